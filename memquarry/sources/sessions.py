"""Session transcripts in JSON lines, of three dialects, as rows of messages; and the text chunker for what is stored.

The dialect of a file is that of its first line that parses: nested ({type: message, message: {role, content}}, or a session header), flat ({type: user|assistant,
message: {content}}), otherwise generic. Lines that don't parse are left out.
"""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memquarry.session import ship

LEAST, TOOL_MOST, VALUE_MOST, GENERIC_MOST = 20, 2000, 200, 5000
ROLES = ("user", "assistant")
SCHEMA = "file string, line_no long, part int, role string, content string"


def dialect_of(record) -> str | None:
    if not isinstance(record, dict):
        return None
    kind, message = record.get("type"), record.get("message")
    if kind == "session" or kind == "message" and isinstance(message, dict) and "role" in message:
        return "nested"
    if kind in ("user", "assistant", "file-history-snapshot"):
        return "flat"
    return "generic"


def flatten(content) -> str:
    """The text of a message's content, a string or a list of blocks."""
    if isinstance(content, str):
        return content.strip()
    parts = []
    for block in content if isinstance(content, list) else []:
        if isinstance(block, str):
            parts.append(block)
        elif isinstance(block, dict) and block.get("type") == "text":
            parts.append(str(block.get("text", "")))
        elif isinstance(block, dict) and block.get("type") == "tool_result":
            text = flatten(block.get("content", ""))
            if len(text) <= TOOL_MOST:
                parts.append(text)
    return "\n".join(parts).strip()


def tool_calls(content):
    for block in content if isinstance(content, list) else []:
        if isinstance(block, dict) and block.get("type") in ("tool_use", "toolCall"):
            given = block.get("input", block.get("arguments", {}))
            given = given if isinstance(given, dict) else {}
            yield "\n".join([f"Tool: {block.get('name', 'unknown')}", *(f"  {k}: {str(v)[:VALUE_MOST]}" for k, v in given.items())])


def any_text(value, depth: int = 3) -> str:
    if isinstance(value, str):
        return value
    if depth <= 0:
        return ""
    if isinstance(value, dict):
        return "\n".join(t for k in ("content", "text", "summary", "message") if (t := any_text(value.get(k), depth - 1)))
    if isinstance(value, list):
        return "\n".join(t for x in value[:10] if (t := any_text(x, depth - 1)))
    return ""


def messages(record, dialect: str):
    """(role, content) of one record."""
    if dialect == "generic":
        text = any_text(record)[:GENERIC_MOST].strip()
        if len(text) >= LEAST:
            yield "unknown", text
        return
    message = record.get("message") if isinstance(record.get("message"), dict) else {}
    role = message.get("role") if dialect == "nested" else record.get("type")
    if dialect == "nested" and record.get("type") != "message":
        return
    text = flatten(message.get("content", ""))
    if role in ROLES:
        if len(text) >= LEAST:
            yield role, text
        for call in tool_calls(message.get("content")):
            yield "tool", call
    elif role == "toolResult" and dialect == "nested" and LEAST <= len(text) <= TOOL_MOST:
        yield "tool_result", text


def parse_lines(lines: DataFrame) -> DataFrame:
    """file, line_no, part, role, content, idx from rows (file, line_no, line). The dialect is found by a partial minimum, so files needn't fit a task."""
    ship(lines.sparkSession)

    def load(text):
        try:
            return json.loads(text)
        except (TypeError, ValueError):
            return None

    def sniff(batches):
        for pdf in batches:
            kinds = [dialect_of(load(t)) for t in pdf["line"]]
            yield pd.DataFrame({"file": pdf["file"], "line_no": pdf["line_no"], "kind": kinds})

    def read(batches):
        for pdf in batches:
            rows = []
            for file, n, text, kind in zip(pdf["file"], pdf["line_no"], pdf["line"], pdf["dialect"]):
                record = load(text)
                if isinstance(record, dict):
                    rows += [(file, n, i, role, content) for i, (role, content) in enumerate(messages(record, kind))]
            yield pd.DataFrame(rows, columns=["file", "line_no", "part", "role", "content"])

    kinds = lines.select("file", "line_no", "line").mapInPandas(sniff, "file string, line_no long, kind string").where("kind IS NOT NULL")
    dialect = kinds.groupBy("file").agg(F.min_by("kind", "line_no").alias("dialect"))
    parsed = lines.join(dialect, "file").select("file", "line_no", "line", "dialect").mapInPandas(read, SCHEMA)
    return parsed.withColumn("idx", (F.row_number().over(Window.partitionBy("file").orderBy("line_no", "part")) - 1).cast("long"))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Messages of all session files under a path. Line numbers within a file follow the file's order."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    numbered = raw.withColumn("line_no", F.row_number().over(Window.partitionBy("file").orderBy("block", "at")).cast("long"))
    return parse_lines(numbered.select("file", "line_no", "line"))


def stored(parsed: DataFrame) -> DataFrame:
    """Chunks to store, of users and assistants only; the id is a digest of session, place and content, so reading a file again gives the same ids."""
    session = F.regexp_extract("file", r"([^/]+?)(\.\w+)?$", 1)
    return parsed.where(F.col("role").isin(*ROLES)).select(
        F.sha2(F.concat_ws("|", session, F.col("idx").cast("string"), "content"), 256).alias("id"), session.alias("session_id"), "role", "content", "idx"
    )


def chunk_text(text: str | None, size: int = 2000, overlap: int = 200) -> list[str]:
    """Windows of `size` characters that end, where the later half has one, after a blank line, a line feed, a full stop and a space, or a space; each begins `overlap` before the last one's end."""
    text = text or ""
    if len(text) <= size:
        return [text] if text.strip() else []
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            for mark in ("\n\n", "\n", ". ", " "):
                at = text.rfind(mark, start, end)
                if at > start + size // 2:
                    end = at + len(mark)
                    break
        if part := text[start:end].strip():
            out.append(part)
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def chunked(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 2000, overlap: int = 200) -> DataFrame:
    """key, idx, content."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<string>")
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda t: chunk_text(t, size, overlap))

    return docs.select(key, F.posexplode(of(F.col(text))).alias("idx", "content"))


def line_groups(docs: DataFrame, n: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, idx, content: groups of n lines."""
    lines = F.split(text, "\n")
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / n).cast("int")), lambda i: F.array_join(F.slice(lines, i * n + 1, F.lit(n)), "\n"))
    return docs.select(key, F.posexplode(groups).alias("idx", "content"))


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, idx, content: texts cut at blank lines, blanks around each paragraph removed, empty ones left out."""
    parts = F.filter(F.transform(F.split(text, r"\n[ \t]*\n"), lambda x: F.trim(x)), lambda x: x != "")
    return docs.select(key, F.posexplode(parts).alias("idx", "content"))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """event_id, template from a CSV file with the columns EventId and EventTemplate."""
    from memquarry.functions.text import event_number

    raw = spark.read.option("header", True).schema("EventId string, EventTemplate string").csv(path)
    return raw.select(event_number(F.col("EventId")).alias("event_id"), F.col("EventTemplate").alias("template"))


def changed_files(listing: DataFrame, seen: DataFrame) -> DataFrame:
    """Files (path, length, modificationTime) that are new or changed since they were seen."""
    mark = F.md5(F.concat_ws(":", F.col("length").cast("string"), F.col("modificationTime").cast("string")))
    return listing.withColumn("mark", mark).join(seen.select("path", "mark"), ["path", "mark"], "left_anti")


def write_json(rows: DataFrame, path: str | Path) -> None:
    rows.write.mode("overwrite").json(str(path))
