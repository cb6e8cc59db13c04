"""Append-only tables in Parquet: chunks, knowledge, evidence, skills, sessions, summaries, audit, files, embeddings; the content-addressed vault; adapters."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "chunks": "id string, source_id string, content string, role string, session_id string, idx long, metadata map<string,string>, created_at timestamp",
    "reasoning_bank": "id string, title string, content string, tags array<string>, evidence_ids array<string>, status string, superseded_by string, session_id string, metadata map<string,string>, created_at timestamp",
    "evidence_packs": "id string, claim string, sources array<string>, confidence double, reasoning string, created_at timestamp",
    "skill_capsules": "id string, name string, description string, procedure string, tags array<string>, version int, created_at timestamp",
    "sessions": "id string, started_at timestamp, ended_at timestamp, metadata map<string,string>",
    "cos": "session_id string, sequence long, summary string, key_facts array<string>, open_questions array<string>, created_at timestamp",
    "audit_log": "id string, action string, target_type string, target_id string, detail string, outcome string, created_at timestamp",
    "files": "path string, content_hash string, size_bytes long, mime_type string, created_at timestamp",
    "commits": "packet_version string, used_tier int, confidence double, text string, text_fingerprint string, created_at timestamp",
    "embedding_cache": "text_hash string, model string, embedding array<float>",
}


class Store:
    """Tables under a folder. Writing appends files; an update is a new row, of which the latest counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, table: str, rows: DataFrame) -> None:
        fields = self.spark.createDataFrame([], TABLES[table]).schema
        have = set(rows.columns)
        rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]).write.mode("append").parquet(f"{self.root}/{table}")

    def table(self, table: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{table}")

    def compact(self, table: str, files: int = 1) -> None:
        """Rewrites a table, into which every write has put files of its own, as a few files. The new folder takes the old one's place by renaming; no other writer may be at work."""
        jvm, conf, name = self.spark._jvm, self.spark._jsc.hadoopConfiguration(), f"{self.root}/{table}"
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(name).getFileSystem(conf)
        if fs.exists(path(name)):
            self.table(table).coalesce(files).write.mode("overwrite").parquet(f"{name}.new")
            fs.rename(path(name), path(f"{name}.old"))
            fs.rename(path(f"{name}.new"), path(name))
            fs.delete(path(f"{name}.old"), True)

    def newest(self, table: str, limit: int = 100) -> DataFrame:
        return self.table(table).orderBy(F.desc("created_at"), "id").limit(limit)

    def audit(self, action: str, target_type: str, target_id: str, detail: str = "", outcome: str = "ok") -> None:
        row = [(uuid.uuid4().hex, action, target_type, target_id, detail, outcome)]
        self.append("audit_log", self.spark.createDataFrame(row, "id string, action string, target_type string, target_id string, detail string, outcome string").withColumn("created_at", F.current_timestamp()))


def hashed_embedding(text: pd.Series, dims: int) -> pd.Series:
    """A deterministic embedding without a model: signed hashes of words, scaled to length 1."""
    import zlib

    import numpy as np

    def one(t):
        v = np.zeros(dims, np.float32)
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % dims] += 1 if h >> 31 else -1
        n = float(np.linalg.norm(v))
        return (v / n if n else v).tolist()

    return text.map(one)


def embedder(dims: int = 64):
    """A pandas UDF from text to vector; any function of the same shape takes its place."""

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        return hashed_embedding(text, dims)

    return embed


def missing_embeddings(texts: DataFrame, cache: DataFrame, model: str, text: str = "content") -> DataFrame:
    """Distinct texts whose digest isn't cached for the model."""
    keyed = texts.select(F.sha2(text, 256).alias("text_hash"), F.col(text).alias("content")).dropDuplicates(["text_hash"])
    return keyed.join(cache.where(F.col("model") == model), "text_hash", "left_anti").withColumn("model", F.lit(model))


def with_embeddings(texts: DataFrame, cache: DataFrame, model: str, text: str = "content") -> DataFrame:
    """texts with their cached vectors, null where there is none."""
    own = cache.where(F.col("model") == model).select("text_hash", "embedding")
    return texts.withColumn("text_hash", F.sha2(text, 256)).join(own, "text_hash", "left")


def vault(files: DataFrame) -> DataFrame:
    """content_hash, path, size_bytes, method, stored_bytes, payload of files (path, content): the smallest of raw, zlib, bz2 and zstandard; files below 128 bytes stay raw. unvaulted() gives the contents back."""

    def run(batches):
        import bz2
        import hashlib
        import zlib

        import zstandard

        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                data = bytes(data)
                forms = {"raw": data}
                if len(data) >= 128:
                    forms |= {"zstd": zstandard.ZstdCompressor(level=19).compress(data), "zlib": zlib.compress(data, 9), "bz2": bz2.compress(data)}
                best = min(forms, key=lambda k: (len(forms[k]), k))
                rows.append((hashlib.sha256(data).hexdigest(), path, len(data), best, len(forms[best]), forms[best]))
            yield pd.DataFrame(rows, columns=["content_hash", "path", "size_bytes", "method", "stored_bytes", "payload"])

    return files.where("content IS NOT NULL").select("path", "content").mapInPandas(run, "content_hash string, path string, size_bytes long, method string, stored_bytes long, payload binary")


def unvaulted(stored: DataFrame) -> DataFrame:
    """content_hash, path, content of vault() rows; a payload whose content doesn't have its digest is an error."""

    def run(batches):
        import bz2
        import hashlib
        import zlib

        import zstandard

        undo = {"raw": bytes, "zlib": zlib.decompress, "bz2": bz2.decompress, "zstd": lambda x: zstandard.ZstdDecompressor().decompress(x)}
        for pdf in batches:
            out = [undo[m](bytes(p)) for m, p in zip(pdf["method"], pdf["payload"])]
            if any(hashlib.sha256(c).hexdigest() != h for c, h in zip(out, pdf["content_hash"])):
                raise ValueError("a payload doesn't have its digest")
            yield pd.DataFrame({"content_hash": pdf["content_hash"], "path": pdf["path"], "content": out})

    return stored.select("content_hash", "path", "method", "payload").mapInPandas(run, "content_hash string, path string, content binary")


def vault_stats(stored: DataFrame) -> DataFrame:
    return stored.groupBy("method").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"), F.sum("stored_bytes").alias("stored_bytes"))


def by_prefix(stored: DataFrame, prefix: str) -> DataFrame:
    """The file of a digest's prefix; none where the prefix fits several digests."""
    hit = stored.where(F.col("content_hash").startswith(prefix))
    n = hit.agg(F.count_distinct("content_hash").alias("n"))
    return hit.crossJoin(F.broadcast(n)).where("n = 1").drop("n")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def message_lines(messages: DataFrame) -> DataFrame:
    """role, content to `[role] content`; line feeds are escaped, so that a message stays one line."""
    return messages.withColumn("line", F.concat(F.lit("["), "role", F.lit("] "), F.replace(F.replace("content", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))))


def line_messages(lines: DataFrame) -> DataFrame:
    """role and content of such lines; a line without a role has the role unknown."""
    pattern = r"^\[([^\]]*)\] (.*)$"
    known = F.col("line").rlike(pattern)
    body = F.when(known, F.regexp_extract("line", pattern, 2)).otherwise(F.col("line"))
    plain = F.replace(F.replace(F.replace(body, F.lit("\\\\"), F.lit("\0")), F.lit("\\n"), F.lit("\n")), F.lit("\0"), F.lit("\\"))
    return lines.withColumn("role", F.when(known, F.regexp_extract("line", pattern, 1)).otherwise("unknown")).withColumn("content", plain)


_ESCAPES = (("%", "%25"), (" ", "%20"), ("=", "%3D"), ("\n", "%0A"))


def _escaped(c):
    for plain, code in _ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def _plain(c):
    for plain, code in reversed(_ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def span_lines(spans: DataFrame) -> DataFrame:
    """Spans (name, trace_id, span_id, parent_id, status, attributes) as `SPAN name k=v ...` lines, attributes sorted by name. Percent signs, blanks, equals signs and line feeds of names, keys and values are written as %25, %20, %3D and %0A; a null value is left out."""
    pairs = F.array_sort(F.transform(F.filter(F.map_entries("attributes"), lambda e: e["value"].isNotNull()), lambda e: F.concat(_escaped(e["key"]), F.lit("="), _escaped(e["value"]))))
    fixed = [F.concat(F.lit(f"{c}="), F.coalesce(_escaped(F.col(c)), F.lit(""))) for c in ("trace_id", "span_id", "parent_id", "status")]
    return spans.withColumn("line", F.concat_ws(" ", F.lit("SPAN"), _escaped(F.col("name")), *fixed, F.array_join(pairs, " ")))


def line_spans(lines: DataFrame) -> DataFrame:
    """The name and fields of such lines."""
    rest = F.regexp_extract("line", r"^SPAN \S+ ?(.*)$", 1)
    fields = F.map_from_entries(F.transform(F.map_entries(F.str_to_map(rest, F.lit(" "), F.lit("="))), lambda e: F.struct(_plain(e["key"]), _plain(e["value"]))))
    return lines.where(F.col("line").startswith("SPAN ")).withColumn("name", _plain(F.regexp_extract("line", r"^SPAN (\S+)", 1))).withColumn("fields", fields)
