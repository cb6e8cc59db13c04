"""Text functions as Column expressions: canonical forms, personal data, tokens, summaries' scores."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memquarry.session import ship

WORDS = r"[\p{L}\p{N}]+"
LOG_TOKEN = r"[A-Za-z0-9_./:-]{2,}"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

#: kind, pattern; a later kind never rewrites what an earlier one replaced.
PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("credit_card", r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b"),
    ("phone", r"\b\d{3}[-. ]\d{3}[-. ]\d{4}\b|\(\d{3}\) ?\d{3}[-. ]\d{4}\b"),
    ("ip", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
)

#: placeholder, pattern, in the order in which they apply.
CANONICAL = (
    ("<TS>", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?Z?"),
    ("<UUID>", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    ("<HEX>", r"\b[0-9a-fA-F]{16,}\b"),
    ("<INT>", r"\b\d{7,}\b"),
)


def number(c: Column) -> Column:
    """The double that a string spells in full, else null (a trailing d or f isn't a number here)."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORDS})"), F.lit(1))


def log_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({LOG_TOKEN})"), F.lit(1))


def canonicalize_lossy(c: Column) -> Column:
    for mark, pattern in CANONICAL:
        c = F.regexp_replace(c, pattern, mark)
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def canonicalize_lossless(c: Column) -> tuple[Column, Column]:
    """The text with <@> for each typed token, and the tokens from left to right; a single alternation keeps their order right when types mix. A <@> of the text's own is a token, too, so reinflate() gives every text back."""
    any_of = "<@>|" + "|".join(p.replace("(\\.", "(?:\\.") for _, p in CANONICAL)
    return F.regexp_replace(c, any_of, "<@>"), F.regexp_extract_all(c, F.lit(f"({any_of})"), F.lit(1))


def reinflate(canonical: Column, tokens: Column) -> Column:
    parts = F.split(canonical, "<@>")
    return F.array_join(F.zip_with(parts, F.concat(tokens, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def pii_count(c: Column, kind: str) -> Column:
    return F.regexp_count(c, F.lit(dict(PII)[kind])).cast("long")


def pii_redact(c: Column) -> Column:
    for kind, pattern in PII:
        c = F.regexp_replace(c, pattern, f"[{kind.upper()}]")
    return c


def pii_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kind, span_start, span_end (in characters), value of every match of each kind, overlapping kinds included; in order of place within a text. One pass; null texts give no rows."""
    ship(docs.sparkSession)

    def run(batches):
        compiled = [(kind, re.compile(pattern, re.ASCII)) for kind, pattern in PII]
        for b in batches:
            rows = []
            for i, t in enumerate(b.column(1).to_pylist()):
                rows += sorted((i, m.start(), m.end(), kind, m.group()) for kind, p in compiled for m in p.finditer(t or ""))
            of = lambda k, kind: pa.array([r[k] for r in rows], kind)
            yield pa.RecordBatch.from_arrays([b.column(0).take(of(0, pa.int64())), of(3, pa.string()), of(1, pa.int32()), of(2, pa.int32()), of(4, pa.string())], names=[key, "kind", "span_start", "span_end", "value"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, kind string, span_start int, span_end int, value string")


def stem_lite(c: Column) -> Column:
    """A word without ing, ed, es or s where more than two letters stay."""
    out = c
    for end in ("s", "es", "ed", "ing"):
        out = F.when(c.endswith(end) & (F.length(c) > len(end) + 2), c.substr(F.lit(1), F.length(c) - len(end))).otherwise(out)
    return out


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos (from 0), line."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def _best_lines(docs: DataFrame, most, key: str, text: str) -> DataFrame:
    """key, summary, n_lines of each row: its best non-blank lines in their own order, most(number of lines) of them. A line's score is the mean, over its distinct words, of the number of the text's lines that hold the word
    (9 places); ties fall to the earlier line. A text is handled by itself, so nothing is shuffled; texts without a line give no row."""
    ship(docs.sparkSession)

    def one(t: str):
        own = [x for x in t.split("\n") if x.strip(" ")]
        held = [set(regex.findall(WORDS, x.lower())) for x in own]
        lines = Counter(itertools.chain.from_iterable(held))
        scores = [round(sum(map(lines.__getitem__, w)) / len(w), 9) if w else 0.0 for w in held]
        best = sorted(range(len(own)), key=lambda i: (-scores[i], i))[: most(len(own))]
        return "\n".join([own[i] for i in sorted(best)]), len(best)

    def run(batches):
        for b in batches:
            rows = [(i, *one(t)) for i, t in enumerate(b.column(1).to_pylist()) if t]
            rows = [r for r in rows if r[2]]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=[key, "summary", "n_lines"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, summary string, n_lines long")


def top_lines(scored: DataFrame, most: Column, key: str = "doc_id") -> DataFrame:
    """Each text's best lines by score (rounded to 9 places, ties to the earlier line), joined in their own order: key, summary, n_lines."""
    best = Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "pos")
    ranked = scored.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key))).withColumn("r", F.row_number().over(best)).where(F.col("r") <= most)
    rows = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return ranked.groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("summary"), F.count(F.lit(1)).alias("n_lines"))


def auto_summary(docs: DataFrame, share: float = 0.1, most: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    return _best_lines(docs, lambda n: max(1, min(most, int(n * share + 1e-9))), key, text)


def gist(docs: DataFrame, most: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    return _best_lines(docs, lambda n: most, key, text)


def keyword_summary(docs: DataFrame, keywords: list[str], most: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines rated 10 for each keyword that they hold, and 1."""
    hits = sum((F.lower("line").contains(k.lower()).cast("int") for k in keywords), F.lit(0))
    scored = lines(docs, key, text).where(F.trim("line") != "").withColumn("score", (10 * hits + 1).cast("double"))
    return top_lines(scored, F.lit(most), key)


def claims(c: Column, most: int = 3) -> Column:
    """The first sentences of more than 20 characters, cut at full stops."""
    return F.slice(F.filter(F.transform(F.split(c, r"\."), lambda x: F.trim(x)), lambda x: F.length(x) > 20), 1, most)


def skeleton(c: Column) -> Column:
    return F.array_join(F.slice(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != ""), 1, 2), "\n")


def witnesses(c: Column) -> Column:
    return F.filter(F.split(c, "\n"), lambda x: x.startswith("Decision:") | x.startswith("Note:"))


def residual(c: Column) -> Column:
    rest = F.filter(F.split(c, "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("Decision:") & ~x.startswith("Note:"))
    return F.array_join(F.slice(rest, F.lit(3), F.greatest(F.size(rest), F.lit(1))), "\n")


def fingerprint(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 10)


def confidence(tier: Column) -> Column:
    return F.when(tier == 3, 0.95).when(tier == 0, 0.70).otherwise(0.0)


def event_number(c: Column) -> Column:
    """An event id written as an integer, as E and an integer, or in hexadecimal after 0x."""
    return F.when(c.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(c, 3, 32), 16, 10).cast("long")).when(c.rlike(r"^[Ee]?\d+$"), F.regexp_extract(c, r"(\d+)$", 1).cast("long"))


def zigzag(c: Column) -> Column:
    return F.shiftleft(c, 1).bitwiseXOR(F.shiftright(c, 63))


def encrypted(c: Column, key: Column) -> Column:
    """AES-GCM with a fresh nonce for every value."""
    return F.base64(F.aes_encrypt(c, key, F.lit("GCM")))


def decrypted(c: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(c), key, F.lit("GCM")).cast("string")
