"""Quality by compression: zstandard ratios (bytes over compressed bytes) of whole documents and of fixed chunks.

Repetitive text compresses too well, random text too little. What is usual depends on the length, as a short text has no history to refer to; so each length band has
its own limits. A document is rejected where its whole ratio lies outside its band, or where chunks outside theirs make up at least `bad_share` of its bytes.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memquarry.llm.common import mapped

LEVEL, CHUNK, BAD_SHARE = 3, 4096, 0.25
#: least bytes of a band: least and largest ratio. Prose in Latin script has 1.1 to 1.8 at 200 bytes, 1.7 to 2.3 at 2 kB and up to 3.5 beyond 16 kB;
#: random letters and digits have 1.3 at any length, a repeated line 5 and more. Below 64 bytes prose has 0.6 to 1.1 and noise no less, so there only repetition shows.
LIMITS = ((0, 0.0, 1.5), (32, 0.0, 1.8), (64, 0.8, 2.2), (128, 0.95, 2.5), (256, 1.1, 2.8), (512, 1.2, 3.2), (1024, 1.33, 3.5), (4096, 1.4, 4.5), (16384, 1.45, 5.5))


def limits(n: int, bands=LIMITS) -> tuple[float, float]:
    """Least and largest ratio for a length in bytes."""
    low, high = 0.0, 1e9
    for at, a, b in bands:
        if n < at:
            break
        low, high = a, b
    return low, high


def rate(text: str | None, compressor, chunk: int = CHUNK, bad_share: float = BAD_SHARE, bands=LIMITS) -> tuple[float | None, float | None, float | None, str]:
    """Whole ratio, least and largest chunk ratio, verdict: keep, repetitive or incompressible. A null or empty text has no ratios and is kept, as nothing speaks against it."""
    data = text.encode("utf-8", "replace") if text else b""
    if not data:
        return None, None, None, "keep"
    ratio = lambda b: len(b) / len(compressor.compress(b))
    whole = ratio(data)
    low, high = limits(len(data), bands)
    parts = [data[i : i + chunk] for i in range(0, len(data), chunk)] if len(data) > chunk else [data]
    rates = [ratio(p) for p in parts] if len(parts) > 1 else [whole]
    dull = sum(len(p) for p, r in zip(parts, rates) if r > limits(len(p), bands)[1])
    noisy = sum(len(p) for p, r in zip(parts, rates) if r < limits(len(p), bands)[0])
    verdict = "keep"
    if whole > high or dull >= bad_share * len(data):
        verdict = "repetitive"
    elif whole < low or noisy >= bad_share * len(data):
        verdict = "incompressible"
    return whole, min(rates), max(rates), verdict


def rated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, bad_share: float = BAD_SHARE, bands=LIMITS) -> DataFrame:
    """doc_id, ratio, least_chunk, largest_chunk (4 places), verdict, keep: one row per row of docs; one pass, no shuffle.

    Null and empty texts have null ratios and are kept; null ids and repeated rows stay as they are; an empty table gives an empty one; other columns, whatever their names, aren't read. Texts are
    compressed whole, however long.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            rows = [rate(t, compressor, chunk, bad_share, bands) for t in b.column(1).to_pylist()]
            numbers = [pa.array([None if r[k] is None else round(r[k], 4) for r in rows], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *numbers, pa.array([r[3] for r in rows], pa.string()), pa.array([r[3] == "keep" for r in rows], pa.bool_())], names=["doc_id", "ratio", "least_chunk", "largest_chunk", "verdict", "keep"]
            )

    return mapped(docs.select(F.col(doc_id), F.col(text)), run, f"doc_id {kind}, ratio double, least_chunk double, largest_chunk double, verdict string, keep boolean")
