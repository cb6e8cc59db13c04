"""Sequences: motifs, rolling anomaly scores, hash chains, interleaving, timelines, delta codes."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memquarry.session import ship


def rolling_z(rows: DataFrame, by: str, order: list[str], value: str, size: int = 50, least: int = 5) -> DataFrame:
    """rows with z (6 places; null before `least` prior values) and severity: z < -2 medium, < -3 high, > 3 low, > 4.5 medium. A deviation of 0 counts as 0.001."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-size, -1)
    n, mean, dev = F.count(value).over(w), F.avg(value).over(w), F.stddev_pop(value).over(w)
    z = F.when(n >= least, F.round((F.col(value) - mean) / F.when(dev < 1e-12, 0.001).otherwise(dev), 6))
    severity = F.when(F.col("z") < -3, "high").when(F.col("z") < -2, "medium").when(F.col("z") > 4.5, "medium").when(F.col("z") > 3, "low")
    return rows.withColumn("z", z).withColumn("severity", severity)


def drift(rows: DataFrame, by: str, order: list[str], value: str, size: int = 50) -> DataFrame:
    """by, n, mean, std, trend (mean of the later half less that of the earlier) and drifting, of the last `size` values."""
    w = Window.partitionBy(by).orderBy(*[F.desc(o) for o in order])
    last = rows.withColumn("back", F.row_number().over(w)).where(F.col("back") <= size).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(by)))
    later = F.col("back") <= F.col("n") - F.floor(F.col("n") / 2)
    out = last.groupBy(by).agg(F.max("n").alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), (F.avg(F.when(later, F.col(value))) - F.avg(F.when(~later, F.col(value)))).alias("t"))
    return out.select(by, "n", F.round("m", 6).alias("mean"), F.round("s", 6).alias("std"), F.round(F.coalesce("t", F.lit(0.0)), 6).alias("trend"), (F.abs(F.coalesce("t", F.lit(0.0))) > F.col("s")).alias("drifting"))


def _ngrams(events: DataFrame, by: str, order: list[str], event: str, least: int, most: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    ahead = F.collect_list(event).over(w.rowsBetween(0, most - 1))
    held = events.select(by, F.row_number().over(w).alias("start"), ahead.alias("ahead"))
    n = F.explode(F.sequence(F.lit(least), F.greatest(F.size("ahead"), F.lit(least)))).alias("n")
    return held.select(by, "start", "ahead", n).where(F.col("n") <= F.size("ahead")).select(by, "start", "n", F.array_join(F.slice("ahead", F.lit(1), F.col("n")), ">").alias("motif"))


def motifs(events: DataFrame, by: str, order: list[str], event: str, least: int = 3, most: int = 10, repeats: int = 2) -> DataFrame:
    """by, motif, n, occurrences, first_start, weight (occurrences times n) of runs of least to most events that occur at least `repeats` times in a sequence, overlaps included.

    Sequences come in order and are counted in memory one at a time, so only events are shuffled: a run of n events is numbered by that of its first n - 1 and its last one, which takes one sort of the sequence for each length.
    """
    ship(events.sparkSession)
    schema = f"{by} {events.schema[by].dataType.simpleString()}, motif string, n int, occurrences long, first_start long"

    def spelled(labels):
        """Runs by their spelling, where an event is null (it is left out of each window) or holds the separator, so different runs may be spelled alike."""
        found: dict = {}
        for i in range(len(labels)):
            ahead = [x for x in labels[i : i + most] if x is not None]
            for n in range(least, len(ahead) + 1):
                at = found.setdefault((">".join(ahead[:n]), n), [0, i + 1])
                at[0] += 1
        return [(m, n, k, start) for (m, n), (k, start) in found.items() if k >= repeats]

    def counted(codes, names, plain):
        labels = [names[c] for c in codes] if not plain else None
        if labels is not None:
            return spelled(labels)
        out, run = [], codes
        for n in range(2, most + 1):
            if len(codes) < n:
                break
            run = run[: len(codes) - n + 1] * len(names) + codes[n - 1 :]
            _, first, run, k = np.unique(run, return_index=True, return_inverse=True, return_counts=True)
            if n >= least:
                for i in np.flatnonzero(k >= repeats):
                    out.append((">".join(names[c] for c in codes[first[i] : first[i] + n]), n, int(k[i]), int(first[i]) + 1))
        return out

    def run(batches):
        def rows(key, parts):
            e = pa.chunked_array(parts).combine_chunks().dictionary_encode(null_encoding="encode")
            names = e.dictionary.to_pylist()
            plain = least >= 2 and all(x is not None and ">" not in x and x for x in names)
            return [(key, *r) for r in counted(e.indices.to_numpy(zero_copy_only=False).astype(np.int64), names, plain)]

        key, parts, ready = None, [], []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in ready], t) for k, t in enumerate((kind, pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=[by, "motif", "n", "occurrences", "first_start"])

        for b in batches:
            keys = b.column(0)
            ends = pc.run_end_encode(keys).run_ends.to_pylist() if len(keys) else []
            start = 0
            for end in ends:
                this = keys[start].as_py()
                if parts and this != key:
                    ready += rows(key, parts)
                    parts = []
                key = this
                parts.append(b.column(1).slice(start, end - start))
                start = end
                if len(ready) > 20_000:
                    yield batch()
                    ready = []
        if parts:
            ready += rows(key, parts)
        if ready:
            yield batch()

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(events.schema[by].dataType)
    held = events.repartition(by).sortWithinPartitions(by, *order).select(by, event)
    return held.mapInArrow(run, schema).withColumn("weight", F.col("occurrences") * F.col("n"))


def longest_known(events: DataFrame, by: str, order: list[str], event: str, least: int = 3, most: int = 10) -> DataFrame:
    """by, place, longest: at each event the length of the longest run ending there that has occurred before."""
    grams = _ngrams(events, by, order, event, least, most).withColumn("place", F.col("start") + F.col("n") - 1)
    seen = grams.withColumn("times", F.row_number().over(Window.partitionBy(by, "motif").orderBy("place")))
    return seen.where("times >= 2").groupBy(by, F.col("place").cast("long").alias("place")).agg(F.max("n").alias("longest"))


def motif_encode(events: DataFrame, by: str, order: list[str], event: str, least: int = 3, most: int = 10) -> DataFrame:
    """by, encoded, n_events, n_symbols, savings, parts, motifs: each sequence with all its repeated runs, numbered from the heaviest, replaced from left to right by M and a number.

    parts are the symbols, an event that itself begins with M and a digit or with a backslash behind a backslash, encoded the same joined by blanks; motifs are the runs by number, those that are used or not. Null events are left out.
    motif_decode() gives the events back. One sequence is handled at a time.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        seq = [str(e) for e in pdf.sort_values(order)[event].tolist()]
        counts: dict = {}
        for n in range(least, most + 1):
            for i in range(len(seq) - n + 1):
                g = tuple(seq[i : i + n])
                counts[g] = counts.get(g, 0) + 1
        runs = sorted((g for g, c in counts.items() if c > 1), key=lambda g: (-counts[g] * len(g), g))
        table = {g: k for k, g in enumerate(runs)}
        out, i = [], 0
        while i < len(seq):
            n = next((n for n in range(most, least - 1, -1) if tuple(seq[i : i + n]) in table and i + n <= len(seq)), 0)
            out.append(f"M{table[tuple(seq[i:i + n])]}" if n else "\\" + seq[i] if _LIKE_MOTIF.match(seq[i]) else seq[i])
            i += n or 1
        return pd.DataFrame({by: [pdf[by].iloc[0]], "encoded": [" ".join(out)], "n_events": [len(seq)], "n_symbols": [len(out)], "savings": [round(1 - len(out) / len(seq), 6)], "parts": [out], "motifs": [[list(g) for g in runs]]})

    schema = f"{by} {events.schema[by].dataType.simpleString()}, encoded string, n_events long, n_symbols long, savings double, parts array<string>, motifs array<array<string>>"
    return events.where(F.col(event).isNotNull()).select(by, event, *[o for o in order if o not in (by, event)]).groupBy(by).applyInPandas(one, schema)


_LIKE_MOTIF = re.compile(r"M\d|\\")


def motif_decode(encoded: DataFrame, by: str) -> DataFrame:
    """by, place (from 0), event: the events of motif_encode()'s sequences in their order; built-in functions only."""
    part = lambda x: F.when(x.rlike(r"^M\d+$"), F.get("motifs", F.substring(x, 2, 20).cast("int"))).otherwise(F.array(F.when(x.startswith("\\"), F.substring(x, 2, 1 << 30)).otherwise(x)))
    return encoded.select(by, F.posexplode(F.flatten(F.transform("parts", part))).alias("place", "event"))


def hash_chain(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """by, place, link: link = sha256(previous link || sha256(value)), the first after 32 zero bytes; a null value counts as an empty one. Sequences are read once in order from sorted partitions, so one may be of any length."""
    ship(rows.sparkSession)
    kind = rows.schema[by].dataType.simpleString()

    def run(batches):
        own, place, link = object(), 0, b""
        for b in batches:
            places, links = [], []
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != own:
                    own, place, link = k, 0, bytes(32)
                link = hashlib.sha256(link + bytes.fromhex(v)).digest()
                places.append(place)
                links.append(link.hex())
                place += 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(places, pa.int32()), pa.array(links, pa.string())], names=[by, "place", "link"])

    digest = F.sha2(F.coalesce(F.col(value).cast("string"), F.lit("")), 256).alias("__digest")
    placed = rows.select(by, order, digest).repartition(by).sortWithinPartitions(by, order).select(by, "__digest")
    return placed.mapInArrow(run, f"{by} {kind}, place int, link string")


def verify_chain(rows: DataFrame, links: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """by, place, ok: whether each stored link follows from the stored one before it and the value, which localises a change to its place."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(value).alias("v")))), lambda x: x["v"])
    placed = rows.groupBy(by).agg(values.alias("vs")).select(by, F.posexplode("vs").alias("place", "v"))
    before = F.coalesce(F.lag("link").over(Window.partitionBy(by).orderBy("place")), F.lit("0" * 64))
    stored = links.withColumn("before", before)
    return placed.join(stored, [by, "place"], "left").select(by, "place", F.coalesce(F.col("link") == F.sha2(F.concat(F.unhex("before"), F.unhex(F.sha2("v", 256))), 256), F.lit(False)).alias("ok"))


def interleave(rows: DataFrame, stream: str, order: str) -> DataFrame:
    """rows with `turn` (from 0) in their stream; round robin is the order by (turn, stream)."""
    return rows.withColumn("turn", (F.row_number().over(Window.partitionBy(stream).orderBy(order)) - 1).cast("long"))


def snapshot(rows: DataFrame, order: str, at) -> DataFrame:
    return rows.where(F.col(order) <= at)


def between(rows: DataFrame, order: str, a, b) -> DataFrame:
    """What was added between two places, whichever comes first."""
    return rows.where((F.col(order) > min(a, b)) & (F.col(order) <= max(a, b)))


def latest(rows: DataFrame, by: str, order: str) -> DataFrame:
    """The row of the largest order of each group, by partial maxima."""
    rest = [c for c in rows.columns if c not in (by, order)]
    best = rows.groupBy(by).agg(F.max(F.struct(order, *rest)).alias("m"))
    return best.select(by, *[F.col(f"m.{c}").alias(c) for c in (order, *rest)])


def deltas(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """rows with `delta`, the difference from the value before (the first as it is), and its zigzag code."""
    before = F.lag(value, 1, 0).over(Window.partitionBy(by).orderBy(*order))
    d = F.col(value).cast("long") - before
    return rows.withColumn("delta", d).withColumn("code", F.shiftleft("delta", 1).bitwiseXOR(F.shiftright("delta", 63)))


def undo_deltas(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    return rows.withColumn("value", F.sum("delta").over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
