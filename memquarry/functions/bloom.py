"""Bloom filters as binary columns: built per group from tokens, tested without the tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memquarry.session import ship, written


def _places(token: Column, bits: int, hashes: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(token, F.lit(i)), F.lit(bits)) for i in range(hashes)])


def blooms(tokens: DataFrame, group: str, token: str = "token", bits: int = 8192, hashes: int = 4) -> DataFrame:
    """group, bloom (binary) of each group's tokens; partial aggregation keeps at most `bits` places a group."""

    @F.pandas_udf("binary")
    def packed(places: pd.Series) -> pd.Series:
        def one(p):
            b = np.zeros(bits, np.uint8)
            b[np.asarray(p, np.int64)] = 1
            return np.packbits(b, bitorder="little").tobytes()

        return places.map(one)

    placed = tokens.select(group, F.explode(_places(F.col(token), bits, hashes)).alias("p"))
    return placed.groupBy(group).agg(F.collect_set("p").alias("ps")).select(group, packed("ps").alias("bloom"))


def might_hold(bloom: Column, token: Column, bits: int = 8192, hashes: int = 4) -> Column:
    """False only where the token isn't in the group."""
    out = F.lit(True)
    for i in range(hashes):
        p = F.pmod(F.xxhash64(token, F.lit(i)), F.lit(bits))
        byte = F.conv(F.hex(F.substring(bloom, (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        out = out & (F.pmod(F.floor(byte / F.pow(F.lit(2), p % 8)).cast("long"), F.lit(2)) == 1)
    return out


def false_positive_rate(filters: DataFrame, unseen: DataFrame, token: str = "token", bits: int = 8192, hashes: int = 4) -> DataFrame:
    """rate: hits of tokens that no group holds, over all tests.

    All tokens meet all filters, but as bits: in each block of filters a place of the filter is one row of bits, a bit a filter, and a token's hits are the bits that its places' rows have in common. Blocks of filters and of tokens meet in tasks of bounded memory.
    """
    ship(filters.sparkSession)
    held, asked = written(filters.where("bloom IS NOT NULL").select("bloom"), "blooms"), written(unseen.select(_places(F.col(token), bits, hashes).cast("array<int>").alias("places")), "places")
    n_held, n_asked = held.count(), asked.count()
    width = max(64, (1 << 26) // bits)
    fb = max(1, -(-n_held // width))
    tb = max(-(-n_asked // (1 << 20)), -(-24 // fb))
    block = lambda n: (F.monotonically_increasing_id() % n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = written(held.select("bloom", block(fb).alias("f")), "blooms").select("bloom", "f", every(tb).alias("t"))
    right = written(asked.select("places", block(tb).alias("t_")), "places").select("places", "t_", every(fb).alias("f_"))

    def run(blooms: pa.Table, tokens: pa.Table) -> pa.Table:
        hits, n = 0, blooms.num_rows
        if n and tokens.num_rows:
            rows = np.zeros((-(-n // 64) * 64, -(-bits // 8)), np.uint8)
            for i, b in enumerate(blooms["bloom"].to_pylist()):
                rows[i] = np.frombuffer(b, np.uint8)
            by_place = np.ascontiguousarray(np.packbits(np.unpackbits(rows, axis=1, bitorder="little")[:, :bits], axis=0).T).view(np.uint64)
            places = tokens["places"].combine_chunks().flatten().to_numpy().reshape(-1, hashes)
            for start in range(0, len(places), 8192):
                part = places[start : start + 8192]
                common = by_place[part[:, 0]]
                for k in range(1, hashes):
                    common &= by_place[part[:, k]]
                hits += int(np.bitwise_count(common).sum(dtype=np.int64))
        return pa.table({"hits": pa.array([hits], pa.int64())})

    found = left.groupBy("f", "t").cogroup(right.groupBy("f_", "t_")).applyInArrow(run, "hits long")
    return found.agg((F.sum("hits") / F.lit(n_held * n_asked)).alias("rate") if n_held * n_asked else F.lit(None).cast("double").alias("rate"))
