"""Approximate nearest vectors by cells: k-means centroids fitted on a bounded sample, every vector in the cell of its nearest centroid, queries answered from the cells of their nearest centroids.

Vectors are kept normalised, so a cosine is one product. Cells are stored as Parquet sorted by cell; large ones are parted into blocks, so no task holds a whole cell that many vectors share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memquarry.session import passing_path, ship

SAMPLE, MOST_CELLS, BLOCK = 20_000, 4096, 8192


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class CellIndex:
    """An index over (key, vector); `recall` against exact search grows with `probes`, the cells that a query reads."""

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE, seed: int = 3):
        """Fits on at most `sample` vectors, those of the least seeded hash of their keys, and stores all. Cells: about the root of the number of vectors, 16 to 4,096. Null keys and vectors are left out; without any vector searches find nothing."""
        self.spark, self.kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
        ship(self.spark)
        rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("v")).where("key IS NOT NULL AND v IS NOT NULL")
        n = rows.count()
        drawn = rows.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(sample).select("v").toPandas()
        self.centroids = self._fitted(drawn["v"].tolist(), cells or int(min(MOST_CELLS, max(16, n**0.5))), seed)
        self.path = passing_path(self.spark, "cells")
        stored = self._placed(rows, 1).select(F.col("cells")[0].alias("cell"), "key", "v")
        stored.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(16))).sortWithinPartitions("cell").write.parquet(self.path)

    @staticmethod
    def _fitted(rows: list, cells: int, seed: int, rounds: int = 10) -> np.ndarray:
        if not rows:
            return np.zeros((1, 1), np.float32)
        x, rng = _unit(np.stack(rows).astype(np.float32)), np.random.default_rng(seed)
        c = x[rng.permutation(len(x))[: min(cells, len(x))]].copy()
        for _ in range(rounds):
            own = (x @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            held = np.bincount(own, minlength=len(c)) > 0
            c[held] = _unit(sums[held])
        return c

    def _placed(self, rows: DataFrame, probes: int) -> DataFrame:
        """rows with their `probes` nearest cells and their vectors at length 1."""
        known = self.spark.sparkContext.broadcast(self.centroids)  # at most MOST_CELLS vectors
        kind = rows.schema["key"].dataType.simpleString()

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    x = _unit(np.stack(pdf["v"].tolist()).astype(np.float32))
                    near = x @ known.value.T
                    k = min(probes, near.shape[1])
                    yield pd.DataFrame({"key": pdf["key"], "v": list(x), "cells": list(np.argsort(-near, axis=1, kind="stable")[:, :k].astype(np.int32))})

        return rows.select("key", "v").mapInPandas(run, f"key {kind}, v array<float>, cells array<int>")

    def calibrated(self, k: int = 10, target: float = 0.95, sample: int = 256, seed: int = 5) -> int:
        """The fewest probes at which `target` of the true k nearest of at most `sample` stored vectors (by a seeded hash) are found, measured against all vectors: one scan, of which the driver gets k rows a query."""
        held = self.spark.read.parquet(self.path)
        drawn = held.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(sample).toPandas()
        if drawn.empty:
            return 1
        q, keys = np.stack(drawn["v"].tolist()), drawn["key"].to_numpy()
        order = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")
        known = self.spark.sparkContext.broadcast((q, keys))

        def run(batches):
            q, keys = known.value
            for pdf in batches:
                out = []
                if len(pdf):
                    s = q @ np.stack(pdf["v"].tolist()).T
                    s[keys[:, None] == pdf["key"].to_numpy()[None, :]] = -2.0
                    for i, row in enumerate(s):
                        near = np.argsort(-row, kind="stable")[:k]
                        out += [(i, int(c), float(x)) for c, x in zip(pdf["cell"].to_numpy()[near], row[near]) if x > -2.0]
                yield pd.DataFrame(out, columns=["i", "cell", "cosine"])

        nearest = Window.partitionBy("i").orderBy(F.desc("cosine"))
        best = held.mapInPandas(run, "i int, cell int, cosine double").withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k).toPandas()
        place = np.argsort(order, axis=1)[best["i"].to_numpy(), best["cell"].to_numpy()]
        return int(np.sort(place)[max(0, int(np.ceil(target * len(place))) - 1)]) + 1 if len(place) else 1

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """query, neighbour, cosine, rank of the k nearest other vectors of each query (key, vector), from its `probes` nearest cells, by default as many as calibrated() says; ties to the smaller key."""
        probes = probes or self.calibrated(k)
        kind, own = self.kind, queries.schema[key].dataType.simpleString()
        asked = queries.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("v")).where("key IS NOT NULL AND v IS NOT NULL")
        asked = self._placed(asked, probes).select(F.col("key").alias("query"), F.col("v").alias("q"), F.explode("cells").alias("cell"))
        held = self.spark.read.parquet(self.path)
        size = held.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        left = held.join(size, "cell").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).select("cell", "block", "key", "v")
        right = asked.join(size, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "block", "query", "q")

        def best(vectors: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(vectors) and len(wanted):
                vectors = vectors.sort_values("key", ignore_index=True)
                x, keys = np.stack(vectors["v"].tolist()), vectors["key"].to_numpy()
                for at in range(0, len(wanted), 512):
                    part = wanted.iloc[at : at + 512]
                    s = np.stack(part["q"].tolist()) @ x.T
                    for row, q in zip(s, part["query"]):
                        row = np.where(keys == q, -2.0, row)
                        for i in np.argsort(-row, kind="stable")[:k]:
                            if row[i] > -2.0:
                                out.append((q, keys[i], float(row[i])))
            return pd.DataFrame(out, columns=["query", "neighbour", "cosine"])

        found = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInPandas(best, f"query {own}, neighbour {kind}, cosine double")
        order = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
        return found.select("query", "neighbour", F.round("cosine", 6).alias("cosine")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
