"""Mixing sources to target weights by fitting each source's token budget as a subset sum.

Documents are counted by exact token length within each source. A source whose budget is less than its tokens first takes the same share of every
length (rounded down); a bounded-knapsack dynamic programme over the counts that are left then fills the remaining budget as closely as it can. Of
each length as many documents are taken as that gives, in the order of a seeded hash of their ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memquarry.llm.common import written
from memquarry.llm.token_counts import RANKS, with_counts
from memquarry.session import ship

ALPHA, SEED = 0.7, 17
BROADCAST_IDS = 200_000  # ids of some 40 bytes: 8 MB
TABLE = 1 << 20  # tokens that the dynamic programme goes up to where fewer can't be filled
RANKED = 50_000  # documents of one source and length that one task ranks, about


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length make the largest sum of at most budget, by dynamic programming over 0..budget. parent[s] is the length that first reached s."""
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return take
    parent = np.full(budget + 1, -1, np.int32)
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        if n <= 0 or n > budget:
            continue
        new = np.flatnonzero(reached)
        for _ in range(min(int(counts[i]), budget // n)):
            new = new[new <= budget - n] + n
            new = new[~reached[new]]
            if not len(new):
                break
            reached[new] = True
            parent[new] = i
        if reached[budget]:
            break
    s = int(np.flatnonzero(reached)[-1])
    while s:
        take[parent[s]] += 1
        s -= int(lengths[parent[s]])
    return take


def plan(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take for a budget of tokens; a length of 0 is taken whole, as it costs nothing. The dynamic programme is left four times the longest document, and where that can't be filled exactly four times as much
    each time, up to TABLE tokens; within them the sum is the largest of all choices."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    most = 4 * int(lengths.max())
    while True:
        share = counts * (max(0, budget - most) / total)
        base = np.minimum(np.floor(share).astype(np.int64), counts)
        base[lengths == 0] = counts[lengths == 0]
        left = budget - int((base * lengths).sum())
        # largest remainders first, until what is left is a few documents' worth
        for i in np.lexsort((lengths, -(share - base))):
            if left <= most:
                break
            if base[i] < counts[i] and lengths[i]:
                base[i] += 1
                left -= int(lengths[i])
        more = fill(lengths, counts - base, left)
        if most >= min(budget, TABLE) or int((more * lengths).sum()) == left:
            return base + more
        most *= 4  # what is left can't be filled: leave more to the programme


def budgets(totals: dict, weights: dict | None, total: int | None, alpha: float) -> dict:
    """Tokens by source. Without weights they are tokens ** alpha; without a total it is the largest at which no source needs more than it has."""
    w = {s: float(t) ** alpha if t else 0.0 for s, t in totals.items()} if weights is None else {s: float(weights.get(s, 0.0)) for s in totals}
    whole = sum(w.values())
    if not whole:
        return dict.fromkeys(totals, 0)
    if total is None:
        total = min(totals[s] * whole / w[s] for s in totals if w[s])
    return {s: min(int(total * w[s] / whole + 1e-6), totals[s]) for s in totals}


def select(docs: DataFrame, weights: dict | None = None, total: int | None = None, alpha: float = ALPHA, seed: int = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text", path: str = RANKS) -> DataFrame:
    """doc_id, source, n_tokens of the selected documents. weights: source to share, others 0; total: tokens of the whole mixture.

    Rows that repeat an id are one document with the sum of their tokens and the least of their sources. Rows with a null id are never selected; a null source is a source of its own (None in
    weights); null and empty texts have length 0 and are taken wherever their source has a budget plan. Ties of the hash fall by id. An empty table gives an empty one. Other columns, whatever their names, aren't read.
    Texts are counted whole, however long.

    What is shuffled are ids, sources and lengths. The driver sees one total per source; the histogram of a source is handled by one task.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    counted = with_counts(rows, ["doc_id", "source"], "text", path).groupBy("doc_id").agg(F.min("source").alias("source"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    counted = written(counted, "token-lengths")
    by_length = counted.groupBy("source", "n_tokens").count()
    goal = budgets({r.source: int(r.t) for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}, weights, total, alpha)

    def planned(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = None if key[0] is None or key[0] != key[0] else key[0]
        pdf = pdf.sort_values("n_tokens", ignore_index=True)
        take = plan(pdf["n_tokens"].to_numpy(), pdf["count"].to_numpy(), goal.get(own, 0)) if own in goal else np.zeros(len(pdf), np.int64)
        return pd.DataFrame({"source": pdf["source"], "n_tokens": pdf["n_tokens"], "take": take})

    ship(docs.sparkSession)
    quota = by_length.groupBy("source").applyInPandas(planned, "source string, n_tokens long, take long").where("take > 0")
    return taken(counted, quota, seed).select(F.col("doc_id").cast(kind), "source", "n_tokens")


def taken(counted: DataFrame, quota: DataFrame, seed: int, most: int = RANKED) -> DataFrame:
    """The documents (doc_id, source, n_tokens) that come first, by a seeded hash of their ids and then by id, among those of their source and length, as many as quota (source, n_tokens, take) says.

    Those of one source and length are parted by ranges of the hash, about `most` in each, so that no task ranks them all: ranges are counted, and each begins with the rank that those before it leave.
    """
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.n_tokens") == F.col(f"{b}.n_tokens"))
    parts = counted.groupBy("source", "n_tokens").agg(F.ceil(F.count(F.lit(1)) / most).cast("long").alias("parts")).alias("p")
    h = F.xxhash64("doc_id", F.lit(seed))
    of = ((F.shiftright(h, 33) + (1 << 30)) * F.col("parts")) / (1 << 31)
    rows = counted.alias("c").join(parts, same("c", "p")).select("c.doc_id", "c.source", "c.n_tokens", h.alias("h"), F.floor(of).cast("long").alias("part"))
    key = [F.coalesce("source", F.lit("")), F.col("source").isNull(), F.col("n_tokens")]
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source", "n_tokens", "part").agg(F.count(F.lit(1)).alias("k")).select("source", "n_tokens", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    room = starts.alias("s").join(quota.alias("q"), same("s", "q")).where("take > start").select("s.source", "s.n_tokens", "part", (F.col("take") - F.col("start")).alias("room")).alias("r")
    held = rows.alias("d").join(room, same("d", "r") & (F.col("d.part") == F.col("r.part"))).select("d.doc_id", "d.source", "d.n_tokens", "d.part", "d.h", "r.room")
    ranked = held.withColumn("rank", F.row_number().over(Window.partitionBy(*key, "part").orderBy("h", "doc_id")))
    return ranked.where("rank <= room").select("doc_id", "source", "n_tokens")


def mixed(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs whose ids select() takes, all columns, whatever their names, as they are. Rows that repeat an id stay or go together; rows with a null id go; null and empty texts count 0 tokens; ties and long texts as in select(); an empty table stays empty."""
    ids = written(select(docs, doc_id=doc_id, **options).select(F.col("doc_id").alias("__chosen")), "chosen")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")
    return docs.join(ids, docs[f"`{doc_id}`"] == ids["__chosen"], "left_semi")
