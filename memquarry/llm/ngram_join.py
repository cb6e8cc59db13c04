"""Documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

A document's n-grams are hashed, their hashes counted by group, and the counts are points of R-trees: two sets share at most the sum over the groups of the smaller count. How the trees are packed, spread over
executors and searched without loss says set_join; no min-hash decides what is compared.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memquarry.llm.common import gathered, mix64, word_hashes, written
from memquarry.llm.set_join import BITS, keyed, links, marks_of

BROADCAST_IDS = 200_000  # ids of 16 bytes and their hash table: some 16 MB


def gram_sets(texts: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of the n-grams of each text's lower-cased words, one text after another, and how many each has; a text of fewer than n words has one gram, of all of them; one without words has none."""
    h, words = word_hashes(texts)
    first = np.cumsum(words) - words
    held = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    g = np.full(max(len(h) - n + 1, 0), n, np.uint64)
    for i in range(n):
        g = mix64(g + h[i : len(h) - n + 1 + i]) if len(g) else g
    g = np.append(g, np.zeros(len(h) - len(g), np.uint64))  # the last words begin no gram of n
    for k in np.flatnonzero((words > 0) & (words < n)).tolist():
        x = np.full(1, words[k], np.uint64)
        for i in range(words[k]):
            x = mix64(x + h[first[k] + i : first[k] + i + 1])
        g[first[k]] = x[0]
    g = gathered(g, first, held) >> np.uint64(64 - BITS)
    stops = np.cumsum(held)
    for a, b in zip((stops - held).tolist(), stops.tolist()):
        g[a:b].sort()
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    new[(stops - held)[held > 0]] = True
    upto = np.concatenate(([0], np.cumsum(new)))
    return g[new], upto[stops] - upto[stops - held]


def _make(n: int):
    def make(texts):
        grams, sizes = gram_sets(texts, n)
        return grams, sizes, marks_of(grams, sizes)

    return make


def _linked(docs: DataFrame, n: int, threshold: float, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, mark of each id and set; mark, rep (the least id), members of each set; mark_a, mark_b, jaccard of different sets. All come from written tables."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    return linked_sets(keyed(texts, _make(n), threshold, "ngram-sets"), threshold)


def linked_sets(table: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of _linked() from set_join.keyed()'s."""
    own, prints = marked_sets(table)
    return own, prints, written(links(table, threshold), "set-links")


def marked_sets(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first two tables of _linked() from set_join.keyed()'s."""
    own = table.select("doc_id", "mark").distinct()
    prints = own.where("mark IS NOT NULL").groupBy("mark").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"))
    return own, written(prints, "set-marks")


def _edges(own: DataFrame, prints: DataFrame, found: DataFrame) -> DataFrame:
    """doc_a, doc_b: each set's least id with its other ones, and of linked sets the least ids; in linear size what pairs of ids say about components."""
    rep = prints.select("mark", "rep")
    within = own.join(rep, "mark").where("doc_id <> rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"))
    across = found.join(rep.toDF("mark_a", "doc_a"), "mark_a").join(rep.toDF("mark_b", "doc_b"), "mark_b").select("doc_a", "doc_b")
    return within.unionByName(across)


def ngram_classes(docs: DataFrame, n: int = 3, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, n_links: one row per id. n_links counts the other documents whose sets reach the threshold with the document's own, copies included; class_id is the least id of all that are linked to it over any number of links.

    Ids are integers. Rows with a null id take no part; a null text, an empty one and one without a word have a class of their own and no links. Rows that repeat are one; an id with several texts has the links of each (where two of its
    texts are similar, with itself, too) and joins their classes. Ties need no order. Texts are taken whole, however long. An empty table gives an empty one; columns besides id and text aren't read, whatever their names.

    Texts are read once. Copies are never expanded to pairs: each link of two different sets counts for all their members.
    """
    return classed(*_linked(docs, n, threshold, doc_id, text))


def classed(own: DataFrame, prints: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links of each id of own, from the three tables of _linked()."""
    both = found.select("mark_a", "mark_b").unionByName(found.select(F.col("mark_b").alias("mark_a"), F.col("mark_a").alias("mark_b")))
    outer = both.join(prints.select(F.col("mark").alias("mark_b"), "members"), "mark_b").groupBy(F.col("mark_a").alias("mark")).agg(F.sum("members").alias("outer"))
    per_set = prints.join(outer, "mark", "left").select("mark", (F.col("members") - 1 + F.coalesce("outer", F.lit(0))).alias("k"))
    linked = own.join(per_set, "mark", "left").groupBy("doc_id").agg(F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("n_links"))
    groups = components(_edges(own, prints, found)).toDF("doc_id", "root")
    return linked.join(groups, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").cast(own.schema["doc_id"].dataType).alias("class_id"), "n_links")


def ngram_pairs(docs: DataFrame, n: int = 3, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_a < doc_b, jaccard (6 places): every pair of ids whose texts' n-gram sets reach the threshold, exact copies included; as many rows as there are such pairs, so copies of one text have a square of them. ngram_classes is linear.

    Ids, nulls, empty and long texts, empty tables and other columns as in ngram_classes. Rows that repeat an id never pair with one another; an id with several texts gets, per partner, its largest similarity.
    """
    own, prints, found = _linked(docs, n, threshold, doc_id, text)
    one = own.where("mark IS NOT NULL")
    within = one.toDF("doc_a", "mark").join(one.toDF("doc_b", "mark"), "mark").select("doc_a", "doc_b", F.lit(1.0).alias("jaccard"))
    across = found.join(one.toDF("x", "mark_a"), "mark_a").join(one.toDF("y", "mark_b"), "mark_b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    # only ids with several texts can give a pair twice
    pairs = within.unionByName(across).where("doc_a < doc_b").groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))
    return pairs.select("doc_a", "doc_b", F.round("jaccard", 6).alias("jaccard"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the connected components of edges (a, b), each named by its least node; by alternating large and small stars, in a logarithmic number of rounds.

    Null ends are left out; loops and repeated edges change nothing; no edges give an empty table. Only edges are shuffled, hubs too (a hub's least neighbour is found by partial aggregation).
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(least, "a")
        if small:  # a > b in every edge
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        else:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = edges.toDF("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "edges")
    now = state(e)
    while True:
        before, e = now, written(star(star(e, small=False), small=True), "edges")
        now = state(e)
        if now == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def one_of_each_group(docs: DataFrame, n: int = 3, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but the least id of each class of ngram_classes; all columns as they are, whatever their names. Rows that repeat an id stay or go together; rows with a null id, a null text or one without a word stay; an empty table stays empty."""
    gone = components(_edges(*_linked(docs, n, threshold, doc_id, text))).where("node <> root").select(F.col("node").alias("__gone"))
    gone = written(gone, "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone.hint("shuffle_hash")
    return docs.join(gone, docs[f"`{doc_id}`"] == gone["__gone"], "left_anti")
