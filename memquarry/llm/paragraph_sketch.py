"""Document fingerprints that subtract: invertible Bloom lookup sketches over paragraph digests.

A document's sketch has a fixed number of cells; each of its distinct paragraphs' digests goes to one cell in each of three parts, where it adds 1 to a count and is
xor-ed into a key and, hashed, into a check. Subtracting two sketches cancels what both hold; peeling cells of a single digest then recovers the digests that differ. Where peeling
stops early, the pair is tried again with four times the cells, until it succeeds, so results are exact.

Versions are documents whose sets of paragraphs have a Jaccard similarity of at least a threshold, all of them, found by set_join. A document is held against the version it is most like among those of smaller ids.
Boilerplate makes versions of all documents that have it beside one paragraph of their own, and their pairs grow as the square of the input. Such documents share one core (set_join.by_core); links are found between cores and counted for all documents of a core, never listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memquarry.llm.common import mapped, mix64, written
from memquarry.llm.ngram_join import components, marked_sets, ngram_pairs
from memquarry.llm.set_join import BITS, by_core, keyed, links, marks_of

CELLS, GROW, THRESHOLD = 48, 4, 0.5
_PARTS = 3


def sketch(digests: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """cells x (count, key, check) as int64, of distinct digests."""
    out = np.zeros((3, cells), np.int64)
    d = np.asarray(digests, np.int64)
    if len(d):
        check = _check(d)
        for part in range(_PARTS):
            at = _cell(d, part, cells)
            np.add.at(out[0], at, 1)
            np.bitwise_xor.at(out[1], at, d)
            np.bitwise_xor.at(out[2], at, check)
    return out


def _check(d: np.ndarray) -> np.ndarray:
    return (mix64(d.view(np.uint64) + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(16)).view(np.int64)


def _cell(d: np.ndarray, part: int, cells: int) -> np.ndarray:
    each = cells // _PARTS
    return (mix64(d.view(np.uint64) * np.uint64(2 * part + 3) + np.uint64(cells)) % np.uint64(each)).astype(np.int64) + part * each


def peel(difference: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The digests only in the first and only in the second of two subtracted sketches, sorted; None where cells are left that don't peel."""
    count, key, check = difference.copy()
    cells = count.shape[0]
    first, second = [], []
    while True:
        pure = np.flatnonzero((np.abs(count) == 1) & (_check(key) == check))
        if not len(pure):
            break
        d, at = np.unique(key[pure], return_index=True)
        sign = count[pure][at]
        first.append(d[sign > 0])
        second.append(d[sign < 0])
        c = _check(d)
        for part in range(_PARTS):
            where = _cell(d, part, cells)
            np.subtract.at(count, where, sign)
            np.bitwise_xor.at(key, where, d)
            np.bitwise_xor.at(check, where, c)
    if count.any() or key.any() or check.any():
        return None
    none = [np.empty(0, np.int64)]
    return np.sort(np.concatenate(first or none)), np.sort(np.concatenate(second or none))


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack((a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2]))


def paragraph_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digests: the distinct 60-bit digests (the first 15 hex digits of MD5) of each id's lines without blanks around them, empty lines left out; over all rows of an id. Ids that are null or have no line aren't there."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    digests = F.array_distinct(F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")))
    own = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), digests.alias("digests"))
    return own.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("digests"))).alias("digests")).where(F.size("digests") > 0)


def fingerprints(digests: DataFrame, cells: int = CELLS) -> DataFrame:
    """doc_id, sketch (binary)."""
    kind = digests.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            lists = b.column(1)
            values, ends = lists.flatten().to_numpy(), np.cumsum(np.diff(lists.offsets.to_numpy()))
            own = np.split(values, ends[:-1]) if len(ends) else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sketch(d, cells).tobytes() for d in own], pa.binary())], names=["doc_id", "sketch"])

    return mapped(digests.select("doc_id", "digests"), run, f"doc_id {kind}, sketch binary")


def _differences(kind: str, pairs: DataFrame, cells: int) -> DataFrame:
    """doc_a, doc_b, done, only_a, only_b from doc_a, doc_b, sketch_a, sketch_b."""

    def run(batches):
        for b in batches:
            a, c = ([np.frombuffer(x, np.int64).reshape(3, cells) for x in b.column(k).to_pylist()] for k in (2, 3))
            found = [peel(subtract(x, y)) for x, y in zip(a, c)]
            text = lambda k: pa.array([None if f is None else ",".join(f"{x:015x}" for x in f[k].tolist()) for f in found], pa.string())
            size = lambda k: pa.array([None if f is None else len(f[k]) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f is not None for f in found], pa.bool_()), size(0), size(1), text(0), text(1)], names=["doc_a", "doc_b", "done", "n_only_a", "n_only_b", "only_a", "only_b"])

    return mapped(pairs.select("doc_a", "doc_b", "sketch_a", "sketch_b"), run, f"doc_a {kind}, doc_b {kind}, done boolean, n_only_a long, n_only_b long, only_a string, only_b string")


def _peeled(kind: str, digests: DataFrame, open_pairs: DataFrame, cells: int) -> DataFrame:
    """The differences of all pairs (doc_a, doc_b), those that don't peel tried again with larger sketches. Only documents of open pairs are sketched."""
    done: list = []
    while True:
        held = digests.join(open_pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct(), "doc_id", "left_semi")
        sketches = fingerprints(held, cells)
        pairs = open_pairs.join(sketches.toDF("doc_b", "sketch_b"), "doc_b").join(sketches.toDF("doc_a", "sketch_a"), "doc_a")
        tried = written(_differences(kind, pairs, cells), "differences")
        done.append(tried.where("done").drop("done"))
        open_pairs = tried.where("NOT done").select("doc_a", "doc_b")
        if open_pairs.isEmpty():
            break
        cells *= GROW
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _as_items(lists: list) -> tuple[np.ndarray, np.ndarray, list]:
    """Lists of distinct 60-bit digests as set_join takes sets."""
    sets = [np.unique(np.array(x or (), np.uint64) >> np.uint64(60 - BITS)) for x in lists]
    sizes = np.array([len(x) for x in sets], np.int64)
    items = np.concatenate([np.empty(0, np.uint64), *sets])
    return items, sizes, marks_of(items, sizes)


def version_differences(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", cells: int = CELLS) -> DataFrame:
    """doc_id, class_id, n_links, base_id, n_only_base, n_only_doc, only_base, only_doc: one row per id.

    Two documents are versions of one another where their paragraphs' Jaccard similarity reaches the threshold. n_links counts a document's versions, copies included; class_id is the least id that it is linked to over any number of links.
    base_id is, of its versions with smaller ids, the most similar one, of equals the least; only_base and only_doc are the digests (hex, sorted, joined by commas) of the paragraphs that only one of the two has, empty for copies.
    A document without such a version has nulls there.

    Ids are integers. Rows that repeat an id are one document with the paragraphs of all; a paragraph that repeats in it counts once; ids with null texts or texts of blanks alone have a class of their own and no links; null ids take no
    part. Texts are taken whole, however long. An empty table gives an empty one; other columns, whatever their names, aren't read. Texts are read once; digests are shuffled, sketches only of documents that are compared.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    digests = written(paragraph_digests(docs, doc_id, text), "digests")
    table = keyed(digests.select("doc_id", F.col("digests").alias("text")), _as_items, threshold, "paragraph-sets")
    own, prints = marked_sets(table)
    core_of, cores = by_core(table, threshold)
    found = written(links(cores, threshold), "core-links").toDF("core", "other", "jaccard")
    sets = written(core_of.join(prints, "mark"), "sets-of-cores")
    sums = written(sets.groupBy("core").agg(F.min("rep").alias("first"), F.sum("members").alias("docs")), "core-sums")
    common = F.length("items") / (BITS // 8)
    alike = cores.select(F.col("mark").alias("core"), F.col("mark").alias("other"), (common / (2 * F.col("n") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold)
    met = found.unionByName(found.select(F.col("other").alias("core"), F.col("core").alias("other"), "jaccard")).unionByName(alike)
    met = written(met.join(sums.withColumnRenamed("core", "other"), "other").select("core", "jaccard", "first", "docs", (F.col("core") == F.col("other")).alias("itself")), "cores-met")

    # a set's least id is the only one whose base may lie in another set; its copies have it for their base
    steps = met.groupBy("core", "jaccard").agg(F.min("first").alias("doc_a"))
    before = F.max("jaccard").over(Window.partitionBy("core").orderBy("doc_a").rowsBetween(Window.unboundedPreceding, -1))
    steps = steps.withColumn("before", before).where("before IS NULL OR jaccard > before")  # a core's least ids that are more alike than all lesser ones, so of those below a set's id the largest is its base
    best = written(sets.join(steps, "core").where("doc_a < rep").groupBy(F.col("rep").alias("doc_b")).agg(F.max("doc_a").alias("doc_a")).select("doc_a", "doc_b"), "bases")
    apart = _peeled(kind, digests, best, cells).toDF("base_id", "doc_id", "n_only_base", "n_only_doc", "only_base", "only_doc")
    within = own.join(prints, "mark").where("doc_id <> rep").select(F.col("rep").alias("base_id"), "doc_id")
    same = within.select("base_id", "doc_id", F.lit(0).cast("long").alias("n_only_base"), F.lit(0).cast("long").alias("n_only_doc"), F.lit("").alias("only_base"), F.lit("").alias("only_doc"))

    outer = met.groupBy("core").agg(F.sum("docs").alias("docs"), F.max("itself").alias("itself"))
    per_set = sets.join(outer, "core").select("mark", (F.col("docs") - F.when(F.col("itself"), F.col("members")).otherwise(0)).alias("outer"))
    counted = own.join(prints.join(per_set, "mark", "left"), "mark", "left").select("doc_id", (F.col("members") - 1 + F.coalesce("outer", F.lit(0))).alias("n_links"))
    # all sets of a core that has any link are linked over it, so one star for each core will do
    stars = sets.join(outer, "core", "left_semi").join(sums, "core").where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    across = found.join(sums.select("core", F.col("first").alias("a")), "core").join(sums.select(F.col("core").alias("other"), F.col("first").alias("b")), "other").select("a", "b")
    groups = components(within.toDF("a", "b").unionByName(stars).unionByName(across)).toDF("doc_id", "class_id")

    every = docs.select(F.col(doc_id).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    classes = every.join(counted, "doc_id", "left").join(groups, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").cast(kind).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return classes.join(apart.unionByName(same), "doc_id", "left").select("doc_id", "class_id", "n_links", "base_id", "n_only_base", "n_only_doc", "only_base", "only_doc")


def version_pairs(docs: DataFrame, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text", cells: int = CELLS) -> DataFrame:
    """The columns of version_differences, of every pair doc_a < doc_b whose paragraphs, or whose word 3-grams, have a Jaccard similarity of at least the threshold, exact copies included.

    Both kinds of pairs come from ngram_pairs; paragraphs are its 1-grams. The 3-grams find versions of one edited paragraph.
    Ids are integers; rows that repeat an id, null ids, null texts and texts of blanks are taken as in version_differences. Sketches are subtracted once for each pair of distinct paragraph sets and the result is given to all their copies.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    digests = written(paragraph_digests(docs, doc_id, text), "digests")
    as_words = digests.select("doc_id", F.concat_ws(" ", F.transform("digests", lambda x: x.cast("string"))).alias("text"))
    found = ngram_pairs(as_words, 1, threshold).unionByName(ngram_pairs(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), 3, threshold)).select("doc_a", "doc_b").distinct()
    marks = digests.select("doc_id", F.sha2(F.concat_ws(" ", F.transform(F.array_sort("digests"), lambda x: x.cast("string"))), 256).alias("mark"))
    rep = written(marks.join(marks.groupBy("mark").agg(F.min("doc_id").alias("rep")), "mark").select("doc_id", "rep"), "paragraph-sets")
    pairs = written(found.join(rep.toDF("doc_a", "ra"), "doc_a").join(rep.toDF("doc_b", "rb"), "doc_b").select("doc_a", "doc_b", F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y"), (F.col("ra") > F.col("rb")).alias("turned")), "version-pairs")
    apart = pairs.where("x <> y").select(F.col("x").alias("doc_a"), F.col("y").alias("doc_b")).distinct()
    differences = _peeled(kind, digests, apart, cells).toDF("x", "y", "n_x", "n_y", "only_x", "only_y")
    side = lambda k, a, b, none: F.coalesce(F.when(F.col("turned"), F.col(f"{k}_{b}")).otherwise(F.col(f"{k}_{a}")), F.lit(none))
    return pairs.join(differences, ["x", "y"], "left").select(
        *("doc_a", "doc_b"), side("n", "x", "y", 0).cast("long").alias("n_only_a"), side("n", "y", "x", 0).cast("long").alias("n_only_b"), side("only", "x", "y", "").alias("only_a"), side("only", "y", "x", "").alias("only_b")
    )
