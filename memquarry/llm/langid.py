"""Language identification by the nearest of several clustered centroids per language.

A text becomes a vector of hashed character 1- to 3-grams over its lower-cased letters, weighted by log(1 + tf) * idf and scaled
to length 1. Document frequencies are counted over all documents. Per language, `clusters` spherical k-means centroids are fitted
on at most `sample_per_lang` labelled documents. A document gets the language of the centroid with the largest cosine, unless
that cosine lies below the limit of its length band; then it is rejected and its language is null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memquarry.llm.common import mapped

BANDS = (16, 64, 256, 1024)  # upper limits, in letters, of all bands but the last


@dataclass
class Model:
    langs: list[str]  # language of each centroid
    centroids: np.ndarray  # float32, dims x centroids, each of length 1
    idf: np.ndarray  # float32, dims
    limits: np.ndarray  # least cosine by length band
    dims: int


def grams(text: str, dims: int) -> tuple[np.ndarray, int]:
    """Hashed 1- to 3-grams of a text, with repeats, and its number of letters. Anything but a letter counts as a space, and grams with two spaces in a row are left out."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = ((c >= 97) & (c <= 122)) | (c >= 0xC0)
    letters = int(letter.sum())
    if not letters:
        return np.empty(0, np.int64), 0
    c = np.concatenate(([0], np.where(letter, c, 0), [0])).astype(np.uint64)
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    one = c[c != 0]
    two = c[:-1] * np.uint64(0x1F123BB5) + c[1:]
    three = two[:-1] * np.uint64(0x1F123BB5) + c[2:]
    shift = np.uint64(64 - (dims.bit_length() - 1))
    mixed = [((x + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> shift for k, x in enumerate((one, two, three), 1)]
    return np.concatenate(mixed).astype(np.int64), letters


def vector(text: str, dims: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places, log(1 + tf) at those places, and the number of letters."""
    g, letters = grams(text, dims)
    tf = np.bincount(g, minlength=dims) if letters else np.zeros(dims, np.int64)
    at = np.flatnonzero(tf)
    return at, np.log1p(tf[at]).astype(np.float32), letters


def band(letters) -> np.ndarray:
    return np.searchsorted(BANDS, letters, side="right")


def similarities(model: Model, text: str | None) -> tuple[str | None, float, bool]:
    """The nearest language, its cosine, and whether the document is accepted. A null text or one without letters is rejected with cosine 0."""
    if not text or not model.langs:
        return None, 0.0, False
    at, w, letters = vector(text, model.dims)
    if not letters:
        return None, 0.0, False
    w = w * model.idf[at]
    norm = math.sqrt(float(w @ w))
    if not norm:
        return None, 0.0, False
    cos = (w @ model.centroids[at]) / norm
    best = int(cos.argmax())
    return model.langs[best], float(cos[best]), bool(cos[best] >= model.limits[band(letters)])


def _clusters(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Spherical k-means over rows of length 1, started at rows far from one another."""
    start = [int(rng.integers(len(x)))]
    while len(start) < min(k, len(x)):
        start.append(int((x @ x[start].T).max(axis=1).argmin()))
    centres = x[start].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        for i in range(len(centres)):
            if (own == i).any():
                s = x[own == i].sum(axis=0)
                centres[i] = s / max(np.linalg.norm(s), 1e-12)
    return centres


def document_frequencies(docs: DataFrame, text: str = "text", dims: int = 1 << 15) -> tuple[np.ndarray, int]:
    """In how many documents each hashed gram occurs, over all of them, and how many have any gram. One row of counts per gram and task is shuffled, never text."""

    def count(batches):
        df, n = np.zeros(dims, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                g, letters = grams(t, dims) if t else (None, 0)
                if letters:
                    df[np.flatnonzero(np.bincount(g, minlength=dims))] += 1
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["gram", "df"])

    rows = mapped(docs.select(F.col(text)), count, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(dims, np.int64)
    inside = rows.gram.to_numpy() >= 0
    df[rows.gram.to_numpy()[inside]] = rows.df.to_numpy()[inside]
    return df, int(rows.df[~inside].sum())


def fit(docs: DataFrame, text: str = "text", label: str = "lang", sample_per_lang: int = 300, clusters: int = 4, dims: int = 1 << 15, slack: float = 0.45, seed: int = 7) -> Model:
    """Fits centroids on at most `sample_per_lang` distinct labelled texts of each language, those with the least seeded hash; a language of fewer distinct texts gives all of them.

    A band's limit is `slack` times the 1 % quantile of the sample's cosines there; a band with fewer than 20 samples takes half of the
    least limit of the others (0.02 where there is none). Rows with a null label or text are not sampled; copies of a text are one, so they neither fill nor empty a sample. Without labelled
    rows, or where no labelled text has a letter, the model rejects everything. Texts are taken whole, however long. Other columns, whatever their names, aren't read.
    """
    spark = docs.sparkSession
    df, n = document_frequencies(docs, text, dims)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    labelled = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("lang"), F.col(text).alias("text"))
    hashed = labelled.withColumn("h", F.xxhash64("text", F.lit(seed)))
    sizes = {r.lang: r["count"] for r in hashed.select("lang", "h").distinct().groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return Model([], np.zeros((dims, 0), np.float32), idf, np.zeros(len(BANDS) + 1), dims)
    span = 1 << 31
    keep = F.lit(False)
    for lang, size in sorted(sizes.items()):  # about 1.5 times the sample of distinct texts by hash, then exactly the sample
        keep = keep | ((F.col("lang") == lang) & (F.pmod("h", F.lit(span)) < int(span * min(1.0, (1.5 * sample_per_lang + 20) / size))))
    chosen = hashed.where(keep).groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text", "h")  # a text's copies are one, in each task before anything is shuffled

    def vectors(batches):
        for b in batches:
            rows = [vector(t, dims) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([at.astype(np.int32) for at, _, _ in rows], pa.list_(pa.int32())), pa.array([w for _, w, _ in rows], pa.list_(pa.float32())), pa.array([k for *_, k in rows], pa.int64())],
                names=["lang", "h", "places", "weights", "letters"],
            )

    sample = (
        mapped(chosen, vectors, "lang string, h long, places array<int>, weights array<float>, letters long")
        .withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(span)), "h")))
        .where((F.col("r") <= sample_per_lang) & (F.col("letters") > 0))
        .orderBy("lang", "r")
        .toArrow()
    )
    rng, langs, centres, cosines, letters = np.random.default_rng(seed), [], [], [], []
    of = np.array(sample.column("lang").to_pylist(), dtype=object)
    for lang in sorted(set(of)):
        rows = np.flatnonzero(of == lang)
        x = np.zeros((len(rows), dims), np.float32)
        for i, r in enumerate(rows):
            at = sample.column("places")[int(r)].values.to_numpy()
            x[i, at] = sample.column("weights")[int(r)].values.to_numpy() * idf[at]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = _clusters(x, clusters, rng)
        cosines.append((x @ c.T).max(axis=1))
        letters.append(sample.column("letters").to_numpy()[rows])
        centres.append(c)
        langs += [lang] * len(c)
    if not langs:
        return Model([], np.zeros((dims, 0), np.float32), idf, np.zeros(len(BANDS) + 1), dims)
    cosines, at = np.concatenate(cosines), band(np.concatenate(letters))
    known = {b: slack * float(np.quantile(cosines[at == b], 0.01)) for b in range(len(BANDS) + 1) if (at == b).sum() >= 20}
    limits = np.array([known.get(b, 0.5 * min(known.values(), default=0.04)) for b in range(len(BANDS) + 1)])
    limits = np.minimum.accumulate(limits[::-1])[::-1]  # a shorter text is never held to more
    return Model(langs, np.concatenate(centres).T.copy(), idf, limits, dims)


def _applied(model: Model, docs: DataFrame, columns: list[str], make, schema) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # dims x centroids floats, whatever the input
    return mapped(docs.select(*[docs[f"`{c}`"] for c in columns]), lambda batches: make(shipped.value, batches), schema)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, predicted, similarity, rejected: one row per row of docs, in one pass without a shuffle.

    Rejected rows (null or empty text, no letters, too far from every centroid) have a null `predicted`; null ids and repeated rows are kept as they are; ties take the
    first language in alphabetical order; an empty table gives an empty one. Texts are taken whole, however long. Other columns, whatever their names, are not read.
    """

    def run(model, batches):
        for b in batches:
            rows = [similarities(model, t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([lang if ok else None for lang, _, ok in rows], pa.string()), pa.array([round(s, 6) for _, s, _ in rows], pa.float64()), pa.array([not ok for *_, ok in rows], pa.bool_())],
                names=["doc_id", "predicted", "similarity", "rejected"],
            )

    return _applied(model, docs, [doc_id, text], run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, predicted string, similarity double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the rows that the model rejects, all columns, whatever their names, as they are; no shuffle.

    Rejected are null and empty texts, those without letters and those too far from every centroid; null ids and repeated rows stay or go by their texts; an empty table stays empty; texts are taken whole."""
    place = docs.columns.index(text)

    def run(model, batches):
        for b in batches:
            yield b.filter(pa.array([similarities(model, t)[2] for t in b.column(place).to_pylist()], pa.bool_()))

    return _applied(model, docs, docs.columns, run, docs.schema)
