"""Ranking and retrieval: BM25, exact vectors, reciprocal-rank fusion, and the filters on top of them.

BM25 is Okapi's with k1 = 1.2, b = 0.75 and idf = ln(1 + (N - n + 0.5) / (n + 0.5)), over lower-cased runs of letters and digits; a text must hold all
terms. Scores are rounded to 6 places before they rank, ties fall by id.
"""

from __future__ import annotations

import regex

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memquarry.functions.text import WORDS
from memquarry.functions.vectors import cosine, sign_buckets
from memquarry.operators.keyword_index import KeywordIndex, indexed

RRF, VECTOR_WEIGHT, KEYWORD_WEIGHT = 60, 0.7, 0.3


def query_terms(query: str) -> list[str]:
    """Distinct lower-cased terms, by the rule that parts texts: runs of letters and digits."""
    return sorted(set(regex.findall(WORDS, query.lower())))


def bm25(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", keep: Column | None = None, index: KeywordIndex | None = None) -> DataFrame:
    """key, score of the texts that hold all terms, from the stored index of docs: its postings of the query's terms are read, no text. Statistics cover all of docs, `keep` filters after matching."""
    terms = query_terms(query)
    scored = (index or indexed(docs, key, text)).bm25(terms) if terms else None
    if scored is None:
        return docs.select(F.col(key), F.lit(0.0).alias("score")).limit(0)
    scored = scored.withColumnRenamed("key", key)
    return scored if keep is None else scored.join(docs.where(keep).select(key), key, "left_semi")


def top(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    return scored.orderBy(F.desc("score"), key).limit(k)


def ranked(scored: DataFrame, k: int, key: str) -> DataFrame:
    """The k best with `rank` from 1; the window sees k rows."""
    return top(scored, k, key).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def vector_scores(vectors: DataFrame, query: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cosine with the one vector of query; a whole scan, exact."""
    q = query.select(F.col(vector).alias("__q")).limit(1)
    return vectors.crossJoin(F.broadcast(q)).select(key, F.round(cosine(F.col(vector), F.col("__q")), 6).alias("score"))


def vector_top_k(vectors: DataFrame, query: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return top(vector_scores(vectors, query, key, vector), k, key)


def resolved(hits: DataFrame, docs: DataFrame, hit_key: str, key: str = "doc_id") -> DataFrame:
    """Hits with their texts; hits without one are dropped."""
    return F.broadcast(hits).withColumnRenamed(hit_key, key).join(docs, key)


def fuse(keyword: DataFrame, vector: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """key, score: sum of weight / (60 + rank) over two ranked lists. Where one list is empty the other comes as it is, with its own scores; `origin` tells which."""
    both = keyword.select(key, "score", "rank", F.lit("keyword").alias("leg")).unionByName(vector.select(key, "score", "rank", F.lit("vector").alias("leg")))
    weight = F.when(F.col("leg") == "vector", VECTOR_WEIGHT).otherwise(KEYWORD_WEIGHT)
    legs = Window.partitionBy()  # at most two lists of 3 k rows
    marked = both.withColumn("legs", F.size(F.collect_set("leg").over(legs)))
    fused = marked.groupBy(key).agg(
        F.max("legs").alias("legs"), F.round(F.sum(weight / (RRF + F.col("rank"))), 8).alias("rrf"), F.max("score").alias("raw"), F.array_join(F.array_sort(F.collect_set("leg")), "+").alias("origin")
    )
    return fused.select(key, F.when(F.col("legs") == 2, F.col("rrf")).otherwise(F.col("raw")).alias("score"), "origin").orderBy(F.desc("score"), key).limit(k)


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, query_vector: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", vec_key: str = "vec_id") -> DataFrame:
    """Fusion of the best 3 k by words and by vector, with the texts: the ids found, at most k, go to the documents' scan as a filter."""
    found = fuse(ranked(bm25(docs, query, key, text), 3 * k, key), ranked(vector_scores(vectors, query_vector, vec_key).withColumnRenamed(vec_key, key), 3 * k, key), k, key)
    hits = found.collect()
    return docs.where(F.col(key).isin([h[key] for h in hits])).join(F.broadcast(docs.sparkSession.createDataFrame(hits, found.schema)), key)


def search_all(chunks: DataFrame, bank: DataFrame, k: int) -> DataFrame:
    """The best of two scored corpora (id, score) by raw score."""
    both = chunks.select("id", "score", F.lit("chunk").alias("origin")).unionByName(bank.select("id", "score", F.lit("reasoning").alias("origin")))
    return both.orderBy(F.desc("score"), "origin", "id").limit(k)


def deduplicated(hits: DataFrame, k: int, content: str = "content", key: str = "id") -> DataFrame:
    """The best hit of each content, equal in its first 200 trimmed lower-cased characters; the first k of them."""
    same = F.substring(F.lower(F.trim(content)), 1, 200)
    best = Window.partitionBy("__same").orderBy(F.desc("score"), key)
    return hits.withColumn("__same", same).withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__same", "__r").orderBy(F.desc("score"), key).limit(k)


def recall(hits: DataFrame, k: int, session: str = "", content: str = "content", key: str = "id") -> DataFrame:
    """Of the best 2 k hits those whose session_id holds `session` or is empty, deduplicated."""
    own = F.coalesce("session_id", F.lit(""))
    return deduplicated(top(hits, 2 * k, key).where((own == "") | own.contains(session)), k, content, key)


def augment(hits: DataFrame, k: int, roles: list[str], min_score: float = 0.005, content: str = "content", key: str = "id") -> DataFrame:
    """Of the best 10 k hits those of at least min_score and of the roles (none is unknown), deduplicated."""
    return deduplicated(top(hits, 10 * k, key).where((F.col("score") >= min_score) & F.coalesce("role", F.lit("unknown")).isin(roles)), k, content, key)


def augment_text(hits: DataFrame, key: str = "id") -> DataFrame:
    """One row `context`: the hits as escaped elements, best first."""
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace("content", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    element = F.concat(F.lit('<memory role="'), F.coalesce("role", F.lit("unknown")), F.lit('">'), escaped, F.lit("</memory>"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(key).alias("i"), element.alias("e"))))
    return hits.agg(F.array_join(F.transform(rows, lambda x: x["e"]), "\n").alias("context"))


def distinct_by_overlap(hits: DataFrame, sets: DataFrame, threshold: float = 0.8, key: str = "id") -> DataFrame:
    """Greedily in rank order, hits whose chunk set has a Jaccard similarity below the threshold with every one kept. Runs on the few rows of a top-k."""
    import pandas as pd

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        own = [set(x) for x in pdf["chunks"]]
        for i in range(len(pdf)):
            if all(not (own[i] | own[j]) or len(own[i] & own[j]) / len(own[i] | own[j]) < threshold for j in kept):
                kept.append(i)
        return pdf.iloc[kept][[key, "score"]]

    rows = F.broadcast(hits).join(sets.select(key, "chunks"), key).select(key, "score", "chunks", F.lit(0).alias("__one"))
    schema = f"{key} {hits.schema[key].dataType.simpleString()}, score double"
    return rows.groupBy("__one").applyInPandas(lambda pdf: greedy(pdf.sort_values(["score", key], ascending=[False, True])), schema)


def bucket_index(vectors: DataFrame, dims: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, buckets: the sign pattern of each eighth of the dimensions."""
    return vectors.select(key, sign_buckets(F.col(vector), dims).alias("buckets"))


def bucket_matches(index: DataFrame, query_key, key: str = "vec_id", least: int = 4) -> DataFrame:
    """Vectors that share at least `least` buckets, place by place, with that of query_key."""
    q = index.where(F.col(key) == query_key).select(F.col("buckets").alias("__q"))
    shared = F.size(F.filter(F.zip_with("buckets", "__q", lambda a, b: a == b), lambda x: x)).cast("long")
    return index.crossJoin(F.broadcast(q)).select(key, shared.alias("shared")).where(F.col("shared") >= least)


def not_in(rows: DataFrame, known: DataFrame, key: str, known_key: str) -> DataFrame:
    return rows.join(known.select(F.col(known_key).alias(key)), key, "left_anti")
