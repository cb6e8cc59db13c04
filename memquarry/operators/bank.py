"""The knowledge bank: gated entries, supersession, contradictions, carry-over summaries, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memquarry.operators.retrieval import bm25, top, vector_top_k
from memquarry.session import written

MOST_BYTES, CONTRADICTION, SIMILAR = 100_000, 5.0, 0.75


def issues(title: Column, content: Column, evidence: Column, most: int = MOST_BYTES) -> Column:
    """What stands against writing an entry; empty where nothing does."""
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim(title), F.lit("")) == "", "empty title"),
            F.when(F.coalesce(F.trim(content), F.lit("")) == "", "empty content"),
            F.when(F.octet_length(content) > most, "content too large"),
            F.when(F.coalesce(F.size(evidence), F.lit(0)) <= 0, "no evidence"),
        )
    )


def evidence_ok(claim: Column, sources: Column, confidence: Column) -> Column:
    return F.coalesce((F.trim(claim) != "") & (F.size(sources) > 0) & confidence.between(0.0, 1.0), F.lit(False))


def contradictions(bank: DataFrame, title: str, k: int = 5, score: float = CONTRADICTION) -> DataFrame:
    """Active entries, of the k best for a title's words, whose score exceeds the bar. Statistics cover superseded entries, too."""
    text = bank.withColumn("__text", F.concat_ws(" ", "title", "content", F.array_join("tags", " ")))
    found = bm25(text, title, "id", "__text", F.col("status") == "active").orderBy(F.desc("score"), "id").limit(k)
    return found.where(F.col("score") > score)


def semantic_contradictions(bank: DataFrame, chunks: DataFrame, vectors: DataFrame, query: DataFrame, k: int = 5, least: float = SIMILAR, entries: int = 3, words: int = 5) -> DataFrame:
    """chunk_id, cosine, id of active entries that a new entry's vector (the one row of query) may speak against: of the k chunks (id, content) whose vectors (id, embedding) are nearest those of a cosine of at least `least`, and for each the entries, of
    the `entries` best by the chunk's first `words` words, that are active. At most k chunks come to the driver."""
    near = vector_top_k(vectors, query, k, "id").where(F.col("score") >= least)
    hits = chunks.join(F.broadcast(near), "id").select("id", "score", F.slice(F.split(F.trim("content"), r"\s+"), 1, words).alias("w")).collect()  # at most k rows
    text = bank.withColumn("__text", F.concat_ws(" ", "title", "content", F.array_join("tags", " ")))
    out = bank.select(F.lit(None).cast(chunks.schema["id"].dataType).alias("chunk_id"), F.lit(None).cast("double").alias("cosine"), "id").limit(0)
    active = bank.where("status = 'active'").select("id")
    for h in sorted(hits, key=lambda h: (-h["score"], h["id"])):
        best = top(bm25(text, " ".join(h["w"]), "id", "__text"), entries, "id").join(active, "id", "left_semi")
        out = out.unionByName(best.select(F.lit(h["id"]).cast(chunks.schema["id"].dataType).alias("chunk_id"), F.lit(h["score"]).alias("cosine"), "id"))
    return out


def superseded(bank: DataFrame, old_id, new_id) -> DataFrame:
    """The bank with an entry marked as superseded by another."""
    old = F.col("id") == old_id
    return bank.withColumn("status", F.when(old, "superseded").otherwise(F.col("status"))).withColumn("superseded_by", F.when(old, F.lit(new_id)).otherwise(F.col("superseded_by")))


def retracted(bank: DataFrame, entry_id) -> DataFrame:
    return bank.withColumn("status", F.when(F.col("id") == entry_id, "retracted").otherwise(F.col("status")))


def chains(links: DataFrame, node: str, following: str) -> DataFrame:
    """node, last, steps, cyclic: the end of every entry's chain and the links to it, whatever its length, by pointer doubling: one join and one written table a round, in as many rounds as the longest chain's length has bits.

    Entries that run into a cycle are marked and have no last; steps then say how far they were followed. A chain that ends at an id which isn't an entry has that id for its last.
    """
    jump = written(links.select(F.col(node).alias("node"), F.col(following).alias("to"), F.col(following).isNotNull().cast("long").alias("steps")), "chains")
    ended = F.col("to2").isNull()
    for _ in range(max(1, jump.count()).bit_length()):  # no chain without a cycle is longer than the table
        nxt = jump.where("to IS NOT NULL").select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"))
        j = jump.join(nxt, "to", "left")
        jump = written(j.select("node", F.coalesce("to2", "to").alias("to"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), ended.alias("done")), "chains")
        if jump.where("NOT done").isEmpty():
            break
    onward = links.where(F.col(following).isNotNull()).select(F.col(node).alias("to"), F.lit(True).alias("onward"))
    cyclic = F.coalesce("onward", F.lit(False))
    return jump.select("node", "to", "steps").join(onward, "to", "left").select("node", F.when(~cyclic, F.coalesce("to", "node")).alias("last"), "steps", cyclic.alias("cyclic"))


def merged_summary(facts: Column, new_facts: Column, questions: Column, resolved: Column, new_questions: Column) -> tuple[Column, Column]:
    """Facts with the new ones appended once; questions less those resolved, with the new ones."""
    return F.array_distinct(F.concat(facts, new_facts)), F.array_distinct(F.concat(F.array_except(questions, resolved), new_questions))


def rendered_summary(sequence: Column, summary: Column, facts: Column, questions: Column) -> Column:
    bullets = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat_ws("\n", F.concat(F.lit("# Carried over ("), sequence.cast("string"), F.lit(")")), summary, F.lit("## Facts"), bullets(facts), F.lit("## Open questions"), bullets(questions))


def newest(rows: DataFrame, k: int, order: str = "created_at", key: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(order), F.desc(key)).limit(k)


def next_version(skills: DataFrame, name: str = "name") -> DataFrame:
    """The latest version of each skill."""
    w = Window.partitionBy(name).orderBy(F.desc("version"))
    return skills.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
