"""Aggregates over template slots and texts: value models, type inference, tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IP = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


def placed(rows: DataFrame, slots: str = "slots", order: str = "line_no") -> DataFrame:
    return rows.select(order, F.posexplode(slots).alias("slot", "value"))


def slot_model(rows: DataFrame, slots: str = "slots", order: str = "line_no") -> DataFrame:
    """slot, value, hits, total, accuracy: the most frequent value of each slot, of equals the first seen."""
    counted = placed(rows, slots, order).groupBy("slot", "value").agg(F.count(F.lit(1)).alias("hits"), F.min(order).alias("first"))
    best = counted.groupBy("slot").agg(F.max(F.struct("hits", (-F.col("first")).alias("early"), "value")).alias("m"), F.sum("hits").cast("long").alias("total"))
    return best.select("slot", F.col("m.value").alias("value"), F.col("m.hits").alias("hits"), "total", F.round(F.col("m.hits") / F.col("total"), 6).alias("accuracy"))


def slot_prediction(rows: DataFrame, model: DataFrame, slots: str = "slots", order: str = "line_no") -> DataFrame:
    """slot, n, hit_rate, ratio: values' bytes over bytes when a hit takes one flag byte and a miss a flag and the value."""
    known = model.select("slot", F.col("value").alias("guess"))  # one row a slot
    marked = placed(rows, slots, order).join(F.broadcast(known), "slot").withColumn("hit", (F.col("value") == F.col("guess")).cast("double"))
    raw, coded = F.sum(F.octet_length("value")), F.sum(1 + (1 - F.col("hit")) * F.octet_length("value"))
    return marked.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(raw / coded, 6).alias("ratio"))


def slot_types(rows: DataFrame, least: int = 50, slots: str = "slots", order: str = "line_no") -> DataFrame:
    """slot, kind: INT with at least `least` integers and nothing else, otherwise DICT."""
    ints = F.sum(F.col("value").rlike(r"^-?\d+$").cast("int"))
    return placed(rows, slots, order).groupBy("slot").agg(F.when((ints >= least) & (ints == F.count(F.lit(1))), "INT").otherwise("DICT").alias("kind"))


def channel_types(rows: DataFrame, repeats: int = 12, slots: str = "slots", order: str = "line_no") -> DataFrame:
    """slot, kind: INT, IP or HEX where all values are; DICT where at least `repeats` values repeat; otherwise RAW."""
    v = F.col("value")
    kind = (
        F.when(F.bool_and(v.rlike(r"^-?\d+$")), "INT").when(F.bool_and(v.rlike(IP)), "IP").when(F.bool_and(v.rlike(r"^[0-9a-fA-F]{6,}$")), "HEX")
        .when(F.count(F.lit(1)) - F.count_distinct(v) >= repeats, "DICT").otherwise("RAW")
    )
    return placed(rows, slots, order).groupBy("slot").agg(kind.alias("kind"))


def auto_tier(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tier: 0 for blank texts and those of at least 100 bytes of which one line makes more than 80 % of the lines, otherwise 3."""
    held = docs.select(key, F.octet_length(text).alias("size"), (F.trim(text) == "").alias("blank"), F.explode(F.split(text, "\n")).alias("line"))
    counted = held.where(F.trim("line") != "").groupBy(key, "line").agg(F.count(F.lit(1)).alias("n"))
    share = counted.groupBy(key).agg((F.max("n") / F.sum("n")).alias("share"))
    own = docs.select(key, F.octet_length(text).alias("size"), (F.trim(text) == "").alias("blank"))
    return own.join(share, key, "left").select(key, F.when(F.col("blank"), 0).when(F.col("size") < 100, 3).when(F.col("share") > 0.8, 0).otherwise(3).cast("long").alias("tier"))
