"""Queries by name, each over whole tables of a folder, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memquarry.session import ship

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def money(c):
    """A double as text with two decimals, the same in every engine."""
    return F.round(c, 2).cast("decimal(18,2)").cast("string")


def log_rows(events: DataFrame) -> DataFrame:
    """Events as templated log rows: line_no, text, template, slots."""
    value = money(F.col("value"))
    return events.select(
        F.col("event_id").alias("line_no"),
        F.concat(F.lit("event "), "event_type", F.lit(" user="), F.col("user_id").cast("string"), F.lit(" value="), value).alias("text"),
        F.lit("event <*> user=<*> value=<*>").alias("template"),
        F.array(F.col("event_type"), F.col("user_id").cast("string"), value).alias("slots"),
    )


def trace_lines(events: DataFrame) -> DataFrame:
    """Events as tool-call lines: line_no, line."""
    return events.select(F.col("event_id").alias("line_no"), F.concat(F.lit("tool_call::"), "event_type", F.lit(" rid=u"), F.col("user_id").cast("string"), F.lit(" payload="), "props").alias("line"))


LOG_SQL = "log AS (SELECT event_id AS line_no, 'event ' || event_type || ' user=' || user_id || ' value=' || CAST(round(value, 2) AS DECIMAL(18,2)) AS text, event_type, CAST(user_id AS VARCHAR) AS user_id, CAST(CAST(round(value, 2) AS DECIMAL(18,2)) AS VARCHAR) AS value FROM events)"
TRACE_SQL = "trace AS (SELECT event_id AS line_no, event_type AS tool, props, 'tool_call::' || event_type || ' rid=u' || user_id || ' payload=' || props AS line FROM events)"
