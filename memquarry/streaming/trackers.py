"""Structured Streaming: session ingest, event motifs, rolling ratios, chunk references and merged agents.

State is keyed by user, label or session, so it spreads over executors; a group's rows of one batch are ordered before they are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memquarry.session import passing_path, ship


def events_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files, old and new: those of a folder, or one file. (Written as a pattern, as only that may be a file.)"""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there now, as a table in the shared folder."""
    out = passing_path(stream.sparkSession, "stream")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows")
    else:
        q = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/rows")).outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


def motif_tracker(events: DataFrame, by: str = "user_id", order: str = "event_id", event: str = "event_type", least: int = 3, most: int = 10) -> DataFrame:
    """by, at, longest: at each event the longest run ending there that the key has had before. State: the last events and the runs seen."""
    ship(events.sparkSession)
    kind, at = events.schema[by].dataType.simpleString(), events.schema[order].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past, seen = (list(state.get[0]), set(state.get[1])) if state.exists else ([], set())
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for place, e in zip(rows[order], rows[event]):
            past = [*past, e][-most:]
            longest = 0
            for n in range(least, len(past) + 1):
                g = ">".join(past[-n:])
                if g in seen:
                    longest = n
                seen.add(g)
            if longest:
                out.append((key[0], place, longest))
        state.update((past, sorted(seen)))
        yield pd.DataFrame(out, columns=["key", "at", "longest"])

    keyed = events.select(by, order, event)
    return keyed.groupBy(by).applyInPandasWithState(step, f"key {kind}, at {at}, longest int", "past array<string>, seen array<string>", "append", GroupStateTimeout.NoTimeout)


def ratio_monitor(events: DataFrame, by: str = "user_id", order: str = "event_id", value: str = "value", size: int = 50, least: int = 5) -> DataFrame:
    """key, at, z of each value against the key's `size` values before it, from the fifth on. State: those values."""
    ship(events.sparkSession)
    kind, at = events.schema[by].dataType.simpleString(), events.schema[order].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for place, v in zip(rows[order], rows[value]):
            if len(past) >= least:
                dev = float(np.std(past))
                out.append((key[0], place, round((v - float(np.mean(past))) / (dev if dev >= 1e-12 else 0.001), 6)))
            past = [*past, float(v)][-size:]
        state.update((past,))
        yield pd.DataFrame(out, columns=["key", "at", "z"])

    return events.select(by, order, value).groupBy(by).applyInPandasWithState(step, f"key {kind}, at {at}, z double", "past array<double>", "append", GroupStateTimeout.NoTimeout)


def chunk_stream(pieces: DataFrame, by: str = "conv_id", order: str = "turn", text: str = "text", last: str | None = None, idle: str | None = None) -> DataFrame:
    """key, kind (FULL or REF), sha256, size of content-defined chunks of texts that arrive piece by piece; a key's chunks joined give its bytes, and are the same however the pieces fall into batches.

    What lies behind the last cut that more bytes can't move waits in the state. It is given as the key's last chunk where a piece has the column `last` true, or, with `idle` (such as "10 minutes"), where no piece has come for that
    long; a later piece of such a key begins anew. State: those bytes, at most one chunk's, and the digests that the key has had.
    """
    import hashlib

    from memquarry.operators.dedup import cut_points

    ship(pieces.sparkSession)
    kind = pieces.schema[by].dataType.simpleString()
    wait = pd.Timedelta(idle).total_seconds() * 1000 if idle else 0

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, seen = (bytes(state.get[0]), set(state.get[1])) if state.exists else (b"", set())
        ended = state.hasTimedOut
        if not ended:
            rows = pd.concat(list(batches)).sort_values(order)
            rest += "".join(t or "" for t in rows[text]).encode()
            ended = bool(rows["__last"].any())
        cuts, start, out = cut_points(rest), 0, []
        for end in cuts if ended else cuts[:-1]:  # more bytes may move the last cut
            h = hashlib.sha256(rest[start:end]).hexdigest()
            out.append((key[0], "REF" if h in seen else "FULL", h, end - start))
            seen.add(h)
            start = end
        if ended:
            state.remove()
        else:
            state.update((rest[start:], sorted(seen)))
            if wait:
                state.setTimeoutDuration(int(wait))
        yield pd.DataFrame(out, columns=["key", "kind", "sha256", "size"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    rows = pieces.select(by, order, text, (F.col(last) if last else F.lit(False)).alias("__last"))
    return rows.groupBy(by).applyInPandasWithState(step, f"key {kind}, kind string, sha256 string, size int", "rest binary, seen array<string>", "append", timeout)


def merged_agents(streams: dict[str, DataFrame]) -> DataFrame:
    """The union of several agents' streams, each row with its agent."""
    out = None
    for agent, stream in streams.items():
        own = stream.withColumn("agent", F.lit(agent))
        out = own if out is None else out.unionByName(own)
    return out


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type and window, rows later than the watermark left out."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def ingest(stream: DataFrame, target: str, checkpoint: str, interval: str = "5 minutes"):
    """Appends a stream of session rows to a table, each id once per batch."""

    def save(df: DataFrame, _: int) -> None:
        df.dropDuplicates(["id"]).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(processingTime=interval)
