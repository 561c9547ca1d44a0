"""The usage log as a stream: idempotent ingest, per-session rate limits, running indicators and upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch


def ingested(events: DataFrame, event_id: str = "event_id", at: str = "ts", late: str = "1 day") -> DataFrame:
    """Each event once: a retry with the same id within the watermark's delay is ignored. The unbounded memory of a
    unique index would be unbounded state, so this delay is the one departure from it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([event_id])


def rate_limited(events: DataFrame, session: str, at: str, most: int, seconds: int, columns: str, late: str = "1 day") -> DataFrame:
    """Events that their session's limit lets in: at most `most` accepted ones within any `seconds`. State: the accepted
    times of the last window, at most `most` numbers a session; it goes once the watermark is past them."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        taken = list(state.get[0]) if state.exists else []
        for p in batches:
            keep = []
            for t in p.sort_values(at)[at].astype("int64") // 1000:
                taken = [x for x in taken if x > t - seconds * 1_000_000]
                ok = len(taken) < most
                if ok:
                    taken.append(int(t))
                keep.append(ok)
            yield p.sort_values(at)[keep]
        state.update((taken,))
        if taken:
            state.setTimeoutTimestamp(max(taken[-1] // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    return events.withWatermark(at, late).groupBy(session).applyInPandasWithState(step, columns, "taken array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def running_counts(events: DataFrame, kind: str, at: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, window), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a query over all that is there now, into the shared folder, and reads what it wrote."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession, name)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{out}/data")
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{out}/data")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def upsert(stream: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """Last write wins: the table of the last writes of all batches so far.

    A batch writes the last write of each of its own keys under its number, and nothing else: the table isn't rewritten,
    and a batch that is run again after a restart overwrites its own rows. Reading takes the last write of each key over
    all batches, so no version is held by the driver.
    """
    spark, out = stream.sparkSession, scratch(stream.sparkSession, name)

    def write(batch: DataFrame, k: int) -> None:
        last_writes(batch, key, order).write.mode("overwrite").parquet(f"{out}/data/batch={k}")

    stream.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/data/batch=-1")
    return last_writes(spark.read.schema(stream.schema).parquet(f"{out}/data").select(*stream.columns), key, order)


def last_writes(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order."""
    w = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def received(stream: DataFrame, at: str = "received") -> DataFrame:
    """Rows with the time at which they arrive, by the cluster's clock; what the sender says of it isn't taken."""
    return stream.drop(at).withColumn(at, F.current_timestamp())


def in_order(df: DataFrame, session: str, at: str, tie: str, place: str = "place") -> DataFrame:
    """Each event's place in its session by its own time: late ones take the place they belong to, none is dropped."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(session).orderBy(at, tie)))


def by_session(events: DataFrame, session: str, at: str) -> DataFrame:
    """(session, starts, ends, n) by the id that events carry, however long the pauses between them; no id, no session."""
    return events.where(F.col(session).isNotNull()).groupBy(session).agg(F.min(at).alias("starts"), F.max(at).alias("ends"), F.count(F.lit(1)).alias("n"))


def by_pause(events: DataFrame, who: str, at: str, pause: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(who, starts, ends, n) of stretches without a longer pause, for logs whose events carry no session id."""
    rows = events.where(F.col(who).isNotNull()).withWatermark(at, late).groupBy(F.session_window(at, pause).alias("_w"), who)
    return rows.agg(F.min(at).alias("starts"), F.max(at).alias("ends"), F.count(F.lit(1)).alias("n")).select(who, "starts", "ends", "n")


def expires(end: str = "end_date") -> Column:
    """When a published event may go: at the end of the day after its last one."""
    return (F.date_add(F.col(end).cast("date"), 2)).cast("timestamp")


def landed(df: DataFrame, name: str, files: int = 8, at_once: int = 4) -> DataFrame:
    """df as a stream: written as files into a landing folder of the shared one, some of which each batch takes up."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", at_once).parquet(path)
