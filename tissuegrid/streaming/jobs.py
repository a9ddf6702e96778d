"""Incremental ingest of tiles and event rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ingest_tiles_stream(
    spark: SparkSession,
    src: str,
    sink: str,
    checkpoint: str,
    schema: T.StructType,
    max_files: int = 1000,
    complete: DataFrame | None = None,
) -> None:
    """Append new tile files to the store once, then stop.

    The checkpoint remembers which files were seen and the sink which batches were
    committed, so each tile of each file is stored exactly once, however many batches a
    slide's files fall into. ``complete`` lists slides (``slide_id``) that an earlier run
    finished; their tiles are left out when they are delivered again.
    """
    tiles = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(src)
    if complete is not None:
        tiles = tiles.join(complete.select("slide_id").distinct(), "slide_id", "left_anti")
    query = (
        tiles.writeStream.outputMode("append")
        .format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def event_rates(events: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts by window, event and status. On a stream, rows later than the watermark are dropped."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy(F.window("ts", window).alias("w"), "event", "status")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event", "status", "n"
        )
    )


def event_rates_stream(
    events: DataFrame, sink: str, checkpoint: str, watermark: str = "10 minutes", window: str = "5 minutes"
) -> None:
    """Append closed windows to Parquet until the source is drained."""
    query = (
        event_rates(events, watermark, window)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def event_rate_updates(
    events: DataFrame, sink: str, checkpoint: str, watermark: str = "10 minutes", window: str = "5 minutes"
) -> None:
    """Store the count of every window that a batch changed, open windows included, until the source is drained.

    A batch overwrites its own folder, so a repeated batch changes nothing;
    ``latest_event_rates`` reads the result.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    query = (
        event_rates(events, watermark, window)
        .writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_event_rates(spark: SparkSession, sink: str) -> DataFrame:
    """Current counts of all windows: counts only grow, so the largest is the latest."""
    return (
        spark.read.parquet(sink)
        .groupBy("window_start", "window_end", "event", "status")
        .agg(F.max("n").alias("n"))
    )


# --- completeness of a slide's outputs -------------------------------------------

COMPLETENESS = "slide_id string, status string, n_outputs int, at_us long"
_STATE = "slides array<string>, outputs array<array<string>>, times array<array<long>>, done array<boolean>"


def _verdict(times: list[int], expected: int, wait: int) -> tuple[str, int, int]:
    """Status, number of outputs in time and moment of decision, from the first times of a slide's outputs."""
    times = sorted(times)
    deadline = times[0] + wait
    in_time = sum(t <= deadline for t in times[:expected])
    if in_time == expected:
        return "complete", expected, times[expected - 1]
    return "quarantined", in_time, deadline


def slide_completeness(files: DataFrame, *, expected: int = 4, wait: str = "1 hour", until=None) -> DataFrame:
    """``(slide_id, status, n_outputs int, at timestamp)`` of every slide of ``files`` ``(slide_id, output, ts)``.

    A slide is complete at the moment its ``expected``-th distinct output is there, if that is within ``wait`` of
    its first one, and quarantined at the end of the wait otherwise. ``until`` (a timestamp column or null) leaves
    out what is decided at or after it, as a stream whose watermark stands there does. Null slides, outputs and
    times are left out; repeated outputs count once.
    """
    given = files.where(F.col("slide_id").isNotNull() & F.col("output").isNotNull() & F.col("ts").isNotNull())
    first = given.groupBy(F.col("slide_id").cast("string").alias("slide_id"), "output").agg(F.min("ts").alias("ts"))
    # of each slide only the first outputs matter
    rank = F.row_number().over(Window.partitionBy("slide_id").orderBy("ts", "output"))
    kept = first.withColumn("_n", rank).where(F.col("_n") <= expected)
    start = kept.groupBy("slide_id").agg((F.min("ts") + F.expr(f"INTERVAL {wait}")).alias("_end"))
    judged = kept.join(start, "slide_id").groupBy("slide_id").agg(
        F.count_if(F.col("ts") <= F.col("_end")).cast("int").alias("n_outputs"), F.max("ts").alias("_last"), F.first("_end").alias("_end")
    )
    whole = F.col("n_outputs") == expected
    at = F.when(whole, F.col("_last")).otherwise(F.col("_end")).alias("at")
    out = judged.select("slide_id", F.when(whole, "complete").otherwise("quarantined").alias("status"), "n_outputs", at)
    # timers know milliseconds
    return out if until is None else out.where(F.floor(F.unix_micros("at") / 1000) < F.floor(F.unix_micros(until) / 1000))


def slide_completeness_stream(
    files: DataFrame,
    sink: str,
    checkpoint: str,
    *,
    expected: int = 4,
    wait: str = "1 hour",
    watermark: str = "10 minutes",
    forget: str = "30 days",
    shards: int = 1 << 14,
) -> None:
    """Append each slide's row of ``slide_completeness`` once it can no longer change, until the source is drained.

    What is held of a slide is the first times of at most ``expected`` outputs, and of a decided one its moment of decision.
    Slides of one shard (a hash of their id) are one state with one timer, as a call to Python costs as much as hundreds of
    slides in it; a batch writes the states of the shards it touches. The timer stands at the earliest moment of
    decision and fires when the watermark has passed it, so rows that come out of order within the
    watermark change nothing. A decided slide is remembered for ``forget`` of event time, so that it is not reported
    twice. After a restart the stream goes on from the checkpoint, with the same ``shards``; how its input is cut into batches
    does not change the rows, so long as nothing is later than the watermark.
    """
    spark = files.sparkSession
    wait_us, forget_us = (_micros(spark, x) for x in (wait, forget))

    def update(key, frames, state):
        import pandas as pd

        now = state.getCurrentWatermarkMs()
        held, decided, found = {}, {}, []
        if state.exists:
            for slide, outputs, times, done in zip(*state.get):
                if done:
                    decided[slide] = times[0]
                else:
                    held[slide] = dict(zip(outputs, times))
        for frame in frames:
            for slide, output, us in zip(frame["slide_id"], frame["output"], frame["_us"]):
                if slide not in decided:
                    own = held.setdefault(slide, {})
                    own[output] = min(int(us), own.get(output, int(us)))
        decided = {slide: at for slide, at in decided.items() if (at + forget_us) // 1000 >= now}
        due = []
        for slide in list(held):
            own = held[slide] = dict(sorted(held[slide].items(), key=lambda x: (x[1], x[0]))[:expected])
            status, n, at = _verdict(list(own.values()), expected, wait_us)
            if at // 1000 < now:
                found.append((slide, status, n, at))
                decided[slide] = at
                del held[slide]
            else:
                due.append(at // 1000)
        due += [(at + forget_us) // 1000 for at in decided.values()]
        if due:
            state.update((
                [*held, *decided],
                [*(list(own) for own in held.values()), *([] for _ in decided)],
                [*(list(own.values()) for own in held.values()), *([at] for at in decided.values())],
                [*(False for _ in held), *(True for _ in decided)],
            ))
            state.setTimeoutTimestamp(max(min(due), now + 1))
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=["slide_id", "status", "n_outputs", "at_us"])

    given = files.where(F.col("slide_id").isNotNull() & F.col("output").isNotNull() & F.col("ts").isNotNull())
    timed = given.select(F.col("slide_id").cast("string").alias("slide_id"), "output", "ts", F.unix_micros("ts").alias("_us"))
    dealt = timed.withColumn("_shard", F.pmod(F.xxhash64("slide_id"), F.lit(shards)))
    judged = dealt.withWatermark("ts", watermark).groupBy("_shard").applyInPandasWithState(update, COMPLETENESS, _STATE, "append", "EventTimeTimeout")
    query = (
        judged.select("slide_id", "status", "n_outputs", F.timestamp_micros("at_us").alias("at"))
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _micros(spark: SparkSession, interval: str) -> int:
    """Microseconds of an interval."""
    moved = spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0).cast("long")) + F.expr(f"INTERVAL {interval}")))
    return moved.first()[0]
