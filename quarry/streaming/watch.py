"""Keeping an index current: bursts of file events, debounced, then one incremental pass."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.plan import plan_index
from quarry.sources.walker import walk

#: What ends a burst, how late events may come, and seconds of a slice of time.
GAP, LATENESS, SLICE = "800 milliseconds", "2 seconds", 3600
# Kinds of events after which files may differ.
RELEVANT = ("create", "remove", "modify", "rename")


def relevant(kind: Column, path: Column) -> Column:
    from quarry.functions.text import indexable

    return kind.isin(*RELEVANT) & indexable(path)


def bursts(events: DataFrame, is_relevant: Column, gap: str = GAP, keys: tuple[str, ...] = ()) -> DataFrame:
    """events(ts, ...) -> (keys, started, ended, events, relevant): sessions closed by a gap.

    Any event extends a burst, but one without a relevant event is none; a burst starts at its first relevant
    event. Works on tables and, with a watermark on ts, on streams. A table is cut into slices of time first: each
    slice finds its bursts alone, and only those, a few rows each, meet to be joined across the cuts.
    """
    marked = events.withColumn("hit", F.coalesce(is_relevant, F.lit(False)))
    kept = [F.min(F.when(F.col("hit"), F.col("ts"))).alias("started"), F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("events"), F.count_if("hit").alias("relevant")]
    if events.isStreaming:
        out = marked.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(*kept)
    else:
        pieces = marked.groupBy(*keys, F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (SLICE * 1_000_000)).alias("slice"), F.session_window("ts", gap).alias("w")).agg(*kept)
        # each piece reaches from its first event to a gap after its last
        reach = F.concat((F.unix_micros((F.col("ended") + F.expr(f"interval {gap}")).cast("timestamp")) - F.unix_micros(F.col("began").cast("timestamp"))).cast("string"), F.lit(" microseconds"))
        out = pieces.groupBy(*keys, F.session_window("began", reach).alias("w")).agg(
            F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("events").alias("events"), F.sum("relevant").alias("relevant")
        )
    return out.where("relevant > 0").select(*keys, "started", "ended", "events", "relevant")


def watch_events(events: DataFrame, on_burst: Callable[[DataFrame, int], None], checkpoint: str, gap: str = GAP) -> StreamingQuery:
    """Runs on_burst once for every micro-batch with a closed burst of the stream events(ts, kind, path).

    A failing pass is reported and the stream goes on: the next burst plans against what is recorded.
    """
    # a stream needs a grouping key beside the window; one index is one group
    one = events.withWatermark("ts", LATENESS).withColumn("index", F.least(F.length("path"), F.lit(0)))
    closed = bursts(one, relevant(F.col("kind"), F.col("path")), gap, ("index",))

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        try:
            on_burst(batch, number)
        except Exception as e:  # noqa: BLE001 - one failed pass must not end the watch
            print(f"indexing failed: {e}")

    return closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(run).start()


def snapshot_changes(spark: SparkSession, root: str, recorded: DataFrame) -> DataFrame:
    """What differs between the tree and recorded(path, content_hash), by size and time of change instead of content.

    File stream sources see neither rewrites nor deletions, so every trigger compares snapshots.
    """
    rows = [(p, f"{n}-{Path(root, p).stat().st_mtime_ns}") for p, n in walk(root)]
    return plan_index(spark.createDataFrame(rows, "path string, content_hash string"), recorded).where("status <> 'unchanged'")


def watch_tree(spark: SparkSession, root: str, index_pass: Callable[[], dict], report: Callable[[dict], None], checkpoint: str, seconds: float = 2.0) -> StreamingQuery:
    """Compares snapshots of the tree at every trigger and runs one pass of the index where they differ."""
    seen: dict[str, str] = {p: f"{n}-{Path(root, p).stat().st_mtime_ns}" for p, n in walk(root)}
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def run(batch: DataFrame, number: int) -> None:
        recorded = spark.createDataFrame(list(seen.items()), "path string, content_hash string")
        changes = snapshot_changes(spark, root, recorded)
        if changes.isEmpty():
            return
        now = {p: f"{n}-{Path(root, p).stat().st_mtime_ns}" for p, n in walk(root)}
        try:
            report(index_pass())
            seen.clear()
            seen.update(now)
        except Exception as e:  # noqa: BLE001 - one failed pass must not end the watch
            report({"failed": str(e)})

    return ticks.writeStream.trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint).foreachBatch(run).start()
