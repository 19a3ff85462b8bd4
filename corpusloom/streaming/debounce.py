"""Changes as a stream: bursts of events per path become one update."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUIET = "500 milliseconds"  # fixed value of the reference


def bursts(events: DataFrame, quiet_seconds: float) -> DataFrame:
    """Batch form: ``path, first_ts, last_ts, events`` for each run of a path's events with gaps below QUIET_SECONDS.

    An event that comes exactly QUIET_SECONDS after the one before begins a new burst. Null times or paths are dropped.
    """
    w = Window.partitionBy("path").orderBy("ts", "event_id")
    e = events.where(F.col("ts").isNotNull() & F.col("path").isNotNull())
    micros = F.unix_micros("ts")
    gap = micros - F.lag(micros).over(w)
    starts = e.withColumn("new", F.when(gap.isNull() | (gap >= int(quiet_seconds * 1e6)), 1).otherwise(0))
    numbered = starts.withColumn("burst", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("path", "burst").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events")
    ).drop("burst")


def debounce_stream(events: DataFrame, quiet: str = QUIET, late: str = "2 seconds") -> DataFrame:
    """Stream form: one row per path and burst, out once the watermark passes the burst's end."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", quiet), "path")
        .agg(F.count("*").alias("events"), F.max("ts").alias("last_ts"))
        .select("path", F.col("session_window.start").alias("first_ts"), "last_ts", "events")
    )


def apply_stream(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each micro-batch of debounced paths to APPLY, once per path.

    APPLY has to be idempotent: a batch is repeated after a failure. The hash gate of the index makes a repeat a no-op.
    """
    return (
        changes.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, n: apply(df.select("path").distinct(), n)).start()
    )
