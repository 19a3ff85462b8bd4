"""What changed between full snapshots (problem 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    """PATH relative to the root, with ``/`` between segments, without blanks around it and empty or ``.`` segments."""
    segments = F.split(F.translate(F.regexp_replace(path, r"^\s+|\s+$", ""), "\\", "/"), "/")
    return F.array_join(F.filter(segments, lambda s: (s != "") & (s != ".")), "/")


def snapshot_states(snaps: DataFrame) -> DataFrame:
    """One row per snapshot and file in normal form: ``snapshot_no, path, hash``.

    Of several rows of a file the one with the latest ``indexed_at`` holds; among equals the greatest hash, a null time
    or hash being the least. Rows without a snapshot number, and paths that are null or empty in normal form, name no
    file and are left out. The partial aggregate removes repeats before the shuffle, so a path that holds a third of
    all rows reaches its reducer as one row per map task and snapshot.
    """
    named = snaps.select("snapshot_no", normal_path(F.col("path")).alias("path"), "hash", "indexed_at")
    return (
        named.where((F.col("path") != "") & F.col("snapshot_no").isNotNull())
        .groupBy("snapshot_no", "path")
        .agg(F.max(F.struct("indexed_at", "hash")).alias("last"))
        .select("snapshot_no", "path", F.col("last.hash").alias("hash"))
    )


def snapshot_changes(snaps: DataFrame) -> DataFrame:
    """Files added, removed or changed since the delivered snapshot before: ``snapshot_no, path, change_type``.

    Snapshots are numbered without gaps by their order, then each path is windowed by that index: a differing lagged
    hash is a change (null is a value of its own), a gap before a row an addition, a gap after it a removal. The first
    snapshot yields nothing. The list of snapshots is one row per snapshot, whose number does not grow with the data;
    the planner chooses the join by its measured size. A path has at most one row per snapshot in the window.
    An empty table gives an empty result.
    """
    states = snapshot_states(snaps)
    order = Window.orderBy("snapshot_no")
    numbers = (
        snaps.where(F.col("snapshot_no").isNotNull())
        .select("snapshot_no")
        .distinct()
        .select(
            "snapshot_no",
            (F.row_number().over(order) - 1).alias("at"),
            F.lead("snapshot_no").over(order).alias("next_no"),
        )
    )
    key = Window.partitionBy("path").orderBy("at")
    seen = (
        states.join(numbers, "snapshot_no")
        .withColumn("prev_at", F.lag("at").over(key))
        .withColumn("prev_hash", F.lag("hash").over(key))
        .withColumn("next_at", F.lead("at").over(key))
    )
    came = F.when((F.col("at") > 0) & (F.coalesce("prev_at", F.lit(-1)) < F.col("at") - 1), F.lit("added")).when(
        (F.col("prev_at") == F.col("at") - 1) & ~F.col("hash").eqNullSafe(F.col("prev_hash")), F.lit("changed")
    )
    gone = F.col("next_no").isNotNull() & (F.coalesce("next_at", F.lit(-1)) != F.col("at") + 1)
    events = F.filter(
        F.array(
            F.struct(F.col("snapshot_no").alias("no"), came.alias("change")),
            F.struct(F.col("next_no").alias("no"), F.when(gone, F.lit("removed")).alias("change")),
        ),
        lambda e: e["change"].isNotNull(),
    )
    return seen.select("path", F.explode(events).alias("e")).select(
        F.col("e.no").alias("snapshot_no"), "path", F.col("e.change").alias("change_type")
    )


def change_summary(snaps: DataFrame) -> DataFrame:
    """Number of changes of each type per snapshot: ``snapshot_no, change_type, files``."""
    return snapshot_changes(snaps).groupBy("snapshot_no", "change_type").agg(F.count("*").alias("files"))
