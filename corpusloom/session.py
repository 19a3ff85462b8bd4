"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> None:
    """Settings that operators rely on.

    A union of two sides that are hashed alike would be zipped partition by partition; adaptive execution can coalesce
    the sides differently, and the job then fails. So unions do not claim a partitioning.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table NAME below BASE."""
    prepare(spark)
    return spark.read.parquet(f"{base}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """DF with its lineage cut by a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``, which all executors share. Only where that is
    unset (tests on one machine) a temporary folder is used.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusloom-"))
    return df.checkpoint(eager=True)
