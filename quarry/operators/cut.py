"""Lineage cuts for iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that ``spark.checkpoint.dir`` names; only a session without one (a
    single machine) gets a temporary folder."""
    folder(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which driver and executors share."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarry-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """The rows of a list that is short by construction (a top-k), held by the driver: what is planned on
    them next starts from a local relation. Anything longer than ``most`` is checkpointed instead."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        return cut(df)
    return df.sparkSession.createDataFrame(rows, df.schema)
