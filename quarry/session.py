"""Session construction and table loading."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on.

    On a cluster ``master`` stays None and spark-submit decides; partition counts are left to AQE
    from a generous starting point, so that one setting serves a laptop and a thousand executors.
    """
    b = (
        SparkSession.builder.appName("quarry")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def local_session(cpus: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    return session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(shuffle_partitions),
            "spark.driver.memory": os.environ.get("QUARRY_DRIVER_MEMORY", "8g"),
            "spark.driver.host": "127.0.0.1",
        },
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be any URI that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
