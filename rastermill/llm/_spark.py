"""Small helpers on sessions, tables and written intermediate results."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    Where spark.checkpoint.dir is absent, a local master gets a folder of its own and any other raises ValueError.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder and cut from what made them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unsigned_hex(column):
    """A long as 16 lowercase hex digits of its two's complement."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
