"""The cell layout: one row per sample, ``(raster_id, h, w, band, y, x, v)``.

h and w are the raster's size and travel with every sample, so that coordinate algebra needs no join. Bands are in the
order blue, green, red, alpha. Samples are doubles, by default from 0 to 255.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["raster_id", "h", "w", "band", "y", "x", "v"]
PLANE = ["raster_id", "band"]


def col(x) -> Column:
    return F.lit(x) if not isinstance(x, (Column, str)) else F.col(x) if isinstance(x, str) else x


def clip(x, low, high) -> Column:
    return F.least(F.greatest(col(x), F.lit(float(low))), F.lit(float(high)))


def sized(cells: DataFrame) -> DataFrame:
    return cells.select(*COLUMNS)


def rounded(x, digits: int = 4) -> Column:
    """Half up at a number of decimals, by the same floating-point steps in every engine; a millionth below half counts as half."""
    return F.floor(col(x) * float(10**digits) + 0.500001) / float(10**digits)


def planes(cells: DataFrame) -> DataFrame:
    """One row for each raster and band."""
    return cells.groupBy("raster_id", "band").agg(F.max("h").alias("h"), F.max("w").alias("w"))


def rasters(cells: DataFrame) -> DataFrame:
    """One row for each raster: size and number of bands (the metadata table)."""
    return cells.groupBy("raster_id").agg(F.max("h").alias("h"), F.max("w").alias("w"), (F.max("band") + 1).alias("bands"), F.max("v").alias("max_value"))


def grid(sizes: DataFrame) -> DataFrame:
    """Every (y, x) of each row's h by w raster."""
    return sizes.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))


def bands_wide(cells: DataFrame, bands: int = 3) -> DataFrame:
    """One row per pixel with columns b0, b1, ...: one aggregation instead of joins of bands."""
    return cells.groupBy("raster_id", "h", "w", "y", "x").agg(*[F.max(F.when(F.col("band") == b, F.col("v"))).alias(f"b{b}") for b in range(bands)])


def bands_long(wide: DataFrame, bands: int = 3) -> DataFrame:
    """Back from ``bands_wide``; bands that are null are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"b{b}").alias("v")) for b in range(bands)]))
    return wide.withColumn("each", each).where("each.v is not null").select("raster_id", "h", "w", "each.band", "y", "x", "each.v")


def spread(source: DataFrame, times: int = 4) -> int:
    """Partitions for what is made of a table that is read: ``times`` those it is read in, at least the session's own number."""
    return max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), times * source.rdd.getNumPartitions())


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where that setting is absent, a local master gets a folder of its own and any other raises ValueError.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder and cut from what made them; for results that several branches use."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
