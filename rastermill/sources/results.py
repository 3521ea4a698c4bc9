"""Results kept by key: batches that can be replayed, a log of uses, and eviction that writes only what goes.

A folder holds Parquet tables whose partitions are batches: ``lines`` (results), ``index`` (result_key, bytes, made),
``uses`` (result_key, used) and ``gone`` (result_key, of, the batch it was in). A batch counts from when its index stands,
which is written last; until then a replay writes its lines anew. Nothing is changed in place: what is evicted is named in
``gone``, and ``compact`` moves what is left of batches that are mostly gone.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..layout import saved
from ..operators import store
from ..operators.scanlines import LINE

INDEX, USES, GONE = "result_key string, bytes long, made timestamp", "result_key string, used timestamp", "result_key string, of long"


class Results:
    """The results in a folder that all executors share, for one writer at a time; any number may read.

    Batches are numbers that grow, such as those of a stream's micro-batches.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, batch long")

    def _write(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def _has(self, name: str, schema: str, batch: int) -> bool:
        return not self._table(name, schema).where(F.col("batch") == batch).isEmpty()

    def index(self) -> DataFrame:
        """Rows (result_key, bytes, made, batch), one for each key that is there; of a key made twice, the earliest batch."""
        rows = self._table("index", INDEX).join(self._table("gone", GONE).select("result_key", F.col("of").alias("batch")), ["result_key", "batch"], "left_anti")
        first = rows.groupBy("result_key").agg(F.min_by(F.struct("bytes", "made", "batch"), "batch").alias("r"))
        return first.select("result_key", "r.*")

    def missing(self, jobs: DataFrame, batch: int) -> DataFrame:
        """One job for each key that isn't there (that of the smallest raster_id); what this very batch made doesn't count, so that a replay makes it again."""
        new = store.todo(jobs, self.index().where(F.col("batch") != batch))
        rest = [c for c in new.columns if c != "result_key"]
        one = new.groupBy("result_key").agg(F.min_by(F.struct(*rest), "raster_id").alias("r"))
        return one.select("result_key", *[F.col(f"r.{c}").alias(c) for c in rest])

    def commit(self, lines: DataFrame, batch: int, made: Column | None = None) -> None:
        """Results (result_key and a raster's lines) as a batch; a batch that stands is left as it is.

        Keys that such a batch lacks raise ValueError, as two streams must not share a store's numbers.
        """
        stands = self._table("index", INDEX).where(F.col("batch") == batch).select("result_key")
        if not stands.isEmpty():
            if not lines.join(stands, "result_key", "left_anti").isEmpty():
                raise ValueError(f"batch {batch} stands with other results")
            return
        ints = [F.col(c).cast("int").alias(c) for c in LINE[1:5]]
        self._write(lines.select("result_key", "raster_id", *ints, "data"), "lines", batch)
        found = self.spark.read.parquet(f"{self.folder}/lines/batch={batch}")
        sizes = found.groupBy("result_key").agg(F.sum(8 * F.size("data")).cast("long").alias("bytes"))
        self._write(sizes.withColumn("made", F.current_timestamp() if made is None else made), "index", batch)

    def touch(self, keys: DataFrame, batch: int, used: Column | None = None) -> None:
        """Logs a batch's use of keys; a replay replaces what it logged."""
        rows = keys.select("result_key").distinct()
        self._write(rows.withColumn("used", F.current_timestamp() if used is None else used), "uses", batch)

    def serve(self, jobs: DataFrame) -> DataFrame:
        """Lines of the results of jobs (raster_id, result_key), under each job's raster_id; jobs without a result give none."""
        lines = self._table("lines", "result_key string, h int, w int, band int, y int, data array<double>")
        wanted = jobs.select("raster_id", "result_key").distinct().join(self.index().select("result_key", "batch"), "result_key")
        return lines.join(wanted, ["result_key", "batch"]).select(*LINE)

    def recency(self) -> DataFrame:
        """Rows (result_key, last_used): of each key that is there, when it was made or last used."""
        there = self.index()
        uses = self._table("uses", USES).select("result_key", "used").join(there.select("result_key"), "result_key", "left_semi")
        return there.select("result_key", F.col("made").alias("used")).unionByName(uses).groupBy("result_key").agg(F.max("used").alias("last_used"))

    def evict(self, keep: int, batch: int) -> None:
        """Leaves the ``keep`` keys used last; only the names of those that go are written. An eviction that stands is not done again."""
        if self._has("gone", GONE, batch):
            return
        kept = store.keep_recent(self.recency(), "result_key", "last_used", keep)
        self._write(saved(self.index().join(kept, "result_key", "left_anti").select("result_key", F.col("batch").alias("of"))), "gone", batch)

    def compact(self, batch: int, share: float = 0.5) -> list[int]:
        """Moves what is left of batches of which at least ``share`` is gone to a new batch, and deletes them; returns them.

        Where it breaks off, keys may stand twice until the next call, of which the earliest counts.
        """
        sizes = self._table("index", INDEX).groupBy("batch").agg(F.count("*").alias("all"))
        left = self.index().groupBy("batch").agg(F.count("*").alias("left"))
        part = F.coalesce("left", F.lit(0)) / F.col("all")
        old = [r.batch for r in sizes.join(left, "batch", "left").where((part <= 1 - share) & (F.col("batch") != batch)).select("batch").collect()]
        if not old:
            return old
        stay = self.index().where(F.col("batch").isin(old))
        lines = self.spark.read.parquet(f"{self.folder}/lines")
        if not self._has("index", INDEX, batch):
            self._write(lines.join(stay.select("result_key", "batch"), ["result_key", "batch"], "left_semi").drop("batch"), "lines", batch)
            self._write(saved(stay.select("result_key", "bytes", "made")), "index", batch)
        for number in old:
            for name in ("index", "lines"):
                self._delete(f"{self.folder}/{name}/batch={number}")
        return old

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def stats(self) -> DataFrame:
        """One row: entries, bytes."""
        return store.cache_stats(self.index())
