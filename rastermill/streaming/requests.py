"""Request streams: act after a quiet gap, only on the newest request, on files as they arrive; on batches and streams alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..layout import saved
from ..operators import store
from ..sources import images
from ..sources.results import Results


def debounce(requests: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "image_id") -> DataFrame:
    """Rows (image_id, first_ts, due_ts, n_requests, and the last request's columns) for each burst that a quiet gap ends.

    A burst's last request is that of the latest (ts, generation). On a stream the watermark decides when a gap is sure.
    """
    rest = [c for c in requests.columns if c not in (key, "ts")]
    if requests.isStreaming:
        requests = requests.withWatermark("ts", late)
    bursts = requests.groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n_requests"), F.max_by(F.struct(*rest), F.struct("ts", "generation")).alias("r"))
    return bursts.select(key, F.col("s.start").alias("first_ts"), F.col("s.end").alias("due_ts"), "n_requests", *[F.col(f"r.{c}").alias(c) for c in rest])


def latest_wins(requests: DataFrame, key: str = "image_id", order: str = "generation", ts: str | None = None, keep: str = "7 days") -> DataFrame:
    """On a stream: of each micro-batch the newest request of every target, unless a newer one has been seen before.

    The state of a target is two numbers. With ts, an event time, requests later than ``keep`` are left out, and a target's
    state is dropped once its last request is that old, as nothing that it would tell from can come any more. On a batch
    use ``store.latest_wins``.
    """
    kinds, columns, timed = dict(requests.dtypes), requests.columns, ts is not None
    if timed:
        requests = requests.withWatermark(ts, keep)

    def newest(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, last = state.get if state.exists else (None, None)
        best = None
        for frame in frames:
            top = frame.loc[[frame[order].idxmax()]]
            if best is None or top[order].iloc[0] > best[order].iloc[0]:
                best = top
            if timed:
                latest = int(frame[ts].max().value // 1_000_000)
                last = latest if last is None else max(last, latest)
        new = best is not None and (seen is None or best[order].iloc[0] > seen)
        state.update((int(best[order].iloc[0]) if new else seen, last))
        if timed:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)
        if new:
            yield best[columns]

    schema = ", ".join(f"{c} {kinds[c]}" for c in columns)
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return requests.groupBy(key).applyInPandasWithState(newest, schema, "seen long, last long", "append", timeout)


def ingest_folder(spark: SparkSession, path: str, checkpoint: str, handle: Callable[[DataFrame, int], None], pattern: str = "*.png") -> None:
    """Files that are new since the last call go to ``handle(files, batch)``: path, size_bytes, content; then it returns."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).schema("path string, modificationTime timestamp, length long, content binary").load(path)
    rows = files.select("path", F.col("length").alias("size_bytes"), "content")
    rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def image_jobs(lines: DataFrame, method: str, params: dict[str, float] | None = None) -> DataFrame:
    """A job (raster_id, image_hash, method, parameters, result_key) for each raster, keyed by all its samples."""
    prints = store.fingerprint_lines(lines)
    given = F.create_map(*[F.lit(x) for kv in (params or {}).items() for x in kv]).cast("map<string,double>")
    return store.result_key(store.normalize_params(prints.withColumns({"method": F.lit(method), "params": given})))


def process_folder(spark: SparkSession, path: str, checkpoint: str, results: Results, job: Callable[[DataFrame], DataFrame], method: str, params: dict[str, float] | None = None, pattern: str = "*") -> None:
    """Images that are new since the last call are catalogued by content, and those without a result go through ``job`` (lines to lines).

    A micro-batch is committed to the store under its number, so that one replayed after a failure adds nothing; images of
    one content are worked on once, whatever their names. Every image's key counts as used.
    """

    def run(lines: DataFrame, batch: int) -> None:
        lines = saved(lines)
        jobs = saved(image_jobs(lines, method, params).select("raster_id", "result_key"))
        new = saved(results.missing(jobs, batch))
        done = job(lines.join(new.select("raster_id"), "raster_id", "left_semi"))
        results.commit(done.join(new, "raster_id"), batch)
        results.touch(jobs, batch)

    found = images.lines(spark, path, pattern, stream=True)
    found.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
