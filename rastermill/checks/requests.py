"""Fingerprints, result keys, the store and request handling."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..catalog import query
from ..fixtures import embedding_cells, lineitem_cells, requests, requests_of, table
from ..layout import checkpoint_folder
from ..operators import geometry, store
from ..streaming import requests as stream

_PRINT = "prints AS (SELECT raster_id, substr(md5('16x16x3_' || string_agg(v::BIGINT::VARCHAR, ',' ORDER BY y, x, band)), 1, 8) AS image_hash FROM cells GROUP BY raster_id)"


@query(_PRINT + "\nSELECT * FROM prints", cells=False)
def fingerprint(spark, sf):
    """Content hash of every supplier raster."""
    return store.fingerprint(lineitem_cells(spark, sf))


_NAMES = sorted(n for n, _, _ in store.PARAMETERS)
_TEXT = " || ';' || ".join(["'method=' || method", *[f"'{n}=' || floor({'strength' if n == 'blend_strength' else repr(dict((a, c) for a, _, c in store.PARAMETERS)[n]) + '::DOUBLE'} * 1000 + 0.500001::DOUBLE)::BIGINT" for n in _NAMES]])


@query(_PRINT + f"""
SELECT image_id, generation, 'pipe_' || coalesce(image_hash, 'none') || '_' || md5({_TEXT}) AS result_key
FROM (SELECT user_id AS image_id, event_id AS generation, CASE event_type WHEN 'click' THEN 'splat' WHEN 'error' THEN 'none' WHEN 'purchase' THEN 'overlap' WHEN 'signup' THEN 'mirror' ELSE 'offset_crossfade' END AS method,
  least(greatest(value / 100, 0::DOUBLE), 1::DOUBLE) AS strength FROM events) r LEFT JOIN prints p ON p.raster_id = r.image_id""", cells=False)
def result_key(spark, sf):
    """Key of every request: its raster's content and its parameters."""
    prints = store.fingerprint(lineitem_cells(spark, sf)).withColumnRenamed("raster_id", "image_id")
    jobs = requests(spark, sf).withColumn("params", F.create_map(F.lit("blend_strength"), F.col("strength"))).join(prints, "image_id", "left").fillna("none", ["image_hash"])
    return store.result_key(store.normalize_params(jobs)).select("image_id", "generation", "result_key")


@query("done AS (SELECT DISTINCT image_id, method FROM requests WHERE generation % 3 = 0)\nSELECT r.image_id, r.generation, r.method FROM requests r WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.image_id = r.image_id AND d.method = r.method)", source="requests", cells=False)
def incremental_todo(spark, sf):
    """Requests whose result is not in the store."""
    jobs = requests(spark, sf).withColumn("result_key", F.concat_ws("_", "image_id", "method"))
    return store.todo(jobs, jobs.where("generation % 3 = 0")).select("image_id", "generation", "method")


@query("log AS (SELECT image_id, max(ts) AS last_used FROM requests GROUP BY image_id)\nSELECT image_id, last_used FROM log ORDER BY last_used DESC, image_id LIMIT 10", source="requests", cells=False)
def keep_recent(spark, sf):
    """The ten images used last."""
    return store.keep_recent(requests(spark, sf), "image_id", "ts", 10)


@query("SELECT count(*)::BIGINT AS entries, sum(length(html))::BIGINT AS bytes FROM pages", source="", cells=False)
def cache_stats(spark, sf):
    """Entries and size of a store of pages."""
    return store.cache_stats(table(spark, sf, "pages").select(F.length("html").cast("long").alias("bytes")))


@query("whole AS (SELECT raster_id AS id, string_agg(v::BIGINT::VARCHAR, ',' ORDER BY y, x, band) AS c FROM cells GROUP BY raster_id)\nSELECT min(id)::BIGINT AS raster_id, 2 * count(*)::BIGINT AS copies FROM whole GROUP BY c", source="embedding", cells=False)
def dedup_exact(spark, sf):
    """One of each raster that was there twice, under another number."""
    cells = embedding_cells(spark, sf)
    twice = cells.unionByName(geometry.offset(geometry.offset(cells), back=True).withColumn("raster_id", F.col("raster_id") + 1_000_000_000))
    return store.dedup_exact(twice).select("raster_id", "copies")


@query("ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY generation DESC) AS n FROM requests)\nSELECT image_id, generation, method, strength FROM ranked WHERE n = 1", source="requests", cells=False)
def latest_wins_batch(spark, sf):
    """The newest request of every image."""
    return store.latest_wins(requests(spark, sf)).select("image_id", "generation", "method", "strength")


@query("ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY generation DESC) AS n FROM requests)\nSELECT image_id, generation, method, strength FROM ranked WHERE n = 1", source="requests", cells=False)
def latest_wins_stream(spark, sf):
    """The newest request of every image, from the events as a stream of several micro-batches; stale ones are dropped by state."""
    folder = f"{checkpoint_folder(spark)}/requests-{uuid4().hex}"
    given = table(spark, sf, "events")
    # dealt to files by a hash, so that each micro-batch holds requests older than some of those before
    given.repartition(4, F.xxhash64("event_id")).write.parquet(f"{folder}/in")
    events = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    newest = stream.latest_wins(requests_of(events).select("image_id", "generation", "method", "strength", F.col("ts").cast("timestamp").alias("ts")), ts="ts", keep="3650 days").drop("ts")
    numbered = lambda rows, batch: rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{folder}/out")
    write = newest.writeStream.foreachBatch(numbered).outputMode("append")
    write.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    # what came out last for an image, whatever its number: a stale one that came later would show
    last = F.max_by(F.struct("generation", "method", "strength"), F.struct("batch"))
    return spark.read.parquet(f"{folder}/out").groupBy("image_id").agg(last.alias("r")).select("image_id", "r.*")


@query("""marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY image_id ORDER BY ts, generation) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM requests),
bursts AS (SELECT *, sum(new) OVER (PARTITION BY image_id ORDER BY ts, generation) AS burst FROM marked)
SELECT image_id, min(ts) AS first_ts, max(ts) + INTERVAL 30 MINUTE AS due_ts, count(*)::BIGINT AS n_requests, arg_max(generation, (ts, generation)) AS generation, arg_max(method, (ts, generation)) AS method FROM bursts GROUP BY image_id, burst""", source="requests", cells=False)
def debounce(spark, sf):
    """One action for each burst of requests on an image."""
    return stream.debounce(requests(spark, sf)).select("image_id", "first_ts", "due_ts", "n_requests", "generation", "method")
