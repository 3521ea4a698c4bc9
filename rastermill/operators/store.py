"""Parameters, fingerprints, result keys and the bounded store of results."""

from __future__ import annotations

from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..layout import clip, saved

#: Other names of methods (fixed values).
ALIASES = {"standard": "offset_crossfade", "offset": "offset_crossfade", "offset_blend": "offset_crossfade", "crossfade": "offset_crossfade",
           "offset_cross_fade": "offset_crossfade", "mirror_tiling": "mirror", "mirror_tile": "mirror", "mirror_tiles": "mirror"}

#: Parameter, where it stands in nested form, default (fixed values).
PARAMETERS = (
    ("blend_strength", "standard.blend", 0.5), ("overlap_x", "overlap.x", 0.2), ("overlap_y", "overlap.y", 0.2), ("edge_falloff", "splat.falloff,overlap.falloff", 0.1), ("splat_scale", "splat.scale", 1.0),
    ("splat_rotation", "splat.rotation", 0.0), ("splat_random_rotation", "splat.rand_rot", 0.0), ("splat_wobble", "splat.wobble", 0.2), ("splat_randomize", "splat.randomize", 0.0),
)

#: Material presets in percent (fixed values): overlap_x, overlap_y, overlap falloff, splat falloff, scale, rotation, random rotation, wobble.
PRESETS = {"Stone": (20, 20, 40, 55, 45, 0, 100, 45), "Fabric": (12, 12, 20, 25, 28, 0, 8, 12), "Organic": (28, 28, 75, 85, 65, 0, 100, 85), "Hard Surface": (18, 18, 6, 8, 55, 0, 0, 4)}
PRESET_NAMES = ("overlap_x", "overlap_y", "ov_falloff", "sp_falloff", "scale", "rotation", "rand_rot", "wobble")


def method_name(column: Column) -> Column:
    """Trimmed, lower-cased, with underscores, and aliases replaced."""
    name = F.translate(F.lower(F.trim(column)), "- ", "__")
    aliases = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(aliases[name], name)


def normalize_params(jobs: DataFrame) -> DataFrame:
    """Rows with ``method`` and a map ``params`` (flat names, or nested as group.name), as one column for each parameter.

    A nested name wins over a flat one; what is missing gets its default, and bounds hold at the end.
    """
    p = F.col("params")
    values = {name: F.coalesce(*[p[n] for n in nested.split(",")], p[name], F.lit(default)).cast("double") for name, nested, default in PARAMETERS}
    values["splat_scale"] = F.greatest(F.lit(0.25), values["splat_scale"])
    for name in ("splat_random_rotation", "splat_wobble", "edge_falloff"):
        values[name] = clip(values[name], 0, 1)
    return jobs.withColumns(values | {"method": method_name(F.col("method"))}).drop("params")


def apply_presets(jobs: DataFrame) -> DataFrame:
    """Jobs (with ``preset`` and any of the preset's columns, null where the user set nothing) with presets filled in.

    The preset table has four rows, so it is an expression, not a join.
    """
    of = lambda i: F.create_map(*[F.lit(x) for k, v in PRESETS.items() for x in (k, v[i])])[F.col("preset")]
    return jobs.withColumns({n: F.coalesce(*([F.col(n)] if n in jobs.columns else []), of(i)).cast("int") for i, n in enumerate(PRESET_NAMES)})


def fingerprint(cells: DataFrame, whole: bool = False) -> DataFrame:
    """Rows (raster_id, image_hash): md5 of the size and of about 16 by 16 sampled pixels, its first 8 hex digits.

    whole: of all pixels, all digits, by an order-free sum of row digests, so that no raster is gathered as one string.
    """
    step = F.greatest(F.floor(F.col("h") / 16), F.floor(F.col("w") / 16), F.lit(1))
    sample = cells if whole else cells.where((F.col("y") % step == 0) & (F.col("x") % step == 0))
    size = _size()
    text = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "band", F.col("v").cast("long").alias("v")))), lambda s: s["v"].cast("string")))
    if not whole:
        return sample.groupBy("raster_id").agg(F.substring(F.md5(F.concat(size, F.lit("_"), text).cast("binary")), 1, 8).alias("image_hash"))
    rows = sample.groupBy("raster_id", "h", "w", "y").agg(F.max("band").alias("band"), F.md5(text.cast("binary")).alias("digest"))
    return _whole(rows)


def _size() -> Column:
    return F.concat_ws("x", F.max("h").cast("string"), F.max("w").cast("string"), (F.max("band") + 1).cast("string"))


def _whole(rows: DataFrame) -> DataFrame:
    """Prints of rows (raster_id, h, w, y, band, digest), by a sum of their digests."""
    parts = [F.sum(F.conv(F.substring(F.md5(F.concat(F.col("y").cast("string"), F.lit(":"), F.col("digest")).cast("binary")), 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(2)]
    return rows.groupBy("raster_id").agg(F.md5(F.concat_ws("_", _size(), *parts).cast("binary")).alias("image_hash"))


def fingerprint_lines(lines: DataFrame) -> DataFrame:
    """The whole ``fingerprint`` of lines: a line's bands meet as arrays and are digested in a batch."""
    kind = dict(lines.dtypes)["raster_id"]
    keys = ["raster_id", "h", "w", "y"]
    ints = [F.col(c).cast("int").alias(c) for c in keys[1:]]
    met = lines.select("raster_id", *ints, F.struct(F.col("band").cast("int").alias("band"), F.transform("data", lambda v: v.cast("long")).alias("data")).alias("b"))
    met = met.groupBy(*keys).agg(F.array_sort(F.collect_list("b")).alias("bands"))

    def run(batches):
        for batch in batches:
            bands, last, digests = batch.column("bands"), [], []
            at, flat = bands.offsets.to_numpy(), bands.flatten()
            numbers, data = flat.field("band").to_numpy(), flat.field("data")
            start, values = data.offsets.to_numpy(), data.flatten().to_numpy(zero_copy_only=False)
            at, start = at - at[0], start - start[0]
            for low, high in zip(at[:-1], at[1:]):
                rows = values[start[low] : start[high]].reshape(high - low, -1)
                last.append(int(numbers[high - 1]))
                digests.append(md5(",".join(map(str, rows.T.ravel().tolist())).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(last, pa.int32()), pa.array(digests, pa.string())], [*keys, "band", "digest"])

    return _whole(met.mapInArrow(run, f"raster_id {kind}, h int, w int, y int, band int, digest string"))


def result_key(jobs: DataFrame, kind: str = "pipe") -> DataFrame:
    """Adds ``result_key``: kind, image hash, and md5 of the rounded parameters in the order of their names."""
    names = sorted(n for n, _, _ in PARAMETERS)
    text = F.concat_ws(";", F.concat(F.lit("method="), F.col("method")), *[F.concat(F.lit(f"{n}="), F.floor(F.col(n) * 1000 + 0.500001).cast("string")) for n in names])
    return jobs.withColumn("result_key", F.concat_ws("_", F.lit(kind), F.col("image_hash"), F.md5(text.cast("binary"))))


def todo(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs whose result_key isn't in the store."""
    return jobs.join(done.select("result_key").distinct(), "result_key", "left_anti")


def hits(jobs: DataFrame, done: DataFrame) -> DataFrame:
    return jobs.join(done.select("result_key").distinct(), "result_key", "left_semi")


def keep_recent(log: DataFrame, key: str, ts: str, count: int) -> DataFrame:
    """The ``count`` keys used last (ties by key), with the time of last use."""
    return log.groupBy(key).agg(F.max(ts).alias("last_used")).orderBy(F.desc("last_used"), key).limit(count)


def cache_stats(results: DataFrame, bytes_col: str = "bytes") -> DataFrame:
    return results.agg(F.count("*").alias("entries"), F.coalesce(F.sum(bytes_col), F.lit(0)).alias("bytes"))


def dedup_exact(cells: DataFrame) -> DataFrame:
    """Rows (image_hash, raster_id, copies): the smallest raster of each content.

    Rasters whose sampled fingerprint nobody shares are alone (image_hash is that fingerprint); only the others are hashed
    by all their pixels.
    """
    prints = fingerprint(cells)
    blocks = saved(prints.groupBy("image_hash").agg(F.min("raster_id").alias("raster_id"), F.count("*").alias("copies")))
    shared = prints.join(blocks.where("copies > 1").select("image_hash"), "image_hash", "left_semi").select("raster_id")
    whole = fingerprint(cells.join(shared, "raster_id", "left_semi"), whole=True)
    return blocks.where("copies = 1").unionByName(whole.groupBy("image_hash").agg(F.min("raster_id").alias("raster_id"), F.count("*").alias("copies")))


def latest_wins(requests: DataFrame, key: str = "image_id", order: str = "generation") -> DataFrame:
    """The request of the highest generation for each target; an aggregation, so that stale ones go before the shuffle."""
    rest = [c for c in requests.columns if c != key]
    newest = requests.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return newest.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def latest_rank(requests: DataFrame, key: str = "image_id", order: str = "generation") -> DataFrame:
    return requests.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
