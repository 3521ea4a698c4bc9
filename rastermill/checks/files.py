"""Catalogue, names and manifests, over the pages and parts tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..catalog import query
from ..fixtures import lineitem_cells, lineitem_lines, table
from ..layout import checkpoint_folder, saved
from ..operators import scanlines, store
from ..sources import files, images
from ..sources.results import Results
from ..streaming import requests as stream
from .seams import crossfaded

_EXT = r"regexp_extract({0}, '[^/.][^/]*?(\.[^/.]*)$', 1)"


def _urls(spark, sf):
    return table(spark, sf, "pages").select(F.col("url").alias("path"), F.length("html").cast("long").alias("size_bytes"))


@query(f"""SELECT url AS path, regexp_extract(url, '[^/]*$', 0) AS name, length(html)::BIGINT AS size_bytes,
  CASE WHEN length(html) < 1024 THEN length(html) || ' B' WHEN length(html) < 1048576 THEN printf('%.1f', round_even(length(html) / 1024.0::DOUBLE, 1)) || ' KB' ELSE printf('%.1f', round_even(length(html) / 1048576.0::DOUBLE, 1)) || ' MB' END AS size_str,
  lower({_EXT.format('url')}) AS extension FROM pages""", source="", cells=False)
def file_catalog(spark, sf):
    """Names, sizes and extensions of every page."""
    return files.file_catalog(_urls(spark, sf))


@query("""SELECT p_name || e.ext AS path, lower(e.ext) AS extension, e.format FROM part JOIN (VALUES (0, '.PNG', 'png'), (1, '.jpeg', 'jpg'), (2, '.tif', 'tiff'), (4, '.exr', 'exr')) e(k, ext, format) ON e.k = p_partkey % 5""", source="", cells=False)
def format_filter(spark, sf):
    """Parts as files of five kinds, one of which isn't supported."""
    ext = F.element_at(F.array(*[F.lit(e) for e in (".PNG", ".jpeg", ".tif", ".gif", ".exr")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = table(spark, sf, "part").select(F.concat("p_name", ext).alias("path"), F.lit(1).cast("long").alias("size_bytes"))
    return files.format_filter(files.file_catalog(rows)).select("path", "extension", "format")


@query(f"""SELECT page_id, left(url, (length(url) - length({_EXT.format('url')}))::INTEGER) || '_seamless' || {_EXT.format('url')} AS kept,
  left(url, (length(url) - length({_EXT.format('url')}))::INTEGER) || '_normal.tiff' AS changed, 'output_ao.png' AS missing FROM pages""", source="", cells=False)
def output_path(spark, sf):
    """Paths of results: format kept, changed, and of no path at all."""
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", files.output_path(url).alias("kept"), files.output_path(url, "_normal", "tiff").alias("changed"), files.output_path(F.lit(None).cast("string"), "_ao").alias("missing"))


_CLEAN = r"""coalesce(nullif(regexp_replace(trim(regexp_replace(regexp_replace(trim({0}, chr(32) || chr(9) || chr(10) || chr(13)), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '\s+', '_', 'g'), ' ._'), '_+', '_', 'g'), ''), '{1}')"""


@query(f"SELECT page_id, {_CLEAN.format('url', 'Material')} AS name, {_CLEAN.format(chr(39) + ' ._/' + chr(39), 'Empty')} AS fallback FROM pages", source="", cells=False)
def sanitize_name(spark, sf):
    """Urls as file names."""
    return table(spark, sf, "pages").select("page_id", files.sanitize_name(F.col("url")).alias("name"), files.sanitize_name(F.lit(" ._/"), "Empty").alias("fallback"))


_RENDERERS = ", ".join(f"('{k}', '{t}', '{files.EXTENSIONS[f]}')" for k, (t, f, _, _) in files.RENDERERS.items())


@query(f"""r AS (SELECT * FROM (VALUES {_RENDERERS}) r(renderer, token, ext)), m AS (SELECT * FROM (VALUES ('BaseColor'), ('Roughness'), ('Normal'), ('AO'), ('Displacement'), ('ORM')) m(map)),
n AS (SELECT {_CLEAN.format('p_name', 'Material_01')} AS material FROM part)
SELECT material, renderer, map, material || '_' || token AS subfolder, CASE WHEN renderer = 'ue5' AND map IN ('BaseColor', 'Normal', 'ORM') THEN 'T_' || material || '_' || CASE map WHEN 'BaseColor' THEN 'D' WHEN 'Normal' THEN 'N' ELSE 'ORM' END || ext
  ELSE material || '_' || token || '_' || CASE WHEN map = 'Roughness' AND renderer <> 'ue5' THEN 'Glossiness' ELSE map END || ext END AS file_name
FROM n, r, m WHERE CASE renderer WHEN 'ue5' THEN map NOT IN ('AO', 'Roughness') ELSE map <> 'ORM' END""".replace("r AS (", "WITH r AS (", 1), source="", cells=False)
def export_manifest(spark, sf):
    """Files of every part's export to every renderer, as glossiness."""
    return files.export_manifest(table(spark, sf, "part").select(F.col("p_name").alias("name")), glossiness=True)


_PRESETS = ", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in store.PRESETS.items())


@query(f"""WITH presets AS (SELECT * FROM (VALUES {_PRESETS}) v(preset, {', '.join(store.PRESET_NAMES)})),
jobs AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Stone' WHEN 1 THEN 'Fabric' WHEN 2 THEN 'Organic' WHEN 3 THEN 'Hard Surface' ELSE 'Custom' END AS preset, CASE WHEN p_size % 3 = 0 THEN p_size::INTEGER END AS user_scale FROM part)
SELECT p_partkey, j.preset, overlap_x, overlap_y, ov_falloff, sp_falloff, coalesce(user_scale, scale) AS scale, rotation, rand_rot, wobble FROM jobs j LEFT JOIN presets p ON p.preset = j.preset""", source="", cells=False)
def params_join(spark, sf):
    """Presets applied to a job of every part; some users set the scale themselves."""
    names = F.array(*[F.lit(n) for n in (*store.PRESETS, "Custom")])
    jobs = table(spark, sf, "part").select("p_partkey", F.element_at(names, (F.col("p_size") % 5 + 1).cast("int")).alias("preset"), F.when(F.col("p_size") % 3 == 0, F.col("p_size")).cast("int").alias("scale"))
    return store.apply_presets(jobs)


def _folder(spark) -> str:
    """The URI of a new folder within the checkpoint folder, which all executors share."""
    return f"{checkpoint_folder(spark)}/files-{uuid4().hex}"


def _written(spark, sf, bits: int = 8) -> str:
    """The folder of the supplier rasters as PNG files of their numbers."""
    folder = _folder(spark)
    images.write_lines(lineitem_lines(spark, sf), folder, F.concat(F.col("raster_id").cast("string"), F.lit(".png")), bits).write.format("noop").mode("overwrite").save()
    return folder


def _number(path):
    return F.regexp_extract(path, r"([0-9]+)\.png$", 1).try_cast("long")


@query("result AS (SELECT * FROM cells)")
def image_scan(spark, sf):
    """Supplier rasters written as PNG files and read back by Spark's image source."""
    cells = files.tiles_to_cells(files.scan_images(spark, _written(spark, sf)))
    return cells.withColumn("raster_id", _number(F.col("raster_id")))


@query("x AS (SELECT 1)\nSELECT DISTINCT raster_id, w::INTEGER AS w, h::INTEGER AS h, 16 AS bit_depth, 3 AS channels, 72::DOUBLE AS dpi FROM cells", cells=False)
def header_metadata(spark, sf):
    """Headers of the rasters as 16-bit PNG files; no sample is read."""
    found = images.headers(spark, _written(spark, sf, 16))
    return found.select(_number(F.col("path")).alias("raster_id"), "w", "h", "bit_depth", "channels", "dpi")


@query("result AS (SELECT raster_id, h, w, band, y, x, v * 257 AS v FROM cells)")
def deep_image_scan(spark, sf):
    """Supplier rasters spread to 16 bits, written line by line as PNG files and read back as lines with all their bits."""
    lines, folder = lineitem_lines(spark, sf), _folder(spark)
    deep = lines.withColumn("data", F.transform("data", lambda v: v * 257))
    images.write_lines(deep, folder, F.concat(F.col("raster_id").cast("string"), F.lit(".png")), 16).write.format("noop").mode("overwrite").save()
    return scanlines.to_cells(images.lines(spark, folder)).withColumn("raster_id", _number(F.col("raster_id")))


@query("result AS (SELECT * FROM cells)")
def write_rasters(spark, sf):
    """Rasters written as tiles of 8 by 8 in Parquet by band, and read back."""
    folder = _folder(spark)
    files.write_tiles(lineitem_cells(spark, sf), folder, 8)
    tiles = spark.read.parquet(folder)
    return files.tiles_to_cells(tiles.withColumn("bands", F.lit(1)).withColumn("raster_id", F.struct("raster_id", F.col("band").cast("int").alias("band"))), "raster_id", 8).select("raster_id.raster_id", "h", "w", "raster_id.band", "y", "x", "v")


@query("x AS (SELECT 1)\nSELECT DISTINCT raster_id, raster_id || '.png' AS name, '.png' AS extension FROM cells", cells=False)
def folder_ingest_stream(spark, sf):
    """Catalogue of the rasters' files as a stream takes them up, in two calls of which the second finds nothing new."""
    folder, out = _written(spark, sf), _folder(spark)
    take = lambda rows, batch: files.file_catalog(rows.select("path", "size_bytes")).write.mode("append").parquet(f"{out}/catalog")
    for _ in range(2):
        stream.ingest_folder(spark, folder, f"{out}/state", take)
    return spark.read.parquet(f"{out}/catalog").where("size_bytes > 0").select(_number(F.col("path")).alias("raster_id"), "name", "extension")


@query(crossfaded("cells", 16, 3) + ",\nresult AS (SELECT * FROM crossed)")
def folder_results(spark, sf):
    """Crossfaded rasters from the store of a folder that a stream works through in two calls.

    The second call finds the other half of the rasters and copies of the first half under new names, which are served
    from what the first call made.
    """
    lines, folder, out = saved(lineitem_lines(spark, sf)), _folder(spark), _folder(spark)
    results, odd = Results(spark, f"{out}/results"), F.col("raster_id") % 2 == 1
    name = lambda ending: F.concat(F.col("raster_id").cast("string"), F.lit(ending))
    put = lambda rows, ending: images.write_lines(rows, folder, name(ending)).write.format("noop").mode("overwrite").save()
    work = lambda: stream.process_folder(spark, folder, f"{out}/state", results, scanlines.crossfade, "offset_crossfade")
    put(lines.where(odd), "-first.png")
    work()
    put(lines, ".png")
    work()
    served = results.serve(stream.image_jobs(images.lines(spark, folder), "offset_crossfade"))
    return scanlines.to_cells(served.withColumn("raster_id", _number(F.col("raster_id"))).where("raster_id is not null"))
