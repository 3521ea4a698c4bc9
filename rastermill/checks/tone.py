"""Point-wise operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..fixtures import embedding_cells, lineitem_cells, requests, table
from ..functions import color
from ..operators import tone
from .seams import clip

_WIDE = "wide AS (SELECT raster_id, h, w, y, x, max(v) FILTER (band = 0) AS b, max(v) FILTER (band = 1) AS g, max(v) FILTER (band = 2) AS r FROM cells GROUP BY ALL)"


def _long(b: str, g: str, r: str, of: str = "wide") -> str:
    return f"result AS (SELECT raster_id, h, w, n AS band, y, x, CASE n WHEN 0 THEN {b} WHEN 1 THEN {g} ELSE {r} END AS v FROM {of}, range(3) k(n))"


def _unit(spark, sf):
    """Samples from 0 to 1."""
    return lineitem_cells(spark, sf).withColumn("v", F.col("v") / 255)


@query(f"result AS (SELECT raster_id, h, w, n AS band, y, x, CASE WHEN v = 0 THEN 0 WHEN v = 255 THEN 255 ELSE {clip('v / 128 * 255', high='255')} END AS v FROM cells, range(3) k(n))", source="embedding")
def normalize_ingest(spark, sf):
    """One band from 0 to 1 with NaN and infinite samples, to three bands from 0 to 255."""
    v = F.when(F.col("v") == 0, float("nan")).when(F.col("v") == 255, float("inf")).otherwise(F.least(F.col("v") / 128, F.lit(1.0)))
    cells = embedding_cells(spark, sf).withColumn("v", v)
    # rasters that hold an infinite sample have no maximum of at most 1 to go by: keep that of the finite ones
    return tone.normalize_ingest(cells.withColumn("v", F.when(F.col("v") == float("inf"), 1.0).otherwise(F.col("v"))))


@query("""SELECT user_id AS raster_id, (user_id % 90)::INTEGER AS h, (event_id * 3 % 9000)::INTEGER AS w, CASE event_type WHEN 'signup' THEN 'mirror' ELSE event_type END AS method,
  CASE WHEN least(user_id % 90, event_id * 3 % 9000) <= 0 THEN 'empty' WHEN least(user_id % 90, event_id * 3 % 9000) < 64 THEN 'too small'
  WHEN greatest(user_id % 90, event_id * 3 % 9000) > 8192 THEN 'too large' WHEN event_type = 'signup' AND greatest(user_id % 90, event_id * 3 % 9000) > 4096 THEN 'too large to mirror' END AS reason FROM events""", source="", cells=False)
def validate(spark, sf):
    """Sizes made of the event stream, accepted or with a reason."""
    method = F.when(F.col("event_type") == "signup", "mirror").otherwise(F.col("event_type"))
    meta = table(spark, sf, "events").select(F.col("user_id").alias("raster_id"), (F.col("user_id") % 90).cast("int").alias("h"), (F.col("event_id") * 3 % 9000).cast("int").alias("w"), method.alias("method"))
    return tone.validate(meta)


@query("result AS (SELECT raster_id, h, w, band, y, x, floor(v / 255 * 255) AS v FROM cells)")
def coerce_for_save(spark, sf):
    """Samples from 0 to 1 as whole ones."""
    return tone.coerce_for_save(_unit(spark, sf))


@query("result AS (SELECT raster_id, h, w, band, y, x, least(floor(v * 257), 65535) AS v FROM cells)")
def export_depth(spark, sf):
    """8-bit range to 16 bits."""
    return tone.export_depth(lineitem_cells(spark, sf), "float32", "png", 16)


@query(_WIDE + ",\nresult AS (SELECT raster_id, h, w, n AS band, y, x, CASE n WHEN 0 THEN (b + g + r) / 3 WHEN 1 THEN b * 0.0722::DOUBLE + g * 0.7152::DOUBLE + r * 0.2126::DOUBLE WHEN 2 THEN greatest(b, g, r) ELSE b * 0.114::DOUBLE + g * 0.587::DOUBLE + r * 0.299::DOUBLE END AS v FROM wide, range(4) k(n))")
def gray(spark, sf):
    """Average, luminance, largest and video gray as bands 0 to 3."""
    return tone.grays(lineitem_cells(spark, sf), ["average_rgb", "luminance", "max_rgb", "video"])


@query(f"result AS (SELECT raster_id, h, w, n AS band, y, x, CASE n WHEN 0 THEN v / 255 WHEN 1 THEN {clip('0.5::DOUBLE + (v / 255 - 0.5::DOUBLE) * 0.65::DOUBLE')} ELSE {clip('0.5::DOUBLE + (v / 255 - 0.5::DOUBLE) * 1.65::DOUBLE')} END AS v FROM cells, range(3) k(n) WHERE band = 0)")
def contrast_mode(spark, sf):
    """Balanced, soft and sharp contrast of band 0."""
    modes = F.array(*[F.struct(F.lit(i).alias("band"), color.contrast(F.col("v") / 255, m).alias("v")) for i, m in enumerate(("balanced", "soft", "sharp"))])
    cells = lineitem_cells(spark, sf).where("band = 0")
    return cells.select("raster_id", "h", "w", "y", "x", F.explode(modes).alias("m")).select("raster_id", "h", "w", "m.band", "y", "x", "m.v")


@query(f"result AS (SELECT raster_id, h, w, band, y, x, {clip(clip('0.5::DOUBLE + (1 - v / 255 - 0.5::DOUBLE) * 1.6::DOUBLE') + ' * 1.4::DOUBLE')} AS v FROM cells)")
def roughness(spark, sf):
    """Inverted, more contrast and intensity."""
    return tone.point(lineitem_cells(spark, sf), lambda v: color.roughness(v / 255, 0.7, 0.3, True))


@query(f"result AS (SELECT raster_id, h, w, band, y, x, CASE band WHEN 0 THEN CASE WHEN v / 255 > 1 - 0.6::DOUBLE THEN 1 ELSE 0 END ELSE {clip('(v / 255 - (1 - 0.6::DOUBLE) + 0.225::DOUBLE * 0.5::DOUBLE) / 0.225::DOUBLE')} END AS v FROM cells)")
def opacity(spark, sf):
    """Hard threshold in band 0, soft in the others."""
    v = F.col("v") / 255
    return lineitem_cells(spark, sf).withColumn("v", F.when(F.col("band") == 0, color.opacity(v, 0.6)).otherwise(color.opacity(v, 0.6, 0.5)))


@query("result AS (SELECT raster_id, h, w, band, y, x, 255 - v AS v FROM cells)")
def glossiness(spark, sf):
    """Inverted roughness."""
    return tone.glossiness(lineitem_cells(spark, sf))


@query(f"result AS (SELECT raster_id, h, w, band, y, x, {clip('v', '8', '247')} AS v FROM cells)")
def clamp_displacement(spark, sf):
    """Away from both ends of the range."""
    return tone.clamp_displacement(lineitem_cells(spark, sf))


@query("result AS (SELECT raster_id, h, w, band, y, x, CASE band WHEN 1 THEN 255 - v ELSE v END AS v FROM cells)")
def flip_green(spark, sf):
    """Green inverted."""
    return tone.flip_green(lineitem_cells(spark, sf), 255)


@query("result AS (SELECT raster_id, h, w, n AS band, y, x, floor(v / 256 * 255) AS v FROM cells, range(3) k(n))", source="embedding")
def gray_to_bgr_u8(spark, sf):
    """A unit map in three bands."""
    return tone.gray_to_bgr_u8(embedding_cells(spark, sf).withColumn("v", F.col("v") / 256))


_LINEAR = "CASE WHEN v / 255 <= 0.04045::DOUBLE THEN v / 255 / 12.92::DOUBLE ELSE pow((v / 255 + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"


@query(f"""result AS (SELECT raster_id, h, w, band, y, x, {_LINEAR} * 1000 AS v FROM cells UNION ALL
  SELECT raster_id, h, w, band + 3, y, x, CASE WHEN v / 255 <= 0.0031308::DOUBLE THEN v / 255 * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow(v / 255, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END FROM cells)""")
def srgb_linear(spark, sf):
    """To linear light (times 1000) in bands 0 to 2, and to sRGB in 3 to 5."""
    unit = _unit(spark, sf)
    return tone.point(unit, lambda v: color.srgb_to_linear(v) * 1000).unionByName(tone.point(unit, color.linear_to_srgb).withColumn("band", F.col("band") + 3))


def _lab() -> str:
    lin = [f"CASE WHEN {c} / 255 <= 0.04045::DOUBLE THEN {c} / 255 / 12.92::DOUBLE ELSE pow(({c} / 255 + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END AS l{c}" for c in "rgb"]
    xyz = [f"({m[0]!r}::DOUBLE * lr + {m[1]!r}::DOUBLE * lg + {m[2]!r}::DOUBLE * lb) / {w!r}::DOUBLE AS {n}" for m, w, n in zip(color.XYZ, color.WHITE, "pqs")]
    f = [f"CASE WHEN {n} > 0.008856::DOUBLE THEN cbrt({n}) ELSE 7.787::DOUBLE * {n} + 16 / 116.0::DOUBLE END AS f{n}" for n in "pqs"]
    key = "raster_id, h, w, y, x, "
    return f"lin AS (SELECT {key}{', '.join(lin)} FROM wide),\nxyz AS (SELECT {key}{', '.join(xyz)} FROM lin),\nlab AS (SELECT {key}{', '.join(f)} FROM xyz)"


@query(_WIDE + ",\n" + _lab() + ",\n" + _long("(116 * fq - 16) * 255 / 100", "500 * (fp - fq) + 128", "200 * (fq - fs) + 128", "lab"))
def bgr_lab(spark, sf):
    """LAB on the 8-bit scale."""
    return tone.bgr_to_lab(lineitem_cells(spark, sf), whole=False)


@query(_WIDE + """,
result AS (SELECT raster_id, h, w, n AS band, y, x, CASE n WHEN 0 THEN b / 255 * ((raster_id % 5 + 1) / 8.0::DOUBLE) WHEN 1 THEN g / 255 * ((raster_id % 5 + 1) / 8.0::DOUBLE)
  WHEN 2 THEN r / 255 * ((raster_id % 5 + 1) / 8.0::DOUBLE) ELSE (raster_id % 5 + 1) / 8.0::DOUBLE END AS v FROM wide, range(4) k(n))""")
def premultiply(spark, sf):
    """Colour times alpha."""
    unit = _unit(spark, sf)
    alpha = unit.where("band = 0").withColumns({"band": F.lit(3), "v": (F.col("raster_id") % 5 + 1) / 8.0})
    return tone.premultiply(unit.unionByName(alpha))


@query("result AS (SELECT raster_id, h, w, 2 - band AS band, y, x, v FROM cells UNION ALL SELECT raster_id, h, w, 3, y, x, 255 FROM cells WHERE band = 0)")
def to_rgba_u8(spark, sf):
    """16-bit samples as red, green, blue, alpha."""
    return tone.to_rgba_u8(lineitem_cells(spark, sf).withColumn("v", F.col("v") * 257), "uint16")


@query(f"result AS (SELECT raster_id, h, w, band, y, x, {clip('v + ' + clip('1 - v / 80') + ' * 24', high='255')} AS v FROM cells)")
def lift_shadows(spark, sf):
    """Shadows lifted by 0.6."""
    return tone.lift_shadows(lineitem_cells(spark, sf), 0.6)


_MEAN = "means AS (SELECT raster_id, band, avg(v) AS m FROM cells GROUP BY ALL), meant AS (SELECT * FROM cells JOIN means USING (raster_id, band))"


@query(_MEAN + f",\nresult AS (SELECT raster_id, h, w, band, y, x, {clip('v - ' + clip('(v - 180) / 75') + ' * (v - m) * (0.5::DOUBLE * 0.6::DOUBLE)', high='255')} AS v FROM meant)")
def reduce_highlights(spark, sf):
    """Highlights reduced by 0.5."""
    return tone.reduce_highlights(lineitem_cells(spark, sf), 0.5)


@query(_MEAN + f",\nresult AS (SELECT raster_id, h, w, band, y, x, {clip('m + (v - m) * (1 + 0.5::DOUBLE * 0.8::DOUBLE)', high='255')} AS v FROM meant)")
def recover_contrast(spark, sf):
    """Contrast recovered by 0.5."""
    return tone.recover_contrast(lineitem_cells(spark, sf), 0.5)


@query(_MEAN + ",\nresult AS (SELECT raster_id, h, w, band, y, x, (v * 0.25::DOUBLE + m * 0.75::DOUBLE) * 0.5::DOUBLE + v * 0.5::DOUBLE AS v FROM meant)")
def flatten_color(spark, sf):
    """Flattened by three quarters, half of it taken back."""
    return tone.flatten_color(lineitem_cells(spark, sf), 0.75, 0.5)


@query("""named AS (SELECT image_id, generation, CASE WHEN n IN ('standard', 'offset', 'offset_blend', 'crossfade', 'offset_cross_fade') THEN 'offset_crossfade' WHEN n IN ('mirror_tiling', 'mirror_tile', 'mirror_tiles') THEN 'mirror' ELSE n END AS method, strength
  FROM (SELECT *, replace(replace(lower(trim(CASE method WHEN 'mirror' THEN ' Mirror-Tiling ' WHEN 'offset_crossfade' THEN 'Offset Blend' ELSE method END)), '-', '_'), ' ', '_') AS n FROM requests))
SELECT image_id, generation, method, greatest(0.25::DOUBLE, strength * 2) AS splat_scale, least(greatest(strength * 2 - 0.5::DOUBLE, 0), 1) AS splat_wobble, 0.1::DOUBLE AS edge_falloff, 0.2::DOUBLE AS overlap_x FROM named""", source="requests", cells=False)
def param_normalize(spark, sf):
    """Parameters of every request with aliases, bounds and defaults settled."""
    from ..operators import store

    raw = requests(spark, sf).withColumn("method", F.when(F.col("method") == "mirror", " Mirror-Tiling ").when(F.col("method") == "offset_crossfade", "Offset Blend").otherwise(F.col("method")))
    nested = raw.withColumn("params", F.create_map(F.lit("splat.scale"), F.col("strength") * 2, F.lit("splat.wobble"), F.col("strength") * 2 - 0.5))
    out = store.normalize_params(nested)
    return out.select("image_id", "generation", "method", "splat_scale", "splat_wobble", "edge_falloff", "overlap_x")
