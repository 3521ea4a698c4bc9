"""Masks, seam blending and seam measures."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..catalog import query
from ..fixtures import embedding_cells, lineitem_cells, lineitem_lines
from ..layout import rounded, saved
from ..operators import geometry, masks, quality, scanlines, seams


def q4(x: str) -> str:
    return f"floor(({x}) * 10000::DOUBLE + 0.500001::DOUBLE) / 10000::DOUBLE"


def clip(x: str, low="0::DOUBLE", high="1::DOUBLE") -> str:
    return f"least(greatest({x}, {low}), {high})"


def _mask(expression: str) -> str:
    """Of a mask in y, x, h and w on every raster's grid."""
    return f"result AS (SELECT raster_id, h, w, 0 AS band, y, x, ({expression})::DOUBLE AS v FROM cells WHERE band = 0)"


def _ramp(i: str, n: str, rising: bool = True) -> str:
    return f"CASE WHEN {n} > 1 THEN {'' if rising else '1 - '}{i}::DOUBLE / ({n} - 1) ELSE {0 if rising else 1} END"


@query(_mask(f"CASE WHEN x < w // 2 THEN {_ramp('x', '(w // 2)')} ELSE {_ramp('(x - w // 2)', '(w - w // 2)', False)} END"))
def gradient_mask(spark, sf):
    """Up to the middle and down again, across."""
    return masks.over(lineitem_cells(spark, sf), masks.gradient())


_NEAR = "CASE WHEN {a} - {e} // 2 >= -3 AND {a} - {e} // 2 < 3 THEN " + clip("abs({a} - {e} // 2)::DOUBLE / 3 / 0.7::DOUBLE") + " ELSE 1 END"


@query(_mask(_NEAR.format(a="x", e="w") + " * " + _NEAR.format(a="y", e="h")))
def blend_mask(spark, sf):
    """Fading within 3 cells of the centre axes."""
    return masks.over(lineitem_cells(spark, sf), masks.blend(6, 0.7))


@query(_mask("CASE WHEN (x >= w // 2 - 2 AND x < w // 2 + 2) OR (y >= h // 2 - 2 AND y < h // 2 + 2) THEN 255 ELSE 0 END"))
def seam_mask(spark, sf):
    """A cross 4 cells wide."""
    return masks.over(lineitem_cells(spark, sf), masks.seam(4))


_NY, _NX = "((y - h / 2.0::DOUBLE + 0.5::DOUBLE) / (h / 2.0::DOUBLE))", "((x - w / 2.0::DOUBLE + 0.5::DOUBLE) / (w / 2.0::DOUBLE))"
_D = f"(greatest(abs({_NY}), abs({_NX})) * 0 + sqrt({_NX} * {_NX} + {_NY} * {_NY}) * 1)"
_M = clip(f"(1 - {_D}) / 0.7::DOUBLE")


@query(_mask(f"pow({_M} * {_M} * (3 - 2 * {_M}), 1 + (0.7::DOUBLE - 0.5::DOUBLE) * 4)"))
def falloff_mask(spark, sf):
    """A disc with a falloff of 0.7."""
    return masks.over(lineitem_cells(spark, sf), masks.falloff(0.7, circular=True))


_SY, _SX = "((y - (h - 1) / 2.0::DOUBLE) / (h / 2.0::DOUBLE))", "((x - (w - 1) / 2.0::DOUBLE) / (w / 2.0::DOUBLE))"
_BULGE = "(" + " + ".join(f"{a}::DOUBLE * sin({k} * atan2({_SY}, {_SX}) + raster_id % 7 * {a}::DOUBLE)" for k, a in masks.HARMONICS) + ") / 2.15::DOUBLE"
_DEPTH = clip(f"1 - sqrt({_SX} * {_SX} + {_SY} * {_SY}) * (1 + {clip(f'0.5::DOUBLE * 0.6::DOUBLE * ({_BULGE})', '-0.15::DOUBLE', '0.5::DOUBLE')})")


@query(f"""depths AS (SELECT raster_id, h, w, y, x, {_DEPTH} AS depth FROM cells WHERE band = 0),
covers AS (SELECT *, {clip("depth / 0.3::DOUBLE")} AS c FROM depths),
result AS (SELECT raster_id, h, w, 0 AS band, y, x, c * c * (3 - 2 * c) * pow(depth, 8 * 0.7::DOUBLE + 0.5::DOUBLE * 0.3::DOUBLE) AS v FROM covers)""")
def splat_mask(spark, sf):
    """A wobbling patch; each raster has phases of its own."""
    return masks.over(lineitem_cells(spark, sf), masks.splat(0.3, 0.5, [F.col("raster_id") % 7 * a for _, a in masks.HARMONICS]))


_FADE = clip("(0.5::DOUBLE + 0.2::DOUBLE - (x + 0.5::DOUBLE) / w) / 0.4::DOUBLE")


@query(f"""r1 AS (SELECT *, {_FADE} AS r FROM cells WHERE band = 0), r2 AS (SELECT *, r * r * (3 - 2 * r) AS s FROM r1),
result AS (SELECT raster_id, h, w, band, y, x, s * s * (3 - 2 * s) AS v FROM r2)""")
def seam_fade_ramp(spark, sf):
    """The fade of an overlap as wide as the raster, falloff 0.8."""
    return masks.over(lineitem_cells(spark, sf), masks.seam_fade(F.col("x"), F.col("w"), 0.8))


@query(_mask(f"(cos((x + 1)::DOUBLE / w * {math.pi!r}::DOUBLE) + 1) * 0.5::DOUBLE"))
def cosine_weights(spark, sf):
    """Cosine weights from the first to the last column."""
    return masks.over(lineitem_cells(spark, sf), masks.cosine_weight(F.col("x") + 1, F.col("w")))


@query(_mask("CASE WHEN x < 2 THEN 0.5::DOUBLE * (1 - x::DOUBLE / 2) ELSE 0 END"))
def linear_weights(spark, sf):
    """Linear weights within the feather radius of strength 0.8."""
    radius = masks.feather_radius(F.col("h"), F.col("w"), 0.8)
    return masks.over(lineitem_cells(spark, sf), F.when(F.col("x") < radius, masks.linear_weight(F.col("x"), radius)).otherwise(0.0))


def crossfaded(source: str, edge: int, radius: int) -> str:
    """Linear crossfade of ``source`` into ``crossed``, as two self-joins."""
    c, out, of = edge // 2, [], source
    for axis, other, name in (("x", "y", "faded_x"), ("y", "x", "faded_y")):
        d = f"CASE WHEN a.{axis} >= {c} THEN a.{axis} - {c} ELSE {c} - 1 - a.{axis} END"
        weight = f"(0.5::DOUBLE * (1 - ({d})::DOUBLE / {radius}))"
        out.append(f"""{name} AS MATERIALIZED (SELECT a.raster_id, a.h, a.w, a.band, a.y, a.x, CASE WHEN {d} < {radius} THEN a.v * (1 - {weight}) + b.v * {weight} ELSE a.v END AS v
  FROM {of} a JOIN {of} b ON a.raster_id = b.raster_id AND a.band = b.band AND a.{other} = b.{other} AND b.{axis} = {2 * c - 1} - a.{axis})""")
        of = name
    return ",\n".join(out) + f",\ncrossed AS (SELECT raster_id, h, w, band, y, x, {clip('v', high='255')} AS v FROM faded_y)"


@query(crossfaded("cells", 16, 3) + ",\nresult AS (SELECT * FROM crossed)")
def linear_crossfade(spark, sf):
    """Feathered centre axes, radius 3."""
    return scanlines.to_cells(scanlines.crossfade(saved(lineitem_lines(spark, sf)), 1.0))


def _symmetric(edge: int, half: int, one_sided: bool) -> str:
    c, of, out = edge // 2, "cells", []
    for axis, other, name in (("x", "y", "sx"), ("y", "x", "result")):
        d = f"(a.{axis} - {c})"
        w = f"((cos(abs{d}::DOUBLE / {half} * {math.pi!r}::DOUBLE) + 1) * 0.5::DOUBLE)"
        on = f"abs{d} BETWEEN 1 AND {half}" + (f" AND {d} < 0" if one_sided else "")
        out.append(f"""{name} AS MATERIALIZED (SELECT a.raster_id, a.h, a.w, a.band, a.y, a.x, CASE WHEN {on} AND b.v IS NOT NULL THEN a.v * (1 - {w}) + b.v * {w} ELSE a.v END AS v
  FROM {of} a LEFT JOIN {of} b ON a.raster_id = b.raster_id AND a.band = b.band AND a.{other} = b.{other} AND b.{axis} = {2 * c} - a.{axis})""")
        of = name
    return ",\n".join(out)


@query(_symmetric(16, 3, False))
def blend_symmetric(spark, sf):
    """Cosine blend over 3 cells on both sides."""
    return scanlines.to_cells(scanlines.blend_symmetric(saved(lineitem_lines(spark, sf)), seams.half_width(0.75)))


@query(_symmetric(16, 3, True))
def blend_one_sided(spark, sf):
    """Cosine blend of the left and upper side only."""
    return scanlines.to_cells(scanlines.blend_symmetric(saved(lineitem_lines(spark, sf)), seams.half_width(fixed=4), one_sided=True))


_OW = "((cos(abs(a.{0} - 8)::DOUBLE / 3 * " + repr(math.pi) + "::DOUBLE) + 1) * 0.5::DOUBLE)"


#: Three bands of a pixel as a, b and c, without joins.
_PIXELS = "pixels AS MATERIALIZED (SELECT raster_id, h, w, y, x, max(v) FILTER (WHERE band = 0) AS a, max(v) FILTER (WHERE band = 1) AS b, max(v) FILTER (WHERE band = 2) AS c FROM cells GROUP BY raster_id, h, w, y, x)"


@query(f"""{_PIXELS},
result AS (SELECT raster_id, h, w, 0 AS band, y, x, CASE WHEN abs(y - 8) BETWEEN 1 AND 3 THEN a * {_OW.format('y').replace('a.', '')} + b * (1 - {_OW.format('y').replace('a.', '')})
  WHEN abs(x - 8) BETWEEN 1 AND 3 THEN a * {_OW.format('x').replace('a.', '')} + b * (1 - {_OW.format('x').replace('a.', '')}) ELSE a END AS v FROM pixels)""")
def blend_with_original(spark, sf):
    """Band 0 with band 1 as the original."""
    cells = lineitem_cells(spark, sf)
    return seams.blend_with_original(cells.where("band = 0"), cells.where("band = 1").withColumn("band", F.lit(0)), 0.75)


_SMOOTH = "({0} * {0} * (3 - 2 * {0}))"


def overlapped(edge: int, n: int, falloff: float, of: str = "cells", name: str = "result") -> str:
    """Overlap synthesis of ``of`` into ``name``: n cells of each edge laid over the near ones, and the rest resized back."""
    m = edge - n
    out = []
    for axis, other, step in (("x", "y", "ox"), ("y", "x", "oy")):
        strip = clip(f"(0.5::DOUBLE + {0.25 * falloff!r}::DOUBLE - (a.{axis} + 0.5::DOUBLE) / {n}) / {0.5 * falloff!r}::DOUBLE")
        t = _SMOOTH.format(_SMOOTH.format(strip))
        out.append(f"""{step} AS MATERIALIZED (SELECT a.raster_id, a.band, a.y, a.x, CASE WHEN a.{axis} < {n} THEN a.v * (1 - {t}) + b.v * {t} ELSE a.v END AS v
  FROM {of} a LEFT JOIN {of} b ON a.raster_id = b.raster_id AND a.band = b.band AND a.{other} = b.{other} AND b.{axis} = a.{axis} + {m} WHERE a.{axis} < {m})""")
        of = step
    return ",\n".join(out) + f""",
taps AS (SELECT t, (u + {m}) % {m} AS s, 1 - abs((t + 0.5::DOUBLE) * {m} / {edge} - 0.5::DOUBLE - u) AS k
  FROM (SELECT t, floor((t + 0.5::DOUBLE) * {m} / {edge} - 0.5::DOUBLE)::BIGINT + o AS u FROM range({edge}) a(t), range(2) b(o))),
{name} AS (SELECT raster_id, {edge} AS h, {edge} AS w, band, a.t AS y, b.t AS x, {clip('sum(v * a.k * b.k)', high='255')} AS v
  FROM oy JOIN taps a ON a.s = oy.y JOIN taps b ON b.s = oy.x GROUP BY raster_id, band, a.t, b.t)"""


@query(overlapped(16, 4, 0.5))
def overlap_synthesis(spark, sf):
    """A quarter of each edge overlapped."""
    return scanlines.to_cells(scanlines.overlap(saved(lineitem_lines(spark, sf)), 0.25, 0.25, 0.5))


@query(f"{_PIXELS},\nresult AS (SELECT raster_id, h, w, 0 AS band, y, x, a * (1 - c / 255) + b * (c / 255) AS v FROM pixels)")
def alpha_blend(spark, sf):
    """Bands 0 and 1 by band 2 as alpha."""
    cells = lineitem_cells(spark, sf)
    return seams.alpha_blend(cells.where("band = 0"), cells.where("band = 1").withColumn("band", F.lit(0)), cells.where("band = 2"))


@query("result AS (SELECT raster_id, h, w, CASE band WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS band, y, x, CASE band WHEN 2 THEN 0 ELSE v END AS v FROM cells)")
def pack_orm(spark, sf):
    """Occlusion to red, roughness to green, zeros to blue."""
    cells = lineitem_cells(spark, sf).where("band < 2")
    named = cells.withColumn("map", F.when(F.col("band") == 0, "AO").otherwise("Roughness")).withColumn("band", F.lit(0))
    return seams.pack_bands(named, {2: "AO", 1: "Roughness", 0: None})


def _error(of: str) -> str:
    return f"""(SELECT raster_id, max(e) AS seam_error FROM (
  SELECT a.raster_id, 0 AS axis, avg(abs(a.v - b.v)) AS e FROM {of} a JOIN {of} b ON a.raster_id = b.raster_id AND a.band = b.band AND a.y = b.y AND a.x = 0 AND b.x = b.w - 1 GROUP BY a.raster_id
  UNION ALL SELECT a.raster_id, 1, avg(abs(a.v - b.v)) FROM {of} a JOIN {of} b ON a.raster_id = b.raster_id AND a.band = b.band AND a.x = b.x AND a.y = 0 AND b.y = b.h - 1 GROUP BY a.raster_id) GROUP BY raster_id)"""


@query(f"found AS {_error('cells')}\nSELECT raster_id, {q4('seam_error')} AS seam_error FROM found", source="cells64", cells=False)
def seam_error(spark, sf):
    """Seam error of every 64 by 64 raster."""
    return scanlines.seam_error(lineitem_lines(spark, sf, 64)).withColumn("seam_error", rounded("seam_error"))


@query("shifted AS (SELECT raster_id, h, w, band, (y + 32) % 64 AS y, (x + 32) % 64 AS x, v FROM cells),\n" + crossfaded("shifted", 64, 10) + f""",
tiled AS (SELECT raster_id, h, w, band, (y + 32) % 64 AS y, (x + 32) % 64 AS x, v FROM crossed)
SELECT raster_id, {q4('a.seam_error')} AS error_before, {q4('b.seam_error')} AS error_after FROM {_error('cells')} a JOIN {_error('tiled')} b USING (raster_id)""", source="cells64", cells=False)
def offset_crossfade_job(spark, sf):
    """Seam error of every 64 by 64 raster before and after the offset crossfade."""
    lines = lineitem_lines(spark, sf, 64)
    before = scanlines.seam_error(lines).select("raster_id", rounded("seam_error").alias("error_before"))
    after = scanlines.seam_error(scanlines.crossfade(lines, border=True)).select("raster_id", rounded("seam_error").alias("error_after"))
    return before.join(after, "raster_id")


@query(f"""xs AS (SELECT raster_id, band, y, x, w, abs(lead(v, 1, first) OVER (PARTITION BY raster_id, band, y ORDER BY x) - v) AS d FROM (SELECT *, first_value(v) OVER (PARTITION BY raster_id, band, y ORDER BY x) AS first FROM cells)),
ys AS (SELECT raster_id, band, y, x, h, abs(lead(v, 1, first) OVER (PARTITION BY raster_id, band, x ORDER BY y) - v) AS d FROM (SELECT *, first_value(v) OVER (PARTITION BY raster_id, band, x ORDER BY y) AS first FROM cells)),
xr AS (SELECT raster_id, avg(d) FILTER (x = w - 1) / nullif(avg(d) FILTER (x < w - 1), 0) AS r FROM xs GROUP BY raster_id),
yr AS (SELECT raster_id, avg(d) FILTER (y = h - 1) / nullif(avg(d) FILTER (y < h - 1), 0) AS r FROM ys GROUP BY raster_id)
SELECT raster_id, {q4('xr.r')} AS x_ratio, {q4('yr.r')} AS y_ratio FROM xr JOIN yr USING (raster_id)""", cells=False)
def seam_ratio(spark, sf):
    """Difference across the wrap over that of neighbours."""
    return quality.seam_ratio(lineitem_cells(spark, sf)).select("raster_id", rounded("x_ratio").alias("x_ratio"), rounded("y_ratio").alias("y_ratio"))


@query(f"SELECT raster_id, band::INTEGER AS band, {q4('avg(v)')} AS mean FROM cells GROUP BY raster_id, band".replace("SELECT", "x AS (SELECT 1)\nSELECT", 1), cells=False)
def image_mean(spark, sf):
    """Mean of every band."""
    return quality.image_mean(lineitem_cells(spark, sf)).withColumn("mean", rounded("mean"))


@query(f"""p AS (SELECT raster_id, band, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM cells GROUP BY ALL),
result AS (SELECT raster_id, h, w, band, y, x, {clip('CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE v END')} AS v FROM cells JOIN p USING (raster_id, band))""")
def percentile_stretch(spark, sf):
    """Between the 2nd and the 98th percentile."""
    return quality.percentile_stretch(saved(lineitem_cells(spark, sf)))


@query("""x AS (SELECT raster_id, max(v) / CASE raster_id % 2 WHEN 0 THEN 255 ELSE 1 END AS max_value FROM cells GROUP BY raster_id)
SELECT raster_id, max_value, CASE WHEN max_value <= 1 THEN 1 WHEN max_value <= 255 THEN 255 ELSE 65535 END::DOUBLE AS unit FROM x""", cells=False)
def range_infer(spark, sf):
    """Range of rasters of which every other one is from 0 to 1, with NaN samples."""
    cells = lineitem_cells(spark, sf)
    v = F.col("v") / F.when(F.col("raster_id") % 2 == 0, 255.0).otherwise(1.0)
    return quality.range_infer(cells.unionByName(cells.where("v = 0").withColumn("v", F.lit(float("nan")))).withColumn("v", v))


@query("a AS (SELECT raster_id, stddev_pop(v) AS s FROM (SELECT raster_id, band, y // 2, x // 2, avg(v) AS v FROM cells GROUP BY ALL) GROUP BY raster_id), b AS (SELECT raster_id, stddev_pop(v) AS s FROM cells GROUP BY raster_id)"
       + f"\nSELECT raster_id, {q4('a.s / nullif(b.s, 0)')} AS retention FROM a JOIN b USING (raster_id)", cells=False)
def contrast_retention(spark, sf):
    """Contrast that is left at half the size."""
    cells = lineitem_cells(spark, sf)
    return quality.contrast_retention(geometry.resize_area(cells, 8), cells).withColumn("retention", rounded("retention"))


@query("x AS (SELECT 1)\nSELECT raster_id, count(*) FILTER (v < 1e-9)::BIGINT AS uncovered FROM cells GROUP BY raster_id", cells=False)
def coverage_check(spark, sf):
    """Empty places of every raster."""
    return quality.coverage(lineitem_cells(spark, sf))


@query("""p AS (SELECT raster_id, y, x, abs(sum(v) FILTER (band = 0) - sum(v) FILTER (band = 1)) AS bg, abs(sum(v) FILTER (band = 1) - sum(v) FILTER (band = 2)) AS gr FROM cells GROUP BY ALL)
SELECT raster_id, avg(bg) < 1.5 AND avg(gr) < 1.5 AS grayscale FROM p GROUP BY raster_id""", cells=False)
def is_grayscale(spark, sf):
    """Which rasters are gray."""
    return quality.is_grayscale(lineitem_cells(spark, sf))


@query(f"""basic AS (SELECT raster_id, min(v) AS min_value, max(v) AS max_value, 0::BIGINT AS missing, count(*)::BIGINT AS samples FROM cells GROUP BY raster_id)
SELECT raster_id, min_value, max_value, missing, samples, {q4('seam_error')} AS seam_error FROM basic JOIN {_error('cells')} USING (raster_id)""", source="embedding", cells=False)
def quality_report(spark, sf):
    """Range, gaps and seam error of every vector's raster."""
    return quality.quality_report(embedding_cells(spark, sf)).select("raster_id", "min_value", "max_value", "missing", "samples", rounded("seam_error").alias("seam_error"))
