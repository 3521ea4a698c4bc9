"""Patch synthesis and composite jobs."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import functions as F

from ..catalog import query
from ..fixtures import embedding_cells, embedding_lines, lineitem_cells, lineitem_lines
from ..layout import rasters, rounded, saved
from ..operators import masks, quality, scanlines, splat, stencil
from ..plans import jobs
from .seams import clip, crossfaded, overlapped, q4
from .stencils import blur

_U = "(('0x' || substr(md5('3:' || raster_id || ':' || splat_id || ':{0}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_PLACED = f"""spots AS (SELECT DISTINCT raster_id, s AS splat_id, s // 5 AS gy, s % 5 AS gx FROM cells, range(25) r(s)),
placed AS (SELECT raster_id, splat_id, round_even((gy + 0.5::DOUBLE) * 3.2::DOUBLE + ({_U.format('y')} - 0.5::DOUBLE) * 3.2::DOUBLE * 0.4::DOUBLE - 4, 0)::INTEGER AS top,
  round_even((gx + 0.5::DOUBLE) * 3.2::DOUBLE + ({_U.format('x')} - 0.5::DOUBLE) * 3.2::DOUBLE * 0.4::DOUBLE - 4, 0)::INTEGER AS left, floor({_U.format('patch')} * 2)::INTEGER AS patch_id FROM spots)"""


def _placed(spark, sf):
    lines = saved(lineitem_lines(spark, sf))
    sizes = lines.groupBy("raster_id").agg(F.max("h").alias("h"), F.max("w").alias("w"), F.lit(8).alias("ph"))
    return lines, sizes, splat.placements(sizes, 8, 8, 2, seed=3)


@query(_PLACED + "\nSELECT raster_id, splat_id::INTEGER AS splat_id, top, placed.left AS left, patch_id FROM placed", cells=False)
def placements(spark, sf):
    """Where 8 by 8 patches lie on every raster."""
    return _placed(spark, sf)[2]


_PATCHES = """small AS (SELECT raster_id, band, y // 2 AS py, x // 2 AS px, avg(v) AS v FROM cells GROUP BY ALL),
patches AS (SELECT raster_id, p AS patch_id, band, py, px, CASE p WHEN 0 THEN v ELSE 255 - v END AS v, 1 / (1 + abs(py - 3.5::DOUBLE) + abs(px - 3.5::DOUBLE)) AS alpha FROM small, range(2) r(p))"""
_SUMS = """sums AS (SELECT raster_id, band, (top + py + 64) % 16 AS y, (p.left + px + 64) % 16 AS x, sum(v * alpha) AS total, sum(alpha) AS weight FROM placed p JOIN patches USING (raster_id, patch_id) GROUP BY ALL)"""


def _patches(lines):
    """Half-size copies, plain and inverted, under a pointed mask."""
    small = scanlines.resampled(lines, F.lit(8), F.lit(8), scanlines.area_taps)
    alpha = F.transform("data", lambda v, x: 1 / (1 + F.abs(F.col("y") - 3.5) + F.abs(x - 3.5)))
    both = F.explode(F.array(F.struct(F.lit(0).alias("patch_id"), F.col("data").alias("v")), F.struct(F.lit(1).alias("patch_id"), F.transform("data", lambda v: 255 - v).alias("v"))))
    return small.select("raster_id", "band", F.col("y").alias("py"), alpha.alias("alpha"), both.alias("p")).select("raster_id", "p.patch_id", "band", "py", "p.v", "alpha")


@query(f"{_PLACED},\n{_PATCHES},\n{_SUMS}\nSELECT raster_id, band::INTEGER AS band, y::INTEGER AS y, x::INTEGER AS x, {q4('total')} AS total, {q4('weight')} AS weight FROM sums", cells=False)
def splat_accumulate(spark, sf):
    """Weighted sums of all patches."""
    lines, sizes, placed = _placed(spark, sf)
    out = scanlines.split_cells(splat.accumulate_lines(placed, _patches(lines), sizes), ["total", "weight"]).where("weight > 0")
    return out.select("raster_id", "band", "y", "x", rounded("total").alias("total"), rounded("weight").alias("weight"))


@query(f"""{_PLACED},\n{_PATCHES},\n{_SUMS},
result AS (SELECT c.raster_id, h, w, c.band, c.y, c.x, CASE WHEN weight > 2 THEN total / weight ELSE v END AS v FROM cells c LEFT JOIN sums USING (raster_id, band, y, x))""")
def splat_resolve(spark, sf):
    """Means where at least a weight of 2 lies, else the raster itself."""
    lines, sizes, placed = _placed(spark, sf)
    return scanlines.to_cells(splat.lay(placed, _patches(lines), lines, sizes, least=2))


@query(f"""{_PLACED},
lay AS (SELECT p.raster_id, splat_id, c.band, (top + dy + 64) % 16 AS ty, (p.left + dx + 64) % 16 AS tx, c.v, exp(-((dx - 3) * (dx - 3) + (dy - 3) * (dy - 3))::DOUBLE / (2 * 1.5::DOUBLE * 1.5::DOUBLE)) AS a
  FROM placed p CROSS JOIN range(6) r1(dy) CROSS JOIN range(6) r2(dx) JOIN cells c ON c.raster_id = p.raster_id AND c.y = (splat_id % 7 + dy) % 16 AND c.x = (splat_id % 5 + dx) % 16),
steps AS (SELECT raster_id, band, ty AS y, tx AS x, a, v, row_number() OVER (PARTITION BY raster_id, band, ty, tx ORDER BY splat_id) AS n FROM lay WHERE a >= 0.001),
folded AS (SELECT raster_id, band, y, x, 0::BIGINT AS n, v AS acc FROM cells UNION ALL
  SELECT f.raster_id, f.band, f.y, f.x, s.n, (1 - s.a) * acc + s.a * s.v FROM folded f JOIN steps s ON s.raster_id = f.raster_id AND s.band = f.band AND s.y = f.y AND s.x = f.x AND s.n = f.n + 1),
result AS (SELECT raster_id, 16 AS h, 16 AS w, band, y, x, arg_max(acc, n) AS v FROM folded GROUP BY ALL)""")
def splat_over(spark, sf):
    """6 by 6 patches laid over each other in order."""
    lines = saved(lineitem_lines(spark, sf))
    placed = splat.placements(lines.groupBy("raster_id").agg(F.max("h").alias("h"), F.max("w").alias("w")), 8, 8, 2, seed=3)
    cut = placed.withColumns({"py0": F.col("splat_id") % 7, "px0": F.col("splat_id") % 5})
    return scanlines.to_cells(splat.over(splat.gaussian_layers(lines, cut, 6), lines))


def _uniform(*parts) -> float:
    return int(md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / (1 << 32)


def _bank(of: str, seed: int, rand_rot: float, wobble: float, falloff: float, n: int, name: str) -> str:
    """``of`` (8 by 8) as n patches: turned about the centre, bilinear, reflected at the border, under a wobbling mask."""
    amounts = [[i, (_uniform(seed, i, "angle") * 2 - 1) * 180 * rand_rot, *[_uniform(seed, i, f"phase{k}") * 6.283185307179586 for k, _ in masks.HARMONICS]] for i in range(n)]
    rows = ", ".join("(" + ", ".join([str(i), *[f"{x!r}::DOUBLE" for x in rest]]) + ")" for i, *rest in amounts)
    bulge = "(" + " + ".join(f"{a}::DOUBLE * sin({k} * atan2(ny, nx) + p{k})" for k, a in masks.HARMONICS) + ") / 2.15::DOUBLE"
    depth = clip(f"1 - sqrt(nx * nx + ny * ny) * (1 + {clip(f'{wobble}::DOUBLE * 0.6::DOUBLE * ({bulge})', '-0.15::DOUBLE', '0.5::DOUBLE')})")
    return f"""kinds AS (SELECT * FROM (VALUES {rows}) k(patch_id, angle, {', '.join(f'p{k}' for k, _ in masks.HARMONICS)})),
spots AS (SELECT k.*, ty, tx, cos(radians(angle)) * (tx - 4) - sin(radians(angle)) * (ty - 4) + 4 AS fx, sin(radians(angle)) * (tx - 4) + cos(radians(angle)) * (ty - 4) + 4 AS fy,
  (ty - 3.5::DOUBLE) / 4 AS ny, (tx - 3.5::DOUBLE) / 4 AS nx FROM kinds k, range(8) a(ty), range(8) b(tx)),
depths AS (SELECT *, {depth} AS depth FROM spots), covers AS (SELECT *, {clip(f'depth / {falloff}::DOUBLE')} AS c FROM depths),
masks AS (SELECT *, c * c * (3 - 2 * c) * pow(depth, 8 * (1 - {falloff}::DOUBLE) + 0.5::DOUBLE * {falloff}::DOUBLE) AS alpha, floor(fx)::BIGINT AS ix, floor(fy)::BIGINT AS iy FROM covers),
marks AS (SELECT patch_id, ty, tx, alpha, ((iy + j) % 14 + 14) % 14 AS my, ((ix + i) % 14 + 14) % 14 AS mx,
  CASE j WHEN 1 THEN fy - iy ELSE 1 - (fy - iy) END * CASE i WHEN 1 THEN fx - ix ELSE 1 - (fx - ix) END AS k FROM masks, range(2) a(i), range(2) b(j)),
{name} AS MATERIALIZED (SELECT s.raster_id, s.band, patch_id, ty AS py, tx AS px, any_value(alpha) AS alpha, sum(s.v * k) AS v FROM marks
  JOIN {of} s ON s.y = CASE WHEN my < 8 THEN my ELSE 14 - my END AND s.x = CASE WHEN mx < 8 THEN mx ELSE 14 - mx END GROUP BY s.raster_id, s.band, patch_id, ty, tx)"""


@query("small AS MATERIALIZED (SELECT raster_id, band, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM cells GROUP BY ALL),\n" + _bank("small", 1, 0.5, 0.3, 0.4, 4, "bank")
       + ",\n" + _PLACED.replace("spots AS", "places AS").replace("FROM spots", "FROM places").replace("md5('3:'", "md5('1:'").replace("* 2)", "* 4)") + """,
laid AS (SELECT p.raster_id, band, (top + py + 64) % 16 AS y, (p.left + px + 64) % 16 AS x, sum(v * alpha) AS total, sum(alpha) AS weight FROM placed p JOIN bank USING (raster_id, patch_id) WHERE alpha > 1e-7::DOUBLE GROUP BY ALL),
result AS (SELECT c.raster_id, h, w, c.band, c.y, c.x, least(greatest(CASE WHEN weight > 1e-9::DOUBLE THEN total / weight ELSE v END, 0), 255) AS v FROM cells c LEFT JOIN laid USING (raster_id, band, y, x))""")  # fmt: skip
def splat_synthesis(spark, sf):
    """Every supplier raster made of turned patches of itself."""
    return scanlines.to_cells(splat.synthesize_lines(saved(lineitem_lines(spark, sf)), scale=0.5, rand_rot=0.5, wobble=0.3, falloff=0.4, seed=1, count=4))


@query(_bank("cells", 1, 0.5, 0.3, 0.4, 4, "bank") + ",\nresult AS (SELECT raster_id, 8 AS h, 8 AS w, patch_id AS band, py AS y, px AS x, v * alpha AS v FROM bank)", source="embedding")
def patch_bank(spark, sf):
    """Four turned patches of every vector's raster with their masks."""
    bank = splat.patch_bank(embedding_cells(spark, sf), 1.0, 0.0, 0.5, 0.3, 0.4, 1, 4)
    return bank.select("raster_id", F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("patch_id").alias("band"), F.col("py").alias("y"), F.col("px").alias("x"), (F.col("v") * F.col("alpha")).alias("v"))


@query()
def splat_quality(spark, sf):
    """Seams, contrast and gaps of the synthesis: one row per raster."""
    lines = saved(lineitem_lines(spark, sf))
    out = saved(splat.synthesize_lines(lines, scale=0.5, wobble=0.2, falloff=0.4, seed=1, count=2))
    weights = scanlines.to_cells(out.where("band = 0").withColumn("data", F.col("weight")))
    report = quality.quality_report_lines(out.select(*scanlines.LINE), lines).join(quality.coverage(weights), "raster_id")
    return report.select("raster_id", F.lit(16).alias("h"), F.lit(16).alias("w"), F.lit(0).alias("band"), F.col("uncovered").cast("int").alias("y"), F.lit(0).alias("x"), F.col("retention").alias("v"))


@query("""methods AS (SELECT DISTINCT raster_id, CASE raster_id % 3 WHEN 0 THEN 'mirror' ELSE 'none' END AS method FROM cells),
result AS (SELECT c.raster_id, CASE m.method WHEN 'mirror' THEN 32 ELSE 16 END AS h, CASE m.method WHEN 'mirror' THEN 32 ELSE 16 END AS w, band, CASE fy WHEN 0 THEN y ELSE 31 - y END AS y, CASE fx WHEN 0 THEN x ELSE 31 - x END AS x, v
  FROM cells c JOIN methods m USING (raster_id), range(2) a(fy), range(2) b(fx) WHERE m.method = 'mirror' OR (fy = 0 AND fx = 0))""")
def seamless_job(spark, sf):
    """Each raster by its own method: mirrored or left."""
    cells = lineitem_cells(spark, sf)
    chosen = rasters(cells).select("raster_id", F.when(F.col("raster_id") % 3 == 0, "mirror").otherwise("none").alias("method"))
    return jobs.seamless(cells, chosen)


@query("shifted AS (SELECT raster_id, h, w, band, (y + 8) % 16 AS y, (x + 8) % 16 AS x, v FROM cells),\n" + crossfaded("shifted", 16, 1) + ",\n" + overlapped(16, 3, 0.1, name="lapped") + """,
result AS (SELECT * FROM lapped WHERE raster_id % 4 = 0
  UNION ALL SELECT raster_id, h, w, band, (y + 8) % 16, (x + 8) % 16, v FROM crossed WHERE raster_id % 4 = 1
  UNION ALL SELECT raster_id, 32, 32, band, CASE fy WHEN 0 THEN y ELSE 31 - y END, CASE fx WHEN 0 THEN x ELSE 31 - x END, v FROM cells, range(2) a(fy), range(2) b(fx) WHERE raster_id % 4 = 2
  UNION ALL SELECT raster_id, h, w, band, y, x, v FROM cells WHERE raster_id % 4 = 3)""")
def seamless_job_all(spark, sf):
    """Each raster by the method of its row, strengths as usual: overlap, crossfade, mirror or none."""
    cells = lineitem_cells(spark, sf)
    names = F.array(*[F.lit(m) for m in ("overlap", "offset_crossfade", "mirror", "none")])
    return jobs.seamless(cells, rasters(cells).select("raster_id", F.element_at(names, (F.col("raster_id") % 4 + 1).cast("int")).alias("method")))


@query(overlapped(16, 4, 0.5, "(SELECT * FROM cells WHERE raster_id % 2 = 0)", "result"))
def seamless_job_limits(spark, sf):
    """Jobs with parameters of their own and no method; those that ask for a mirror are rejected by size."""
    cells = lineitem_cells(spark, sf)
    method = F.when(F.col("raster_id") % 2 == 1, "mirror")
    asked = rasters(cells).select("raster_id", method.alias("method"), F.lit(0.25).alias("overlap_x"), F.lit(0.25).alias("overlap_y"), F.lit(0.5).alias("edge_falloff"))
    return jobs.seamless(cells, asked, limits={"low": 16, "mirror": 8})


@query("""parts AS MATERIALIZED (SELECT raster_id * 4 + cy * 2 + cx AS raster_id, 10 AS h, 10 AS w, band, y - 6 * cy AS y, x - 6 * cx AS x, v FROM cells, range(2) a(cy), range(2) b(cx)
  WHERE y BETWEEN 6 * cy AND 6 * cy + 9 AND x BETWEEN 6 * cx AND 6 * cx + 9),\n""" + overlapped(10, 2, 0.5, "parts", "laid") + """,
placed AS MATERIALIZED (SELECT raster_id // 4 AS raster_id, raster_id % 4 AS step, band, y + 6 * (raster_id // 2 % 2) AS y, x + 6 * (raster_id % 2) AS x, v FROM laid
  WHERE NOT (raster_id // 2 % 2 = 1 AND y = 0) AND NOT (raster_id % 2 = 1 AND x = 0)),
result AS (SELECT c.raster_id, c.h, c.w, c.band, c.y, c.x, coalesce(arg_max(p.v, p.step), any_value(c.v)) AS v
  FROM cells c LEFT JOIN placed p ON p.raster_id = c.raster_id AND p.band = c.band AND p.y = c.y AND p.x = c.x GROUP BY c.raster_id, c.h, c.w, c.band, c.y, c.x)""")
def chunked_job(spark, sf):
    """Overlap synthesis by chunks of 8 cells, merged."""
    return scanlines.to_cells(jobs.chunked_overlap_lines(saved(lineitem_lines(spark, sf)), 8, 2, 0.25, 0.5))


@query("""known AS MATERIALIZED (SELECT * FROM cells WHERE NOT (x BETWEEN 6 AND 9 OR y BETWEEN 6 AND 9)),
gaps AS MATERIALIZED (SELECT * FROM cells WHERE x BETWEEN 6 AND 9 OR y BETWEEN 6 AND 9),
fill AS MATERIALIZED (SELECT t.raster_id, t.band, t.y, t.x, sum(k.v / ((t.y - k.y) * (t.y - k.y) + (t.x - k.x) * (t.x - k.x))::DOUBLE) / sum(1 / ((t.y - k.y) * (t.y - k.y) + (t.x - k.x) * (t.x - k.x))::DOUBLE) AS f
  FROM gaps t JOIN known k ON k.raster_id = t.raster_id AND k.band = t.band AND (t.y - k.y) * (t.y - k.y) + (t.x - k.x) * (t.x - k.x) BETWEEN 1 AND 9 GROUP BY ALL),
result AS (SELECT c.raster_id, h, w, c.band, c.y, c.x, CASE WHEN c.x BETWEEN 6 AND 9 OR c.y BETWEEN 6 AND 9 THEN coalesce(f, v) ELSE v END AS v FROM cells c LEFT JOIN fill USING (raster_id, band, y, x))""")
def seam_fill(spark, sf):
    """The centre cross filled from around it."""
    return jobs.seam_fill(lineitem_cells(spark, sf), 4, 3)


def _round(known: str) -> str:
    """Cells of the query below that are not known yet, from known ones at a distance of 3 or less."""
    square = "((t.y - k.y) * (t.y - k.y) + (t.x - k.x) * (t.x - k.x))"
    return f"""SELECT t.raster_id, t.h, t.w, t.band, t.y, t.x, sum(k.v / {square}::DOUBLE) / sum(1 / {square}::DOUBLE) AS v
  FROM (SELECT * FROM cells ANTI JOIN {known} USING (raster_id, band, y, x)) t JOIN {known} k ON k.raster_id = t.raster_id AND k.band = t.band AND {square} BETWEEN 1 AND 9 GROUP BY ALL"""


@query(f"""known AS (SELECT raster_id, h, w, band, y, x, v FROM cells WHERE NOT (x BETWEEN 4 AND 11 OR y BETWEEN 4 AND 11)),
first AS (SELECT * FROM known UNION ALL {_round("known")}),
result AS (SELECT * FROM first UNION ALL {_round("first")})""")
def seam_fill_wide(spark, sf):
    """A centre cross of 8 cells, filled from around it in rounds of radius 3."""
    return jobs.seam_fill(lineitem_cells(spark, sf), 8, 3)


_CUBIC = "CASE WHEN d <= 1 THEN (1.25::DOUBLE * d - 2.25::DOUBLE) * d * d + 1 WHEN d < 2 THEN ((-0.75::DOUBLE * d + 3.75::DOUBLE) * d - 6) * d + 3 ELSE 0 END"


def _scaled(f: int, masked: str) -> str:
    """Cells shrunk by f, the masked ones filled from within 3, and enlarged back, bicubic with the border repeated."""
    n, square = 16 // f, "((t.y - k.y) * (t.y - k.y) + (t.x - k.x) * (t.x - k.x))"
    gap = lambda t: f"({t}.y {masked} OR {t}.x {masked})"
    return f"""small{f} AS MATERIALIZED (SELECT raster_id, band, y // {f} AS y, x // {f} AS x, avg(v) AS v FROM cells GROUP BY ALL),
filled{f} AS MATERIALIZED (SELECT raster_id, band, y, x, v FROM small{f} t WHERE NOT {gap('t')} UNION ALL
  SELECT t.raster_id, t.band, t.y, t.x, sum(k.v / {square}::DOUBLE) / sum(1 / {square}::DOUBLE) FROM small{f} t JOIN small{f} k ON k.raster_id = t.raster_id AND k.band = t.band AND {square} BETWEEN 1 AND 9
  WHERE {gap('t')} AND NOT {gap('k')} GROUP BY ALL),
taps{f} AS (SELECT t, s, sum({_CUBIC}) AS k FROM (SELECT t, least(greatest(u, 0), {n - 1}) AS s, abs((t + 0.5::DOUBLE) / {f} - 0.5::DOUBLE - u) AS d
  FROM (SELECT t, floor((t + 0.5::DOUBLE) / {f} - 0.5::DOUBLE)::BIGINT + o AS u FROM range(16) a(t), range(-1, 3) b(o))) GROUP BY ALL),
up{f} AS MATERIALIZED (SELECT raster_id, band, a.t AS y, b.t AS x, sum(v * a.k * b.k) AS v FROM filled{f} JOIN taps{f} a ON a.s = y JOIN taps{f} b ON b.s = x GROUP BY raster_id, band, a.t, b.t)"""


@query(",\n".join([_scaled(1, "BETWEEN 6 AND 9"), _scaled(2, "BETWEEN 3 AND 4"), _scaled(4, "= 2")]) + """,
result AS (SELECT c.raster_id, c.h, c.w, c.band, c.y, c.x, ((c.v * 0.7::DOUBLE + a.v * 0.3::DOUBLE) * 0.85::DOUBLE + b.v * 0.15::DOUBLE) * 0.925::DOUBLE + d.v * 0.075::DOUBLE AS v
  FROM cells c JOIN up1 a USING (raster_id, band, y, x) JOIN up2 b USING (raster_id, band, y, x) JOIN up4 d USING (raster_id, band, y, x))""")
def multi_scale_fill(spark, sf):
    """The centre cross filled at three scales and mixed."""
    return jobs.multi_scale_fill(lineitem_cells(spark, sf), 4, 3)


def _light(detail: float) -> str:
    """Light removal of strength a half: kernels of 45, 15 and 7 taps follow from an edge of 8."""
    blurs = [blur("far", "cells", stencil.gaussian_kernel(45, 15.0), 8, "reflect"), blur("mid", "cells", stencil.gaussian_kernel(15, 5.0), 8, "reflect"), blur("fine", "cells", stencil.gaussian_kernel(7, 2.0), 8, "reflect")]
    lit = f"c.v / {clip('a.v * 0.6::DOUBLE + b.v * 0.4::DOUBLE', '1', '255')} * m.m" + (f" + (c.v - f.v) * (1 + {detail}::DOUBLE * 0.5::DOUBLE) * 0.5::DOUBLE" if detail else "")
    mean = "means AS (SELECT raster_id, band, greatest(avg(v), 1) AS m FROM cells GROUP BY ALL)"
    joined = "cells c JOIN far a USING (raster_id, band, y, x) JOIN mid b USING (raster_id, band, y, x) JOIN fine f USING (raster_id, band, y, x) JOIN means m USING (raster_id, band)"
    return ",\n".join([*blurs, mean, f"result AS (SELECT c.raster_id, c.h, c.w, c.band, c.y, c.x, {clip(f'c.v * 0.5::DOUBLE + ({lit}) * 0.5::DOUBLE', high='255')} AS v FROM {joined})"])


@query(_light(0.0), source="embedding")
def delight_light(spark, sf):
    """Low frequencies divided out of every vector's raster."""
    return stencil.remove_light(embedding_cells(spark, sf), 0.5, detail=0.0)


@query(_light(0.75), source="embedding")
def delight_detail(spark, sf):
    """The same with detail put back."""
    return stencil.remove_light(embedding_cells(spark, sf), 0.5, detail=0.75)


@query()
def export_package_job(spark, sf):
    """Maps of every vector's raster at twice the size, at export depth."""
    return jobs.export_lines(embedding_lines(spark, sf), 16)

