"""Neighbourhood operators, light removal and pyramids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..fixtures import embedding_cells, embedding_lines, lineitem_cells, lineitem_lines
from ..functions import color
from ..operators import masks, pyramid, scanlines, stencil
from ..plans import jobs
from .seams import clip
from .tone import _lab, _WIDE


def _index(axis: str, shift: str, n: int, border: str) -> str:
    u = f"({axis} + {shift})"
    return {
        "wrap": f"(({u} + {4 * n}) % {n})", "replicate": f"least(greatest({u}, 0), {n - 1})",
        "reflect": f"(CASE WHEN ({u} + {4 * (n - 1)}) % {2 * n - 2} < {n} THEN ({u} + {4 * (n - 1)}) % {2 * n - 2} ELSE {2 * n - 2} - ({u} + {4 * (n - 1)}) % {2 * n - 2} END)",
    }[border]


def gather(name: str, of: str, taps, columns: list[str], n: int, border: str) -> str:
    """A common table with the correlated columns, found from each target's side."""
    values = ", ".join(f"({dy}, {dx}, {', '.join(f'{k!r}::DOUBLE' for k in ks)})" for dy, dx, ks in taps)
    sums = ", ".join(f"sum(s.v * k.{c}) AS {c}" for c in columns)
    return f"""{name} AS (SELECT t.raster_id, t.h, t.w, t.band, t.y, t.x, any_value(t.v) AS v, {sums} FROM {of} t CROSS JOIN (VALUES {values}) k(dy, dx, {', '.join(columns)})
  JOIN {of} s ON s.raster_id = t.raster_id AND s.band = t.band AND s.y = {_index('t.y', 'k.dy', n, border)} AND s.x = {_index('t.x', 'k.dx', n, border)} GROUP BY t.raster_id, t.h, t.w, t.band, t.y, t.x)"""


def blur(name: str, of: str, kernel: list[float], n: int, border: str) -> str:
    far = len(kernel) // 2
    down = gather(f"{name}_down", of, [(i - far, 0, [k]) for i, k in enumerate(kernel)], ["s"], n, border)
    mid = f"{name}_mid AS (SELECT raster_id, h, w, band, y, x, s AS v FROM {name}_down)"
    across = gather(f"{name}_across", f"{name}_mid", [(0, i - far, [k]) for i, k in enumerate(kernel)], ["s"], n, border)
    return f"{down},\n{mid},\n{across},\n{name} AS (SELECT raster_id, h, w, band, y, x, s AS v FROM {name}_across)"


_UNIT = "unit AS (SELECT raster_id, h, w, band, y, x, v / 256 AS v FROM cells)"


def _unit(spark, sf):
    return embedding_cells(spark, sf).withColumn("v", F.col("v") / 256)


def _packed(exprs: list[str], of: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(exprs))
    return f"result AS (SELECT raster_id, h, w, n AS band, y, x, CASE n {cases} END AS v FROM {of}, range({len(exprs)}) k(n))"


@query("""s AS (SELECT *, (coalesce(lead(v) OVER px, first_value(v) OVER px) - coalesce(lag(v) OVER px, last_value(v) OVER (PARTITION BY raster_id, band, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) * 0.5::DOUBLE AS du,
  (coalesce(lead(v) OVER py, first_value(v) OVER py) - coalesce(lag(v) OVER py, last_value(v) OVER (PARTITION BY raster_id, band, x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) * 0.5::DOUBLE AS dv
  FROM cells WINDOW px AS (PARTITION BY raster_id, band, y ORDER BY x), py AS (PARTITION BY raster_id, band, x ORDER BY y))
SELECT raster_id, band::INTEGER AS band, y::INTEGER AS y, x::INTEGER AS x, du, dv FROM s""", cells=False)
def four_sample_slopes(spark, sf):
    """Derivatives by neighbours, wrapped."""
    field = scanlines.correlate(lineitem_lines(spark, sf), [(stencil.NEIGHBOURS, ["du", "dv"])])
    return scanlines.split_cells(field, ["du", "dv"]).select("raster_id", "band", "y", "x", "du", "dv")


@query(_packed([f"CASE WHEN abs(x - 8) <= {r} AND abs(y - 8) <= {r} AND x <> 8 THEN sign(x - 8) * ({2 * r + 1} - abs(x - 8) - abs(y - 8)) / {sum(abs(t[2][0]) for t in stencil.derivative_taps(f'sobel_{2 * r + 1}x{2 * r + 1}', normalize=False))}::DOUBLE ELSE 0 END" for r in (1, 2, 3, 4)], "(SELECT * FROM cells WHERE band = 0)"))
def kernel_build(spark, sf):
    """Response of each raster's grid to an impulse at its centre, turned over: the four kernels as bands."""
    # an impulse where the middle of the middle line is, on lines of one band
    lines = lineitem_lines(spark, sf).where("band = 0")
    impulse = lines.withColumn("data", F.transform("data", lambda v, i: F.when((F.col("y") == 8) & (i == 8), 1.0).otherwise(0.0)))
    kernels, taps = [f"k{n}" for n in (3, 5, 7, 9)], {}
    for i, n in enumerate((3, 5, 7, 9)):
        for dy, dx, (across, _) in stencil.derivative_taps(f"sobel_{n}x{n}"):
            taps.setdefault((dy, dx), [0.0] * 4)[i] = across
    out = scanlines.split_cells(scanlines.correlate(impulse, [([(*at, ks) for at, ks in taps.items()], kernels)], "replicate"), kernels)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), (-F.col(k)).alias("v")) for i, k in enumerate(kernels)]))
    return out.select("raster_id", "h", "w", "y", "x", each.alias("one")).select("raster_id", "h", "w", "one.band", "y", "x", "one.v")


_TAPS9 = stencil.derivative_taps("blended_sobel")


@query(gather("s", "cells", _TAPS9, ["du", "dv"], 8, "wrap") + ",\n" + _packed(["du * 8", "dv * 8"], "s"), source="embedding")
def convolve_slopes(spark, sf):
    """Blended 9 by 9 derivatives as two bands, on blocks of lines."""
    field = scanlines.split_cells(scanlines.correlate(embedding_lines(spark, sf), [(_TAPS9, ["du", "dv"])]), ["du", "dv"])
    both = F.explode(F.array(F.struct(F.lit(0).alias("band"), (F.col("du") * 8).alias("v")), F.struct(F.lit(1).alias("band"), (F.col("dv") * 8).alias("v"))))
    return field.select("raster_id", "h", "w", "y", "x", both.alias("s")).select("raster_id", "h", "w", "s.band", "y", "x", "s.v")


@query(blur("soft", "cells", stencil.gaussian_kernel(5, 1.2), 8, "reflect") + ",\nresult AS (SELECT * FROM soft)", source="embedding")
def gaussian_blur(spark, sf):
    """Blurred with 5 taps, reflected at the border."""
    return scanlines.to_cells(stencil.blurred_lines(embedding_lines(spark, sf), 5, 1.2))


@query("""result AS (SELECT t.raster_id, t.h, t.w, t.band, t.y, t.x, max(s.v) AS v FROM cells t JOIN cells s ON s.raster_id = t.raster_id AND s.band = t.band
  AND s.y BETWEEN t.y - 2 AND t.y + 1 AND s.x BETWEEN t.x - 2 AND t.x + 1 GROUP BY t.raster_id, t.h, t.w, t.band, t.y, t.x)""", source="embedding")
def dilate(spark, sf):
    """Largest of 4 by 4."""
    return stencil.dilate(embedding_cells(spark, sf), 4)


_TAPS3 = stencil.derivative_taps("sobel_3x3", normalize=False)


@query(_WIDE + ",\ngrays AS (SELECT raster_id, h, w, 0 AS band, y, x, b * 0.114::DOUBLE + g * 0.587::DOUBLE + r * 0.299::DOUBLE AS v FROM wide),\n" + gather("s", "grays", _TAPS3, ["gx", "gy"], 16, "reflect") + """,
hard AS (SELECT *, CASE WHEN sqrt(gx * gx + gy * gy) > 400.123::DOUBLE THEN 255 ELSE 0 END AS m FROM s),
result AS (SELECT t.raster_id, t.h, t.w, t.band, t.y, t.x, max(n.m) AS v FROM hard t JOIN hard n ON n.raster_id = t.raster_id AND n.y BETWEEN t.y - 1 AND t.y + 1 AND n.x BETWEEN t.x - 1 AND t.x + 1 GROUP BY ALL)""")
def seam_detect(spark, sf):
    """Steep places and their neighbours."""
    return stencil.seam_detect(lineitem_cells(spark, sf), 400.123, 3)


_RAW9 = stencil.derivative_taps("blended_sobel", normalize=False)
_SIZE = "sqrt(gx * gx + gy * gy + 1)"


@query(_UNIT + ",\n" + gather("f", "unit", _RAW9, ["gx0", "gy0"], 8, "wrap") + ",\ng AS (SELECT *, gx0 * 0.25::DOUBLE AS gx, gy0 * 0.25::DOUBLE AS gy FROM f),\n"
       + _packed([f"1 / {_SIZE} * 0.5::DOUBLE + 0.5::DOUBLE", f"-gy / {_SIZE} * 0.5::DOUBLE + 0.5::DOUBLE", f"-gx / {_SIZE} * 0.5::DOUBLE + 0.5::DOUBLE", f"sqrt(gx * gx + gy * gy) / {_SIZE}"], "g"), source="embedding")
def gradient_normals(spark, sf):
    """Normals and steepness by the plain 9 by 9 kernel."""
    return stencil.gradient_normals(_unit(spark, sf), strength=0.25)


def _normal(field: str, gx: str, gy: str) -> str:
    size = f"sqrt(({gx}) * ({gx}) + ({gy}) * ({gy}) + 0.0625::DOUBLE)"
    return _packed([f"floor({clip(f'({n} * 0.5::DOUBLE + 0.5::DOUBLE + 1e-9::DOUBLE) * 65535', high='65535')})" for n in (f"(0.25::DOUBLE / {size})", f"(-({gy}) / {size})", f"(-({gx}) / {size})")], field)


@query(_UNIT + ",\n" + gather("f", "unit", [(0, -1, [-0.5, 0.0]), (0, 1, [0.5, 0.0]), (-1, 0, [0.0, -0.5]), (1, 0, [0.0, 0.5])], ["du", "dv"], 8, "wrap") + ",\n" + _normal("f", "du * 4.266::DOUBLE", "dv * -4.266::DOUBLE"), source="embedding")
def normal_map(spark, sf):
    """16-bit normals by neighbours, Y downwards."""
    return stencil.normal_map(_unit(spark, sf), directx=True)


_SETS = [stencil.derivative_taps(f"sobel_{n}x{n}") for n in (3, 5, 7)]


def _displacement(of: str, name: str) -> str:
    at = [{(t[0], t[1]): t[2] for t in s} for s in _SETS]
    taps = [(dy, dx, [k * 8 for s in at for k in s.get((dy, dx), [0.0, 0.0])]) for dy in range(-3, 4) for dx in range(-3, 4)]
    size = lambda n: f"sqrt(u{n} * u{n} + v{n} * v{n})"
    detail = clip(f"({size(3)} * 0.5::DOUBLE + {size(5)} * 0.35::DOUBLE + {size(7)} * 0.15::DOUBLE) * 1.5::DOUBLE")
    return gather(f"{name}_f", of, taps, ["u3", "v3", "u5", "v5", "u7", "v7"], 8, "wrap") + f",\n{name} AS (SELECT raster_id, h, w, band, y, x, {clip(f'(v * 0.7::DOUBLE + {detail} * 0.3::DOUBLE) * (0.5::DOUBLE * 2)')} AS v FROM {name}_f)"


@query(_UNIT + ",\n" + _displacement("unit", "disp") + ",\nresult AS (SELECT * FROM disp)", source="embedding")
def displacement_map(spark, sf):
    """Height with gradient detail, not smoothed."""
    return stencil.displacement_map(_unit(spark, sf), smooth=0.0)


def _ao(of: str, name: str, radius: int, strength: float, normal: str | None = None) -> str:
    scales = (max(1, radius // 4), max(1, radius // 2), radius)
    parts = [blur(f"{name}_b{i}", of, stencil.gaussian_kernel(s | 1), 8, "wrap") for i, s in enumerate(scales)]
    deep = "(" + " + ".join(f"{clip(f'b{i}.v - h.v')} * {w}::DOUBLE" for i, w in enumerate((0.5, 0.3, 0.2))) + f") * ({strength}::DOUBLE * 8)"
    joins = " ".join(f"JOIN {name}_b{i} b{i} ON b{i}.raster_id = h.raster_id AND b{i}.y = h.y AND b{i}.x = h.x" for i in range(3))
    if normal:
        joins += f" JOIN {normal} nm ON nm.raster_id = h.raster_id AND nm.y = h.y AND nm.x = h.x AND nm.band = 0"
        deep = f"{deep} + {clip('1 - (nm.v / 65535 * 2 - 1)')} * ({deep}) * {strength}::DOUBLE * 0.5::DOUBLE"
    return ",\n".join(parts) + f",\n{name} AS (SELECT h.raster_id, h.h, h.w, 0 AS band, h.y, h.x, 1 - {clip(deep)} AS v FROM {of} h {joins})"


@query(_UNIT + ",\n" + _ao("unit", "ao", 12, 0.5) + ",\nresult AS (SELECT * FROM ao)", source="embedding")
def ao_map(spark, sf):
    """Occlusion by three wrapped blurs."""
    return stencil.ao_map(_unit(spark, sf), radius=12, strength=0.5)


@query("""known AS (SELECT * FROM cells WHERE NOT (x IN (3, 4) OR y IN (3, 4))),
fill AS (SELECT t.raster_id, t.band, t.y, t.x, sum(k.v / ((t.y - k.y) * (t.y - k.y) + (t.x - k.x) * (t.x - k.x))::DOUBLE) / sum(1 / ((t.y - k.y) * (t.y - k.y) + (t.x - k.x) * (t.x - k.x))::DOUBLE) AS f
  FROM cells t JOIN known k ON k.raster_id = t.raster_id AND k.band = t.band AND (t.y - k.y) * (t.y - k.y) + (t.x - k.x) * (t.x - k.x) BETWEEN 1 AND 9 GROUP BY ALL),
result AS (SELECT c.raster_id, h, w, c.band, c.y, c.x, CASE WHEN c.x IN (3, 4) OR c.y IN (3, 4) THEN coalesce(f, v) ELSE v END AS v FROM cells c LEFT JOIN fill USING (raster_id, band, y, x))""", source="embedding")
def gap_fill(spark, sf):
    """The centre cross filled from around it."""
    cells = embedding_cells(spark, sf)
    return stencil.gap_fill(cells, masks.over(cells, masks.seam(2)), 3)


@query("unit255 AS (SELECT raster_id, h, w, band, y, x, v / 255 AS v FROM cells),\n" + gather("f", "unit255", _TAPS3, ["gx", "gy"], 8, "reflect") + ",\n"
       + _packed([f"{n} / sqrt((gx * -1.7::DOUBLE) * (gx * -1.7::DOUBLE) + (gy * 1.7::DOUBLE) * (gy * 1.7::DOUBLE) + 1)" for n in ("(gx * -1.7::DOUBLE)", "(gy * 1.7::DOUBLE)", "1")], "f"), source="embedding")
def height_tangent(spark, sf):
    """Normals of the height by plain derivatives."""
    return stencil.height_tangent(embedding_cells(spark, sf))


@query(blur("soft", "cells", stencil.gaussian_kernel(9, 3.0), 8, "reflect") + f",\nresult AS (SELECT c.raster_id, c.h, c.w, c.band, c.y, c.x, {clip('c.v + ' + clip('(s.v - c.v) / 60') + ' * (0.6::DOUBLE * 35)', high='255')} AS v FROM cells c JOIN soft s USING (raster_id, band, y, x))", source="embedding")
def remove_ao(spark, sf):
    """Crevices lifted."""
    return stencil.remove_ao(embedding_cells(spark, sf), 0.6)


@query(blur("soft", "cells", stencil.gaussian_kernel(0, 1.5), 8, "reflect") + ",\nresult AS (SELECT c.raster_id, c.h, c.w, c.band, c.y, c.x, c.v * (1 - 0.5::DOUBLE * 0.3::DOUBLE) + s.v * (0.5::DOUBLE * 0.3::DOUBLE) AS v FROM cells c JOIN soft s USING (raster_id, band, y, x))", source="embedding")
def edge_consistency(spark, sf):
    """Mixed with a blur whose size follows from sigma."""
    return stencil.edge_consistency(embedding_cells(spark, sf), 0.5)


def _plane(name: str, of: str, v: str, joins: str = "") -> str:
    """A step of light removal on cells c of a plane."""
    return f"{name} AS (SELECT c.raster_id, c.h, c.w, c.band, c.y, c.x, {v} AS v FROM {of} c {joins})"


def folded(name: str, of: str, kernel: list[float], n: int) -> str:
    """``blur``, reflected, by the weights that a kernel gives each pair of places: no more rows than n for each target."""
    taps = ", ".join(f"({i - len(kernel) // 2}, {k!r}::DOUBLE)" for i, k in enumerate(kernel))
    turns = 4 * (n - 1) * (1 + len(kernel) // n)
    place = f"(CASE WHEN (t + d + {turns}) % {2 * n - 2} < {n} THEN (t + d + {turns}) % {2 * n - 2} ELSE {2 * n - 2} - (t + d + {turns}) % {2 * n - 2} END)"
    return f"""{name}_k AS (SELECT t, {place} AS s, sum(k) AS k FROM range({n}) r(t), (VALUES {taps}) v(d, k) GROUP BY ALL),
{name}_down AS (SELECT c.raster_id, c.h, c.w, c.band, k.t AS y, c.x, sum(c.v * k.k) AS v FROM {of} c JOIN {name}_k k ON k.s = c.y GROUP BY ALL),
{name} AS (SELECT c.raster_id, c.h, c.w, c.band, c.y, k.t AS x, sum(c.v * k.k) AS v FROM {name}_down c JOIN {name}_k k ON k.s = c.x GROUP BY ALL)"""


def _delight(strength: float, flatness: float, shadow: float, highlight: float, contrast: float, ao: float, edges: float) -> str:
    """All steps in order, for edges of 16: kernels of 45, 15, 7 and 9 taps follow from that."""
    kernel, at = stencil.gaussian_kernel, "USING (raster_id, band, y, x)"
    mean = lambda name, of, least="": f"{name} AS (SELECT raster_id, band, {'greatest(avg(v), 1)' if least else 'avg(v)'} AS m FROM {of} GROUP BY ALL)"
    lit = f"c.v / {clip('a.v * 0.6::DOUBLE + b.v * 0.4::DOUBLE', '1', '255')} * m.m + (c.v - f.v) * (1 + 0.75::DOUBLE * 0.5::DOUBLE) * {strength!r}::DOUBLE"
    lab = ["(116 * fq - 16) * 255 / 100", "500 * (fp - fq) + 128", "200 * (fq - fs) + 128"]
    cases = " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(lab))
    xyz = ", ".join(f"CASE WHEN {f} * {f} * {f} > 0.008856::DOUBLE THEN {f} * {f} * {f} ELSE ({f} - 16 / 116.0::DOUBLE) / 7.787::DOUBLE END * {w!r}::DOUBLE AS {n}" for f, w, n in zip(("fx", "fy", "fz"), color.WHITE, ("xx", "yy", "zz")))
    lights = ", ".join(f"{r[0]!r}::DOUBLE * xx + {r[1]!r}::DOUBLE * yy + {r[2]!r}::DOUBLE * zz AS {n}" for r, n in zip(color.RGB, ("r", "g", "b")))
    coded = lambda n: f"CASE WHEN {n} <= 0.0031308::DOUBLE THEN {n} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow({n}, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END * 255"
    whole = ", ".join(f"max(CASE WHEN band = {i} THEN floor({clip('v', high='255')}) END) AS {n}" for i, n in enumerate(("l", "a", "b")))
    steps = [
        _WIDE, _lab(), f"lab8 AS (SELECT raster_id, h, w, n AS band, y, x, round_even({clip(f'CASE n {cases} END', high='255')}, 0) AS v FROM lab, range(3) k(n))", "p0 AS (SELECT * FROM lab8 WHERE band = 0)",
        folded("far", "p0", kernel(45, 15.0), 16), folded("mid", "p0", kernel(15, 5.0), 16), folded("fine", "p0", kernel(7, 2.0), 16), mean("m0", "p0", "1"),
        _plane("p1", "p0", clip(f"c.v * (1 - {strength!r}::DOUBLE) + ({lit}) * {strength!r}::DOUBLE", high="255"), f"JOIN far a {at} JOIN mid b {at} JOIN fine f {at} JOIN m0 m USING (raster_id, band)"),
        _plane("p2", "p1", clip(f"c.v + {clip('1 - c.v / 80')} * {shadow * 40!r}::DOUBLE", high="255")), mean("m2", "p2"),
        _plane("p3", "p2", clip(f"c.v - {clip('(c.v - 180) / 75')} * (c.v - m.m) * {highlight * 0.6!r}::DOUBLE", high="255"), "JOIN m2 m USING (raster_id, band)"), folded("near", "p3", kernel(9, 3.0), 16),
        _plane("p4", "p3", clip(f"c.v + {clip('(s.v - c.v) / 60')} * {ao * 35!r}::DOUBLE", high="255"), f"JOIN near s {at}"), mean("m4", "p4"),
        _plane("p5", "p4", clip(f"m.m + (c.v - m.m) * {1 + contrast * 0.8!r}::DOUBLE", high="255"), "JOIN m4 m USING (raster_id, band)"), folded("soft", "p5", kernel(0, 0.5 + edges * 2), 16),
        _plane("p6", "p5", f"c.v * {1 - edges * 0.3!r}::DOUBLE + s.v * {edges * 0.3!r}::DOUBLE", f"JOIN soft s {at}"), mean("ml", "lab8"),
        f"parts AS (SELECT * FROM p6 UNION ALL SELECT c.raster_id, c.h, c.w, c.band, c.y, c.x, c.v * {1 - flatness!r}::DOUBLE + m.m * {flatness!r}::DOUBLE AS v FROM lab8 c JOIN ml m USING (raster_id, band) WHERE c.band > 0)",
        f"out8 AS (SELECT raster_id, h, w, y, x, {whole} FROM parts GROUP BY raster_id, h, w, y, x)",
        "fs AS (SELECT *, (l * 100 / 255 + 16) / 116 AS fy, (l * 100 / 255 + 16) / 116 + (a - 128) / 500 AS fx, (l * 100 / 255 + 16) / 116 - (b - 128) / 200 AS fz FROM out8)",
        f"whites AS (SELECT raster_id, h, w, y, x, {xyz} FROM fs)", f"lights AS (SELECT raster_id, h, w, y, x, {lights} FROM whites)",
        f"result AS (SELECT raster_id, h, w, n AS band, y, x, round_even({clip('CASE n WHEN 0 THEN ' + coded('b') + ' WHEN 1 THEN ' + coded('g') + ' ELSE ' + coded('r') + ' END', high='255')}, 0) AS v FROM lights, range(3) k(n))"]
    return ",\n".join(steps).replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


@query(_delight(0.5, 0.3, 0.2, 0.2, 0.2, 0.2, 0.2))
def delight(spark, sf):
    """All steps of light removal on every supplier raster."""
    return stencil.delight_lines(lineitem_lines(spark, sf), strength=0.5, flatness=0.3, shadow=0.2, highlight=0.2, contrast=0.2, ao=0.2, edges=0.2)


def _levels(edge: int, f: str) -> str:
    """All mip levels by recursion over rounded means of two by two."""
    return f"""levels AS (SELECT raster_id, band, 0 AS level, {edge} AS n, y, x, v FROM {f} UNION ALL
  SELECT raster_id, band, level + 1, n // 2, y // 2, x // 2, round_even(avg(v) OVER (PARTITION BY raster_id, band, level, y // 2, x // 2), 0) FROM levels WHERE n > 1),
mips AS (SELECT DISTINCT raster_id, band, level, n, y, x, v FROM levels)"""


@query(_levels(8, "cells") + "\nSELECT raster_id, band::INTEGER AS band, level::INTEGER AS level, n::INTEGER AS h, y::INTEGER AS y, x::INTEGER AS x, v FROM mips", source="embedding", cells=False)
def mip_scalar(spark, sf):
    """Levels 8, 4, 2 and 1."""
    lines = pyramid.mip_lines(embedding_lines(spark, sf), "height", 3)
    return lines.select("raster_id", "band", "level", "h", "y", F.posexplode("data").alias("x", "v"))


_LIN = "CASE WHEN v / 255 <= 0.04045::DOUBLE THEN v / 255 / 12.92::DOUBLE ELSE pow((v / 255 + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"


@query(f"""alphas AS (SELECT raster_id, y, x, (raster_id % 3 + y % 2) / 4.0::DOUBLE AS a FROM cells WHERE band = 0),
pre AS (SELECT c.raster_id, band, c.y, c.x, a, {_LIN} * a AS l FROM cells c JOIN alphas USING (raster_id, y, x)),
small AS (SELECT raster_id, band, y // 2 AS y, x // 2 AS x, avg(l) AS l, avg(a) AS a FROM pre GROUP BY ALL),
plain AS (SELECT *, {clip('l / greatest(a, 1e-6)')} AS u FROM small),
result AS (SELECT raster_id, 8 AS h, 8 AS w, band, y, x, round_even(CASE WHEN u <= 0.0031308::DOUBLE THEN u * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow(u, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END * 255, 0) AS v FROM plain
  UNION ALL SELECT raster_id, 8, 8, 3, y, x, round_even(a * 255, 0) FROM small WHERE band = 0)""")
def mip_color(spark, sf):
    """One level of colour with alpha."""
    cells = lineitem_cells(spark, sf)
    alpha = cells.where("band = 0").withColumns({"band": F.lit(3), "v": (F.col("raster_id") % 3 + F.col("y") % 2) / 4.0 * 255})
    return pyramid.mipmaps(cells.unionByName(alpha), "BaseColor", 1).where("level = 1")


@query(_WIDE + """,
slope AS (SELECT raster_id, y, x, (b / 127.5::DOUBLE - 1) / greatest((192 + r / 4) / 127.5::DOUBLE - 1, 1e-4) AS sx, (g / 127.5::DOUBLE - 1) / greatest((192 + r / 4) / 127.5::DOUBLE - 1, 1e-4) AS sy FROM wide),
small AS (SELECT raster_id, y // 2 AS y, x // 2 AS x, avg(sx) AS sx, avg(sy) AS sy, 8 AS h, 8 AS w FROM slope GROUP BY ALL),
""" + _packed([f"round_even({clip(f'{n} / sqrt(sx * sx + sy * sy + 1) * 127.5::DOUBLE + 127.5::DOUBLE', high='255')}, 0)" for n in ("sx", "sy", "1")] + ["255"], "small"))
def mip_normal(spark, sf):
    """One level of encoded normals."""
    cells = lineitem_cells(spark, sf)
    coded = cells.withColumn("v", F.when(F.col("band") == 2, 192 + F.col("v") / 4).otherwise(F.col("v")))
    return pyramid.mipmaps(coded.unionByName(cells.where("band = 0").withColumns({"band": F.lit(3), "v": F.lit(255.0)})), "Normal", 1).where("level = 1")


_ROUGH = clip(clip("0.5::DOUBLE + (v - 0.5::DOUBLE) * 1") + " * (0.5::DOUBLE * 2)")


@query((_UNIT + ",\n" + gather("f", "unit", [(0, -1, [-0.5, 0.0]), (0, 1, [0.5, 0.0]), (-1, 0, [0.0, -0.5]), (1, 0, [0.0, 0.5])], ["du", "dv"], 8, "wrap") + ",\n"
       + _normal("f", "du * 4.266::DOUBLE", "dv * 4.266::DOUBLE").replace("result AS", "normals AS") + ",\n" + _displacement("unit", "disp") + ",\n" + _ao("disp", "ao", 12, 0.5, "normals") + f""",
scalars AS (SELECT 'Roughness' AS map, raster_id, y, x, {_ROUGH} AS v FROM unit UNION ALL SELECT 'Displacement', raster_id, y, x, v FROM disp
  UNION ALL SELECT 'AO', raster_id, y, x, v FROM ao UNION ALL SELECT 'Opacity', raster_id, y, x, CASE WHEN v > 0 THEN 1 ELSE 0 END FROM unit)
SELECT map, raster_id, n::INTEGER AS band, y::INTEGER AS y, x::INTEGER AS x, floor({clip('(v + 1e-9::DOUBLE) * 255', high='255')}) AS v FROM scalars, range(3) k(n)
UNION ALL SELECT 'Normal', raster_id, band::INTEGER, y::INTEGER, x::INTEGER, v FROM normals""").replace(" AS (SELECT", " AS MATERIALIZED (SELECT"), source="embedding", cells=False)
def pbr_maps_job(spark, sf):
    """All five maps of every vector's raster, without smoothing."""
    return jobs.pbr_maps(_unit(spark, sf), smooth=0.0).select("map", "raster_id", "band", "y", "x", "v")

