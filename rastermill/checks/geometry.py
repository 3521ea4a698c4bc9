"""Coordinate algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..fixtures import embedding_cells, embedding_lines, lineitem_cells, table
from ..layout import rounded
from ..operators import geometry as g
from ..operators import scanlines


@query("result AS (SELECT * FROM cells)")
def rasterize(spark, sf):
    """Supplier rasters, dense, from order lines."""
    return lineitem_cells(spark, sf)


@query("result AS (SELECT raster_id, h, w, band, (y + h // 2) % h AS y, (x + w // 2) % w AS x, v FROM cells)")
def offset(spark, sf):
    """Shifted by half on both axes."""
    return g.offset(lineitem_cells(spark, sf))


@query("result AS (SELECT raster_id, h, w, band, (y - 4 + h) % h AS y, (x - 5 + w) % w AS x, v FROM cells)")
def reverse_offset(spark, sf):
    """Shifted back, by a quarter down and a third across (rounded down to whole cells)."""
    return g.offset(lineitem_cells(spark, sf), x=1 / 3, y=0.25, back=True)


@query("""result AS (SELECT raster_id, 2 * h AS h, 2 * w AS w, band, CASE fy WHEN 0 THEN y ELSE 2 * h - 1 - y END AS y,
  CASE fx WHEN 0 THEN x ELSE 2 * w - 1 - x END AS x, v FROM cells, range(2) a(fy), range(2) b(fx))""")
def mirror_tile(spark, sf):
    """Mirrored to twice the size."""
    return g.mirror_tile(lineitem_cells(spark, sf))


@query("""small AS (SELECT raster_id, band, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM cells GROUP BY ALL),
result AS (SELECT raster_id, 8 AS h, 8 AS w, band, y + 4 * i AS y, x + 4 * j AS x, v FROM small, range(2) a(i), range(2) b(j))""", source="embedding")
def tile_repeat(spark, sf):
    """Shrunk to half, then repeated two by two."""
    return g.tile_repeat(embedding_cells(spark, sf), n=2, max_edge=8)


@query("result AS (SELECT raster_id, 13 AS h, 12 AS w, band, y - 2 AS y, x AS x, v FROM cells WHERE y >= 2 AND y < 15 AND x < 12)")
def crop(spark, sf):
    """Two rows off the top, one off the bottom, four columns off the right."""
    return g.crop(lineitem_cells(spark, sf), top=2, bottom=1, right=4)


_AREA = """
ty AS (SELECT s, t, least(s + 1, (t + 1) * 16.0::DOUBLE / 7) - greatest(s, t * 16.0::DOUBLE / 7) AS k FROM range(16) a(s), range(7) b(t)),
result AS (SELECT raster_id, 7 AS h, 7 AS w, band, a.t AS y, b.t AS x, sum(v * a.k * b.k) / sum(a.k * b.k) AS v
  FROM cells JOIN ty a ON a.s = cells.y AND a.k > 1e-9 JOIN ty b ON b.s = cells.x AND b.k > 1e-9 GROUP BY raster_id, band, a.t, b.t)"""


@query(_AREA)
def resize_area(spark, sf):
    """16 to 7 cells on both axes, by area."""
    return g.resize_area(lineitem_cells(spark, sf), 7)


def _taps(n: int, m: int, reach: int, kernel: str, border: str) -> str:
    """Taps (t, s, k) of every target, found from the target's side."""
    place = {"clamp": f"least(greatest(u, 0), {n - 1})", "wrap": f"(u + {4 * n}) % {n}"}[border]
    return f"""
taps AS (SELECT t, {place} AS s, sum(k) AS k FROM (SELECT t, u, {kernel} AS k FROM (
  SELECT t, u, abs((t + 0.5::DOUBLE) * {n} / {m} - 0.5::DOUBLE - u) AS d FROM (
    SELECT t, floor((t + 0.5::DOUBLE) * {n} / {m} - 0.5::DOUBLE)::BIGINT + o AS u FROM range({m}) a(t), range({1 - reach}, {reach + 1}) b(o)))) GROUP BY ALL),
result AS (SELECT raster_id, {m} AS h, {m} AS w, band, a.t AS y, b.t AS x, sum(v * a.k * b.k) AS v
  FROM cells JOIN taps a ON a.s = cells.y JOIN taps b ON b.s = cells.x GROUP BY raster_id, band, a.t, b.t)"""


_CUBIC = "CASE WHEN d <= 1 THEN (1.25::DOUBLE * d - 2.25::DOUBLE) * d * d + 1 WHEN d < 2 THEN ((-0.75::DOUBLE * d + 3.75::DOUBLE) * d - 6) * d + 3 ELSE 0 END"


@query(_taps(8, 13, 1, "greatest(0, 1 - d)", "clamp"), source="embedding")
def resize_linear(spark, sf):
    """8 to 13 cells, bilinear."""
    return g.resize_linear(embedding_cells(spark, sf), 13)


@query(_taps(8, 11, 1, "greatest(0, 1 - d)", "wrap"), source="embedding")
def resize_wrapped(spark, sf):
    """8 to 11 cells, bilinear across the wrap."""
    return scanlines.to_cells(scanlines.resize_wrapped(embedding_lines(spark, sf), 11, 11))


@query(_taps(8, 16, 2, _CUBIC, "clamp"), source="embedding")
def resize_cubic(spark, sf):
    """8 to 16 cells, bicubic."""
    return g.resize_cubic(embedding_cells(spark, sf), 16)


@query("""result AS (SELECT raster_id, 11 AS h, 11 AS w, band, a.t AS y, b.t AS x, v FROM cells
  JOIN range(11) a(t) ON (a.t * 8) // 11 = y JOIN range(11) b(t) ON (b.t * 8) // 11 = x)""", source="embedding")
def resize_nearest(spark, sf):
    """8 to 11 cells, nearest."""
    return g.resize_nearest(embedding_cells(spark, sf), 11)


@query("""spot AS (SELECT t.*, floor(fx)::BIGINT AS ix, floor(fy)::BIGINT AS iy FROM (SELECT gy.y AS ty, gx.x AS tx,
    cos(radians(30::DOUBLE)) * (gx.x - 4) - sin(radians(30::DOUBLE)) * (gy.y - 4) + 4 AS fx, sin(radians(30::DOUBLE)) * (gx.x - 4) + cos(radians(30::DOUBLE)) * (gy.y - 4) + 4 AS fy
    FROM range(8) gy(y), range(8) gx(x)) t),
tap AS (SELECT ty, tx, ((iy + j) % 14 + 14) % 14 AS my, ((ix + i) % 14 + 14) % 14 AS mx,
  CASE j WHEN 1 THEN fy - iy ELSE 1 - (fy - iy) END * CASE i WHEN 1 THEN fx - ix ELSE 1 - (fx - ix) END AS k FROM spot, range(2) a(i), range(2) b(j)),
result AS (SELECT raster_id, h, w, band, ty AS y, tx AS x, sum(v * k) AS v FROM tap
  JOIN cells ON y = CASE WHEN my < 8 THEN my ELSE 14 - my END AND x = CASE WHEN mx < 8 THEN mx ELSE 14 - mx END GROUP BY raster_id, h, w, band, ty, tx)""", source="embedding")
def rotate(spark, sf):
    """Turned by 30 degrees, reflected at the border."""
    return g.rotate(embedding_cells(spark, sf), 30)


_PADS = {"wrap": "((t - 3) % 8 + 8) % 8", "replicate": "least(greatest(t - 3, 0), 7)", "reflect": "CASE WHEN ((t - 3) % 14 + 14) % 14 < 8 THEN ((t - 3) % 14 + 14) % 14 ELSE 14 - ((t - 3) % 14 + 14) % 14 END"}


@query("pads AS (" + " UNION ALL ".join(f"SELECT {i} AS mode, t, {s} AS s FROM range(14) r(t)" for i, s in enumerate(_PADS.values())) + """),
result AS (SELECT raster_id, 14 AS h, 14 AS w, a.mode AS band, a.t AS y, b.t AS x, v FROM cells JOIN pads a ON a.s = y JOIN pads b ON b.s = x AND b.mode = a.mode)""", source="embedding")
def pad_border(spark, sf):
    """Padded by 3: wrapped, repeated and reflected, as bands 0 to 2."""
    cells = embedding_cells(spark, sf)
    modes = [g.pad_border(cells, 3, m).withColumn("band", F.lit(i)) for i, m in enumerate(_PADS)]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


_CHUNKS = """chunks AS (SELECT raster_id, band, cy, cx, greatest(0, cy * 6 - 2) AS y0, greatest(0, cx * 6 - 2) AS x0, least(h, cy * 6 + 8) AS y1, least(w, cx * 6 + 8) AS x1, y, x, v
  FROM cells, range(3) a(cy), range(3) b(cx) WHERE y >= cy * 6 - 2 AND y < cy * 6 + 8 AND x >= cx * 6 - 2 AND x < cx * 6 + 8)"""


@query(_CHUNKS + "\nSELECT raster_id, cy::INTEGER AS cy, cx::INTEGER AS cx, (y1 - y0)::INTEGER AS h, (x1 - x0)::INTEGER AS w, band::INTEGER AS band, (y - y0)::INTEGER AS y, (x - x0)::INTEGER AS x, v FROM chunks", cells=False)
def split_tiles(spark, sf):
    """Chunks of 6 cells, 2 more at each side."""
    return g.split_tiles(lineitem_cells(spark, sf), 6, 2).drop("y0", "x0")


@query(_CHUNKS.replace("chunks AS", "parts AS") + """,
steps AS (SELECT raster_id, band, y, x, cy * 3 + cx AS step, 255 - v AS v, CASE WHEN y0 > 0 AND y - y0 < 2 THEN (y - y0)::DOUBLE ELSE 1 END AS fy,
  CASE WHEN x0 > 0 AND x - x0 < 2 THEN (x - x0)::DOUBLE ELSE 1 END AS fx FROM parts),
ordered AS (SELECT *, row_number() OVER (PARTITION BY raster_id, band, y, x ORDER BY step) AS n, count(*) OVER (PARTITION BY raster_id, band, y, x) AS many FROM steps),
folded AS (SELECT raster_id, band, y, x, 0::BIGINT AS n, v AS acc FROM cells UNION ALL
  SELECT f.raster_id, f.band, f.y, f.x, o.n, (o.v * o.fy + acc * (1 - o.fy)) * o.fx + acc * (1 - o.fx) FROM folded f JOIN ordered o ON o.raster_id = f.raster_id AND o.band = f.band AND o.y = f.y AND o.x = f.x AND o.n = f.n + 1),
result AS (SELECT raster_id, 16 AS h, 16 AS w, band, y, x, arg_max(acc, n) AS v FROM folded GROUP BY ALL)""")
def merge_feathered(spark, sf):
    """Chunks inverted and merged back with feathered edges."""
    cells = lineitem_cells(spark, sf)
    return g.merge_feathered(g.split_tiles(cells, 6, 2).withColumn("v", 255 - F.col("v")), cells, 2)


@query("""points AS (SELECT p_partkey AS point_id, p_partkey % 150 AS raster_id, (p_partkey % 1000) / 1000.0::DOUBLE AS u, (p_size % 50) / 50.0::DOUBLE AS pv FROM part)
SELECT point_id, p.raster_id, coalesce(band, 0)::INTEGER AS band, coalesce(c.v, -1)::DOUBLE AS value FROM points p
LEFT JOIN cells c ON c.raster_id = p.raster_id AND c.x = floor(u * 16)::BIGINT % 16 AND c.y = floor(pv * 16)::BIGINT % 16""", cells=False)
def sample_uv(spark, sf):
    """The cell under a point of every part; -1 where the raster is missing."""
    points = table(spark, sf, "part").select(F.col("p_partkey").alias("point_id"), (F.col("p_partkey") % 150).alias("raster_id"), ((F.col("p_partkey") % 1000) / 1000.0).alias("u"), ((F.col("p_size") % 50) / 50.0).alias("v"))
    return g.sample_uv(points, lineitem_cells(spark, sf), default=-1.0)


@query("result AS (SELECT raster_id, h, w, 2 - band AS band, y, x, v FROM cells UNION ALL SELECT raster_id, h, w, 3, y, x, v FROM cells WHERE band = 1)")
def reorder_bands(spark, sf):
    """Bands in the order 2, 1, 0, 1."""
    return g.reorder_bands(lineitem_cells(spark, sf), [2, 1, 0, 1])


@query("""scaled AS (SELECT raster_id, s.scale, band, y // s.f AS y, x // s.f AS x, avg(v) AS v FROM cells, (VALUES (0.125::DOUBLE, 8), (0.5::DOUBLE, 2), (1.0::DOUBLE, 1)) s(scale, f) GROUP BY ALL)
SELECT raster_id, scale, band::INTEGER AS band, y::INTEGER AS y, x::INTEGER AS x, floor(v * 10000::DOUBLE + 0.500001::DOUBLE) / 10000::DOUBLE AS v FROM scaled""", cells=False)
def multi_scale_request(spark, sf):
    """An eighth, a half and the full size."""
    return g.multi_scale(lineitem_cells(spark, sf)).select("raster_id", "scale", "band", "y", "x", rounded("v").alias("v"))
