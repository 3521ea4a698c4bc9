"""Coordinate algebra on cells: shifts, reflections, repetition, crops, resampling, padding, chunks, lookups, band orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..layout import COLUMNS, col, sized


def offset(cells: DataFrame, x: float = 0.5, y: float = 0.5, back: bool = False) -> DataFrame:
    """Circular shift by a whole number of cells, the fraction of each edge rounded down; ``back`` undoes it."""
    sign = -1 if back else 1
    return sized(cells.withColumns({
        "x": F.pmod(F.col("x") + sign * F.floor(F.col("w") * x), F.col("w")).cast("int"),
        "y": F.pmod(F.col("y") + sign * F.floor(F.col("h") * y), F.col("h")).cast("int"),
    }))


def mirror_tile(cells: DataFrame) -> DataFrame:
    """Twice the size on both axes: the raster, its reflections across each axis and across both."""
    far_x, far_y = 2 * F.col("w") - 1 - F.col("x"), 2 * F.col("h") - 1 - F.col("y")
    spots = F.array(*[F.struct(b.alias("y"), a.alias("x")) for b in (F.col("y"), far_y) for a in (F.col("x"), far_x)])
    spread = cells.withColumn("spot", F.explode(spots))
    return spread.select("raster_id", (F.col("h") * 2).alias("h"), (F.col("w") * 2).alias("w"), "band", "spot.y", "spot.x", "v")


def tile_repeat(cells: DataFrame, n: int = 2, max_edge: int | None = None) -> DataFrame:
    """n by n repetition; with ``max_edge``, rasters whose edge exceeds max_edge // n are shrunk to that first."""
    if max_edge:
        scale = F.least(F.lit(1.0), (max_edge // n) / F.greatest("h", "w"))
        cells = resize_area(cells, lambda e: F.greatest(F.lit(1), F.floor(F.col(e) * scale)).cast("int"))
    both = cells.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return both.select("raster_id", (F.col("h") * n).alias("h"), (F.col("w") * n).alias("w"), "band", (F.col("y") + F.col("i") * F.col("h")).alias("y"), (F.col("x") + F.col("j") * F.col("w")).alias("x"), "v")


def crop(cells: DataFrame, top=0, bottom=0, left=0, right=0) -> DataFrame:
    """Without so many rows and columns at each side (numbers or columns)."""
    top, bottom, left, right = map(col, (top, bottom, left, right))
    kept = cells.where((F.col("y") >= top) & (F.col("y") < F.col("h") - bottom) & (F.col("x") >= left) & (F.col("x") < F.col("w") - right))
    return kept.select("raster_id", (F.col("h") - top - bottom).cast("int").alias("h"), (F.col("w") - left - right).cast("int").alias("w"), "band", (F.col("y") - top).cast("int").alias("y"), (F.col("x") - left).cast("int").alias("x"), "v")


def images(place: Column, n: Column, pad: int | Column, border: str) -> Column:
    """All positions from -pad to n + pad - 1 at which a padded axis of n cells shows cell ``place``.

    wrap: the axis repeats; replicate: its end cells go on; reflect: it is mirrored at its end cells, which show once.
    """
    low, high = -col(pad), n + (pad - 1)

    def series(at: Column, step: Column) -> Column:
        first = at + step * F.ceil((low - at) / step)
        return F.when(first <= high, F.sequence(first.cast("int"), high.cast("int"), step.cast("int"))).otherwise(F.array().cast("array<int>"))

    if border == "wrap":
        return series(place, n)
    ends = F.filter(F.sequence(low.cast("int"), high.cast("int")), lambda t: F.least(F.greatest(t, F.lit(0)), n - 1) == place)
    if border == "replicate":
        return F.when((place > 0) & (place < n - 1), F.array(place.cast("int"))).otherwise(ends)
    if border == "reflect":
        period = F.greatest(2 * n - 2, F.lit(1))
        return F.when(n == 1, ends).otherwise(F.array_distinct(F.concat(series(place, period), series(-place, period))))
    raise ValueError(f"unknown border {border!r}")


def pad_border(cells: DataFrame, pad: int, border: str = "wrap") -> DataFrame:
    """Larger by ``pad`` cells at each side, filled by the border rule; coordinates start at 0 again."""
    out = cells.withColumn("i", F.explode(images(F.col("y"), F.col("h"), pad, border))).withColumn("j", F.explode(images(F.col("x"), F.col("w"), pad, border)))
    return out.select("raster_id", (F.col("h") + 2 * pad).alias("h"), (F.col("w") + 2 * pad).alias("w"), "band", (F.col("i") + pad).alias("y"), (F.col("j") + pad).alias("x"), "v")


Size = int | Callable[[str], Column]


def _targets(cells: DataFrame, size: Size) -> DataFrame:
    """Adds the sizes to come, ``__mh`` and ``__mw``, both from the sizes that are."""
    return cells.withColumns({f"__m{e}": (F.lit(size) if isinstance(size, int) else size(e)).cast("int") for e in ("h", "w")})


def _resample(cells: DataFrame, size: Size, reach: int, kernel: Callable[[Column], Column], border: str) -> DataFrame:
    """One axis after the other: each cell, and each of its images past the border, goes to the targets within ``reach`` with its weight.

    No join: which targets a cell reaches follows from the sizes. Sums are partial before the shuffle.
    """
    cells = _targets(cells, size)
    for axis, edge in (("y", "h"), ("x", "w")):
        n, m = F.col(edge), F.col(f"__m{edge}")
        spread = cells.withColumn("__u", F.explode(images(F.col(axis), n, reach, border)))
        first = F.greatest(F.lit(0), F.floor((F.col("__u") - reach + 0.5) * m / n - 0.5)).cast("int")
        last = F.least(m - 1, F.ceil((F.col("__u") + reach + 0.5) * m / n - 0.5)).cast("int")
        spread = spread.where(first <= last).withColumn("__t", F.explode(F.sequence(first, last)))
        spread = spread.withColumn("__k", kernel((F.col("__t") + 0.5) * n / m - 0.5 - F.col("__u"))).where("__k <> 0")
        keep = [c for c in (*COLUMNS, "__mh", "__mw") if c not in (axis, "v")]
        cells = spread.groupBy(*keep, F.col("__t").alias(axis)).agg(F.sum(F.col("v") * F.col("__k")).alias("v"))
    return cells.select("raster_id", F.col("__mh").alias("h"), F.col("__mw").alias("w"), "band", "y", "x", "v")


def _linear(d: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(d))


def _cubic(d: Column, a: float = -0.75) -> Column:
    t = F.abs(d)
    near = ((a + 2) * t - (a + 3)) * t * t + 1
    far = ((a * t - 5 * a) * t + 8 * a) * t - 4 * a
    return F.when(t <= 1, near).when(t < 2, far).otherwise(F.lit(0.0))


def resize_linear(cells: DataFrame, size: Size) -> DataFrame:
    """Bilinear, half-pixel centres, border cells repeated."""
    return _resample(cells, size, 1, _linear, "replicate")


def resize_wrapped(cells: DataFrame, size: Size) -> DataFrame:
    """Bilinear, half-pixel centres, sampling across the wrap, so that a seamless raster stays seamless."""
    return _resample(cells, size, 1, _linear, "wrap")


def resize_cubic(cells: DataFrame, size: Size) -> DataFrame:
    """Bicubic (a = -0.75), half-pixel centres, border cells repeated."""
    return _resample(cells, size, 2, _cubic, "replicate")


def resize_nearest(cells: DataFrame, size: Size) -> DataFrame:
    """Target t takes source floor(t * n / m): the targets of source s are those from ceil(s * m / n) on."""
    cells = _targets(cells, size)
    for axis, edge in (("y", "h"), ("x", "w")):
        n, m = F.col(edge), F.col(f"__m{edge}")
        first, last = F.ceil(F.col(axis) * m / n).cast("int"), (F.ceil((F.col(axis) + 1) * m / n) - 1).cast("int")
        cells = cells.where(first <= last).withColumn("__t", F.explode(F.sequence(first, last))).withColumn(axis, F.col("__t"))
    return cells.select("raster_id", F.col("__mh").alias("h"), F.col("__mw").alias("w"), "band", "y", "x", "v")


def resize_area(cells: DataFrame, size: Size) -> DataFrame:
    """Shrinks by the mean over each target's footprint, source cells weighted by their overlap with it."""
    spread = _targets(cells, size)
    for axis, edge in (("y", "h"), ("x", "w")):
        m = F.col(f"__m{edge}")
        step = F.col(edge) / m
        first, last = F.floor(F.col(axis) / step).cast("int"), F.least(m - 1, F.ceil((F.col(axis) + 1) / step) - 1).cast("int")
        t = F.col(f"__t{axis}")
        spread = spread.withColumn(f"__t{axis}", F.explode(F.sequence(first, F.greatest(first, last))))
        spread = spread.withColumn(f"__k{axis}", F.least(F.col(axis) + 1.0, (t + 1) * step) - F.greatest(F.col(axis) + 0.0, t * step))
    weight = F.col("__ky") * F.col("__kx")
    out = spread.where("__ky > 1e-9 and __kx > 1e-9").groupBy("raster_id", F.col("__mh").alias("h"), F.col("__mw").alias("w"), "band", F.col("__ty").alias("y"), F.col("__tx").alias("x"))
    return out.agg((F.sum(F.col("v") * weight) / F.sum(weight)).alias("v")).select(*COLUMNS)


def rotate(cells: DataFrame, degrees: float | Column) -> DataFrame:
    """Counter-clockwise about (w / 2, h / 2), bilinear, reflected at the border; the size stays.

    Each cell, and each of its reflections that the turned raster shows, goes to the targets that it is a tap of, found by
    turning it forth. So there is no join; sums are partial before the shuffle. degrees: a number, or a column of the
    raster's key.
    """
    turn = F.radians(col(degrees).cast("double"))
    half = {"y": F.col("h") / 2, "x": F.col("w") / 2}
    far = {"y": F.abs("__sin") * half["x"] + F.abs("__cos") * half["y"], "x": F.abs("__cos") * half["x"] + F.abs("__sin") * half["y"]}
    spread = cells.withColumns({"__cos": F.cos(turn), "__sin": F.sin(turn)})
    for axis, edge in (("y", "h"), ("x", "w")):
        pad = (F.ceil(F.greatest(far[axis] - half[axis], F.lit(0.0))) + 2).cast("int")
        spread = spread.withColumn(f"__u{axis}", F.explode(images(F.col(axis), F.col(edge), pad, "reflect")))
    cos, sin, uy, ux = F.col("__cos"), F.col("__sin"), F.col("__uy") - half["y"], F.col("__ux") - half["x"]
    # a tap lies less than 1 off on both axes, which turned back is a square of this reach
    reach = F.abs(cos) + F.abs(sin)
    for axis, edge, at in (("y", "h", cos * uy - sin * ux + half["y"]), ("x", "w", cos * ux + sin * uy + half["x"])):
        first, last = F.greatest(F.lit(0), F.ceil(at - reach).cast("int")), F.least(F.col(edge) - 1, F.floor(at + reach).cast("int"))
        spread = spread.withColumns({"__first": first, "__last": last}).where("__first <= __last").withColumn(f"__t{axis}", F.explode(F.sequence("__first", "__last")))
    dy, dx = F.col("__ty") - half["y"], F.col("__tx") - half["x"]
    fx, fy = cos * dx - sin * dy + half["x"], sin * dx + cos * dy + half["y"]
    spread = spread.withColumn("__k", _linear(fy - F.col("__uy")) * _linear(fx - F.col("__ux"))).where("__k > 0")
    out = spread.groupBy("raster_id", "h", "w", "band", F.col("__ty").alias("y"), F.col("__tx").alias("x"))
    return out.agg(F.sum(F.col("v") * F.col("__k")).alias("v")).select(*COLUMNS)


def split_tiles(cells: DataFrame, chunk: int = 1024, overlap: int = 64) -> DataFrame:
    """Each cell in every chunk that holds it, chunks being expanded by ``overlap`` at each side and cut to the raster.

    Adds (cy, cx): the chunk's number; (y0, x0): where it starts; h, w, y and x become the chunk's own.
    """

    def numbers(place: str, n: str) -> Column:
        low = F.greatest(F.lit(0), F.floor((F.col(place) - overlap) / chunk))
        high = F.least(F.floor((F.col(n) - 1) / chunk), F.floor((F.col(place) + overlap) / chunk))
        return F.explode(F.sequence(low.cast("int"), high.cast("int")))

    out = cells.withColumn("cy", numbers("y", "h")).withColumn("cx", numbers("x", "w"))
    start = {a: F.greatest(F.lit(0), F.col(c) * chunk - overlap) for a, c in (("y0", "cy"), ("x0", "cx"))}
    end = {e: F.least(F.col(e), F.col(c) * chunk + chunk + overlap) for e, c in (("h", "cy"), ("w", "cx"))}
    return out.select("raster_id", "cy", "cx", start["y0"].cast("int").alias("y0"), start["x0"].cast("int").alias("x0"), (end["h"] - start["y0"]).cast("int").alias("h"), (end["w"] - start["x0"]).cast("int").alias("w"),
                      "band", (F.col("y") - start["y0"]).cast("int").alias("y"), (F.col("x") - start["x0"]).cast("int").alias("x"), "v")


def merge_feathered(chunks: DataFrame, source: DataFrame, overlap: int = 64) -> DataFrame:
    """Chunks put back in order over the source, each faded in over its first ``overlap`` rows and columns, y and then x.

    What a pixel shows is an ordered fold over the few chunks that hold it, so it is gathered and folded by pixel.
    """

    def fade(place: str, start: str, edge: str) -> Column:
        n = F.least(F.lit(overlap), F.col(edge))
        ramp = F.when(n > 1, F.col(place) / (n - 1)).otherwise(F.lit(0.0))
        return F.when((F.col(start) > 0) & (F.col(place) < n), ramp).otherwise(F.lit(1.0))

    step = F.struct("cy", "cx", F.col("v").alias("v"), fade("y", "y0", "h").alias("fy"), fade("x", "x0", "w").alias("fx"))
    placed = chunks.select("raster_id", "band", (F.col("y") + F.col("y0")).alias("y"), (F.col("x") + F.col("x0")).alias("x"), step.alias("step"))
    steps = placed.groupBy("raster_id", "band", "y", "x").agg(F.array_sort(F.collect_list("step")).alias("steps"))

    def over(acc: Column, s: Column) -> Column:
        faded = s["v"] * s["fy"] + acc * (1 - s["fy"])
        return faded * s["fx"] + acc * (1 - s["fx"])

    out = source.join(steps, ["raster_id", "band", "y", "x"])
    return out.withColumn("v", F.aggregate("steps", F.col("v"), over)).select(*COLUMNS)


def sample_uv(points: DataFrame, cells: DataFrame, default: float = 0.0) -> DataFrame:
    """Points (point_id, raster_id, u, v) with the cell under them in each band; ``default`` in band 0 where the raster is missing."""
    sizes = cells.groupBy("raster_id").agg(F.max("h").alias("h"), F.max("w").alias("w"))
    at = points.join(sizes, "raster_id", "left")
    at = at.withColumns({"x": F.pmod(F.floor(F.col("u") * F.col("w")), F.col("w")).cast("int"), "y": F.pmod(F.floor(F.col("v") * F.col("h")), F.col("h")).cast("int")})
    met = at.join(cells.select("raster_id", "y", "x", "band", F.col("v").alias("value")), ["raster_id", "y", "x"], "left")
    return met.select("point_id", "raster_id", F.coalesce("band", F.lit(0)).alias("band"), F.coalesce("value", F.lit(default)).alias("value"))


def reorder_bands(cells: DataFrame, order: list[int]) -> DataFrame:
    """Band i of the result is band order[i] of the input; one input band may be shown several times, others are dropped."""
    to = F.array(*[F.struct(F.lit(i).alias("to"), F.lit(b).alias("of")) for i, b in enumerate(order)])
    shown = cells.withColumn("spot", F.explode(F.filter(to, lambda s: s["of"] == F.col("band"))))
    return shown.withColumn("band", F.col("spot.to")).select(*COLUMNS)


def multi_scale(cells: DataFrame, scales: tuple[float, ...] = (0.125, 0.5, 1.0)) -> DataFrame:
    """The raster at each scale, with a column ``scale``: lines are spread over scales and shrunk in blocks."""
    from . import scanlines

    lines = scanlines.from_cells(cells).withColumn("scale", F.explode(F.array(*[F.lit(float(s)) for s in scales])))
    down = lambda e: F.greatest(F.lit(1), F.floor(F.col(e) * F.col("raster_id.scale")))
    shrunk = scanlines.resampled(lines.withColumn("raster_id", F.struct("raster_id", "scale")), down("h"), down("w"), scanlines.area_taps)
    return scanlines.to_cells(shrunk).select("raster_id.raster_id", "raster_id.scale", "h", "w", "band", "y", "x", "v")
