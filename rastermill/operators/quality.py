"""Whole-raster statistics: seam measures, ranges, means, percentiles, coverage, contrast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..layout import COLUMNS, PLANE, clip, saved


def image_mean(cells: DataFrame) -> DataFrame:
    """Mean of each band of each raster."""
    return cells.groupBy("raster_id", "band").agg(F.avg("v").alias("mean"))


#: Bins of a round of selection; a bin of so few samples is sorted.
BINS, SORTED = 1024, 4096


def percentiles(cells: DataFrame, shares: list[float]) -> DataFrame:
    """Rows (raster_id, band, p), p an array of exact percentiles, linear between samples, of the samples that are numbers.

    Distributed selection: each rank starts in its band's whole range. A round counts samples by bin of the range, in partial
    sums, and keeps the bin that holds the rank; once it holds few samples, or one value, these are sorted. So no task
    holds a band, whatever its size, and rounds are few (each narrows a range by ``BINS``).
    """
    cells = cells.where(F.col("v").isNotNull() & ~F.isnan("v")).select(*PLANE, "v")
    plane = cells.groupBy(*PLANE).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    place = lambda i: (F.col("n") - 1) * float(shares[i])
    ends = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), ((F.ceil if up else F.floor)(place(i))).cast("long").alias("rank")) for i in range(len(shares)) for up in (False, True)])
    # rank: among the samples of [low, high]
    asked = saved(plane.select(*PLANE, "n", "low", "high", F.inline(ends)))
    open_ = asked.select(*PLANE, "i", "up", "rank", "low", "high", F.col("n").alias("held"))
    found = open_.where("low = high").select(*PLANE, "i", "up", F.col("low").alias("value"))
    open_ = open_.where("low < high")
    while True:
        few = open_.where(F.col("held") <= SORTED)
        ranges = few.groupBy(*PLANE, "low", "high").agg(F.collect_set(F.struct("i", "up", "rank")).alias("asks"))
        sorted_ = cells.join(ranges, PLANE).where("v BETWEEN low AND high").groupBy(*PLANE, "low", "high").agg(F.first("asks").alias("asks"), F.array_sort(F.collect_list("v")).alias("vs"))
        found = found.unionByName(sorted_.select(*PLANE, "vs", F.inline("asks")).select(*PLANE, "i", "up", F.get("vs", F.col("rank").cast("int")).alias("value")))
        open_ = open_.where(F.col("held") > SORTED)
        if open_.isEmpty():
            break
        ranges = open_.select(*PLANE, "low", "high").distinct()
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BINS))
        bins = cells.join(ranges, PLANE).where("v BETWEEN low AND high").groupBy(*PLANE, "low", "high", bin_.alias("bin")).agg(F.count("*").alias("held"), F.min("v").alias("from"), F.max("v").alias("to"))
        before = F.sum("held").over(Window.partitionBy(*PLANE, "low", "high").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("held")
        met = open_.drop("held").join(bins.withColumn("before", before), [*PLANE, "low", "high"]).where("rank >= before AND rank < before + held")
        narrowed = saved(met.select(*PLANE, "i", "up", (F.col("rank") - F.col("before")).alias("rank"), F.col("from").alias("low"), F.col("to").alias("high"), "held"))
        found = found.unionByName(narrowed.where("low = high").select(*PLANE, "i", "up", F.col("low").alias("value")))
        open_ = narrowed.where("low < high")
    of = lambda i, up: F.max(F.when((F.col("i") == i) & (F.col("up") == up), F.col("value")))
    both = found.groupBy(*PLANE).agg(*[of(i, up).alias(f"v{i}{up}") for i in range(len(shares)) for up in (False, True)]).join(asked.select(*PLANE, "n").distinct(), PLANE)
    between = [F.col(f"v{i}False") + (F.col(f"v{i}True") - F.col(f"v{i}False")) * (place(i) - F.floor(place(i))) for i in range(len(shares))]
    return both.select(*PLANE, F.array(*between).alias("p"))


def percentile_stretch(cells: DataFrame, low: float = 0.02, high: float = 0.98, exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """Between the two percentiles of each band, 0 to 1; unchanged but clipped where they are equal.

    exact: linear interpolation between samples (``percentiles``); otherwise percentile_approx, whose state is bounded by
    ``accuracy``.
    """
    approx = lambda: cells.groupBy("raster_id", "band").agg(F.percentile_approx("v", F.array(F.lit(low), F.lit(high)), accuracy).alias("p"))
    bounds = percentiles(cells, [low, high]) if exact else approx()
    range_ = bounds.select("raster_id", "band", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    stretched = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("v"))
    return cells.join(range_, ["raster_id", "band"]).withColumn("v", clip(stretched, 0, 1)).select(*COLUMNS)


def range_infer(cells: DataFrame) -> DataFrame:
    """Rows (raster_id, max_value, unit): the largest sample that is a number, and 1, 255 or 65535 as the range it fits."""
    top = F.max(F.when(~F.isnan("v"), F.col("v")))
    found = cells.groupBy("raster_id").agg(top.alias("max_value"))
    return found.withColumn("unit", F.when(F.coalesce("max_value", F.lit(0.0)) <= 1, 1.0).when(F.col("max_value") <= 255, 255.0).otherwise(65535.0))


def seam_error(cells: DataFrame) -> DataFrame:
    """Rows (raster_id, seam_error): mean difference of first and last column, or of first and last row, whichever is larger.

    Each line's two ends meet in a first aggregation by line; only edge cells are shuffled.
    """
    ends = []
    for axis, edge, other in (("x", "w", "y"), ("y", "h", "x")):
        sign = F.when(F.col(axis) == 0, F.col("v")).otherwise(0.0) - F.when(F.col(axis) == F.col(edge) - 1, F.col("v")).otherwise(0.0)
        on = cells.where((F.col(axis) == 0) | (F.col(axis) == F.col(edge) - 1)).select("raster_id", F.lit(axis).alias("axis"), "band", F.col(other).alias("line"), sign.alias("d"))
        ends.append(on)
    by_line = ends[0].unionByName(ends[1]).groupBy("raster_id", "axis", "band", "line").agg(F.abs(F.sum("d")).alias("d"))
    return by_line.groupBy("raster_id", "axis").agg(F.avg("d").alias("e")).groupBy("raster_id").agg(F.max("e").alias("seam_error"))


def seam_ratio(cells: DataFrame) -> DataFrame:
    """Rows (raster_id, x_ratio, y_ratio): difference across the wrap over the mean difference of neighbours (null if that is 0).

    Differences to the next sample on each axis, the first one for the last, are made in blocks of lines and summed by line.
    """
    from . import scanlines

    return seam_ratio_lines(scanlines.from_cells(cells))


def seam_ratio_lines(lines: DataFrame) -> DataFrame:
    """``seam_ratio`` of lines."""
    from . import scanlines

    steps = [(0, 0, [-1.0, -1.0]), (0, 1, [1.0, 0.0]), (1, 0, [0.0, 1.0])]
    lines = scanlines.correlate(lines.where("h > 1 or w > 1"), [(steps, ["dx", "dy"])], "wrap")
    total = lambda d: F.aggregate(d, F.lit(0.0), lambda s, v: s + F.abs(v))
    last = F.abs(F.get("dx", F.col("w") - 1))
    sums = lines.select("raster_id", "h", "w", "y", last.alias("xw"), total(F.slice("dx", 1, F.col("w") - 1)).alias("xi"), total(F.col("dy")).alias("d"))
    end = F.col("y") == F.col("h") - 1
    sums = sums.groupBy("raster_id", "h", "w").agg(
        F.sum("xw").alias("xw"), F.sum("xi").alias("xi"), F.sum(F.when(end, F.col("d"))).alias("yw"), F.coalesce(F.sum(F.when(~end, F.col("d"))), F.lit(0.0)).alias("yi"))
    # the bands' lines and columns cancel: a wrap has one difference where the inside has an edge less one
    ratio = lambda a, e: (F.col(f"{a}w") / F.when(F.col(f"{a}i") != 0, F.col(f"{a}i") / (F.col(e) - 1))).alias(f"{a}_ratio")
    return sums.select("raster_id", ratio("x", "w"), ratio("y", "h"))


def contrast_retention(result: DataFrame, source: DataFrame) -> DataFrame:
    """Rows (raster_id, retention): population standard deviation of the result over that of the source (null if that is 0)."""
    spread = lambda df, name: df.groupBy("raster_id").agg(F.stddev_pop("v").alias(name))
    met = spread(result, "a").join(spread(source, "b"), "raster_id")
    return met.select("raster_id", (F.col("a") / F.when(F.col("b") != 0, F.col("b"))).alias("retention"))


def coverage(weights: DataFrame, least: float = 1e-9) -> DataFrame:
    """Rows (raster_id, uncovered): places with less weight than ``least``."""
    return weights.groupBy("raster_id").agg(F.count_if(F.col("v") < least).alias("uncovered"))


def is_grayscale(cells: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """Rows (raster_id, grayscale): blue and green, and green and red, differ by less than ``tolerance`` on the mean."""
    pick = lambda b: F.sum(F.when(F.col("band") == b, F.col("v")))
    pixels = cells.where("band < 3").groupBy("raster_id", "y", "x").agg(F.abs(pick(0) - pick(1)).alias("bg"), F.abs(pick(1) - pick(2)).alias("gr"))
    means = pixels.groupBy("raster_id").agg(F.coalesce(F.avg("bg"), F.lit(0.0)).alias("bg"), F.coalesce(F.avg("gr"), F.lit(0.0)).alias("gr"))
    return means.select("raster_id", ((F.col("bg") < tolerance) & (F.col("gr") < tolerance)).alias("grayscale"))


def quality_report(cells: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """One row per raster: seam error, seam ratios, smallest, largest and missing samples, and contrast kept of a source."""
    return _report(cells, seam_error(cells), seam_ratio(cells), source)


def quality_report_lines(lines: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """``quality_report`` of lines, of a source in lines."""
    from . import scanlines

    return _report(scanlines.to_cells(lines), scanlines.seam_error(lines), seam_ratio_lines(lines), source if source is None else scanlines.to_cells(source))


def _report(cells: DataFrame, error: DataFrame, ratio: DataFrame, source: DataFrame | None) -> DataFrame:
    basic = cells.groupBy("raster_id").agg(F.min("v").alias("min_value"), F.max("v").alias("max_value"), F.count_if(F.isnan("v") | F.col("v").isNull()).alias("missing"), F.count("*").alias("samples"))
    out = basic.join(error, "raster_id", "left").join(ratio, "raster_id", "left")
    return out if source is None else out.join(contrast_retention(cells, source), "raster_id", "left")
