"""Point-wise operators on cells: ingest and output ranges, gray, maps of single samples, colour spaces, light removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..layout import COLUMNS, bands_long, bands_wide, clip, sized
from . import scanlines


def _with_max(cells: DataFrame) -> DataFrame:
    """Adds ``__max``, the raster's largest sample that is a number (0 where there is none)."""
    tops = cells.groupBy("raster_id").agg(F.coalesce(F.max(F.when(~F.isnan("v"), F.col("v"))), F.lit(0.0)).alias("__max"))
    return cells.join(tops, "raster_id")


def normalize_ingest(cells: DataFrame, dtype: str = "float32") -> DataFrame:
    """To 0..255: gray to three bands, 16-bit over 257, floats of at most 1 times 255, then non-finite samples replaced and clipped."""
    if dtype == "uint16":
        cells = cells.withColumn("v", F.col("v") / 257)
    scaled = _with_max(cells).withColumn("v", F.when(F.col("__max") <= 1, F.col("v") * 255).otherwise(F.col("v")))
    bands = cells.groupBy("raster_id").agg(F.max("band").alias("__last"))
    spread = scaled.join(bands, "raster_id").withColumn("band", F.explode(F.when(F.col("__last") == 0, F.array(*[F.lit(b) for b in range(3)])).otherwise(F.array("band"))))
    return sized(spread.withColumn("v", clip(color.finite("v"), 0, 255)))


def validate(meta: DataFrame, low: int = 64, high: int = 8192, mirror: int = 4096) -> DataFrame:
    """Adds ``reason`` to rows (raster_id, h, w, method): empty, too small, too large, or too large to mirror; null if accepted."""
    short, long = F.least("h", "w"), F.greatest("h", "w")
    empty = F.coalesce(short <= 0, F.lit(True))
    reason = F.when(empty, "empty").when(short < low, "too small").when(long > high, "too large").when((F.col("method") == "mirror") & (long > mirror), "too large to mirror")
    return meta.withColumn("reason", reason)


def coerce_for_save(cells: DataFrame, dtype: str = "float32", fmt: str = "png") -> DataFrame:
    """Samples as a file of the format holds them: 0..1 for exr, whole 16-bit where kept, else whole 8-bit, truncated."""
    if dtype == "uint8":
        return sized(cells)
    if dtype == "uint16":
        return sized(cells) if fmt in ("png", "tiff") else sized(cells.withColumn("v", F.floor(F.col("v") / 257).cast("double")))
    clean = _with_max(cells.withColumn("v", color.finite("v", high=1.0)))
    if fmt == "exr":
        return sized(clean.withColumn("v", clip(F.when(F.col("__max") > 1, F.col("v") / 255).otherwise(F.col("v")), 0, 1)))
    return sized(clean.withColumn("v", F.floor(clip(F.when(F.col("__max") <= 1, F.col("v") * 255).otherwise(F.col("v")), 0, 255)).cast("double")))


def at_depth(v: Column, dim: Column, dtype: str, fmt: str = "png", bits: int = 8) -> Column:
    """A sample, a number, at an export's bit depth; dtype is that of the map: uint8, uint16 or float32. dim: none of the raster is above 1."""
    if fmt == "exr":
        return v / (65535 if dtype == "uint16" else 255) if dtype != "float32" else clip(v / F.when(dim, 1.0).otherwise(255.0), 0, 1)
    if dtype == "uint16":
        return v if bits == 16 else F.floor(v / 257).cast("double")
    if bits == 8 and dtype == "uint8":
        return v
    unit, other, most = (65535.0, 257.0, 65535) if bits == 16 else (255.0, 1.0, 255)
    return F.floor(clip(v * F.when(dim, unit).otherwise(other), 0, most)).cast("double")


def export_depth(cells: DataFrame, dtype: str, fmt: str = "png", bits: int = 8) -> DataFrame:
    """Samples at an export's bit depth, see ``at_depth``."""
    if dtype == "uint16" or (dtype == "uint8" and (fmt == "exr" or bits == 8)):
        return point(cells, lambda v: at_depth(v, F.lit(False), dtype, fmt, bits))
    clean = _with_max(cells.withColumn("v", color.finite("v")))
    return sized(clean.withColumn("v", at_depth(F.col("v"), F.col("__max") <= 1, dtype, fmt, bits)))


def gray(cells: DataFrame, source: str = "average_rgb") -> DataFrame:
    """One band, 0, of a pixel's bands by the named source; a raster of one band stays as it is."""
    return grays(cells, [source])


def grays(cells: DataFrame, sources: list[str]) -> DataFrame:
    """``gray`` by each source as a band of its own, in order; a pixel's bands meet once for all."""
    wide = bands_wide(cells, 4)
    b, g, r = F.col("b0"), F.coalesce("b1", "b0"), F.coalesce("b2", "b0")
    value = lambda s: F.when(F.col("b1").isNull(), b).otherwise(color.gray(b, g, r, s, F.col("b3")))
    if len(sources) == 1:
        return wide.select("raster_id", "h", "w", F.lit(0).alias("band"), "y", "x", value(sources[0]).alias("v"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), value(s).alias("v")) for i, s in enumerate(sources)]))
    return wide.select("raster_id", "h", "w", "y", "x", each.alias("one")).select("raster_id", "h", "w", "one.band", "y", "x", "one.v")


def gray_lines(lines: DataFrame, source: str = "average_rgb") -> DataFrame:
    """``gray`` of lines: the bands of a line meet once, as arrays."""
    of = lambda b: F.first(F.when(F.col("band") == b, F.col("data")), True)
    met = lines.groupBy("raster_id", "h", "w", "y").agg(*[of(b).alias(f"b{b}") for b in range(4)])
    zipped = F.transform(F.arrays_zip("b0", "g", "r", "a"), lambda c: color.gray(c["b0"], c["g"], c["r"], source, c["a"]))
    met = met.withColumns({"g": F.coalesce("b1", "b0"), "r": F.coalesce("b2", "b0"), "a": F.coalesce("b3", F.array().cast("array<double>"))})
    return met.select("raster_id", "h", "w", F.lit(0).alias("band"), "y", F.when(F.col("b1").isNull(), F.col("b0")).otherwise(zipped).alias("data"))


def point(cells: DataFrame, f) -> DataFrame:
    """v replaced by f(v)."""
    return sized(cells.withColumn("v", f(F.col("v")).cast("double")))


def glossiness(cells: DataFrame) -> DataFrame:
    return point(cells, lambda v: 255 - v)


def clamp_displacement(cells: DataFrame, low: int = 8, high: int = 247) -> DataFrame:
    return point(cells, lambda v: clip(v, low, high))


def flip_green(cells: DataFrame, high: int = 65535) -> DataFrame:
    """Between the two conventions of normal maps: green becomes high minus green."""
    return sized(cells.withColumn("v", F.when(F.col("band") == 1, high - F.col("v")).otherwise(F.col("v"))))


def gray_to_bgr_u8(unit: DataFrame, alpha: DataFrame | None = None) -> DataFrame:
    """A map from 0 to 1 as whole 0..255 in three equal bands, alpha (0 to 1) as a fourth."""
    gray = unit.withColumn("band", F.explode(F.array(*[F.lit(b) for b in range(3)]))).withColumn("v", color.to_u8(F.col("v"))).select(*COLUMNS)
    return gray if alpha is None else gray.unionByName(alpha.select(*COLUMNS).withColumn("band", F.lit(3)).withColumn("v", color.to_u8(F.col("v"))))


def _wide(cells: DataFrame, f, bands: int = 3) -> DataFrame:
    """The first three bands replaced by f(b0, b1, b2)."""
    wide = bands_wide(cells, bands)
    new = f(*[F.col(f"b{i}") for i in range(bands)])
    return bands_long(wide.withColumns({f"b{i}": c for i, c in enumerate(new)}), bands)


def bgr_to_lab(cells: DataFrame, whole: bool = True) -> DataFrame:
    """LAB on an 8-bit scale as bands 0 to 2."""
    end = (lambda c: F.rint(clip(c, 0, 255))) if whole else (lambda c: c)
    return _wide(cells, lambda b, g, r: [end(c) for c in color.bgr_to_lab(b, g, r)])


def lab_to_bgr(cells: DataFrame) -> DataFrame:
    return _wide(cells, lambda x, a, b: [F.rint(clip(c, 0, 255)) for c in color.lab_to_bgr(x, a, b)])


def _pixels(lines: DataFrame) -> DataFrame:
    """One row per pixel with columns b0, b1 and b2, from lines whose bands meet once, as arrays."""
    of = lambda b: F.first(F.when(F.col("band") == b, F.col("data")), True)
    keys = ["raster_id", "h", "w", "y"]
    met = scanlines.dealt(lines, *keys).groupBy(*keys).agg(*[of(b).alias(f"b{b}") for b in range(3)])
    return met.select(*keys, F.posexplode(F.arrays_zip("b0", "b1", "b2")).alias("x", "c")).select(*keys, "x", "c.*")


def lab_lines(lines: DataFrame) -> DataFrame:
    """``bgr_to_lab`` of lines; pixels are gathered to lines again where they are."""
    lab = [F.rint(clip(c, 0, 255)).alias(f"n{i}") for i, c in enumerate(color.bgr_to_lab(F.col("b0"), F.col("b1"), F.col("b2")))]
    keys = ["raster_id", "h", "w", "y"]
    whole = _pixels(lines).select(*keys, "x", *lab).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "n0", "n1", "n2"))).alias("all"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col(f"all.n{i}").alias("data")) for i in range(3)]))
    return whole.select(*keys, each.alias("one")).select("raster_id", "h", "w", "one.band", "y", "one.data")


def bgr_cells(lines: DataFrame) -> DataFrame:
    """Cells of ``lab_to_bgr`` of lines."""
    new = [F.rint(clip(c, 0, 255)).alias(f"b{i}") for i, c in enumerate(color.lab_to_bgr(F.col("b0"), F.col("b1"), F.col("b2")))]
    return bands_long(_pixels(lines).select("raster_id", "h", "w", "y", "x", *new))


def premultiply(cells: DataFrame, back: bool = False) -> DataFrame:
    """Colour bands (0 to 1) times alpha, band 3, or divided by it again."""
    factor = (lambda x, a: x / F.greatest(a, F.lit(1e-6))) if back else (lambda x, a: x * a)
    return _wide(cells, lambda b, g, r, a: [factor(b, a), factor(g, a), factor(r, a), a], 4)


def to_rgba_u8(cells: DataFrame, dtype: str = "uint8") -> DataFrame:
    """Red, green, blue, alpha as whole 0..255: 16-bit over 257 rounded half to even, others clipped and truncated."""
    v = F.rint(F.col("v") / 257) if dtype == "uint16" else F.floor(clip("v", 0, 255)).cast("double")
    wide = bands_wide(cells.withColumn("v", v), 4)
    b, g, r = F.col("b0"), F.coalesce("b1", "b0"), F.coalesce("b2", "b0")
    return bands_long(wide.select("raster_id", "h", "w", "y", "x", r.alias("n0"), g.alias("n1"), b.alias("n2"), F.coalesce("b3", F.lit(255.0)).alias("n3")).withColumnsRenamed({f"n{i}": f"b{i}" for i in range(4)}), 4)


# Light removal on the L plane (cells of one band, 0 to 255).


def _with_mean(cells: DataFrame) -> DataFrame:
    return cells.join(cells.groupBy("raster_id", "band").agg(F.avg("v").alias("__mean")), ["raster_id", "band"])


def lift_shadows(plane: DataFrame, amount: float) -> DataFrame:
    """The dark end raised by up to 40."""
    return point(plane, lambda v: clip(v + clip(1 - v / 80, 0, 1) * (amount * 40), 0, 255))


def reduce_highlights(plane: DataFrame, amount: float) -> DataFrame:
    """The bright end pulled towards the mean."""
    v = F.col("v")
    return sized(_with_mean(plane).withColumn("v", clip(v - clip((v - 180) / 75, 0, 1) * (v - F.col("__mean")) * (amount * 0.6), 0, 255)))


def recover_contrast(plane: DataFrame, amount: float) -> DataFrame:
    """Deviations from the mean enlarged."""
    return sized(_with_mean(plane).withColumn("v", clip(F.col("__mean") + (F.col("v") - F.col("__mean")) * (1 + amount * 0.8), 0, 255)))


def flatten_color(planes: DataFrame, flatness: float, keep: float = 0.0) -> DataFrame:
    """Each plane towards its mean, and then back towards what it was, if it wasn't flattened wholly."""
    v, mean = F.col("v"), F.col("__mean")
    flat = v * (1 - flatness) + mean * flatness if flatness > 0.01 else v
    back: Column = flat * (1 - keep) + v * keep if keep > 0.01 and flatness < 0.99 else flat
    return sized(_with_mean(planes).withColumn("v", back))
