"""Seam blending: a cell and its mirror across a centre axis meet in one aggregation on the pair, not in a self-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..layout import COLUMNS, clip
from . import masks
from .geometry import resize_wrapped


def _paired(cells: DataFrame, axis: str, pair: Column, weight: Column, active: Column) -> DataFrame:
    """v of each active cell mixed with its partner's, the other cell of the same pair number, by weight.

    Both cells of a pair meet in a hash aggregation, and leave it as two rows again; a cell that has no partner stays.
    """
    other = "y" if axis == "x" else "x"
    side = F.col(axis) >= F.floor(F.col("w" if axis == "x" else "h") / 2)
    keyed = cells.withColumns({"__pair": pair.cast("int"), "__k": F.when(active, weight).otherwise(0.0)})
    of = lambda c, right: F.max(F.when(side == right, F.col(c)))
    met = keyed.groupBy("raster_id", "h", "w", "band", other, "__pair").agg(*[of(c, r).alias(f"{c}{int(r)}") for c in (axis, "v", "__k") for r in (False, True)])
    mixed = lambda own, mate: F.when(F.col(f"{axis}{mate}").isNull(), F.col(f"v{own}")).otherwise(F.col(f"v{own}") * (1 - F.col(f"__k{own}")) + F.col(f"v{mate}") * F.col(f"__k{own}"))
    both = F.explode(F.array(*[F.struct(F.col(f"{axis}{own}").alias("p"), mixed(own, 1 - own).alias("v")) for own in (0, 1)]))
    return met.withColumn("cell", both).where("cell.p is not null").select("raster_id", "h", "w", "band", *[F.col("cell.p").alias("x") if c == axis and axis == "x" else F.col("cell.p").alias("y") if c == axis else F.col(c) for c in ("y", "x")], "cell.v")


def linear_crossfade(cells: DataFrame, strength: float = 1.0) -> DataFrame:
    """Both sides of the centre axes faded into each other by linear weights, columns first; clipped to 0..255.

    Mixing never leaves the range of what is mixed, so rasters from 0 to 1 need no bound of their own.
    """
    radius = masks.feather_radius(F.col("h"), F.col("w"), strength)
    for axis, edge in (("x", "w"), ("y", "h")):
        centre = F.floor(F.col(edge) / 2)
        d = F.when(F.col(axis) >= centre, F.col(axis) - centre).otherwise(centre - 1 - F.col(axis))
        cells = _paired(cells, axis, d, masks.linear_weight(d, radius), d < radius)
    return cells.withColumn("v", clip("v", 0, 255)).select(*COLUMNS)


def half_width(strength: float = 0.5, fixed: int | None = None) -> Column:
    """Cells on each side of a centre axis that are blended."""
    width = F.lit(int(fixed * 1.5)) if fixed is not None else F.floor(F.floor(F.least("h", "w") / 2) * strength)
    return F.when(width < 2, 0).otherwise(F.floor(width / 2)).cast("int")


def _ring(axis: str, edge: str) -> tuple[Column, Column]:
    """Signed distance to the centre axis around the wrap, and its amount."""
    centre = F.floor(F.col(edge) / 2)
    d = F.col(axis) - centre
    return d, F.abs(d)


def blend_symmetric(cells: DataFrame, strength: float = 0.5, fixed: int | None = None, one_sided: bool = False) -> DataFrame:
    """Cells at equal distance on both sides of the centre axes mixed by cosine weights, columns and then rows.

    one_sided: only the left and upper cells change. A blend width below 2 changes nothing. Half widths stay below half
    the edge, so partners never wrap onto each other.
    """
    for axis, edge in (("x", "w"), ("y", "h")):
        d, size = _ring(axis, edge)
        half = half_width(strength, fixed)
        weight = masks.cosine_weight(size, half)
        if one_sided:
            weight = F.when(d < 0, weight).otherwise(0.0)
        cells = _paired(cells, axis, size, weight, (size >= 1) & (size <= half))
    return cells


def blend_with_original(cells: DataFrame, original: DataFrame, strength: float = 0.5, fixed: int | None = None) -> DataFrame:
    """Near the centre axes the other raster's cells take over by distance; rows overwrite columns."""
    met = cells.join(original.select("raster_id", "band", "y", "x", F.col("v").alias("__o")), ["raster_id", "band", "y", "x"])
    half, out = half_width(strength, fixed), F.col("v")
    for axis, edge in (("x", "w"), ("y", "h")):
        _, size = _ring(axis, edge)
        weight = masks.cosine_weight(size, half)
        out = F.when((size >= 1) & (size <= half), F.col("v") * weight + F.col("__o") * (1 - weight)).otherwise(out)
    return met.withColumn("v", out).select(*COLUMNS)


def overlap_synthesis(cells: DataFrame, x: float = 0.2, y: float = 0.2, falloff: float = 0.5) -> DataFrame:
    """The far edge laid over the near one, joined by ``masks.seam_fade``, cut off, and the rest resized across the wrap."""
    if max(x, y) > 0.5:
        raise ValueError("an overlap is at most half the edge")
    cells = cells.select(*COLUMNS, F.col("h").alias("__h"), F.col("w").alias("__w"))
    for axis, edge, share in (("x", "w", x), ("y", "h", y)):
        n = F.floor(F.col(edge) * share)
        near, far = F.col(axis) < n, F.col(axis) >= F.col(edge) - n
        place = F.when(near, F.col(axis)).when(far, F.col(axis) - F.col(edge) + n)
        other = "y" if axis == "x" else "x"
        pair = Window.partitionBy("raster_id", "band", other, "__place")
        keyed = cells.withColumn("__place", place).withColumn("__mate", F.sum(F.when(far, F.col("v"))).over(pair))
        weight = masks.seam_fade(F.col(axis), n, falloff)
        keyed = keyed.withColumn("v", F.when(near, F.col("v") * (1 - weight) + F.col("__mate") * weight).otherwise(F.col("v")))
        kept = keyed.where(F.col(axis) < F.col(edge) - n).withColumn(edge, (F.col(edge) - n).cast("int"))
        cells = kept.select(*COLUMNS, "__h", "__w")
    # the sizes to return to ride along as the raster's key
    keyed = cells.withColumn("raster_id", F.struct("raster_id", "__h", "__w"))
    out = resize_wrapped(keyed, lambda e: F.col(f"raster_id.__{e}"))
    return out.select("raster_id.raster_id", "h", "w", "band", "y", "x", clip("v", 0, 255).alias("v"))


def alpha_blend(base: DataFrame, top: DataFrame, alpha: DataFrame) -> DataFrame:
    """base (1 - alpha) + top alpha; alpha cells (raster_id, y, x, v) hold for all bands, and above 1 are out of 255."""
    weight = alpha.select("raster_id", "y", "x", F.col("v").alias("__a"))
    largest = alpha.groupBy("raster_id").agg(F.max("v").alias("__most"))
    met = base.join(top.select("raster_id", "band", "y", "x", F.col("v").alias("__t")), ["raster_id", "band", "y", "x"]).join(weight, ["raster_id", "y", "x"]).join(largest, "raster_id")
    a = F.col("__a") / F.when(F.col("__most") > 1, 255.0).otherwise(1.0)
    return met.withColumn("v", F.col("v") * (1 - a) + F.col("__t") * a).select(*COLUMNS)


def pack_bands(maps: DataFrame, bands: dict[int, str | None]) -> DataFrame:
    """Bands of one raster from maps (cells with a column ``map``, band 0): {band: map, or None for zeros}.

    One pass: a map's cells take the band numbers that show it, and zeros are made on the grid of any map.
    """
    spots = F.array(*[F.struct(F.lit(m).alias("map"), F.lit(b).alias("band")) for b, m in bands.items() if m])
    shown = maps.where("band = 0").withColumn("spot", F.explode(F.filter(spots, lambda s: s["map"] == F.col("map"))))
    out = shown.select("raster_id", "h", "w", "spot.band", "y", "x", "v")
    for b in (b for b, m in bands.items() if not m):
        out = out.unionByName(maps.select("raster_id", "h", "w", F.lit(b).alias("band"), "y", "x", F.lit(0.0).alias("v")).distinct())
    return out

