"""Masks and weight curves as expressions on coordinates; ``over`` lays one on a raster's grid as cells of band 0."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..layout import COLUMNS, clip, col, grid


def over(cells: DataFrame, mask: Column) -> DataFrame:
    """Cells of one band, 0, with the mask's value at every place of each raster (columns y, x, h, w)."""
    sizes = cells.groupBy("raster_id").agg(F.max("h").alias("h"), F.max("w").alias("w"))
    return grid(sizes).withColumns({"band": F.lit(0), "v": mask.cast("double")}).select(*COLUMNS)


def ramp(i: Column, n: Column, rising: bool = True) -> Column:
    """The i-th of n evenly spaced values from 0 to 1 (or back); a single one is where it starts."""
    up = F.when(n > 1, i / (n - 1)).otherwise(F.lit(0.0))
    return up if rising else F.when(n > 1, 1 - i / (n - 1)).otherwise(F.lit(1.0))


def gradient(axis: str = "x", symmetric: bool = True) -> Column:
    """0 to 1 along an axis; symmetric: up over the first half, then down over the rest."""
    i, n = F.col(axis), F.col("w" if axis == "x" else "h")
    half = F.floor(n / 2)
    return F.when(i < half, ramp(i, half)).otherwise(ramp(i - half, n - half, False)) if symmetric else ramp(i, n)


def blend(width: int, falloff: float = 0.5) -> Column:
    """1, but within half of ``width`` of each centre axis the distance to it, steeper for a small falloff."""
    half = width // 2

    def curve(axis: str, edge: str) -> Column:
        d = F.col(axis) - F.floor(F.col(edge) / 2)
        near = (d >= -half) & (d < half)
        return F.when(near, clip(F.abs(d) / half / max(0.001, falloff), 0, 1)).otherwise(F.lit(1.0)) if half else F.lit(1.0)

    return curve("x", "w") * curve("y", "h")


def seam(thickness: int) -> Column:
    """255 on the cross of the centre axes, ``thickness`` wide."""
    half = thickness // 2
    on = [(F.col(a) >= F.floor(F.col(e) / 2) - half) & (F.col(a) < F.floor(F.col(e) / 2) + half) for a, e in (("x", "w"), ("y", "h"))]
    return F.when(on[0] | on[1], 255.0).otherwise(0.0)


def smooth(t: Column) -> Column:
    return t * t * (3 - 2 * t)


def falloff(amount: float = 0.2, circular: bool = False) -> Column:
    """1 inside, 0 at the border of a box that turns into a disc (if ``circular``) as the amount grows; see ``smooth``."""
    if amount < 0.001:
        border = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("h") - 1) | (F.col("x") == F.col("w") - 1)
        return F.when(border, 0.0).otherwise(1.0)
    ny = (F.col("y") - F.col("h") / 2 + 0.5) / (F.col("h") / 2)
    nx = (F.col("x") - F.col("w") / 2 + 0.5) / (F.col("w") / 2)
    distance = F.greatest(F.abs(nx), F.abs(ny))
    if circular:
        round_ = min(1.0, max(0.0, (amount - 0.1) * 2))
        distance = distance * (1 - round_) + F.sqrt(nx * nx + ny * ny) * round_
    mask = smooth(clip((1 - distance) / max(0.005, amount), 0, 1))
    return F.pow(mask, F.lit(1 + (amount - 0.5) * 4)) if amount > 0.5 else mask


#: Angular harmonics of a patch's outline and their weights (fixed values).
HARMONICS = ((2, 1.0), (3, 0.6), (5, 0.35), (7, 0.2))


def splat(falloff: float | Column = 0.3, wobble: float | Column = 0.0, phases: list[Column] | None = None) -> Column:
    """Weight of a patch's cells: a soft disc, its outline deformed by harmonics at the given phases, heavier at the centre."""
    ny = (F.col("y") - (F.col("h") - 1) / 2) / (F.col("h") / 2)
    nx = (F.col("x") - (F.col("w") - 1) / 2) / (F.col("w") / 2)
    radius = F.sqrt(nx * nx + ny * ny)
    falloff, wobble = col(falloff), col(wobble)
    if phases:
        theta = F.atan2(ny, nx)
        bulge = sum((amp * F.sin(k * theta + p) for (k, amp), p in zip(HARMONICS, phases)), F.lit(0.0)) / sum(a for _, a in HARMONICS)
        radius = F.when(wobble > 0.001, radius * (1 + clip(wobble * 0.6 * bulge, -0.15, 0.5))).otherwise(radius)
    depth = clip(1 - radius, 0, 1)
    return smooth(clip(depth / F.greatest(F.lit(0.02), falloff), 0, 1)) * F.pow(depth, 8 * (1 - falloff) + 0.5 * falloff)


def splat_line(h: int, w: int, y: int, falloff: float, wobble: float, phases: list[float]) -> np.ndarray:
    """``splat`` of a patch's line y, as numbers."""
    ny, nx = (y - (h - 1) / 2) / (h / 2), (np.arange(w) - (w - 1) / 2) / (w / 2)
    radius = np.sqrt(nx * nx + ny * ny)
    if wobble > 0.001:
        theta = np.arctan2(ny, nx)
        bulge = sum(amp * np.sin(k * theta + p) for (k, amp), p in zip(HARMONICS, phases)) / sum(a for _, a in HARMONICS)
        radius = radius * (1 + np.clip(wobble * 0.6 * bulge, -0.15, 0.5))
    depth = np.clip(1 - radius, 0, 1)
    t = np.clip(depth / max(0.02, falloff), 0, 1)
    return t * t * (3 - 2 * t) * depth ** (8 * (1 - falloff) + 0.5 * falloff)


def seam_fade(i: Column, n: Column, falloff: float | Column) -> Column:
    """Weight of the far edge over an overlap of n cells: 1 at its start, 0 at its end, switched around the middle."""
    p, half = (i + 0.5) / n, 0.25 * col(falloff)
    return F.when(half <= 1e-6, F.when(p < 0.5, 1.0).otherwise(0.0)).otherwise(smooth(smooth(clip((0.5 + half - p) / F.greatest(2 * half, F.lit(1e-9)), 0, 1))))


def cosine_weight(i: Column, half: Column) -> Column:
    return (F.cos(i / half * math.pi) + 1) * 0.5


def linear_weight(d: Column, radius: Column) -> Column:
    return 0.5 * (1 - d / radius)


def feather_radius(h: Column, w: Column, strength: float | Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.least(h, w) * 0.16 * clip(strength, 0.1, 1))).cast("int")
