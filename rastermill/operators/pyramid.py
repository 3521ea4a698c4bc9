"""Mip pyramids: each level is made of the one before by area, in the way its kind of map needs.

On lines, a block is what one line of a level far up is made of: all levels up to there are made in the block's task, and
only the topmost ones are shuffled again. ``*_step`` are the same levels on cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..layout import bands_long, bands_wide, clip, saved
from . import scanlines
from .geometry import resize_area

#: Samples of a band in a block of lines, its last level's line alone taking as many as it must.
BLOCK = 1 << 18


def _halve(cells: DataFrame) -> DataFrame:
    return resize_area(cells, lambda e: F.greatest(F.lit(1), F.floor(F.col(e) / 2)))


def mip_levels(cells: DataFrame, step: Callable[[DataFrame], DataFrame], levels: int | None = None) -> DataFrame:
    """Levels 0 to ``levels`` with a column ``level``, each made of the one before; rasters of one cell add no further level.

    Without ``levels``, down to one cell. Each level but the last is saved for the next and for the result.
    """
    if levels is None:
        edge = cells.agg(F.max(F.greatest("h", "w"))).first()[0] or 1
        levels = int(edge).bit_length() - 1
    out, now = cells.withColumn("level", F.lit(0)), cells
    for level in range(1, levels + 1):
        now = step(now.where("h > 1 or w > 1"))
        now = saved(now) if level < levels else now
        out = out.unionByName(now.withColumn("level", F.lit(level)))
    return out


def scalar_step(cells: DataFrame) -> DataFrame:
    """Means, whole."""
    return _halve(cells).withColumn("v", F.rint("v"))


def color_step(rgba: DataFrame) -> DataFrame:
    """sRGB colour (0 to 255, alpha as band 3) averaged in linear light, weighed by alpha."""
    wide = bands_wide(rgba, 4).withColumn("b3", F.col("b3") / 255)
    wide = wide.withColumns({f"b{i}": color.srgb_to_linear(F.col(f"b{i}") / 255) * F.col("b3") for i in range(3)})
    small = bands_wide(_halve(bands_long(wide, 4)), 4)
    small = small.withColumns({f"b{i}": color.linear_to_srgb(F.col(f"b{i}") / F.greatest(F.col("b3"), F.lit(1e-6))) for i in range(3)})
    return bands_long(small.withColumns({f"b{i}": F.rint(clip(f"b{i}", 0, 1) * 255) for i in range(4)}), 4)


def normal_step(rgba: DataFrame) -> DataFrame:
    """Encoded normals (x, y, z, alpha) averaged as slopes and normalised again."""
    wide = bands_wide(rgba, 4)
    nz = F.greatest(F.col("b2") / 127.5 - 1, F.lit(1e-4))
    slopes = wide.withColumns({"b0": (F.col("b0") / 127.5 - 1) / nz, "b1": (F.col("b1") / 127.5 - 1) / nz, "b2": F.lit(1.0)})
    small = bands_wide(_halve(bands_long(slopes, 4)), 4)
    size = F.sqrt(F.col("b0") * F.col("b0") + F.col("b1") * F.col("b1") + 1)
    coded = {f"b{i}": F.rint(clip(F.col(f"b{i}") / size * 127.5 + 127.5, 0, 255)) for i in range(3)}
    return bands_long(small.withColumns(coded | {"b3": F.rint("b3")}), 4)


def _area(x: np.ndarray, n: int, m: int, s0: int, t0: int, t1: int) -> np.ndarray:
    """Samples t0 to t1 of the last axis of n shrunk to m by area, x being its samples from s0 on."""
    if n == m:
        return x[..., t0 - s0 : t1 - s0]
    if n == 2 * m:
        part = x[..., 2 * t0 - s0 : 2 * t1 - s0]
        return (part[..., ::2] + part[..., 1::2]) / 2
    a, b = np.arange(t0, t1) * n / m, np.arange(t0 + 1, t1 + 1) * n / m
    first, out = np.floor(a + 1e-9).astype(np.int64), 0.0
    for i in range(math.ceil(n / m) + 1):
        k = np.clip(np.minimum(b, first + i + 1) - np.maximum(a, first + i), 0, None) * m / n
        out = out + k * x[..., np.clip(first + i - s0, 0, x.shape[-1] - 1)]
    return out


def _half(x: np.ndarray, h: int, w: int, s0: int, t0: int, t1: int) -> np.ndarray:
    """Lines t0 to t1 of the next level of lines of h by w, x being those from s0 on.

    Of even sizes four samples are added one by one, as a mean by grouping does it: where that rounds to the same whole
    number in every order of the four, sums of two pairs may still fall on the other side of a half.
    """
    h1, w1 = max(1, h // 2), max(1, w // 2)
    if h == 2 * h1 and w == 2 * w1:
        part = x[..., 2 * t0 - s0 : 2 * t1 - s0, :]
        up, down = part[..., ::2, :], part[..., 1::2, :]
        return (up[..., ::2] + up[..., 1::2] + down[..., ::2] + down[..., 1::2]) / 4
    along = _area(x, w, w1, 0, 0, w1)
    return _area(along.swapaxes(-1, -2), h, h1, s0, t0, t1).swapaxes(-1, -2)


def _scalar(x: np.ndarray, shrink: Callable) -> np.ndarray:
    return np.rint(shrink(x))


def _color(x: np.ndarray, shrink: Callable) -> np.ndarray:
    """(rasters, bands, lines, samples): sRGB and alpha, 0 to 255."""
    c, a = x[:, :3] / 255, x[:, 3:4] / 255
    small = shrink(np.concatenate([np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4) * a, a], axis=1))
    c = np.clip(small[:, :3] / np.maximum(small[:, 3:4], 1e-6), 0, 1)
    coded = np.where(c <= 0.0031308, c * 12.92, 1.055 * c ** (1 / 2.4) - 0.055)
    return np.rint(np.clip(np.concatenate([coded, small[:, 3:4]], axis=1), 0, 1) * 255)


def _normal(x: np.ndarray, shrink: Callable) -> np.ndarray:
    """(rasters, bands, lines, samples): encoded x, y, z and alpha."""
    z = np.maximum(x[:, 2:3] / 127.5 - 1, 1e-4)
    small = shrink(np.concatenate([(x[:, :2] / 127.5 - 1) / z, np.ones_like(z), x[:, 3:4]], axis=1))
    size = np.sqrt(small[:, :1] ** 2 + small[:, 1:2] ** 2 + 1)
    return np.rint(np.concatenate([np.clip(small[:, :3] / size * 127.5 + 127.5, 0, 255), small[:, 3:4]], axis=1))


LINE_STEPS = {"normal": _normal, "basecolor": _color, "base color": _color}


def cones(h: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level from 0 to k the lines [low, high) that each line of level k is made of."""
    edges = [max(1, h >> i) for i in range(k + 1)]
    low, high = np.arange(edges[k]), np.arange(edges[k]) + 1
    out = [(low, high)]
    for i in range(k, 0, -1):
        low, high = low * edges[i - 1] // edges[i], -(-high * edges[i - 1] // edges[i])
        out.append((low, high))
    return out[::-1]


def _levels(state: DataFrame, step: Callable) -> DataFrame:
    """The next levels of lines with columns level and __left (levels to go), as many as fit a block."""
    kind = dict(state.dtypes)["raster_id"]
    fit = F.length(F.bin(F.greatest(F.lit(2), F.floor(BLOCK / F.col("w"))).cast("long"))) - 1
    state = state.withColumn("__k", F.least(F.col("__left"), fit).cast("int"))

    def deal(batches):
        for batch in batches:
            y, h, k = (scanlines._ints(batch, c) for c in ("y", "h", "__k"))
            which, block = [], []
            for rows in scanlines._alike(h, k):
                low, high = cones(int(h[rows[0]]), int(k[rows[0]]))[0]
                a, b = np.searchsorted(high, y[rows], "right"), np.searchsorted(low, y[rows], "right")
                which.append(np.repeat(rows, b - a))
                block.append(np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a))
            if which:
                take = pa.array(np.concatenate(which))
                yield pa.RecordBatch.from_arrays([*[c.take(take) for c in batch.columns], pa.array(np.concatenate(block).astype(np.int32))], [*batch.schema.names, "__block"])

    keys = ["raster_id", "h", "w", "level", "__left", "__k"]
    dealt = state.select(*keys, "band", "y", "data").mapInArrow(deal, f"raster_id {kind}, h int, w int, level int, __left int, __k int, band int, y int, data array<double>, __block int")
    blocks = dealt.groupBy(*keys, "__block").agg(F.array_sort(F.collect_list(F.struct("band", "y", "data"))).alias("rows"))

    def make(batches):
        for batch in batches:
            rows, own = batch.column("rows"), [scanlines._ints(batch, c) for c in (*keys[1:], "__block")]
            count = np.diff(rows.offsets.to_numpy())
            flat, first = rows.flatten(), np.r_[0, np.cumsum(count)][:-1]
            bands, got = flat.field("band").to_numpy(), scanlines._Batch(flat.field("data"), np.repeat(own[1], count))
            out = []
            for which in scanlines._alike(*own, count):
                h, w, level, left, k, block = (int(o[which[0]]) for o in own)
                cone = cones(h, k)
                s0, s1 = (int(e[block]) for e in cone[0])
                n = count[which[0]] // (s1 - s0)
                band = bands[first[which[0]] : first[which[0]] + count[which[0]] : s1 - s0]
                x = got.rows((first[which][:, None] + np.arange(count[which[0]])).ravel()).reshape(len(which), n, s1 - s0, w)
                for i in range(1, k + 1):
                    h1, w1 = max(1, h // 2), max(1, w // 2)
                    t0, t1 = (int(e[block]) for e in cone[i])
                    x = step(x, lambda v: _half(v, h, w, s0, t0, t1))  # noqa: B023
                    h, w, s0 = h1, w1, t0
                    # a block's own lines of a level are those that its line of the last level covers
                    a, b = -(-block * h // len(cone[k][0])), -(-(block + 1) * h // len(cone[k][0]))
                    out.append((which, h, w, level + i, left - i, i == k, band, a, x[:, :, a - t0 : b - t0]))
            if not out:
                continue
            take = np.concatenate([np.repeat(o[0], len(o[6]) * (o[8].shape[2])) for o in out])
            per = lambda f: np.concatenate([f(o) for o in out])
            many = lambda i: per(lambda o: np.full(o[8].shape[0] * o[8].shape[1] * o[8].shape[2], int(o[i]), np.int32))
            band = per(lambda o: np.tile(np.repeat(o[6], o[8].shape[2]), len(o[0]))).astype(np.int32)
            y = per(lambda o: np.tile(np.arange(o[7], o[7] + o[8].shape[2]), len(o[0]) * len(o[6]))).astype(np.int32)
            widths = many(2)
            data = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(widths)], pa.int32()), pa.array(per(lambda o: o[8].ravel())))
            columns = [batch.column("raster_id").take(pa.array(take)), many(1), widths, many(3), many(4), many(5), band, y]
            yield pa.RecordBatch.from_arrays([*[c if isinstance(c, pa.Array) else pa.array(c) for c in columns], data], ["raster_id", "h", "w", "level", "__left", "__last", "band", "y", "data"])

    return blocks.mapInArrow(make, f"raster_id {kind}, h int, w int, level int, __left int, __last int, band int, y int, data array<double>")


def mip_lines(lines: DataFrame, map_name: str, levels: int | None = None) -> DataFrame:
    """Lines of all levels of a map's pyramid, with a column level from 0; down to one cell unless ``levels`` says otherwise.

    Colour and normals need four bands. Each round makes as many levels as a block holds and writes them; lines are
    shuffled once a round, those at the border of two blocks of an odd size twice.
    """
    step = LINE_STEPS.get(map_name.lower(), _scalar)
    whole = F.length(F.bin(F.greatest("h", "w").cast("long"))) - 1
    ints = {c: F.col(c).cast("int") for c in ("h", "w", "band", "y")}
    state = lines.select(*scanlines.LINE).withColumns(ints | {"level": F.lit(0), "__left": (whole if levels is None else F.least(whole, F.lit(levels))).cast("int")})
    out, columns = state.select(*scanlines.LINE, "level"), [*scanlines.LINE, "level"]
    state = state.where("__left > 0")
    while not state.isEmpty():
        made = saved(_levels(state, step))
        out = out.unionByName(made.select(*columns))
        state = made.where("__last = 1 AND __left > 0").drop("__last")
    return out


def mipmaps(cells: DataFrame, map_name: str, levels: int | None = None) -> DataFrame:
    """Cells of the pyramid of a map by its name, with a column level (see ``mip_lines``)."""
    lines = mip_lines(scanlines.from_cells(cells), map_name, levels)
    return lines.select("raster_id", "h", "w", "band", "y", F.posexplode("data").alias("x", "v"), "level")


#: The same levels on cells.
STEPS = {"normal": normal_step, "basecolor": color_step, "base color": color_step}
