"""Patch synthesis: placements on a jittered grid, a bank of patches, weighted sums and ordered layers.

Patches are laid on blocks of a raster's lines: each line of a patch goes once to a block that it falls on, however many
placements put it there, and meets them within the task, where they are summed. Layers go to the line that they fall on and
are laid over each other in order. No sample is a row by itself.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..layout import COLUMNS, col, saved, sized
from . import masks, scanlines
from .geometry import resize_area, rotate

#: Distance of placements in patch edges, jitter in cells of the grid, and bytes of a bank (fixed values).
SPACING, JITTER, BANK_BYTES = 0.40, 0.4, 64 << 20


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts: the same on every machine and in every order of rows."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


Amount = float | Column


def placements(rasters: DataFrame, patch_h: int | Column, patch_w: int | Column, variants: int | Column, seed: int | Column = 0) -> DataFrame:
    """Rows (raster_id, splat_id, top, left, patch_id) that cover each raster (raster_id, h, w); sizes of patches may differ by raster."""
    patch_h, patch_w, variants, seed = map(col, (patch_h, patch_w, variants, seed))
    cells = {n: F.greatest(F.lit(1), F.ceil(F.col(e) / F.greatest(F.lit(1.0), p * SPACING))).cast("int") for n, e, p in (("nx", "w", patch_w), ("ny", "h", patch_h))}
    at = rasters.withColumns({"__ph": patch_h, "__pw": patch_w, "__n": variants, "__seed": seed} | cells)
    at = at.withColumn("splat_id", F.explode(F.sequence(F.lit(0), F.col("nx") * F.col("ny") - 1)))
    gy, gx = F.floor(F.col("splat_id") / F.col("nx")), F.col("splat_id") % F.col("nx")
    cell_h, cell_w = F.col("h") / F.col("ny"), F.col("w") / F.col("nx")
    name = F.col("raster_id.raster_id") if "struct<" in dict(rasters.dtypes)["raster_id"] else F.col("raster_id")
    u = lambda salt: uniform(F.col("__seed"), name, F.col("splat_id"), F.lit(salt))
    top = F.rint((gy + 0.5) * cell_h + (u("y") - 0.5) * cell_h * JITTER - F.col("__ph") / 2)
    left = F.rint((gx + 0.5) * cell_w + (u("x") - 0.5) * cell_w * JITTER - F.col("__pw") / 2)
    return at.select("raster_id", "splat_id", top.cast("int").alias("top"), left.cast("int").alias("left"), F.floor(u("patch") * F.col("__n")).cast("int").alias("patch_id"))


def patch_edge(n: Column, scale: Amount) -> Column:
    """Edge of a raster's patches: its own times scale, 8 at least."""
    return F.greatest(F.lit(8), F.rint(n * scale)).cast("int")


def variants(patch_h: Column, patch_w: Column, bands: Column, rand_rot: Amount, wobble: Amount, preview: bool = False) -> Column:
    """One patch if all would be equal, else as many as the bank's bytes allow, from 4 to 12 (preview) or 24."""
    fit = F.floor(BANK_BYTES / F.greatest(F.lit(1), patch_h * patch_w * bands * 4))
    return F.when((col(rand_rot) < 0.01) & (col(wobble) <= 0.001), 1).otherwise(F.least(F.lit(12 if preview else 24), F.greatest(F.lit(4), fit))).cast("int")


def banks(cells: DataFrame, scale: Amount, rand_rot: Amount, wobble: Amount, count: int | None = None) -> DataFrame:
    """One row for each raster: its size (h, w) and that of its bank (ph, pw, n)."""
    sizes = cells.groupBy("raster_id").agg(F.max("h").alias("h"), F.max("w").alias("w"), (F.max("band") + 1).alias("bands"))
    sizes = sizes.withColumns({"ph": patch_edge(F.col("h"), scale), "pw": patch_edge(F.col("w"), scale)})
    return sizes.withColumn("n", F.lit(count) if count else variants(F.col("ph"), F.col("pw"), F.col("bands"), rand_rot, wobble)).drop("bands")


def patch_bank(cells: DataFrame, scale: Amount = 1.0, rotation: Amount = 0.0, rand_rot: Amount = 0.0, wobble: Amount = 0.2, falloff: Amount = 0.2, seed: int | Column = 0, count: int | None = None) -> DataFrame:
    """Rows (raster_id, patch_id, py, px, band, v, alpha): shrunk, turned copies of each raster with a mask for each.

    Sizes and numbers of patches follow from each raster's own size. Amounts may be columns of the raster's key; a
    variant's angle and outline come from hashes of seed and number. All variants are turned in one plan.
    """
    rotation, rand_rot, seed = map(col, (rotation, rand_rot, seed))
    base = saved(resize_area(cells, lambda e: patch_edge(F.col(e), scale)))
    bank = banks(cells, scale, rand_rot, wobble, count).select("raster_id", "n")
    i = F.col("patch_id")
    angle = rotation + F.when((rand_rot >= 0.01) & (F.col("n") > 1), (uniform(seed, i, F.lit("angle")) * 2 - 1) * 180 * rand_rot).otherwise(0.0)
    each = base.join(bank, "raster_id").withColumn("patch_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("angle", F.when(F.abs(angle) > 0.05, angle).otherwise(0.0))
    keyed = each.withColumn("raster_id", F.struct("raster_id", "patch_id", "angle")).select(*COLUMNS)
    turned = rotate(keyed.where("raster_id.angle <> 0"), F.col("raster_id.angle")).unionByName(keyed.where("raster_id.angle = 0"))
    turned = turned.withColumns({"patch_id": F.col("raster_id.patch_id"), "raster_id": F.col("raster_id.raster_id")})
    mask = masks.splat(falloff, wobble, [uniform(seed, i, F.lit(f"phase{k}")) * 6.283185307179586 for k, _ in masks.HARMONICS])
    return turned.select("raster_id", "patch_id", F.col("y").alias("py"), F.col("x").alias("px"), "band", "v", mask.alias("alpha"))


def patch_lines(patches: DataFrame) -> DataFrame:
    """Rows (raster_id, patch_id, band, py, v, alpha), v and alpha the arrays of a patch's line, of its samples."""
    line = F.array_sort(F.collect_list(F.struct("px", "v", "alpha")))
    lines = patches.groupBy("raster_id", "patch_id", "band", "py").agg(line.alias("line"))
    return lines.select("raster_id", "patch_id", "band", "py", F.col("line.v").alias("v"), F.col("line.alpha").alias("alpha"))


class _Laid:
    """Arrow lists ``laid`` of (n, band, a, b, c, v, alpha), one for each block of lines, as flat arrays.

    n = 0: line b of patch a; n = 1: the canvas's line a; n = 2: patch a put at top b, left c.
    """

    def __init__(self, batch: pa.RecordBatch):
        laid = batch.column("laid")
        count, flat = np.diff(laid.offsets.to_numpy()), laid.flatten()
        self.h, self.w, self.group = scanlines._ints(batch, "h"), scanlines._ints(batch, "w"), np.repeat(np.arange(batch.num_rows), count)
        self.n, self.band, self.a, self.b, self.c = (flat.field(f).to_numpy().astype(np.int64) for f in ("n", "band", "a", "b", "c"))
        v, alpha = flat.field("v"), flat.field("alpha")
        self.long = np.diff(v.offsets.to_numpy())
        self.first, self.alpha_first = (x.offsets.to_numpy()[:-1] - x.offsets.to_numpy()[0] for x in (v, alpha))
        self.v, self.alpha = (x.flatten().to_numpy(zero_copy_only=False) for x in (v, alpha))

    def planes(self) -> tuple[np.ndarray, np.ndarray]:
        """Block and band of each plane that has patches or a canvas."""
        of = self.n < 2
        found = np.unique(np.stack([self.group[of], self.band[of]]), axis=1)
        return found[0], found[1]

    def sums(self, planes: np.ndarray, band: np.ndarray, start: np.ndarray, y0: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Total, weight and canvas of all planes' samples; start, y0, rows: of each plane its first sample, first line and number of lines."""
        many = int(self.band[self.n < 2].max(initial=0)) + 1
        plane = lambda i: np.searchsorted(planes * many + band, self.group[i] * many + self.band[i])
        total, weight, base = (np.zeros(start[-1]) for _ in range(3))
        own = np.flatnonzero(self.n == 1)
        p = plane(own)
        at, sample, _ = self._samples(own, start[p] + (self.a[own] - y0[p]) * self.w[self.group[own]], np.zeros(len(own), np.int64))
        base[at] = self.v[sample]
        lines, spots = np.flatnonzero(self.n == 0), np.flatnonzero(self.n == 2)
        most = int(self.a[self.n != 1].max(initial=0)) + 1
        spots = spots[np.argsort(self.group[spots] * most + self.a[spots], kind="stable")]
        key, of = self.group[spots] * most + self.a[spots], self.group[lines] * most + self.a[lines]
        low, high = np.searchsorted(key, of), np.searchsorted(key, of, "right")
        line = np.repeat(lines, high - low)
        spot = spots[np.repeat(low, high - low) + np.arange(len(line)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)]
        p, y = plane(line), (self.b[spot] + self.b[line]) % self.h[self.group[line]]
        inside = (y >= y0[p]) & (y < y0[p] + rows[p])
        line, spot, p, y = line[inside], spot[inside], p[inside], y[inside]
        at, sample, cover = self._samples(line, start[p] + (y - y0[p]) * self.w[self.group[line]], self.c[spot])
        k = self.alpha[cover]
        on = k > 1e-7
        at, k = at[on], k[on]
        total += np.bincount(at, self.v[sample[on]] * k, minlength=len(total))
        weight += np.bincount(at, k, minlength=len(weight))
        return total, weight, base

    def _samples(self, which: np.ndarray, start: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all samples of the items ``which``: where they fall, from ``start`` of a line and ``left`` on it, and places of v and alpha."""
        long = self.long[which]
        inside = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
        at = np.repeat(start, long) + (np.repeat(left, long) + inside) % np.repeat(self.w[self.group[which]], long)
        return at, np.repeat(self.first[which], long) + inside, np.repeat(self.alpha_first[which], long) + inside


def _summed(placed: DataFrame, lines: DataFrame, sizes: DataFrame, canvas: DataFrame | None, end: Callable, names: list[str]) -> DataFrame:
    """Lines with arrays ``names``: ``end`` of the total and weight of what falls on each sample and of the canvas's own (0 without one).

    sizes: (raster_id, h, w, ph), ph the height of the raster's patches. Patch lines, canvas and placements meet by blocks of
    the raster's lines, all bands together: a patch's line is shuffled to the blocks that its placements put it on.
    """
    kind = dict(lines.dtypes)["raster_id"]
    size = F.greatest(F.lit(scanlines.LEAST), F.floor(scanlines.BLOCK / F.col("w"))).cast("int")
    sizes = sizes.select("raster_id", *[F.col(c).cast("int").alias(c) for c in ("h", "w", "ph")]).withColumn("size", size)
    block = lambda y: F.floor(F.pmod(y, F.col("h")) / F.col("size")).cast("int")
    keys = ["raster_id", "h", "w", "size", "block"]
    none = F.array().cast("array<double>")

    def item(n: int, band, a, b, c, v: Column = none, alpha: Column = none) -> Column:
        ints = [col(x).cast("int").alias(name) for name, x in zip(("n", "band", "a", "b", "c"), (n, band, a, b, c))]
        return F.struct(*ints, v.alias("v"), alpha.alias("alpha")).alias("laid")

    spots = placed.join(sizes, "raster_id")
    on = F.when(F.col("h") <= F.col("size"), F.array(F.lit(0))).otherwise(F.array_distinct(F.transform(F.sequence(F.col("top"), F.col("top") + F.col("ph") - 1), block)))
    parts = spots.withColumn("block", F.explode(on)).select(*keys, item(2, 0, "patch_id", "top", "left"))
    # where a patch is put, by which its lines find their blocks
    tops = spots.groupBy("raster_id", "patch_id", "h", "w", "size").agg(F.collect_set("top").alias("tops"))
    to = F.when(F.col("h") <= F.col("size"), F.array(F.lit(0))).otherwise(F.array_distinct(F.transform("tops", lambda t: block(t + F.col("py")))))
    parts = parts.unionByName(scanlines.dealt(lines, "raster_id", "patch_id").join(tops, ["raster_id", "patch_id"]).withColumn("block", F.explode(to)).select(*keys, item(0, "band", "patch_id", "py", 0, F.col("v"), F.col("alpha"))))
    if canvas is not None:
        under = canvas.withColumns({"h": F.col("h").cast("int"), "w": F.col("w").cast("int")}).withColumn("size", size).withColumn("block", block(F.col("y")))
        parts = parts.unionByName(under.select(*keys, item(1, "band", "y", 0, 0, F.col("data"))))
    gathered = scanlines.dealt(parts, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list("laid")).alias("laid"))

    def held(batch: pa.RecordBatch) -> np.ndarray:
        """Samples that a block's placements lay, about: those of its patch lines, by placements of a patch, and its own."""
        laid = batch.column("laid")
        start, flat = laid.offsets.to_numpy(), laid.flatten()
        n, long = flat.field("n").to_numpy(), np.diff(flat.field("v").offsets.to_numpy())
        of = lambda x: np.diff(np.r_[0, np.cumsum(x)][start - start[0]])
        return of(long) * (1 + of(n == 2) // np.maximum(1, of((n == 2) & (np.r_[-1, flat.field("a").to_numpy()[:-1]] != flat.field("a").to_numpy()))))

    def run(batches):
        for batch in scanlines._bounded(batches, held):
            own = _Laid(batch)
            planes, band = own.planes()
            h, w, size, block = (scanlines._ints(batch, c)[planes] for c in ("h", "w", "size", "block"))
            rows = np.minimum(size, h - block * size)
            start, y0 = np.r_[0, np.cumsum(rows * w)], block * size
            total, weight, base = own.sums(planes, band, start, y0, rows)
            of = np.repeat(np.arange(len(planes)), rows)
            take = pa.array(planes[of])
            y = y0[of] + np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)
            offsets = pa.array(np.r_[0, np.cumsum(w[of])], pa.int32())
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in end(total, weight, base)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in ("raster_id", "h", "w")], pa.array(band[of], pa.int32()), pa.array(y, pa.int32()), *arrays], ["raster_id", "h", "w", "band", "y", *names])

    return gathered.mapInArrow(run, f"raster_id {kind}, h int, w int, band int, y int, " + ", ".join(f"{n} array<double>" for n in names))


def accumulate_lines(placed: DataFrame, lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """``accumulate`` on patch lines (raster_id, patch_id, band, py, v, alpha), as lines with arrays total and weight."""
    return _summed(placed, lines, sizes, None, lambda total, weight, base: (total, weight), ["total", "weight"])


def accumulate(placed: DataFrame, patches: DataFrame, rasters: DataFrame) -> DataFrame:
    """Rows (raster_id, band, y, x, total, weight): commutative weighted sums of all patch cells on the wrapped raster."""
    lines = saved(patch_lines(patches))
    high = lines.groupBy("raster_id").agg((F.max("py") + 1).alias("ph"))
    sums = accumulate_lines(placed, lines, rasters.select("raster_id", "h", "w").join(high, "raster_id"))
    return scanlines.split_cells(sums, ["total", "weight"]).where("weight > 0").drop("h", "w")


def lay(placed: DataFrame, lines: DataFrame, canvas: DataFrame, sizes: DataFrame, least: float = 1e-9) -> DataFrame:
    """Lines of the canvas with arrays data, the weighted means of the patch lines on it, and weight; see ``_summed``.

    Where patches have no more weight than ``least``, data is the canvas's own.
    """
    mean = lambda total, weight, base: (np.where(weight > least, total / np.maximum(weight, least), base), weight)
    return _summed(placed, lines, sizes, canvas, mean, ["data", "weight"])


def resolve(sums: DataFrame, canvas: DataFrame) -> DataFrame:
    """Weighted means, and the canvas's own cell where hardly any patch lies."""
    met = canvas.join(sums, ["raster_id", "band", "y", "x"], "left")
    return sized(met.withColumn("v", F.when(F.col("weight") > 1e-9, F.col("total") / F.col("weight")).otherwise(F.col("v"))))


class _Layers:
    """Arrow lists ``laid`` of (n, left, v, alpha), one for each line of a raster, as flat arrays."""

    def __init__(self, batch: pa.RecordBatch):
        self.w = scanlines._ints(batch, "w")
        laid = batch.column("laid")
        count, flat = np.diff(laid.offsets.to_numpy()), laid.flatten()
        self.group, self.n, left = np.repeat(np.arange(len(self.w)), count), flat.field("n").to_numpy(), flat.field("left").to_numpy()
        self.start = np.r_[0, np.cumsum(self.w)]
        v = flat.field("v")
        self.long = np.diff(v.offsets.to_numpy())
        self.first = np.r_[0, np.cumsum(self.long)][:-1]
        inside = np.arange(self.long.sum()) - np.repeat(self.first, self.long)
        self.at = np.repeat(self.start[self.group], self.long) + (np.repeat(left, self.long) + inside) % np.repeat(self.w[self.group], self.long)
        self.v, self.alpha = v.flatten().to_numpy(zero_copy_only=False), flat.field("alpha").flatten().to_numpy(zero_copy_only=False)

    def lists(self, flat: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.start, pa.int32()), pa.array(flat))


def over(layers: DataFrame, canvas: DataFrame) -> DataFrame:
    """Layers (raster_id, splat_id, band, y, left, alpha, v), alpha and v lines, laid over the canvas's lines in the order of splat_id.

    Samples of an alpha below 0.001 are skipped. A layer is no wider than its raster.
    """
    kind = dict(canvas.dtypes)["raster_id"]
    keys = ["raster_id", "h", "w", "band", "y"]
    under = canvas.select("raster_id", *[F.col(c).cast("int").alias(c) for c in keys[1:]], F.struct(F.lit(-1).cast("long").alias("n"), F.lit(0).alias("left"), F.col("data").alias("v"), F.col("data").alias("alpha")).alias("laid"))
    sizes = canvas.groupBy("raster_id").agg(F.max("h").cast("int").alias("h"), F.max("w").cast("int").alias("w"))
    upper = layers.join(sizes, "raster_id").select("raster_id", "h", "w", F.col("band").cast("int").alias("band"), F.col("y").cast("int").alias("y"), F.struct(F.col("splat_id").cast("long").alias("n"), F.col("left").cast("int").alias("left"), "v", "alpha").alias("laid"))
    gathered = under.unionByName(upper).groupBy(*keys).agg(F.array_sort(F.collect_list("laid")).alias("laid"))

    def run(batches):
        for batch in batches:
            own = _Layers(batch)
            data = np.zeros(own.start[-1])
            # the line itself comes first; the n-th layers of all lines are laid at once
            depth = np.arange(len(own.group)) - np.searchsorted(own.group, own.group)
            level = np.repeat(depth, own.long)
            for i in range(int(depth.max(initial=-1)) + 1):
                on = level == i
                at, v, a = own.at[on], own.v[on], own.alpha[on]
                if not i:
                    data[at] = v
                else:
                    at, v, a = at[a >= 0.001], v[a >= 0.001], a[a >= 0.001]
                    data[at] = (1 - a) * data[at] + a * v
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], own.lists(data)], scanlines.LINE)

    return gathered.mapInArrow(run, f"raster_id {kind}, h int, w int, band int, y int, data array<double>")


def gaussian_layers(lines: DataFrame, placed: DataFrame, patch: int, wrap: bool = True) -> DataFrame:
    """Layers of square patches cut from each raster: placements (raster_id, splat_id, top, left, py0, px0) with a Gaussian alpha.

    Without wrap, what lies beyond the border is left out.
    """
    far = patch / 4
    spread = placed.withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(patch - 1))))
    sizes = lines.groupBy("raster_id").agg(F.max("h").alias("h"), F.max("w").alias("w"))
    at = spread.join(sizes, "raster_id").withColumns({"ty": F.col("top") + F.col("dy"), "y": F.pmod(F.col("py0") + F.col("dy"), F.col("h")).cast("int")})
    if not wrap:
        at = at.where((F.col("ty") >= 0) & (F.col("ty") < F.col("h")))
    steps = F.sequence(F.lit(0), F.lit(patch - 1))
    square = (F.col("dy") - patch // 2) * (F.col("dy") - patch // 2)
    alpha = F.transform(steps, lambda x: F.when(F.lit(wrap) | ((F.col("left") + x >= 0) & (F.col("left") + x < F.col("w"))), F.exp(-((x - patch // 2) * (x - patch // 2) + square) / (2 * far * far))).otherwise(0.0))
    v = F.transform(steps, lambda x: F.get("data", F.pmod(F.col("px0") + x, F.col("w")).cast("int")))
    met = at.join(lines.select("raster_id", "band", "y", "data"), ["raster_id", "y"])
    return met.select("raster_id", "splat_id", "band", F.pmod("ty", F.col("h")).cast("int").alias("y"), "left", alpha.alias("alpha"), v.alias("v"))


def bank_lines(lines: DataFrame, sizes: DataFrame, scale: Amount, rotation: Amount = 0.0, rand_rot: Amount = 0.0, wobble: Amount = 0.2, falloff: Amount = 0.2, seed: int | Column = 0, count: int | None = None) -> DataFrame:
    """``patch_bank`` as patch lines (raster_id, patch_id, band, py, v, alpha) of lines; sizes: rows of ``banks``.

    Variants are turned in blocks (``scanlines.rotated``); those of no angle aren't moved.
    """
    kind = dict(lines.dtypes)["raster_id"]
    rotation, rand_rot, seed = map(col, (rotation, rand_rot, seed))
    keyed = scanlines.resampled(lines, patch_edge(F.col("h"), scale), patch_edge(F.col("w"), scale), scanlines.area_taps)
    keyed = keyed.withColumn("n", F.lit(count)) if count else scanlines.dealt(keyed, "raster_id").join(sizes.select("raster_id", "n"), "raster_id")
    i = F.col("patch_id")
    angle = rotation + F.when((rand_rot >= 0.01) & (F.col("n") > 1), (uniform(seed, i, F.lit("angle")) * 2 - 1) * 180 * rand_rot).otherwise(0.0)
    each = keyed.withColumn("patch_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("angle", F.when(F.abs(angle) > 0.05, angle).otherwise(0.0))
    each = each.withColumn("raster_id", F.struct("raster_id", "patch_id", "angle")).select(*scanlines.LINE)
    turned = scanlines.rotated(each.where("raster_id.angle <> 0"), F.col("raster_id.angle")).unionByName(each.where("raster_id.angle = 0"))
    turned = turned.withColumns({"patch_id": F.col("raster_id.patch_id"), "raster_id": F.col("raster_id.raster_id")})
    amounts = {"falloff": col(falloff).cast("double"), "wobble": col(wobble).cast("double")} | {f"phase{k}": uniform(seed, i, F.lit(f"phase{k}")) * 6.283185307179586 for k, _ in masks.HARMONICS}
    keyed = turned.select("raster_id", "patch_id", F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), F.col("band").cast("int").alias("band"), F.col("y").cast("int").alias("py"), F.col("data").alias("v"), *[c.alias(n) for n, c in amounts.items()])
    names = list(amounts)

    def run(batches):
        for batch in batches:
            own = [batch.column(c).to_numpy() for c in ("h", "w", "py", *names)]
            parts = []
            for which in scanlines._alike(*own):
                h, w, y, *rest = (o[which[0]] for o in own)
                parts.append((which, np.tile(masks.splat_line(int(h), int(w), int(y), *rest[:2], rest[2:]), (len(which), 1))))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("raster_id", "patch_id", "band", "py", "v")], scanlines._lists(parts, batch.num_rows)], ["raster_id", "patch_id", "band", "py", "v", "alpha"])

    return keyed.mapInArrow(run, f"raster_id {kind}, patch_id int, band int, py int, v array<double>, alpha array<double>")


def synthesize_lines(lines: DataFrame, scale: Amount = 0.5, rotation: Amount = 0.0, rand_rot: Amount = 0.0, wobble: Amount = 0.2, falloff: Amount = 0.2, seed: int | Column = 0, count: int | None = None) -> DataFrame:
    """Each raster's lines covered with patches of itself, data clipped to 0..255, with an array of the weights that lie on them."""
    rasters = saved(banks(lines, scale, rand_rot, wobble, count))
    bank = bank_lines(lines, rasters, scale, rotation, rand_rot, wobble, falloff, seed, count)
    placed = placements(rasters, F.col("ph"), F.col("pw"), F.col("n"), seed)
    end = lambda total, weight, base: (np.clip(np.where(weight > 1e-9, total / np.maximum(weight, 1e-9), base), 0.0, 255.0), weight)
    return _summed(placed, bank, rasters, lines, end, ["data", "weight"])


def synthesize(cells: DataFrame, scale: Amount = 0.5, rotation: Amount = 0.0, rand_rot: Amount = 0.0, wobble: Amount = 0.2, falloff: Amount = 0.2, seed: int | Column = 0, count: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Each raster covered with patches of itself, and the weights (cells of band 0) that lie on it."""
    laid = saved(synthesize_lines(saved(scanlines.from_cells(cells)), scale, rotation, rand_rot, wobble, falloff, seed, count))
    weights = scanlines.to_cells(laid.where("band = 0").withColumn("data", F.col("weight")))
    return scanlines.to_cells(laid).select(*COLUMNS), weights.select(*COLUMNS)
