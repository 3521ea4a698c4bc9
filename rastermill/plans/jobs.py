"""Whole jobs composed of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..layout import COLUMNS, clip, saved, sized
from ..operators import geometry, masks, scanlines, seams, splat, stencil, tone
from ..sources import files
from ..sources.files import RENDERERS


def offset_crossfade(cells: DataFrame, strength: float = 1.0) -> DataFrame:
    """Borders moved to the middle by half the size, faded into each other there, and moved back.

    The moves cancel, so that borders are faded where they are, on lines: only those near the upper and lower border meet.
    """
    return scanlines.to_cells(scanlines.crossfade(scanlines.from_cells(cells), strength, border=True))


#: Parameters of a seamless job and what holds where its row says nothing.
DEFAULTS = {"overlap_x": 0.2, "overlap_y": 0.2, "edge_falloff": 0.1, "blend_strength": 0.5, "splat_scale": 1.0, "splat_rotation": 0.0, "splat_random_rotation": 0.0, "splat_wobble": 0.2, "splat_randomize": 0.0}


def seamless(cells: DataFrame, jobs: DataFrame, light: dict | None = None, limits: dict | None = None, **defaults: float) -> DataFrame:
    """Each raster by the method of its row in jobs: overlap, splat, offset_crossfade or mirror; ``none`` leaves it, any other is overlap.

    jobs: raster_id, method and any of the columns of ``DEFAULTS`` (see ``store.normalize_params``); what is missing or
    null is taken from defaults, then from there. limits: sizes for ``tone.validate`` (``{}``: its own); rasters that it
    rejects are left out, and samples that are no numbers replaced. A raster's parameters ride along as its key, so that
    each method's branch is one plan whatever the jobs say.
    """
    unknown = set(defaults) - set(DEFAULTS)
    if unknown:
        raise TypeError(f"unknown parameters {sorted(unknown)}")
    if light:
        cells = stencil.delight(cells, **light)
    base = DEFAULTS | defaults
    amounts = [F.coalesce(F.col(n).cast("double"), F.lit(float(v))).alias(n) if n in jobs.columns else F.lit(float(v)).alias(n) for n, v in base.items()]
    method = F.when(F.col("method").isin("splat", "offset_crossfade", "mirror", "none"), F.col("method")).otherwise("overlap")
    asked = jobs.select("raster_id", method.alias("method"), *amounts)
    if limits is not None:
        sizes = cells.groupBy("raster_id").agg(F.max("h").alias("h"), F.max("w").alias("w"))
        asked = tone.validate(sizes.join(asked, "raster_id"), **limits).where("reason is null").drop("h", "w", "reason")
        cells = tone.point(cells, lambda v: color.finite(v, high=1.0))
    chosen = cells.join(asked, "raster_id").withColumn("raster_id", F.struct("raster_id", *base))
    of = lambda m: chosen.where(F.col("method") == m).select(*COLUMNS)
    own = lambda n: F.col(f"raster_id.{n}")
    lines = lambda m: scanlines.from_cells(of(m))
    out = scanlines.to_cells(scanlines.overlap(lines("overlap"), F.least(own("overlap_x"), F.lit(0.5)), F.least(own("overlap_y"), F.lit(0.5)), own("edge_falloff")))
    out = out.unionByName(scanlines.to_cells(scanlines.crossfade(lines("offset_crossfade"), own("blend_strength"), border=True)))
    out = out.unionByName(geometry.mirror_tile(of("mirror"))).unionByName(of("none"))
    splats = of("splat")
    if not asked.where("method = 'splat'").isEmpty():
        made = splat.synthesize(saved(splats), own("splat_scale"), own("splat_rotation"), own("splat_random_rotation"), own("splat_wobble"), own("edge_falloff"), own("splat_randomize").cast("int"))[0]
        out = out.unionByName(made)
    return out.withColumn("raster_id", F.col("raster_id.raster_id")).select(*COLUMNS)


def pbr_maps(gray: DataFrame, depth: float = 0.5, smooth: float = 0.1, rough: float = 0.5, scale: float = 4.266, kind: str = "4_sample", ao: float = 0.5, spread: float = 0.3, threshold: float = 1.0, softness: float = 0.0, alpha: DataFrame | None = None) -> DataFrame:
    """Rows (map, cells) of Normal (whole 16-bit) and Displacement, Roughness, AO and Opacity (whole 8-bit, three bands) of heights from 0 to 1.

    alpha (0 to 1), if given, becomes the fourth band of every map. Heights are worked on as lines (``stencil.relief``); a
    sample becomes those of all maps at once.
    """
    made = stencil.relief(scanlines.from_cells(sized(gray)), depth, smooth, scale, kind, round(4 + spread * 28), ao)
    kinds = _kinds(rough, threshold, softness)
    maps = {"Normal": ["nz", "ny", "nx"]} | {m: [m] * 3 for m in ("Displacement", "Roughness", "AO", "Opacity")}
    out = _mapped(made, maps, kinds)
    if alpha is None:
        return out
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("map"), (color.to_u16 if m == "Normal" else color.to_u8)(F.col("v")).alias("v")) for m in maps]))
    fourth = alpha.select("raster_id", "h", "w", F.lit(3).alias("band"), "y", "x", each.alias("one"))
    return out.unionByName(fourth.select("raster_id", "h", "w", "band", "y", "x", "one.v", "one.map"))


Kinds = dict[str, tuple[str, Callable[[Column], Column]]]


def _kinds(rough: float = 0.5, threshold: float = 1.0, softness: float = 0.0) -> Kinds:
    """For each kind of band the array of ``stencil.relief`` that it is made of and how, whole 16-bit for normals, else 8-bit.

    All but the normals' rise or fall with their one value.
    """
    whole = lambda f: lambda v: color.to_u8(f(v) + 1e-9)
    plain = whole(lambda v: v)
    return {
        "Displacement": ("height", plain), "Roughness": ("gray", whole(lambda v: color.roughness(v, rough))), "AO": ("shade", plain),
        "Opacity": ("gray", whole(lambda v: color.opacity(v, threshold, softness))), **{n: (n, stencil.packed) for n in ("nz", "ny", "nx")},
    }


def _mapped(made: DataFrame, maps: dict[str, list[str]], kinds: Kinds, dim: dict[str, Column] | None = None, end: Callable[[Column, Column, str], Column] = lambda v, dim, dtype: v) -> DataFrame:
    """Cells (with ``map``) of all bands of maps (their kinds, in order), from lines of ``stencil.relief``.

    A line becomes those of all bands as arrays first, so that a sample's value is one choice by kind. end: what becomes
    of a sample (value, whether its map is dim, dtype).
    """
    used = list(dict.fromkeys(k for bands in maps.values() for k in bands))
    band = lambda m, b, k: F.struct(F.lit(m).alias("map"), F.lit(b).alias("band"), F.lit(used.index(k)).alias("kind"), (dim or {}).get(m, F.lit(False)).alias("dim"), F.col(kinds[k][0]).alias("data"))
    each = F.explode(F.array(*[band(m, b, k) for m, bands in maps.items() for b, k in enumerate(bands)]))
    lines = made.select("raster_id", "h", "w", "y", each.alias("one"))
    cells = lines.select("raster_id", "h", "w", "one.band", "y", "one.map", "one.kind", "one.dim", F.posexplode("one.data").alias("x", "v"))
    deep = lambda k: kinds[k][0] in ("nz", "ny", "nx")

    def value(some: list[str], dtype: str) -> Column:
        out = F.lit(None).cast("double")
        for f in {id(kinds[k][1]): kinds[k][1] for k in some}.values():
            out = F.when(F.col("kind").isin([used.index(k) for k in some if kinds[k][1] is f]), f(F.col("v"))).otherwise(out)
        return end(out, F.col("dim"), dtype)

    normals = [k for k in used if deep(k)]
    v = F.when(F.col("kind").isin([used.index(k) for k in normals]), value(normals, "uint16")).otherwise(value([k for k in used if not deep(k)], "uint8"))
    return cells.select("raster_id", "h", "w", "band", "y", "x", v.alias("v"), "map")


def chunked_overlap(cells: DataFrame, chunk: int, overlap: int, share: float = 0.2, falloff: float = 0.1) -> DataFrame:
    """Overlap synthesis of each chunk by itself, merged back with feathered edges; a chunk's number is part of its raster's key."""
    return scanlines.to_cells(chunked_overlap_lines(saved(scanlines.from_cells(cells)), chunk, overlap, share, falloff))


def chunked_overlap_lines(lines: DataFrame, chunk: int, overlap: int, share: float = 0.2, falloff: float = 0.1) -> DataFrame:
    """``chunked_overlap`` of lines: parts of lines are worked on, and meet the source's line that they are laid over."""
    if share > 0.5:
        raise ValueError("an overlap is at most half the edge")
    names = ("raster_id", "cy", "cx", "y0", "x0")
    keyed = scanlines.chunks(lines, chunk, overlap).withColumn("raster_id", F.struct(*names)).select(*scanlines.LINE)
    done = scanlines.overlap(keyed, share, share, falloff)
    return scanlines.merged(done.select(*[F.col(f"raster_id.{n}").alias(n) for n in names], "h", "w", "band", "y", "data"), lines, overlap)


def seam_fill(cells: DataFrame, width: int = 30, radius: int | None = None, largest: int = 2048) -> DataFrame:
    """The centre cross filled from around it; rasters above ``largest`` are filled at that size, enlarged, and mixed in by a softened mask.

    radius: if not given, half the seam's width as it is where the raster is filled, 3 at least.
    """
    edge = F.greatest("h", "w")
    near = cells.where(edge <= largest)
    near = stencil.gap_fill(near, masks.over(near, masks.seam(width)), radius or max(3, width // 2))
    cells = cells.where(edge > largest)
    if cells.isEmpty():
        return near
    mask = masks.over(cells, masks.seam(width))
    # sizes to go back to, from which each raster's own scale follows, ride along as its key
    keyed, keyed_mask = (c.withColumn("raster_id", F.struct("raster_id", "h", "w")) for c in (cells, mask))
    scale = largest / F.greatest("raster_id.h", "raster_id.w")
    down = lambda e: F.greatest(F.lit(1), F.floor(F.col(e) * scale))
    small = stencil.gap_fill(geometry.resize_area(keyed, down), geometry.resize_nearest(keyed_mask, down), radius or F.greatest(F.lit(3), F.floor(width // 2 * scale)))
    large = geometry.resize_linear(small, lambda e: F.col(f"raster_id.{e}"))
    large = large.select("raster_id.raster_id", "h", "w", "band", "y", "x", "v")
    return near.unionByName(seams.alpha_blend(cells, large, stencil.gaussian_blur(mask, 5)))


def multi_scale_fill(cells: DataFrame, width: int = 30, radius: int = 5, scales: tuple[float, ...] = (1.0, 0.5, 0.25)) -> DataFrame:
    """The centre cross filled at each scale and mixed in from the largest on, a smaller scale with a smaller share; one fold by line.

    The radius goes down with the scale, to 3 at least (where it isn't smaller from the start). All scales are one plan on
    lines: a line's scale and size to go back to ride along as its raster's key.
    """
    lines, half = saved(scanlines.from_cells(cells)), width // 2
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("scale"), F.lit(max(min(3, radius), int(radius * s))).alias("radius")) for i, s in enumerate(scales)]))
    keyed = lines.withColumn("__at", each).withColumn("raster_id", F.struct("raster_id", "__at.i", "__at.scale", "__at.radius", "h", "w"))
    own = lambda n: F.col(f"raster_id.{n}")
    down = lambda e: F.greatest(F.lit(1), F.floor(F.col(e) * own("scale")))
    small = scanlines.resampled(keyed, down("h"), down("w"), scanlines.area_taps)
    # the cross as it is at the nearest place of the whole size
    on = lambda p, n: (p >= F.floor(n / 2) - half) & (p < F.floor(n / 2) + half)
    crossed = lambda p, e: on(F.floor(p * own(e) / F.col(e)), own(e))
    gap = F.transform("data", lambda v, x: crossed(F.col("y"), "h") | crossed(x, "w"))
    up = scanlines.resampled(stencil.gap_fill_lines(small.withColumn("gap", gap), own("radius")), own("h"), own("w"), scanlines.cubic_taps)
    step = lambda i, k: F.struct(i.alias("i"), k.alias("k"), "data").alias("step")
    steps = lines.select("raster_id", "h", "w", "band", "y", step(F.lit(-1), F.lit(1.0)))
    steps = steps.unionByName(up.select(own("raster_id").alias("raster_id"), "h", "w", "band", "y", step(own("i"), own("scale") * 0.3)))
    gathered = steps.groupBy("raster_id", "h", "w", "band", "y").agg(F.array_sort(F.collect_list("step")).alias("steps"))
    mixed = F.aggregate(F.slice("steps", 2, len(scales)), F.col("steps")[0]["data"], lambda acc, s: F.zip_with(acc, s["data"], lambda a, b: (1 - s["k"]) * a + s["k"] * b))
    return scanlines.to_cells(gathered.withColumn("data", mixed))


def export_package(cells: DataFrame, edge: int, renderer: str = "generic", source: str = "average_rgb", smooth: float = 0.0, packing: bool = True, glossiness: bool = False, clamp: bool = False) -> DataFrame:
    """Cells of all maps of an export with a column ``map``: resized so that the longest edge is ``edge``, green turned and depth set for the renderer.

    packing: for ue5, occlusion and roughness as one map ORM. glossiness: for others, roughness turned over, as one band.
    clamp: displacement within 8 to 247. Write them with ``write_package``.
    """
    return export_lines(scanlines.from_cells(cells), edge, renderer, source, smooth, packing, glossiness, clamp)


def export_lines(lines: DataFrame, edge: int, renderer: str = "generic", source: str = "average_rgb", smooth: float = 0.0, packing: bool = True, glossiness: bool = False, clamp: bool = False) -> DataFrame:
    """``export_package`` of lines; samples are rows only in the result.

    What depends on the whole raster is whether a map of it is dim, no sample of it above 1, which follows from the ends of
    what it is made of. As dim maps are rare, they are joined only where there are any.
    """
    _, fmt, convention, bits = RENDERERS[renderer]
    scaled = lambda e: F.greatest(F.lit(1), F.floor(F.col(e) * (edge / F.greatest("h", "w")) + 1e-9))
    base = saved(scanlines.resampled(lines, scaled("h"), scaled("w"), lambda n, m: scanlines.cubic_taps(n, m) if m > n else scanlines.area_taps(n, m)))
    gray = tone.gray_lines(base.withColumn("data", F.transform("data", lambda v: v / 255)), source)
    made = saved(stencil.relief(gray, smooth=smooth, radius=12, strength=0.5))

    kinds = _kinds()
    kinds |= {"Zero": ("gray", lambda v: F.lit(0.0)), "Glossiness": ("gray", lambda v: 255 - kinds["Roughness"][1](v)), "down": ("ny", lambda v: 65535 - stencil.packed(v))}
    if clamp:
        kinds["Displacement"] = ("height", lambda v: clip(color.to_u8(v + 1e-9), 8, 247))
    maps = {m: [m] * 3 for m in ("Roughness", "AO", "Displacement", "Opacity")}
    if renderer == "ue5" and packing:
        maps = {"ORM": ["Zero", "Roughness", "AO"], "Displacement": maps["Displacement"], "Opacity": maps["Opacity"]}
    elif renderer != "ue5" and glossiness:
        maps["Roughness"] = ["Glossiness"]
    small, dim = _dimmed(made, {m: [kinds[k] for k in dict.fromkeys(bands)] for m, bands in maps.items()})
    maps["Normal"] = ["nz", "down" if convention.startswith("DirectX") else "ny", "nx"]
    out = _mapped(small, maps, kinds, dim, lambda v, dim, dtype: tone.at_depth(v, dim, dtype, fmt, bits))
    limited = lambda v: clip(v, 0, 255)
    whole, dim = _dimmed(base, {"BaseColor": [("data", limited)]})
    first = whole.select("raster_id", "h", "w", "band", "y", dim["BaseColor"].alias("dim"), F.posexplode("data").alias("x", "v"))
    first = first.withColumn("v", tone.at_depth(limited("v"), F.col("dim"), "float32", fmt, bits))
    return first.select(*COLUMNS, F.lit("BaseColor").alias("map")).unionByName(out)


def _dimmed(lines: DataFrame, maps: dict[str, list[tuple[str, Callable]]]) -> tuple[DataFrame, dict[str, Column]]:
    """Lines with what says of each map whether it is dim in its raster: not all 0, and no sample above 1.

    maps: the arrays that a map is made of and how; as that rises or falls with a sample, the ends of an array are enough.
    """
    arrays = list(dict.fromkeys(a for made in maps.values() for a, _ in made))
    ends = lines.groupBy("raster_id").agg(*[f(g(a)).alias(f"{end}_{a}") for a in arrays for end, f, g in (("low", F.min, F.array_min), ("high", F.max, F.array_max))])
    tops = {m: F.greatest(F.lit(0.0), *[f(F.col(f"{end}_{a}")) for a, f in made for end in ("low", "high")]) for m, made in maps.items()}
    dim = saved(ends.select("raster_id", *[((t > 0) & (t <= 1)).alias(f"dim_{m}") for m, t in tops.items()]).where(" OR ".join(f"dim_{m}" for m in tops)))
    if dim.isEmpty():
        return lines, {m: F.lit(False) for m in tops}
    return lines.join(dim, "raster_id", "left"), {m: F.coalesce(f"dim_{m}", F.lit(False)) for m in tops}


def write_package(package: DataFrame, materials: DataFrame, folder: str, renderer: str = "generic", packing: bool = True, glossiness: bool = False, maps: dict[str, bool] | None = None) -> DataFrame:
    """Files of a package (see ``export_package``) under their names in the manifest; rows (path, bytes).

    materials: (raster_id, name). Maps that aren't selected (``files.MAPS`` unless given) aren't written.
    """
    named = materials.select("raster_id", files.sanitize_name(F.col("name"), "Material_01").alias("material"))
    wanted = files.export_manifest(materials.select("name"), maps=maps, packing=packing, glossiness=glossiness).where(F.col("renderer") == renderer).distinct()
    wanted = wanted.join(named, "material").select("raster_id", "map", F.concat("subfolder", F.lit("/"), "file_name").alias("file"))
    _, fmt, _, bits = RENDERERS[renderer]
    keyed = package.join(wanted, ["raster_id", "map"])
    return files.write_files(keyed.drop("map"), folder, F.col("file"), 16 if bits == 16 and fmt in ("png", "tiff") else 8)
