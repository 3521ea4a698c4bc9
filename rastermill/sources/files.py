"""Files as tables: catalogue, formats, names, image headers, decoded pixels, and PNG files as a sink."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .images import PNG_CHANNELS, write_lines

#: Extension to format (fixed values).
FORMATS = {".png": "png", ".jpg": "jpg", ".jpeg": "jpg", ".tif": "tiff", ".tiff": "tiff", ".tga": "tga", ".exr": "exr"}

#: Format to the extension of what is written (fixed values).
EXTENSIONS = {"png": ".png", "jpg": ".jpg", "jpeg": ".jpeg", "tiff": ".tiff", "tga": ".tga", "exr": ".exr"}

#: Renderer: token, format, normal convention, bit depth (fixed values).
RENDERERS = {
    "corona": ("CORONA", "png", "OpenGL (Y+)", 16), "vray": ("VRAY", "tiff", "DirectX (Y-)", 16), "ue5": ("UE5", "png", "DirectX (Y-)", 8),
    "blender": ("BLENDER", "png", "OpenGL (Y+)", 16), "generic": ("PBR", "png", "OpenGL (Y+)", 16),
}

#: Map and whether it is exported unless said otherwise (fixed values).
MAPS = {"BaseColor": True, "Roughness": True, "Normal": True, "AO": True, "Displacement": True, "Opacity": False}

#: File name endings of single channels (fixed values).
SUFFIXES = {"Base Color": "_basecolor", "Normal": "_normal", "Roughness": "_roughness", "AO": "_ao", "Displacement": "_displacement", "Opacity": "_opacity"}


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def extension(path: Column) -> Column:
    """From the last dot of the file's name on, if something but dots stands before it; else empty."""
    return F.regexp_extract(path, r"[^/.][^/]*?(\.[^/.]*)$", 1)


def size_text(n: Column) -> Column:
    """Bytes, KB or MB in steps of 1024, with one decimal (half to even)."""
    tenth = lambda unit: F.format_string("%.1f", F.rint(n / unit * 10) / 10)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(tenth(1024), F.lit(" KB"))).otherwise(F.concat(tenth(1024 * 1024), F.lit(" MB")))


def file_catalog(files: DataFrame) -> DataFrame:
    """Rows (path, name, size_bytes, size_str, extension) of files (path, size_bytes)."""
    name = F.regexp_extract("path", r"[^/]*$", 0)
    return files.select("path", name.alias("name"), "size_bytes", size_text(F.col("size_bytes")).alias("size_str"), F.lower(extension(F.col("path"))).alias("extension"))


def read_catalog(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The catalogue of a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return file_catalog(found.select("path", F.col("length").alias("size_bytes")))


def format_filter(catalog: DataFrame) -> DataFrame:
    """Files of supported formats, with ``format``."""
    return catalog.withColumn("format", _lookup(FORMATS, F.col("extension"))).where("format is not null")


def output_path(path: Column, suffix: str = "_seamless", fmt: str | None = None) -> Column:
    """The path with a suffix before its extension, which another format replaces; null paths get a default name."""
    own = extension(path)
    stem = F.substring(path, F.lit(1), F.length(path) - F.length(own))
    new = F.lit(EXTENSIONS[fmt.lower()]) if fmt and fmt.lower() in EXTENSIONS else own
    default = f"output{suffix}{EXTENSIONS.get((fmt or 'png').lower(), '.png')}"
    return F.coalesce(F.concat(stem, F.lit(suffix), new), F.lit(default))


def channel_suffix(channel: Column) -> Column:
    return F.coalesce(_lookup(SUFFIXES, channel), F.concat(F.lit("_"), F.translate(F.lower(channel), " ", "_")))


def sanitize_name(name: Column, fallback: str = "Material") -> Column:
    """A name that every file system takes: reserved and control characters, and runs of white space, become one underscore."""
    cleaned = F.regexp_replace(F.btrim(F.coalesce(name, F.lit("")), F.lit(" \t\n\r")), r'[<>:"/\\|?*\x00-\x1f]', "_")
    cleaned = F.btrim(F.regexp_replace(cleaned, r"\s+", "_"), F.lit(" ._"))
    return F.coalesce(F.nullif(F.regexp_replace(cleaned, "_+", "_"), F.lit("")), F.lit(fallback))


def export_manifest(materials: DataFrame, packing: bool = True, glossiness: bool = False, maps: dict[str, bool] | None = None) -> DataFrame:
    """Rows (material, renderer, map, subfolder, file_name) of every file that an export of materials (name) writes.

    Renderers and maps are small fixed tables, so they are spread as arrays rather than joined.
    """
    chosen = MAPS if maps is None else maps
    rows = []
    for key, (token, fmt, _, _) in RENDERERS.items():
        for m in ("BaseColor", "Normal", "Roughness", "AO", "Displacement", "Opacity"):
            if chosen.get(m) and not (key == "ue5" and packing and m in ("AO", "Roughness")):
                short = {"BaseColor": "D", "Normal": "N"}.get(m) if key == "ue5" else None
                rows.append((key, token, m, short, "Glossiness" if glossiness and m == "Roughness" and key != "ue5" else m, EXTENSIONS[fmt]))
        if key == "ue5" and packing:
            rows.append((key, token, "ORM", "ORM", "ORM", EXTENSIONS[fmt]))
    spots = F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("renderer", "token", "map", "short", "suffix", "ext"))]) for r in rows]))
    named = materials.select(sanitize_name(F.col("name"), "Material_01").alias("material"), spots.alias("e")).select("material", "e.*")
    long = F.concat("material", F.lit("_"), "token", F.lit("_"), "suffix", "ext")
    name = F.when(F.col("short").isNotNull(), F.concat(F.lit("T_"), "material", F.lit("_"), "short", "ext")).otherwise(long)
    return named.select("material", "renderer", "map", F.concat("material", F.lit("_"), "token").alias("subfolder"), name.alias("file_name"))


def _png_header(content: memoryview) -> tuple[int, int, int, int, float] | None:
    """(w, h, bit depth, channels, dpi) by walking the chunks up to the samples."""
    if bytes(content[:8]) != b"\x89PNG\r\n\x1a\n" or bytes(content[12:16]) != b"IHDR" or len(content) < 33:
        return None
    w, h, depth, kind = struct.unpack(">IIBB", content[16:26])
    at, dpi = 33, 72.0
    while at + 12 <= len(content) and bytes(content[at + 4 : at + 8]) not in (b"IDAT", b"IEND"):
        size = struct.unpack(">I", content[at : at + 4])[0]
        if bytes(content[at + 4 : at + 8]) == b"pHYs" and size == 9 and at + 17 <= len(content):
            across, _, unit = struct.unpack(">IIB", content[at + 8 : at + 17])
            dpi = round(across * 0.0254, 2) if unit == 1 else dpi
        at += 12 + size
    return w, h, depth, PNG_CHANNELS.get(kind), dpi


def png_headers(files: DataFrame) -> DataFrame:
    """Rows (path, w, h, bit_depth, channels, dpi) of PNG files (path, content); dpi is 72 where the header says nothing.

    Chunks are walked up to the samples, which are not read; what isn't a PNG is left out.
    """

    def run(batches):
        for batch in batches:
            found = [(p, h) for p, c in zip(batch.column("path").to_pylist(), batch.column("content")) if c.is_valid and (h := _png_header(memoryview(c.as_buffer())))]
            columns = [pa.array([h[i] for _, h in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), *columns], ["path", "w", "h", "bit_depth", "channels", "dpi"])

    return files.select("path", "content").mapInArrow(run, "path string, w int, h int, bit_depth int, channels int, dpi double")


def scan_images(spark: SparkSession, path: str, tile: int = 256) -> DataFrame:
    """Tiles (path, h, w, bands, ty, tx, th, tw, data) of a folder's images, 8 bits, bands blue, green, red, alpha; files that don't decode are left out.

    The decoded image is a row only at this boundary; it leaves the task as tiles, interleaved and row by row.
    """
    rows = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                path, h, w, n = (batch.column(c)[i].as_py() for c in range(4))
                field = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8).reshape(h, w, n)
                for y in range(0, h, tile):
                    parts = [(x, field[y : y + tile, x : x + tile]) for x in range(0, w, tile)]
                    yield pa.RecordBatch.from_pydict({
                        "path": [path] * len(parts), **{k: pa.array([v] * len(parts), pa.int32()) for k, v in (("h", h), ("w", w), ("bands", n), ("ty", y // tile))}, "tx": pa.array([x // tile for x, _ in parts], pa.int32()),
                        "th": pa.array([p.shape[0] for _, p in parts], pa.int32()), "tw": pa.array([p.shape[1] for _, p in parts], pa.int32()), "data": pa.array([p.ravel().astype(np.float32) for _, p in parts], pa.list_(pa.float32())),
                    })

    return rows.mapInArrow(cut, "path string, h int, w int, bands int, ty int, tx int, th int, tw int, data array<float>")


def tiles_to_cells(tiles: DataFrame, key: str = "path", tile: int = 256) -> DataFrame:
    """Cells of interleaved tiles; the key column becomes raster_id."""
    at = tiles.select(F.col(key).alias("raster_id"), "h", "w", "bands", "ty", "tx", "tw", F.posexplode("data").alias("i", "s"))
    pixel = F.floor(F.col("i") / F.col("bands"))
    return at.select("raster_id", "h", "w", (F.col("i") % F.col("bands")).cast("int").alias("band"), (F.col("ty") * tile + F.floor(pixel / F.col("tw"))).cast("int").alias("y"),
                     (F.col("tx") * tile + pixel % F.col("tw")).cast("int").alias("x"), F.col("s").cast("double").alias("v"))


def cells_to_tiles(cells: DataFrame, tile: int = 256) -> DataFrame:
    """Planar tiles (raster_id, band, ty, tx, h, w, th, tw, data), row by row."""
    placed = cells.withColumns({"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")})
    data = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"].cast("float"))
    out = placed.groupBy("raster_id", "band", "ty", "tx", "h", "w").agg(data.alias("data"))
    edge = lambda n, t: F.least(F.lit(tile), F.col(n) - F.col(t) * tile)
    return out.select("raster_id", "band", "ty", "tx", "h", "w", edge("h", "ty").alias("th"), edge("w", "tx").alias("tw"), "data")


def write_files(cells: DataFrame, folder: str, name: Column, bits: int = 8) -> DataFrame:
    """One PNG, TIFF or TGA (by its extension) for each raster under ``name``, in a folder that all executors share; rows (path, bytes).

    Cells are gathered to lines, which ``images.write_lines`` feeds to open files.
    """
    data = F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda c: c["v"])
    lines = cells.withColumn("name", name).groupBy("name", "h", "w", "band", "y").agg(data.alias("data"))
    return write_lines(lines, folder, F.col("name"), bits)


write_png = write_files


def write_tiles(cells: DataFrame, path: str, tile: int = 256) -> None:
    """Tiles as Parquet, partitioned by band, under Spark's commit protocol."""
    cells_to_tiles(cells, tile).write.mode("overwrite").partitionBy("band").parquet(path)
