"""Image files as a data source of Spark, batch and stream: headers alone, or samples as lines; and lines written as files.

What is read follows from the columns asked for: without ``band``, ``y`` and ``data`` a file gives one row, of which only
the first bytes and the heads of later chunks are read. Partitions are planned by bytes. Lines are inflated, unfiltered and
handed on in blocks, so that no image stands in memory whole; 16-bit samples keep their 16 bits. Files are reached through
Arrow's file systems, by URI.
"""

from __future__ import annotations

import fnmatch
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

HEADER = "path string, size_bytes long, format string, h int, w int, bit_depth int, channels int, dpi double"
LINES = HEADER + ", band int, y int, data array<double>"

#: Bytes read of a file at first; bytes of files in a partition; bytes of unfiltered lines in a block; samples in an Arrow batch.
FIRST, PARTITION, BLOCK, BATCH = 8192, 64 << 20, 16 << 20, 1 << 20
#: Bytes that opening a file counts as where partitions are planned, unless their bytes are asked for.
OPEN = 1 << 18

#: PNG colour type: number of channels (fixed values).
PNG_CHANNELS = {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}

#: Adam7 passes: first column and row, step across and down (fixed values).
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))

#: TIFF field type: its struct letter (fixed values); others aren't needed.
TIFF_KINDS = {1: "B", 3: "H", 4: "I"}


class Head(NamedTuple):
    """What a file says of itself; ``more`` is what its format needs to find the samples."""

    format: str
    w: int
    h: int
    bit_depth: int
    channels: int
    dpi: float
    more: dict


class Peek:
    """Bytes at any place of a file; the first ones are read once. ``taken`` counts what was read."""

    def __init__(self, file):
        self.file, self.start = file, file.read(FIRST)
        self.taken = len(self.start)

    def __call__(self, at: int, n: int) -> bytes:
        if at + n <= len(self.start):
            return self.start[at : at + n]
        self.file.seek(at)
        found = self.file.read(n)
        self.taken += len(found)
        if len(found) < n:
            raise ValueError("file ends early")
        return found


def _png_head(peek: Peek) -> Head:
    w, h, depth, kind, _, _, laced = struct.unpack(">IIBBBBB", peek(16, 13))
    at, dpi, more = 33, 72.0, {"kind": kind, "laced": laced}
    while True:
        size, name = struct.unpack(">I4s", peek(at, 8))
        if name == b"IDAT":
            break
        if name == b"pHYs" and size == 9:
            across, _, unit = struct.unpack(">IIB", peek(at + 8, 9))
            dpi = round(across * 0.0254, 2) if unit == 1 else dpi
        elif name in (b"PLTE", b"tRNS") and kind == 3:
            more[name.decode()] = peek(at + 8, size)
        elif name == b"IEND":
            raise ValueError("no samples")
        at += 12 + size
    return Head("png", w, h, depth, PNG_CHANNELS[kind] + ("tRNS" in more), dpi, more | {"at": at})


def _jpeg_head(peek: Peek) -> Head:
    at, dpi = 2, 72.0
    while True:
        mark, kind = peek(at, 2)
        if mark != 0xFF:
            raise ValueError("no marker")
        if kind == 0xFF:  # a filler
            at += 1
            continue
        size = struct.unpack(">H", peek(at + 2, 2))[0]
        if kind == 0xE0 and size >= 14 and peek(at + 4, 5) == b"JFIF\0":
            unit, across = struct.unpack(">BH", peek(at + 11, 3))
            dpi = {1: float(across), 2: round(across * 2.54, 2)}.get(unit, dpi)
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            depth, h, w, channels = struct.unpack(">BHHB", peek(at + 4, 6))
            return Head("jpg", w, h, depth, channels, dpi, {})
        at += 2 + size


def _tiff_head(peek: Peek) -> Head:
    order = {b"II": "<", b"MM": ">"}[peek(0, 2)]
    at = struct.unpack(order + "I", peek(4, 4))[0]
    tags = {}
    for i in range(struct.unpack(order + "H", peek(at, 2))[0]):
        entry = peek(at + 2 + 12 * i, 12)
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if kind in TIFF_KINDS:
            size = struct.calcsize(f"{order}{n}{TIFF_KINDS[kind]}")
            place = entry[8 : 8 + size] if size <= 4 else peek(struct.unpack(order + "I", entry[8:])[0], size)
            tags[tag] = struct.unpack(f"{order}{n}{TIFF_KINDS[kind]}", place)
        elif kind == 5:
            over, under = struct.unpack(order + "II", peek(struct.unpack(order + "I", entry[8:])[0], 8))
            tags[tag] = (over / under if under else 0.0,)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    dpi = {2: 1.0, 3: 2.54}.get(one(296, 2), 0.0) * one(282, 0.0)
    return Head("tiff", one(256, 0), one(257, 0), one(258, 1), one(277, 1), round(dpi, 2) or 72.0, {"order": order, "tags": tags})


def _tga_head(peek: Peek) -> Head:
    n, _, kind = struct.unpack("<BBB", peek(0, 3))
    w, h, bits, flags = struct.unpack("<HHBB", peek(12, 6))
    if kind not in (2, 3, 10, 11) or bits not in (8, 24, 32):
        raise ValueError("a kind of TGA that isn't read")
    return Head("tga", w, h, 8, bits // 8, 72.0, {"at": 18 + n, "kind": kind, "down": bool(flags & 0x20)})


def _exr_head(peek: Peek) -> Head:
    def text(at: int) -> bytes:
        out = b""
        while not out.endswith(b"\0"):
            out += peek(at + len(out), 1)
        return out

    at, found = 8, {}
    while (name := text(at)) != b"\0":
        kind = text(at + len(name))
        at += len(name) + len(kind)
        size = struct.unpack("<I", peek(at, 4))[0]
        if name in (b"channels\0", b"dataWindow\0"):
            found[name[:-1]] = peek(at + 4, size)
        at += 4 + size
    kinds, left = [], found[b"channels"]
    while left[:1] != b"\0":
        name, left = left.split(b"\0", 1)
        kinds.append(struct.unpack("<I", left[:4])[0])
        left = left[16:]
    x0, y0, x1, y1 = struct.unpack("<4i", found[b"dataWindow"])
    return Head("exr", x1 - x0 + 1, y1 - y0 + 1, 16 if set(kinds) == {1} else 32, len(kinds), 72.0, {})


def head_of(peek: Peek, path: str) -> Head | None:
    """The header of a PNG, JPEG, TIFF, TGA (by its name) or EXR file; None for other files and those cut within it."""
    start = peek.start
    try:
        if start[:8] == b"\x89PNG\r\n\x1a\n" and start[12:16] == b"IHDR":
            return _png_head(peek)
        if start[:3] == b"\xff\xd8\xff":
            return _jpeg_head(peek)
        if start[:4] in (b"II*\0", b"MM\0*"):
            return _tiff_head(peek)
        if start[:4] == b"v/1\x01":
            return _exr_head(peek)
        return _tga_head(peek) if path.lower().endswith(".tga") else None
    except (ValueError, KeyError, IndexError, struct.error):
        return None


def _inflated(file, at: int) -> Iterator[bytes]:
    """The samples' bytes of a PNG as they come, chunks and their sums checked."""
    pack = zlib.decompressobj()
    file.seek(at)
    while True:
        size, name = struct.unpack(">I4s", file.read(8))
        total, left = zlib.crc32(name), size
        while left:
            part = file.read(min(left, BATCH))
            if not part:
                raise ValueError("file ends early")
            left, total = left - len(part), zlib.crc32(part, total)
            while part and name == b"IDAT":
                yield pack.decompress(part, BATCH)
                part = pack.unconsumed_tail
        if struct.unpack(">I", file.read(4))[0] != total:
            raise ValueError("sum of a chunk")
        if name == b"IEND":
            if not pack.eof:
                raise ValueError("samples end early")
            return


def _taken(parts: Iterator[bytes], held: bytearray, n: int) -> np.ndarray:
    while len(held) < n:
        held += next(parts, None) or _ended(parts)
    out = np.frombuffer(bytes(held[:n]), np.uint8)
    del held[:n]
    return out


def _ended(parts: Iterator[bytes]) -> bytes:
    for part in parts:
        if part:
            return part
    raise ValueError("samples end early")


def unfiltered(block: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """Lines (kind of filter, then bytes) without their filters; ``above`` is the line before, ``step`` the bytes of a pixel.

    Differences to the left are running sums and those upwards whole lines. Where a block has lines of the other two kinds,
    which look left and up at once, all its lines are worked on together along diagonals, each of which needs only the two
    before it.
    """
    kinds, rows = block[:, 0], block[:, 1:]
    if (kinds > 4).any():
        raise ValueError("kind of filter")
    n, width = rows.shape
    if not (kinds > 2).any():
        out = rows.copy()
        for i in range(n):
            if kinds[i] == 1:
                out[i] = np.cumsum(rows[i].reshape(-1, step), axis=0, dtype=np.uint8).ravel()
            elif kinds[i] == 2:
                out[i] += out[i - 1] if i else above
        return out
    pixels = width // step
    out = np.zeros((n + 1, pixels + 1, step), np.int16)
    out[0, 1:] = above.reshape(-1, step)
    given = rows.reshape(n, pixels, step).astype(np.int16)
    for d in range(n + pixels - 1):
        y = np.arange(max(0, d - pixels + 1), min(n - 1, d) + 1)
        x = d - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        far_a, far_b, far_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        near = np.where((far_a <= far_b) & (far_a <= far_c), a, np.where(far_b <= far_c, b, c))
        guess = np.choose(kinds[y][:, None], (np.int16(0), a, b, (a + b) >> 1, near))
        out[y + 1, x + 1] = (given[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(n, width)


def _samples(rows: np.ndarray, w: int, depth: int, count: int) -> np.ndarray:
    """(lines, w, count) of packed bytes."""
    if depth == 16:
        return np.ascontiguousarray(rows).view(">u2").reshape(len(rows), w, count)
    if depth == 8:
        return rows.reshape(len(rows), w, count)
    bits = np.unpackbits(rows, axis=1)[:, : w * count * depth].reshape(len(rows), w, count, depth)
    return (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)


def _png_blocks(file, head: Head, checked: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(first line, samples) of blocks; checked: only that all lines and known filters are there, without any sample."""
    kind, depth = head.more["kind"], head.bit_depth
    count = 1 if kind == 3 else PNG_CHANNELS[kind]
    step = max(1, count * depth // 8)
    if kind == 3:
        table = np.frombuffer(head.more["PLTE"], np.uint8).reshape(-1, 3)
        if "tRNS" in head.more:
            clear = np.frombuffer(head.more["tRNS"], np.uint8)
            table = np.column_stack([table, np.r_[clear, np.full(max(0, len(table) - len(clear)), 255, np.uint8)][: len(table)]])
    parts, held = _inflated(file, head.more["at"]), bytearray()

    def blocks(w: int, h: int) -> Iterator[tuple[int, np.ndarray]]:
        width = (w * count * depth + 7) // 8
        size, above = max(16, min(256, BLOCK // (width + 1))), np.zeros(width, np.uint8)
        for y in range(0, h, size):
            n = min(size, h - y)
            block = _taken(parts, held, n * (width + 1)).reshape(n, width + 1)
            if checked:
                if (block[:, 0] > 4).any():
                    raise ValueError("kind of filter")
                continue
            rows = unfiltered(block, above, step)
            above = rows[-1]
            found = _samples(rows, w, depth, count)
            if kind == 3:
                found = table[found[:, :, 0]]
            elif depth < 8:
                found = found * (255 // (2**depth - 1))
            yield y, found

    if head.more["laced"]:
        whole = np.zeros((head.h, head.w, head.channels), np.uint16)
        for x0, y0, dx, dy in PASSES:
            w, h = -(-(head.w - x0) // dx), -(-(head.h - y0) // dy)
            if w > 0 and h > 0:
                for y, found in blocks(w, h):
                    whole[y0 + y * dy : y0 + (y + len(found)) * dy : dy, x0::dx] = found
        if not checked:
            yield 0, whole
    else:
        yield from blocks(head.w, head.h)
    for _ in parts:  # sums of the last chunks
        pass


def _tiff_blocks(file, head: Head, checked: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """Lines of an uncompressed TIFF with interleaved samples of 8 or 16 bits."""
    tags, width = head.more["tags"], head.w * head.channels * head.bit_depth // 8
    if tags.get(259, (1,))[0] != 1 or tags.get(284, (1,))[0] != 1 or head.bit_depth not in (8, 16) or tags.get(262, (1,))[0] not in (1, 2):
        raise ValueError("a kind of TIFF that isn't read")
    tall, size = tags.get(278, (head.h,))[0], max(1, BLOCK // max(1, width))
    if checked:
        if 273 not in tags or any(file.size() < at + width * min(tall, head.h - i * tall) for i, at in enumerate(tags[273])):
            raise ValueError("file ends early")
        return
    for i, at in enumerate(tags[273]):
        for y in range(i * tall, min(head.h, (i + 1) * tall), size):
            n = min(size, head.h - y, (i + 1) * tall - y)
            file.seek(at + (y - i * tall) * width)
            rows = np.frombuffer(file.read(n * width), np.dtype(head.more["order"] + "u2") if head.bit_depth == 16 else np.uint8)
            yield y, rows.reshape(n, head.w, head.channels)


def _tga_blocks(file, head: Head, checked: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """Lines of an uncompressed TGA, samples turned to the order red, green, blue, alpha."""
    width = head.w * head.channels
    if head.more["kind"] > 3 or file.size() < head.more["at"] + width * head.h:
        raise ValueError("packed, or file ends early")
    size = max(1, BLOCK // max(1, width))
    for at in range(0, 0 if checked else head.h, size):
        n = min(size, head.h - at)
        file.seek(head.more["at"] + at * width)
        rows = np.frombuffer(file.read(n * width), np.uint8).reshape(n, head.w, head.channels)
        rows = rows[:, :, [2, 1, 0, 3][: head.channels]] if head.channels > 1 else rows
        yield (at, rows) if head.more["down"] else (head.h - at - n, rows[::-1])


BLOCKS = {"png": _png_blocks, "tiff": _tiff_blocks, "tga": _tga_blocks}

#: Number of channels: band of each, in the order of the file.
BANDS = {1: (0,), 2: (0, 3), 3: (2, 1, 0), 4: (2, 1, 0, 3)}


def _place(uri: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path within it, what stands before such paths in a URI)."""
    uri = uri.replace("s3a://", "s3://", 1).rstrip("/")
    system, path = fs.FileSystem.from_uri(uri)
    return system, path, uri[: -len(path)] if uri.endswith(path) else ""


def _files(uri: str, pattern: str) -> list[tuple[int, str, int]]:
    """(time of change, path, bytes) of a folder's files, hidden ones left out, in this order."""
    system, path, _ = _place(uri)
    if system.get_file_info(path).type == fs.FileType.File:
        found = [system.get_file_info(path)]
    else:
        found = [i for i in system.get_file_info(fs.FileSelector(path, recursive=True)) if i.type == fs.FileType.File and not any(p[:1] in "._" for p in i.path[len(path) :].split("/") if p)]
    return sorted((i.mtime_ns or 0, i.path, i.size) for i in found if fnmatch.fnmatch(i.base_name, pattern))


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _Reader:
    """What batches and streams share: the plan by bytes, and the rows of a partition."""

    def __init__(self, options: dict, schema: StructType):
        self.uri, self.pattern = options["path"], options.get("pattern", "*")
        self.bytes = int(options.get("partitionBytes", PARTITION))
        self.open = 0 if "partitionBytes" in options else OPEN
        self.schema = schema
        self.columns, self.lines = schema.names, bool({"band", "y", "data"} & set(schema.names))

    def planned(self, files: list[tuple[int, str, int]]) -> list[Files]:
        out, total = [], 0
        for _, path, size in sorted(files, key=lambda f: f[1]):
            # opening counts too, as many small files take far longer than their bytes
            size_read = (max(size, 1) if self.lines else min(size, FIRST) + 1) + self.open
            if not out or total + size_read > self.bytes:
                out.append(Files([]))
                total = 0
            out[-1].files.append((path, size))
            total += size_read
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """Batches of several small files' rows, as a batch by itself costs more than a small file's lines."""
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        waiting, held = [], 0
        for batch in self.rows(partition, schema):
            waiting.append(batch)
            held += batch.nbytes
            if held >= BATCH:
                yield from pa.Table.from_batches(waiting, schema).combine_chunks().to_batches()
                waiting, held = [], 0
        if waiting:
            yield from pa.Table.from_batches(waiting, schema).combine_chunks().to_batches()

    def rows(self, partition: Files, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        system, _, before = _place(self.uri)
        waiting = []
        for path, size in partition.files:
            with system.open_input_file(path) as file:
                head = head_of(Peek(file), path)
                if head is None:
                    continue
                row = {"path": before + path, "size_bytes": size, **head._asdict()}
                if not self.lines:
                    waiting.append({n: row[n] for n in self.columns})
                    if len(waiting) == 4096:
                        yield pa.RecordBatch.from_pylist(waiting, schema)
                        waiting = []
                elif head.format in BLOCKS and head.channels in BANDS:
                    try:  # a first pass, so that a broken file gives no lines at all
                        for _ in BLOCKS[head.format](file, head, checked=True):
                            pass
                    except (ValueError, KeyError, IndexError, struct.error, zlib.error):
                        continue
                    for y, samples in BLOCKS[head.format](file, head):
                        yield from self.batches(row, head, y, samples, schema)
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, schema)

    def batches(self, row: dict, head: Head, y: int, samples: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        bands = np.array(BANDS[head.channels], np.int32)
        size = max(1, BATCH // max(1, head.w * head.channels))
        for i in range(0, len(samples), size):
            part = samples[i : i + size].transpose(0, 2, 1)
            rows = part.shape[0] * part.shape[1]
            columns = {"band": np.tile(bands, len(part)), "y": np.repeat(np.arange(y + i, y + i + len(part), dtype=np.int32), head.channels)}
            if "data" in self.columns:
                start = pa.array(np.arange(rows + 1, dtype=np.int32) * head.w)
                columns["data"] = pa.ListArray.from_arrays(start, pa.array(part.astype(np.float64).ravel()))
            arrays = [pa.array(columns[n]).cast(t) if n in columns else pa.repeat(pa.scalar(row[n], t), rows) for n, t in zip(schema.names, schema.types)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)


class ImageReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.planned(_files(self.uri, self.pattern))


class ImageStreamReader(_Reader, DataSourceStreamReader):
    """Files in the order of (time of change, path); an offset is the last one taken.

    A file must appear under its name whole, with a time not before that of files taken already.
    """

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        found = _files(self.uri, self.pattern)
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((o["time"], o["path"]) for o in (start, end))
        return self.planned([f for f in _files(self.uri, self.pattern) if low < f[:2] <= high])

    def commit(self, end: dict) -> None:
        pass


class Images(DataSource):
    """Options: ``path``, ``pattern`` (of names), ``partitionBytes``. The schema asked for is any part of ``LINES``."""

    @classmethod
    def name(cls) -> str:
        return "raster_images"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> ImageReader:
        return ImageReader(self.options, schema)

    def streamReader(self, schema: StructType) -> ImageStreamReader:
        return ImageStreamReader(self.options, schema)


def _reader(spark: SparkSession, schema: str, pattern: str, stream: bool):
    spark.dataSource.register(Images)
    return (spark.readStream if stream else spark.read).format(Images.name()).schema(schema).option("pattern", pattern)


def headers(spark: SparkSession, path: str, pattern: str = "*", stream: bool = False) -> DataFrame:
    """One row (``HEADER``) for each image of a folder; files that aren't images are left out, dpi is 72 where a file says nothing."""
    return _reader(spark, HEADER, pattern, stream).load(path)


def lines(spark: SparkSession, path: str, pattern: str = "*", stream: bool = False) -> DataFrame:
    """Lines (raster_id, the path; h, w, band, y, data) of a folder's PNG, and uncompressed TIFF and TGA, images.

    Bands are blue, green, red and alpha; samples go up to 255, or 65535 at 16 bits. A broken file gives no line. An
    interlaced PNG is held whole; all others are read by blocks of at most 256 lines.
    """
    found = _reader(spark, "path string, h int, w int, band int, y int, data array<double>", pattern, stream).load(path)
    return found.withColumnRenamed("path", "raster_id")


class _Sink:
    """A file that takes lines in their order; it gets its name when it is whole."""

    def __init__(self, system: fs.FileSystem, path: str, w: int, h: int, bands: int, bits: int):
        self.system, self.path, self.w, self.h, self.bands, self.bits, self.n = system, path, w, h, bands, bits, 0
        self.kind = path.rpartition(".")[2].lower()
        if self.kind not in ("png", "tif", "tiff", "tga"):
            raise ValueError(f"no writer for {path}")
        if self.kind == "tga" and (bits != 8 or bands == 2):
            raise ValueError("TGA holds 8 bits in 1, 3 or 4 bands")
        folder, _, name = path.rpartition("/")
        system.create_dir(folder, recursive=True)
        self.part = f"{folder}/.writing-{uuid4().hex}-{name}"
        self.file, self.bytes, self.pack = system.open_output_stream(self.part), 0, zlib.compressobj(6)
        self.put(getattr(self, f"start_{self.kind[:3]}")())

    def put(self, data: bytes) -> None:
        if data:
            self.file.write(data)
            self.bytes += len(data)

    def chunk(self, name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    def start_png(self) -> bytes:
        kind = {1: 0, 2: 4, 3: 2, 4: 6}[self.bands]
        return b"\x89PNG\r\n\x1a\n" + self.chunk(b"IHDR", struct.pack(">IIBBBBB", self.w, self.h, self.bits, kind, 0, 0, 0))

    def start_tif(self) -> bytes:
        size = self.w * self.h * self.bands * self.bits // 8
        if size >= 1 << 32:
            raise ValueError("TIFF holds 4 GB")
        return b"MM\0*" + struct.pack(">I", 8 + size + size % 2)

    def start_tga(self) -> bytes:
        return struct.pack("<BBBHHBHHHHBB", 0, 0, 3 if self.bands == 1 else 2, 0, 0, 0, 0, 0, self.w, self.h, 8 * self.bands, 0x20 | (8 if self.bands == 4 else 0))

    def add(self, samples: np.ndarray) -> None:
        """The next line (w, bands), in the order red, green, blue, alpha."""
        whole = np.floor(np.clip(np.nan_to_num(samples), 0, 2**self.bits - 1)).astype(">u2" if self.bits == 16 else np.uint8)
        if whole.shape != (self.w, self.bands):
            raise ValueError(f"{self.path}: lines of different sizes")
        self.n += 1
        if self.kind == "png":
            packed = self.pack.compress(b"\0" + whole.tobytes())
            self.put(self.chunk(b"IDAT", packed) if packed else b"")
        else:
            self.put((whole[:, [2, 1, 0, 3][: self.bands]] if self.kind == "tga" and self.bands > 1 else whole).tobytes())

    def end(self) -> dict:
        if self.n != self.h:
            raise ValueError(f"{self.path}: {self.n} of {self.h} lines")
        if self.kind == "png":
            self.put(self.chunk(b"IDAT", self.pack.flush()) + self.chunk(b"IEND", b""))
        elif self.kind != "tga":
            self.put(self.directory())
        self.file.close()
        self.system.move(self.part, self.path)
        return {"path": self.path, "bytes": self.bytes}

    def directory(self) -> bytes:
        """Tags of a TIFF of one strip, which stand after its samples."""
        size, bands, bits = self.bytes - 8, self.bands, self.bits
        entries = [(256, 4, [self.w]), (257, 4, [self.h]), (258, 3, [bits] * bands), (259, 3, [1]), (262, 3, [2 if bands > 2 else 1]), (273, 4, [8]), (277, 3, [bands]), (278, 4, [self.h]), (279, 4, [size])]
        entries += [(338, 3, [2])] if bands in (2, 4) else []
        at, out, more = 8 + size + size % 2 + 2 + 12 * len(entries) + 4, struct.pack(">H", len(entries)), b""
        for tag, kind, values in entries:
            packed = struct.pack(f">{len(values)}{TIFF_KINDS[kind]}", *values)
            if len(packed) > 4:
                packed, more = struct.pack(">I", at + len(more)), more + packed
            out += struct.pack(">HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        return b"\0" * (size % 2) + out + b"\0\0\0\0" + more

    def drop(self) -> None:
        self.file.close()
        if self.system.get_file_info(self.part).type == fs.FileType.File:
            self.system.delete_file(self.part)


def _by_line(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """((name, h, w, y), samples of each band) of rows that are sorted by name, line and band."""
    key, rows = None, []
    for batch in batches:
        # one array of the batch's samples, of which lines are slices
        flat, ends = batch.column("data").flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(np.diff(batch.column("data").offsets.to_numpy()))
        keys = zip(*[batch.column(n).to_pylist() for n in ("name", "h", "w", "y")])
        for new, low, high in zip(keys, [0, *ends[:-1].tolist()], ends.tolist()):
            if new != key and rows:
                yield key, rows
                rows = []
            key = new
            rows.append(flat[low:high])
    if rows:
        yield key, rows


def write_lines(lines: DataFrame, folder: str, name: Column, bits: int = 8) -> DataFrame:
    """One PNG, TIFF or TGA (by its extension) for each raster under ``name`` in a folder, given as a URI; rows (path, bytes).

    A task takes its files' lines sorted and feeds them to an open file one by one, so that it holds a batch of lines and
    never a file. A file appears under its name only when it is whole; a raster that lacks a line raises ValueError.
    """
    order = F.array_position(F.array(*[F.lit(b) for b in (2, 1, 0, 3)]), F.col("band"))
    rows = lines.select(name.alias("name"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), F.col("y").cast("int").alias("y"), order.alias("o"), "data")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at, before = _place(folder)
        sink, last = None, None
        done = lambda s: pa.RecordBatch.from_pylist([s.end()], pa.schema([("path", pa.string()), ("bytes", pa.int64())]))
        try:
            for (file, h, w, _), bands in _by_line(batches):
                if file != last:
                    if sink:
                        yield done(sink)
                    sink, last = _Sink(system, f"{at}/{file}", w, h, len(bands), bits), file
                sink.add(np.stack(bands, axis=1))
            if sink:
                yield done(sink)
        except BaseException:
            if sink:
                sink.drop()
            raise

    # a number of partitions, as few bytes may be many files
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "name").sortWithinPartitions("name", "y", "o").mapInArrow(write, "path string, bytes long")
