"""Image files as a data source: every filter and kind of PNG, headers of other formats, streams, and files written by line."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.sources import files, images


def chunk(name, data):
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def filtered(rows, step, kinds):
    """Lines of bytes with the filter that kinds says for each, written plainly from the format's definition."""
    out = b""
    for y, row in enumerate(rows):
        kind, line = int(kinds[y]), bytearray()
        for i, v in enumerate(row):
            a = int(row[i - step]) if i >= step else 0
            b = int(rows[y - 1][i]) if y else 0
            c = int(rows[y - 1][i - step]) if y and i >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((int(v) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out += bytes([kind]) + line
    return out


def packed(samples, depth):
    """Bytes of (h, w, channels) samples."""
    flat = samples.reshape(len(samples), -1)
    if depth == 16:
        return flat.astype(">u2").view(np.uint8)
    if depth == 8:
        return flat.astype(np.uint8)
    bits = (flat[:, :, None] >> np.arange(depth)[::-1]) & 1
    return np.packbits(bits.reshape(len(flat), -1).astype(np.uint8), axis=1)


def png(samples, depth, kind, kinds=None, laced=False, more=b"", part=50):
    h, w, count = samples.shape
    parts = [samples] if not laced else [samples[y0::dy, x0::dx] for x0, y0, dx, dy in images.PASSES]
    data = b""
    for p in parts:
        if p.size:
            data += filtered(packed(p, depth), max(1, count * depth // 8), np.zeros(len(p)) if kinds is None else np.resize(kinds, len(p)))
    data = zlib.compress(data)
    body = b"".join(chunk(b"IDAT", data[i : i + part]) for i in range(0, len(data), part))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, laced)) + more + body + chunk(b"IEND", b"")


def read(spark, folder, name):
    rows = images.lines(spark, str(folder), name).collect()
    return {(r.band, r.y): r.data for r in rows}


@pytest.mark.parametrize("kinds", [[0], [1], [2], [3], [4], [4, 0, 3, 1, 2]])
@pytest.mark.parametrize("depth, kind, count", [(8, 0, 1), (8, 2, 3), (8, 6, 4), (16, 0, 1), (16, 2, 3), (16, 4, 2), (8, 4, 2)])
def test_every_filter(kinds, depth, kind, count, tmp_path):
    samples = np.random.default_rng(depth + kind).integers(0, 2**depth, (19, 13, count))
    path = tmp_path / "a.png"
    path.write_bytes(png(samples, depth, kind, kinds))
    with images.fs.LocalFileSystem().open_input_file(str(path)) as f:
        head = images.head_of(images.Peek(f), "a.png")
        got = np.concatenate([b for _, b in images.BLOCKS["png"](f, head)])
    assert head[1:5] == (13, 19, depth, count) and (got == samples).all()


def test_blocks_carry_the_line_above(monkeypatch, tmp_path):
    monkeypatch.setattr(images, "BLOCK", 1)
    samples = np.random.default_rng(1).integers(0, 256, (75, 5, 3))
    (tmp_path / "a.png").write_bytes(png(samples, 8, 2, [4, 2, 3]))
    with images.fs.LocalFileSystem().open_input_file(str(tmp_path / "a.png")) as f:
        blocks = list(images.BLOCKS["png"](f, images.head_of(images.Peek(f), "a.png")))
    assert len(blocks) > 4 and (np.concatenate([b for _, b in blocks]) == samples).all()


def test_interlaced_palette_and_few_bits(spark, tmp_path):
    rng = np.random.default_rng(2)
    deep, index, gray = rng.integers(0, 65536, (11, 9, 3)), rng.integers(0, 4, (7, 10, 1)), rng.integers(0, 4, (6, 7, 1))
    (tmp_path / "laced.png").write_bytes(png(deep, 16, 2, [0, 4, 1], laced=True))
    table = rng.integers(0, 256, (4, 3)).astype(np.uint8)
    (tmp_path / "index.png").write_bytes(png(index, 2, 3, more=chunk(b"PLTE", table.tobytes()) + chunk(b"tRNS", b"\x07\x08")))
    (tmp_path / "gray.png").write_bytes(png(gray, 2, 0))
    got = read(spark, tmp_path, "laced.png")
    assert all(got[b, y] == deep[y, :, 2 - b].tolist() for b in range(3) for y in range(11))
    got = read(spark, tmp_path, "index.png")
    full = np.column_stack([table, [7, 8, 255, 255]])[index[:, :, 0]]
    assert all(got[b, y] == full[y, :, c].tolist() for c, b in enumerate((2, 1, 0, 3)) for y in range(7))
    assert read(spark, tmp_path, "gray.png") == {(0, y): (gray[y, :, 0] * 85).tolist() for y in range(6)}


def test_equals_sparks_own_image_reader(spark, tmp_path):
    samples = np.random.default_rng(3).integers(0, 256, (14, 12, 3))
    (tmp_path / "a.png").write_bytes(png(samples, 8, 2, [4, 3, 2, 1, 0]))
    mine = read(spark, tmp_path, "*")
    theirs = {}
    for r in files.tiles_to_cells(files.scan_images(spark, str(tmp_path))).collect():
        theirs.setdefault((r.band, r.y), [0.0] * r.w)[r.x] = r.v
    assert mine == theirs


@pytest.mark.parametrize("name, bits, bands", [("a.png", 16, 3), ("a.png", 16, 4), ("b.png", 8, 1), ("c.tiff", 16, 3), ("c.tif", 8, 1), ("d.tga", 8, 4), ("d.tga", 8, 3), ("e.png", 16, 2)])
def test_written_lines_come_back(spark, tmp_path, name, bits, bands):
    image = np.random.default_rng(4).integers(0, 2**bits, (21, 17, bands)).astype(float)
    order = {2: (0, 3)}.get(bands, range(bands))
    rows = [(7, 21, 17, b, y, image[y, :, i].tolist()) for i, b in enumerate(order) for y in range(21)]
    lines = spark.createDataFrame(rows, "raster_id long, h int, w int, band int, y int, data array<double>").repartition(5)
    done = images.write_lines(lines, tmp_path.as_uri(), F.lit(f"x/{name}"), bits).collect()
    assert len(done) == 1 and done[0].bytes == (tmp_path / "x" / name).stat().st_size and len(list((tmp_path / "x").iterdir())) == 1
    back = {(r.band, r.y): r.data for r in images.lines(spark, tmp_path.as_uri()).collect()}
    assert back == {(r[3], r[4]): r[5] for r in rows}
    head = images.headers(spark, tmp_path.as_uri()).first()
    assert (head.w, head.h, head.bit_depth, head.channels, head.dpi, head.path) == (17, 21, bits, bands, 72.0, f"{tmp_path.as_uri()}/x/{name}")


def test_a_raster_that_lacks_a_line_is_not_written(spark, tmp_path):
    lines = spark.createDataFrame([(1, 3, 2, 0, y, [1.0, 2.0]) for y in (0, 2)], "raster_id long, h int, w int, band int, y int, data array<double>")
    with pytest.raises(Exception, match="2 of 3 lines"):
        images.write_lines(lines, str(tmp_path / "o"), F.lit("a.png")).collect()
    assert list((tmp_path / "o").iterdir()) == []


def test_broken_files_give_no_lines(spark, tmp_path):
    good = png(np.random.default_rng(5).integers(0, 256, (30, 30, 3)), 8, 2, [1])
    damaged = bytearray(good)
    damaged[len(good) // 2] ^= 255
    for name, data in (("cut", good[: len(good) // 2]), ("sum", bytes(damaged)), ("none", b""), ("text", b"not an image"), ("start", good[:20]), ("good", good)):
        (tmp_path / f"{name}.png").write_bytes(data)
    assert {r[0].rpartition("/")[2] for r in images.lines(spark, str(tmp_path)).select("raster_id").distinct().collect()} == {"good.png"}
    assert {r.path.rpartition("/")[2] for r in images.headers(spark, str(tmp_path)).collect()} == {"cut.png", "sum.png", "good.png"}


def test_headers_read_little_and_know_other_formats(spark, tmp_path):
    marker = lambda kind, data: b"\xff" + bytes([kind]) + struct.pack(">H", len(data) + 2) + data
    jpeg = b"\xff\xd8" + marker(0xE0, b"JFIF\0\1\1\2" + struct.pack(">HH", 100, 100) + b"\0\0") + marker(0xE1, b"x" * 60000) + marker(0xC2, struct.pack(">BHHB", 8, 33, 44, 3) + b"\0" * 9) + b"\0" * 200000
    attribute = lambda name, kind, data: name + b"\0" + kind + b"\0" + struct.pack("<I", len(data)) + data
    channels = b"".join(c + b"\0" + struct.pack("<I", 1) + b"\0" * 4 + struct.pack("<II", 1, 1) for c in (b"B", b"G", b"R")) + b"\0"
    exr = b"v/1\x01\x02\0\0\0" + attribute(b"channels", b"chlist", channels) + attribute(b"dataWindow", b"box2i", struct.pack("<4i", 0, 0, 49, 19)) + b"\0" + b"\0" * 100
    far = png(np.zeros((2, 3, 1), int), 8, 0, more=chunk(b"iCCP", b"y" * 300000) + chunk(b"pHYs", struct.pack(">IIB", 11811, 11811, 1)))
    for name, data in (("a.jpg", jpeg), ("b.exr", exr), ("c.png", far)):
        (tmp_path / name).write_bytes(data)
        with images.fs.LocalFileSystem().open_input_file(str(tmp_path / name)) as f:
            peek = images.Peek(f)
            assert images.head_of(peek, name) and peek.taken < 16384
    got = {r.format: (r.w, r.h, r.bit_depth, r.channels, r.dpi) for r in images.headers(spark, str(tmp_path)).collect()}
    assert got == {"jpg": (44, 33, 8, 3, 254.0), "exr": (50, 20, 16, 3, 72.0), "png": (3, 2, 8, 1, round(11811 * 0.0254, 2))}


def test_partitions_are_planned_by_bytes(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"{i:02}.png").write_bytes(png(np.full((9, 9, 1), i), 8, 0))
    size = (tmp_path / "00.png").stat().st_size
    spark.dataSource.register(images.Images)
    some = spark.read.format("raster_images").schema("path string, y int").option("partitionBytes", 3 * size + 10).load(str(tmp_path))
    assert 4 <= some.rdd.getNumPartitions() <= 6 and some.count() == 12 * 9
    assert images.lines(spark, str(tmp_path), "*.jpg").count() == 0


def test_stream_gives_the_rows_of_a_batch_and_each_file_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for n in ("a", "b"):
        (folder / f"{n}.png").write_bytes(png(np.random.default_rng(6).integers(0, 256, (5, 4, 3)), 8, 2, [4]))
        images.lines(spark, str(folder), stream=True).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
    batch = images.lines(spark, str(folder))
    assert spark.read.parquet(out).exceptAll(batch).count() == 0 and batch.count() == spark.read.parquet(out).count() == 30
