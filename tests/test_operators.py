"""Properties of operators on rasters of our own, against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rastermill.operators import geometry, masks, pyramid, quality, scanlines, seams, splat, stencil, store, tone
from rastermill.plans import jobs
from rastermill.sources import files
from rastermill.streaming import requests


def cells_of(spark, image, raster_id=1):
    image = np.atleast_3d(image)
    h, w, n = image.shape
    y, x, b = np.mgrid[:h, :w, :n]
    return spark.createDataFrame(pd.DataFrame({"raster_id": raster_id, "h": h, "w": w, "band": b.ravel(), "y": y.ravel(), "x": x.ravel(), "v": image.ravel().astype(float)})).select("raster_id", *[F.col(c).cast("int").alias(c) for c in ("h", "w", "band", "y", "x")], "v")


def image_of(cells):
    p = cells.toPandas()
    out = np.full((p.h.max(), p.w.max(), p.band.max() + 1), np.nan)
    out[p.y, p.x, p.band] = p.v
    return out


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(0).uniform(0, 255, (24, 32, 3))


def test_offset_is_a_roll_and_reverses(spark, noise):
    shifted = geometry.offset(cells_of(spark, noise))
    assert np.array_equal(image_of(shifted), np.roll(noise, (12, 16), (0, 1)))
    assert np.array_equal(image_of(geometry.offset(shifted, back=True)), noise)


def test_mirror_quadrants(spark, noise):
    out = image_of(geometry.mirror_tile(cells_of(spark, noise)))
    wide = np.concatenate([noise, noise[:, ::-1]], 1)
    assert np.array_equal(out, np.concatenate([wide, wide[::-1]], 0))


@pytest.mark.parametrize("mode,border", [("wrap", "wrap"), ("edge", "replicate"), ("reflect", "reflect")])
@pytest.mark.parametrize("pad", [2, 40])
def test_pad_is_numpy_pad(spark, noise, mode, border, pad):
    assert np.array_equal(image_of(geometry.pad_border(cells_of(spark, noise[:, :, 0]), pad, border))[:, :, 0], np.pad(noise[:, :, 0], pad, mode=mode))


def test_crossfade_edges_are_equal(spark, noise):
    out = image_of(jobs.offset_crossfade(cells_of(spark, noise)))
    assert np.allclose(out[:, 0], out[:, -1]) and np.allclose(out[0], out[-1])


def test_results_do_not_depend_on_company(spark, noise):
    """Splat synthesis and jobs with own parameters: a raster alone and beside a larger one."""
    small, large = cells_of(spark, noise[:16, :20], 1), cells_of(spark, noise.repeat(2, 0), 2)
    both = small.unionByName(large)
    make = lambda c: splat.synthesize(c, scale=0.5, rand_rot=0.4, wobble=0.3, seed=3, count=4)[0].where("raster_id = 1")
    assert np.allclose(image_of(make(small)), image_of(make(both)))
    asked = spark.createDataFrame([(1, "splat", 0.5, 0.5), (2, "splat", 0.25, None)], "raster_id long, method string, splat_scale double, splat_random_rotation double")
    job = lambda c: jobs.seamless(c, asked, splat_wobble=0.3).where("raster_id = 1")
    alone = image_of(job(small))
    assert np.allclose(alone, image_of(job(both))) and not np.allclose(alone, noise[:16, :20]) and np.isfinite(alone).all()


def test_zero_overlap_is_identity(spark, noise):
    assert np.allclose(image_of(seams.overlap_synthesis(cells_of(spark, noise), 0, 0)), noise)


def test_overlap_lowers_seam_ratio(spark):
    y, x = np.mgrid[:32, :32]
    image = 128 + 100 * np.sin(x / 9) * np.cos(y / 7)
    cells = cells_of(spark, image)
    before, after = (quality.seam_ratio(c).first() for c in (cells, seams.overlap_synthesis(cells, 0.3, 0.3, 0.8)))
    assert after.x_ratio < 1.5 < before.x_ratio


def matched(a, b, columns=("v",)):
    a, b = (c.toPandas().sort_values(["raster_id", "band", "y", "x"]).reset_index(drop=True) for c in (a, b))
    return len(a) == len(b) and (a[["h", "w", "y", "x"]] == b[["h", "w", "y", "x"]]).all(axis=None) and np.allclose(a[list(columns)], b[list(columns)])


def test_blocks_of_lines_equal_cells(spark, noise, monkeypatch):
    monkeypatch.setattr(scanlines, "BLOCK", 64)
    monkeypatch.setattr(scanlines, "LEAST", 3)
    cells = cells_of(spark, noise)
    taps = stencil.derivative_taps("blended_sobel")
    for border in ("wrap", "replicate", "reflect"):
        assert matched(*[f(cells, taps, ["du", "dv"], border) for f in (stencil.correlate_cells, stencil.correlate)], columns=("v", "du", "dv"))


def test_lines_equal_cells(spark, noise):
    """Odd sizes, with three and one rows of different rasters in one table."""
    cells = cells_of(spark, noise).unionByName(geometry.crop(cells_of(spark, noise), top=1, left=3, bottom=2).withColumn("raster_id", F.col("raster_id") + 100))
    lines = scanlines.from_cells(cells)
    assert matched(scanlines.to_cells(lines), cells)
    assert matched(scanlines.to_cells(scanlines.crossfade(lines, 0.7)), seams.linear_crossfade(cells, 0.7))
    moved = geometry.offset(seams.linear_crossfade(geometry.offset(cells), 0.7), back=True)
    assert matched(scanlines.to_cells(scanlines.crossfade(lines, 0.7, border=True)), moved)
    for one_sided in (False, True):
        assert matched(scanlines.to_cells(scanlines.blend_symmetric(lines, seams.half_width(0.9), one_sided)), seams.blend_symmetric(cells, 0.9, one_sided=one_sided))
    assert matched(scanlines.to_cells(scanlines.overlap(lines, 0.2, 0.4, 0.1)), seams.overlap_synthesis(cells, 0.2, 0.4, 0.1))
    assert matched(scanlines.to_cells(scanlines.resize_wrapped(lines, 40, 9)), geometry.resize_wrapped(cells, lambda e: F.lit(40 if e == "h" else 9)))
    a, b = (x.toPandas().sort_values("raster_id").reset_index(drop=True) for x in (scanlines.seam_error(lines), quality.seam_error(cells)))
    assert len(a) == 2 and np.allclose(a, b)


def test_partitions_do_not_matter(spark, noise):
    cells = cells_of(spark, noise)
    outs = [image_of(seams.blend_symmetric(cells.repartition(n), 0.6)) for n in (1, 7, 64)]
    assert np.allclose(outs[0], outs[1]) and np.allclose(outs[0], outs[2])


def test_flat_normals(spark):
    out = image_of(stencil.normal_map(cells_of(spark, np.full((8, 8), 0.5))))
    assert (out[:, :, 0] == 65535).all() and (out[:, :, 1:] == 32767).all()


def test_alpha_stays(spark):
    height, alpha = cells_of(spark, np.full((8, 8), 0.5)), cells_of(spark, np.full((8, 8), 0.25))
    assert (image_of(stencil.normal_map(height, alpha=alpha))[:, :, 3] == 16383).all()
    maps = jobs.pbr_maps(height, smooth=0, alpha=alpha)
    assert {(r.map, r.v) for r in maps.where("band = 3").select("map", "v").distinct().collect()} == {("Normal", 16383.0), *[(m, 63.0) for m in ("Displacement", "Roughness", "AO", "Opacity")]}


def test_pyramid_ends_at_one_cell(spark, noise):
    out = pyramid.mipmaps(cells_of(spark, np.floor(noise[:9, :20])), "Roughness").groupBy("level").agg(F.max("h").alias("h"), F.max("w").alias("w")).collect()
    assert sorted((r.level, r.h, r.w) for r in out) == [(0, 9, 20), (1, 4, 10), (2, 2, 5), (3, 1, 2), (4, 1, 1)]


def test_lit_column_wraps(spark):
    image = np.zeros((6, 6))
    image[:, 0] = 1
    cells = cells_of(spark, image)
    wrapped = stencil.four_sample_slopes(cells, True).where("x = 5").select("du").distinct().collect()
    clamped = stencil.four_sample_slopes(cells, False).where("x = 5").select("du").distinct().collect()
    assert [r.du for r in wrapped] == [0.5] and [r.du for r in clamped] == [0.0]


def test_min_z(spark, noise):
    out = image_of(stencil.normal_map(cells_of(spark, noise[:, :, 0] / 255), min_z=0.8))
    assert (out[:, :, 0] / 65535 * 2 - 1 >= 0.8 - 1e-4).all()


def test_premultiplied_mip(spark):
    image = np.zeros((2, 2, 4))
    image[:, 0] = (255, 0, 0, 0)
    image[:, 1] = (0, 0, 255, 255)
    assert image_of(pyramid.color_step(cells_of(spark, image)))[0, 0].tolist() == [0, 0, 255, 128]


def test_mip_sizes_of_a_long_raster(spark):
    levels = pyramid.mipmaps(cells_of(spark, np.zeros((8, 4))), "height", 3).groupBy("level").agg(F.max("h").alias("h"), F.max("w").alias("w")).orderBy("level").collect()
    assert [(r.h, r.w) for r in levels] == [(8, 4), (4, 2), (2, 1), (1, 1)]


def test_lab_round_trip(spark, noise):
    back = image_of(tone.lab_to_bgr(tone.bgr_to_lab(cells_of(spark, noise))))
    assert np.abs(back - noise).mean() < 2


def test_light_removal_evens_a_gradient(spark):
    y, x = np.mgrid[:48, :48]
    image = np.repeat((60 + 3 * x + 10 * ((x + y) % 2))[:, :, None], 3, 2).astype(float)
    out = image_of(stencil.delight(cells_of(spark, image), strength=1.0))
    assert np.ptp(out.mean((0, 2))) < np.ptp(image.mean((0, 2)))
    same = image_of(stencil.delight(cells_of(spark, image), contrast=1.0, edges=1.0))
    assert np.array_equal(same, image)


@pytest.mark.parametrize("wobble,falloff", [(0.0, 0.05), (0.5, 0.5), (0.9, 0.3)])
def test_splats_cover(spark, noise, wobble, falloff):
    cells = cells_of(spark, noise)
    out, weights = splat.synthesize(cells, scale=0.5, rand_rot=0.5, wobble=wobble, falloff=falloff, count=2)
    assert quality.coverage(weights).first().uncovered == 0
    assert image_of(out).shape == noise.shape


def test_gap_fill_of_a_constant(spark):
    image = np.full((10, 10), 7.0)
    broken = image.copy()
    broken[4:6, 4:6] = 200
    cells = cells_of(spark, broken)
    mask = masks.over(cells, F.when(F.col("y").between(4, 5) & F.col("x").between(4, 5), 255.0).otherwise(0.0))
    assert np.allclose(image_of(stencil.gap_fill(cells, mask, 3))[:, :, 0], image)


def test_empty_cells_stay_empty(spark, noise):
    none = cells_of(spark, noise).where("false")
    for f in (geometry.mirror_tile, geometry.offset, seams.linear_crossfade, seams.blend_symmetric, seams.overlap_synthesis, stencil.normal_map, tone.gray, lambda c: geometry.resize_area(c, 5), lambda c: stencil.delight(c, strength=0.5), tone.normalize_ingest):
        assert f(none).count() == 0


@pytest.mark.parametrize("bits,bands", [(8, 3), (8, 1), (8, 4), (16, 3)])
def test_png_round_trip(spark, noise, tmp_path, bits, bands):
    image = np.floor(np.resize(noise, (24, 32, bands)) * (257 if bits == 16 else 1))
    written = files.write_png(cells_of(spark, image), str(tmp_path), F.concat(F.lit("r"), F.col("raster_id").cast("string"), F.lit(".png")), bits).collect()
    (tmp_path / "broken.png").write_bytes(b"no image")
    head = files.png_headers(spark.read.format("binaryFile").load(str(tmp_path))).first()
    assert (head.w, head.h, head.bit_depth, head.channels, head.dpi) == (32, 24, bits, bands, 72.0) and len(written) == 1
    back = image_of(files.tiles_to_cells(files.scan_images(spark, str(tmp_path), tile=10), tile=10))
    assert np.abs(back - np.floor(image / (257 if bits == 16 else 1))).max() <= (1 if bits == 16 else 0)
    assert files.read_catalog(spark, str(tmp_path)).count() == 2


def test_tiles_round_trip(spark, noise, tmp_path):
    files.write_tiles(cells_of(spark, noise), str(tmp_path / "t"), 10)
    tiles = spark.read.parquet(str(tmp_path / "t"))
    assert tiles.count() == 3 * 4 * 3 and tiles.agg(F.sum(F.size("data"))).first()[0] == noise.size


def test_tiff_and_tga(spark, noise, tmp_path):
    """Files of other formats hold the samples where their headers say."""
    whole = np.floor(noise[:6, :9])
    cells = cells_of(spark, whole)
    for name, bits in (("a.tiff", 8), ("b.tif", 16), ("c.tga", 8)):
        files.write_files(cells, str(tmp_path), F.lit(name), bits).collect()
        data = (tmp_path / name).read_bytes()
        if name.endswith("tga"):
            assert data[2] == 2 and int.from_bytes(data[12:14], "little") == 9 and data[16] == 24
            got = np.frombuffer(data[18:], np.uint8).reshape(6, 9, 3)
        else:
            at = int.from_bytes(data[4:8], "big")
            tags = {int.from_bytes(data[at + 2 + 12 * i :][:2], "big"): int.from_bytes(data[at + 10 + 12 * i :][:4], "big") for i in range(int.from_bytes(data[at : at + 2], "big"))}
            assert tags[256] == 9 and tags[257] == 6 and tags[273] == 8 and int.from_bytes(data[tags[258] : tags[258] + 2], "big") == bits
            got = np.frombuffer(data[8 : 8 + tags[279]], ">u2" if bits == 16 else np.uint8).reshape(6, 9, 3)[:, :, ::-1]
        assert (got == whole).all()


def test_png_header_far_into_the_file():
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + b"\0\0\0\0"
    start = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (7).to_bytes(4, "big") + (5).to_bytes(4, "big") + b"\x08\x06\0\0\0")
    dense = chunk(b"pHYs", (11811).to_bytes(4, "big") * 2 + b"\x01")
    assert files._png_header(memoryview(start + chunk(b"tEXt", b"x" * 100_000) + dense)) == (7, 5, 8, 4, 300.0)
    assert files._png_header(memoryview(start + chunk(b"tEXt", dense) + chunk(b"IDAT", dense))) == (7, 5, 8, 4, 72.0)
    assert files._png_header(memoryview(b"no png")) is None


def test_packages(spark, noise, tmp_path):
    cells, materials = cells_of(spark, noise[:8, :8]), spark.createDataFrame([(1, "My rock")], "raster_id long, name string")
    plain = jobs.export_package(cells, 8, "ue5", packing=False)
    packed = jobs.export_package(cells, 8, "ue5", clamp=True)
    by = {m: image_of(packed.where(F.col("map") == m)) for m in ("ORM", "Displacement")}
    single = {m: image_of(plain.where(F.col("map") == m)) for m in ("AO", "Roughness", "Displacement")}
    assert (by["ORM"][:, :, 2] == single["AO"][:, :, 0]).all() and (by["ORM"][:, :, 1] == single["Roughness"][:, :, 0]).all() and not by["ORM"][:, :, 0].any()
    assert (by["Displacement"] == np.clip(single["Displacement"], 8, 247)).all()
    written = {r.path.rpartition(str(tmp_path))[2] for r in jobs.write_package(packed, materials, str(tmp_path), "ue5").collect()}
    assert written == {f"/My_rock_UE5/{n}.png" for n in ("T_My_rock_D", "T_My_rock_N", "T_My_rock_ORM", "My_rock_UE5_Displacement")}
    glossy = jobs.export_package(cells, 8, "vray", glossiness=True)
    assert set(jobs.write_package(glossy, materials, str(tmp_path), "vray", glossiness=True).select(F.regexp_extract("path", "([^_]+)$", 1)).toPandas().iloc[:, 0]) == {"BaseColor.tiff", "Normal.tiff", "Glossiness.tiff", "AO.tiff", "Displacement.tiff"}


def test_export_package(spark, noise):
    maps = jobs.export_package(cells_of(spark, noise), 48, "vray").groupBy("map").agg(F.max("h").alias("h"), F.max("w").alias("w"), F.max("v").alias("v")).collect()
    assert {r.map for r in maps} == {"BaseColor", "Normal", "Roughness", "AO", "Displacement", "Opacity"}
    assert all((r.h, r.w) == (36, 48) and r.v <= 65535 for r in maps)


def test_seam_fill_of_large_rasters(spark, noise):
    out = image_of(jobs.seam_fill(cells_of(spark, noise), 4, 3, largest=16))
    assert out.shape == noise.shape and np.isfinite(out).all() and np.allclose(out[0, 0], noise[0, 0])


def test_seam_fill_of_wide_seams(spark):
    image = np.full((80, 80), 7.0)
    image[25:55], image[:, 25:55] = 200, 200
    cells = cells_of(spark, image)
    assert np.allclose(image_of(jobs.seam_fill(cells)), 7)
    assert np.allclose(image_of(jobs.seam_fill(cells, radius=5)), 7)
    image[24:56], image[:, 24:56] = 200, 200  # whole cells at each scale
    left = np.prod([1 - 0.3 * s for s in (1.0, 0.5, 0.25)])
    out = image_of(jobs.multi_scale_fill(cells_of(spark, image), 32))
    assert np.allclose(out[40], 200 * left + 7 * (1 - left)) and np.allclose(out[5, 5], 7)


@pytest.mark.parametrize("job", [
    lambda c: stencil.remove_ao(c.where("band = 0"), 0.6), lambda c: stencil.remove_light(c.where("band = 0"), 0.5),
    lambda c: jobs.seam_fill(c, 4, 3, largest=32), lambda c: jobs.seam_fill(c, 4, largest=16), lambda c: jobs.export_package(c, 40).where("map = 'BaseColor'"),
])
def test_larger_rasters_beside_change_nothing(spark, noise, job):
    one, large = cells_of(spark, noise), cells_of(spark, np.tile(noise, (5, 5, 1)), 2)
    alone, beside = (image_of(job(c).where("raster_id = 1").select("raster_id", "h", "w", "band", "y", "x", "v")) for c in (one, one.unionByName(large)))
    assert alone.shape == beside.shape and np.allclose(alone, beside, atol=1e-6)


def test_cubic_identity_and_scales(spark, noise):
    cells = cells_of(spark, noise)
    assert np.allclose(image_of(geometry.resize_cubic(cells, lambda e: F.col(e))), noise)
    assert np.isfinite(image_of(jobs.multi_scale_fill(cells, 4, 3))).all()


def test_full_fingerprint_tells_rasters_apart(spark, noise):
    other = noise.copy()
    other[5, 5, 1] += 1
    rows = cells_of(spark, noise, 1).union(cells_of(spark, noise, 2)).union(cells_of(spark, other, 3))
    assert sorted((r.raster_id, r.copies) for r in store.dedup_exact(rows).collect()) == [(1, 2), (3, 1)]


def test_stream_of_requests_keeps_the_newest(spark, tmp_path):
    for i, rows in enumerate(([(1, 5), (1, 7), (2, 3)], [(1, 6), (2, 4)])):
        spark.createDataFrame(rows, "image_id long, generation long").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("image_id long, generation long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = requests.latest_wins(stream).writeStream.format("memory").queryName("newest").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    seen = spark.sql("SELECT image_id, max(generation) AS g, count(*) AS n FROM newest GROUP BY image_id").collect()
    assert {r.image_id: r.g for r in seen} == {1: 7, 2: 4}


def test_debounce_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT 1L AS image_id, timestampadd(MINUTE, m, timestamp'2024-01-01') AS ts, cast(m AS long) AS generation FROM VALUES (0), (10), (15), (60), (61), (500) t(m)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = requests.debounce(stream, "30 minutes", "1 minute")
    out.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    batch = {(r.first_ts, r.generation) for r in requests.debounce(rows).collect()}
    streamed = {(r.first_ts, r.generation) for r in spark.table("bursts").collect()}
    assert len(batch) == 3 and streamed == {b for b in batch if b[1] != 500}


def test_folder_ingest_is_incremental(spark, noise, tmp_path):
    folder, seen = tmp_path / "images", []
    name = lambda n: F.lit(f"{n}.png")
    for n in ("a", "b"):
        files.write_png(cells_of(spark, noise), str(folder), name(n)).collect()
        requests.ingest_folder(spark, str(folder), str(tmp_path / "c"), lambda f, batch: seen.extend(r.path.rpartition("/")[2] for r in f.collect()))
    assert seen == ["a.png", "b.png"]


def test_no_blend_is_identity(spark, noise):
    cells = cells_of(spark, noise)
    for same in (seams.blend_symmetric(cells, 0.0), seams.blend_with_original(cells, cells, 0.0), seams.blend_symmetric(cells, fixed=1)):
        assert np.array_equal(image_of(same), noise)


def test_odd_sizes_blend(spark, noise):
    out = image_of(seams.blend_symmetric(cells_of(spark, noise[:23, :31]), 1.0))
    crossed = image_of(seams.linear_crossfade(cells_of(spark, noise[:23, :31])))
    assert out.shape == crossed.shape == (23, 31, 3) and np.isfinite(out).all() and np.isfinite(crossed).all()


@pytest.mark.parametrize("shape", [(13, 21), (1, 9), (40, 7)])
@pytest.mark.parametrize("size, sigma", [(7, 2.0), (45, 15.0), (0, 6.0)])
def test_blur_by_turned_blocks_is_that_of_taps(spark, shape, size, sigma):
    """Blocks of columns give what the halo of taps gives, with kernels beyond the raster and blocks that don't divide it."""
    image = np.random.default_rng(3).uniform(0, 255, (*shape, 1))
    lines = scanlines.from_cells(cells_of(spark, image))
    kernel = stencil.gaussian_kernel(size, sigma)
    far = len(kernel) // 2
    taps = [([(i - far, 0, [k]) for i, k in enumerate(kernel)], ["data"]), ([(0, i - far, [k]) for i, k in enumerate(kernel)], ["data"])]
    plain = image_of(scanlines.to_cells(scanlines.correlate(lines, taps, "reflect").select(*scanlines.LINE)))
    turned = scanlines.blurs(lines, {"soft": (F.lit(size), F.lit(sigma))}, stencil.gaussian_kernel, width=4)
    assert np.allclose(image_of(scanlines.to_cells(turned.withColumn("data", F.col("soft")))), plain, atol=1e-8)
    assert np.allclose(image_of(scanlines.to_cells(turned)), image)


def test_percentiles_are_exact_by_selection(spark, monkeypatch):
    """Several rounds, ties across the ranks, one value only, and samples that are no numbers."""
    monkeypatch.setattr(quality, "BINS", 4)
    monkeypatch.setattr(quality, "SORTED", 5)
    draw = np.random.default_rng(4)
    bands = [draw.normal(size=400), draw.integers(0, 3, 400).astype(float), np.full(400, 7.0), np.r_[draw.exponential(size=398) ** 4, np.nan, 0.5]]
    rows = [(1, b, float(v)) for b, band in enumerate(bands) for v in band] + [(2, 0, 3.0)]
    got = {(r.raster_id, r.band): r.p for r in quality.percentiles(spark.createDataFrame(rows, "raster_id long, band int, v double"), [0.02, 0.5, 0.98]).collect()}
    for b, band in enumerate(bands):
        assert np.allclose(got[1, b], np.quantile(band[~np.isnan(band)], [0.02, 0.5, 0.98]), atol=1e-12)
    assert got[2, 0] == [3.0, 3.0, 3.0]


@pytest.mark.parametrize("name, bands", [("height", 1), ("height", 3), ("BaseColor", 4), ("Normal", 4)])
@pytest.mark.parametrize("shape", [(16, 16), (13, 7), (1, 9), (37, 22)])
def test_pyramids_on_lines_are_those_on_cells(spark, monkeypatch, name, bands, shape):
    """Odd sizes, blocks of one or a few levels, so that lines lie in two blocks and rounds follow each other."""
    monkeypatch.setattr(pyramid, "BLOCK", 64)
    image = np.floor(np.random.default_rng(5).uniform(0, 256, (*shape, bands)))
    if name == "Normal":
        image[..., 2] = 192 + image[..., 2] / 4
    cells = cells_of(spark, image)
    plain = pyramid.mip_levels(cells, pyramid.STEPS.get(name.lower(), pyramid.scalar_step))
    key = ["level", "h", "w", "band", "y", "x"]
    want = plain.select(*key, "v").toPandas().astype(float).sort_values(key).to_numpy()
    got = pyramid.mipmaps(cells, name).select(*key, "v").toPandas().astype(float).sort_values(key).to_numpy()
    assert (want[:, :6] == got[:, :6]).all() and np.abs(want[:, 6] - got[:, 6]).max() <= 1 and (want[:, 6] != got[:, 6]).mean() < 0.02


def test_gap_fill_by_blocks_is_that_of_the_plain_rule(spark, monkeypatch):
    """Rounds over blocks of a few lines: gaps wider than the radius, at the border, and one raster all gaps."""
    monkeypatch.setattr(stencil, "FILLED", 40)
    draw = np.random.default_rng(6)
    image, gap = draw.uniform(0, 255, (23, 13)), np.zeros((23, 13), bool)
    gap[8:15, :], gap[:, 5:9], gap[0, 0] = True, True, True
    want, open_ = image.copy(), gap.copy()
    while open_.any():
        known, before = ~open_, want.copy()
        for y, x in np.argwhere(open_):
            near = [(before[j, i], 1 / ((j - y) ** 2 + (i - x) ** 2)) for j, i in np.argwhere(known) if 0 < (j - y) ** 2 + (i - x) ** 2 <= 9]
            if near:
                want[y, x] = sum(v * k for v, k in near) / sum(k for _, k in near)
                open_[y, x] = False
    cells = cells_of(spark, image).unionByName(cells_of(spark, image[:5, :5]).withColumn("raster_id", F.lit(2).cast("long")))
    mask = [(1, int(y), int(x), 255.0) for y, x in np.argwhere(gap)] + [(2, y, x, 1.0) for y in range(5) for x in range(5)]
    out = stencil.gap_fill(cells, spark.createDataFrame(mask, "raster_id long, y int, x int, v double"), 3)
    assert np.allclose(image_of(out.where("raster_id = 1"))[..., 0], want) and np.allclose(image_of(out.where("raster_id = 2"))[..., 0], image[:5, :5])


def test_latest_wins_drops_stale_requests_and_old_state(spark, tmp_path):
    """Three micro-batches: an older generation within the gap is stale; once the gap is over, the target's state is gone."""
    schema = "image_id long, generation long, ts timestamp"
    hour = lambda h: (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)).to_pydatetime()
    batches = [[(1, 5, hour(0)), (2, 1, hour(0))], [(1, 4, hour(1)), (2, 2, hour(1))], [(3, 1, hour(30))], [(1, 3, hour(31))], [(2, 1, hour(2))]]
    seen = []
    (tmp_path / "in").mkdir()
    newest = requests.latest_wins(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ts="ts", keep="6 hours")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        write = newest.writeStream.foreachBatch(lambda df, i: seen.extend((r.image_id, r.generation) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/state")
        query = write.trigger(availableNow=True).start()
        query.awaitTermination()
    # generation 4 of image 1 is stale; 30 hours later its state is dropped, so 3 counts as new; the last row is too late
    assert seen[:2] in ([(1, 5), (2, 1)], [(2, 1), (1, 5)]) and seen[2:] == [(2, 2), (3, 1), (1, 3)]


def test_dedup_hashes_only_rasters_that_share_a_fingerprint(spark):
    """Rasters that agree in all sampled pixels but not in all are told apart; copies are found."""
    image = np.random.default_rng(7).integers(0, 255, (32, 32, 1)).astype(float)
    other = image.copy()
    other[1, 1] += 1
    cells = cells_of(spark, image, 4).unionByName(cells_of(spark, image, 2)).unionByName(cells_of(spark, other, 3)).unionByName(cells_of(spark, image + 1, 1))
    assert sorted((r.raster_id, r.copies) for r in store.dedup_exact(cells).collect()) == [(1, 1), (2, 2), (3, 1)]
