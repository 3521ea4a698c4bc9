"""What keeps queries within bounds as tables grow: plans without joins that could be broadcast, results that no batch or table size changes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rastermill.operators import geometry
from test_operators import cells_of, image_of


def turned(image, degrees):
    """Each target from its four taps, reflected at the border."""
    h, w, n = image.shape
    cos, sin = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    y, x = np.mgrid[:h, :w]
    fx, fy = cos * (x - w / 2) - sin * (y - h / 2) + w / 2, sin * (x - w / 2) + cos * (y - h / 2) + h / 2
    ix, iy = np.floor(fx).astype(int), np.floor(fy).astype(int)

    def reflected(p, n):
        m = p % max(1, 2 * n - 2)
        return np.where(n == 1, 0, np.where(m < n, m, 2 * n - 2 - m))

    out = np.zeros(image.shape)
    for j in (0, 1):
        for i in (0, 1):
            k = np.abs(1 - j - (fy - iy)) * np.abs(1 - i - (fx - ix))
            out += k[..., None] * image[reflected(iy + j, h), reflected(ix + i, w)]
    return out


@pytest.mark.parametrize("shape", [(8, 8), (5, 17), (17, 5), (1, 9), (1, 1)])
@pytest.mark.parametrize("degrees", [0, 30, 45, 90, -135.5, 180])
def test_rotation_is_that_of_its_taps_without_a_join(spark, shape, degrees):
    image = np.random.default_rng(1).uniform(0, 255, (*shape, 2))
    out = geometry.rotate(cells_of(spark, image), degrees)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert np.allclose(image_of(out), turned(image, degrees), atol=1e-6)


def shuffled_by(df):
    """Numbers of partitions named in exchanges of the executed plan."""
    import re

    return [int(n) for n in re.findall(r"hashpartitioning\([^\n]*?, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())]


def test_lines_of_sums_are_not_merged_into_few_tasks(spark, sf):
    """Few bytes of sums become many samples, so that their partitions are given, not left to the bytes."""
    from rastermill.fixtures import lineitem_cells, table
    from rastermill.layout import spread

    assert spread(table(spark, sf, "lineitem")) in shuffled_by(lineitem_cells(spark, sf))


def test_kernels_are_one_exchange_of_blocks(spark, sf):
    """No cell is spread over taps: the four kernels are made where a block of lines is."""
    from rastermill import catalog

    plan = catalog.queries()["kernel_build"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "tap" not in plan


def test_grays_of_all_sources_share_one_pass(spark):
    from rastermill.operators import tone

    cells = cells_of(spark, np.random.default_rng(2).uniform(0, 255, (3, 5, 4)))
    both = tone.grays(cells, ["luminance", "max_rgb"])
    assert "Union" not in both._jdf.queryExecution().optimizedPlan().toString()
    found = image_of(both)
    for i, source in enumerate(("luminance", "max_rgb")):
        assert np.allclose(found[..., i], image_of(tone.gray(cells, source))[..., 0])


@pytest.mark.parametrize("block", [40, 1 << 17])
@pytest.mark.parametrize("shape, to", [((24, 32), (7, 9)), ((13, 37), (13, 37)), ((40, 9), (3, 1))])
def test_resampled_lines_are_resized_cells(spark, monkeypatch, shape, to, block):
    from rastermill.operators import scanlines

    monkeypatch.setattr(scanlines, "BLOCK", block)
    monkeypatch.setattr(scanlines, "LEAST", 2)
    cells = cells_of(spark, np.random.default_rng(3).uniform(0, 255, (*shape, 2)))
    lines, size = scanlines.from_cells(cells), lambda e: F.lit(to["hw".index(e)])
    small = scanlines.resampled(lines, size("h"), size("w"), scanlines.area_taps)
    assert np.allclose(image_of(scanlines.to_cells(small)), image_of(geometry.resize_area(cells, size)))
    back = scanlines.resampled(small, F.lit(shape[0]), F.lit(shape[1]), scanlines.cubic_taps)
    plain = geometry.resize_cubic(geometry.resize_area(cells, size), lambda e: F.lit(shape["hw".index(e)]))
    assert np.allclose(image_of(scanlines.to_cells(back)), image_of(plain))


def test_scales_are_one_plan_on_lines(spark):
    """A line is shuffled as an array; no sample is spread over the targets that it reaches."""
    from rastermill.plans import jobs

    cells = cells_of(spark, np.random.default_rng(4).uniform(0, 255, (16, 16, 1)))
    for df in (geometry.multi_scale(cells), jobs.multi_scale_fill(cells, 4, 3)):
        assert "__k" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_batches_are_cut_by_their_samples():
    """A task's arrays follow from the slice, not from the number of rows that Arrow batches hold."""
    import pyarrow as pa

    from rastermill.operators import scanlines

    batch = pa.RecordBatch.from_pydict({"w": [5] * 10 + [100] + [5] * 4})
    parts = list(scanlines._bounded([batch], lambda b: scanlines._ints(b, "w"), 20))
    assert pa.Table.from_batches(parts).column("w").to_pylist() == batch.column("w").to_pylist()
    assert all(sum(p.column("w").to_pylist()[1:]) < 20 for p in parts) and len(parts) > 4


def test_seam_ratio_is_one_exchange_of_lines(spark):
    from rastermill.operators import quality

    image = np.random.default_rng(5).uniform(0, 255, (5, 7, 2))
    ratio = quality.seam_ratio(cells_of(spark, image))
    assert "pair" not in ratio._jdf.queryExecution().optimizedPlan().toString()
    row = ratio.first()
    for found, axis in ((row.x_ratio, 1), (row.y_ratio, 0)):
        d = np.abs(np.roll(image, -1, axis) - image).swapaxes(0, axis)
        assert np.isclose(found, d[-1].mean() / d[:-1].mean())
    flat = quality.seam_ratio(cells_of(spark, image[:1])).first()
    assert flat.y_ratio is None and flat.x_ratio is not None and quality.seam_ratio(cells_of(spark, image[:1, :1])).count() == 0


def test_many_small_files_are_many_partitions(spark):
    """Neither written nor read by one task because their bytes are few."""
    from pyspark.sql.types import StructType

    from rastermill.operators import scanlines
    from rastermill.sources import images

    reader = images.ImageReader({"path": "file:///none"}, StructType.fromDDL("path string, band int, y int, data array<double>"))
    parts = reader.planned([(0, f"{i}.png", 400) for i in range(6000)])
    assert len(parts) > 20 and sum(len(p.files) for p in parts) == 6000
    out = images.write_lines(scanlines.from_cells(cells_of(spark, np.zeros((2, 2, 1)))), "file:///none", F.lit("a.png"))
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("square", [3, 256])
@pytest.mark.parametrize("shape", [(8, 8), (5, 17), (17, 5), (1, 9), (1, 1)])
@pytest.mark.parametrize("degrees", [0, 30, 90, -135.5])
def test_lines_are_turned_in_squares(spark, monkeypatch, shape, degrees, square):
    """A square takes the parts of lines that it is made of; no sample is spread over targets."""
    from rastermill.operators import scanlines

    monkeypatch.setattr(scanlines, "SQUARE", square)
    image = np.random.default_rng(6).uniform(0, 255, (*shape, 2))
    out = scanlines.rotated(scanlines.from_cells(cells_of(spark, image)), degrees)
    assert np.allclose(image_of(scanlines.to_cells(out)), turned(image, degrees), atol=1e-6)


@pytest.mark.parametrize("block", [24, 1 << 17])
def test_patches_meet_blocks_of_lines(spark, monkeypatch, block):
    """Sums are those of each placement, and a patch's line is not shuffled once for each placement of it."""
    from rastermill.operators import scanlines, splat

    monkeypatch.setattr(scanlines, "BLOCK", block)
    monkeypatch.setattr(scanlines, "LEAST", 2)
    rng, h, w = np.random.default_rng(7), 13, 11
    patches, alpha = rng.uniform(0, 255, (3, 4, 5, 2)), rng.uniform(0, 1, (3, 4, 5))
    spots = [(1, i, int(rng.integers(-4, h)), int(rng.integers(-5, w)), int(rng.integers(0, 3))) for i in range(40)]
    placed = spark.createDataFrame(spots, "raster_id long, splat_id int, top int, left int, patch_id int")
    lines = spark.createDataFrame([(1, p, b, y, patches[p, y, :, b].tolist(), alpha[p, y].tolist()) for p in range(3) for b in range(2) for y in range(4)], "raster_id long, patch_id int, band int, py int, v array<double>, alpha array<double>")
    canvas = rng.uniform(0, 255, (h, w, 2))
    total, weight = np.zeros((h, w, 2)), np.zeros((h, w, 2))
    for _, _, top, left, p in spots:
        at = np.ix_((top + np.arange(4)) % h, (left + np.arange(5)) % w)
        total[at] += patches[p] * alpha[p][..., None]
        weight[at] += alpha[p][..., None]
    sizes = spark.createDataFrame([(1, h, w, 4)], "raster_id long, h int, w int, ph int")
    laid = splat.lay(placed, lines, scanlines.from_cells(cells_of(spark, canvas)), sizes, 0.7)
    assert np.allclose(image_of(scanlines.to_cells(laid)), np.where(weight > 0.7, total / np.maximum(weight, 0.7), canvas))
    sums = splat.accumulate_lines(placed, lines, sizes)
    assert np.allclose(image_of(scanlines.to_cells(sums.withColumn("data", F.col("weight")))), weight)
    assert "REPARTITION_BY_NUM" in sums._jdf.queryExecution().executedPlan().toString()


def test_splats_are_made_of_lines(spark, sf):
    """No cell is a row before the result; cells were spread over the targets of a turn and joined again."""
    from rastermill import catalog

    for name in ("splat_synthesis", "splat_accumulate", "splat_resolve"):
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("posexplode") + plan.count("arrays_zip") <= 2 and "__k" not in plan, name


def test_chunks_are_parts_of_lines(spark):
    """Chunks of lines, merged on lines, are those of cells; no cell is a row on the way."""
    from rastermill.operators import scanlines, seams
    from rastermill.plans import jobs

    image = np.random.default_rng(8).uniform(0, 255, (21, 30, 2))
    cells = cells_of(spark, image)
    keyed = geometry.split_tiles(cells, 8, 3).withColumn("raster_id", F.struct("raster_id", "cy", "cx", "y0", "x0"))
    laid = seams.overlap_synthesis(keyed, 0.25, 0.25, 0.5)
    plain = geometry.merge_feathered(laid.select("raster_id.*", "h", "w", "band", "y", "x", "v"), cells, 3)
    lines = jobs.chunked_overlap_lines(scanlines.from_cells(cells), 8, 3, 0.25, 0.5)
    assert "posexplode" not in lines._jdf.queryExecution().optimizedPlan().toString()
    assert np.allclose(image_of(scanlines.to_cells(lines)), image_of(plain))


def test_small_files_share_batches(spark, tmp_path):
    """Read in few batches; and prints of lines are those of cells, without a row for each cell."""
    from pyspark.sql.types import StructType

    from rastermill.operators import scanlines, store
    from rastermill.sources import images
    from rastermill.streaming import requests

    image = np.random.default_rng(9).integers(0, 255, (4, 5, 3)).astype(float)
    lines = scanlines.from_cells(cells_of(spark, image, 1).unionByName(cells_of(spark, 255 - image[:3], 2)))
    many = lines.withColumn("raster_id", F.explode(F.array(*[F.col("raster_id") + 2 * i for i in range(20)])))
    images.write_lines(many, f"file://{tmp_path}", F.concat(F.col("raster_id").cast("string"), F.lit(".png"))).collect()
    reader = images.ImageReader({"path": f"file://{tmp_path}"}, StructType.fromDDL("path string, band int, y int, data array<double>"))
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(batches) == 1 and batches[0].num_rows == 20 * 3 * (4 + 3)
    prints = lambda df: dict(df.collect())
    assert prints(store.fingerprint_lines(lines)) == prints(store.fingerprint(scanlines.to_cells(lines), whole=True))
    assert "posexplode" not in requests.image_jobs(lines, "mirror")._jdf.queryExecution().optimizedPlan().toString()


def test_exports_are_made_of_lines(spark, monkeypatch):
    """No cell is saved or shuffled on the way to the maps; a raster that is dim is still spread by itself."""
    from rastermill.operators import stencil
    from rastermill.plans import jobs

    kept = []
    for module in (jobs, stencil):
        monkeypatch.setattr(module, "saved", lambda df, was=module.saved: kept.append(df.columns) or was(df))
    rng = np.random.default_rng(10)
    dim, light = rng.uniform(0, 1, (6, 8, 3)), rng.uniform(0, 255, (6, 8, 3))
    out = jobs.export_package(cells_of(spark, dim, 1).unionByName(cells_of(spark, light, 2)), 8)
    assert kept and not any("x" in columns for columns in kept)
    base = {i: image_of(out.where(f"map = 'BaseColor' AND raster_id = {i}")) for i in (1, 2)}
    assert np.array_equal(base[1], np.floor(dim * 65535)) and np.array_equal(base[2], np.floor(light * 257))
    maps = {r.map: (r.n, r.bands) for r in out.groupBy("map").agg(F.count("v").alias("n"), F.countDistinct("band").alias("bands")).collect()}
    assert maps == {m: (2 * 6 * 8 * 3, 3) for m in ("BaseColor", "Normal", "Roughness", "AO", "Displacement", "Opacity")}


def test_light_is_removed_on_lines(spark, monkeypatch):
    """No step saves or shuffles cells, and no block of columns is a call of its own."""
    from rastermill.operators import scanlines, stencil

    kept = []
    monkeypatch.setattr(stencil, "saved", lambda df, was=stencil.saved: kept.append(df.columns) or was(df))
    image = np.random.default_rng(11).uniform(0, 255, (9, 14, 3))
    amounts = {"strength": 0.5, "flatness": 0.3, "shadow": 0.2, "highlight": 0.2, "contrast": 0.2, "ao": 0.2, "edges": 0.2}
    out = stencil.delight(cells_of(spark, image), **amounts)
    assert kept and not any("x" in columns for columns in kept)
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
    found = image_of(out)
    assert found.shape == image.shape and np.isfinite(found).all()
    # beside a raster of another size the result stays
    beside = stencil.delight(cells_of(spark, image).unionByName(cells_of(spark, 255 - image[:4, :5], 2)), **amounts)
    assert np.array_equal(image_of(beside.where("raster_id = 1")), found)
    lines = scanlines.from_cells(cells_of(spark, image))
    means = {(r.raster_id, r.band): r["mean"] for r in scanlines.means(lines).collect()}
    assert np.allclose([means[1, b] for b in range(3)], image.mean((0, 1)))


def test_rasters_of_rows_are_filled_in_batches(spark, sf):
    """No sample is looked up by itself in a map of its line, and the flagship saves no lines."""
    from rastermill import catalog
    from rastermill.fixtures import lineitem_lines

    assert "lambda" not in lineitem_lines(spark, sf, 64)._jdf.queryExecution().optimizedPlan().toString()
    plan = catalog.queries()[catalog.FLAGSHIP](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "RDD" not in plan


def test_lines_to_write_are_slices_of_their_batch():
    """Also where a batch is itself a slice, and without a call of Arrow for each line."""
    import pyarrow as pa

    from rastermill.sources import images

    data = [[0.0], [1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]
    batch = pa.RecordBatch.from_pydict({"name": ["z", "a", "a", "b"], "h": [1] * 4, "w": [1, 2, 2, 2], "y": [0] * 4, "data": data}).slice(1)
    found = [(key, [r.tolist() for r in rows]) for key, rows in images._by_line([batch])]
    assert found == [(("a", 1, 2, 0), data[1:3]), (("b", 1, 2, 0), data[3:])]
