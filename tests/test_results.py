"""The store of results: replayed batches, uses, eviction, compaction, and folders worked through by a stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rastermill.operators import scanlines
from rastermill.sources import images
from rastermill.sources.results import Results
from rastermill.streaming import requests

LINE = "result_key string, raster_id long, h int, w int, band int, y int, data array<double>"


def at(hour):
    return F.lit(dt.datetime(2024, 1, 1, hour))


def lines_of(spark, values):
    """A raster of two lines for each key."""
    return spark.createDataFrame([(k, i, 2, 3, 0, y, [float(v)] * 3) for i, (k, v) in enumerate(values.items()) for y in range(2)], LINE)


def jobs_of(spark, *keys):
    return spark.createDataFrame([(100 + i, k) for i, k in enumerate(keys)], "raster_id long, result_key string")


def served(spark, results, *keys):
    return {(r.raster_id, r.y): r.data[0] for r in results.serve(jobs_of(spark, *keys)).collect()}


@pytest.fixture
def results(spark, tmp_path):
    out = Results(spark, f"{tmp_path}/r")
    out.commit(lines_of(spark, {"a": 1, "b": 2, "c": 3}), 0, at(1))
    out.commit(lines_of(spark, {"d": 4}), 1, at(2))
    return out


def keys(results):
    return {r.result_key for r in results.index().collect()}


def test_an_empty_store(spark, tmp_path):
    empty = Results(spark, f"{tmp_path}/r")
    assert keys(empty) == set() and served(spark, empty, "a") == {} and empty.stats().first()[:] == (0, 0)
    assert empty.missing(jobs_of(spark, "a"), 0).count() == 1
    empty.evict(3, 0)
    assert empty.compact(5) == []


def test_a_replayed_batch_adds_nothing(spark, results):
    before = results.stats().first()
    results.commit(lines_of(spark, {"a": 9, "c": 9}), 0, at(5))
    with pytest.raises(ValueError, match="other results"):
        results.commit(lines_of(spark, {"a": 9, "x": 9}), 0, at(5))
    assert results.stats().first() == before == (4, 4 * 48) and served(spark, results, "a", "x") == {(100, 0): 1.0, (100, 1): 1.0}


def test_a_batch_without_an_index_does_not_count_and_is_made_anew(spark, results):
    results._write(lines_of(spark, {"e": 7}), "lines", 2)  # where a writer was lost before its index
    assert keys(results) == set("abcd") and served(spark, results, "e") == {}
    results.commit(lines_of(spark, {"e": 5}), 2, at(3))
    assert served(spark, results, "e") == {(100, 0): 5.0, (100, 1): 5.0}


def test_missing_takes_one_job_for_each_key_and_repeats_on_replay(spark, results):
    jobs = jobs_of(spark, "a", "z", "z", "d")
    assert [(r.result_key, r.raster_id) for r in results.missing(jobs, 2).collect()] == [("z", 101)]
    assert {r.result_key for r in results.missing(jobs, 1).collect()} == {"z", "d"}


def test_a_key_made_twice_is_served_once(spark, results):
    results.commit(lines_of(spark, {"a": 8}), 3, at(4))
    assert served(spark, results, "a") == {(100, 0): 1.0, (100, 1): 1.0} and results.stats().first()[0] == 4


def test_eviction_keeps_what_was_used_last_and_is_done_once(spark, results):
    results.touch(jobs_of(spark, "b", "zz"), 2, at(9))
    results.touch(jobs_of(spark, "b"), 2, at(9))
    assert {r.result_key: r.last_used.hour for r in results.recency().collect()} == {"a": 1, "b": 9, "c": 1, "d": 2}
    results.evict(2, 7)
    assert keys(results) == {"b", "d"}
    results.evict(0, 7)
    assert keys(results) == {"b", "d"}
    results.commit(lines_of(spark, {"a": 6}), 8, at(10))
    assert served(spark, results, "a", "c") == {(100, 0): 6.0, (100, 1): 6.0}


def test_compaction_moves_what_is_left(spark, results, tmp_path):
    results.touch(jobs_of(spark, "b"), 2, at(9))
    results.evict(2, 7)
    assert results.compact(9) == [0] and sorted(p.name for p in (tmp_path / "r" / "lines").iterdir()) == ["batch=1", "batch=9"]
    assert served(spark, results, "b", "d", "a") == {(100, 0): 2.0, (100, 1): 2.0, (101, 0): 4.0, (101, 1): 4.0}
    assert {r.result_key: r.last_used.hour for r in results.recency().collect()} == {"b": 9, "d": 2} and results.compact(10) == []


def test_a_folder_is_worked_through_once_by_content(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    made = lambda ids: spark.createDataFrame([(i, 4, 5, 0, y, [float(7 * i + y * x) for x in range(5)]) for i in ids for y in range(4)], LINE.partition(", ")[2])
    put = lambda ids, ending: images.write_lines(made(ids), str(folder), F.concat(F.col("raster_id").cast("string"), F.lit(ending))).collect()
    results = Results(spark, f"{tmp_path}/r")

    def job(lines):
        seen.append(sorted(r[0].rpartition("/")[2] for r in lines.select("raster_id").distinct().collect()))
        return scanlines.crossfade(lines)

    run = lambda state: requests.process_folder(spark, str(folder), f"{tmp_path}/{state}", results, job, "offset_crossfade", {"blend_strength": 0.5})
    put([1, 2], ".png")
    run("c")
    put([1, 3], "-again.png")
    run("c")
    run("c")
    assert seen == [["1.png", "2.png"], ["3-again.png"]] and results.stats().first()[0] == 3
    jobs = requests.image_jobs(images.lines(spark, str(folder)), "offset_crossfade", {"blend_strength": 0.5})
    out = {(r.raster_id.rpartition("/")[2], r.y): r.data for r in results.serve(jobs).collect()}
    assert len(out) == 16 and all(out["1.png", y] == out["1-again.png", y] for y in range(4))
    # a stream that starts anew has the same batch numbers; where its first batch holds more, that is told
    put([4], ".png")
    with pytest.raises(Exception, match="other results"):
        run("other")
