"""Each stage of the pipeline on documents with planted cases."""

import random

import pytest

import corpus_pipeline as pipeline

EN = "the quick brown fox jumps over a lazy dog and then the old man walks slowly to his house near river while children play with wooden toys in garden under trees".split()
DE = "der schnelle braune fuchs springt über den faulen hund und dann geht alte mann langsam zu seinem haus am fluss während kinder mit holz spielzeug im garten spielen".split()


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    draw = random.Random(1)
    text = lambda words, n: " ".join(draw.choice(words) + draw.choice(["", "", "s", "er", "en"]) for _ in range(n))
    rows = [(i, text(EN if i % 2 else DE, 120), "en" if i % 2 else "de", f"s{i % 3}") for i in range(200)]
    rows += [(300 + i, rows[i][1], rows[i][2], "s1") for i in range(5)]
    for i in range(5, 10):
        w = rows[i][1].split()
        w[60] = "edited"
        rows.append((300 + i, " ".join(w), rows[i][2], "s1"))
    item = text(EN, 30)
    rows += [(400, text(EN, 50) + " " + item + " " + text(EN, 50), "en", "s2"), (401, None, "en", "s0"), (402, "12 34 %%", "en", "s0")]
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    all_ids, kept = ids(docs), {}
    for name, stage in pipeline.STAGES[:4]:
        columns = docs.columns
        docs = stage(spark, docs, planted)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = ids(docs)
    assert all_ids - kept["language"] == {401, 402}
    assert kept["language"] - kept["near_duplicates"] == set(range(300, 310))
    assert kept["near_duplicates"] - kept["decontaminated"] == {400}
    assert kept["mixed"] <= kept["decontaminated"] and docs.count() > len(kept["mixed"]) / 2
    out = pipeline.sharded(spark, docs, planted).collect()
    assert len(out) == docs.count() and {r.shard for r in out} <= set(range(16))


def test_near_duplicates_without_ids_or_with_shared_ones(spark):
    draw = random.Random(2)
    text = lambda: " ".join(draw.choice(EN) + draw.choice(["", "s", "er"]) for _ in range(120))
    a, b, c, d, e, f = (text() for _ in range(6))
    near = e.replace(e.split()[60], "edited", 1)
    rows = [(None, a), (None, a), (None, b), (1, c), (1, d), (2, e), (None, near), (3, e), (3, f), (None, f)]
    docs = spark.createDataFrame([(*r, "en", "s1", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 5):
        out = pipeline.near_duplicates(spark, docs.repartition(parts), "").collect()
        assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted([(None, a), (None, b), (1, c), (1, d), (2, e), (3, f)], key=str)


def test_run(spark, planted, sf):
    out = pipeline.run(spark, planted)
    assert out.count() > 0 and {"doc_id", "shard", "slot"} <= set(out.columns)
    assert pipeline.run(spark, sf).count() > 0


def test_empty_and_extra_columns(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet").where("false").selectExpr("*", "1 AS score", "2 AS component_id", "3 AS size")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, planted).count() == 0
    some = spark.read.parquet(f"{planted}/documents.parquet").selectExpr("*", "1 AS score", "2 AS component_id", "3 AS size", "4 AS target")
    for _, stage in pipeline.STAGES[:4]:
        out = stage(spark, some, planted)
        assert out.columns == some.columns and out.count() > 0
