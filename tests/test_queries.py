"""Every registered query against its SQL at the smallest scale."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from rastermill import catalog, fixtures

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in columns:
        if a[c].dtype.kind in "fi" and b[c].dtype.kind in "fi":
            assert np.array_equal(a[c].to_numpy(float), b[c].to_numpy(float), equal_nan=True), c
        else:
            assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, sf, duck, name):
    same(catalog.queries()[name](spark, sf).toPandas(), duck.execute(catalog.oracle_sql()[name]).df())


def test_halves_fall_as_in_the_sql(spark, tmp_path):
    """Blocks whose mean is a half, where the SQL gives one value in every order of its sum (sums of two pairs gave the other)."""
    blocks = {1: [(2, 9, 5, 9)], 2: [(2, 2, 9, 10), (2, 4, 3, 8), (2, 4, 5, 6), (3, 9, 2, 5)]}
    rows = [(raster, 15, 15, 255) for raster in blocks]
    for raster, found in blocks.items():
        for i, (a, b, c, d) in enumerate(turned for a, b, c, d in found for turned in ((a, b, c, d), (b, a, c, d), (a, b, d, c), (b, a, d, c))):
            rows += [(raster, i // 8 * 2 + j // 2, i % 8 * 2 + j % 2, v) for j, v in enumerate((a, b, c, d))]
    duck = duckdb.connect(config={"threads": 1})  # several threads would add sums of parts
    duck.execute(f"""CREATE TABLE lineitem AS SELECT r::BIGINT AS l_suppkey, y::BIGINT AS l_partkey, v::DOUBLE AS l_quantity, 1::DOUBLE AS l_extendedprice,
      TIMESTAMP '2020-01-01' + to_days(((x + 15) % 16)::INTEGER) AS l_shipdate FROM (VALUES {', '.join(map(str, rows))}) t(r, y, x, v)""")
    duck.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    assert duck.execute("WITH " + fixtures.SQL["cells"].strip() + " SELECT raster_id, y, x, v::INTEGER FROM cells WHERE band = 0 AND v > 0 ORDER BY ALL").fetchall() == sorted(rows)
    same(catalog.queries()["mip_color"](spark, str(tmp_path)).toPandas(), duck.execute(catalog.oracle_sql()["mip_color"]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - {"export_package_job"}))
def test_rows(spark, sf, name):
    rows = catalog.queries()[name](spark, sf).toPandas()
    assert len(rows) and np.isfinite(rows["v"]).all()


def test_entry_without_corpus_parts(monkeypatch):
    """The rest loads where the subpackage, or a package that it needs, is absent."""

    def absent(name):
        raise ImportError(name)

    monkeypatch.setattr(entry, "import_module", absent)
    assert entry.queries().keys() == catalog.queries().keys() and entry.oracle_sql() == catalog.oracle_sql()


def test_entry(spark):
    found = entry.entry(spark).toPandas()
    assert (found.error_after == 0).all() and (found.error_before > 0).all()
