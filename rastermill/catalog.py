"""The registered queries of the raster operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import fixtures
from .layout import rounded

FLAGSHIP = "offset_crossfade_job"
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}

#: End of the SQL of queries that return cells, from a common table ``result``.
CELLS = "SELECT raster_id, h::INTEGER AS h, w::INTEGER AS w, band::INTEGER AS band, y::INTEGER AS y, x::INTEGER AS x, floor(v * 10000::DOUBLE + 0.500001::DOUBLE) / 10000::DOUBLE AS v FROM result"


def query(sql: str | None = None, source: str = "cells", cells: bool = True):
    """Registers a query under its function's name.

    sql: common tables that end in ``result`` (cells), or in a whole SELECT; what the source's own tables offer stands before.
    """

    def register(f: Callable) -> Callable:
        def run(spark, sf_dir):
            out = f(spark, sf_dir)
            if not cells:
                return out
            ints = {c: out[c].cast("int") for c in ("h", "w", "band", "y", "x")}
            return out.withColumns(ints | {"v": rounded("v")}).select("raster_id", *ints, "v")

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        _QUERIES[f.__name__] = run
        if sql is not None:
            parts = [p.strip() for p in (fixtures.SQL.get(source, ""), sql) if p.strip()]
            if cells:
                text = "WITH RECURSIVE " + ",\n".join(parts) + "\n" + CELLS
            else:
                text = ("WITH RECURSIVE " + ",\n".join(parts)) if source in fixtures.SQL else sql.strip()
            _SQL[f.__name__] = text
        return f

    return register


def _load() -> None:
    from . import checks

    checks.load()


def queries() -> dict[str, Callable[..., DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
