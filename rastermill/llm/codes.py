"""Vector codes by Ball k-means: every vector is cut into parts, and each part position has its own small codebook.

An entry's ball holds the parts assigned to it; its radius is the farthest of them. Entries farther from it than twice the
radius cannot win any part of the ball, so only the others are its neighbours. Parts within half the distance to the
nearest neighbour are the ball's stable core: they stay, unmeasured. The rest lie in rings between the halves of successive
neighbours' distances, and a part in ring n is compared with the first n neighbours alone. All numbers are integers, and
bounds keep what is as near, so that codes, ties included, are those of comparing every part with every entry.

Assignments stand beside the vectors in a table of the shared folder, written anew each round with the sums that the next
entries follow from, so that a round is one pass without a shuffle of vectors.
"""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import saved, shared_folder

#: Components are whole multiples of 1 / SCALE; parts of a vector; entries of a codebook; rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


def squares(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    diff = x - entry
    return (diff * diff).sum(-1)


def settle(x: np.ndarray, code: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row of x, ties to the lower number, and its squared distance; code: where each row is now."""
    between = squares(entries[:, None], entries[None])
    out, best = code.copy(), squares(x, entries[code])
    order = np.argsort(code, kind="stable")
    edges = np.searchsorted(code[order], np.arange(len(entries) + 1))
    for i in range(len(entries)):
        ball = order[edges[i] : edges[i + 1]]
        if not len(ball):
            continue
        far = best[ball]
        near = np.flatnonzero((between[i] <= 4 * far.max()) & (np.arange(len(entries)) != i))  # the ball's neighbours
        near = near[np.argsort(between[i][near], kind="stable")]
        ring = np.searchsorted(between[i][near], 4 * far, "right")  # 0: the stable core
        for n, j in enumerate(near):
            rows = ball[ring > n]
            d = squares(x[rows], entries[j])
            won = (d < best[rows]) | ((d == best[rows]) & (j < out[rows]))
            out[rows[won]], best[rows[won]] = j, d[won]
    return out, best


def whole(vectors: np.ndarray) -> np.ndarray:
    """Components of vectors, a row each, as integers."""
    out = np.floor(vectors.astype(np.float64) * SCALE)
    most = math.isqrt((1 << 60) // max(1, vectors.shape[1]))
    if out.size and np.abs(out).max() > most:
        raise ValueError(f"components beyond {most // SCALE} have no exact squared distances in 64 bits")
    return out.astype(np.int64)


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (id, label, vector) without those whose vector is null or empty or holds a null or non-finite component."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("vector"))
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", odd))


def start(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """A codebook for each part, (entries, width): the parts of the smallest ids (null ids last, equal ones by their vectors)."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    whole_ = whole(np.array([r.vector for r in first]))
    return list(np.stack(np.split(whole_, parts, axis=1)))


def _pass(books: list[np.ndarray]):
    """Batches (kind, id, label, vector, code, error, part, entry, count, sums): rows with their new codes, then the task's sums."""
    parts, k = len(books), len(books[0])

    def run(batches):
        sums, counts = [np.zeros(b.shape, object) for b in books], np.zeros((parts, k), np.int64)
        template = None
        for batch in batches:
            template = batch
            n = batch.num_rows
            if not n:
                continue
            x = np.split(whole(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)), parts, axis=1)
            was = batch.column("code")
            code = np.zeros((n, parts), np.int64) if was.null_count == n else np.frombuffer(b"".join(was.to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
            error = np.zeros(n, np.int64)
            for p in range(parts):
                code[:, p], best = settle(x[p], code[:, p], books[p])
                error += best
                counts[p] += np.bincount(code[:, p], minlength=k)
                block = np.zeros(books[p].shape, np.int64)
                np.add.at(block, code[:, p], x[p])
                sums[p] = sums[p] + block.astype(object)
            packed = pa.array([r.tobytes() for r in code.astype(np.uint8)], pa.binary())
            yield _rows(batch, 0, n, packed, pa.array(error), None)
        if template is not None:
            flat = [(p, e, int(counts[p, e]), [int(s) for s in sums[p][e]]) for p in range(parts) for e in range(k) if counts[p, e]]
            yield _rows(template, 1, len(flat), pa.nulls(len(flat), pa.binary()), pa.nulls(len(flat), pa.int64()), flat)

    return run


_SUMS = [("part", pa.int32()), ("entry", pa.int32()), ("count", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))]


def _rows(batch: pa.RecordBatch, kind: int, n: int, code: pa.Array, error: pa.Array, flat: list | None) -> pa.RecordBatch:
    own = [batch.column(c) if flat is None else pa.nulls(n, batch.column(c).type) for c in ("id", "label", "vector")]
    if flat is None:
        extra = [pa.nulls(n, t) for _, t in _SUMS]
    else:
        extra = [pa.array([f[i] if i < 3 else [Decimal(s) for s in f[3]] for f in flat], t) for i, (_, t) in enumerate(_SUMS)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *own, code, error, *extra], ["kind", "id", "label", "vector", "code", "error", *[c for c, _ in _SUMS]])


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of this module's own folder through Spark's file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def assign(state: DataFrame, books: list[np.ndarray], path: str) -> tuple[DataFrame, DataFrame]:
    """Writes one pass over state (id, label, vector, code) to path; returns the new state and the rows of sums."""
    kinds = dict(state.dtypes)
    schema = f"kind int, id {kinds['id']}, label {kinds['label']}, vector array<double>, code binary, error long, part int, entry int, count long, sums array<decimal(38,0)>"
    state.select("id", "label", "vector", "code").mapInArrow(_pass(books), schema).write.partitionBy("kind").parquet(path)
    made = state.sparkSession.read.parquet(path)
    return made.where("kind = 0").select("id", "label", "vector", "code", "error"), made.where("kind = 1").select("part", "entry", "count", "sums")


def next_books(books: list[np.ndarray], sums: DataFrame) -> list[np.ndarray]:
    """Entries as floor(sum / count) of their parts; unused ones stay. Reads as many rows as there are entries."""
    width = books[0].shape[1]
    totals = sums.groupBy("part", "entry").agg(F.sum("count").alias("count"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
    out = [b.copy() for b in books]
    for row in totals.collect():
        out[row.part][row.entry] = [int(row[f"s{i}"]) // row["count"] for i in range(width)]
    return out


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (id, label, vector, code, error) of ``kept``'s, assigned to the codebooks of the last round, and these.

    A round before the last table is deleted once the next one stands; rounds end early where entries no longer move.
    """
    spark = rows.sparkSession
    books, folder = start(rows, parts, entries), f"{shared_folder(spark)}/codes-{uuid4().hex}"
    state, at = rows.withColumn("code", F.lit(None).cast("binary")), 0
    while True:
        state, sums = assign(state, books, f"{folder}/{at}")
        if at:
            remove(spark, f"{folder}/{at - 1}")
        new = next_books(books, sums) if at < rounds else books
        if at == rounds or all((a == b).all() for a, b in zip(books, new)):
            return state, books
        books, at = new, at + 1


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for e in b for v in e.tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (vec_id, code, error, label_error, codebooks_sha256), one for each vector that is kept.

    Vectors that are null or empty or hold null or non-finite components are dropped, as are those whose length is not
    the most usual of the table's (the smaller of equally usual ones) or no multiple of ``parts``. Components must be so
    small that distances are exact in 64 bits (within 32768 of zero for 64 of them), else ValueError. Null ids are kept, and are the last to start a
    codebook; repeated rows and ids stay; fewer vectors than ``entries`` make smaller codebooks; null labels are one
    label; an empty table, or one without a fit vector, gives an empty one; other columns are ignored.
    """
    rows = kept(vectors, id_col, vector_col, label_col).where(F.size("vector") % parts == 0)
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    kinds = dict(rows.dtypes)
    if usual is None:
        return vectors.sparkSession.createDataFrame([], f"{id_col} {kinds['id']}, code string, error long, label_error long, codebooks_sha256 string")
    found, books = fit(rows.where(F.size("vector") == usual.n), parts, entries, rounds)
    found = found.select("id", "label", "code", "error")
    # written, so that the join is a plain one, of which Spark can split the side of a frequent label
    labels = saved(found.groupBy("label").agg(F.sum("error").alias("label_error")))
    out = found.join(labels.withColumnRenamed("label", "__label"), F.col("label").eqNullSafe(F.col("__label")))
    hexes = F.lower(F.hex("code"))
    return out.select(F.col("id").alias(id_col), hexes.alias("code"), "error", F.col("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB's form over the embeddings table: every part against every entry, a common table for each round."""
    text = f"""WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, i AS part, x[i * len(x) // {parts} + 1 : (i + 1) * len(x) // {parts}] AS x FROM v, (SELECT unnest(range({parts})) AS i)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < {entries})"""
    for r in range(rounds + 1):
        text += f""",
a{r} AS MATERIALIZED (SELECT vec_id, label, part, x, min({{'d': d, 'entry': entry}}) AS m FROM (
  SELECT vec_id, label, p.part, x, entry, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM p JOIN c{r} ON p.part = c{r}.part) GROUP BY ALL)"""
        if r < rounds:
            text += f""",
s{r} AS (SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (
  SELECT part, m.entry AS entry, i, sum(x[i])::DOUBLE AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i) GROUP BY ALL) GROUP BY part, entry),
c{r + 1} AS MATERIALIZED (SELECT c{r}.part, c{r}.entry, coalesce(s{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN s{r} ON c{r}.part = s{r}.part AND c{r}.entry = s{r}.entry)"""
    return f"""{text},
k AS (SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(hex(m.entry)), 2, '0'), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256 FROM k"""


ORACLE_SQL = _sql()
