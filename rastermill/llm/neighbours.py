"""Nearest neighbours: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

Euclidean distance is searched as maximum inner product, q.x - |x|^2 / 2, with the squared length kept exactly. Vectors
are cut into pairs of dimensions with 16 codewords each. Codewords and codes minimise the score-aware loss: the part of the
residual along the vector, which moves high scores most, weighs ``eta`` times the part across it. A scan adds up table
entries for two four-bit codes at once. The best of each block of rows are measured exactly, and then all others whose
code, given how far it is off, doesn't rule out that they are nearer; so what is found in the rows scanned is exact.

Rows are dealt by their nearest coarse centre, and a query is sent to the blocks of the centres nearest to it, as many as
held the neighbours of sampled queries. Few rows have few centres, all of which are asked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import saved, shuffles

PAIR = 2  # dimensions of a four-bit code


@dataclass
class Codebook:
    """codewords: (parts, 16, PAIR), parts even (zeros pad the dimensions); eta: weight of the parallel residual."""

    codewords: np.ndarray
    eta: float

    @property
    def parts(self) -> int:
        return len(self.codewords)

    def _cut(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x.astype(np.float32), ((0, 0), (0, self.parts * PAIR - x.shape[1]))).reshape(len(x), self.parts, PAIR)

    def codes(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """(rows, parts) codes by coordinate descent on the score-aware loss, from the nearest codewords."""
        cut = self._cut(x)
        unit = cut / np.maximum(np.linalg.norm(cut.reshape(len(x), -1), axis=1), 1e-12)[:, None, None]
        out = np.stack([((cut[:, m, None] - self.codewords[m]) ** 2).sum(-1).argmin(1) for m in range(self.parts)], 1)
        along = ((cut - self.codewords[np.arange(self.parts), out]) * unit).sum((1, 2))
        for _ in range(rounds):
            for m in range(self.parts):
                left = cut[:, m, None] - self.codewords[m]
                part = (left * unit[:, m, None]).sum(-1)
                rest = along - np.take_along_axis(part, out[:, m : m + 1], 1)[:, 0]
                out[:, m] = ((left**2).sum(-1) + (self.eta - 1) * (rest[:, None] + part) ** 2).argmin(1)
                along = rest + np.take_along_axis(part, out[:, m : m + 1], 1)[:, 0]
        return out.astype(np.uint8)

    @classmethod
    def fit(cls, x: np.ndarray, threshold: float = 0.2, rounds: int = 8) -> Codebook:
        """From a bounded sample. threshold: the cosine above which scores count, which sets eta."""
        dims = x.shape[1]
        eta = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
        parts = -(-dims // PAIR)
        parts += parts % 2
        book = cls(np.zeros((parts, 16, PAIR), np.float32), eta)
        cut = book._cut(x)
        for m in range(parts):
            order = np.lexsort(cut[:, m].T[::-1])
            book.codewords[m] = cut[order[np.linspace(0, len(x) - 1, 16).astype(int)], m]
        unit = cut / np.maximum(np.linalg.norm(cut.reshape(len(x), -1), axis=1), 1e-12)[:, None, None]
        for _ in range(rounds):
            codes = book.codes(x, 1)
            along = ((cut - book.codewords[np.arange(parts), codes]) * unit).sum((1, 2))
            for m in range(parts):
                u, own = unit[:, m], codes[:, m]
                rest = along - ((cut[:, m] - book.codewords[m, own]) * u).sum(1)
                right = cut[:, m] + (eta - 1) * u * (rest + (u * cut[:, m]).sum(1))[:, None]
                left = np.eye(PAIR) + (eta - 1) * u[:, :, None] * u[:, None, :]
                for c in np.unique(own):
                    of = own == c
                    book.codewords[m, c] = np.linalg.solve(left[of].sum(0), right[of].sum(0))
                along = rest + ((cut[:, m] - book.codewords[m, own]) * u).sum(1)
        return book

    def decoded(self, packed: np.ndarray) -> np.ndarray:
        """(rows, dimensions) that two codes in a byte stand for."""
        codes = np.stack([packed >> 4, packed & 15], 2).reshape(len(packed), self.parts)
        return self.codewords[np.arange(self.parts), codes].reshape(len(packed), -1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, parts / 2, 256): what two codes in a byte add to the inner product."""
        one = np.einsum("qmd,mcd->qmc", self._cut(queries), self.codewords)
        return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(queries), self.parts // 2, 256)


def _best(score: np.ndarray, count: int) -> np.ndarray:
    """Positions of the count largest scores of one row; of equal ones the first."""
    if len(score) <= count:
        return np.arange(len(score))
    least = score[np.argpartition(score, len(score) - count)[len(score) - count]]
    above = np.flatnonzero(score > least)
    return np.concatenate([above, np.flatnonzero(score == least)[: count - len(above)]])


class _Search:
    """Nearest k of each query over the blocks of one task."""

    def __init__(self, book: Codebook, ids: np.ndarray, queries: np.ndarray, k: int, short: int):
        self.book, self.ids, self.queries, self.k, self.short = book, ids, queries, k, short
        self.near = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)

    def scan(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, x, codes = ids[order], x[order], codes[order]
        exact = x.astype(np.float64)
        half = (exact**2).sum(1) / 2
        coded = self.book.decoded(codes).astype(np.float64)[:, : x.shape[1]]
        lost, length = np.sqrt(((exact - coded) ** 2).sum(1)), np.sqrt((coded**2).sum(1))
        for at in range(0, len(self.ids), 32):
            asked = self.queries[at : at + 32]
            tables = self.book.tables(asked)
            score = np.zeros((len(asked), len(x)), np.float32) - half.astype(np.float32)
            for j in range(codes.shape[1]):
                score += tables[:, j, codes[:, j]]
            for q in range(len(asked)):
                others = ids != self.ids[at + q]
                to = asked[q].astype(np.float64)
                first = _best(np.where(others, score[q], -np.inf), self.short)
                first = first[others[first]]
                self._measure(at + q, ids[first], exact[first], to)
                # the code of a row is off by ``lost``, so a row whose code lies further than that beyond the k-th found is no nearer
                worst, size = self._worst(at + q), np.sqrt((to**2).sum())
                rounding = (2 * self.book.parts + 16) * 2.0**-23 * (half + size * length)
                off = np.sqrt(np.maximum(0, size**2 + length**2 - 2 * (score[q].astype(np.float64) + half) - 2 * rounding))
                others[first] = False
                rest = np.flatnonzero(others & ~(off > (worst + lost) * (1 + 1e-9)))
                for i in range(0, len(rest), 4096):
                    part = rest[i : i + 4096]
                    square = size**2 + 2 * half[part] - 2 * (exact[part] @ to)
                    part = part[~(square > self._worst(at + q) ** 2 + len(to) * 2.0**-48 * (size**2 + 2 * half[part]))]
                    self._measure(at + q, ids[part], exact[part], to)

    def _worst(self, q: int) -> float:
        """The distance that a row must not exceed to be among the nearest k."""
        far = self.near[q][1]
        return far[-1] if len(far) == self.k else np.inf

    def _measure(self, q: int, ids: np.ndarray, x: np.ndarray, to: np.ndarray) -> None:
        """Rows taken up among the nearest k, by distance and then by id."""
        both_id, both_far = np.r_[self.near[q][0], ids], np.r_[self.near[q][1], np.sqrt(((x - to) ** 2).sum(1))]
        first = np.lexsort((both_id, both_far))[: self.k]
        self.near[q] = both_id[first], both_far[first]


def coarse(x: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Centres by k-means, of a sample; the same rows give the same centres."""
    centres = x[np.linspace(0, len(x) - 1, count).astype(int)].copy()
    for _ in range(rounds if count > 1 else 1):
        own = nearest(x, centres, 1)[:, 0]
        sums, n = np.zeros((count, x.shape[1])), np.bincount(own, minlength=count)
        np.add.at(sums, own, x)
        centres[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(x.dtype)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, count: int, step: int = 4096) -> np.ndarray:
    """(rows, count) numbers of the nearest centres, in no order."""
    if count >= len(centres):
        return np.tile(np.arange(len(centres)), (len(x), 1))
    half = (centres.astype(np.float64) ** 2).sum(1) / 2
    parts = [np.argpartition(half - x[i : i + step] @ centres.T, count - 1, axis=1)[:, :count] for i in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros((0, count), np.int64)


def probes(x: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int = 256) -> int:
    """So many centres that they hold this share of the k nearest, within the sample, of its queries.

    Neighbours in the whole table are nearer than those in a sample, so that they lie in no more centres.
    """
    if len(centres) == 1:
        return 1
    own = nearest(x, centres, 1)[:, 0]
    need = []
    for q in x[np.linspace(0, len(x) - 1, min(asked, len(x))).astype(int)]:
        far = ((x - q) ** 2).sum(1)
        near = np.argsort(far, kind="stable")[1 : k + 1]
        rank = np.empty(len(centres), np.int64)
        rank[np.argsort(((centres - q) ** 2).sum(1), kind="stable")] = np.arange(len(centres))
        need.append(rank[own[near]] + 1)
    return int(np.quantile(np.concatenate(need), recall, method="higher"))


def search(vectors: DataFrame, every: int = 100, k: int = 10, short: int = 100, sample: int = 20_000, block: int = 16_384, queries: int = 4096, leaf: int = 8192, most: int = 4096, recall: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest of each row whose id is divisible by ``every``.

    score: Euclidean distance in double precision on the original vectors; ties go to the smaller id. Every row is
    indexed; codebook and centres are fitted on at most ``sample`` rows in expectation, chosen by a hash of the id. There
    is a centre for each ``leaf`` rows, at most ``most``; a query asks so many of them that in the sample they hold
    ``recall`` of the nearest (all, where there are few). Centres of more than ``block`` rows are cut into blocks, and of
    more than ``queries`` queries into rounds, so that no task holds more of one; of each block the ``short`` best by table
    are measured first, which gives a distance that rules out most others; the rest are measured too. A block passes on k
    rows for each query. Vectors that are null or zero, or that hold null or non-finite components, take no part; vectors
    of another number of dimensions are searched apart. Rows of one id are each other's own row, so never neighbours, and
    an id at one distance counts once. An empty table gives an empty one; other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    kind = "double" if dict(vectors.dtypes)[vector_col] == "array<double>" else "float"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.where(~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0))
    out = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for dims, count in sorted((r.dims, r["count"]) for r in rows.groupBy(F.size("v").alias("dims")).count().collect()):
        own = rows.where(F.size("v") == dims)
        chosen = own.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, sample / count) * (1 << 30))).orderBy("id").collect()
        chosen = chosen or own.limit(sample).collect()
        fitted = np.array([r.v for r in chosen], np.float32)
        book = Codebook.fit(fitted)
        centres = coarse(fitted, max(1, min(most, -(-count // leaf), len(fitted))))
        ask = probes(fitted, centres, k, recall)

        def encode(batches, book=book, dims=dims, centres=centres):
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                    codes = book.codes(x)
                    packed = (codes[:, 0::2] * 16 + codes[:, 1::2]).tobytes()
                    width = book.parts // 2
                    part = nearest(x.astype(np.float32), centres, 1)[:, 0].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([packed[i : i + width] for i in range(0, len(packed), width)], pa.binary()), pa.array(part)], ["id", "v", "codes", "part"])

        def near(batches, dims=dims, centres=centres, ask=ask):
            for batch in batches:
                if batch.num_rows:
                    parts = nearest(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float32), centres, ask)
                    at = pa.array(np.repeat(np.arange(batch.num_rows), parts.shape[1]))
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("v").take(at), pa.array(parts.ravel().astype(np.int32))], ["id", "v", "part"])

        index = saved(own.mapInArrow(encode, f"id long, v array<{kind}>, codes binary, part int"))
        asked = own.where(F.pmod("id", F.lit(every)) == 0).mapInArrow(near, f"id long, v array<{kind}>, part int")
        # one row for each centre: into how many blocks its rows go, and into how many rounds its queries
        sizes = index.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("cuts"))
        rounds = asked.groupBy("part").agg(F.ceil(F.count("*") / queries).cast("int").alias("rounds"))
        shape = F.broadcast(saved(sizes.join(rounds, "part")))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = index.join(shape, "part").withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")).withColumn("round", each("rounds"))
        sent = asked.join(shape, "part").withColumn("round", F.pmod(F.xxhash64("id"), F.col("rounds")).cast("int")).withColumn("cut", each("cuts"))
        place = ["part", "cut", "round"]
        both = sent.select("id", "v", F.lit(None).cast("binary").alias("codes"), *place).unionByName(dealt.select("id", "v", "codes", *place))
        both = both.repartition(shuffles(spark), *place).sortWithinPartitions(*place)

        def scan(batches, book=book, dims=dims):
            for group in _groups(batches, place):
                codes = group.column("codes")
                vectors_ = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                ids, told = group.column("id").to_numpy(), codes.is_valid().to_numpy()
                asked_, held = np.flatnonzero(~told), np.flatnonzero(told)
                if not len(asked_) or not len(held):
                    continue
                found = _Search(book, ids[asked_], vectors_[asked_], k, short)
                found.scan(ids[held], vectors_[held], np.frombuffer(b"".join(codes.take(pa.array(held)).to_pylist()), np.uint8).reshape(len(held), -1))
                for q, (near_, far) in zip(ids[asked_].tolist(), found.near):
                    if len(near_):
                        yield pa.RecordBatch.from_pydict({"query_id": np.full(len(near_), q), "vec_id": near_, "score": far})

        out = out.unionByName(both.mapInArrow(scan, "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _groups(batches, keys: list[str]):
    """Tables of consecutive rows of one key, from batches in the order of keys."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in keys], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:]):
            if last is not None and tuple(key[a]) != last:
                yield pa.Table.from_batches(rest)
                rest = []
            last = tuple(key[a])
            rest.append(batch.slice(a, b - a))
    if rest:
        yield pa.Table.from_batches(rest)
