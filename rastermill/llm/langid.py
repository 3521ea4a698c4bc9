"""Language identification by the nearest of several TF-IDF centroids per language.

Texts become L2-normalised TF-IDF vectors of letter n-grams (1 to 3 code points, lower-cased, runs of other characters
as one space), hashed to ``BUCKETS`` dimensions. Document frequencies come from all training rows; centroids from a
bounded sample of them, clustered per language. A text takes the language of the centroid with the largest cosine and is
rejected where that cosine is too far below what training texts of the language and of its length have.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import packed, pieces

BUCKETS = 4096
#: Classes of length: powers of two of the number of n-grams, longer ones in the last.
CLASSES = 24
#: Rows of text in a dense matrix of counts at once.
ROWS = 256
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter, and its lower-case form where that is one code point."""
    if not _tables:
        chars = [chr(i) for i in range(0x20000)]
        lower = [c.lower() if len(c.lower()) == 1 else c for c in chars]
        _tables.append((np.array([c.isalpha() for c in chars]), np.array([ord(c) for c in lower], np.uint32)))
    return _tables[0]


def count_grams(column) -> tuple[np.ndarray, np.ndarray]:
    """Counts (rows x BUCKETS) of the hashed n-grams of whole texts, and whether each text has a letter."""
    data, off = packed(column)
    rows = len(off) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")
    bounds = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=bounds[1:])
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(bounds[off]))
    is_letter, lower = _letters()
    # code points past the table are CJK extensions and the like: letters without case
    letter = np.where(points < len(lower), is_letter[np.minimum(points, len(lower) - 1)], points < 0xE0000)
    points = np.where(letter, np.where(points < len(lower), lower[np.minimum(points, len(lower) - 1)], points), 32).astype(np.uint32)
    has = np.bincount(row[letter], minlength=rows)[:rows] > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points, row = points[keep], row[keep]
    cells = np.zeros(rows * BUCKETS, np.int64)
    code = np.zeros(len(points), np.uint32)
    for n in range(1, 4):
        if len(points) < n:
            break
        code = (code[: len(points) - n + 1] ^ points[n - 1 :]) * np.uint32(0x9E3779B1)
        code ^= code >> np.uint32(15)
        whole = row[: len(code)] == row[n - 1 :]
        cells += np.bincount(row[: len(code)][whole] * BUCKETS + (code[whole] * np.uint32(0x85EBCA6B) >> np.uint32(20)), minlength=len(cells))
    return cells.reshape(rows, BUCKETS), has


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, dtype=np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """Learned languages: one row of ``centroids`` for each (language, cluster); ``limit``: smallest accepted cosine of
    each row, for each class of length."""

    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    limit: np.ndarray


def _lengths(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts.sum(1), 1)).astype(np.int64), CLASSES - 1)


def limits(langs: list[str], rows: np.ndarray, low: np.ndarray, slack: float, enough: int = 20, shorter: tuple[float, float] = (0.9, 0.6), least: float = 0.08) -> np.ndarray:
    """(languages, CLASSES) smallest accepted cosines, from the numbers of training rows and their low cosines.

    ``slack`` times the low cosine of the language's rows of that length, or of all languages' where it has fewer than
    ``enough``; never stricter than for a longer class. A class of which all together have fewer takes ``shorter`` of the
    next longer one's (the second number below 64 n-grams), down to ``least``, as shorter texts lie further off and tell
    less; the longest take the most lenient. Without any class of enough rows nothing is rejected by its cosine.
    """
    _, one = np.unique(langs, return_index=True)
    told = rows[one].sum(0) >= enough
    pooled = np.array([low[rows[:, c] > 0, c].min() if told[c] else np.nan for c in range(CLASSES)])
    out = np.zeros((len(langs), CLASSES), np.float32)
    if not told.any():
        return out
    last = np.flatnonzero(told)[-1]
    for i in range(len(langs)):
        now = np.inf
        for c in range(last, -1, -1):
            now = min(now, slack * (low[i, c] if rows[i, c] >= enough else pooled[c])) if told[c] else max(least, shorter[c < 6] * now)
            out[i, c] = now
        out[i, last + 1 :] = out[i, told.nonzero()[0]].min()
    return out


def _cluster(x: np.ndarray, clusters: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds; the same rows in any order give the same result."""
    x = x[np.lexsort(x[:, :8].T)]
    seeds = [x.mean(0)]
    near = x @ seeds[0]
    while len(seeds) <= clusters:
        seeds.append(x[int(near.argmin())])
        near = np.maximum(near, x @ seeds[-1])
    centre = np.array(seeds[1:])
    for _ in range(rounds):
        own = (x @ centre.T).argmax(1)
        for k in range(len(centre)):
            if (own == k).any():
                centre[k] = x[own == k].mean(0)
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return centre, (x @ centre.T).argmax(1)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", clusters: int = 4, sample: int = 600, max_langs: int = 300, slack: float = 0.8) -> Model:
    """Learn from the rows of docs that have text and language.

    Document frequencies cover every row. ``sample`` bounds the rows of a language that the centroids are fitted on (in
    expectation; chosen by a hash of the id, so reruns agree). More than ``max_langs`` languages raise ValueError. The
    smallest accepted cosine is ``slack`` times the first percentile of what the sample's rows have (see ``limits``). No
    rows give a model of no language.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")

    def frequencies(batches):
        total, seen = np.zeros(BUCKETS, np.int64), 0
        for batch in pieces(batches, "text", 1 << 20, ROWS):
            cells, has = count_grams(batch.column("text"))
            total += (cells > 0).sum(0)
            seen += int(has.sum())
        yield pa.RecordBatch.from_pydict({"bucket": np.arange(-1, BUCKETS), "n": np.r_[seen, total]})

    sums = {r.bucket: r.n for r in rows.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    idf = np.array([np.log((1 + sums.get(-1, 0)) / (1 + sums.get(b, 0))) + 1 for b in range(BUCKETS)], np.float32)
    if not counts:
        return Model(idf, [], np.zeros((0, BUCKETS), np.float32), np.zeros((0, CLASSES), np.float32))

    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, sample / n) * (1 << 30))])
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[F.col("lang")])

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        parts = [count_grams(batch.column("text")) for batch in pieces([pa.RecordBatch.from_pandas(group[["text"]])], "text", 1 << 20, ROWS)]
        x = np.concatenate([_vectors(c, idf)[has] for c, has in parts])
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "rows": [], "low": []})
        length = np.concatenate([_lengths(c)[has] for c, has in parts])
        centre, own = _cluster(x, max(1, min(clusters, len(x) // 8)))
        best = (x @ centre.T).max(1)
        rows_ = np.bincount(length, minlength=CLASSES)
        low = np.array([np.quantile(best[length == c], 0.01) if rows_[c] else np.nan for c in range(CLASSES)])
        used = [k for k in range(len(centre)) if (own == k).any()]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [centre[k].astype(np.float32) for k in used], "rows": [rows_] * len(used), "low": [low] * len(used)})

    found = chosen.groupBy("lang").applyInPandas(centroids, "lang string, centroid array<float>, rows array<long>, low array<double>").collect()
    found = sorted(found, key=lambda r: (r.lang, r.centroid[:16]))
    if not found:
        return Model(idf, [], np.zeros((0, BUCKETS), np.float32), np.zeros((0, CLASSES), np.float32))
    langs = [r.lang for r in found]
    limit = limits(langs, np.array([r.rows for r in found]), np.array([r.low for r in found], float), slack)
    return Model(idf, langs, np.array([r.centroid for r in found], np.float32), limit)


def predict(docs: DataFrame, model: Model, text_col: str = "text", added: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with three more columns, named in ``added``: language, cosine (0 to 1), and whether the text is rejected.

    A null text, or one without a letter, is ``und`` with score 0 and rejected, and so is every text under a model of no
    language. Texts are read whole. Repeated rows are predicted alike; ties go to the language that sorts first.
    """
    langs = np.array([*model.langs, "und"], object)

    def run(batches):
        for batch in pieces(batches, text_col, 1 << 20, ROWS):
            cells, has = count_grams(batch.column(text_col))
            if len(model.langs):
                cosine = _vectors(cells, model.idf) @ model.centroids.T
                best = cosine.argmax(1)
                score = np.clip(cosine[np.arange(len(best)), best].astype(float), 0, 1)
                rejected = ~has | (score < model.limit[best, _lengths(cells)])
            else:
                best, score, rejected = np.zeros(len(has), int), np.zeros(len(has)), np.ones(len(has), bool)
            best = np.where(has, best, len(model.langs))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs[best], pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(rejected)], [*batch.schema.names, *added])

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, {added[0]} string, {added[1]} double, {added[2]} boolean")


def held_out(id_col: str = "doc_id", folds: int = 5):
    """True where crc32(id as text) mod folds is 0, and for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(True))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, rejected), one for each row of docs, learned from the rows not held out.

    Language, source and id are no inputs of a prediction. Rejected rows keep the nearest language as ``lang_pred``.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"), held_out(id_col).alias("held_out"))
    model = fit(docs.where("not held_out"), "doc_id", "text", "lang", **options)
    return predict(docs.select("doc_id", "held_out", "text"), model).select(F.col("doc_id").alias(id_col), "held_out", "lang_pred", "score", "rejected")
