"""Benchmark decontamination: item-sized windows of documents against items by CGK embedding and bit-sampling LSH.

A CGK random walk reads a word sequence and repeats or advances at each step by a random bit of (step, word), which turns
a small edit distance into a small Hamming distance. Sampled positions of several walks are the LSH keys: items stand in a
table of their keys, and a window is looked up there by its own; items that it shares a key with are verified by exact word
edit distance. Windows that can hold no item are not embedded: an item of n words within e edits keeps one of e + 1 pieces
whole, so that a run of n // (e + 1) words of it stands in the window, and windows are laid where some item's run does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import LOWER, NOT_ALNUM, gram_hashes, gram_rows, mix, packed, pieces, word_hashes, words

#: Bytes of item text held by a task at once; a larger benchmark is searched in several shards of at most about this.
SHARD_BYTES = 4 << 20


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (ASCII punctuation separates), and the number of words before each row."""
    data, off = packed(column)
    data = LOWER[data]
    starts, ends, first = words(data, off, NOT_ALNUM)
    return word_hashes(data, starts, ends), first


def allowed(n, similarity: float):
    """Most edits of an item of n words at this similarity."""
    return np.floor((1 - similarity) * n + 1e-9).astype(np.int64)


def walk(sequence: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """CGK embeddings (rows x steps) of word sequences that are padded with 0 to one length."""
    rows, at = np.arange(len(sequence)), np.zeros(len(sequence), np.int64)
    out = np.zeros((len(sequence), steps), np.uint64)
    for j in range(steps):
        out[:, j] = sequence[rows, np.minimum(at, sequence.shape[1] - 1)]
        at += (mix(out[:, j] ^ mix(np.array([seed * 1_000_003 + j], np.uint64))) & np.uint64(1)).astype(np.int64)
    return out


def edit_distance(item: np.ndarray, n: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Fewest word edits that turn each row of ``item`` (its first n words) into some run of the same row of ``text``."""
    across = np.arange(text.shape[1] + 1)
    cost, best = np.zeros((len(item), text.shape[1] + 1), np.int64), np.zeros(len(item), np.int64)
    for i in range(item.shape[1]):
        new = cost + 1
        new[:, 1:] = np.minimum(new[:, 1:], cost[:, :-1] + (text != item[:, i : i + 1]))
        cost = np.minimum.accumulate(new - across, axis=1) + across
        best = np.where(n == i + 1, cost.min(1), best)
    return best


@dataclass
class Lengths:
    """Items of one class of lengths (powers of two), so that a long item pads no short one."""

    item: np.ndarray
    words: np.ndarray
    n: np.ndarray
    keys: np.ndarray | None = None
    owner: np.ndarray | None = None


@dataclass
class Items:
    """A shard of benchmark items, prepared for the search."""

    ids: list
    n: np.ndarray
    lengths: dict[int, Lengths]
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    similarity: float
    walks: int
    samples: int
    bits: int

    @classmethod
    def of(cls, ids: list, texts: list, similarity: float, least: int, walks: int, samples: int, bits: int) -> Items:
        hashes, first = _tokens(pa.array(texts, pa.string()))
        kept = np.flatnonzero(np.diff(first) >= max(1, least))
        n, begin = np.diff(first)[kept], first[:-1][kept]
        run = np.clip(n // (allowed(n, similarity) + 1), 1, 4)
        grams = {}
        for k in np.unique(run).tolist():
            of = np.flatnonzero(run == k)
            row, at = gram_rows(np.r_[0, np.cumsum(n[of])], k)
            at -= np.r_[0, np.cumsum(n[of])][row]
            found = gram_hashes(hashes, k)[begin[of][row] + at]
            order = np.argsort(found, kind="stable")
            grams[k] = found[order], of[row[order]], at[order]
        kind, lengths = np.array([int(x).bit_length() for x in n], np.int64), {}
        for c in np.unique(kind).tolist():
            of = np.flatnonzero(kind == c)
            table = np.zeros((len(of), int(n[of].max())), np.uint64)
            for row, i in enumerate(of):
                table[row, : n[i]] = hashes[begin[i] : begin[i] + n[i]]
            lengths[c] = Lengths(of, table, n[of])
        return cls([ids[i] for i in kept], n, lengths, grams, similarity, walks, samples, bits)

    def _keys(self, sequence: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(rows, walks * samples) LSH keys of word sequences: for each, the words at sampled places of a walk."""
        places = np.random.default_rng(5).random(self.samples * self.bits)
        sampled = (places * (2 * n)[:, None]).astype(np.int64)
        out = []
        for seed in range(self.walks):
            seen = np.take_along_axis(walk(sequence, 2 * sequence.shape[1], seed), sampled, 1).reshape(len(n), self.samples, self.bits)
            key = mix(np.arange(self.samples, dtype=np.uint64) + np.uint64(seed << 20) + (n.astype(np.uint64) << np.uint64(32))[:, None])
            for bit in range(self.bits):
                key = mix(key ^ seen[:, :, bit])
            out.append(key)
        return np.concatenate(out, 1)

    def _table(self, own: Lengths) -> Lengths:
        """With its keys, made once in a task."""
        if own.keys is None:
            keys = self._keys(own.words, own.n)
            order = np.argsort(keys, axis=None, kind="stable")
            own.keys, own.owner = keys.reshape(-1)[order], order // keys.shape[1]
        return own

    def _windows(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows (document row, start, words) of the item-sized windows laid where an item's run of words stands."""
        out = [np.zeros((0, 3), np.int64)]
        for k, (gram, item, at) in self.grams.items():
            row, start = gram_rows(first, k)
            own = gram_hashes(hashes, k)[start] if len(start) else np.zeros(0, np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[(gram >> np.uint64(44)).astype(np.int64)] = True
            maybe = np.flatnonzero(seen[(own >> np.uint64(44)).astype(np.int64)])
            low = np.searchsorted(gram, own[maybe])
            count = np.searchsorted(gram, own[maybe], "right") - low
            which = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            hit = np.repeat(maybe, count)
            out.append(np.stack([row[hit], start[hit] - at[which], self.n[item[which]]], 1))
        return np.unique(np.concatenate(out), axis=0)

    def search(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows (document row, item row, edits, start word in its document), the best window of each pair."""
        windows = self._windows(hashes, first)
        kind = np.array([int(x).bit_length() for x in windows[:, 2]], np.int64)
        found = [np.zeros((0, 4), np.int64)]
        for c, own in self.lengths.items():
            of = windows[kind == c]
            width = own.words.shape[1]
            step = max(1, (1 << 18) // width)

            def cut(doc, begin, length, most):
                where = begin[:, None] + np.arange(most)
                inside = (where >= first[doc][:, None]) & (where < first[doc + 1][:, None]) & (np.arange(most) < length[:, None])
                return np.where(inside, hashes[np.clip(where, 0, len(hashes) - 1)], np.uint64(0))

            for at in range(0, len(of), step):
                doc, start, n = of[at : at + step].T
                table, keys = self._table(own), self._keys(cut(doc, start, n, width), n)
                low = np.searchsorted(table.keys, keys)
                count = np.searchsorted(table.keys, keys, "right") - low
                rows = np.repeat(np.arange(len(doc)), count.sum(1))
                low, count = low.reshape(-1), count.reshape(-1)
                which = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                met = np.unique(rows * len(own.n) + table.owner[which])
                for part in range(0, len(met), step):
                    window, item = np.divmod(met[part : part + step], len(own.n))
                    extra = allowed(own.n[item], self.similarity)
                    length = own.n[item] + 2 * extra
                    edits = edit_distance(own.words[item], own.n[item], cut(doc[window], start[window] - extra, length, int(length.max())))
                    good = edits <= extra
                    found.append(np.stack([doc[window], own.item[item], edits, np.maximum(start[window] - first[doc[window]], 0)], 1)[good])
        found = np.concatenate(found)
        found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
        return found[np.r_[True, (found[1:, :2] != found[:-1, :2]).any(1)]] if len(found) else found


def _shards(benchmark: DataFrame, id_col: str, text_col: str, options: dict) -> list[Items]:
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // SHARD_BYTES)
    parts = (items.where(F.pmod(F.xxhash64("text"), F.lit(count)) == s).orderBy("id", "text").collect() for s in range(count))
    return [Items.of([r.id for r in part], [r.text for r in part], **options) for part in parts]


def _options(similarity: float = 0.8, least: int = 5, walks: int = 4, samples: int = 16, bits: int = 2) -> dict:
    return {"similarity": similarity, "least": least, "walks": walks, "samples": samples, "bits": bits}


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """Rows (doc_id, item_id, item_words, edits, similarity, start_word): documents that hold an item or near it.

    similarity: 1 - word edits / words of the item, 0.8 or more by default. Whole texts and all windows are searched; null
    and empty texts, and items of fewer than ``least`` words, match nothing. Repeated rows each give their rows. An empty
    table on either side gives an empty table. options: see ``_options`` (walks, samples, bits set the recall).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, item_kind = dict(rows.dtypes)["id"], dict(benchmark.dtypes)[item_col]
    schema = f"id {kind}, item {item_kind}, item_words int, edits int, similarity double, start_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _shards(benchmark, item_col, item_text, _options(**options)):

        def run(batches, items=items):
            for batch in pieces(batches, "text"):
                hit = items.search(*_tokens(batch.column("text")))
                n = items.n[hit[:, 1]]
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(hit[:, 0])), pa.array([items.ids[i] for i in hit[:, 1]], pa.from_numpy_dtype(np.int64) if item_kind == "bigint" else None),
                    pa.array(n, pa.int32()), pa.array(hit[:, 2], pa.int32()), pa.array(1 - hit[:, 2] / n), pa.array(hit[:, 3]),
                ], ["id", "item", "item_words", "edits", "similarity", "start_word"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no benchmark item (see ``leaks``), unchanged, in one pass without a shuffle."""
    for items in _shards(benchmark, item_col, item_text, _options(**options)):

        def run(batches, items=items):
            for batch in pieces(batches, text_col):
                keep = np.ones(batch.num_rows, bool)
                keep[items.search(*_tokens(batch.column(text_col)))[:, 0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
