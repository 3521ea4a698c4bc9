"""Substring dedup: suffix automata of reference passages, through which documents are streamed for matching statistics.

A window is ``span`` words. Each window picks the smallest hash among its runs of ``GRAM`` words; neighbouring windows with
one choice form a segment, and equal windows make equal choices, so that only segments of one chosen run (an anchor) can
share a window. Of segments that are equal as a whole, all but the first are later copies: repeats in one document are
seen where it is read, others by the smallest document of each segment. Where an anchor has several different segments,
its shard is a suffix automaton of those that come earlier: each segment is streamed through it, and windows that end
where the matching statistic reaches ``span`` are later copies. Every passage visits one shard, that of its anchor, instead
of all shards of the corpus. Shards of more than ``shard`` segments are settled window by window with partial aggregates
instead, which no group's size can hold up. Segments travel as hashes and are found again where their text is read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import saved, shuffles
from ._words import _STEP, U64, gram_hashes, gram_rows, mix, packed, pieces, powers, word_hashes, words

GRAM = 5
_NONE = -(2**63)


class SuffixAutomaton:
    """Of several word sequences, grown on line. States hold transitions, suffix link and longest length."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            last = self._extend(last, word)

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word, self.next[p][word])
        return new

    def matching(self, sequence: list[int]) -> list[int]:
        """For each word, the length of the longest match that ends with it."""
        state = size = 0
        out = []
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            else:
                size = 0
            out.append(size)
        return out


def segments(hashes: np.ndarray, first: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(row, start word, windows, anchor, hash of all its words) of each segment."""
    row, start = gram_rows(first, span)
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2
    gram = gram_hashes(hashes, GRAM)
    low, at, reach, need = gram, np.arange(len(gram)), 1, span - GRAM + 1
    while reach < need:  # the leftmost smallest of ever longer runs
        step = min(reach, need - reach)
        left = low[:-step] <= low[step:]
        low, at, reach = np.where(left, low[:-step], low[step:]), np.where(left, at[:-step], at[step:]), reach + step
    at = at[start]
    new = np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])]
    begin = np.flatnonzero(new)
    count = np.diff(np.r_[begin, len(start)])
    a, b = start[begin], start[begin] + count + span - 1
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * powers(_STEP, len(hashes)), out=total[1:])
    whole = mix((total[b] - total[a]) * powers(pow(_STEP, -1, 2**64), len(hashes))[a] + count.astype(U64))
    return row[begin], a - first[row[begin]], count, gram[at[begin]], whole


def _hashed(column) -> tuple[np.ndarray, np.ndarray]:
    data, off = packed(column)
    starts, ends, first = words(data, off)
    return word_hashes(data, starts, ends), first


def _covered(matches: list[int], span: int) -> list[tuple[int, int]]:
    """Runs (first window, windows) of windows whose last word has a match of span words."""
    ends = np.flatnonzero(np.array(matches) >= span)
    if not len(ends):
        return []
    cut = np.flatnonzero(np.diff(ends) > 1) + 1
    return [(int(x[0]) - span + 1, len(x)) for x in np.split(ends, cut)]


def _later(span: int):
    """Rows (key, start, n) of windows that a segment earlier in its shard holds; input sorted by anchor, key and start."""

    def run(batches):
        anchor, automaton = None, None
        for batch in batches:
            out = []
            for own, key, start, sequence in zip(*[batch.column(c).to_pylist() for c in ("anchor", "key", "start", "words")]):
                if own != anchor:
                    anchor, automaton = own, SuffixAutomaton()
                else:
                    out += [(key, start + a, n) for a, n in _covered(automaton.matching(sequence), span)]
                automaton.add(sequence)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["key", "start", "n"])

    return run


def _first_in_row(row: np.ndarray, anchor: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """For each segment, whether it is the first of its kind in its document."""
    order = np.lexsort((np.arange(len(row)), anchor, whole, row))
    first = np.ones(len(row), bool)
    a, b = order[1:], order[:-1]
    first[a[(row[a] == row[b]) & (whole[a] == whole[b]) & (anchor[a] == anchor[b])]] = False
    return first


def _tag(anchor: np.ndarray) -> np.ndarray:
    """16 bits of the anchor; with them, 80 bits tell segments apart."""
    return (anchor >> U64(48)).astype(np.int32)


def _longs(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def _kinds(rows: DataFrame, span: int) -> DataFrame:
    """Rows (anchor, whole, first, docs, kinds) of the segments that have a copy in another document, or whose anchor has another segment.

    first: the smallest key. A task sends one row for each kind of segment in a megabyte of text, so that a passage
    with any number of copies reaches the task of its anchor as few rows.
    """

    def cut(batches):
        for batch in pieces(batches, "text"):
            row, _, _, anchor, whole = segments(*_hashed(batch.column("text")), span)
            key = batch.column("key").to_numpy()[row]
            order = np.lexsort((key, whole, anchor))
            row, anchor, whole, key = row[order], anchor[order], whole[order], key[order]
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])] if len(row) else np.zeros(0, bool)
            begin = np.flatnonzero(new)
            last = np.r_[begin[1:], len(key)] - 1
            yield pa.RecordBatch.from_arrays([_longs(anchor[begin]), _longs(whole[begin]), pa.array(key[begin]), pa.array(np.where(key[begin] != key[last[: len(begin)]], 2, 1).astype(np.int32))], ["anchor", "whole", "key", "docs"])

    parts = rows.mapInArrow(cut, "anchor long, whole long, key long, docs int")
    # most anchors have one segment in one document and go here, on sums of one size whatever an anchor gathers
    state = [F.min("whole").alias("whole"), F.max("whole").alias("last"), F.min("key").alias("first"), F.sum("docs").alias("docs")]
    anchors = saved(parts.groupBy("anchor").agg(*state).where("whole < last or docs > 1"))
    one = anchors.where("whole = last").select("anchor", "whole", "first", "docs", F.lit(1).cast("long").alias("kinds"))
    shared = parts.join(anchors.where("whole < last").select("anchor"), "anchor")
    shared = saved(shared.groupBy("anchor", "whole").agg(F.min("key").alias("first"), F.sum("docs").alias("docs")))
    # written, so that the join with it is a plain one of which Spark can split a common anchor's side
    many = saved(shared.groupBy("anchor").agg(F.count("*").alias("kinds")))
    return one.unionByName(shared.join(many, "anchor"))


def repeats(rows: DataFrame, span: int, shard: int) -> DataFrame:
    """Rows (key, wholes, spans): segments of document key that are later copies, and (start, n) of later windows in others.

    rows: (key, text), keys unique but for equal rows. Repeats within one document are not told.
    """
    kinds = saved(_kinds(rows, span))
    tag = F.shiftrightunsigned("anchor", 48).cast("int").alias("tag")

    def every(batches):
        for batch in pieces(batches, "text"):
            row, _, _, anchor, whole = segments(*_hashed(batch.column("text")), span)
            one = _first_in_row(row, anchor, whole)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row[one])), _longs(whole[one]), pa.array(_tag(anchor[one]))], ["key", "whole", "tag"])

    copied = kinds.where("docs > 1").select("whole", tag, "first")
    copies = rows.mapInArrow(every, "key long, whole long, tag int").join(copied, ["whole", "tag"]).where("key > first").select("key", "whole")

    def quote(batches):
        for batch in pieces(batches, "text"):
            hashes, first = _hashed(batch.column("text"))
            row, start, n, anchor, whole = segments(hashes, first, span)
            one, wanted = _first_in_row(row, anchor, whole), batch.column("wanted")
            ask = np.zeros(len(row), bool)
            begin = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for i in range(batch.num_rows):
                at = slice(begin[i], begin[i + 1])
                ask[at] = np.isin(whole[at].view(np.int64), wanted[i].values.to_numpy()) & one[at]
            chosen = np.flatnonzero(ask)
            size = n[chosen] + span - 1
            offsets = np.r_[0, np.cumsum(size)]
            at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size) + np.repeat((first[row] + start)[chosen], size)
            words_ = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _longs(hashes[at]))
            yield pa.RecordBatch.from_arrays([_longs(anchor[chosen]), batch.column("key").take(pa.array(row[chosen])), pa.array(start[chosen]), words_], ["anchor", "key", "start", "words"])

    def passages(of: DataFrame) -> DataFrame:
        asked = of.groupBy(F.col("first").alias("key")).agg(F.collect_list("whole").alias("wanted"))
        return rows.join(asked, "key")

    small = passages(kinds.where((F.col("kinds") > 1) & (F.col("kinds") <= shard))).mapInArrow(quote, "anchor long, key long, start long, words array<long>")
    small = small.repartition(shuffles(rows.sparkSession), "anchor").sortWithinPartitions("anchor", "key", "start")
    spans = small.mapInArrow(_later(span), "key long, start long, n long")

    large = kinds.where(F.col("kinds") > shard)
    if not large.isEmpty():

        def windows(batches):
            for batch in quote(batches):
                for anchor, key, start, sequence in zip(*[batch.column(c).to_pylist() for c in ("anchor", "key", "start", "words")]):
                    found = gram_hashes(np.array(sequence, np.int64).view(U64), span)
                    n = len(found)
                    yield pa.RecordBatch.from_pydict({"anchor": [anchor] * n, "window": found.view(np.int64), "key": [key] * n, "start": np.arange(start, start + n)})

        each = passages(large).mapInArrow(windows, "anchor long, window long, key long, start long")
        place = F.struct("key", "start")
        first = each.groupBy("anchor", "window").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last")
        late = each.join(first, ["anchor", "window"]).where(place > F.col("first"))
        spans = spans.unionByName(late.select("key", "start", F.lit(1).cast("long").alias("n")))
    told = copies.select("key", "whole", F.lit(None).cast("struct<start:long,n:long>").alias("span"))
    told = told.unionByName(spans.select("key", F.lit(None).cast("long").alias("whole"), F.struct("start", "n").alias("span")))
    return told.groupBy("key").agg(F.collect_list("whole").alias("wholes"), F.collect_list("span").alias("spans"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows (key, text) and, where keys are not the ids, the ids of keys. A null id is the smallest key, a null text empty.

    Where different texts share an id, keys are numbers in the order of (id, hash of the text) instead of ids.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    no = F.xxhash64("text")
    if rows.groupBy("key").agg(F.min(no).alias("a"), F.max(no).alias("b")).where("a <> b").isEmpty():
        return rows, None
    pairs = rows.select(F.col("key").alias("id"), no.alias("no")).distinct()
    order = pairs.repartitionByRange(shuffles(docs.sparkSession), "id", "no").sortWithinPartitions("id", "no")
    numbers = saved(order.withColumn("key", F.monotonically_increasing_id()))
    return rows.select(F.col("key").alias("id"), no.alias("no"), "text").join(numbers, ["id", "no"]).select("key", "text"), numbers.select("key", "id")


def deduplicate(docs: DataFrame, span: int = 20, shard: int = 4096, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256, and kept with ``texts``), one for each row of docs.

    A word is removed where some window of ``span`` words over it, as it stands in the input, starts earlier too: in a
    document of smaller id, or in the same document further up. Words are what stands between white space, unchanged;
    kept: the other words joined by one space. Null and blank texts have no words. Repeated rows are one document and
    have one outcome; different texts under one id stand side by side in the order of a hash. Null ids come before all
    others. An empty table gives an empty one; other columns are ignored.
    """
    rows, ids = _keyed(docs, id_col, text_col)

    def remove(batches):
        for batch in pieces(batches, "text"):
            hashes, first = _hashed(batch.column("text"))
            row, start, n, anchor, whole = segments(hashes, first, span)
            gone = ~_first_in_row(row, anchor, whole)
            begin = np.searchsorted(row, np.arange(batch.num_rows + 1))
            edge = np.zeros(len(hashes) + 1, np.int64)
            for i, (wholes, spans) in enumerate(zip(batch.column("wholes"), batch.column("spans"))):
                if wholes.is_valid and len(wholes.values):
                    at = slice(begin[i], begin[i + 1])
                    gone[at] |= np.isin(whole[at].view(np.int64), wholes.values.to_numpy())
                if spans.is_valid and len(spans.values):
                    a = first[i] + spans.values.field("start").to_numpy()
                    np.add.at(edge, a, 1)
                    np.add.at(edge, a + spans.values.field("n").to_numpy() + span - 1, -1)
            a = (first[row] + start)[gone]
            np.add.at(edge, a, 1)
            np.add.at(edge, a + n[gone] + span - 1, -1)
            keep = np.cumsum(edge[:-1]) == 0
            out = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own, kept = text.encode().split(), keep[first[i] : first[i + 1]]
                left = b" ".join(own if kept.all() else [own[j] for j in np.flatnonzero(kept).tolist()])
                out.append((len(own), len(own) - int(kept.sum()), hashlib.sha256(left).hexdigest(), left.decode() if texts else None))
            yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]], ["key", "n_words", "n_removed", "kept_sha256", "kept"])

    done = rows.join(repeats(rows, span, shard), "key", "left").mapInArrow(remove, "key long, n_words long, n_removed long, kept_sha256 string, kept string")
    done = done.withColumn("id", F.col("key")) if ids is None else done.join(ids, "key")
    return done.select(F.when(F.col("id") != _NONE, F.col("id")).alias(id_col), "n_words", "n_removed", "kept_sha256", *["kept"] * texts)
