"""SimHash near-duplicates: fingerprints of word shingles, linked by BK-trees within a Hamming radius.

Every pair within the radius is found: the 64 bits are cut into ``radius + pick`` blocks, so that two fingerprints that
differ in at most ``radius`` bits agree on at least ``pick`` whole blocks. Each choice of ``pick`` blocks deals the
distinct fingerprints into shards of equal block values; a shard's BK-tree is searched with the shard's own
fingerprints. ``pick`` grows with the number of fingerprints (1 to 4) so that shards stay small; the links are the same.

For a similarity instead of a radius, fingerprints are of distinct shingles and have 128 bits; a radius that wide has no
whole blocks in common, so shards are of texts whose smallest hashes agree in a band. Candidates are verified by the
shingle sets themselves, so that no two texts below the similarity are linked.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import saved, shuffles
from ._words import LOWER, gram_hashes, gram_rows, mix, packed, pieces, word_hashes, words
from .graph import components

#: Fingerprints in a part of a shard: larger shards are cut, and every pair of parts is searched apart.
SHARD = 4096


def fingerprint(raw: bytes, size: int = 4) -> np.uint64:
    """SimHash of one text: A-Z lower-cased, shingles of ``size`` words with repeats, XXH64 with seed 42."""
    text = b" ".join(raw.lower().split())
    if not text:
        return np.uint64(0)
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(text)]
    k, digest = min(size, len(starts)), xxhash.xxh64_intdigest
    hashes = np.array([digest(text[a:b], 42) for a, b in zip(starts, ends[k - 1 :])], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint as long), one for each row of docs; null, empty or blank texts have fingerprint 0."""

    def run(batches):
        for batch in pieces(batches, "text"):
            data, off = packed(batch.column("text"))
            raw = data.tobytes()
            out = np.array([fingerprint(raw[a:b], size) for a, b in zip(off.tolist(), off[1:].tolist())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out.view(np.int64))], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, fingerprint long").withColumnRenamed("id", id_col)


class BkForest:
    """BK-trees of many shards at once: a node's children are keyed by their integer Hamming distance to it."""

    def __init__(self, prints: np.ndarray, group: np.ndarray):
        """prints: (rows, words). group: ascending numbers, one tree each. Equal fingerprints must not be in one group."""
        self.prints, self.bits = prints, 64 * prints.shape[1]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        self.root = np.repeat(first, np.diff(np.r_[first, len(group)]))
        members = np.flatnonzero(self.root != np.arange(len(group)))
        parent, keys, child = self.root[members], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(members):
            key = parent * (self.bits + 1) + self._far(members, parent)
            order = np.argsort(key, kind="stable")
            key, members = key[order], members[order]
            new = np.r_[True, key[1:] != key[:-1]]
            keys.append(key[new])
            child.append(members[new])
            parent = members[new][np.cumsum(new) - 1][~new]
            members = members[~new]
        order = np.argsort(np.concatenate(keys))
        self.keys, self.child = np.concatenate(keys)[order], np.concatenate(child)[order]

    def _far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.prints[a] ^ self.prints[b]).sum(1, dtype=np.int64)

    def within(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (asked, other) of positions in one tree whose fingerprints differ in at most radius bits."""
        found, node = [(np.zeros(0, np.int64),) * 2], self.root[asked]
        while len(asked):
            far = self._far(asked, node)
            hit = (far <= radius) & (asked != node)
            found.append((asked[hit], node[hit]))
            low = np.searchsorted(self.keys, node * (self.bits + 1) + np.maximum(far - radius, 1))
            count = np.searchsorted(self.keys, node * (self.bits + 1) + np.minimum(far + radius, self.bits), "right") - low
            asked = np.repeat(asked, count)
            node = self.child[np.arange(len(asked)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        return tuple(np.concatenate(x) for x in zip(*found))


def _forest_links(prints: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join just what the radius joins: each member of a tree's component to the component's first."""
    tree, label = BkForest(prints, group), np.arange(len(prints))
    for at in range(0, len(prints), 1024):
        a, b = tree.within(np.arange(at, min(at + 1024, len(prints))), radius)
        while len(a):
            least = np.minimum(label[a], label[b])
            old = label.copy()
            np.minimum.at(label, label[a], least)
            np.minimum.at(label, label[b], least)
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            label = label[label]
            if (old == label).all():
                break
    own = np.flatnonzero(label != np.arange(len(label)))
    return own, label[own]


def _by_cells(keys: list[str], links):
    """Applies links to frames that hold whole groups of keys, from rows that come sorted by them."""

    def run(frames):
        rest = None
        for rows in frames:
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            last = (rows[keys] == rows[keys].iloc[-1]).all(axis=1).to_numpy()
            cut = int(len(rows) - last[::-1].argmin()) if not last.all() else 0
            if cut:
                yield links(rows.iloc[:cut].reset_index(drop=True))
            rest = rows.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield links(rest)

    return run


def _search(radius: int):
    """Links (a, b) of fingerprints within groups of rows that come sorted."""
    keys = ["combo", "part", "i", "j"]

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        number = (rows[keys].ne(rows[keys].shift())).any(axis=1).cumsum().to_numpy()
        value = rows["fingerprint"].to_numpy()
        a, b = _forest_links(value.view(np.uint64)[:, None], number, radius)
        return pd.DataFrame({"a": value[a], "b": value[b]})

    return _by_cells(keys, links)


def _joined(dealt: DataFrame, radius: int, shard: int) -> DataFrame:
    """Links within the shards (combo, part) of dealt; shards of more than ``shard`` rows are cut, and each pair of cuts is searched."""
    sizes = dealt.groupBy("combo", "part").count().where("count > 1").select("combo", "part", F.ceil(F.col("count") / shard).cast("int").alias("cuts"))
    cut = dealt.join(sizes, ["combo", "part"]).withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("cuts")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select("fingerprint", "combo", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    cut = cut.repartition(shuffles(dealt.sparkSession), "combo", "part", "i", "j").sortWithinPartitions("combo", "part", "i", "j")
    return cut.mapInPandas(_search(radius), "a long, b long")


def links(nodes: DataFrame, radius: int = 4, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between distinct fingerprints of ``nodes`` that join exactly what the Hamming radius joins."""
    count = nodes.count()
    pick = next((p for p in (1, 2, 3) if count >> (64 * p // (radius + p)) <= 64), 4)
    blocks = radius + pick
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum((1 << edges[x + 1]) - (1 << edges[x]) for x in chosen) for chosen in combinations(range(blocks), pick)]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("combo"), F.col("fingerprint").bitwiseAND(F.lit(signed(m))).alias("part")) for c, m in enumerate(masks)]))
    return _joined(nodes.select("fingerprint", parts.alias("x")).select("fingerprint", "x.*"), radius, shard)


def differing(similarity: float) -> float:
    """Share of bits in which SimHashes of texts differ whose shingle sets have this Jaccard similarity, sizes being equal."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _classes(nodes: DataFrame, node: str, joined: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Rows (node, component_id) of nodes (node, least): the smallest ``least`` of the nodes that links join.

    labels: rows (node, label) of components that are known, whose labels the links join.
    """
    if labels is not None:
        nodes = nodes.join(labels.withColumnRenamed("node", node), node, "left").select(node, "least", F.coalesce("label", node).alias("__at"))
    else:
        nodes = nodes.withColumn("__at", F.col(node))
    labels = saved(nodes.join(components(joined).withColumnRenamed("node", "__at"), "__at", "left").select(node, "least", F.coalesce("label", "__at").alias("label")))
    # written, so that the join with it is a plain one of which Spark can split a large component's side
    least = saved(labels.groupBy("label").agg(F.min("least").alias("component_id")))
    return labels.join(least, "label").select(node, "component_id")


def _sets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the distinct shingles of all rows on end, ascending in each, and where each row starts (one more entry).

    A text of fewer words than a shingle is one shingle.
    """
    data, off = packed(batch.column("text"))
    data = LOWER[data]
    starts, ends, first = words(data, off)
    hashes = word_hashes(data, starts, ends)
    row, start = gram_rows(first, size)
    grams = gram_hashes(hashes, size)[start] if len(start) else np.zeros(0, np.uint64)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < size)).tolist()
    row = np.r_[row, np.array(short, np.int64)]
    grams = np.r_[grams, np.array([gram_hashes(hashes[first[i] : first[i + 1]], int(first[i + 1] - first[i]))[0] for i in short], np.uint64)]
    both = np.unique((row.astype(np.uint64) << np.uint64(32)) | (grams >> np.uint64(32)))
    return both & np.uint64(0xFFFFFFFF), np.searchsorted(both, np.arange(batch.num_rows + 1, dtype=np.uint64) << np.uint64(32))


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """rows with ``text`` replaced by ``shingles``, an ordered array of the 32-bit hashes of its distinct shingles."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches):
        for batch in pieces(batches, "text"):
            hashes, offsets = _sets(batch, size)
            values = pa.array(hashes.astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], [*names, "shingles"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, "".join(f"{n} {kinds[n]}, " for n in names) + "shingles array<int>")


#: Bands of so many smallest hashes each: texts of similarity 0.8 meet in one with probability 0.985.
BANDS, WIDTH = 8, 4


def signatures(keyed: DataFrame, size: int) -> DataFrame:
    """Rows (key, node, n, fingerprint, fingerprint1, bands) of rows (key, text).

    node: a 64-bit hash of the set of distinct shingles, n their number; fingerprints: SimHash of the set in 128 bits; bands:
    ``BANDS`` hashes, of which two texts share each with probability similarity ** WIDTH. A text without words has n 0.
    """
    draw = np.random.default_rng(9)
    turns = draw.integers(1, 2**63, (BANDS, WIDTH), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for batch in pieces(batches, "text"):
            hashes, offsets = _sets(batch, size)
            n, rows = np.diff(offsets), batch.num_rows
            some = np.flatnonzero(n)
            out, bands = np.zeros((3, rows), np.uint64), np.zeros((rows, BANDS), np.uint64)
            if len(some):
                starts, x = offsets[some], mix(hashes)
                out[0, some] = mix(np.add.reduceat(mix(x ^ np.uint64(0x5EED)), starts) + n[some].astype(np.uint64))
                for w, value in enumerate((x, mix(x + np.uint64(1)))):
                    ones = np.add.reduceat(np.unpackbits(value.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), starts, axis=0, dtype=np.int32)
                    out[1 + w, some] = np.packbits(2 * ones > n[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
                for b in range(BANDS):
                    band = np.full(len(some), b, np.uint64)
                    for turn in turns[b]:
                        band = mix(band ^ np.minimum.reduceat(x * turn, starts))
                    bands[some, b] = band
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out[0].view(np.int64)), pa.array(n.astype(np.int32)), *[pa.array(o.view(np.int64)) for o in out[1:]], lists], ["key", "node", "n", *PRINT, "bands"])

    return keyed.mapInArrow(run, f"key {dict(keyed.dtypes)['key']}, node long, n int, fingerprint long, fingerprint1 long, bands array<long>")


PRINT = ["fingerprint", "fingerprint1"]


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) of nodes whose sets, rows (node, shingles), have the similarity."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("__one")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("__two")), "b")
    common = F.size(F.array_intersect("__one", "__two"))
    return both.where(common >= similarity * (F.size("__one") + F.size("__two") - common)).select("a", "b")


class _Common:
    """How many shingles a row shares with each row of its cell, by lists of the rows that hold each shingle."""

    def __init__(self, sets: list[np.ndarray], cell: np.ndarray):
        sizes = np.array([len(x) for x in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        key = (cell[owner].astype(np.uint64) << np.uint64(32)) | np.concatenate(sets).astype(np.int32).view(np.uint32)
        _, self.term = np.unique(key, return_inverse=True)
        self.rows, self.off = owner[np.argsort(self.term, kind="stable")], np.r_[0, np.cumsum(sizes)]
        self.start = np.r_[0, np.cumsum(np.bincount(self.term))]

    def counts(self, row: int) -> np.ndarray:
        terms = self.term[self.off[row] : self.off[row + 1]]
        _, at = _spread(terms, self.start[terms], self.start[terms + 1] - self.start[terms])
        return np.bincount(self.rows[at], minlength=len(self.off) - 1)


def _apart(radius: int, similarity: float):
    """Links (a, b) of nodes whose sets have the similarity, in cells (part, u, s) of rows that come sorted.

    Rows with ``asked`` are looked up in the BK-tree of their cell. Candidates within the radius are measured by their sets
    where they lie, a pair only in the first band that it shares; what has been joined in the cell is not measured again,
    and of each component that a row joins one link is given.
    """
    keys = ["part", "u", "s"]

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        cell = (rows[keys].ne(rows[keys].shift())).any(axis=1).cumsum().to_numpy()
        asked, node, label, n, part = (rows[c].to_numpy().copy() for c in ("asked", "node", "label", "n", "part"))
        prints, bands, common = rows[PRINT].to_numpy().view(np.uint64), np.stack(rows["bands"].to_list()), _Common(rows["shingles"].to_list(), cell)
        # equal fingerprints of a cell are one node of its tree
        order = np.lexsort((prints[:, 1], prints[:, 0], cell))
        new = np.r_[True, (cell[order][1:] != cell[order][:-1]) | (prints[order][1:] != prints[order][:-1]).any(1)]
        place = np.empty(len(rows), np.int64)
        place[order] = np.cumsum(new) - 1
        tree = BkForest(prints[order][new], cell[order][new])
        held = order[~asked[order]]
        first = np.searchsorted(place[held], np.arange(new.sum() + 1))
        found, who = [], np.flatnonzero(asked)
        for at in range(0, len(who), 256):
            some = who[at : at + 256]
            own = np.unique(place[some])
            a, b = tree.within(own, radius)
            a, b = np.r_[a, own], np.r_[b, own]
            by = np.argsort(a, kind="stable")
            a, b = a[by], b[by]
            for i in some.tolist():
                near = b[np.searchsorted(a, place[i]) : np.searchsorted(a, place[i], "right")]
                _, near = _spread(near, first[near], first[near + 1] - first[near])
                near = held[near]
                near = near[(label[near] != label[i]) & (np.minimum(n[near], n[i]) >= similarity * np.maximum(n[near], n[i]))]
                same = bands[near] == bands[i]
                near = near[bands[i][same.argmax(1)] == part[i]] if len(near) else near
                if not len(near):
                    continue
                shared = common.counts(i)[near]
                near = near[shared >= similarity * (n[near] + n[i] - shared)]
                if len(near):
                    labels, one = np.unique(label[near], return_index=True)
                    found += [(node[i], x) for x in node[near[one]].tolist()]
                    labels = np.r_[labels, label[i]]
                    label[np.isin(label, labels)] = labels.min()
        return pd.DataFrame({"a": [min(p) for p in found], "b": [max(p) for p in found]}, dtype="int64")

    return _by_cells(keys, links)


def _spread(rows: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row as often as counted, with the numbers from its low on."""
    return np.repeat(rows, count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)


def _unsettled(met: DataFrame, leads: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """met with labels, and of its rows those whose label is that of none of their shard's leaders."""
    named = saved(met.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    of = leads.join(labels.withColumnRenamed("node", "lead"), "lead", "left").select("part", F.coalesce("label", "lead").alias("label")).distinct()
    return named, saved(named.join(of, ["part", "label"], "left_anti"))


def _outside(named: DataFrame, leads: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of named (part, label, ...) that are not of their shard's main label, the most frequent one of its leaders.

    Of two nodes with different labels one at least is among them, however many leaders a shard got; where it has one, they
    are those that it did not settle.
    """
    of = leads.join(labels.withColumnRenamed("node", "lead"), "lead", "left").select("part", F.coalesce("label", "lead").alias("label")).distinct()
    sizes = named.join(of, ["part", "label"]).groupBy("part", "label").agg(F.count("*").alias("rows"))
    main = sizes.groupBy("part").agg(F.max(F.struct("rows", "label")).alias("best")).select("part", F.col("best.label").alias("label"))
    return saved(named.join(main, ["part", "label"], "left_anti"))


def similar(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """Rows (doc_id, component_id), one for each row of docs: near-duplicates by shingles of ``size`` words at a similarity.

    Texts with one set of shingles are one node. Nodes that share a band of smallest hashes are a shard, and candidates where
    their fingerprints differ in no more bits than the similarity gives plus five deviations. First every node is
    compared with the nearest leader of its shards, which settles groups of copies in one step; as long as more than ``shard`` nodes of a shard
    stay and half of them settle, they get further leaders. Then all but those of the largest leader's component are looked up in
    BK-trees of their shards, cut into cells, where candidates of different components are measured by their sets. So every candidate
    pair ends up verified or inside one component, whether ``shard`` gave further leaders or not, and only pairs whose sets have the similarity link. A pair at 0.8 shares a shard with
    probability 0.985, a closer one more surely. See ``near_duplicates`` for nulls, repeats and empty tables.
    """
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text).alias("no")).alias("key"), text.alias("text"))
    prints = saved(signatures(keyed, size))
    nodes = saved(prints.groupBy("node").agg(F.min("key").alias("least"), *[F.first(c).alias(c) for c in ("n", *PRINT, "bands")]))
    p = differing(similarity)
    radius = round(64 * len(PRINT) * p + 5 * math.sqrt(64 * len(PRINT) * p * (1 - p)))
    dealt = nodes.where("n > 0").select("node", "n", *PRINT, F.explode("bands").alias("part"))
    shards = dealt.groupBy("part").agg(F.count("*").alias("rows"), F.min(F.struct("node", "n", *PRINT)).alias("lead"))
    # written, so that the join is a plain one of which Spark can split a large shard's side
    shards = saved(shards.where("rows > 1"))
    met = saved(dealt.join(shards.select("part"), "part"))
    of = met.select("node").distinct().join(nodes.select("node", "bands", "least.*"), "node")
    here = (keyed["key.no"] == of["no"]) & keyed["key.id"].eqNullSafe(of["id"])
    sets = saved(shingle_sets(keyed.join(of, here).select("node", "bands", "text").dropDuplicates(["node"]), size))

    def with_leader(rows: DataFrame, leaders: DataFrame) -> DataFrame:
        both = rows.join(leaders.select("part", "lead"), "part").where("node <> lead.node")
        far = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"lead.{c}"))) for c in PRINT), F.lit(0))
        few, many = F.least("n", "lead.n"), F.greatest("n", "lead.n")
        # of its leaders the nearest; pairs with the others are candidates that the cells measure
        near = both.where((far <= radius) & (few >= similarity * many)).groupBy("node").agg(F.min(F.struct(far.alias("far"), F.col("lead.node").alias("lead"))).alias("best"))
        pairs = near.select(F.least("node", "best.lead").alias("a"), F.greatest("node", "best.lead").alias("b")).distinct()
        return saved(verified(pairs, sets, similarity))

    linked, leads = with_leader(met, shards), shards.select("part", F.col("lead.node").alias("lead"))
    labels = components(linked)
    named, open_ = _unsettled(met, leads, labels)
    many = open_.groupBy("part").agg(F.count("*").alias("rows"), F.min(F.struct("node", "n", *PRINT)).alias("lead")).where(F.col("rows") > shard)
    while (before := many.agg(F.sum("rows")).first()[0]) is not None:
        hot = saved(many)
        linked = linked.unionByName(with_leader(open_.drop("label"), hot))
        leads = saved(leads.unionByName(hot.select("part", F.col("lead.node").alias("lead"))))
        labels = components(linked)
        named, open_ = _unsettled(met, leads, labels)
        if 2 * open_.join(hot.select("part"), "part").count() > before:
            break
        many = open_.groupBy("part").agg(F.count("*").alias("rows"), F.min(F.struct("node", "n", *PRINT)).alias("lead")).where(F.col("rows") > shard)
    open_ = _outside(named, leads, labels)
    own = lambda c: F.pmod(F.xxhash64("node", F.lit(1)), F.col(c)).cast("int")
    all_ = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    # cells of so many rows, or of so many shingles where texts are long
    cut = F.ceil(F.greatest(F.count("*") / shard, F.sum("n") / (shard * 512))).cast("int")
    cuts = saved(open_.groupBy("part").agg(cut.alias("us")).join(named.groupBy("part").agg(cut.alias("ss")), "part"))
    columns = ["part", "u", "s", "asked", "node", "n", "label", *PRINT, "bands", "shingles"]
    cells = open_.join(cuts, "part").join(sets, "node").withColumn("asked", F.lit(True)).withColumn("u", own("us")).withColumn("s", all_("ss")).select(*columns)
    cells = cells.unionByName(named.join(cuts, "part").join(sets, "node").withColumn("asked", F.lit(False)).withColumn("s", own("ss")).withColumn("u", all_("us")).select(*columns))
    cells = cells.repartition(shuffles(docs.sparkSession), "part", "u", "s").sortWithinPartitions("part", "u", "s")
    rest = saved(cells.mapInPandas(_apart(radius, similarity), "a long, b long").distinct())
    # what the rest links are components, so that few rounds join them
    ends = labels.select(F.col("node").alias("a"), F.col("label").alias("__a")), labels.select(F.col("node").alias("b"), F.col("label").alias("__b"))
    between = rest.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("__a", "a").alias("a"), F.coalesce("__b", "b").alias("b"))
    groups = _classes(nodes.select("node", "least"), "node", between, labels)
    return prints.join(groups, "node").select(F.col("key.id").alias(id_col), F.col("component_id.id").alias("component_id"))


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint as 16 hex digits, component_id), one for each row of docs.

    component_id: the smallest doc_id that can be reached over links of at most ``radius`` differing bits, its own
    included. Null, empty and blank texts have fingerprint 0 and are linked like any other; texts of fewer words than a
    shingle are one shingle; repeated rows stay and share a component; null doc_ids are never the smallest (a component
    that has nothing else gets null); an empty table gives an empty table; other columns are ignored.
    """
    prints = saved(fingerprints(docs, size, id_col, text_col))
    nodes = saved(prints.groupBy("fingerprint").agg(F.min(id_col).alias("least")))
    groups = _classes(nodes, "fingerprint", links(nodes, radius))
    return prints.join(groups, "fingerprint").select(id_col, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
