"""A Merkle manifest of a table: one tree for each partition value, their roots under one root.

Trees are cut into aligned subtrees of ``HEIGHT`` levels below their root, the blocks; the roots of a level of blocks are
the leaves of the next, so that each round divides the nodes by 4096. A block is one row, whose digests lie in van Emde
Boas order: the upper half of its levels first, then each subtree of the lower half, both laid out likewise. Addresses are
arithmetic on (level, place), in making a block as in fetching siblings, so that neither needs pointers nor whole trees.

No task holds more than a block and its leaves. Leaves are ranked by a range sort, numbered within its partitions.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import saved

#: Children of a node, and levels below a block's root.
ARITY, HEIGHT = 8, 4
#: Bytes of a digest.
WIDTH = 32
#: Rows up to which a table of blocks or counts is one partition, or sent to all tasks; larger ones are shuffled.
FEW = 1 << 14
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def capacity(levels: int) -> int:
    """Nodes of a whole subtree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


@cache
def address(levels: int, level: int) -> np.ndarray:
    """Van Emde Boas places of all nodes of one level (0: the root) of a subtree of ``levels`` levels.

    The upper levels // 2 levels are laid out first, then the lower subtrees one by one.
    """
    if levels == 1:
        return np.zeros(1, np.int64)
    top = levels // 2
    if level < top:
        return address(top, level)
    below = address(levels - top, level - top)
    return (capacity(top) + np.arange(ARITY**top) * capacity(levels - top))[:, None].repeat(len(below), 1).ravel() + np.tile(below, ARITY**top)


def _hash(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


class Block:
    """A subtree: digests in van Emde Boas order, with as many levels as its tree has left there, ``HEIGHT`` at most."""

    def __init__(self, nodes: bytes | bytearray, leaves: int, height: int):
        self.nodes, self.leaves, self.height = nodes, leaves, height

    @classmethod
    def of(cls, digests: list[bytes], height: int) -> Block:
        """The block over these digests; inner nodes are hashes of their children's hex digests on end."""
        out = cls(bytearray(WIDTH * capacity(height + 1)), len(digests), height)
        level = [d.hex() for d in digests]
        for depth in range(height, -1, -1):
            for place, digest in zip(address(height + 1, depth).tolist(), level):
                out.nodes[place * WIDTH : (place + 1) * WIDTH] = bytes.fromhex(digest)
            level = [hashlib.sha256("".join(level[i : i + ARITY]).encode()).hexdigest() for i in range(0, len(level), ARITY)]
        return out

    def at(self, depth: int, place: int) -> bytes:
        where = int(address(self.height + 1, depth)[place]) * WIDTH
        return bytes(self.nodes[where : where + WIDTH])

    def count(self, depth: int) -> int:
        """Nodes that there are in a level."""
        return -(-self.leaves // ARITY ** (self.height - depth))

    def siblings(self) -> list[tuple[str, str]]:
        """For each leaf, from its own level up: hex digests of the siblings to its left and to its right, ``,`` after each level."""
        paths = [("", "")]
        for depth in range(1, self.height + 1):
            n, hexes = self.count(depth), [self.at(depth, i).hex() for i in range(self.count(depth))]
            runs = [hexes[i : i + ARITY] for i in range(0, n, ARITY)]
            above, paths = paths, []
            for (left, right), run in zip(above, runs):
                paths += [(f"{''.join(run[:i])},{left}", f"{''.join(run[i + 1 :])},{right}") for i in range(len(run))]
        return paths


def fold(digest: str, left: str, right: str) -> str:
    """The root that a hex digest leads to with these siblings."""
    for a, b in zip(left.split(",")[:-1], right.split(",")[:-1]):
        digest = hashlib.sha256(f"{a}{digest}{b}".encode()).hexdigest()
    return digest


def proof(left: str, right: str) -> str:
    """Hash of all siblings, level by level, left to right."""
    return hashlib.sha256("".join(a + b for a, b in zip(left.split(","), right.split(","))).encode()).hexdigest()


def encoded(value: str | Column) -> Column:
    """One field of a leaf: ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    value = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: list[str | Column]) -> Column:
    """Hex digest of a row's fields."""
    return F.sha2(F.concat(*[encoded(f) for f in fields]).cast("binary"), 256)


def _packed(rows: DataFrame) -> DataFrame:
    """rows of a written table, in one partition where they are few, so that grouping them needs no exchange."""
    return rows.coalesce(1) if rows.count() <= FEW else rows


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows of a written table with ``rank`` (from 0) in their ``tree`` by order, and ``total``, the tree's number of rows.

    Rows are range-sorted, and rows equal in all of ``order`` by where they were read, so that one value can fill several
    tasks; a rank is a row's place in its partition and the counts of the partitions before it.
    """
    if rows.count() <= FEW:
        tree = Window.partitionBy("tree")
        return rows.coalesce(1).withColumn("rank", (F.row_number().over(tree.orderBy(*order)) - 1).cast("long")).withColumn("total", F.count("*").over(tree))
    rows = rows.withColumn("__read", F.monotonically_increasing_id())
    by = ["tree", *order, "__read"]
    rows = saved(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("__read").withColumn("__place", F.monotonically_increasing_id()))
    rows = rows.withColumn("__part", F.shiftright("__place", 33))
    counts = rows.groupBy("tree", "__part").agg(F.min("__place").alias("__first"), F.count("*").alias("__n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("__n").over(tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = saved(counts.select("tree", "__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(tree).alias("total")))
    few = counts.count() <= FEW
    return rows.join(F.broadcast(counts) if few else counts, ["tree", "__part"]).withColumn("rank", F.col("__place") + F.col("__shift")).drop("__place", "__part", "__shift")


def _make(table: pa.Table) -> pa.Table:
    table = table.sort_by("rank")
    tree, total, rank = (table.column(c)[0].as_py() for c in ("tree", "total", "rank"))
    height, left = 0, total
    while height < HEIGHT and left > 1:
        height, left = height + 1, -(-left // ARITY)
    block = Block.of(table.column("digest").to_pylist(), height)
    made = {"tree": [tree], "block": [rank // ARITY**HEIGHT], "total": [left], "leaves": [block.leaves], "height": [height], "nodes": [bytes(block.nodes)]}
    return pa.table(made, schema=_BLOCK_ARROW)


_BLOCK = "tree string, block long, total long, leaves int, height int, nodes binary"
_BLOCK_ARROW = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("leaves", pa.int32()), ("height", pa.int32()), ("nodes", pa.binary())])


def build(leaves: DataFrame) -> list[DataFrame]:
    """Tables of blocks, the lowest first, of rows (tree, rank, total, digest): (tree, block, total, leaves, height, nodes).

    total: nodes that a tree has on the level of these blocks' roots; where it is 1, the root is the tree's. Each table
    has a 4096th of the rows of the one before, and is written to the checkpoint folder.
    """
    stages = []
    while True:
        nodes = leaves.select("tree", "rank", "total", "digest").withColumn("block", F.floor(F.col("rank") / ARITY**HEIGHT))
        stages.append(saved(nodes.groupBy("tree", "block").applyInArrow(_make, _BLOCK)))
        if stages[-1].where("total > 1").isEmpty():
            return stages
        leaves = _packed(stages[-1].where("total > 1")).select("tree", F.col("block").alias("rank"), "total", F.substring("nodes", 1, WIDTH).alias("digest"))


def roots(stages: list[DataFrame]) -> DataFrame:
    """Rows (tree, root as binary)."""
    out = None
    for stage in stages:
        part = stage.where("total = 1").select("tree", F.substring("nodes", 1, WIDTH).alias("root"))
        out = part if out is None else out.unionByName(part)
    return out


_PATHS = "tree string, rank long, left string, right string"


def paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Rows (tree, rank, left, right), the siblings of each leaf of blocks up to the root, from those of the blocks' roots.

    above: rows (tree, rank, left, right), rank being the block's number.
    """

    def each(own: pa.Table, up: pa.Table) -> pa.Table:
        found = []
        for row in own.to_pylist():
            left, right = (up.column(c)[0].as_py() if up.num_rows else "" for c in ("left", "right"))
            start = row["block"] * ARITY**HEIGHT
            found += [(row["tree"], start + i, a + left, b + right) for i, (a, b) in enumerate(Block(row["nodes"], row["leaves"], row["height"]).siblings())]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.string(), pa.string()))], ["tree", "rank", "left", "right"])

    above = above.select(F.col("tree").alias("__tree"), F.col("rank").alias("__block"), "left", "right")
    if blocks.count() <= FEW:
        blocks, above = blocks.coalesce(1), above.coalesce(1)  # above has a row for each block
    return blocks.groupBy("tree", "block").cogroup(above.groupBy("__tree", "__block")).applyInArrow(each, _PATHS)


def block_paths(stages: list[DataFrame], top: DataFrame) -> DataFrame:
    """Rows (tree, rank, left, right) for the roots of the lowest blocks; top: the same for the trees' roots (rank 0)."""
    above = None
    for at in range(len(stages) - 1, -1, -1):
        own = top.join(F.broadcast(done) if (done := stages[at].where("total = 1").select("tree")).count() <= FEW else done, "tree", "left_semi")
        above = own if above is None else own.unionByName(paths(stages[at + 1], above))
    return above


def manifest(docs: DataFrame, fields: list[str], partition: str, order: str) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Leaves (id, tree, rank, total, digest, forged), the blocks of the partitions' trees, and those of the tree above.

    fields: columns that a leaf's digest covers. forged: the digest after tampering, where it differs. See ``verify``.
    """
    text, key = F.col("text").cast("string"), F.col(order)
    hit = F.crc32(key.cast("string").cast("binary")) % 3 == 0
    forged = [F.translate(text, UPPER, UPPER.lower()) if f == "text" else f for f in fields]
    own = saved(docs.select(key.alias("id"), F.coalesce(F.concat(F.lit("+"), F.col(partition).cast("string")), F.lit("")).alias("tree"),
                            F.unhex(leaf(fields)).alias("digest"), F.when(hit & text.rlike("[A-Z]"), F.unhex(leaf(forged))).alias("forged")))
    leaves = saved(ranked(own, ["id", "digest"]))
    stages = build(leaves)
    tops = saved(ranked(roots(stages).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")), ["name"]))
    return leaves, stages, [tops, *build(tops)]


def verify(docs: DataFrame, fields: list[str] | None = None, partition: str = "lang", order: str = "doc_id") -> DataFrame:
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one for each row of docs.

    Leaves cover ``fields`` and ascend by ``order`` in the tree of their ``partition`` (null ids first, rows of one id by
    digest, so that repeated rows are leaves of their own); a null partition is a tree of its own, the first. Where 3
    divides the crc32 of the id, the text is tampered with (A-Z lower-cased) before the root is folded anew; null ids and
    texts stay. An empty table gives an empty one; other columns are ignored.
    """
    fields = fields or ["doc_id", "source", "lang", "n_chars", "text"]
    leaves, stages, (tops, *top) = manifest(docs, fields, partition, order)
    kind = dict(leaves.dtypes)["id"]
    root = roots(top).first()  # one row, or none
    # siblings of the subroots; a single tree has none
    highest = block_paths(top, roots(top).select("tree", F.lit(0).cast("long").alias("rank"), F.lit("").alias("left"), F.lit("").alias("right")))
    named = tops.select("rank", "name", F.col("digest").alias("subroot"))
    few = tops.count() <= FEW
    highest = paths(top[0], highest).join(F.broadcast(named) if few else named, "rank")
    highest = saved(highest.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("rank"), "left", "right", "subroot", F.lit(bytes(root.root) if root else b"").alias("__root")))
    known = highest.select("tree", "subroot", "__root")
    above = block_paths(stages, highest.select("tree", "rank", "left", "right")).join(F.broadcast(known) if few else known, "tree").withColumnRenamed("rank", "block")
    blocks = stages[0].join(F.broadcast(above) if stages[0].count() <= FEW else above, ["tree", "block"]).withColumnsRenamed({"tree": "__tree", "block": "__block"})

    def check(own: pa.Table, block: pa.Table) -> pa.Table:
        row = block.select(["nodes", "leaves", "height", "left", "right", "subroot", "__root"]).to_pylist()[0]
        up = (row["left"], row["right"])
        siblings = Block(row["nodes"], row["leaves"], row["height"]).siblings()
        rank, out = own.column("rank").to_numpy() % ARITY**HEIGHT, []
        for at, digest, forged in zip(rank.tolist(), own.column("digest").to_pylist(), own.column("forged").to_pylist()):
            left, right = siblings[at][0] + up[0], siblings[at][1] + up[1]
            out.append((digest.hex(), proof(left, right), fold((forged or digest).hex(), left, right)))
        n, (digests, proofs, folded) = own.num_rows, zip(*out)
        same = [row["__root"].hex()] * n
        columns = [own.column("id"), digests, [row["subroot"].hex()] * n, same, proofs, folded, [f == r for f, r in zip(folded, same)]]
        return pa.table(columns, names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    own = leaves.withColumn("block", F.floor(F.col("rank") / ARITY**HEIGHT)).groupBy("tree", "block")
    out = own.cogroup(blocks.groupBy("__tree", "__block")).applyInArrow(check, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumnRenamed("id", order)


#: DuckDB's form over the documents table: levels by recursion, all trees at once, then the tree of their roots.
ORACLE_SQL = """
WITH RECURSIVE crc(i, c) AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: xor(c >> 1, 3988292384 * (c & 1))) FROM (SELECT unnest(range(256)) AS i)),
tab AS (SELECT list(c ORDER BY i) AS t FROM crc),
docs AS (SELECT doc_id, lang, source, n_chars, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) AS crc FROM documents, tab),
own AS (SELECT doc_id, lang, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head, text, low, xor(crc, 4294967295) % 3 = 0 AS hit FROM docs),
leaves AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN hit THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS forged FROM own),
ranks AS (SELECT row_number() OVER () AS rid, *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM leaves),
up(level, tree, rank, digest, n) AS (SELECT 0, tree, rank, leaf, count(*) OVER (PARTITION BY tree) FROM ranks
  UNION ALL SELECT level + 1, tree, rank, digest, count(*) OVER (PARTITION BY tree) FROM (
    SELECT level, tree, rank // 8 AS rank, sha256(string_agg(digest, '' ORDER BY up.rank)) AS digest FROM up WHERE n > 1 GROUP BY level, tree, rank // 8)),
subs AS (SELECT tree, level, digest FROM up WHERE n = 1),
top(level, rank, digest, n) AS (SELECT 0, tree, digest, count(*) OVER () FROM subs
  UNION ALL SELECT level + 1, rank, digest, count(*) OVER () FROM (SELECT level, rank // 8 AS rank, sha256(string_agg(digest, '' ORDER BY top.rank)) AS digest FROM top WHERE n > 1 GROUP BY level, rank // 8)),
sib AS (SELECT tree, level, rank, string_agg(digest, '') OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, string_agg(digest, '') OVER (b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r
  FROM up WHERE n > 1 WINDOW b AS (PARTITION BY tree, level, rank // 8 ORDER BY rank)),
topsib AS (SELECT level, rank, string_agg(digest, '') OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, string_agg(digest, '') OVER (b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r
  FROM top WHERE n > 1 WINDOW b AS (PARTITION BY level, rank // 8 ORDER BY rank)),
steps AS (SELECT rid, sib.level, coalesce(l, '') AS l, coalesce(r, '') AS r FROM ranks JOIN sib ON sib.tree = ranks.tree AND sib.rank = ranks.rank // (8 ** sib.level)::BIGINT
  UNION ALL SELECT rid, 1000 + topsib.level, coalesce(l, ''), coalesce(r, '') FROM ranks JOIN topsib ON topsib.rank = ranks.tree // (8 ** topsib.level)::BIGINT),
proofs AS (SELECT rid, list({'l': l, 'r': r} ORDER BY level) AS path, string_agg(l || r, '' ORDER BY level) AS whole FROM steps GROUP BY rid),
found AS (SELECT doc_id, leaf, s.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root, sha256(coalesce(whole, '')) AS proof_sha256,
  list_reduce(list_prepend({'l': coalesce(forged, leaf), 'r': ''}, coalesce(path, [])), lambda x, y: {'l': sha256(y.l || x.l || y.r), 'r': ''}).l AS folded_root
  FROM ranks LEFT JOIN proofs USING (rid) JOIN subs s USING (tree))
SELECT *, folded_root = root AS verified FROM found
"""
