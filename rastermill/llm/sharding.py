"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups of at least 1 / ``grain`` of a shard are items by themselves; there are at most ``grain`` of them to a shard. The
rest, grains by comparison, are first dealt by hash into ``2 * grain`` bundles to a shard, which are items too. So the
items that are packed are bounded by the number of shards alone, however many groups there are.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import saved

#: Most items that are packed at once.
ITEMS = 200_000


def best_fit_decreasing(items: list[tuple[int, str]], capacity: int, shards: int | None = None) -> dict[str, int]:
    """Shard of each item (size, name): the largest first, each into the tightest shard that still has room for it.

    The shards' free capacities are kept sorted and searched by bisection. Without ``shards`` a new one is opened where
    none has room (one over capacity gets its own); with it, the one with the most room takes the item.
    """
    free = [(capacity, s) for s in range(shards or 0)]
    out, opened = {}, shards or 0
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, shard = free.pop(at)
        elif shards:
            room, shard = free.pop()
        else:
            room, shard, opened = capacity, opened, opened + 1
        insort(free, (room - size, shard))
        out[name] = shard
    return out


def assign(docs: DataFrame, shards: int | None = 16, capacity: int | None = None, grain: int = 256, id_col: str = "doc_id", text_col: str = "text", bins: int = 4096) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one for each row of docs.

    size: UTF-8 bytes of the text plus 1 (null text: 1, crc null). Rows of equal text are a group and stay together, nulls
    too. With ``shards``, sizes come out nearly equal (as far as groups allow); with ``capacity`` instead, the fewest
    shards of that size are filled. slot: place in the shard, gapless from 0, by hash bin of the id and then id; numbered
    within ``bins`` bins a shard, so that no task holds a whole shard. Repeated rows get slots of their own. law is
    ``bytes`` and grown_shard null. An empty table gives an empty one; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).select(
        "id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.md5(F.col("text").cast("binary")), F.octet_length("text").cast("string")), F.lit("null")).alias("group"))
    rows = saved(rows)
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    room = capacity or max(1, -(-total // shards))
    count = shards or max(1, -(-total // room))
    grain = max(2, min(grain, ITEMS // (3 * count)))
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("group"), F.lit(2 * grain * count)).cast("string"))
    large = [r.group for r in groups.where(F.col("bytes") * grain >= room).select("group").collect()]
    spark = docs.sparkSession
    own = F.broadcast(spark.createDataFrame([(g, g) for g in large], "group string, own string"))
    items = rows.select("group", "size").join(own, "group", "left").groupBy(F.coalesce("own", bundle).alias("item")).agg(F.sum("size").alias("bytes"))
    packed = best_fit_decreasing([(r.bytes, r.item) for r in items.collect()], room, shards)
    where = F.broadcast(spark.createDataFrame(list(packed.items()), "item string, shard int"))
    placed = rows.join(own, "group", "left").withColumn("item", F.coalesce("own", bundle)).join(where, "item")
    placed = placed.select("id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("id"), F.lit(bins)).alias("bin"))
    ahead = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("shard", "bin").count().select("shard", "bin", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("id", "text_crc32")) - 1
    out = placed.join(base, ["shard", "bin"]).withColumn("slot", (F.col("base") + number).cast("long"))
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
