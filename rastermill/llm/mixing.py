"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source sends its documents in a shuffled order (by md5 of the id), again and again. A document's virtual finish time
is the source's words up to its end divided by the source's target; the mix is all documents in the order of finish time,
cut where the total budget is used up. As the targets sum to the budget, that is virtual time 1: what finishes by then is
taken whole, and the document a source is serving then is taken in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import saved, shuffles

WORD = r"[^\x20\x09-\x0D]+"
_INNER = ("__key", "__hash", "__bin", "__words", "__base")


def targets(sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2) -> DataFrame:
    """Adds ``target`` to rows (key, source_size): ``share`` of all sizes by weight, none above ``most`` times its size.

    Weights repeat over the sources in the order of key. The excess of full sources goes to the others by weight until none
    is above: with sources by rising most * size / weight, a source is full where the level at which the rest would stand
    reaches its own ratio, and all after the first that isn't full stand at that level. One row per source, so that one
    task orders them.
    """
    whole = Window.orderBy("key")
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(whole) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", "key")
    ranked = ranked.withColumn("place", F.row_number().over(by)).withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * float(share))
    full = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = ranked.withColumn("level", (F.col("budget") - full) / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("open", F.col("level") < F.col("ratio"))
    level = F.min(F.when(F.col("open"), F.struct("place", "level"))).over(Window.partitionBy())
    return ranked.withColumn("target", F.when(F.col("open"), F.col("weight") * level["level"]).otherwise(F.col("cap"))).select("key", "source_size", "target")


def plan(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", digits: int = 3) -> DataFrame:
    """docs with size, source_size, target, before (words of its source ahead of it in one round) and taken.

    size: words of the text (null, empty or blank: 0, never taken). taken: words the mix takes of the row, repeats
    counted, at most ``most`` times its size. Sources in code point order, null last as a source of its own. Running sums
    are dealt out by source and the first ``digits`` hex digits of the hash, so that no task holds a whole source. Repeated
    rows follow each other in the order and share an outcome between them; an empty table gives an empty one. Columns of
    docs that have the names of added ones, or of those used within, are replaced.
    """
    added = {"size", "source_size", "target", "before", "taken", *_INNER}
    docs = docs.select(*[c for c in docs.columns if c not in added])
    sized = docs.withColumns({
        "size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"),
        "__key": F.coalesce(F.concat(F.lit("1"), F.col(source_col)), F.lit("2")),
        "__hash": F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")),
    }).withColumn("__bin", F.substring("__hash", 1, digits))
    bins = saved(sized.groupBy("__key", "__bin").agg(F.sum("size").alias("__words")))
    aim = targets(bins.groupBy(F.col("__key").alias("key")).agg(F.sum("__words").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("__key").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    base = bins.withColumn("__base", F.coalesce(F.sum("__words").over(earlier), F.lit(0))).join(aim, F.col("__key") == F.col("key")).drop("key", "__words")
    within = Window.partitionBy("__key", "__bin").orderBy("__hash", id_col, "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("__base") + F.coalesce(F.sum("size").over(within), F.lit(0))
    out = sized.join(base, ["__key", "__bin"]).withColumn("before", ahead)
    out = out.withColumn("taken", sum((_served(p) for p in range(1, most)), _served(0)))
    return out.drop(*_INNER)


def _served(round_no: int):
    """Words taken of a row in one round of its source: what lies ahead of virtual time 1, where target words are served."""
    left = F.floor("target") - F.col("source_size") * round_no - F.col("before")
    return F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of docs in the global order of virtual finish time, a row once for each round that takes it.

    A document in service when the budget ends stays whole where at least half of it was served, and goes otherwise. See
    ``plan`` for nulls and repeats. All columns of docs are kept as they are.
    """
    whole = docs.select(F.struct(*docs.columns).alias("__row"), *dict.fromkeys([id_col, text_col, source_col]))
    planned = plan(whole, weights, share, most, id_col, text_col, source_col)
    rounds = F.explode(F.array(*[F.struct(F.lit(p).alias("round"), _served(p).alias("served")) for p in range(most)]))
    rows = planned.withColumn("__round", rounds).where("__round.served > 0 and 2 * __round.served >= size")
    finish = (F.col("__round.round") * F.col("source_size") + F.col("before") + F.col("size")) / F.col("target")
    ordered = rows.withColumn("__finish", finish).repartitionByRange(shuffles(docs.sparkSession), "__finish", id_col).sortWithinPartitions("__finish", id_col)
    return ordered.select("__row.*")


#: DuckDB's form of the plan over the documents table.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce('1' || source, '2') AS k, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
sources AS (SELECT k, sum(size)::BIGINT AS source_size FROM sized GROUP BY k),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
  source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM sources),
levels AS (SELECT *, cap / w AS ratio,
  (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER (ORDER BY cap / w, k) AS place FROM weighed),
first_open AS (SELECT min_by(level, place) AS level FROM levels WHERE level < ratio),
aims AS (SELECT k, source_size, CASE WHEN l.level < ratio THEN w * f.level ELSE cap END AS target FROM levels l, first_open f),
queued AS (SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY k ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized JOIN aims USING (k))
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, floor(target)::BIGINT - ahead)) + greatest(0, least(size, floor(target)::BIGINT - source_size - ahead)))::BIGINT AS taken
FROM queued
"""
