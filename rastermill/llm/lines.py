"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling, in DataFrame functions only.

Lines get 128-bit names. Prefix doubling names each position's prefix of 2, 4, ... lines by two names of half the length:
up to the shortest run that counts within a document's row, from there on by a join of each position with the one a prefix
further on. Positions of one name are an interval of the suffix array whose longest common prefix is at least that long;
positions that are alone in theirs are settled and go, so that a round carries on only what still repeats. In an interval
all positions but the first are later copies. Their prefixes, as far as doubling took them, overlap to the maximal repeated
runs, and these lines are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import saved

#: Columns that tell a position: document, text (where different texts share an id), line number.
PLACE = ("id", "no", "at")


def _name(*parts):
    """A 128-bit name, as two longs, of what lines or names stand in each part."""
    return F.struct(F.xxhash64(*[p["a"] for p in parts]).alias("a"), F.xxhash64(F.lit(1), *[p["b"] for p in parts]).alias("b"))


def prefix_names(rows: DataFrame, run: int) -> DataFrame:
    """Rows (id, no, names) of (id, no, lines): the names of the runs of ``run`` lines at each position, those that fit."""
    one = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    rows, length = rows.where(F.size("lines") >= run).select("id", "no", one.alias("names")), 1
    while length < run:
        step = min(length, run - length)
        fit = F.greatest(F.size("names") - step, F.lit(0))
        rows = rows.withColumn("names", F.zip_with(F.slice("names", F.lit(1), fit), F.slice("names", F.lit(1 + step), fit), lambda x, y: _name(x, y)))
        length += step
    return rows


def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left with the right's other columns, where both are at one place (null ids meet too)."""
    here = [left["id"].eqNullSafe(right["id"]), left["no"] == right["no"], left["at"] == right["at"]]
    return left.join(right, here).drop(*[right[c] for c in PLACE])


def repeated_runs(rows: DataFrame, run: int) -> DataFrame:
    """Rows (id, no, start, end): maximal runs of lines [start, end) that are later copies, from rows (id, no, lines).

    Each doubling writes the positions that repeat, and ends when none does: after as many rounds as the longest repeat
    has doublings.
    """
    level = saved(prefix_names(rows, run).select("id", "no", F.posexplode("names").alias("at", "name")).select(*PLACE, "name.a", "name.b"))
    place, length, prefixes = F.struct(*PLACE), run, []
    while True:
        # written, so that the join is a plain one of which Spark can split a frequent run's side
        interval = saved(level.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last"))
        met = level.join(interval, ["a", "b"]).withColumn("later", place > F.col("first"))
        if length == run:  # equal rows of one id have the same places
            met = met.groupBy(*PLACE).agg(F.min("a").alias("a"), F.min("b").alias("b"), F.max("later").alias("later"))
        shared = saved(met.select(*PLACE, "a", "b", "later"))
        if shared.isEmpty():
            break
        prefixes.append(shared.where("later").select(*PLACE, F.lit(length).alias("length")))
        ahead = shared.select("id", "no", (F.col("at") - length).alias("at"), F.struct("a", "b").alias("next")).where("at >= 0")
        level = saved(_meet(shared.select(*PLACE, F.struct("a", "b").alias("own")), ahead).select(*PLACE, _name(F.col("own"), F.col("next")).alias("name")).select(*PLACE, "name.*"))
        length *= 2
    if not prefixes:
        return rows.sparkSession.createDataFrame([], rows.select("id", "no", F.lit(0).alias("start"), F.lit(0).alias("end")).schema)
    found = prefixes[0]
    for more in prefixes[1:]:
        found = found.unionByName(more)
    longest = found.groupBy(*PLACE).agg(F.max("length").alias("length"))
    # prefixes that overlap or touch make one run
    by = Window.partitionBy("id", "no").orderBy("at")
    reach = F.max(F.col("at") + F.col("length")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    parts = longest.withColumn("new", F.coalesce((F.col("at") > reach).cast("int"), F.lit(1))).withColumn("part", F.sum("new").over(by))
    return parts.groupBy("id", "no", "part").agg(F.min("at").alias("start"), F.max(F.col("at") + F.col("length")).alias("end")).drop("part")


def deduplicate(docs: DataFrame, run: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_lines, n_removed, kept), one for each row of docs.

    Lines are the parts of a text between newlines, compared as they are. A line is removed where it is in a run of
    ``run`` lines or more that starts earlier too: in a document of smaller id, or in the same document further up. kept:
    the other lines, joined by newlines (null where none is left). A null text has no line and nothing is kept. Repeated
    ids are taken as one document: the copies of one text have one outcome, and different texts under one id stand side by
    side, ordered by a hash of the text. Null ids come before all others. Empty tables give empty tables; other columns
    are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("no", F.xxhash64("text"))
    found = repeated_runs(rows.where("text is not null").select("id", "no", F.split("text", "\n", -1).alias("lines")), run)
    gone = found.groupBy("id", "no").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))
    gone = gone.select(F.col("id").alias("__id"), F.col("no").alias("__no"), "runs")
    split = rows.join(gone, F.col("id").eqNullSafe(F.col("__id")) & (F.col("no") == F.col("__no")), "left").withColumn("lines", F.split("text", "\n", -1))
    # the lines before, between and after the runs stay
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("runs")), lambda i: F.slice(
        "lines", F.coalesce(F.get("runs", i - 1)["end"], F.lit(0)) + 1,
        F.coalesce(F.get("runs", i)["start"], F.size("lines")) - F.coalesce(F.get("runs", i - 1)["end"], F.lit(0)))))
    left = F.when(F.col("text").isNull(), F.array().cast("array<string>")).when(F.col("runs").isNull(), F.col("lines")).otherwise(kept)
    out = split.withColumn("kept_lines", left).withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")))
    return out.select(F.col("id").alias(id_col), F.col("n_lines").cast("long"), (F.col("n_lines") - F.size("kept_lines")).cast("long").alias("n_removed"),
                      F.when(F.size("kept_lines") > 0, F.array_join("kept_lines", "\n")).alias("kept"))


#: DuckDB's form over the documents table, for runs of two lines.
ORACLE_SQL = r"""
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
one AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM lines),
two AS (SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM one),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, pos) > 1 AS later FROM two WHERE next IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, pos FROM ranked WHERE later UNION ALL SELECT doc_id, pos + 1 FROM ranked WHERE later)),
kept AS (SELECT one.doc_id, string_agg(line, chr(10) ORDER BY one.pos) AS kept, count(*) AS n
  FROM one LEFT JOIN gone ON one.doc_id = gone.doc_id AND one.pos = gone.pos WHERE gone.pos IS NULL GROUP BY one.doc_id)
SELECT l.doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(len(ls), 0) - coalesce(n, 0) AS n_removed, md5(kept) AS kept_md5
FROM lines l LEFT JOIN kept USING (doc_id)
"""
