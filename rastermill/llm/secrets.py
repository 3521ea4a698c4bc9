"""Secret scans by a trigram inverted index, in DataFrame functions only.

Every rule is a regex. From it follows which trigrams a text must hold before it can match: a Boolean query in disjunctive
form, worked out once on the driver. The index has a posting (trigram, text) for each trigram of these queries that stands
in a text, lower-cased; intersecting postings clause by clause gives the candidates of a rule. Rules with an alternative
that needs no trigram scan all texts instead. Only candidates are verified by the regex itself, which also gives places.
"""

from __future__ import annotations

import re._constants as ops  # the tree of a parsed pattern
import re._parser as patterns
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import saved


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and non-overlapping, whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Kinds, patterns and lengths that the query's contract names.
BASE = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
]
#: Public formats of keys beside them (fixed values).
FORMATS = [
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
]

#: Ways through a pattern that are told apart; where there are more, only trigrams common to all are asked for.
WAYS = 64
#: Bytes of candidates up to which they are sent to all tasks; beyond, texts are shuffled to meet them.
SENT = 16 << 20


def _letters(item) -> set[str] | None:
    """The characters, lower-cased, that one item of a character class stands for; None: too many to follow."""
    op, value = item
    if op is ops.LITERAL:
        return {chr(value).lower()}
    if op is ops.RANGE and value[1] - value[0] < 8:
        return {chr(c).lower() for c in range(value[0], value[1] + 1)}
    return None


def _walk(tree, ways: set) -> set:
    """Ways (trigrams so far, known characters just before this place) after each part of the tree."""
    for op, value in tree:
        if op in (ops.LITERAL, ops.IN):
            sets = [_letters(i) for i in (value if op is ops.IN else [(op, value)])]
            letters = set().union(*sets) if all(sets) else None
            if letters is None or len(letters) > 8:
                ways = {(g, "") for g, _ in ways}
            else:
                ways = {(g | {t + c} if len(t) == 2 else g, (t + c)[-2:]) for g, t in ways for c in letters}
        elif op is ops.BRANCH:
            ways = set().union(*[_walk(b, ways) for b in value[1]])
        elif op is ops.SUBPATTERN:
            ways = _walk(value[3], ways)
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
            low, high, part = value
            for _ in range(min(low, 3)):
                ways = _walk(part, ways)
            if low == 0 and high == 1:
                ways = ways | _walk(part, ways)
            elif high != low or low > 3:
                ways = {(g, "") for g, _ in ways}
        elif op is not ops.AT:
            ways = {(g, "") for g, _ in ways}
        if len(ways) > WAYS:
            ways = {(frozenset.intersection(*[frozenset(g) for g, _ in ways]), "")}
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of trigrams, of one of which a lower-cased text holds all if it matches; None: it may match without any."""
    found = {frozenset(g) for g, _ in _walk(patterns.parse(pattern), {(frozenset(), "")})}
    return None if frozenset() in found else sorted((c for c in found if not any(o < c for o in found)), key=sorted)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, text, a, b): a and b are a 128-bit name of id and text, so that rows equal in both have one outcome."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumns({"a": F.xxhash64("id", "text"), "b": F.xxhash64(F.lit(1), "text", "id")})


def index(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """Rows (id, a, b, grams, scanned), one for each row of docs, and the trigrams that ``grams`` numbers.

    grams: those of the rules' queries that stand in the text; scanned: numbers of the rules without a query that match.
    """
    asked = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted({g for clauses in asked.values() for c in clauses or [] for g in c})
    numbered = F.lit(0) if not grams else F.array(*[F.lit(g) for g in grams])
    # the lower-cased text is bound once, and not made again for each trigram
    held = F.transform(F.array(F.lower("text")), lambda low: F.array_compact(F.transform(numbered, lambda g, i: F.when(F.contains(low, g), i))))
    none = F.array().cast("array<int>")
    scanned = F.array_compact(F.array(*[F.when(F.col("text").rlike(_scanned(r)), F.lit(i)) for i, r in enumerate(rules) if asked[r.kind] is None], F.lit(None).cast("int")))
    return _keyed(docs, id_col, text_col).select("id", "a", "b", (F.get(held, F.lit(0)) if grams else none).alias("grams"), scanned.alias("scanned")), grams


def _scanned(rule: Rule) -> str:
    """The rule's pattern; a class repeated at the end is asked for its least length at once, which all other texts fail sooner."""
    simple = rule.group == 0 and rule.pattern.startswith("[") and rule.pattern.endswith("]+") and rule.pattern.count("[") == 1
    return f"{rule.pattern[:-1]}{{{rule.least},}}" if simple and rule.least else rule.pattern


def candidates(indexed: DataFrame, grams: list[str], rules: list[Rule]) -> DataFrame:
    """Rows (a, b, rules): texts whose postings meet a clause of a rule, or that a full scan has found, with the rules' numbers."""
    terms = [(grams.index(g), i, n, 1 << at, (1 << len(c)) - 1) for i, r in enumerate(rules) for n, c in enumerate(trigram_query(r.pattern) or []) for at, g in enumerate(sorted(c))]
    clauses = indexed.sparkSession.createDataFrame(terms, "gram int, rule int, clause int, bit long, whole long")  # as many rows as the rules have trigrams
    postings = indexed.select("a", "b", F.explode("grams").alias("gram"))
    met = postings.join(F.broadcast(clauses), "gram").groupBy("rule", "clause", "a", "b").agg(F.bit_or("bit").alias("bits"), F.max("whole").alias("whole"))
    found = met.where("bits = whole").select("a", "b", "rule").unionByName(indexed.select("a", "b", F.explode("scanned").alias("rule")))
    return found.groupBy("a", "b").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def _met(rows: DataFrame, found: DataFrame, how: str, row_bytes: int) -> DataFrame:
    """Joined on the texts' names; found is sent to all tasks where it is small."""
    return rows.join(F.broadcast(found) if found.count() * row_bytes <= SENT else found, ["a", "b"], how)


def _places(rule: Rule, number: int) -> Column:
    """For each match in text: rule, characters since the match before, the match's own, and whether it counts."""
    pattern = F.lit(_scanned(rule))
    match = F.regexp_extract_all("text", pattern, F.lit(0))
    tested = match if not rule.group else F.regexp_extract_all("text", pattern, F.lit(rule.group))
    made = F.transform(F.arrays_zip(F.slice(F.split("text", _scanned(rule), -1), 1, F.size(match)).alias("before"), match.alias("match"), tested.alias("tested")),
                       lambda m: F.struct(F.lit(number).alias("rule"), F.char_length(m["before"]).alias("gap"), F.char_length(m["match"]).alias("long"), (F.char_length(m["tested"]) >= rule.least).alias("counts")))
    return F.when(F.array_contains("rules", number), made).otherwise(F.array().cast("array<struct<rule:int,gap:int,long:int,counts:boolean>>"))


def scan(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, spans), one for each row of docs; spans: array of (start, rule, end), in that order, in code points.

    rule is the number in ``rules`` (by default BASE and FORMATS). A null text is empty; null and repeated ids and repeated
    rows stay as they are, each with its own text's spans; an empty table gives an empty one; other columns are ignored.
    Places are running sums over a text's own matches, so that texts with many of them cost no more than linear work.
    """
    rules = BASE + FORMATS if rules is None else rules
    indexed, grams = index(docs, rules, id_col, text_col)
    indexed = saved(indexed)
    found = saved(candidates(indexed, grams, rules))
    texts = _met(_keyed(docs, id_col, text_col).select("a", "b", "text"), found, "inner", 48)
    matches = texts.select("a", "b", F.flatten(F.array(*[_places(r, i) for i, r in enumerate(rules)])).alias("matches")).where(F.size("matches") > 0).dropDuplicates(["a", "b"])
    each = matches.select("a", "b", F.posexplode("matches").alias("at", "m")).select("a", "b", "at", "m.*")
    before = Window.partitionBy("a", "b", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.col("long")).over(before), F.lit(0)) + F.col("gap")
    spans = each.withColumn("start", start).where("counts").groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("start", "rule", (F.col("start") + F.col("long")).alias("end")))).alias("spans"))
    out = _met(indexed.select("id", "a", "b"), saved(spans), "left", 160)
    return out.select(F.col("id").alias(id_col), F.coalesce("spans", F.array().cast("array<struct<start:bigint,rule:int,end:bigint>>")).alias("spans"))


def digest(found: DataFrame, rules: list[Rule] | None = None, base: int = len(BASE), id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, n_<kind> for the first ``base`` rules, base_sha256, spans as text) of ``scan``'s."""
    rules = BASE + FORMATS if rules is None else rules
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"], s["end"])), ",")
    numbers = F.transform("spans", lambda s: s["rule"])
    counts = [(F.size("spans") - F.size(F.array_remove(numbers, i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(rules[:base])]
    own = F.filter("spans", lambda s: s["rule"] < base)
    return found.select(id_col, *counts, F.sha2(text(own).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def _sql() -> str:
    """DuckDB's form: pieces between matches and the matches themselves, whose lengths sum up to places."""
    rules, parts = BASE + FORMATS, []
    either = lambda p: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in p)
    for i, r in enumerate(rules):
        pattern = r.pattern.replace("'", "''")
        if pattern.startswith("(?i)"):
            key, rest = pattern[4:].split(")", 1)
            pattern = f"{either(key)}){rest}"
        parts.append(f"""SELECT rid, {i} AS rule, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(text, '{pattern}') AS gaps,
  regexp_extract_all(text, '{pattern}') AS found, regexp_extract_all(text, '{pattern}', {r.group}) AS tested FROM docs""")
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(parts)}),
hits AS (SELECT rid, rule, kind, least, unnest(found) AS f, unnest(tested) AS t, unnest(gaps[:len(found)]) AS g, generate_subscripts(found, 1) AS place FROM m WHERE len(found) > 0),
p AS (SELECT *, sum(length(g) + length(f)) OVER (PARTITION BY rid, rule ORDER BY place) - length(f) AS s FROM hits),
k AS (SELECT rid, rule, kind, s::BIGINT AS s, (s + length(f))::BIGINT AS z FROM p WHERE length(t) >= least),
a AS (SELECT rid, count(*) FILTER (WHERE rule = 0) AS n_assign, count(*) FILTER (WHERE rule = 1) AS n_access, count(*) FILTER (WHERE rule = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || z, ',' ORDER BY s, rule) FILTER (WHERE rule < {len(BASE)}) AS base, string_agg(kind || ':' || s || ':' || z, ',' ORDER BY s, rule) AS spans FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN a USING (rid)"""


ORACLE_SQL = _sql()
