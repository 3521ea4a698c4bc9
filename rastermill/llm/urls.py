"""URL filters: explicit rules, and for other urls a path-template tree per host with smoothed labelled purity.

The tree grows level by level over path segments. Under each node, segments that are too many and too rare to be branches
are generalised to a wildcard (its file extension kept); branches whose share of bad labels does not differ
significantly from their siblings' are merged. A url is rejected where its template's share of good labels, smoothed
towards its host's and that towards the whole table's, falls below a threshold. How many labels the smoothing is worth is
fitted to how much templates differ beyond chance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import saved

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url):
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null and where there is no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _SMALL)


def path(url):
    """After the host up to ? # or the end; empty for null and where there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def templates(urls: DataFrame, children: int = 16, share: float = 0.1, depth: int = 6, z: float = 1.96) -> DataFrame:
    """Rows (host, path, template) of distinct urls (host, path, n, good, bad).

    A node's segments become wildcards where it has more than ``children`` of them, but for those with at least ``share``
    of its rows. Segments past ``depth`` are one wildcard. z: smallest difference of a branch's bad share from its
    siblings', in standard errors, that keeps the branch apart. Counts of a node are sums of partial sums, so a host with
    any share of the rows is dealt out over tasks.
    """
    tree = urls.withColumn("segments", F.slice(F.split(F.regexp_replace("path", "^/", ""), "/"), 1, depth + 1))
    tree = saved(tree.withColumn("template", F.lit("")))
    levels = min(depth, tree.agg(F.max(F.size("segments"))).first()[0] or 0)
    for level in range(levels):
        at = tree.withColumn("segment", F.get("segments", F.lit(level)))
        branch = at.where("segment is not null").groupBy("host", "template", "segment").agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")])
        # written, so that the join with it is a plain one of which Spark can split a large host's side
        node = saved(branch.groupBy("host", "template").agg(F.count("*").alias("k"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "good", "bad")]))
        extension = F.regexp_extract("segment", r"\.[A-Za-z]{1,5}$", 0)
        met = branch.join(node, ["host", "template"])
        own, rest = F.col("good") + F.col("bad"), F.col("all_good") + F.col("all_bad") - F.col("good") - F.col("bad")
        pooled = F.col("all_bad") / (own + rest)
        gap = F.abs(F.col("bad") / own - (F.col("all_bad") - F.col("bad")) / rest)
        apart = F.coalesce((own > 0) & (rest > 0) & (gap > z * F.sqrt(pooled * (1 - pooled) * (1 / own + 1 / rest))), F.lit(False))
        name = F.when((F.col("k") > children) & (F.col("n") < share * F.col("all_n")), F.concat(F.lit("*"), extension)).when(F.col("k") == 1, F.col("segment")).when(apart, F.col("segment")).otherwise(F.lit("~"))
        named = met.select("host", "template", "segment", name.alias("name"))
        tree = at.join(named, ["host", "template", "segment"], "left").withColumn("template", F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name"))).drop("segment", "name")
        tree = saved(tree)
    return tree.select("host", "path", F.when(F.size("segments") > depth, F.concat("template", F.lit("/**"))).otherwise(F.col("template")).alias("template"), "n", "good", "bad")


def ruled(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rows (host, path, rule, ruled) of the distinct urls (host, path) that a rule fits, with the longest that does."""
    spark = urls.sparkSession
    table = spark.createDataFrame([(h, h, p, v) for h, p, v in rules], "end string, rule_host string, rule_path string, ruled string")
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = urls.select("host", "path", F.explode(ends).alias("end")).join(table, "end").where(F.col("path").startswith(F.col("rule_path")))
    order = F.struct((-F.length("rule_host") - F.length("rule_path")).alias("n"), "rule_host", "rule_path", "ruled")
    best = met.groupBy("host", "path").agg(F.min_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "ruled"), order).alias("best"))
    return best.select("host", "path", "best.*")


def worth(parts: DataFrame, least: float = 1.0, most: float = 10.0) -> float:
    """Labels' worth of a prior for the share of good ones of parts (n, good, of_n, of_good: the part's and its whole's).

    By the moments of the beta-binomial: with labels that agree within parts by a correlation r beyond chance, 1 / r - 1.
    Held between ``least`` and ``most``; ``most`` where parts differ by no more than chance.
    """
    share = F.col("of_good") / F.col("of_n")
    sums = parts.where("n > 0").agg(
        F.sum(F.col("n") * (F.col("good") / F.col("n") - share) ** 2).alias("spread"), F.sum(F.col("n") * share * (1 - share)).alias("chance"), F.sum("n").alias("n"),
        F.sum(1 - F.col("n") / F.col("of_n")).alias("free"), F.sum(F.col("n") - F.col("n") ** 2 / F.col("of_n")).alias("size")).first()
    if not sums.n or not sums.chance or sums.free < 1e-9 or sums.size <= sums.free:
        return most
    r = (sums.spread / sums.free / (sums.chance / sums.n) - 1) / (sums.size / sums.free - 1)
    return min(most, max(least, 1 / r - 1)) if r > 0 else most


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", purity: float = 0.5, **options) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, template, purity), one for each row of pages.

    rules: (host, path, allow or block), any number; one fits its host and all subdomains if the url's path starts with
    its own, and the longest (host and path) wins. labels: (label_id, quality, toxic); good is quality not 0 and toxic not
    1; nulls count as no label. Urls without a rule are blocked where the smoothed purity of their template is below
    ``purity``; the prior is worth 1 to 10 labels, as ``worth`` finds, so that ten bad labels and no good one block a
    template whatever its host. Null urls, and those without ://, have empty host and path and are judged as such.
    Repeated rows stay; no labels at all: all allowed.
    """
    rows = pages.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    known = labels.select(F.col(label_id).alias("id"), bad.alias("is_bad")).where("is_bad is not null").groupBy("id").agg(F.max("is_bad").alias("is_bad"))
    seen = rows.join(known, "id", "left").groupBy("host", "path").agg(F.count("*").alias("n"), F.count_if(F.col("is_bad") == 0).alias("good"), F.count_if(F.col("is_bad") == 1).alias("bad"))
    tree = saved(templates(seen, **options))
    found = saved(tree.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum(F.col("good") + F.col("bad")).alias("n")))
    by_host = saved(found.groupBy("host").agg(F.sum("good").alias("of_good"), F.sum("n").alias("of_n")))
    totals = by_host.agg(F.coalesce(F.sum("of_good"), F.lit(0)).alias("good"), F.coalesce(F.sum("of_n"), F.lit(0)).alias("n")).first()
    prior = totals.good / totals.n if totals.n else 1.0
    both = found.join(by_host, "host")
    weight = worth(both)
    hosts = by_host.select(F.col("of_n").alias("n"), F.col("of_good").alias("good"))
    host_weight = worth(hosts.withColumns({"of_n": F.lit(totals.n), "of_good": F.lit(totals.good)})) if totals.n else weight
    host_pure = (F.col("of_good") + host_weight * prior) / (F.col("of_n") + host_weight)
    pure = both.select("host", "template", ((F.col("good") + weight * host_pure) / (F.col("n") + weight)).alias("purity"))
    verdicts = tree.select("host", "path", "template").join(pure, ["host", "template"])
    if rules:
        verdicts = verdicts.join(ruled(tree.select("host", "path"), rules), ["host", "path"], "left")
    else:
        verdicts = verdicts.withColumns({"rule": F.lit(None).cast("string"), "ruled": F.lit(None).cast("string")})
    verdict = F.coalesce("ruled", F.when(F.col("purity") < purity, "block").otherwise("allow"))
    return rows.join(verdicts, ["host", "path"]).select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
