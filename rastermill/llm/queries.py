"""The numbered queries over the corpus tables, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontaminate, html, langid, lines, merkle, mixing, neighbours, secrets, sharding, simhash, substrings, urls
from ._spark import table


#: (host, path, verdict), decided before the template tree.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the four folds that are not held out."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % of all words takes of every document; sources weigh 3, 1, 2, repeating."""
    return mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without later copies of passages of 20 words or more."""
    return substrings.deduplicate(table(spark, sf_dir, "documents"), span=20)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one within a fifth of its words, with the item."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page, by rules or by its path template; labels are those of the same id."""
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), RULES)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth id."""
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op8_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes; equal texts stay together."""
    return sharding.assign(table(spark, sf_dir, "documents"), shards=16)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (links at 4 or fewer differing bits)."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, radius=4)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without later copies of runs of two lines or more."""
    return lines.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.md5(F.col("kept").cast("binary")).alias("kept_md5"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, digest and places of secrets in every document."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and check against tampering of every document."""
    return merkle.verify(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of eight parts of every vector after six rounds, with errors and the codebooks' digest."""
    return codes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_main_text, op2_language_id, op3_weighted_fair_mix, op4_substring_dedup, op5_decontaminate, op6_url_filter, op7_nearest_neighbours, op8_bin_packing, op9_simhash_dedup, op10_line_dedup, op11_secret_scan, op12_merkle_manifest, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op3_weighted_fair_mix": mixing.ORACLE_SQL, "op10_line_dedup": lines.ORACLE_SQL, "op11_secret_scan": secrets.ORACLE_SQL, "op12_merkle_manifest": merkle.ORACLE_SQL, "op13_vector_codes": codes.ORACLE_SQL}
