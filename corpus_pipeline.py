"""Corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. ``run`` applies them to the documents
table, each result written as Parquet to the shared checkpoint folder and read again, so that a lost executor costs no
earlier stage. Stages keep the columns of documents (other columns pass through); the last returns the shards.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.llm import decontaminate, langid, mixing, sharding, simhash
from rastermill.llm._spark import shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: null texts, texts without letters and those far from all languages go."""
    model = langid.fit(docs.where(~langid.held_out()))
    added = ("__lang_pred", "__score", "__rejected")
    return langid.predict(docs, model, added=added).where("not __rejected").drop(*added)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): that of the smallest doc_id, nulls last.

    Rows that share an id are told apart by their texts, and rows of one id and text by their other columns (but maps), so
    that a text unlike all others stays whatever its id, and reruns keep the same row.
    """
    kinds = dict(docs.dtypes)
    hashed = [c for c, kind in kinds.items() if "map<" not in kind and "variant" not in kind]
    no = F.coalesce("doc_id", F.lit("0").cast(kinds["doc_id"]))
    key = F.struct(F.col("doc_id").isNull().alias("none"), no.alias("no"), F.xxhash64("text").alias("text"), F.xxhash64(*hashed).alias("row"))
    rows = docs.withColumn("__key", key)
    kept = simhash.similar(rows, size=5, similarity=0.8, id_col="__key").where("__key = component_id").select("__key").distinct()
    return rows.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in their text.

    Null texts hold none and stay, as do repeated rows and rows without an id; an empty benchmark keeps all documents.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight, a document once for each time it is taken, in the order of virtual finish time.

    A null source is a source of its own; repeated rows are documents of their own; null and empty texts, which have no
    words, are never taken; an empty table gives an empty one.
    """
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix; rows of equal text, null ones too, share a shard, and repeated rows have slots of their own."""
    return sharding.assign(docs, shards=16)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("mixed", mixed), ("sharded", sharded)]

#: Clustered centroids, SimHash components and bin packing have no SQL form. tests/llm holds near-duplicates and
#: decontamination against brute force, the mix against its SQL, and the stages together against planted documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
