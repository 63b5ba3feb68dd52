"""A cleaning pipeline over the table documents: quality rules, line dedup, near-duplicate removal, surrogates, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.llm import line_dedup, ngram_join, packing, pii, quality_rules
from lumenary.llm.common import discard, written
from lumenary.llm.queries import PII_KEY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality_rules.judge(docs).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later occurrences of three-line windows."""
    return line_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of least id, of each group of near copies: five-word n-grams, similarity 0.8 or more.

    Where ids are unique integers without nulls, they are the rows' keys. Else each row gets a key of its own, written with
    it, so that rows without an id or with the same one are judged each by itself; rows without an id come last in a group.
    """
    docs = docs.select(*COLUMNS)
    ids = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("n_ids")).first()
    unique = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long") and ids.n == ids.n_ids and docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    keyed = docs.withColumn("_row", F.col("doc_id").cast("long")) if unique else written(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    groups = ngram_join.join(keyed, key="_row")
    if unique:
        stay = groups.where("_row = component_id").select("_row")
    else:
        order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "_row")
        stay = groups.join(keyed.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(order).alias("least")).select("least._row")
    return keyed.join(stay, "_row", "left_semi").select(*COLUMNS)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities replaced."""
    return pii.replace(docs, PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, with their sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("PII surrogates", surrogates), ("best-fit packing", packed)]

#: HMAC and tokens are beyond SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each stage's result written and read again, and deleted once the next one's is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"stage{i}")
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
