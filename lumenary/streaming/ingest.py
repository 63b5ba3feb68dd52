"""Incremental ingestion as a stream of files with idempotent upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("document_id", "parse_version")


def _newest(df: DataFrame, keys: tuple[str, ...], order: list) -> DataFrame:
    """One row of each key, the first in ``order``; the hash of all columns decides what is left, never chance."""
    w = W.partitionBy(*keys).orderBy(*order, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: tuple[str, ...] = KEYS, order: str | None = None):
    """Start a query that adds each batch of new files to ``target`` as a folder of its own, named by the batch's number.

    Nothing that was written is changed: a batch that runs twice writes its folder again, and one that fails leaves a
    folder without a mark of success, which ``current`` passes over. Of rows of one key within a batch the one of highest
    ``order`` stays.
    """

    def add(batch: DataFrame, epoch: int) -> None:
        new = _newest(batch, keys, [F.desc(order)] if order else [])
        new.write.mode("overwrite").parquet(f"{target}/batch={epoch:012d}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batches(spark: SparkSession, target: str) -> list[str]:
    """The folders of complete batches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("batch=")]
    return sorted(p.toString() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, target: str, schema: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The rows that hold: of each key, that of the latest complete batch."""
    folders = _batches(spark, target)
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", target).parquet(*folders)
    return _newest(rows, keys, [F.desc("batch")]).drop("batch")


def compact(spark: SparkSession, target: str, schema: str, into: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Write what holds to another place as one batch, under the number of the latest, from which a stream can go on."""
    last = _batches(spark, target)[-1].rsplit("/", 1)[-1]
    current(spark, target, schema, keys).write.mode("overwrite").parquet(f"{into}/{last}")
    return current(spark, into, schema, keys)
