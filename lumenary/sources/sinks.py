"""Sinks: partitioned writes, verified copies and artifact bundles."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_index(df: DataFrame, path: str, by: tuple[str, ...] = ("document_id", "parse_version")) -> None:
    """Replace the partitions that ``df`` has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def copy_missing(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``source`` that ``target`` lacks. A row of the target that the source doesn't have alike is an error."""
    columns = source.columns
    if not target.select(*columns).exceptAll(source).isEmpty():
        raise ValueError("the target has rows that differ from the source")
    return source.join(target.select(*keys), keys, "left_anti").select(*columns)


def verify_copy(source: DataFrame, target: DataFrame) -> bool:
    return source.exceptAll(target.select(*source.columns)).isEmpty() and target.select(*source.columns).exceptAll(source).isEmpty()


#: The name of the pointer to a bundle's version, and of the folder of its versions.
POINTER, VERSIONS = "CURRENT", "versions"


def _files(spark: SparkSession, path: str):
    """Hadoop's file context of a path, and what makes paths."""
    fs = spark._jvm.org.apache.hadoop.fs
    uri = fs.Path(path).toUri()
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return (fs.FileContext.getFileContext(uri, conf) if uri.getScheme() else fs.FileContext.getFileContext(conf)), fs.Path


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Let the bundle's pointer name a version: a new pointer is written aside and renamed over the old one, in one step."""
    files, place = _files(spark, path)
    jvm = spark._jvm
    options = jvm.org.apache.hadoop.fs.Options
    aside = f"{path}/{POINTER}-{uuid.uuid4().hex}"
    fs = place(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = fs.create(place(aside), False)
    out.write(version.encode())
    out.close()
    how = spark.sparkContext._gateway.new_array(options.Rename, 1)
    how[0] = options.Rename.OVERWRITE
    files.rename(place(aside), place(f"{path}/{POINTER}"), how)


def current(spark: SparkSession, path: str) -> str:
    """The folder of the version that a bundle's pointer names."""
    lines = spark.read.text(f"{path}/{POINTER}").collect()  # one short line
    return f"{path}/{VERSIONS}/{lines[0].value}"


def write_bundle(df: DataFrame, path: str, keep: int = 2) -> DataFrame:
    """Write ``df`` as a new version of a bundle: data, and a manifest with the rows and a content hash of each file. Then the
    bundle's pointer is replaced by one that names the version. Returns the manifest.

    A reader sees the old version or the whole new one at any time, and a job that fails before the pointer is replaced
    leaves the old one in place. Of older versions the last ones stay, ``keep`` with the new one, for readers that have
    begun; the others, and what failed jobs left, go.
    """
    spark = df.sparkSession
    try:
        before = current(spark, path).rpartition("/")[2]
    except AnalysisException:  # there is no pointer yet
        before = ""
    version = f"{max(int(before.partition('-')[0] or 0), 0) + 1:08d}-{uuid.uuid4().hex}"
    place = f"{path}/{VERSIONS}/{version}"
    df.write.parquet(f"{place}/data")
    hashes(spark, place).coalesce(1).write.json(f"{place}/manifest")
    _point(spark, path, version)
    _, folder = _files(spark, path)
    fs = folder(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder(f"{path}/{VERSIONS}")))
    for name in names[: max(0, len(names) - max(1, keep))]:
        if name != version:
            fs.delete(folder(f"{path}/{VERSIONS}/{name}"), True)
    return spark.read.schema(MANIFEST).json(f"{place}/manifest")


MANIFEST = "file string, rows long, content string"


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """file, rows and content of each data file: the content's hash is a sum over rows, whatever their order."""
    d = spark.read.parquet(f"{path}/data")
    return d.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*d.columns).cast("decimal(38,0)")).cast("string").alias("content"))


def load_bundle(spark: SparkSession, path: str) -> DataFrame:
    """The data of the bundle's current version, after each of its files was held against the manifest."""
    place = current(spark, path)
    want, got = spark.read.schema(MANIFEST).json(f"{place}/manifest"), hashes(spark, place)
    if not want.exceptAll(got.select(want.columns)).isEmpty() or not got.select(want.columns).exceptAll(want).isEmpty():
        raise ValueError("the bundle doesn't fit its manifest")
    return spark.read.parquet(f"{place}/data")
