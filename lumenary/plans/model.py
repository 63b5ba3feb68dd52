"""The engine's tables as views of the driver's: documents cut into chunks, turns, runs and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    active = F.when(F.col("lang") == "en", "v2").when(F.col("lang") == "fr", "legacy").when(F.col("lang") == "es", "v1")
    return d.select(F.col("doc_id").alias("document_id"), F.col("source").alias("project_id"), "text", "n_chars", "lang", active.alias("active_parse_version"), F.when(F.col("n_chars") < 20, "failed").otherwise("ready").alias("status"))


def chunks(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """A chunk a line; of the documents of ``only`` (document_id), if given."""
    d = documents(spark, sf_dir)
    d = d if only is None else d.join(only, "document_id", "left_semi")
    x = d.select("document_id", "project_id", "n_chars", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    version = F.when(F.col("n_chars") < 600, None).when(F.col("n_chars") < 1200, "legacy").when(F.col("n_chars") < 2400, "v1").otherwise("v2")
    role = F.when(F.col("ordinal") == 0, "parent").when(F.col("ordinal") != 2, "child")
    block = F.when(F.col("text").contains("Licen"), "reference").when(F.length("text") >= 8, "narrative")
    return x.select("document_id", "project_id", "ordinal", "text", F.concat_ws(":", "document_id", "ordinal").alias("chunk_id"), version.alias("parse_version"), role.alias("chunk_role"), block.alias("block_type"))


DOCUMENTS_SQL = """d AS (SELECT doc_id AS document_id, source AS project_id, text, n_chars, lang, CASE lang WHEN 'en' THEN 'v2' WHEN 'fr' THEN 'legacy' WHEN 'es' THEN 'v1' END AS active_parse_version, CASE WHEN n_chars < 20 THEN 'failed' ELSE 'ready' END AS status FROM documents)"""
CHUNKS_SQL = DOCUMENTS_SQL + """,
x AS (SELECT document_id, project_id, n_chars, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS ordinal FROM d),
chunks AS (SELECT document_id, project_id, CAST(ordinal AS INT) AS ordinal, text, document_id || ':' || ordinal AS chunk_id,
  CASE WHEN n_chars < 600 THEN NULL WHEN n_chars < 1200 THEN 'legacy' WHEN n_chars < 2400 THEN 'v1' ELSE 'v2' END AS parse_version,
  CASE WHEN ordinal = 0 THEN 'parent' WHEN ordinal <> 2 THEN 'child' END AS chunk_role,
  CASE WHEN contains(text, 'Licen') THEN 'reference' WHEN length(text) >= 8 THEN 'narrative' END AS block_type FROM x)"""
ACTIVE_SQL = """((d.active_parse_version IS NOT NULL AND d.active_parse_version <> 'legacy' AND c.parse_version = d.active_parse_version AND c.chunk_role = 'child' AND c.block_type IS NOT NULL AND c.block_type <> 'reference')
 OR ((d.active_parse_version IS NULL OR d.active_parse_version = 'legacy') AND (c.parse_version IS NULL OR c.parse_version = 'legacy') AND (c.chunk_role IS NULL OR c.chunk_role = 'child') AND (c.block_type IS NULL OR c.block_type <> 'reference')))"""
