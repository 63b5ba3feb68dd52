"""Versioned scans, joins of chunks with documents and vectors, the vector index, and activation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import versions as O
from . import model as M
from .registry import query, table


@query(f"WITH {M.CHUNKS_SQL} SELECT c.document_id, c.ordinal, c.parse_version FROM chunks c JOIN d USING (document_id) WHERE {M.ACTIVE_SQL}")
def f1_active_children(spark, sf_dir):
    return O.select_children(M.chunks(spark, sf_dir), M.documents(spark, sf_dir)).select("document_id", "ordinal", "parse_version")


@query(f"""WITH {M.CHUNKS_SQL}, s AS (SELECT doc_id AS document_id, 'v1' AS version_key FROM labels WHERE toxic = 1)
SELECT c.document_id, c.ordinal, c.parse_version FROM chunks c JOIN d USING (document_id) LEFT JOIN s ON s.document_id = c.document_id
WHERE CASE WHEN s.version_key IS NOT NULL THEN coalesce(c.parse_version = s.version_key AND c.chunk_role = 'child' AND c.block_type <> 'reference', false) ELSE {M.ACTIVE_SQL} END""")
def f2_shadow_versions(spark, sf_dir):
    shadow = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"), F.lit("v1").alias("version_key"))
    return O.select_children(M.chunks(spark, sf_dir), M.documents(spark, sf_dir), shadow).select("document_id", "ordinal", "parse_version")


@query(f"WITH {M.DOCUMENTS_SQL} SELECT project_id, count(*) AS n FROM d WHERE status = 'ready' GROUP BY 1")
def f3_ready_scope(spark, sf_dir):
    return M.documents(spark, sf_dir).where("status = 'ready'").groupBy("project_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS document_id FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def f4_foreign_documents(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id")).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id")), "document_id", "left_anti")


@query(f"""WITH {M.CHUNKS_SQL} SELECT document_id, ordinal, length(text) > 0 AND trim(text) = text AS is_plain, contains(lower(text), 'references') OR contains(lower(text), 'licensed') AS in_references FROM chunks""")
def f8_narrative_scope(spark, sf_dir):
    t = F.col("text")
    return M.chunks(spark, sf_dir).select("document_id", "ordinal", ((F.length(t) > 0) & (F.trim(t) == t)).alias("is_plain"), (F.contains(F.lower(t), F.lit("references")) | F.contains(F.lower(t), F.lit("licensed"))).alias("in_references"))


@query("SELECT c.parse_version AS parse_version, e.label AS label, count(*) AS n FROM (WITH " + M.CHUNKS_SQL + " SELECT DISTINCT document_id, parse_version FROM chunks) c JOIN embeddings e ON e.vec_id = c.document_id GROUP BY 1, 2")
def j2_vectors_by_version(spark, sf_dir):
    d = M.documents(spark, sf_dir).select("document_id", F.when(F.col("n_chars") < 600, None).when(F.col("n_chars") < 1200, "legacy").when(F.col("n_chars") < 2400, "v1").otherwise("v2").alias("parse_version"))
    return d.join(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "document_id"), "document_id").groupBy("parse_version", "label").agg(F.count("*").alias("n"))


@query(f"""WITH {M.CHUNKS_SQL}, p AS (SELECT document_id, chunk_id FROM chunks WHERE chunk_role = 'parent')
SELECT c.document_id, c.ordinal, p.chunk_id AS parent_id, lag(c.chunk_id) OVER w AS previous_id, lead(c.chunk_id) OVER w AS next_id FROM chunks c LEFT JOIN p ON p.document_id = c.document_id WHERE c.chunk_role = 'child' WINDOW w AS (PARTITION BY c.document_id ORDER BY c.ordinal)""")
def j5_parents_and_neighbours(spark, sf_dir):
    c = M.chunks(spark, sf_dir)
    parents = c.where("chunk_role = 'parent'").select("document_id", F.col("chunk_id").alias("parent_id"))
    w = W.partitionBy("document_id").orderBy("ordinal")
    return c.where("chunk_role = 'child'").join(parents, "document_id", "left").select("document_id", "ordinal", "parent_id", F.lag("chunk_id").over(w).alias("previous_id"), F.lead("chunk_id").over(w).alias("next_id"))


@query("""SELECT e.vec_id, e.label, CASE WHEN l.doc_id IS NULL THEN 'kept' ELSE 'replaced' END AS state FROM embeddings e LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = e.vec_id""")
def src14_index_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where(V.valid(F.col("embedding"), 64))
    index = e.select("vec_id", "label", F.lit("kept").alias("state"))
    fresh = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id")).distinct()
    return O.upsert(index, e.join(fresh, "vec_id", "left_semi").select("vec_id", "label", F.lit("replaced").alias("state")), ["vec_id"])


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def src15_index_counts(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query(f"""WITH {M.CHUNKS_SQL}, k AS (SELECT document_id, 'v3' AS version_key, count(*) AS expected FROM chunks WHERE chunk_role = 'child' AND document_id IN (SELECT vec_id FROM embeddings) GROUP BY 1)
SELECT d.document_id, CASE WHEN k.version_key IS NOT NULL THEN 'v3' ELSE d.active_parse_version END AS active_parse_version, CASE WHEN k.version_key IS NOT NULL THEN d.active_parse_version END AS superseded_version FROM d LEFT JOIN k ON k.document_id = d.document_id""")
def c14_activation(spark, sf_dir):
    c = M.chunks(spark, sf_dir).where("chunk_role = 'child'").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id")), "document_id", "left_semi")
    n = F.count("*")
    return O.next_pointers(M.documents(spark, sf_dir), c.groupBy("document_id").agg(n.alias("expected"), n.alias("indexed"), n.alias("embedded")).withColumn("version_key", F.lit("v3")))


@query(f"WITH {M.CHUNKS_SQL} SELECT c.document_id, c.parse_version, count(*) AS n FROM chunks c JOIN d USING (document_id) WHERE c.parse_version IS NOT NULL AND d.active_parse_version IS NOT NULL AND c.parse_version <> d.active_parse_version GROUP BY 1, 2")
def c15_superseded_rows(spark, sf_dir):
    d = M.documents(spark, sf_dir).select("document_id", "active_parse_version")
    return M.chunks(spark, sf_dir).join(d, "document_id").where("parse_version <> active_parse_version").groupBy("document_id", "parse_version").agg(F.count("*").alias("n"))
