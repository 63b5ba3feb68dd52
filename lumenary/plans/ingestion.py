"""Sources and chunking over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking
from ..sources import adapters as A
from ..sources import sinks
from .registry import query, table


@query(r"SELECT page_id, CASE lower(regexp_extract(url, '\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'pdf' THEN 'pdf' WHEN 'md' THEN 'markdown' ELSE 'text' END AS format FROM pages")
def src1_format_dispatch(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", A.format_of(F.col("url")).alias("format"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), f AS (SELECT *, trim(x) <> '' AS f FROM l), s AS (SELECT *, sum(CAST(f AND NOT coalesce(p, false) AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, lag(f) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM f))
SELECT doc_id, CAST(g - 1 AS INT) AS ordinal, CAST(min(i) AS INT) AS line_start, CAST(max(i) AS INT) AS line_end, string_agg(x, chr(10) ORDER BY i) AS text FROM s WHERE f GROUP BY doc_id, g""")
def src2_paragraphs(spark, sf_dir):
    return A.paragraphs(table(spark, sf_dir, "documents"), "doc_id")


@query()
def src4_html_blocks(spark, sf_dir):
    return A.blocks(table(spark, sf_dir, "pages"), "page_id", "html", A.html_blocks)


@query()
def src3_markdown_blocks(spark, sf_dir):
    return A.blocks(table(spark, sf_dir, "documents"), "doc_id", "text", A.markdown_blocks)


def _pages(spark, sf_dir):
    """Documents of a source as pages of one document."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_index"), "text")


@query("""WITH p AS (SELECT source AS document_id, doc_id AS page_index, text FROM documents WHERE lang = 'en' UNION ALL SELECT source, doc_id, text FROM documents WHERE lang <> 'en' AND trim(text) <> '')
SELECT document_id, page_index, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_index, text) - 1 AS INT) AS ordinal FROM p""")
def src10_missing_pages(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    parsed = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_index"), "text")
    return A.missing_pages(pages, parsed).select("document_id", "page_index", "ordinal")


@query(r"""WITH l AS (SELECT source AS document_id, doc_id AS page_index, list_filter(list_transform(regexp_split_to_array(text, '[\r\n]+'), lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))), lambda x: x <> '') AS ls FROM documents),
m AS (SELECT document_id, page_index, unnest(list_distinct(list_concat(ls[1:2], ls[greatest(1, len(ls) - 1):len(ls)]))) AS line FROM l)
SELECT document_id, line, count(DISTINCT page_index) AS n_pages FROM m WHERE length(line) >= 20 GROUP BY 1, 2 HAVING count(DISTINCT page_index) >= 2""")
def src11_repeated_margins(spark, sf_dir):
    return A.repeated_margins(_pages(spark, sf_dir))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def src16_copy_missing(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    have = e.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return sinks.copy_missing(e, have, ["vec_id"])


@query()
def c1_semantic_chunks(spark, sf_dir):
    return chunking.chunks(table(spark, sf_dir, "documents"))


@query(r"""SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents WHERE length(text) > 0 GROUP BY 1""")
def c4_parents(spark, sf_dir):
    """Parents and children of all documents; parents tile their text."""
    f = chunking.families(table(spark, sf_dir, "documents"))
    return f.where("child = -1").groupBy("doc_id").agg(F.sum(F.col("end") - F.col("begin")).alias("n_chars"))


@query("""SELECT conv_id AS session_id, turn AS attachment_id, replace(text, chr(0), '') AS text, CAST(greatest(1, length(replace(text, chr(0), '')) // 4) AS BIGINT) AS token_estimate FROM conversations WHERE role = 'user' AND trim(replace(text, chr(0), '')) <> ''""")
def src19_session_attachments(spark, sf_dir):
    """Users' turns as texts attached to their session, with a sign between that no text may have."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("attachment_id"), F.concat(F.lit("\u0000"), "text").alias("text"))
    return A.attachments(c).select("session_id", "attachment_id", "text", "token_estimate")
