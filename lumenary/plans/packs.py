"""Evidence packs of lines with their paragraphs as parents: finalising and fitting into a budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import packs as P
from ..sources.scratch import cut
from . import model as M
from .registry import query, table
from .retrieval import EVIDENCE_SQL, evidence, question_terms, routed_few
from .text import tokens_sql

#: Lines of a paragraph, and what questions ask for in turn.
LINES = 6
ASKED = ["", "Table 2: ", "Summarize ", "formula of ", "accuracy of "]


def families(spark, sf_dir, only=None):
    """Chunks: each line a child, six lines their parent; a line with a pipe is a row of its document's table. Of the documents
    of ``only`` (document_id), if given: parents and neighbours are of a line's own document."""
    c = M.chunks(spark, sf_dir, only).select("document_id", "ordinal", "text", "parse_version", "chunk_id")
    family = F.concat_ws(":p", "document_id", F.floor(F.col("ordinal") / LINES))
    at = lambda k: F.concat_ws(":", "document_id", F.col("ordinal") + k)
    table_id = F.when(F.contains("text", F.lit("|")), F.concat("document_id", F.lit("t")))
    block = F.when(table_id.isNotNull(), "table").when(F.contains("text", F.lit("Licen")), "reference").otherwise("narrative")
    within = F.col("ordinal") % LINES
    children = c.select(
        "chunk_id", "document_id", "parse_version", F.lit("child").alias("chunk_role"), block.alias("block_type"), family.alias("parent_chunk_id"), F.when(within > 0, at(-1)).alias("previous_chunk_id"),
        F.when(within < LINES - 1, at(1)).alias("next_chunk_id"), "text", table_id.alias("table_id"),
    )
    d = M.documents(spark, sf_dir)
    lines = (d if only is None else d.join(only, "document_id", "left_semi")).select("document_id", "n_chars", F.split("text", "\n").alias("_l"))
    parents = lines.select("document_id", "n_chars", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / LINES).cast("int")), lambda i: F.array_join(F.slice("_l", i * LINES + 1, LINES), "\n"))).alias("_i", "text"))
    version = F.when(F.col("n_chars") < 600, None).when(F.col("n_chars") < 1200, "legacy").when(F.col("n_chars") < 2400, "v1").otherwise("v2")
    parents = parents.select(F.concat_ws(":p", "document_id", "_i").alias("chunk_id"), "document_id", version.alias("parse_version"), F.lit("parent").alias("chunk_role"), F.lit("narrative").alias("block_type"), "text")
    return children.unionByName(parents, allowMissingColumns=True)


def questions(spark, sf_dir):
    """Questions of five kinds by turns, which name a syllable of the prose."""
    k = F.col("item_id")
    begin = F.element_at(F.array(*map(F.lit, ASKED)), (k % len(ASKED) + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select(k.alias("query_id"), F.concat(begin, F.lit("tion")).alias("question"))


def contexts(spark, sf_dir, few=None):
    """The lines that routed documents share with a question; long shared words are what a profile's term would prove."""
    e = evidence(spark, sf_dir, few).join(question_terms(spark, sf_dir), "query_id")
    anchors = F.filter(F.array_intersect("terms", T.tokens(F.col("text"))), lambda t: F.length(t) >= 9)
    kind = F.when(F.contains("text", F.lit("|")), "table").when(F.contains("text", F.lit("=")), "formula").when(F.size(anchors) > 0, "profile-term").otherwise("text")
    return e.select("query_id", F.concat_ws(":", "document_id", "ordinal").alias("chunk_id"), F.col("score").cast("double").alias("score"), kind.alias("kind"), F.concat_ws(":", "document_id", "page").alias("page"), F.lit(None).cast("string").alias("label"), anchors.alias("anchors"))


def staged(spark, sf_dir):
    few = routed_few(spark, sf_dir)
    only = few.select("document_id")
    chunks, asked = cut(families(spark, sf_dir, only)), questions(spark, sf_dir)
    found = P.checked(contexts(spark, sf_dir, few), chunks, M.documents(spark, sf_dir).join(only, "document_id", "left_semi"))
    return P.finalised(P.expanded(found, chunks, asked), asked), asked


_LIMIT = "CASE WHEN canonical THEN 24 ELSE 8 END"
_PIECE = r"CASE WHEN kind = 'table' THEN chunk_id ELSE substr(regexp_replace(trim(text), '\s+', ' ', 'g'), 1, 180) END"


@query(rf"""WITH {EVIDENCE_SQL},
c0 AS (SELECT ev.query_id, ev.document_id || ':' || ev.ordinal AS chunk_id, ev.document_id, CAST(ev.score AS DOUBLE) AS score, ev.text, ev.document_id || ':' || page AS page, chunks.parse_version,
  list_filter(list_intersect(qq.toks, {tokens_sql('ev.text')}), lambda t: length(t) >= 9) AS anchors, contains(ev.text, '|') AS pipe
  FROM ev JOIN qq USING (query_id) JOIN chunks ON chunks.document_id = ev.document_id AND chunks.ordinal = ev.ordinal JOIN d ON d.document_id = ev.document_id
  WHERE chunks.parse_version IS NULL OR chunks.parse_version = 'legacy' OR (chunks.parse_version = d.active_parse_version AND (contains(ev.text, '|') OR NOT contains(ev.text, 'Licen')))),
c1 AS (SELECT *, CASE WHEN pipe THEN 'table' WHEN contains(text, '=') THEN 'formula' WHEN len(anchors) > 0 THEN 'profile-term' ELSE 'text' END AS kind, query_id % 5 IN (1, 4) AS tq, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS key FROM c0),
c2 AS (SELECT *, tq AND coalesce(bool_or(kind = 'table' AND parse_version IS NOT NULL AND parse_version <> 'legacy') OVER (PARTITION BY query_id), false) AS canonical,
  CASE WHEN tq THEN CASE WHEN query_id % 5 = 1 AND contains(key, 'table2') THEN 100.0 ELSE 0.0 END + CASE WHEN contains(key, 'tion') THEN 3.0 ELSE 0.0 END ELSE 0.0 END AS rel,
  CASE WHEN tq THEN CASE WHEN kind = 'table' AND query_id % 5 = 1 AND contains(lower(text), 'table 2') THEN 3 WHEN kind = 'table' THEN 2 ELSE 0 END WHEN kind = 'formula' AND query_id % 5 = 3 THEN 4 ELSE 0 END AS str FROM c1),
c3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY str DESC, rel DESC, CASE WHEN tq AND kind = 'table' THEN 1 ELSE 0 END DESC, score DESC, chunk_id) AS o, CASE WHEN tq AND pipe THEN max(rel) FILTER (tq AND pipe) OVER (PARTITION BY query_id, document_id) END AS grp,
  tq AND pipe AND row_number() OVER (PARTITION BY query_id, document_id, pipe ORDER BY rel DESC, score DESC, chunk_id) = 1 AS best FROM c2),
c4 AS (SELECT *, coalesce(best AND grp > 0, false) AS rep FROM c3),
c5 AS (SELECT *, count(*) FILTER (rep) OVER (PARTITION BY query_id) AS reps, row_number() OVER (PARTITION BY query_id ORDER BY rep DESC, grp DESC NULLS LAST, score DESC, chunk_id) AS turn FROM c4),
c6 AS (SELECT *, rep AND reps >= 2 AND turn <= least(8, {_LIMIT}) AS front FROM c5),
c7 AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY front DESC, CASE WHEN front THEN turn END NULLS LAST, o) AS o) FROM c6),
c8 AS (SELECT *, {_PIECE} AS piece, CASE WHEN row_number() OVER (PARTITION BY query_id, page, kind = 'table', {_PIECE} ORDER BY o) = 1 THEN 1 ELSE 0 END AS once FROM c7),
c9 AS (SELECT * FROM (SELECT * FROM c8 QUALIFY kind = 'profile-term' OR sum(once) OVER (PARTITION BY query_id, page ORDER BY o) - once < CASE WHEN tq THEN {_LIMIT} ELSE 5 END) QUALIFY row_number() OVER (PARTITION BY query_id, page, kind = 'table', piece ORDER BY o) = 1),
c10 AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total, CASE WHEN kind = 'profile-term' AND NOT canonical THEN row_number() OVER (PARTITION BY query_id ORDER BY kind = 'profile-term' DESC, score DESC, o) END AS p FROM c9),
news AS (SELECT DISTINCT query_id, p FROM (SELECT query_id, a, min(p) AS p FROM (SELECT query_id, p, unnest(anchors) AS a FROM c10 WHERE p IS NOT NULL) GROUP BY 1, 2)),
c11 AS (SELECT c10.*, news.p IS NOT NULL AND total > {_LIMIT} AS fresh FROM c10 LEFT JOIN news ON news.query_id = c10.query_id AND news.p = c10.p),
c12 AS (SELECT *, fresh OR (kind <> 'text' AND NOT (kind = 'profile-term' AND canonical) AND row_number() OVER (PARTITION BY query_id, kind ORDER BY o) = 1) AS req FROM c11),
c13 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fresh DESC, req DESC, CASE WHEN fresh THEN p END, o) AS r FROM c12),
c14 AS (SELECT * FROM c13 WHERE total <= {_LIMIT} OR r <= {_LIMIT})
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fresh DESC, CASE WHEN fresh THEN p END, o) AS INT) AS position, chunk_id, kind, score FROM c14""")
def r14_staged_packs(spark, sf_dir):
    """Packs with versions checked again, reserved tables, deduplication, page caps and slots."""
    return staged(spark, sf_dir)[0].select("query_id", "position", "chunk_id", "kind", "score")


@query()
def b1_parent_packing(spark, sf_dir):
    """The staged packs fitted into a budget, with parents, neighbours, excerpts and rescued windows. tests/test_packs.py holds
    it against a plain version."""
    packs, asked = staged(spark, sf_dir)
    return P.packed(packs, asked, budget=1500)
