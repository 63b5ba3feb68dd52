"""Evaluation: recall, coverage, ratios, gates, quality scores, answer checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as AN
from ..operators import evaluation as E
from ..operators import gates as GT
from ..operators import retrieval as R
from . import model as M
from .registry import query, table
from .retrieval import HYBRID_SQL, inputs


def cases(spark, sf_dir, only=None):
    """Expected documents of a query: those whose vectors have the label of its own; of ``only`` some documents, if given."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")).join(e, "vec_id").select(F.col("vec_id").alias("query_id"), "label")
    f = e if only is None else e.join(only.withColumnRenamed("document_id", "vec_id"), "vec_id", "left_semi")
    return R.small(q).join(f, "label").select("query_id", F.col("vec_id").alias("document_id"))


_CASES = "cases AS (SELECT b.item_id AS query_id, f.vec_id AS document_id FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id JOIN embeddings f ON f.label = e.label)"


@query(f"WITH {HYBRID_SQL}, {_CASES} SELECT query_id, coalesce(max(CAST(rank <= 3 AS INT)), 0) AS hit_3, coalesce(max(CAST(rank <= 8 AS INT)), 0) AS hit_8 FROM cases LEFT JOIN hybrid USING (query_id, document_id) GROUP BY 1")
def a8_recall(spark, sf_dir):
    return E.recall(R.hybrid(*inputs(spark, sf_dir)), cases(spark, sf_dir), (3, 8))


@query(f"""WITH {HYBRID_SQL}, t AS (SELECT query_id, toks, list_sort(list_filter(toks, lambda w: length(w) >= 9)) AS required FROM q), ev AS (SELECT query_id, string_agg(lower(text), ' ') AS evidence FROM hybrid JOIN documents ON doc_id = document_id WHERE rank <= 5 GROUP BY 1)
SELECT query_id, CASE WHEN len(required) = 0 THEN NULL ELSE round(len(list_filter(required, lambda w: contains(evidence, w))) / len(required), 6) END AS coverage FROM t JOIN ev USING (query_id)""")
def a9_anchor_coverage(spark, sf_dir):
    q, d, v = inputs(spark, sf_dir)
    top = R.hybrid(q, d, v).where("rank <= 5").join(d, "document_id")
    evidence = top.groupBy("query_id").agg(F.lower(F.array_join(F.collect_list("text"), " ")).alias("evidence"))  # five texts a query
    required = q.select("query_id", F.filter(T.tokens(F.col("text")), lambda w: F.length(w) >= 9).alias("required"))
    hit = F.size(F.filter("required", lambda w: F.contains("evidence", w)))
    return required.join(evidence, "query_id").select("query_id", F.when(F.size("required") > 0, F.round(hit / F.size("required"), 6)).alias("coverage"))


@query(f"""WITH {HYBRID_SQL}, {_CASES} SELECT h.query_id, round(avg(CAST(c.document_id IS NOT NULL AND d.n_chars > 100 AS INT)), 6) AS validity FROM hybrid h JOIN documents d ON d.doc_id = h.document_id LEFT JOIN cases c ON c.query_id = h.query_id AND c.document_id = h.document_id GROUP BY 1""")
def a11_citation_validity(spark, sf_dir):
    found = R.hybrid(*inputs(spark, sf_dir))
    h = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "n_chars").join(found, "document_id")
    c = cases(spark, sf_dir, found.select("document_id")).withColumn("_c", F.lit(1))
    valid = F.col("_c").isNotNull() & (F.col("n_chars") > 100)
    return h.join(c, ["query_id", "document_id"], "left").groupBy("query_id").agg(F.round(F.avg(valid.cast("int")), 6).alias("validity"))


@query(f"""WITH {M.CHUNKS_SQL}, v AS (SELECT doc_id, n_chars >= 20 AS completed, CASE WHEN doc_id % 50 = 0 THEN 0.5 ELSE 1.0 END AS fidelity, lang, sha256(text) AS own, CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE sha256(text) END AS stored FROM documents),
k AS (SELECT c.*, e.embedding IS NOT NULL AND len(e.embedding) = 64 AS ok FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.document_id WHERE chunk_role = 'child'),
g AS (SELECT 'parse_completeness' AS gate, count(*) FILTER (completed) AS valid, count(*) AS total FROM v UNION ALL SELECT 'source_fidelity_completeness', count(*) FILTER (fidelity = 1), count(*) FROM v UNION ALL SELECT 'structured_limit_completeness', count(*), count(*) FROM v
 UNION ALL SELECT 'config_identity_completeness', count(*) FILTER (lang = 'en'), count(*) FROM v UNION ALL SELECT 'source_version_identity_completeness', count(*) FILTER (own = stored), count(*) FROM v
 UNION ALL SELECT 'contextual_prefix_completeness', count(*) FILTER (block_type IS NOT NULL), count(*) FROM k UNION ALL SELECT 'plain_embedding_completeness', count(*) FILTER (block_type IS NOT NULL OR ordinal % 2 = 0 OR text = trim(text)), count(*) FROM k UNION ALL SELECT 'embedding_completeness', count(*) FILTER (ok), count(*) FROM k
 UNION ALL SELECT 'source_span_validity', count(*) FILTER (length(text) > 0), count(*) FROM k UNION ALL SELECT 'child_token_limit_completeness', count(*) FILTER (greatest(1, length(text) // 4) <= 100), count(*) FROM k
 UNION ALL SELECT 'table_validation_rate', count(*) FILTER (l_quantity < 40), count(*) FROM lineitem UNION ALL SELECT 'artifact_link_validity', 0, 0)
SELECT gate, CAST(valid AS BIGINT) AS valid, CAST(total AS BIGINT) AS total, CASE WHEN total = 0 THEN 1.0 ELSE round_even(valid / total, 6) END AS ratio FROM g""")
def a7_integrity_gates(spark, sf_dir):
    """Documents as active versions and their lines as children; lines without a type have no prefix."""
    d = table(spark, sf_dir, "documents")
    own = F.sha2(F.col("text").cast("binary"), 256)
    versions = d.select((F.col("n_chars") >= 20).alias("completed"), F.when(F.col("doc_id") % 50 == 0, 0.5).otherwise(1.0).alias("source_fidelity"), F.lit(1.0).alias("structured_limit"), F.col("lang").alias("config"), own.alias("source_hash"), F.when(F.col("doc_id") % 9 == 0, "x").otherwise(own).alias("stored_hash"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding")
    c = M.chunks(spark, sf_dir).where("chunk_role = 'child'").join(e, "document_id", "left")
    embedded = F.when(F.col("block_type").isNotNull(), F.concat("block_type", F.lit("\n\n"), "text")).when(F.col("ordinal") % 2 == 0, F.col("text")).otherwise(F.trim("text"))
    children = c.select("text", embedded.alias("embedding_text"), F.col("block_type").alias("prefix"), "embedding", F.length("text").alias("n_spans"), T.token_estimate(F.col("text")).alias("n_tokens"))
    tables = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") < 40).alias("accepted"))
    return GT.integrity(versions, children, tables, tables.limit(0).select(F.lit(True).alias("ok")), F.lit("en"), 64, 100)


@query("""WITH c AS (SELECT source, lang, count(*) > 5 AS big, max(n_chars) > 2000 AS long FROM documents GROUP BY 1, 2)
SELECT source, count(*) > 0 AND bool_and(big AND long) AS passed, list_sort(list_distinct(list_concat(list(CASE WHEN NOT big THEN 'size' END) FILTER (NOT big), list('length') FILTER (NOT long)))) AS failed_layers FROM c GROUP BY 1""")
def a12_gate_rollup(spark, sf_dir):
    c = table(spark, sf_dir, "documents").groupBy("source", "lang").agg((F.count("*") > 5).alias("big"), (F.max("n_chars") > 2000).alias("long"))
    layers = F.flatten(F.collect_list(F.concat(F.when(~F.col("big"), F.array(F.lit("size"))).otherwise(F.array().cast("array<string>")), F.when(~F.col("long"), F.array(F.lit("length"))).otherwise(F.array().cast("array<string>")))))
    return c.groupBy("source").agg(((F.count("*") > 0) & F.bool_and(F.col("big") & F.col("long"))).alias("passed"), F.sort_array(F.array_distinct(layers)).alias("failed_layers"))


@query("""SELECT count(*) FILTER (role = 'user' AND length(text) > 100) AS matched, count(*) FILTER (role = 'user' AND length(text) <= 100) AS unmatched, count(*) FILTER (role = 'assistant') AS with_answers FROM conversations""")
def a14_coverage_counters(spark, sf_dir):
    u = F.col("role") == "user"
    return table(spark, sf_dir, "conversations").agg(F.count_if(u & (F.length("text") > 100)).alias("matched"), F.count_if(u & (F.length("text") <= 100)).alias("unmatched"), F.count_if(F.col("role") == "assistant").alias("with_answers"))


@query(f"""WITH {M.CHUNKS_SQL}, i AS (SELECT document_id, CASE WHEN length(text) = 0 THEN 'error' WHEN length(text) < 20 THEN 'warning' WHEN contains(text, '%%%') THEN 'fatal' ELSE 'info' END AS severity, length(text) = 0 AS repairable FROM chunks),
g AS (SELECT document_id, sum(CASE severity WHEN 'warning' THEN 0.05 WHEN 'error' THEN 0.15 WHEN 'fatal' THEN 0.35 ELSE 0 END) AS p, bool_or(severity = 'fatal') AS f, bool_or(repairable) AS r, bool_or(severity = 'warning') AS w FROM i GROUP BY 1)
SELECT document_id, CAST(round(greatest(0.0, 1.0 - p), 6) AS DOUBLE) AS score, CASE WHEN f THEN 'rejected' WHEN r THEN 'validation_failed' WHEN w THEN 'accepted_with_warnings' ELSE 'accepted' END AS status, NOT f AND NOT r AS accepted FROM g""")
def a17_quality_score(spark, sf_dir):
    t = F.col("text")
    severity = F.when(F.length(t) == 0, "error").when(F.length(t) < 20, "warning").when(F.contains(t, F.lit("%%%")), "fatal").otherwise("info")
    return E.quality(M.chunks(spark, sf_dir).select("document_id", severity.alias("severity"), (F.length(t) == 0).alias("repairable")))


_TOKENS_SQL = "regexp_extract_all(lower({t}), '[a-z0-9]+|[\u4e00-\u9fff]')"
_REPEATS_SQL = """t AS (SELECT {key}, {tokens} AS w FROM {table}), g AS (SELECT {key}, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS gram FROM t WHERE len(w) >= 12),
c AS (SELECT {key}, gram, count(*) AS n FROM g WHERE NOT regexp_matches(gram, '^[0-9 ]+$') GROUP BY ALL), m AS (SELECT {key}, max(n) AS repeats FROM c GROUP BY ALL),
u AS (SELECT {key}, len(w) AS total, unnest(w) AS tok FROM t WHERE len(w) >= 12), k AS (SELECT {key}, total, tok, count(*) AS n FROM u GROUP BY ALL), d AS (SELECT {key}, max(n) FILTER (n >= 8 AND 2 * n >= total AND regexp_matches(tok, '[a-z\u4e00-\u9fff]')) AS dominant FROM k GROUP BY ALL)"""


@query(f"WITH {_REPEATS_SQL.format(key='doc_id', table='documents', tokens=_TOKENS_SQL.format(t='text'))} SELECT t.doc_id, coalesce(repeats, 0) AS repeats, coalesce(dominant, 0) AS dominant FROM t LEFT JOIN m USING (doc_id) LEFT JOIN d USING (doc_id) WHERE repeats >= 4 OR dominant > 0")
def a21_repeated_grams(spark, sf_dir):
    return E.repetition(table(spark, sf_dir, "documents"), ["doc_id"])


@query("""WITH w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]{8,}')) AS term FROM documents), c AS (SELECT source, term, count(*) AS n FROM w GROUP BY 1, 2)
SELECT source, term, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS r FROM c) WHERE r <= 10""")
def a23_keywords(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0))).alias("term"))
    return R.ranked(w.groupBy("source", "term").agg(F.count("*").alias("n")), ["source"], [F.desc("n"), F.col("term")], 10, "_r").select("source", "term", "n")


_ROUTES = ["simple_rag", "table_or_metric", "evidence_required", "needs_clarification", "multi_source_compare"]


@query(rf"""WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 3 THEN 'same same ' || repeat('same ', 12) WHEN turn % 11 = 5 THEN ' ' ELSE text END AS answer, {_ROUTES}[(conv_id + turn) % 5 + 1] AS route, (conv_id * 3 + turn) % 4 AS citations, CAST(conv_id % 2 AS BIGINT) AS table_citations FROM conversations WHERE role = 'assistant'),
{_REPEATS_SQL.format(key='conv_id, turn', table='a', tokens=_TOKENS_SQL.format(t='answer'))},
f AS (SELECT a.*, list_filter([CASE WHEN trim(answer) = '' THEN 'empty' END, CASE WHEN repeats >= 4 THEN 'repeated_phrase' END, CASE WHEN dominant > 0 THEN 'dominant_token' END, CASE WHEN route IN ('evidence_required', 'multi_source_compare', 'table_or_metric') AND citations = 0 THEN 'no_citations' END], lambda x: x IS NOT NULL) AS w FROM a LEFT JOIN m USING (conv_id, turn) LEFT JOIN d USING (conv_id, turn))
SELECT conv_id, turn, CASE WHEN route = 'needs_clarification' THEN [] WHEN len(w) = 0 AND route = 'table_or_metric' AND NOT regexp_matches(answer, '\d') AND table_citations = 0 THEN ['no_table_evidence'] ELSE w END AS warnings FROM f""")
def v1_answer_rules(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    answer = F.when(F.col("turn") % 7 == 3, F.concat(F.lit("same same "), F.repeat(F.lit("same "), F.lit(12)))).when(F.col("turn") % 11 == 5, " ").otherwise(F.col("text"))
    route = F.element_at(F.array(*map(F.lit, _ROUTES)), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    rows = a.select("conv_id", "turn", answer.alias("answer"), route.alias("route"), ((F.col("conv_id") * 3 + F.col("turn")) % 4).alias("citations"), (F.col("conv_id") % 2).alias("table_citations"))
    return AN.verify(rows).select("conv_id", "turn", "warnings")


@query(r"""WITH c AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{6,}')) AS a FROM conversations), q AS (SELECT c.conv_id, c.turn, c.a AS answer, p.a AS expected FROM c JOIN c p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 AND p.role = 'user' WHERE c.role = 'assistant')
SELECT conv_id, turn, CAST(len(list_intersect(answer, expected)) AS INT) AS covered, len(list_intersect(answer, expected)) < greatest(1, len(expected) // 2) AS retry FROM q""")
def v5_coverage_retry(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("a", F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{6,}"), F.lit(0))))
    p = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("a").alias("expected"))
    covered = F.size(F.array_intersect("a", "expected"))
    return c.where("role = 'assistant'").join(p, ["conv_id", "turn"]).select("conv_id", "turn", covered.alias("covered"), (covered < F.greatest(F.lit(1), F.floor(F.size("expected") / 2))).alias("retry"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), b AS (SELECT doc_id, i + CASE WHEN doc_id % 7 = 0 AND i > 0 THEN 1 ELSE 0 END AS o, CASE i % 5 WHEN 3 THEN 'figure' WHEN 4 THEN 'formula' ELSE 'narrative' END AS k, trim(t) <> '' AS f FROM l),
g AS (SELECT doc_id, count(*) FILTER (f) AS content, count(*) AS n, count(DISTINCT o) AS d, min(o) AS lo, max(o) AS hi, count(*) FILTER (k = 'figure' AND NOT f) AS fig, count(*) FILTER (k = 'formula' AND NOT f) AS form FROM b GROUP BY 1),
r AS (SELECT d.doc_id, unnest(list_filter([CASE WHEN d.doc_id % 4 = 3 THEN 'page_missing' END, CASE WHEN content = 0 THEN 'content_empty' END, CASE WHEN d <> n OR lo <> 0 OR hi <> n - 1 THEN 'reading_order_invalid' END, CASE WHEN source LIKE '%e%' THEN 'asset_path_unsafe' END, CASE WHEN n_chars < 500 THEN 'abstract_missing' END, CASE WHEN fig > 0 THEN 'figure_empty' END, CASE WHEN form > 0 THEN 'formula_empty' END], lambda x: x IS NOT NULL)) AS code FROM documents d JOIN g ON g.doc_id = d.doc_id)
SELECT doc_id AS document_id, code, CASE WHEN code IN ('page_missing', 'content_empty', 'reading_order_invalid') THEN 'fatal' WHEN code = 'abstract_missing' THEN 'warning' ELSE 'error' END AS severity FROM r""")
def c11_document_gate(spark, sf_dir):
    """Lines as blocks, of which some are figures and formulas; every seventh document has a gap in its order, and every fourth
    lacks its last page."""
    d = table(spark, sf_dir, "documents")
    lines = d.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    kind = F.when(F.col("i") % 5 == 3, "figure").when(F.col("i") % 5 == 4, "formula").otherwise("narrative")
    order = F.col("i") + F.when((F.col("document_id") % 7 == 0) & (F.col("i") > 0), 1).otherwise(0)
    blocks = lines.select("document_id", order.alias("reading_order"), kind.alias("block_type"), "text", F.lit(None).cast("string").alias("caption"), F.lit(True).alias("retrievable"))
    parsed = F.when(F.col("doc_id") % 4 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    asset = F.when(F.contains("source", F.lit("e")), F.concat(F.lit("a/../"), "source")).otherwise(F.concat(F.lit("a/"), "source"))
    documents = d.select(F.col("doc_id").alias("document_id"), F.lit(3).alias("expected_pages"), parsed.alias("parsed_pages"), F.array(asset).alias("assets"), (F.col("n_chars") >= 500).alias("has_abstract"))
    return GT.document_issues(documents, blocks).select("document_id", "code", "severity")
