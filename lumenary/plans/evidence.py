"""Evidence scans, packs and checks of generated text."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from ..operators import evidence as E
from ..operators import retrieval as R
from . import model as M
from .registry import query, table
from .retrieval import HYBRID_SQL, inputs
from .text import tokens_sql


@query("""WITH e AS (SELECT doc_id, text, CASE WHEN lang = 'en' THEN '' ELSE source END AS prefix, CASE WHEN lang = 'en' THEN '' ELSE source || chr(10) || chr(10) END || CASE WHEN doc_id % 5 = 0 THEN trim(text) || '.' ELSE text END AS embedded FROM documents)
SELECT doc_id, CASE WHEN trim(prefix) = '' THEN embedded = text ELSE embedded = prefix || chr(10) || chr(10) || text END AS follows_policy FROM e""")
def f6_embedding_policy(spark, sf_dir):
    """English documents have no prefix, the others their source; every fifth document's embedded text isn't its own."""
    d = table(spark, sf_dir, "documents")
    prefix = F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("source"))
    body = F.when(F.col("doc_id") % 5 == 0, F.concat(F.trim("text"), F.lit("."))).otherwise(F.col("text"))
    embedded = F.when(F.col("lang") == "en", body).otherwise(F.concat("source", F.lit("\n\n"), body))
    return d.select("doc_id", E.contextual(F.col("text"), embedded, prefix).alias("follows_policy"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'error')")
def j14_related_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(e, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query(f"""WITH {M.CHUNKS_SQL}, r AS (SELECT document_id, ordinal, row_number() OVER (PARTITION BY document_id ORDER BY ordinal = 0 DESC, length(text) DESC, ordinal) AS r FROM chunks) SELECT document_id, ordinal FROM r WHERE r <= 3""")
def g2_generation_context(spark, sf_dir):
    """The first chunk in any case, and the two that score best (here: the longest)."""
    c = M.chunks(spark, sf_dir)
    return R.ranked(c, ["document_id"], [(F.col("ordinal") == 0).desc(), F.length("text").desc(), F.col("ordinal")], 3, "_r").select("document_id", "ordinal")


@query(r"""WITH c AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), n AS (SELECT conv_id, turn, role, list_filter(regexp_extract_all(text, '\d+(?:\.\d+)?'), lambda x: length(x) > 1) AS a, list_filter(regexp_extract_all(coalesce(before, ''), '\d+(?:\.\d+)?'), lambda x: length(x) > 1) AS b FROM c)
SELECT conv_id, turn, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS supported FROM n WHERE role = 'assistant'""")
def s6_number_support(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("_b", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant'")
    return c.select("conv_id", "turn", E.supported_numbers(F.col("text"), F.col("_b")).alias("supported"))


@query(r"""WITH c AS (SELECT conv_id, turn, role, text || ' [3] in Table 7 and OPLS4, ' || turn || '.0' AS text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') || ' ' || CASE WHEN turn % 3 = 0 THEN '' ELSE CAST(turn AS VARCHAR) END AS before FROM conversations),
n AS (SELECT conv_id, turn, role, list_transform(list_filter(regexp_extract_all(regexp_replace(' ' || replace(replace(text, '[3]', ' '), 'Table 7', ' '), '\s', '  ', 'g') || ' ', '[^A-Za-z0-9_](\d+(?:\.\d+)?)[^A-Za-z0-9_.]', 1), lambda x: true), lambda x: CAST(x AS DOUBLE)) AS a, list_transform(regexp_extract_all(regexp_replace(' ' || before, '\s', '  ', 'g') || ' ', '[^A-Za-z0-9_](\d+(?:\.\d+)?)[^A-Za-z0-9_.]', 1), lambda x: CAST(x AS DOUBLE)) AS b FROM c)
SELECT conv_id, turn, CAST(len(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))) AS INT) AS unsupported FROM n WHERE role = 'assistant'""")
def s6_synthesis_numbers(spark, sf_dir):
    """Numbers of an answer, by value, that the turn before and its own number lack; markers, tables and names don't count."""
    before = F.concat(F.coalesce(F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")), F.lit("")), F.lit(" "), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("turn").cast("string")))
    c = table(spark, sf_dir, "conversations").withColumn("_b", before).where("role = 'assistant'")
    answer = F.concat("text", F.lit(" [3] in Table 7 and OPLS4, "), F.col("turn").cast("string"), F.lit(".0"))
    return c.select("conv_id", "turn", F.size(T.unsupported_numbers(answer, F.col("_b"))).alias("unsupported"))


@query(f"""WITH {M.CHUNKS_SQL}, o AS (SELECT document_id, ordinal, (CAST(contains(lower(text), 'token =') AS INT) + CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'version') AS INT)) AS hits, least(len({tokens_sql('text')}), 8) AS ov FROM chunks)
SELECT document_id, ordinal, CAST(43.0 + ov + 2.0 * hits AS DOUBLE) AS score FROM o WHERE hits > 0""")
def r9_limitation_scan(spark, sf_dir):
    s = E.limitation_score(F.col("text"), F.size(T.tokens(F.col("text"))), ["token =", "license", "version"])  # what these texts have
    return M.chunks(spark, sf_dir).select("document_id", "ordinal", s.alias("score")).where("score IS NOT NULL")


@query(f"""WITH q AS (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS key FROM benchmark), t AS (SELECT doc_id AS chunk_id, unnest({tokens_sql('text')}) AS key FROM documents), h AS (SELECT query_id, chunk_id, count(*) AS n FROM q JOIN t USING (key) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT query_id, chunk_id, score, rank FROM (SELECT query_id, chunk_id, round(CAST(12.0 + 1.5 * n + 0.5 AS DOUBLE), 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n DESC, chunk_id) AS INT) AS rank FROM h) WHERE rank <= 3""")
def r10_claim_evidence(spark, sf_dir):
    keys = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.tokens(F.col("text"), chemistry=False)).alias("key"))
    claims = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), F.col("doc_id").alias("chunk_id"), "text", F.lit(0.5).alias("confidence"))
    return E.claim_evidence(claims, keys)


@query(f"""WITH {HYBRID_SQL}, w AS (SELECT DISTINCT query_id, term FROM qt WHERE length(term) >= 9), have AS (SELECT DISTINCT h.query_id, dt.term FROM hybrid h JOIN dt ON dt.document_id = h.document_id)
SELECT query_id, term FROM w WHERE NOT EXISTS (SELECT 1 FROM have WHERE have.query_id = w.query_id AND have.term = w.term)""")
def r11_uncovered_terms(spark, sf_dir):
    q, d, v = inputs(spark, sf_dir)
    wanted = q.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).where(F.length("term") >= 9)
    have = R.hybrid(q, d, v).join(d, "document_id").select("query_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    return E.supplement(have, wanted)


@query("""WITH q AS (SELECT DISTINCT o_custkey AS query_id, l_suppkey AS table_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey), f AS (SELECT DISTINCT o_custkey AS query_id, l_suppkey AS table_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'), g AS (SELECT DISTINCT s_suppkey AS table_id FROM supplier WHERE s_nationkey < 12)
SELECT q.query_id, q.table_id, CASE WHEN f.query_id IS NOT NULL THEN 'found' WHEN g.table_id IS NOT NULL THEN 'filled' ELSE 'missing' END AS origin, f.query_id IS NULL AND g.table_id IS NOT NULL AS coverage_by_fill FROM q LEFT JOIN f USING (query_id, table_id) LEFT JOIN g ON g.table_id = q.table_id""")
def r16_requested_tables(spark, sf_dir):
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("query_id"), F.col("l_suppkey").alias("table_id"), "l_returnflag")
    fetched = table(spark, sf_dir, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("table_id"))
    return E.fill_tables(j.select("query_id", "table_id").distinct(), j.where("l_returnflag = 'R'"), fetched)


@query("""WITH p AS (SELECT conv_id AS document_id, turn AS page_index, role AS header, length(text) AS n FROM conversations), s AS (SELECT *, CAST(coalesce(page_index - lag(page_index) OVER w > 1, true) AS INT) AS s FROM p WINDOW w AS (PARTITION BY document_id, header ORDER BY page_index)), g AS (SELECT *, sum(s) OVER (PARTITION BY document_id, header ORDER BY page_index) AS g FROM s)
SELECT document_id, header, min(page_index) AS first_page, max(page_index) AS last_page, CAST(sum(n) AS BIGINT) AS n_rows FROM g GROUP BY document_id, header, g""")
def c7_merged_continuations(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_index"), F.col("role").alias("header"), F.length("text").alias("n_rows"))
    return E.merge_continuations(p)


_S = "list_filter(list_transform(regexp_extract_all(p, '[^.!?。！？\\n]+[.!?。！？]?'), lambda x: trim(x)), lambda x: x <> '')"


@query(rf"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10))[1] || CASE WHEN doc_id % 3 = 0 THEN ' In 98765 cases. Yes. No.' ELSE '' END AS p FROM documents)
SELECT doc_id, list_filter([CASE WHEN trim(p) = '' THEN 'empty' END, CASE WHEN length(p) > 400 THEN 'too_long' END, CASE WHEN len({_S}) > 2 THEN 'too_many_sentences' END, CASE WHEN length(p) >= 8 AND contains(text, p) THEN 'copy' END,
 CASE WHEN len(list_filter(regexp_extract_all(p, '\d+(?:\.\d+)?'), lambda x: NOT list_contains(regexp_extract_all(text, '\d+(?:\.\d+)?'), x))) > 0 THEN 'new_number' END, CASE WHEN NOT regexp_matches(p, '[\x{{3400}}-\x{{9fff}}]') THEN 'not_chinese' END], lambda x: x IS NOT NULL) AS errors FROM d""")
def s20_prefix_errors(spark, sf_dir):
    """A document's first line as its prefix, every third with sentences and a number more."""
    p = F.concat(F.split("text", "\n")[0], F.when(F.col("doc_id") % 3 == 0, " In 98765 cases. Yes. No.").otherwise(""))
    d = table(spark, sf_dir, "documents").withColumn("_p", p)
    return d.select("doc_id", E.prefix_errors(F.col("_p"), F.col("text")).alias("errors"))


@query()
def c16_embeddings(spark, sf_dir):
    return E.embed(table(spark, sf_dir, "documents"), "doc_id", "text", chunking.hashing_embedder)


@query("""SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN sha256('{"a":[1,{"x":"' || event_type || '","y":null}],"b":' || user_id || '}') END AS fingerprint FROM events""")
def m6_fingerprints(spark, sf_dir):
    """Objects whose keys stand in no order and have blanks between; every ninth is no JSON."""
    text = F.concat(F.lit('{"b": '), F.col("user_id").cast("string"), F.lit(', "a": [1, {"y": null, "x": "'), "event_type", F.lit('"}]'), F.when(F.col("event_id") % 9 == 0, F.lit("")).otherwise(F.lit("}")))
    return E.fingerprints(table(spark, sf_dir, "events").select("event_id", text.alias("value")), "event_id", "value")


@query(f"""WITH {M.CHUNKS_SQL}, k AS (SELECT document_id * 10 + ordinal % 10 AS claim_id, CASE WHEN ordinal % 3 = 0 THEN document_id + 1 ELSE document_id END AS document_id, chunk_id FROM chunks WHERE ordinal < 10)
SELECT k.claim_id, k.chunk_id, k.document_id, d.project_id FROM k JOIN chunks c ON c.chunk_id = k.chunk_id AND c.document_id = k.document_id JOIN d ON d.document_id = k.document_id WHERE d.status = 'ready'""")
def j3_claim_evidence_rows(spark, sf_dir):
    """A claim for each of a document's first lines; every third names the document after its own, which doesn't have that line."""
    c = M.chunks(spark, sf_dir)
    claims = c.where("ordinal < 10").select((F.col("document_id") * 10 + F.col("ordinal") % 10).alias("claim_id"), F.when(F.col("ordinal") % 3 == 0, F.col("document_id") + 1).otherwise(F.col("document_id")).alias("document_id"), "chunk_id")
    return E.claim_rows(claims, c, M.documents(spark, sf_dir))


@query(r"""WITH l AS (SELECT doc_id, list_concat(regexp_extract_all(string_split(text, chr(10))[1], '[A-Za-z]+'), ['source'], regexp_extract_all(coalesce(string_split(text, chr(10))[2], ''), '[A-Za-z]+')) AS w FROM documents) SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS terms FROM l""")
def u4_ordered_terms(spark, sf_dir):
    """The words of a document's first two lines, each where it stands first."""
    line = lambda i: F.regexp_extract_all(F.coalesce(F.get(F.split("text", "\n"), F.lit(i)), F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_distinct(F.concat(line(0), F.array(F.lit("source")), line(1))), " ").alias("terms"))
