"""Composite retrieval: routing, hybrid top-k, scans, supplements, expansion, caps and packing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as EV
from ..operators import knn, lexical
from ..operators import retrieval as R
from ..operators import routing as RT
from ..sources.scratch import cut
from . import model as M
from .registry import query, table
from .text import tokens_sql


def inputs(spark, sf_dir):
    """Queries with the vector of the document of their number, documents and vectors."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(v.withColumnRenamed("document_id", "query_id"), "query_id", "left")
    return q, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text"), v


HYBRID_SQL = f"""q AS (SELECT item_id AS query_id, {tokens_sql('b.text')} AS toks, CAST(e.embedding AS DOUBLE[]) AS qv FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id),
qt AS (SELECT query_id, unnest(toks) AS term FROM q),
dt AS (SELECT doc_id AS document_id, unnest({tokens_sql('text')}) AS term FROM documents),
df AS (SELECT term, count(*) AS df FROM dt GROUP BY 1),
lex AS (SELECT query_id, document_id, count(*) AS overlap, count(*) FILTER (length(term) >= 6) AS route_overlap, count(*) FILTER (length(term) >= 6 AND df <= 3) AS rare FROM qt JOIN dt USING (term) JOIN df USING (term) GROUP BY 1, 2),
cosines AS (SELECT query_id, vec_id AS document_id, round(CASE WHEN list_inner_product(qv, qv) = 0 OR list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) = 0 THEN 0 ELSE list_inner_product(qv, CAST(embedding AS DOUBLE[])) / (sqrt(list_inner_product(qv, qv)) * sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) END, 9) AS cosine FROM q, embeddings WHERE qv IS NOT NULL),
pairs AS (SELECT query_id, document_id, coalesce(overlap, 0) AS overlap, coalesce(route_overlap, 0) AS route_overlap, coalesce(rare, 0) AS rare, cosine FROM lex FULL JOIN (SELECT * FROM cosines WHERE document_id IN (SELECT doc_id FROM documents)) cosines USING (query_id, document_id)),
scored AS (SELECT query_id, document_id, round(CASE WHEN cosine IS NOT NULL THEN 10 * cosine + least(overlap * 0.05 + route_overlap * 0.08, 0.4) + least(rare * 0.6, 1.2) WHEN overlap + route_overlap > 0 THEN least(0.3 + (overlap + route_overlap) * 0.1 + least(rare * 0.6, 1.2), 1.2) ELSE 0 END, 6) AS score FROM pairs),
hybrid AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS INT) AS rank FROM scored WHERE score > 0) WHERE rank <= 8)"""


@query(f"WITH {HYBRID_SQL} SELECT query_id, document_id, score, rank FROM hybrid")
def r3_hybrid_topk(spark, sf_dir):
    return R.hybrid(*inputs(spark, sf_dir))


@query(f"WITH {HYBRID_SQL} SELECT term, df FROM df WHERE term IN (SELECT term FROM qt)")
def a4_route_term_frequency(spark, sf_dir):
    q, d, _ = inputs(spark, sf_dir)
    terms = q.select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    return d.select(F.explode(T.tokens(F.col("text"))).alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {HYBRID_SQL} SELECT query_id, document_id, overlap FROM lex WHERE overlap >= 5")
def u1_token_intersection(spark, sf_dir):
    q, d, _ = inputs(spark, sf_dir)
    return R.shared(q, d, 5).select("query_id", "document_id", "overlap")


@query(f"WITH {HYBRID_SQL} SELECT query_id, document_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, document_id) AS r FROM cosines) WHERE r <= 10")
def t1_knn(spark, sf_dir):
    q, _, v = inputs(spark, sf_dir)
    return knn.top_k(v, q.where("embedding IS NOT NULL"), 10, 64)


@query(f"""WITH {HYBRID_SQL}, en AS (SELECT doc_id FROM documents WHERE lang = 'en')
SELECT query_id, document_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, document_id) AS r FROM cosines WHERE document_id IN (SELECT doc_id FROM en)) WHERE r <= 10""")
def t2_knn_filtered(spark, sf_dir):
    """The filter goes before the ranking, so nothing needs fetching again."""
    q, _, v = inputs(spark, sf_dir)
    en = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("document_id"))
    return knn.top_k(v.join(en, "document_id", "left_semi"), q.where("embedding IS NOT NULL"), 10, 64)


_ROUTE_SQL = f"""q AS (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark),
p AS (SELECT doc_id AS document_id, unnest({tokens_sql('text')}) AS term, 1 AS w FROM documents UNION ALL SELECT doc_id, unnest({tokens_sql("string_split(text, chr(10))[1]")}), 3 FROM documents UNION ALL SELECT doc_id, unnest({tokens_sql('source')}), 5 FROM documents),
s AS (SELECT query_id, document_id, CAST(sum(w) AS BIGINT) AS score FROM q JOIN p USING (term) GROUP BY 1, 2 HAVING sum(w) >= 2),
routed AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS INT) AS rank FROM s) WHERE rank <= 5)"""


def question_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.tokens(F.col("text")).alias("terms"))


def routed(spark, sf_dir):
    """Weighted overlap of a question with a document's text, title (its first line) and alias (its source)."""
    d = table(spark, sf_dir, "documents")
    parts = [(F.col("text"), 1), (F.split("text", "\n")[0], 3), (F.col("source"), 5)]
    tokens = [T.tokens(c) for c, _ in parts]
    weights = F.concat(*[F.array_repeat(F.lit(w), F.size(t)) for t, (_, w) in zip(tokens, parts, strict=True)])
    texts = d.select(F.col("doc_id").alias("document_id"), F.lit(0).alias("ordinal"), F.concat(*tokens).alias("terms"), weights.alias("weights"))
    best = lexical.best(texts, question_terms(spark, sf_dir), 5, lambda total, *_: total, 2.0)
    return best.select("query_id", "document_id", F.col("score").cast("long").alias("score"), "rank")


@query(f"WITH {_ROUTE_SQL} SELECT query_id, document_id, score, rank FROM routed")
def r1_document_routing(spark, sf_dir):
    return routed(spark, sf_dir)


_FLAGS_SQL = """f AS (SELECT *, query_id % 13 = 0 AND rank IN (2, 3) AS subject_locked, query_id % 11 = 0 AND rank = 4 AS explicit, query_id % 7 = 0 AND rank = 2 AS is_primary, query_id % 5 = 0 AND rank <= 1 + query_id % 2 AS exact_alias,
 query_id % 3 = 0 AND rank = 3 AS introduced, query_id % 4 = 1 AS cross_paper FROM routed)"""


@query(f"""WITH {_ROUTE_SQL}, {_FLAGS_SQL}, t AS (SELECT *, count(*) FILTER (subject_locked) OVER w AS ns, count(*) FILTER (explicit) OVER w AS ne, count(*) FILTER (is_primary) OVER w AS np, count(*) FILTER (exact_alias) OVER w AS na, count(*) FILTER (introduced) OVER w AS ni,
 max(score) OVER w AS a, max(score) FILTER (rank = 2) OVER w AS b, count(*) OVER w AS n FROM f WINDOW w AS (PARTITION BY query_id)),
d AS (SELECT *, CASE WHEN ns > 0 THEN 'subject' WHEN ne > 0 THEN 'explicit' WHEN np > 0 THEN 'primary' WHEN na = 1 THEN 'alias' WHEN na > 1 THEN 'aliases' WHEN cross_paper THEN 'cross_paper' WHEN ni = 1 THEN 'introduced' WHEN a >= 10 AND (b IS NULL OR a >= b + 8 OR a >= 1.75 * b) THEN 'obvious' ELSE 'top_k' END AS decision FROM t)
SELECT query_id, document_id, decision, decision NOT IN ('aliases', 'cross_paper', 'top_k') AS locked FROM d WHERE CASE decision WHEN 'subject' THEN rank = 2 WHEN 'explicit' THEN rank = 4 WHEN 'primary' THEN rank = 2 WHEN 'alias' THEN exact_alias WHEN 'aliases' THEN exact_alias WHEN 'introduced' THEN introduced WHEN 'obvious' THEN rank = 1 ELSE true END""")
def r2_route_decision(spark, sf_dir):
    """The cascade over routed documents; what it asks of profiles, which the tables don't have, is dealt by number."""
    k, r = F.col("query_id"), F.col("rank")
    m = routed(spark, sf_dir).withColumns({"subject_locked": (k % 13 == 0) & r.isin(2, 3), "explicit": (k % 11 == 0) & (r == 4), "primary": (k % 7 == 0) & (r == 2), "exact_alias": (k % 5 == 0) & (r <= 1 + k % 2), "introduced": (k % 3 == 0) & (r == 3), "cross_paper": k % 4 == 1})
    return RT.decide(m)


@query(f"""WITH {M.CHUNKS_SQL}, q AS (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark), c AS (SELECT document_id, ordinal, unnest({tokens_sql('text')}) AS term FROM chunks WHERE ordinal <= 3),
o AS (SELECT query_id, document_id, ordinal, count(*) AS overlap FROM q JOIN c USING (term) GROUP BY 1, 2, 3)
SELECT query_id, document_id, ordinal, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, ordinal) AS r FROM (SELECT *, round(CAST(42.0 + least(overlap, 12) + greatest(0.0, 4.0 - ordinal * 0.2) AS DOUBLE), 6) AS score FROM o)) WHERE r <= 2""")
def r7_intro_scan(spark, sf_dir):
    texts = M.chunks(spark, sf_dir).where("ordinal <= 3").select("document_id", "ordinal", T.tokens(F.col("text")).alias("terms"))
    texts = texts.withColumn("weights", F.array_repeat(F.lit(1), F.size("terms")))
    best = lexical.best(texts, question_terms(spark, sf_dir), 2, lambda overlap, ordinal, _: np.round(42.0 + np.minimum(overlap, 12) + np.maximum(0.0, 4.0 - ordinal * 0.2), 6), 0.0)
    return best.select("query_id", "document_id", "ordinal", "score")


_W = lambda words: rf"(^|[^a-z0-9_])({words})([^a-z0-9_]|$)"


@query(rf"""WITH {M.CHUNKS_SQL}, s AS (SELECT document_id, ordinal, lower(text) AS low, substr(lower(text), 1, 240) AS head, text FROM chunks WHERE length(trim(text)) > 0),
o AS (SELECT document_id, ordinal, round(20.0 + CASE WHEN ordinal <= 8 THEN greatest(0.0, 18.0 - ordinal * 1.5) ELSE 0 END + CASE WHEN contains(head, 'abstract') THEN 26 ELSE 0 END + CASE WHEN regexp_matches(head, '{_W("introduction")}') THEN 20 ELSE 0 END
 + CASE WHEN regexp_matches(low, '{_W(r"we\s+(introduce|propose|present|develop|study|show|demonstrate)")}') THEN 18 ELSE 0 END + CASE WHEN regexp_matches(low, '{_W("method|approach|framework|algorithm|model")}') THEN 8 ELSE 0 END
 + CASE WHEN regexp_matches(head, '{_W("conclusions?")}') THEN 14 ELSE 0 END - CASE WHEN regexp_matches(head, '{_W("appendix|references|acknowledgements?")}') THEN 18 ELSE 0 END - CASE WHEN regexp_matches(head, '{_W(r"table\s+\d+")}') THEN 16 ELSE 0 END + least(length(text) / 500.0, 4.0), 6) AS score FROM s)
SELECT document_id, ordinal, score FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, ordinal) AS r FROM o WHERE score > 0) WHERE r <= 5""")
def r8_overview_scan(spark, sf_dir):
    c = M.chunks(spark, sf_dir).where("length(trim(text)) > 0").withColumn("score", F.round(R.overview_score(F.col("text"), F.col("ordinal"), F.lit(None).cast("int")), 6)).where("score > 0")
    return R.ranked(c, ["document_id"], [F.desc("score"), F.col("ordinal")], 5, "_r").select("document_id", "ordinal", "score")


@query(f"""WITH {HYBRID_SQL}, r AS (SELECT h.query_id, h.document_id, h.score, h.rank, EXISTS (SELECT 1 FROM lex l WHERE l.query_id = h.query_id AND l.document_id = h.document_id) AS hit FROM hybrid h)
SELECT query_id, document_id, CASE WHEN score >= 15 THEN 'direct' WHEN score >= 5 OR hit THEN 'contextual' ELSE 'weak' END AS support FROM r""")
def r15_support_hint(spark, sf_dir):
    q, d, v = inputs(spark, sf_dir)
    kept = d.join(R.hybrid(q, d, v), "document_id").join(q.select("query_id", F.col("text").alias("_q")), "query_id")  # only kept texts are cut into tokens
    hit = F.arrays_overlap(T.tokens(F.col("_q")), T.tokens(F.col("text")))
    return kept.select("query_id", "document_id", R.support_hint(F.col("score"), hit).alias("support"))


_BEGIN = ["", "Table 2: ", "Summarize ", "", "accuracy of "]


@query(f"""WITH {_ROUTE_SQL}, {HYBRID_SQL.replace("q AS (", "hq AS (", 1).replace("FROM q)", "FROM hq)").replace("FROM q, embeddings", "FROM hq, embeddings")},
o AS (SELECT item_id AS query_id FROM benchmark WHERE NOT (item_id % 7 = 0 OR item_id % 5 = 2 OR (item_id % 2 = 0 AND item_id % 5 IN (1, 4)))),
u AS (SELECT query_id, document_id, 'routed' AS origin, 0 AS o FROM routed UNION ALL SELECT query_id, document_id, 'supplement', 1 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, document_id) AS r FROM cosines) WHERE r <= 8 AND query_id IN (SELECT query_id FROM o))
SELECT query_id, document_id, arg_min(origin, o) AS origin FROM u GROUP BY 1, 2""")
def r12_supplement(spark, sf_dir):
    """Questions of which some ask for a table, a metric or an overview; scopes and locks are dealt by number."""
    q, _, v = inputs(spark, sf_dir)
    near = knn.top_k(v, q.where("embedding IS NOT NULL"), R.CONTEXTS, 64)
    k = F.col("query_id")
    begin = F.element_at(F.array(*map(F.lit, _BEGIN)), (k % len(_BEGIN) + 1).cast("int"))
    asked = q.select("query_id", F.concat(begin, F.lit("of item "), k.cast("string")).alias("question"), (k % 7 == 0).alias("explicit_scope"), (k % 2 == 0).alias("locked"))
    return R.with_supplement(routed(spark, sf_dir), near, asked)


@query(f"""WITH {M.CHUNKS_SQL}, k AS (SELECT *, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 180) AS key FROM chunks)
SELECT document_id, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY project_id, key ORDER BY document_id, ordinal) AS r FROM k) WHERE r = 1""")
def t5_excerpt_dedup(spark, sf_dir):
    return R.excerpt_dedup(M.chunks(spark, sf_dir), [F.col("document_id"), F.col("ordinal")], ["project_id"]).select("document_id", "ordinal")


#: Pieces of evidence: the lines that share a token with a question, of the documents that it was routed to. Lines with a pipe count as rows of
#: their document's table, four lines as a page.
EVIDENCE_SQL = f"""{_ROUTE_SQL}, {M.CHUNKS_SQL}, qq AS (SELECT item_id AS query_id, {tokens_sql('text')} AS toks FROM benchmark),
ev AS (SELECT * FROM (SELECT r.query_id, c.document_id, c.ordinal, c.chunk_role, c.text, c.ordinal // 4 AS page, contains(c.text, '|') AS is_table, CAST(len(list_intersect(qq.toks, {tokens_sql('c.text')})) AS BIGINT) AS score FROM routed r JOIN chunks c ON c.document_id = r.document_id JOIN qq ON qq.query_id = r.query_id) WHERE score > 0)"""


def routed_few(spark, sf_dir):
    """query_id and document_id of routed documents, written and broadcast: five a question."""
    return R.small(cut(routed(spark, sf_dir).select("query_id", "document_id")))


def evidence(spark, sf_dir, few=None):
    """``few``: the routed documents, where a caller has them already. Only their texts are cut into lines."""
    few = routed_few(spark, sf_dir) if few is None else few
    c = M.chunks(spark, sf_dir, few.select("document_id")).select("document_id", "ordinal", "chunk_role", "text")
    j = few.join(c, "document_id").join(question_terms(spark, sf_dir), "query_id")
    score = F.size(F.array_intersect("terms", T.tokens(F.col("text")))).cast("long")
    return j.select("query_id", "document_id", "ordinal", "chunk_role", "text", F.floor(F.col("ordinal") / 4).alias("page"), F.contains("text", F.lit("|")).alias("is_table"), score.alias("score")).where("score > 0")


def _best():
    return [F.desc("score"), F.col("document_id"), F.col("ordinal")]


_KEY = "substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 180)"


@query(f"""WITH {EVIDENCE_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, {_KEY} ORDER BY score DESC, document_id, ordinal) AS a FROM ev), pp AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, page ORDER BY score DESC, ordinal) AS b FROM k WHERE a = 1)
SELECT query_id, document_id, ordinal FROM pp WHERE b <= 2""")
def w4_page_cap(spark, sf_dir):
    """At most two pieces a page; repeated excerpts go first, so that they don't use up a page's places."""
    once = R.excerpt_dedup(evidence(spark, sf_dir), _best(), ["query_id"])
    return R.ranked(once, ["query_id", "document_id", "page"], [F.desc("score"), F.col("ordinal")], 2, "_b").select("query_id", "document_id", "ordinal")


@query(f"""WITH {EVIDENCE_SQL}, pp AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, ordinal) = 1 AS is_first FROM ev)
SELECT query_id, document_id, ordinal, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY is_first DESC, score DESC, document_id, ordinal) AS INT) AS rank FROM pp) WHERE rank <= 8""")
def w2_best_per_table(spark, sf_dir):
    """The best piece of each document's table first, then the best of what is left, up to eight."""
    first = F.row_number().over(W.partitionBy("query_id", "document_id").orderBy(F.desc("score"), "ordinal")) == 1
    return R.ranked(evidence(spark, sf_dir).withColumn("_f", first), ["query_id"], [F.desc("_f"), *_best()], 8).select("query_id", "document_id", "ordinal", "rank")


@query(f"""WITH {EVIDENCE_SQL}, pp AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, ordinal) AS n, max(score) OVER (PARTITION BY query_id, document_id) AS best FROM ev)
SELECT query_id, document_id, ordinal, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n, best DESC, document_id) AS INT) AS rank FROM pp) WHERE rank <= 32""")
def w3_round_robin(spark, sf_dir):
    """The tables' pieces in turn, the table with the best piece first, 32 at most."""
    w = W.partitionBy("query_id", "document_id")
    e = evidence(spark, sf_dir).withColumn("_n", F.row_number().over(w.orderBy(F.desc("score"), "ordinal"))).withColumn("_s", F.max("score").over(w))
    return R.ranked(e, ["query_id"], [F.col("_n"), F.desc("_s"), F.col("document_id")], 32).select("query_id", "document_id", "ordinal", "rank")


@query(f"""WITH {EVIDENCE_SQL}, t AS (SELECT query_id, document_id, count(*) AS hits, max(score) AS best, arg_max(ordinal, {{'v': score, 'e': -ordinal}}) AS ordinal FROM ev GROUP BY 1, 2), n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS tables, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, best DESC, document_id) AS r FROM t)
SELECT query_id, document_id, ordinal FROM n WHERE tables >= 2 AND r <= 8""")
def w5_reserved_children(spark, sf_dir):
    """One piece for each of several tables that a question asks for, eight tables at most."""
    t = evidence(spark, sf_dir).groupBy("query_id", "document_id").agg(F.count("*").alias("hits"), F.max("score").alias("best"), F.max_by("ordinal", F.struct(F.col("score"), -F.col("ordinal"))).alias("ordinal"))
    n = t.withColumn("_t", F.count("*").over(W.partitionBy("query_id"))).where("_t >= 2")
    return R.ranked(n, ["query_id"], [F.desc("hits"), F.desc("best"), F.col("document_id")], 8, "_r").select("query_id", "document_id", "ordinal")


#: What a piece's structure counts, the first key of a pack's order: tables, headings, prose.
def structure(df):
    return F.when(df["is_table"], 4).when(F.length(df["text"]) < 40, 2).otherwise(0)


_STRUCTURE_SQL = "CASE WHEN is_table THEN 4 WHEN length(text) < 40 THEN 2 ELSE 0 END"


@query(f"""WITH {EVIDENCE_SQL} SELECT query_id, document_id, ordinal, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_STRUCTURE_SQL} DESC, score DESC, coalesce(chunk_role = 'child', false) DESC, document_id, ordinal) AS INT) AS position FROM ev) WHERE position <= 8""")
def t4_context_sort(spark, sf_dir):
    e = evidence(spark, sf_dir)
    child = F.coalesce(F.col("chunk_role") == "child", F.lit(False))
    return R.ranked(e.withColumn("_s", structure(e)), ["query_id"], [F.desc("_s"), F.desc("score"), child.desc(), F.col("document_id"), F.col("ordinal")], 8, "position").select("query_id", "document_id", "ordinal", "position")


@query(f"""WITH {EVIDENCE_SQL}, e AS (SELECT *, {_STRUCTURE_SQL} AS structure, document_id * 1000000 + ordinal AS piece FROM ev), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, {_KEY} ORDER BY structure DESC, score DESC, piece) AS r FROM e) WHERE r = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id || ':' || page ORDER BY structure DESC, score DESC, piece) AS c FROM a) WHERE c <= 5)
SELECT query_id, document_id, ordinal, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY structure DESC, score DESC, piece) AS INT) AS rank FROM b) WHERE rank <= 8""")
def r14_finalised_packs(spark, sf_dir):
    """Packs of eight pieces, five a page, without repeated excerpts, tables before headings before prose."""
    e = evidence(spark, sf_dir)
    piece = F.struct("document_id", "ordinal").alias("document_id")
    rows = e.select("query_id", F.concat_ws(":", "document_id", "page").alias("page"), structure(e).alias("structure"), "score", piece, "text")
    packs = EV.finalise(rows)
    return packs.select("query_id", "document_id.document_id", "document_id.ordinal", "rank")


@query(f"""WITH {M.CHUNKS_SQL}, m AS (SELECT document_id, ordinal FROM chunks WHERE contains(text, 'token =')), s AS (SELECT c.document_id, c.ordinal, max(round(CAST(10.0 - 0.000001 * (abs(c.ordinal - m.ordinal) + 1) AS DOUBLE), 6)) AS score FROM chunks c JOIN m USING (document_id) GROUP BY 1, 2)
SELECT document_id, ordinal, score FROM s""")
def r13_sibling_expansion(spark, sf_dir):
    c = M.chunks(spark, sf_dir).select("document_id", "ordinal", "text")
    near = R.nearest_mark(c, F.contains("text", F.lit("token =")), ["document_id"], "ordinal").where("distance IS NOT NULL")
    return near.select("document_id", "ordinal", F.round(10.0 - 0.000001 * (F.col("distance") + 1), 6).alias("score"))


@query()
def b1_budget_packing(spark, sf_dir):
    q, d, v = inputs(spark, sf_dir)
    rows = R.hybrid(q, d, v).join(d, "document_id").select("query_id", "rank", "document_id", T.token_estimate(F.col("text")).alias("tokens"))
    return R.pack_budget(rows, "query_id long, rank int, document_id long, used long, kind string", budget=1500)


@query(f"""WITH {HYBRID_SQL}, b AS (SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, document_id) AS r FROM lex), v AS (SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, document_id) AS r FROM cosines),
f AS (SELECT query_id, document_id, sum(1.0 / (60 + r)) AS s FROM (SELECT * FROM b WHERE r <= 50 UNION ALL SELECT * FROM v WHERE r <= 50) GROUP BY 1, 2)
SELECT query_id, document_id, round(s, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, document_id) AS k FROM f) WHERE k <= 10""")
def r_fused_ranks(spark, sf_dir):
    """Reciprocal ranks of the lexical and the vector branch, summed."""
    q, d, v = inputs(spark, sf_dir)
    texts = d.select("document_id", F.lit(0).alias("ordinal"), T.tokens(F.col("text")).alias("terms")).withColumn("weights", F.array_repeat(F.lit(1), F.size("terms")))
    b = lexical.best(texts, question_terms(spark, sf_dir), 50, lambda total, *_: total, 1.0).select("query_id", "document_id", F.col("rank").alias("r"))
    n = R.ranked(knn.top_k(v, q.where("embedding IS NOT NULL"), 50, 64), ["query_id"], [F.desc("cosine"), F.col("document_id")], 50, "r").select("query_id", "document_id", "r")
    s = b.unionByName(n).groupBy("query_id", "document_id").agg(F.round(F.sum(1.0 / (60 + F.col("r"))), 9).alias("score"))
    return R.ranked(s, ["query_id"], [F.desc("score"), F.col("document_id")], 10, "_k").select("query_id", "document_id", "score")
