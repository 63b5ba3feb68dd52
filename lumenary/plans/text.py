"""Scalar functions over texts, conversations and vectors (tokens, keys, numbers, windows, classifiers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from ..functions import vectors as V
from .registry import query, table

#: DuckDB's form of ``functions.text.tokens``.
LOWERED = r"regexp_replace(regexp_replace(regexp_replace(lower(coalesce({t}, '')), '[δ∆Δ]', 'delta ', 'g'), '\bdelta\s*h\s*[-_ ]?\s*vap\b', 'delta h vap hvap', 'g'), '\bh\s*[-_ ]?\s*vap\b', 'h vap hvap', 'g')"


def tokens_sql(t: str) -> str:
    low = LOWERED.format(t=t)
    return (
        f"list_distinct(list_concat(list_filter(regexp_extract_all({low}, '[a-z0-9_]+'), lambda w: length(w) > 1),"
        f" regexp_extract_all({low}, '[\u4e00-\u9fff]+'),"
        f" flatten(list_transform(list_filter(regexp_extract_all({low}, '[\u4e00-\u9fff]+'), lambda r: length(r) > 1), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))),"
        f" CASE WHEN list_contains(regexp_extract_all({low}, '[a-z0-9_]+'), 'hvap') THEN ['delta', 'vap'] ELSE [] END,"
        f" CASE WHEN list_has_all(regexp_extract_all({low}, '[a-z0-9_]+'), ['delta', 'vap']) THEN ['hvap'] ELSE [] END))"
    )


@query(f"SELECT doc_id, list_sort({tokens_sql('text')}) AS tokens FROM documents")
def s1_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sort_array(T.tokens(F.col("text"))).alias("tokens"))


@query(r"SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) > 1))) AS terms FROM documents")
def s1b_graph_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sort_array(T.tokens(F.col("text"), chemistry=False)).alias("terms"))


@query("SELECT conv_id, turn, len(regexp_extract_all(lower(text), '[a-z0-9\u4e00-\u9fff]+')) AS n_tokens, coalesce(regexp_extract_all(lower(text), '[a-z0-9\u4e00-\u9fff]+')[1], '') AS first_token FROM conversations")
def s1c_attachment_tokens(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn("_t", T.attachment_tokens(F.col("text")))
    return t.select("conv_id", "turn", F.size("_t").cast("long").alias("n_tokens"), F.coalesce(F.get("_t", F.lit(0)), F.lit("")).alias("first_token"))


_KEY = "regexp_replace(lower(url), '[^a-z0-9]+', '', 'g')"


@query(f"SELECT page_id, {_KEY} AS lookup_key, {_KEY} AS fact_key, {_KEY} AS scientific_key, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def s2_selector_keys(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.lookup_key(u).alias("lookup_key"), T.fact_key(u).alias("fact_key"), T.scientific_key(u).alias("scientific_key"), T.slug(u).alias("slug"))


@query(r"SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9_\-])license([^a-z0-9_\-]|$)') AS has_license, regexp_matches(lower(text), '(^|[^a-z0-9_\-])token([^a-z0-9_\-]|$)') AS has_token FROM documents")
def s3_alias_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.has_alias(F.col("text"), "license").alias("has_license"), T.has_alias(F.col("text"), "token").alias("has_token"))


@query(r"SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(text, '\[\d+\]', ' ', 'g'), '\d+(?:\.\d+)?%?'), lambda x: length(x) > 1))) AS numbers, TRY_CAST(regexp_extract(text, '-?\d+(\.\d+)?') AS DOUBLE) AS first_number FROM documents")
def s5_numbers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sort_array(T.answer_numbers(F.col("text"))).alias("numbers"), T.first_float(F.col("text")).alias("first_number"))


@query(r"""WITH w AS (SELECT doc_id, text, strpos(lower(text), 'license') - 1 AS a FROM documents)
SELECT doc_id, substr(text, CAST(CASE WHEN a < 0 THEN 0 ELSE greatest(0, a - 20) END AS INT) + 1, 80) AS excerpt FROM w""")
def s8_anchor_window(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.anchor_window(F.col("text"), F.lit("license"), 80).alias("excerpt"))


_NUM = r"[+-]?\d+(\.\d+)?%?"


@query(rf"""WITH c AS (SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) || ' ± 2.5' WHEN o_totalprice > 200000 THEN '- ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) WHEN o_totalprice > 100000 THEN o_orderpriority ELSE '12.5%' END AS cell FROM orders)
SELECT o_orderkey, regexp_matches(trim(regexp_replace(cell, '\s*(±|\+/-)\s*', ' ', 'g')), '^([+-]\s+)?{_NUM}(\s+([+-]\s+)?{_NUM})*$') AS is_numeric FROM c""")
def s13_numeric_cells(spark, sf_dir):
    return _judged_cells(table(spark, sf_dir, "orders"))


def _judged_cells(orders):
    price = F.col("o_totalprice")
    uncertain = F.concat(F.rint(price).cast("long").cast("string"), F.lit(" ± 2.5"))
    cell = F.when(price > 300000, uncertain).when(price > 200000, F.concat(F.lit("- "), F.floor(price).cast("string"))).when(price > 100000, F.col("o_orderpriority")).otherwise("12.5%")
    return orders.select("o_orderkey", T.numeric_cell(cell).alias("is_numeric"))


@query(r"""WITH t AS (SELECT doc_id, text, trim(text, E' \t\n\r') AS s FROM documents), d AS (SELECT *, length(regexp_replace(s, '[^\x{4e00}-\x{9fff}A-Za-z0-9]', '', 'g')) / greatest(length(s), 1) AS density, regexp_extract_all(text, '[A-Za-z0-9]+') AS ws FROM t)
SELECT doc_id, CASE WHEN length(s) < 40 THEN 'low' WHEN contains(s, chr(65533)) OR density < 0.28 THEN 'low' WHEN length(s) > 120 AND density >= 0.4 THEN 'high' ELSE 'medium' END AS quality,
 len(ws) >= 12 AND len(list_filter(ws, lambda w: length(w) <= 2)) >= 0.8 * len(ws) AND len(regexp_extract_all(text, '[-+=/*^;∑∫√]')) >= 8 AS is_noise,
 CAST(greatest(1, length(text) // 4) AS BIGINT) AS token_estimate, CAST(strlen(text) AS BIGINT) AS n_bytes FROM d""")
def s16_text_layer(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.text_layer_quality(t).alias("quality"), T.formula_noise(t).alias("is_noise"), T.token_estimate(t).alias("token_estimate"), F.octet_length(t).cast("long").alias("n_bytes"))


@query(r"""SELECT event_id, substr(sha256(event_type || '|' || user_id || '|value|' || props), 1, 16) AS fact_id, CAST(nullif(regexp_extract(props, '\d+'), '') AS INT) AS page_number,
 regexp_matches(props, '^[\d\s.,:%/-]+$') AS is_transient FROM events""")
def s23_fact_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.fact_id(F.col("event_type"), F.col("user_id").cast("string"), F.lit("value"), F.col("props")).alias("fact_id"), T.page_number(F.col("props")).alias("page_number"), T.transient_value(F.col("props")).alias("is_transient"))


_Q = "lower(coalesce(text, ''))"
_CONTAINS = lambda terms: "(" + " OR ".join(f"contains(q, '{t}')" for t in terms) + ")"


#: Questions of which some name tables, figures, metrics and so on: a turn's text behind one of these beginnings.
_ASKED = ["", "Compare A and B: ", "value of Table S 3, ", "parameter x 值 ", "列出所有参数 ", "Fig. 2 shows ", "why does f 1 change? ", "what is the equation? ", "展开第二张 ", "pKa error in the table: ", "Summarize ", "quote the source: ", "which method is best? ", "its limitations: ", "1. what\n2. why ", "50% of 1.5 Å "]
_ASKED_SQL = "[" + ", ".join("'" + a.replace("\n", "' || chr(10) || '") + "'" for a in _ASKED) + "]"


def asked(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    begin = F.element_at(F.array(*map(F.lit, _ASKED)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(_ASKED))) + 1).cast("int"))
    return c.select("conv_id", "turn", F.concat(begin, F.coalesce("text", F.lit(""))).alias("question"))


_TABLE_SQL = r"(regexp_matches(q, 'table\s*(s\s*)?(\d+|[ivxlcdm]+)\b') OR contains(q, '表') OR contains(q, 'tabular'))"
_FIGURE_SQL = r"(regexp_matches(q, 'figure\s*\d+') OR regexp_matches(q, 'fig\.?\s*\d+') OR contains(q, '图') OR contains(q, 'illustration') OR contains(q, 'diagram'))"
_METRIC_SQL = rf"""(contains(q, '指标') OR contains(q, '分数') OR contains(q, '得分') OR regexp_matches(q, '(^|[^a-z0-9])f\s*1([^a-z0-9]|$)') OR regexp_matches(q, '\b({C.METRICS})\b')
 OR (regexp_matches(q, '\bpka\b') AND {_CONTAINS(["table", "表", "数值", "误差", "改善", "shift", "rmse", "error", "value"])}))"""


@query(rf"""WITH x AS (SELECT conv_id, turn, {_ASKED_SQL}[(conv_id + turn) % {len(_ASKED)} + 1] || coalesce(text, '') AS question FROM conversations), y AS (SELECT conv_id, turn, lower(question) AS l, lower(trim(question, E' \t\n\r')) AS q FROM x)
SELECT conv_id, turn, CASE WHEN q = '' THEN 'needs_clarification' WHEN {_CONTAINS(C.COMPLEX)} OR len(regexp_extract_all(q, '(^|\n)\s*[1-9]\d*\.')) >= 2 THEN 'complex_multi_hop'
 WHEN {_CONTAINS(C.COMPARISON)} THEN 'multi_source_compare' WHEN {_CONTAINS(C.TABLE)} OR ({_CONTAINS(C.PARAMETER)} AND {_CONTAINS(C.PARAMETER_CONTEXT)}) OR regexp_matches(q, '\bkcal\b|å|\bangstrom\b|\d+%') THEN 'table_or_metric' WHEN {_CONTAINS(C.EVIDENCE)} THEN 'evidence_required' ELSE 'simple_rag' END AS route,
 {_TABLE_SQL} AS is_table, {_FIGURE_SQL} AS is_figure, {_METRIC_SQL} AS is_metric, regexp_matches(q, '\b(formula|equation|eq\.)\b') OR contains(q, '公式') AS is_formula,
 regexp_matches(q, '{C.TABLE_REFERENCE}') AS is_table_reference, {_CONTAINS(C.CROSS_PAPER).replace("(q,", "(l,")} AS is_cross_paper, {_CONTAINS(C.DIFFERENCE).replace("(q,", "(l,")} AS is_difference, {_CONTAINS(C.LIMITATION)} AS is_limitation,
 {_CONTAINS(C.HIGH_RISK)} AS is_high_risk, {_CONTAINS(C.NEEDS_SOURCE)} AS needs_source,
 NOT ({_TABLE_SQL} OR {_METRIC_SQL} OR {_FIGURE_SQL}) AND NOT {_CONTAINS(C.OVERVIEW_MARKERS)} AND ({_CONTAINS(C.CAUSAL)} OR regexp_matches(q, '\bwhy\b|\bmechanism\b')) AS is_mechanism FROM y""")
def c_question_classes(spark, sf_dir):
    t = F.col("question")
    flags = {"is_table": C.is_table, "is_figure": C.is_figure, "is_metric": C.is_metric, "is_formula": C.is_formula, "is_table_reference": C.is_table_reference, "is_cross_paper": C.is_cross_paper, "is_difference": C.is_difference, "is_limitation": C.is_limitation, "is_high_risk": C.high_risk, "needs_source": C.needs_source, "is_mechanism": C.is_mechanism}
    return asked(spark, sf_dir).select("conv_id", "turn", C.route(t).alias("route"), *[f(t).alias(n) for n, f in flags.items()])


@query(rf"""WITH x AS (SELECT conv_id, turn, {_ASKED_SQL}[(conv_id + turn) % {len(_ASKED)} + 1] AS b, {_ASKED_SQL}[(conv_id + turn) % {len(_ASKED)} + 1] || coalesce(text, '') AS q FROM conversations)
SELECT conv_id, turn, CASE b WHEN 'value of Table S 3, ' THEN 'Table S 3' WHEN 'Fig. 2 shows ' THEN 'Fig. 2' END AS first_anchor, CAST(CASE WHEN b IN ('value of Table S 3, ', 'Fig. 2 shows ') THEN 1 ELSE 0 END AS INT) AS n_anchors FROM x""")
def c_question_anchors(spark, sf_dir):
    a = C.figure_table_anchors(F.col("question"))
    return asked(spark, sf_dir).select("conv_id", "turn", F.get(a, F.lit(0)).alias("first_anchor"), F.size(a).alias("n_anchors"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS ordinal FROM documents), s AS (SELECT doc_id, ordinal, trim(t, E' \t\n\r\x0b\f') AS s FROM l),
w AS (SELECT *, CASE WHEN regexp_matches(s, '^#+\s+') THEN '' ELSE s END AS u, len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')) AS n FROM s)
SELECT doc_id, ordinal, s = '' OR (NOT (length(u) >= 50 AND (n >= 8 OR length(regexp_replace(u, '[^\x{4e00}-\x{9fff}]', '', 'g')) >= 20)) AND (length(s) < 50 OR n < 8)) AS heading_only FROM w""")
def c_heading_only(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "t"))
    return lines.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), C.heading_only(F.col("t")).alias("heading_only"))


@query("""WITH s AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, q FROM embeddings, s)
SELECT vec_id, round(CASE WHEN list_inner_product(e, e) = 0 OR list_inner_product(q, q) = 0 THEN 0 ELSE list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q))) END, 6) + 0.0 AS cosine,
 len(e) = 64 AS is_valid, round(sqrt(list_inner_product(e, e)), 5) AS norm FROM d""")
def m1_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    seed = e.orderBy("vec_id").select(F.col("embedding").alias("_q")).limit(1)  # one row
    return e.join(F.broadcast(seed)).select("vec_id", (F.round(V.cosine(F.col("embedding"), F.col("_q")), 6) + 0.0).alias("cosine"), V.valid(F.col("embedding"), 64).alias("is_valid"), F.round(V.norm(F.col("embedding")), 5).alias("norm"))


@query("""SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))))), 5) AS l1, round(greatest(0.0, 10 * (1 - greatest(CAST(embedding[1] AS DOUBLE), 0.0))), 5) AS score FROM embeddings""")
def m2_normalise(spark, sf_dir):
    n = V.normalised(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + F.abs(x)), 5).alias("l1"), F.round(V.distance_score(F.col("embedding")[0].cast("double")), 5).alias("score"))
