"""Passages and answers: predicates, snippets, headings, citations, guards, profiles and coverage audits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import citations as CI
from ..functions import normalise as N
from ..functions import text as T
from ..operators import fidelity as FI
from ..operators import answers as AN
from ..operators import chunking
from ..operators import evidence as E
from ..operators import retrieval as R
from ..operators import tables as TB
from . import model as M
from .registry import query, table
from .retrieval import HYBRID_SQL, inputs
from .tables import CELLS_SQL, cells, markdown


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) SELECT doc_id, count(*) FILTER (trim(t) = '') = 0 OR doc_id % 4 = 0 AS has_span FROM l GROUP BY 1""")
def f7_span_validity(spark, sf_dir):
    """Lines as spans, of which blank ones have no line of their own; every fourth document's have a page all the same."""
    d = table(spark, sf_dir, "documents")
    spans = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.when(F.trim(x) != "", i).alias("line_start"), F.when(F.col("doc_id") % 4 == 0, 0).alias("page_index"), F.lit("x").alias("kind")))
    return d.select("doc_id", E.valid_spans(spans, ["line_start", "page_index", "kind"]).alias("has_span"))


@query(f"WITH {CELLS_SQL} SELECT DISTINCT table_id, length(table_id) % 3 <> 0 AS has_data, length(table_id) % 3 = 1 AS has_data_without_separator, length(table_id) % 3 = 1 AS has_metric FROM cells")
def f9_table_data(spark, sf_dir):
    """Tables whole, without their digits, or without their body; the second have data only behind a separator row."""
    m = markdown(spark, sf_dir)
    kind = F.length("table_id") % 3
    text = F.when(kind == 0, F.substring_index("markdown", "\n", 2)).when(kind == 2, F.regexp_replace("markdown", "[0-9]", "x")).otherwise(F.concat(F.lit("accuracy\n"), "markdown"))
    bare = F.regexp_replace(text, r"\n\|[-|]+\|\n?", "\n")
    return m.select("table_id", T.table_data(text).alias("has_data"), T.table_data(bare).alias("has_data_without_separator"), T.metric_numbers(text).alias("has_metric"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), f AS (SELECT doc_id, i, CASE WHEN contains(t, '|') THEN 'table-' || i WHEN contains(t, '@') THEN 'meta-' || i END AS x FROM l)
SELECT d.doc_id, arg_min(x, i) FILTER (x IS NOT NULL) AS table_id FROM documents d LEFT JOIN f USING (doc_id) GROUP BY 1""")
def f14_first_identifier(spark, sf_dir):
    """Lines as spans: rows of tables name theirs, lines with an address have one in their metadata."""
    number = lambda p, i: F.concat(F.lit(p), i.cast("string"))
    span = lambda x, i: F.struct(F.when(F.contains(x, F.lit("|")), number("table-", i)).otherwise(F.lit("")).alias("table_id"), F.create_map(F.lit("table_id"), F.when(F.contains(x, F.lit("@")), number("meta-", i))).alias("metadata"))
    return table(spark, sf_dir, "documents").select("doc_id", E.first_identifier(F.transform(F.split("text", "\n"), span), "table_id").alias("table_id"))


@query("""SELECT c.conv_id, c.turn, e.event_id FROM conversations c JOIN events e ON e.user_id = c.conv_id JOIN customer k ON k.c_custkey = e.user_id WHERE c.role = 'user' AND e.event_type = 'purchase'""")
def j4_session_attachments(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn")
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("conv_id"), "event_id")
    return c.join(e, "conv_id").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("conv_id")), "conv_id", "left_semi")


@query(f"""WITH {M.CHUNKS_SQL}, h AS (SELECT document_id, ordinal, CASE WHEN length(text) < 40 THEN text END AS heading FROM chunks)
SELECT document_id, ordinal, last(heading IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS path FROM h""")
def w9_heading_propagation(spark, sf_dir):
    w = W.partitionBy("document_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    return M.chunks(spark, sf_dir).select("document_id", "ordinal", F.last(F.when(F.length("text") < 40, F.col("text")), ignorenulls=True).over(w).alias("path"))


@query()
def w6_required_slots(spark, sf_dir):
    q, d, v = inputs(spark, sf_dir)
    kind = F.when(F.contains("text", F.lit("|")), "table").when(F.contains("text", F.lit("%%%")), "formula").otherwise("prose")
    ranked = R.hybrid(q, d, v).join(d, "document_id").select("query_id", "rank", kind.alias("kind"), "document_id")
    return chunking.required_slots(ranked, "query_id long, rank int, kind string, document_id long", 4)


@query("""WITH c AS (SELECT conv_id AS query_id, CAST(turn AS INT) AS position, role || ':' || (turn // 12) AS page, text AS excerpt, CAST(length(text) AS DOUBLE) AS score FROM conversations),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, page, excerpt ORDER BY position) AS a FROM c), n AS (SELECT *, count(*) OVER (PARTITION BY query_id, page) AS n FROM f WHERE a = 1),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id, page, substr(trim(excerpt), 1, 120) ORDER BY score DESC, position) AS b FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, page ORDER BY score DESC, position) AS r FROM h WHERE n <= 2 OR b = 1)
SELECT query_id, position FROM r WHERE n <= 2 OR r <= 2""")
def t6_citation_dedup(spark, sf_dir):
    """Turns as citations of pages of twelve; none is a table, so that two a page stay."""
    c = table(spark, sf_dir, "conversations")
    page = F.concat("role", F.lit(":"), F.floor(F.col("turn") / 12).cast("string"))
    rows = c.select(F.col("conv_id").alias("query_id"), F.col("turn").cast("int").alias("position"), page.alias("page"), F.col("text").alias("excerpt"), F.length("text").cast("double").alias("score"), F.lit(False).alias("is_table"), F.lit(None).cast("string").alias("table_id"))
    return AN.dedup_citations(rows).select("query_id", "position")


@query(f"""WITH {HYBRID_SQL}, a AS (SELECT query_id, document_id, min(o) AS o FROM (SELECT query_id, document_id, rank AS o FROM hybrid WHERE rank <= 4 UNION ALL SELECT query_id, document_id, 100 + rank FROM hybrid) GROUP BY 1, 2)
SELECT query_id, document_id, idx FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o) AS INT) AS idx FROM a) WHERE idx <= 15""")
def u3_merged_packs(spark, sf_dir):
    """Two packs merged, what is in both once, numbered anew from 1."""
    h = R.hybrid(*inputs(spark, sf_dir))
    both = h.where("rank <= 4").select("query_id", "document_id", F.col("rank").alias("o")).unionByName(h.select("query_id", "document_id", (F.col("rank") + 100).alias("o")))
    return R.ranked(both.groupBy("query_id", "document_id").agg(F.min("o").alias("o")), ["query_id"], [F.col("o")], 15, "idx").select("query_id", "document_id", "idx")


@query(r"""SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9\-])license([^a-z0-9\-]|$)') AS has_license, regexp_matches(text, '(^|[^0-9.])2\.0([^0-9.]|\.[^0-9]|\.?$)') AS has_version FROM documents""")
def s4_term_matching(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.selector_in_text("license", F.col("text")).alias("has_license"), T.term_matches("2.0", F.col("text")).alias("has_version"))


_M = "CASE WHEN ({n}) % 2 = 1 AND ({n}) < 8 THEN '[' || ({n}) // 2 || ']' ELSE '' END"


@query(rf"""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[][]', '', 'g') AS x FROM conversations) SELECT conv_id, turn, x || ' ' || {_M.format(n="turn")} || ' ' || {_M.format(n="turn + 1")} || ' ' || {_M.format(n="turn")} || {_M.format(n="turn + 2")} || ' named ' AS renumbered,
 CASE WHEN trim(x) = '' THEN x ELSE regexp_replace(x, '\s+$', '') || CASE WHEN regexp_matches(x, '[ \n]$') THEN '' ELSE ' ' END || '[0]' END AS ensured FROM t""")
def s7_citation_markers(spark, sf_dir):
    """Turns with markers of several forms: contexts 1, 3, 5 and 7 are returned as 0 to 3, other markers vanish."""
    x = F.regexp_replace("text", r"[\[\]]", "")
    n = lambda k: (F.col("turn") + k).cast("string")
    answer = F.concat(x, F.lit(" ["), n(0), F.lit("] [["), n(1), F.lit("]] ["), n(0), F.lit(", "), n(2), F.lit("] [[named]] [[sources/a.md]][label]"))
    selected = F.array(*map(F.lit, (1, 3, 5, 7)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", CI.renumbered(answer, selected).alias("renumbered"), CI.ensured(x, F.lit(1)).alias("ensured"))


@query("""SELECT doc_id, CASE WHEN length(text) >= 60 AND doc_id % 60 >= 8 THEN substr(text, CAST(doc_id % 60 AS INT) + 1) ELSE text END AS rest FROM documents""")
def s9_overlap_removal(spark, sf_dir):
    """A text behind a piece that ends in its first characters, up to 59; fewer than eight are no overlap."""
    t = F.col("text")
    before = F.when(F.length(t) >= 60, F.concat(F.lit("\u0001"), F.substring(t, F.lit(1), (F.col("doc_id") % 60).cast("int")))).otherwise(F.lit("\u0001"))
    return table(spark, sf_dir, "documents").select("doc_id", T.without_overlap(before, t, 8, 60).alias("rest"))


_HEADERS = [" F1", " AUC", "  precision 2", " Recall", " size", ""]


@query(f"""SELECT p_partkey, CASE WHEN p_size % 6 < 4 THEN trim(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END) END AS dataset, CASE WHEN p_size % 5 <> 0 THEN CASE p_size % 6 WHEN 0 THEN 'F1' WHEN 1 THEN 'AUC' WHEN 2 THEN 'precision' WHEN 3 THEN 'Recall' END END AS metric FROM part""")
def s15_metric_headers(spark, sf_dir):
    """Headers of a brand and a metric; every fifth has "Method" for a brand, which is no dataset."""
    end = F.element_at(F.array(*map(F.lit, _HEADERS)), (F.col("p_size") % 6 + 1).cast("int"))
    dataset, metric = T.metric_header(F.concat(F.when(F.col("p_size") % 5 == 0, "Method").otherwise(F.col("p_brand")), end))
    return table(spark, sf_dir, "part").select("p_partkey", dataset.alias("dataset"), metric.alias("metric"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?。！？\n]+[.!?。！？]?'), lambda x: trim(x)), lambda x: x <> '') AS ss FROM documents), f AS (SELECT doc_id, list_filter(ss, lambda s: length(s) >= 6 AND regexp_matches(lower(s), '""" + T.FACT_VALUE + "|" + "|".join(T.FACT_MARKERS) + r"""')) AS fs FROM s)
SELECT doc_id, CAST(least(12, len(list_distinct(fs))) AS INT) AS n_facts, fs[1] AS first_fact FROM f""")
def s22_key_facts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("_f", T.key_facts(F.col("text")))
    return d.select("doc_id", F.size("_f").alias("n_facts"), F.get("_f", F.lit(0)).alias("first_fact"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'x ' || CAST(floor(o_totalprice) AS BIGINT) || '.5' WHEN 1 THEN '12.5 ± ' || (o_orderkey % 10) WHEN 2 THEN 'C_6 ' || o_orderstatus END AS cell FROM orders")
def s12_table_cells(spark, sf_dir):
    """Cells as OCR leaves them, in plain form."""
    number = F.concat(F.lit(r"\mathrm{x} "), F.floor("o_totalprice").cast("string"), F.lit(" . 5"))
    uncertain = F.concat(F.lit(r"12. 5 $\pm$ "), (F.col("o_orderkey") % 10).cast("string"), F.lit(" "))
    nested = F.concat(F.lit(r"\mathbf{\text{C}_{6}}  "), "o_orderstatus")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, number).when(F.col("o_orderkey") % 3 == 1, uncertain).otherwise(nested).alias("c"))
    return o.select("o_orderkey", N.table_cells("c").alias("cell"))


@query()
def s18_match_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.match_texts("text").alias("match_text"))


@query("SELECT event_id, round_even(value, 1) AS rounded, CAST(greatest(0, least(100, floor(value))) AS BIGINT) AS percent, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def m4_rounding(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.bround("value", 1).alias("rounded"), F.greatest(F.lit(0), F.least(F.lit(100), F.floor("value"))).alias("percent"), F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("""WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'), x AS (SELECT conv_id, turn, list_slice(list_distinct(list_concat(regexp_extract_all(text, '\\d+(?:\\.\\d+)?'), regexp_extract_all(text, '[A-Z]{2,5}'))), 1, 10) AS anchors FROM a) SELECT conv_id, turn, CAST(len(anchors) AS INT) AS n_anchors FROM x""".replace("\\\\", "\\"))
def v4b_evidence_anchors(spark, sf_dir):
    both = F.concat(F.regexp_extract_all("text", F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), F.regexp_extract_all("text", F.lit("[A-Z]{2,5}"), F.lit(0)))
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.size(F.slice(F.array_distinct(both), 1, 10)).alias("n_anchors"))


_NUMS = r"list_distinct(list_transform(list_filter(regexp_extract_all(regexp_replace({}, '\[\d+\]', ' ', 'g'), '\d+(?:\.\d+)?%?'), lambda x: length(x) > 1), lambda x: replace(x, '%', '')))"


@query(rf"""WITH c AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') || ' Table ' || turn AS evidence FROM conversations), d AS (SELECT conv_id, turn, evidence, text || ' ' || evidence AS draft, CASE turn % 4 WHEN 0 THEN text || ' ' || evidence WHEN 1 THEN text WHEN 2 THEN text || ' ' || evidence || ' 98765' ELSE replace(text || ' ' || evidence, 'Table', 'No.') END AS synthesis FROM c),
n AS (SELECT *, {_NUMS.format("draft")} AS dn, {_NUMS.format("evidence")} AS en, {_NUMS.format("synthesis")} AS sn FROM d)
SELECT conv_id, turn, CASE WHEN len(list_filter(dn, lambda x: list_contains(en, x) AND NOT list_contains(sn, x))) > 0 THEN 'draft_fidelity' WHEN len(list_filter(sn, lambda x: NOT list_contains(en, x))) > 0 THEN 'unsupported_numbers'
 WHEN turn % 4 IN (1, 3) AND NOT regexp_matches(lower(synthesis), 'table\s*' || turn || '([^0-9]|$)') THEN 'table_labels' WHEN turn % 5 = 0 THEN 'expected_facts' END AS reason FROM n""")
def v3_fidelity_guard(spark, sf_dir):
    """Drafts of a turn and its evidence, the turn before, against syntheses that keep, lose or add to them."""
    before = F.coalesce(F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    c = table(spark, sf_dir, "conversations").withColumn("_e", F.concat(before, F.lit(" Table "), F.col("turn").cast("string")))
    draft = F.concat("text", F.lit(" "), "_e")
    kind = F.col("turn") % 4
    synthesis = F.when(kind == 0, draft).when(kind == 1, F.col("text")).when(kind == 2, F.concat(draft, F.lit(" 98765"))).otherwise(F.replace(draft, F.lit("Table"), F.lit("No.")))
    return c.select("conv_id", "turn", AN.guard(draft, F.col("_e"), synthesis, F.when(F.col("turn") % 5 == 0, 1).otherwise(0)).alias("reason"))


@query("""WITH a AS (SELECT conv_id, turn, text, conv_id + turn AS k FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CASE WHEN k % 11 = 0 THEN 'evidence_insufficient' WHEN trim(coalesce(text, '')) = '' OR k % 7 = 0 THEN 'empty_answer' WHEN k % 5 = 0 THEN 'no_citations' WHEN k % 13 = 0 THEN 'rag_contradicted' WHEN k % 3 = 0 THEN 'draft_verify_retry' WHEN k % 2 = 0 AND turn % 4 = 1 THEN 'coverage_partial' END AS reason FROM a""")
def v2_draft_gate(spark, sf_dir):
    """Answers as drafts; what the tables don't have of a draft is dealt by number."""
    k = F.col("conv_id") + F.col("turn")
    answer = F.when(k % 7 == 0, " \n").otherwise(F.col("text"))
    reason = AN.draft_reason(k % 11 == 0, answer, (k % 5).cast("int"), F.when(k % 13 == 0, "contradicted").otherwise("supported"), k % 3 == 0, F.when(k % 2 == 0, "table_or_metric").otherwise("simple_rag"), F.when(F.col("turn") % 4 == 1, "partial").otherwise("unknown"))
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", reason.alias("reason"))


@query(f"""WITH {CELLS_SQL}, x AS (SELECT DISTINCT c.table_id, c.row_label, y.name FROM cells c, (VALUES ('early'), ('middle'), ('late')) y(name)), g AS (SELECT x.table_id, count(*) AS expected, count(*) FILTER (c.n IS NULL) AS missing FROM x LEFT JOIN cells c ON c.table_id = x.table_id AND c.row_label = x.row_label AND c.column_name = x.name GROUP BY 1)
SELECT table_id, expected, missing, CASE WHEN missing > 0 THEN 'missing' ELSE 'complete' END AS status FROM g""")
def v4_expected_facts(spark, sf_dir):
    """The inventory of a table, each of its rows in each column, against the facts that its Markdown yields."""
    m = markdown(spark, sf_dir)
    f = TB.facts(m)
    labels = m.select("table_id", F.explode(F.transform(F.slice(TB.grid(F.col("markdown")), 2, 1000), lambda r: r[0])).alias("row_label"))
    requested = labels.select("table_id", "row_label", F.explode(F.array(*map(F.lit, ("early", "middle", "late")))).alias("column_name"))
    ids = m.select("table_id", F.xxhash64("table_id").alias("query_id"))
    status = AN.expected_facts(requested.join(ids, "table_id"), f.join(ids, "table_id"))
    return status.join(ids, "query_id").select("table_id", "expected", "missing", "status")


@query(f"WITH {CELLS_SQL}, m AS (SELECT table_id, max(row_label) AS last FROM cells GROUP BY 1) SELECT table_id, column_name, count(*) AS n, CAST(count(*) FILTER (row_label = last AND length(table_id) % 2 = 0) AS INT) AS lost FROM cells JOIN m USING (table_id) GROUP BY 1, 2")
def c8_source_fidelity(spark, sf_dir):
    """Cells of the source against the facts of the tables made of them; every other table comes without its last row."""
    source = cells(spark, sf_dir).select("table_id", "row_label", "column_name", F.col("n").cast("string").alias("value"))
    cut = F.when(F.length("table_id") % 2 == 0, F.regexp_replace("markdown", r"\n[^\n]*$", "")).otherwise(F.col("markdown"))
    facts = TB.facts(markdown(spark, sf_dir).withColumn("markdown", cut)).select("table_id", "row_label", "column_name", "value").withColumn("_f", F.lit(1))
    j = source.join(facts, ["table_id", "row_label", "column_name", "value"], "left")
    return j.groupBy("table_id", "column_name").agg(F.count("*").alias("n"), F.count_if(F.col("_f").isNull()).cast("int").alias("lost"))


@query()
def c5_packed_snippets(spark, sf_dir):
    """Sentences of all documents packed into snippets of 320 characters; a longer sentence stands alone."""
    return chunking.snippets(table(spark, sf_dir, "documents"), 320)


@query("""SELECT source AS document_id, CAST(sum(CAST('0x' || substr(sha256(doc_id || ':' || sha256(text)), 1, 12) AS BIGINT)) AS VARCHAR) AS text_hash, count(*) AS n_parts FROM documents GROUP BY 1""")
def c13_profile_hash(spark, sf_dir):
    """What a profile was made of, to tell when it must be made anew: a sum of hashes, which merges on the map side and needs
    no order, so that a document of any number of parts is no one task's."""
    part = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2(F.col("text").cast("binary"), 256)).cast("binary"), 256)
    d = table(spark, sf_dir, "documents").select("source", F.conv(F.substring(part, 1, 12), 16, 10).cast("decimal(38,0)").alias("h"))
    return d.groupBy(F.col("source").alias("document_id")).agg(F.sum("h").cast("string").alias("text_hash"), F.count("*").alias("n_parts"))


@query(f"WITH {CELLS_SQL} SELECT table_id, CAST(count(*) + count(DISTINCT row_label) + 4 AS BIGINT) AS n_cells FROM cells GROUP BY 1")
def src5_html_table_grid(spark, sf_dir):
    """Cells of the tables rendered as HTML and read again; empty cells of the grid are left out."""
    import pyarrow as pa

    g = markdown(spark, sf_dir).select("table_id", TB.grid(F.col("markdown")).alias("g"))
    row = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))), ""), F.lit("</tr>"))
    html = g.select("table_id", F.concat(F.lit("<table><tbody>"), F.array_join(F.transform("g", row), ""), F.lit("</tbody></table>")).alias("html"))

    def run(batches):
        for b in batches:
            rows = [(k, *c[1:]) for k, h in zip(*(c.to_pylist() for c in b.columns), strict=True) for c in TB.html_cells(h)]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["table_id", "row_index", "column_index", "rowspan", "colspan", "is_header", "text"])

    c = html.mapInArrow(run, "table_id string, row_index int, column_index int, rowspan int, colspan int, is_header boolean, text string")
    return c.where("text <> '-'").groupBy("table_id").agg(F.count("*").alias("n_cells"))


_PAIRS_SQL = M.CHUNKS_SQL + """, l AS (SELECT document_id, ordinal, text, ordinal // 2 AS k, sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY ordinal) - length(text) - 1 AS b FROM chunks),
p AS (SELECT document_id, k, string_agg(text, chr(10) ORDER BY ordinal) AS text, min(b) AS b, max(b + length(text) + 1) AS e, document_id + k AS n FROM l GROUP BY 1, 2),
c AS (SELECT document_id, k, text, CASE WHEN n % 17 = 1 THEN b + 1 ELSE b END AS b, e, n FROM p WHERE n % 11 <> 3),
lagged AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY document_id ORDER BY b, e, k), 0) AS before FROM c),
f AS (SELECT document_id, 'child_embedding_text_differs_from_source_text' AS reason FROM c WHERE n % 13 = 5 UNION ALL SELECT document_id, 'child_token_count_mismatch' FROM c WHERE n % 7 = 2
 UNION ALL SELECT document_id, 'child_token_limit_exceeded' FROM c WHERE greatest(1, length(text) // 4) > 600
 UNION ALL SELECT document_id, CASE WHEN e <= b THEN 'empty_part' WHEN b > before THEN 'gap_before_part' ELSE 'overlap_with_part_before' END FROM lagged WHERE e <= b OR b <> before
 UNION ALL SELECT w.document_id, CASE WHEN m.e IS NULL THEN 'no_part' ELSE 'end_not_covered' END FROM (SELECT document_id, max(e) AS e FROM p GROUP BY 1) w LEFT JOIN (SELECT document_id, max(e) AS e FROM c GROUP BY 1) m USING (document_id) WHERE m.e IS NULL OR m.e < w.e
 UNION ALL SELECT l.document_id, 'narrative_source_unit_not_reconstructable' FROM l LEFT JOIN c ON c.document_id = l.document_id AND c.k = l.k AND c.b <= l.b WHERE length(l.text) > 0 AND c.k IS NULL)"""


@query(f"WITH {_PAIRS_SQL} SELECT document_id, reason, count(*) AS n FROM f GROUP BY 1, 2")
def c8_audited_chunks(spark, sf_dir):
    """Children of two lines each against their documents; by their number some are lost, moved, miscounted or changed."""
    c = M.chunks(spark, sf_dir).select("document_id", "ordinal", "text")
    begin = F.sum(F.length("text") + 1).over(W.partitionBy("document_id").orderBy("ordinal")) - F.length("text") - 1
    lines = c.withColumns({"begin": begin, "k": F.floor(F.col("ordinal") / 2)})
    pairs = lines.groupBy("document_id", "k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias("text"), F.min("begin").alias("begin"), F.max(F.col("begin") + F.length("text") + 1).alias("end"))  # two lines
    wholes = pairs.groupBy("document_id").agg(F.max("end").alias("length"))
    n = F.col("document_id") + F.col("k")
    children = pairs.where(n % 11 != 3).select(
        "document_id", F.col("k").alias("chunk_id"), F.lit("narrative").alias("block_type"), "text", (F.col("begin") + F.when(n % 17 == 1, 1).otherwise(0)).alias("begin"), "end",
        F.concat("text", F.when(n % 13 == 5, "x").otherwise("")).alias("embedding_text"), (T.token_estimate(F.col("text")) + F.when(n % 7 == 2, 1).otherwise(0)).alias("token_count"),
    )
    units = lines.where("length(text) > 0").select("document_id", F.col("ordinal").alias("unit_id"), F.lit("narrative").alias("block_type"), "begin", (F.col("begin") + F.length("text")).alias("end"), "text")
    found = FI.texts(children).select("document_id", "reason").unionByName(FI.tiling(wholes, children.withColumnRenamed("chunk_id", "source_id"), ["document_id"]).select("document_id", "reason")).unionByName(FI.units(units, children).select("document_id", "reason"))
    return found.groupBy("document_id", "reason").agg(F.count("*").alias("n"))


@query()
def s18_source_spans(spark, sf_dir):
    """Each document's third line, found in the document as it is read for matching: the span is that of the line, or of an earlier
    place that reads alike. tests/test_matching.py holds all of them against a plain reading."""
    d = table(spark, sf_dir, "documents").withColumn("_line", F.get(F.split("text", "\n"), F.lit(2))).where("_line IS NOT NULL")
    return d.select("doc_id", N.source_spans("text", "_line").alias("_s")).select("doc_id", "_s.begin", "_s.end")


@query()
def s19_copied_lines(spark, sf_dir):
    """Whether a line copies most of the next one of its document: neighbours, as a prefix and its child are."""
    c = M.chunks(spark, sf_dir).select("document_id", "ordinal", "text")
    after = F.lead("text").over(W.partitionBy("document_id").orderBy("ordinal"))
    return c.withColumn("_next", after).where("_next IS NOT NULL").select("document_id", "ordinal", chunking.copied_children("text", "_next").alias("copied"))
