"""Tables as data: facts of generated Markdown tables against the figures they were made of, and checks of grids."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B
from ..operators import planner as PL
from ..operators import structures as ST
from ..operators import table_facts as TF
from ..operators import tables as O
from .registry import query, table


def cells(spark, sf_dir):
    """Per nation (a table), status (a row) and year band (a column): numbers of orders."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    band = F.when(F.year("o_orderdate") < 1996, "early").when(F.year("o_orderdate") < 2000, "middle").otherwise("late")
    return o.groupBy(F.col("n_name").alias("table_id"), F.col("o_orderpriority").alias("row_label"), band.alias("column_name")).agg(F.count("*").alias("n"))


CELLS_SQL = """cells AS (SELECT n_name AS table_id, o_orderpriority AS row_label, CASE WHEN year(o_orderdate) < 1996 THEN 'early' WHEN year(o_orderdate) < 2000 THEN 'middle' ELSE 'late' END AS column_name, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"""


def markdown(spark, sf_dir):
    """The cells as Markdown tables, two rows of the same label in turn with a blank label."""
    wide = cells(spark, sf_dir).groupBy("table_id", "row_label").pivot("column_name", ["early", "middle", "late"]).agg(F.first("n"))
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    line = F.concat(F.lit("| "), F.col("row_label"), F.lit(" | "), value("early"), F.lit(" | "), value("middle"), F.lit(" | "), value("late"), F.lit(" |"))
    rows = wide.groupBy("table_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_label", line.alias("line")))), lambda r: r["line"]), "\n").alias("body"))
    return rows.select("table_id", F.concat(F.lit("| priority | early | middle | late |\n|---|---|---|---|\n"), F.col("body")).alias("markdown"))


@query(f"WITH {CELLS_SQL} SELECT table_id, row_label, column_name, CAST(n AS VARCHAR) AS value, substr(sha256(table_id || '|' || row_label || '|' || column_name || '|' || n), 1, 16) AS fact_id FROM cells")
def k2_table_facts(spark, sf_dir):
    f = O.facts(markdown(spark, sf_dir))
    return f.select("table_id", "row_label", "column_name", "value", T.fact_id(F.col("table_id"), F.col("row_label"), F.col("column_name"), F.col("value")).alias("fact_id"))


@query(f"WITH {CELLS_SQL} SELECT table_id, CAST(count(DISTINCT row_label) AS INT) AS row_count FROM cells GROUP BY 1")
def k1_assembled_tables(spark, sf_dir):
    """Tables cut into two chunks, the header repeated, and put together again."""
    m = markdown(spark, sf_dir).withColumn("_l", F.split("markdown", "\n"))
    head = F.slice("_l", 1, 2)
    parts = F.array(F.concat(F.array(F.lit("Orders by priority")), F.slice("_l", 1, 4)), F.concat(head, F.slice("_l", 5, 1000)))
    chunks = m.select(F.lit(1).cast("long").alias("document_id"), F.lit("v1").alias("parse_version"), "table_id", F.posexplode(parts).alias("ordinal", "_p")).select("document_id", "parse_version", "table_id", "ordinal", F.concat_ws(":", "table_id", "ordinal").alias("chunk_id"), F.array_join("_p", "\n").alias("text"))
    return O.assemble(chunks).select("table_id", "row_count")


@query(f"""WITH {CELLS_SQL}, w AS (SELECT table_id, row_label, max(n) FILTER (column_name = 'early') AS e, max(n) FILTER (column_name = 'middle') AS m, max(n) FILTER (column_name = 'late') AS l FROM cells GROUP BY 1, 2)
SELECT table_id, row_label AS model, 'NYT' AS dataset, CAST(e AS VARCHAR) AS f1, CAST(m AS VARCHAR) AS auc, NULL::VARCHAR AS recall FROM w WHERE e IS NOT NULL OR m IS NOT NULL UNION ALL SELECT table_id, row_label, 'WEB', NULL, NULL, CAST(l AS VARCHAR) FROM w WHERE l IS NOT NULL""")
def k3_metric_columns(spark, sf_dir):
    """Tables whose columns are called by datasets and metrics."""
    m = markdown(spark, sf_dir).withColumn("markdown", F.replace("markdown", F.lit("| priority | early | middle | late |"), F.lit("| Model | NYT F1 | nyt  auc 2 | WEB Recall |")))
    v = F.col("values")
    return O.metric_values(m).select("table_id", "model", "dataset", v["F1"].alias("f1"), v["AUC"].alias("auc"), v["Recall"].alias("recall"))


@query("SELECT DISTINCT l_returnflag AS row_label, l_linestatus AS column_name, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value FROM lineitem")
def k4_fact_dedup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("row_label"), F.col("l_linestatus").alias("column_name"), F.col("l_quantity").cast("long").cast("string").alias("value")).dropDuplicates()


@query(f"WITH {CELLS_SQL} SELECT table_id, string_agg(row_label || ' ' || column_name || ': ' || n, '; ' ORDER BY row_label, column_name) AS answer FROM cells GROUP BY 1")
def k5_table_answer(spark, sf_dir):
    f = O.facts(markdown(spark, sf_dir)).withColumn("_x", F.concat("row_label", F.lit(" "), "column_name", F.lit(": "), "value"))
    return f.groupBy("table_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_label", "column_name", "_x"))), lambda r: r["_x"]), "; ").alias("answer"))


@query("""WITH c AS (SELECT CAST(user_id AS VARCHAR) AS table_id, event_id % 7 AS r, event_id % 5 AS c FROM events WHERE event_type = 'error'), k AS (SELECT table_id, r, c, count(*) AS n FROM c GROUP BY 1, 2, 3)
SELECT table_id, 'overlap' AS code, count(*) AS n FROM k WHERE n > 1 GROUP BY 1 UNION ALL SELECT table_id, 'gap', (max(r) + 1) * (max(c) + 1) - count(*) FROM k GROUP BY 1 HAVING (max(r) + 1) * (max(c) + 1) - count(*) > 0""")
def c10_grid_checks(spark, sf_dir):
    c = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").cast("string").alias("table_id"), (F.col("event_id") % 7).alias("row_index"), (F.col("event_id") % 5).alias("column_index"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"))
    return O.validate(c)


@query("""WITH v AS (SELECT o_orderpriority AS grp, o_orderstatus AS variant, round(avg(o_totalprice), 2) AS a, count(*) AS b FROM orders GROUP BY 1, 2), f AS (SELECT grp, arg_max({'a': a, 'b': b, 'variant': variant}, {'s': a + b, 'v': variant}) AS m FROM v GROUP BY 1)
SELECT v.grp, v.variant, v.a < m.a AND v.b < m.b AS lower_on_all FROM v JOIN f USING (grp) WHERE v.variant <> m.variant""")
def a20_ablation(spark, sf_dir):
    v = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("variant")).agg(F.round(F.avg("o_totalprice"), 2).alias("a"), F.count("*").alias("b"))
    full = v.groupBy("grp").agg(F.max_by(F.struct("a", "b", "variant"), F.struct(F.col("a") + F.col("b"), F.col("variant"))).alias("m"))
    return v.join(full, "grp").where(F.col("variant") != F.col("m.variant")).select("grp", "variant", ((F.col("a") < F.col("m.a")) & (F.col("b") < F.col("m.b"))).alias("lower_on_all"))


@query("""WITH e AS (SELECT l_suppkey AS table_id, list_sort(list_distinct(list(l_linenumber))) AS covered FROM lineitem GROUP BY 1), x AS (SELECT table_id, len(list_filter([1, 2, 3, 4, 5, 6, 7], lambda i: NOT list_contains(covered, i))) AS missing FROM e)
SELECT table_id, CASE WHEN missing = 0 THEN 'complete' WHEN missing < 7 THEN 'partial' ELSE 'unknown' END AS coverage FROM x""")
def a6_table_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("table_id")).agg(F.collect_set("l_linenumber").alias("covered"))
    missing = F.size(F.array_except(F.sequence(F.lit(1), F.lit(7)), "covered"))
    return e.select("table_id", F.when(missing == 0, "complete").when(missing < 7, "partial").otherwise("unknown").alias("coverage"))


@query("SELECT l_suppkey AS table_id, list_sort(list_distinct(list(l_linenumber))) AS row_indices, count(DISTINCT l_orderkey) AS parents FROM lineitem GROUP BY 1")
def a5_table_inventory(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("table_id")).agg(F.sort_array(F.collect_set("l_linenumber")).alias("row_indices"), F.count_distinct("l_orderkey").alias("parents"))


@query(r"""SELECT page_id, page_label, CAST(row_number() OVER (PARTITION BY host ORDER BY CASE WHEN regexp_matches(page_label, '^\d+$') THEN CAST(page_label AS BIGINT) ELSE 1000000000 END, page_label, page_id) AS INT) AS position FROM (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS host, regexp_extract(url, '/([^/?#.]+)[^/]*$', 1) AS page_label FROM pages)""")
def t8_page_order(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"), F.regexp_extract("url", r"/([^/?#.]+)[^/]*$", 1).alias("page_label"))
    number = F.when(F.col("page_label").rlike(r"^\d+$"), F.col("page_label").cast("long")).otherwise(F.lit(1_000_000_000))
    return p.withColumn("position", F.row_number().over(W.partitionBy("host").orderBy(number, "page_label", "page_id"))).drop("host")


def _asked(spark, sf_dir):
    """A question for each table, about its first row, put to two documents: the table's own and the next one."""
    m = markdown(spark, sf_dir)
    ids = m.select("table_id", (F.row_number().over(W.orderBy("table_id")) - 1).cast("long").alias("document_id"))  # 25 tables
    d = m.join(ids, "table_id").select("document_id", "table_id", F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("").alias("markdown"), F.col("table_id").alias("caption")), F.struct(F.col("markdown"), F.col("table_id").alias("caption"))).alias("tables")).alias("document_intelligence"))).alias("metadata"))
    q = ids.select(F.col("document_id").alias("query_id"), "document_id", F.concat(F.lit("early orders of 1-URGENT priority for "), "table_id").alias("question"))
    return d, q.unionByName(q.withColumn("document_id", (F.col("document_id") + 1) % 25))


@query(f"""WITH {CELLS_SQL}, t AS (SELECT table_id, row_number() OVER (ORDER BY table_id) - 1 AS id FROM (SELECT DISTINCT table_id FROM cells)) SELECT id AS query_id, id AS document_id, CAST(1 AS INT) AS ordinal FROM t""")
def r6_own_tables(spark, sf_dir):
    """The best table of each question among those of the documents that it was put to: its own."""
    d, q = _asked(spark, sf_dir)
    return B.own_tables(d, q, 1).select("query_id", "document_id", "ordinal")


@query(f"WITH {CELLS_SQL} SELECT DISTINCT table_id, true AS own_matches, false AS other_matches FROM cells")
def f11_table_groups(spark, sf_dir):
    """Whether a table answers a question about its first row, and one about a thing that no table has."""
    m = markdown(spark, sf_dir)
    own = F.concat(F.lit("early orders of 1-URGENT priority in "), "table_id")
    return m.select("table_id", B.group_matches(own, F.col("markdown")).alias("own_matches"), B.group_matches(F.lit("melting-point of copper in Peru"), F.col("markdown")).alias("other_matches"))


@query(f"""WITH {CELLS_SQL}, r AS (SELECT table_id, row_label, row_number() OVER (PARTITION BY table_id ORDER BY row_label) - 1 AS i FROM (SELECT DISTINCT table_id, row_label FROM cells)) SELECT table_id, count(*) + 2 AS n_children, CAST(sum(i) AS BIGINT) AS row_sum FROM r GROUP BY 1""")
def c6_table_chunks(spark, sf_dir):
    """Children of each table: a row each, as labels differ, and two footnotes."""
    g = markdown(spark, sf_dir).select("table_id", O.grid(F.col("markdown")).alias("g"))
    t = g.select("table_id", F.lit("Orders").alias("caption"), F.get("g", F.lit(0)).alias("headers"), F.slice("g", 2, 1000).alias("rows"), F.array(F.lit("# of all years"), F.lit("a note without a mark")).alias("notes"))
    c = ST.chunk_tables(t, 60).where("chunk_role = 'child'")
    return c.groupBy("table_id").agg(F.count("*").alias("n_children"), F.sum(F.aggregate("rows", F.lit(0), lambda a, x: a + x)).alias("row_sum"))


@query(f"WITH {CELLS_SQL}, t AS (SELECT table_id, row_number() OVER (ORDER BY table_id) AS id FROM (SELECT DISTINCT table_id FROM cells)) SELECT CAST(id // 3 AS BIGINT) AS document_id, table_id AS original, table_id || '_r' AS repaired, CASE id % 2 WHEN 0 THEN 'source_region_id' ELSE 'normalized_bbox' END AS basis FROM t WHERE id // 3 <> 4")
def c12_repaired_tables(spark, sf_dir):
    """Tables, three a document, and their repaired versions, told by region or box; in one document all boxes are alike, so
    that it has no answer."""
    ids = markdown(spark, sf_dir).select("table_id", F.row_number().over(W.orderBy("table_id")).alias("id"))  # 25 tables
    document = F.floor(F.col("id") / 3).cast("long")
    left = F.when(document == 4, 0.0).otherwise(F.col("id") * 10.0)
    region = F.when((F.col("id") % 2 == 0) & (document != 4), F.concat(F.lit("r"), F.col("id").cast("string")))
    row = lambda side, name, shift: ids.select(document.alias("document_id"), F.lit(side).alias("side"), name.alias("table_id"), region.alias("region_id"), F.array(left + shift, F.lit(0.0), left + 8.0, F.lit(9.0)).alias("box"), F.lit(None).cast("string").alias("block_id"))
    return ST.match_inventories(row("original", F.col("table_id"), 0.0).unionByName(row("repaired", F.concat("table_id", F.lit("_r")), 0.5)))


@query(f"WITH {CELLS_SQL} SELECT table_id, CAST(count(DISTINCT row_label) + 2 AS INT) AS n_lines, true AS spans_repeat FROM cells GROUP BY 1")
def src6_html_markdown(spark, sf_dir):
    """Tables as HTML, with a label over two columns in the header, as Markdown of the older form."""
    g = markdown(spark, sf_dir).select("table_id", O.grid(F.col("markdown")).alias("g"))
    row = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))), ""), F.lit("</tr>"))
    head = F.lit("<tr><th>priority</th><th colspan=2>years</th><th>late</th></tr>")
    html = g.select("table_id", F.concat(F.lit("<table>"), head, F.array_join(F.transform(F.slice("g", 2, 1000), row), ""), F.lit("</table>")).alias("html"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([O.html_markdown(x) for x in b.column(1).to_pylist()])], ["table_id", "markdown"])

    m = html.mapInArrow(run, "table_id string, markdown string")
    return m.select("table_id", F.size(F.split("markdown", "\n")).alias("n_lines"), F.contains("markdown", F.lit("| priority | years | years | late |")).alias("spans_repeat"))


#: Tables of orders, a nation each: their header has two levels, and each chunk repeats it. Every other one has one level, under which
#: another name of it stands. Values are words for none of them, so that what is a number decides.
_LEVELS_SQL = """o AS (SELECT n_nationkey, n_name, o_orderpriority AS label, count(*) FILTER (year(o_orderdate) < 1996) AS early, count(*) FILTER (year(o_orderdate) >= 1996) AS late, count(*) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3),
facts AS (SELECT n_nationkey, n_name, label, CASE WHEN n_nationkey % 2 = 0 THEN 'orders early' ELSE 'before' END AS column_name, early AS v FROM o UNION ALL SELECT n_nationkey, n_name, label, CASE WHEN n_nationkey % 2 = 0 THEN 'orders late' ELSE 'since' END, late FROM o
 UNION ALL SELECT n_nationkey, n_name, label, 'total', total FROM o)"""


def levels(spark, sf_dir):
    """Chunks of the tables, three rows each behind a repeated header."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    early = F.year("o_orderdate") < 1996
    g = o.groupBy("n_nationkey", "n_name", F.col("o_orderpriority").alias("label")).agg(F.count_if(early).alias("early"), F.count_if(~early).alias("late"), F.count("*").alias("total"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "label", "early", "late", "total"), F.lit(" |"))
    lines = g.groupBy("n_nationkey", "n_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("label", line.alias("line")))), lambda x: x["line"]).alias("lines"))  # five priorities
    head = F.when(F.col("n_nationkey") % 2 == 0, F.lit("| priority | orders | orders | total |\n|---|---|---|---|\n| priority | early | late | |")).otherwise(F.lit("| priority | before | since | total |\n|---|---|---|---|\n| | first | second | |"))
    parts = F.array(F.slice("lines", 1, 3), F.slice("lines", 4, 3))
    text = F.concat(F.lit("Orders of "), "n_name", F.lit("\n"), head, F.lit("\n"), F.array_join("_part", "\n"))
    return lines.select("n_nationkey", "n_name", head.alias("_h"), F.posexplode(parts).alias("ordinal", "_part")).where(F.size("_part") > 0).select(F.col("n_nationkey").cast("long").alias("document_id"), F.lit("v1").alias("parse_version"), F.col("n_name").alias("table_id"), "ordinal", F.concat_ws(":", "n_name", "ordinal").alias("chunk_id"), text.alias("text"))


@query(f"WITH {_LEVELS_SQL} SELECT n_name AS table_id, 'Orders of ' || n_name AS caption, CASE WHEN n_nationkey % 2 = 0 THEN 'priority|orders early|orders late|total' ELSE 'priority|before|since|total' END AS headers, CAST(count(*) AS INT) AS n_rows, 'header_like_data_row' AS flags, string_agg(label, '|' ORDER BY label) AS labels FROM o GROUP BY n_nationkey, n_name")
def k1_composed_headers(spark, sf_dir):
    """Two levels of headers become one, another name for the header is dropped, and chunks' repetitions of both vanish."""
    t = TF.assembled(levels(spark, sf_dir))
    return t.select("table_id", "caption", F.array_join("headers", "|").alias("headers"), F.size("rows").alias("n_rows"), F.array_join("flags", "|").alias("flags"), F.array_join("labels", "|").alias("labels"))


#: Questions, with the columns and rows that they come to: by name, by a part of a word, or not at all.
_ASKED = ["early and before for 1-URGENT", "late or since of the urgent ones", "everything there is", "ea, si of low", "total, 1-URGENT and 3-MEDIUM", "what about 9-NONE"]


@query(rf"""WITH {_LEVELS_SQL}, q(n, cols, pattern, rows_by, columns_by) AS (VALUES (0, 'orders early|before', '1-URGENT', 'exact', 'strong'), (1, 'orders late|since', '1-URGENT', 'matched', 'strong'), (2, '', '', 'all', 'all'), (3, 'orders early|since', '5-LOW', 'matched', 'weak'), (4, 'total', '1-URGENT|3-MEDIUM', 'exact', 'strong'), (5, '', '', 'all', 'all'))
SELECT n, n_name AS table_id, label AS row_label, column_name, CAST(v AS VARCHAR) AS value, rows_by, columns_by FROM facts, q WHERE (cols = '' OR list_contains(string_split(cols, '|'), column_name)) AND (pattern = '' OR list_contains(string_split(pattern, '|'), label))""")
def k2_selected_facts(spark, sf_dir):
    """Cells for each question of each table, by the chain of fallbacks."""
    asked = F.posexplode(F.array(*map(F.lit, _ASKED))).alias("n", "question")
    return TF.selected(TF.assembled(levels(spark, sf_dir)).select("*", asked)).select("n", "table_id", "row_label", "column_name", "value", "rows_by", "columns_by")


#: Questions about the tables of orders, numbered by their nations, each with the tables of its nation and of the next one at hand.
_DEMANDS = ["Table {n}: orders early, totals of row 2", "Table {n} and its since values", "the total row of before", "Table {n} orders late", "Table 99 total", "Table {n}?"]


@query(f"""WITH {_LEVELS_SQL}, ks AS (SELECT n_nationkey AS k, n_nationkey % 2 = 0 AS even, count(*) AS n_rows FROM o GROUP BY 1), q AS (SELECT k, i, even, n_rows, k * 6 + i AS query_id FROM ks, range(6) r(i))
SELECT query_id, CAST(CASE i WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 3 THEN 1 WHEN 5 THEN 1 ELSE 0 END AS BIGINT) AS expected,
  CAST(CASE i WHEN 0 THEN CASE WHEN n_rows < 3 THEN 2 WHEN even THEN 0 ELSE 1 END WHEN 1 THEN CASE WHEN even THEN 1 ELSE 0 END WHEN 3 THEN CASE WHEN even THEN 0 ELSE 1 END ELSE 0 END AS BIGINT) AS missing,
  CASE WHEN i IN (2, 4) THEN 'unknown' WHEN (i = 0 AND (n_rows < 3 OR NOT even)) OR (i = 1 AND even) OR (i = 3 AND NOT even) THEN 'missing' ELSE 'complete' END AS status FROM q""")
def v4_planned_facts(spark, sf_dir):
    """Demands read from questions and bound to tables, against all facts of these."""
    tables = TF.assembled(levels(spark, sf_dir)).withColumn("_k", F.col("document_id"))
    ask = F.posexplode(F.array(*[F.concat(F.lit(d.partition("{n}")[0]), F.when(F.lit("{n}" in d), F.col("_k").cast("string")).otherwise(""), F.lit(d.partition("{n}")[2])) for d in _DEMANDS])).alias("_i", "question")
    asked = tables.select("_k", ask).select((F.col("_k") * 6 + F.col("_i")).alias("query_id"), "_k", "question")
    most = 25  # nations are numbered from 0; the one after the last is the first
    own = asked.select("query_id", F.explode(F.array("_k", (F.col("_k") + 1) % most)).alias("_k"))
    name = F.concat(F.lit("table-"), F.col("_k").cast("string"))
    inventory = own.select("query_id", F.col("_k").alias("document_id"), F.lit("v1").alias("parse_version"), name.alias("table_id"))
    rows = tables.select("_k", "headers", F.posexplode("rows").alias("row_index", "_r"), "labels").select("_k", "row_index", F.get("labels", F.col("row_index")).alias("row_label"), "headers", F.posexplode("_r").alias("_c", "value")).where("_c > 0")
    facts = own.join(rows, "_k").select("query_id", F.col("_k").alias("document_id"), F.lit("v1").alias("parse_version"), name.alias("table_id"), "row_index", "row_label", F.get("headers", F.col("_c")).alias("column_name"), F.lit(None).cast("string").alias("term"))
    return PL.answered(PL.planned(asked.select("query_id", "question"), inventory), facts)
