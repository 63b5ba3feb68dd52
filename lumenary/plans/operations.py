"""Conversations, runs and traces: counters, roll-ups, latest rows, retention, paging."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import classify as C
from ..operators import answers as AN
from ..operators import versions as VE
from .registry import query, table


@query("SELECT conv_id, count(*) AS n_turns, coalesce(max(turn), -1) + 1 AS next_turn FROM conversations GROUP BY 1")
def a1_next_turn(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), (F.coalesce(F.max("turn"), F.lit(-1)) + 1).alias("next_turn"))


def latest(df, by: list[str], order: list):
    """The first row of each group in a total order; a window group limit keeps one row a task and group."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def j8_latest_run(spark, sf_dir):
    return latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


_STATUS = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'queued' END"
_PERCENT = "CASE event_type WHEN 'purchase' THEN 100 WHEN 'error' THEN 100 WHEN 'click' THEN 50 ELSE 5 END"


@query(f"""WITH l AS (SELECT user_id, {_STATUS} AS status, {_PERCENT} AS percent, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events),
t AS (SELECT user_id, count(*) AS document_count, count(*) FILTER (status = 'completed') AS completed_count, count(*) FILTER (status = 'failed') AS failed_count, count(*) FILTER (status IN ('running', 'queued')) AS processing_count, avg(percent) AS p FROM l WHERE r = 1 GROUP BY 1)
SELECT user_id, document_count, completed_count, processing_count, failed_count, CAST(floor(p) AS BIGINT) AS progress_percent, CAST(completed_count * 100 // document_count AS BIGINT) AS parsing_rate,
 CASE WHEN failed_count > 0 THEN 'failed' WHEN processing_count > 0 THEN 'processing' WHEN completed_count > 0 THEN 'ready' ELSE 'empty' END AS status FROM t""")
def a2_topic_rollup(spark, sf_dir):
    e = latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    status = F.expr(_STATUS)
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    t = e.select("user_id", status.alias("status"), F.expr(_PERCENT).alias("percent")).groupBy("user_id").agg(F.count("*").alias("document_count"), n("completed").alias("completed_count"), n("pending", "processing", "queued", "running").alias("processing_count"), n("failed").alias("failed_count"), F.avg("percent").alias("_p"))
    return t.withColumns({"progress_percent": F.floor("_p"), "parsing_rate": F.floor(F.col("completed_count") * 100 / F.col("document_count")), "status": F.when(F.col("failed_count") > 0, "failed").when(F.col("processing_count") > 0, "processing").when(F.col("completed_count") > 0, "ready").otherwise("empty")}).drop("_p")


@query("SELECT count(*) AS total, count(*) FILTER (event_type IN ('view', 'click')) AS processing, count(*) FILTER (event_type = 'error') AS failed FROM events")
def a3_dashboard(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count("*").alias("total"), F.count_if(F.col("event_type").isin("view", "click")).alias("processing"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY 1")
def a10_nearest_rank(spark, sf_dir):
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(q(0.5).alias("p50"), q(0.95).alias("p95"), F.count("*").alias("n"))


@query("""SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1, 2""")
def a13_failure_histogram(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase")).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, round(coalesce(avg(CASE WHEN event_type IN ('purchase', 'error') THEN CAST(event_type = 'purchase' AS INT) END), 1.0), 6) AS pass_rate, quantile_disc(value, 0.5) FILTER (value > 0) AS p50, quantile_disc(value, 0.95) FILTER (value > 0) AS p95 FROM events GROUP BY 1""")
def a15_agent_summary(spark, sf_dir):
    judged = F.when(F.col("event_type").isin("purchase", "error"), (F.col("event_type") == "purchase").cast("int"))
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value) FILTER (WHERE value > 0)")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.coalesce(F.avg(judged), F.lit(1.0)), 6).alias("pass_rate"), q(0.5).alias("p50"), q(0.95).alias("p95"))


@query("""WITH c AS (SELECT user_id, event_type, count(DISTINCT CAST(ts AS DATE)) AS n, max(ts) AS last FROM events GROUP BY 1, 2)
SELECT user_id, event_type AS main_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, last DESC) AS r FROM c) WHERE r = 1""")
def a16_majority(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count_distinct(F.to_date("ts")).alias("n"), F.max("ts").alias("last"))
    return c.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", "last")).alias("main_type"))


@query("""SELECT event_id, user_id FROM events WHERE event_type = 'error' AND value > 10 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')""")
def f12_trace_filters(spark, sf_dir):
    return trace_filter(table(spark, sf_dir, "events"), event_type="error", least=10.0).join(table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id"), "user_id", "left_semi").select("event_id", "user_id")


def trace_filter(df, event_type: str | None = None, user_id: int | None = None, least: float | None = None):
    """Conjunction of the conditions that are given."""
    for column, value in (("event_type", event_type), ("user_id", user_id)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df if least is None else df.where(F.col("value") > least)


@query("SELECT event_type, count(*) AS expired FROM events WHERE ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY GROUP BY 1")
def f13_retention(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("ts") < F.expr("timestamp_ntz'2024-01-31 00:00:00' - interval 20 days")).groupBy("event_type").agg(F.count("*").alias("expired"))


@query(r"""SELECT event_id, '{"user":' || user_id || ',"api_key":"[redacted]","nested":{"prompt_tokens":3,"My_Token":"[redacted]"},"list":[{"password":"[redacted]","k":' || (event_id % 7) || '},"password"],"note":"' || CASE WHEN event_id % 3 = 0 THEN '[redacted]' ELSE 'it = fine' END || '"}' AS payload FROM events""")
def f15_redaction(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = lambda c: c.cast("string")
    note = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("key=abcdefghijklmnop"), text(F.col("event_id")))).otherwise(F.lit("it = fine"))
    payload = F.concat(F.lit('{"user":'), text(F.col("user_id")), F.lit(',"api_key":"'), "event_type", F.lit('","nested":{"prompt_tokens":3,"My_Token":"'), text(F.col("user_id")), F.lit('"},"list":[{"password":1,"k":'), text(F.col("event_id") % 7), F.lit('},"password"],"note":"'), note, F.lit('"}'))
    return AN.redact(e.select("event_id", payload.alias("payload")), "event_id", "payload")


@query("SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def t7_paging(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).offset(100).limit(50).select("event_id", "ts", "value")


#: Turns of a conversation's end that are looked back at (fixed value).
LOOK_BACK = 12


@query(r"""WITH u AS (SELECT conv_id, turn, text, CASE WHEN length(text) % 3 = 0 THEN substr(text, 1, 30) ELSE text END AS q FROM conversations WHERE role = 'user'),
p AS (SELECT *, CASE WHEN turn - lag(turn) OVER w < 12 THEN trim(lag(q) OVER w, E' \t\n\r\x0b\f') END AS before FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN length(trim(q, E' \t\n\r\x0b\f')) <= 30 AND before <> '' AND before <> trim(q, E' \t\n\r\x0b\f') THEN '上一轮问题：' || before || chr(10) || '当前追问：' || trim(q, E' \t\n\r\x0b\f') ELSE q END AS asked FROM p""")
def q1_follow_ups(spark, sf_dir):
    """Questions as retrieval gets them; every third one is cut to 30 characters, as short ones are follow-ups."""
    w = W.partitionBy("conv_id").orderBy("turn")
    q = F.when(F.length("text") % 3 == 0, F.substring("text", 1, 30)).otherwise(F.col("text"))
    u = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("q", q)
    before = F.when(F.col("turn") - F.lag("turn").over(w) < LOOK_BACK, F.nullif(F.trim(F.lag("q").over(w), F.lit(C.BLANK)), F.lit("")))
    return u.withColumn("_b", before).select("conv_id", "turn", C.follow_up(F.col("q"), F.col("_b")).alias("asked"))


@query("SELECT conv_id, turn, trim(coalesce(text, '')) <> '' AND count(*) OVER (PARTITION BY conv_id ORDER BY turn) >= 2 AS cross_turn FROM conversations WHERE role = 'user'")
def q2_cross_turn(spark, sf_dir):
    """Whether a question comes in a conversation that has two users' turns by then."""
    n = F.count("*").over(W.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", ((F.trim(F.coalesce("text", F.lit(""))) != "") & (n >= 2)).alias("cross_turn"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4")
def w12_compaction(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("_r", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"))))
    return c.where("_r <= 4").select("conv_id", "turn", "role")


@query("SELECT conv_id, arg_min(text, turn) AS first_question FROM conversations WHERE role = 'user' GROUP BY 1")
def w13_first_question(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_question"))


@query("""WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, regexp_extract_all(text, '[A-Z][a-z]{5,}') AS anchors FROM conversations WHERE role = 'assistant')
SELECT DISTINCT conv_id, unnest(anchors) AS anchor FROM a WHERE r <= 2""")
def w11_recent_anchors(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("_r", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"))))
    return a.where("_r <= 2").select("conv_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0))).alias("anchor")).distinct()


@query("""SELECT conv_id, turn, last(nullif(CASE WHEN role = 'user' THEN text ELSE '' END, '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS label FROM conversations""")
def w7_forward_fill(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.nullif("text", F.lit(""))), ignorenulls=True).over(w).alias("label"))


@query("""WITH s AS (SELECT *, CAST(coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) <> role, true) AS INT) AS starts FROM conversations), g AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM s)
SELECT conv_id, CAST(grp AS BIGINT) AS grp, role, min(turn) AS first_turn, count(*) AS n FROM g GROUP BY 1, 2, 3""")
def w8_runs(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn")
    s = table(spark, sf_dir, "conversations").withColumn("_s", F.coalesce(F.lag("role").over(w) != F.col("role"), F.lit(True)).cast("int"))
    return s.withColumn("grp", F.sum("_s").over(w)).groupBy("conv_id", "grp", "role").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"))


_TOK = "regexp_extract_all(lower(text), '[a-z0-9一-鿿]+')"


@query(f"""WITH t AS (SELECT conv_id, turn, role, unnest({_TOK}) AS w FROM conversations), c AS (SELECT conv_id, turn, role, w, count(*) AS n FROM t GROUP BY ALL),
o AS (SELECT q.conv_id, q.turn AS question_turn, a.turn, sum(least(q.n, a.n)) AS overlap FROM c q JOIN c a ON a.conv_id = q.conv_id AND a.w = q.w WHERE q.role = 'user' AND a.role = 'assistant' GROUP BY 1, 2, 3)
SELECT conv_id, question_turn, turn, CAST(overlap AS BIGINT) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, question_turn ORDER BY overlap DESC, turn) AS r FROM o) WHERE r <= 3""")
def t9_attachment_ranking(spark, sf_dir):
    """Multiset overlap of a question's tokens with those of the conversation's answers; the three best."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.explode(T.attachment_tokens(F.col("text"))).alias("w")).groupBy("conv_id", "turn", "role", "w").agg(F.count("*").alias("n"))
    q, a = t.where("role = 'user'").select("conv_id", F.col("turn").alias("question_turn"), "w", F.col("n").alias("m")), t.where("role = 'assistant'").select("conv_id", "turn", "w", "n")
    o = q.join(a, ["conv_id", "w"]).groupBy("conv_id", "question_turn", "turn").agg(F.sum(F.least("m", "n")).alias("overlap"))
    return o.withColumn("_r", F.row_number().over(W.partitionBy("conv_id", "question_turn").orderBy(F.desc("overlap"), "turn"))).where("_r <= 3").drop("_r")


@query("SELECT o.o_orderkey, o.o_orderstatus, c.c_name, n.n_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey")
def j9_lookups(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_orderstatus", "c_name", "n_name")


@query("SELECT l_orderkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) UNION ALL SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def j13_orphans(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem").select("l_orderkey"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return VE.unmatched(l, o, "l_orderkey")


@query("""WITH a AS (SELECT source, doc_id FROM documents WHERE lang = 'en'), b AS (SELECT d.source, d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1)
SELECT source, count(*) FILTER (in_b IS NULL) AS missing, count(*) FILTER (in_a IS NULL) AS extra FROM (SELECT coalesce(a.source, b.source) AS source, a.doc_id AS in_a, b.doc_id AS in_b FROM a FULL JOIN (SELECT DISTINCT * FROM b) b USING (doc_id)) GROUP BY 1""")
def j12_inventory_difference(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a = d.where("lang = 'en'").select("doc_id", F.col("source").alias("sa"), F.lit(1).alias("in_a"))
    b = d.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct(), "doc_id").select("doc_id", F.col("source").alias("sb"), F.lit(1).alias("in_b"))
    return a.join(b, "doc_id", "full_outer").groupBy(F.coalesce("sa", "sb").alias("source")).agg(F.count_if(F.col("in_b").isNull()).alias("missing"), F.count_if(F.col("in_a").isNull()).alias("extra"))


@query("SELECT doc_id, sha256(text) AS content_hash, count(*) OVER (PARTITION BY source, sha256(text)) > 1 AS is_duplicate FROM documents")
def src12_content_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    groups = d.groupBy("source", "content_hash").agg((F.count("*") > 1).alias("is_duplicate"))
    return d.join(groups, ["source", "content_hash"]).select("doc_id", "content_hash", "is_duplicate")


@query("""SELECT source, CAST(sum(CASE WHEN n_copies > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_groups, max(n_copies) AS largest FROM (SELECT source, sha256(text) AS h, count(*) AS n_copies FROM documents GROUP BY 1, 2) GROUP BY 1""")
def a22_duplicate_groups(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("source", F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.count("*").alias("n"))
    return g.groupBy("source").agg(F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.max("n").alias("largest"))
