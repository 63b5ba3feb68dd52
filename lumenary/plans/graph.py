"""Knowledge-graph operators over claims made of events and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence_search as ES
from ..operators import graph as G
from .registry import query, table

CUT = "2024-01-10"


def claims(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("claim_id"), (F.col("user_id") % 10).alias("document_id"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("subject"), F.col("event_type").alias("predicate"),
        F.when(F.col("value") > 90, F.concat(F.lit("User "), F.col("user_id").cast("string"))).otherwise(F.get_json_object("props", "$.k")).alias("object_text"), F.least(F.col("value") / 20, F.lit(1.0)).alias("confidence"),
        F.when(F.col("event_type") == "view", "source_fact").otherwise("relation").alias("relation_type"), F.when(F.col("event_type") == "signup", "user 1").otherwise("").alias("expected_head"),
        F.when(F.col("value") > 3, F.col("event_type")).alias("evidence_chunk_id"), "ts",
    )


CLAIMS_SQL = """claims AS (SELECT event_id AS claim_id, user_id % 10 AS document_id, 'user ' || user_id AS subject, event_type AS predicate, CASE WHEN value > 90 THEN 'User ' || user_id ELSE json_extract_string(props, '$.k') END AS object_text,
 least(value / 20, 1.0) AS confidence, CASE WHEN event_type = 'view' THEN 'source_fact' ELSE 'relation' END AS relation_type, CASE WHEN event_type = 'signup' THEN 'user 1' ELSE '' END AS expected_head, CASE WHEN value > 3 THEN event_type END AS evidence_chunk_id, ts FROM events),
previous AS (SELECT lower(subject) AS s, lower(predicate) AS p, min(lower(object_text)) AS lo, max(lower(object_text)) AS hi FROM claims WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1, 2),
c AS (SELECT c.*, lo, hi, CASE WHEN evidence_chunk_id IN ('click', 'purchase', 'error', 'view') THEN 'the user ' || evidence_chunk_id || ' 12' END AS txt, row_number() OVER (PARTITION BY document_id, lower(subject), lower(predicate), lower(object_text) ORDER BY claim_id) AS n FROM claims c LEFT JOIN previous p ON p.s = lower(subject) AND p.p = lower(predicate) WHERE ts >= TIMESTAMP '2024-01-10'),
verified AS (SELECT claim_id, document_id, subject, expected_head, list_filter([CASE WHEN n > 1 THEN 'duplicate' END, CASE WHEN subject = '' OR predicate = '' OR object_text = '' THEN 'format_error' END, CASE WHEN expected_head <> '' AND expected_head <> lower(subject) THEN 'head_entity_error' END,
 CASE WHEN lower(subject) = lower(object_text) THEN 'head_tail_contradiction' END, CASE WHEN confidence < CASE WHEN relation_type = 'source_fact' THEN 0.45 ELSE 0.6 END THEN 'low_confidence' END, CASE WHEN relation_type <> 'source_fact' AND txt IS NULL THEN 'missing_evidence' END,
 CASE WHEN lo IS NOT NULL AND (lo <> lower(object_text) OR hi <> lower(object_text)) THEN 'potential_conflict' END], lambda x: x IS NOT NULL) AS errors FROM c)"""


def verified(spark, sf_dir):
    c = claims(spark, sf_dir)
    cut = F.col("ts") < F.lit(CUT).cast("timestamp_ntz")
    types = F.explode(F.array(*map(F.lit, ("click", "purchase", "error", "view")))).alias("chunk_id")
    evidence = c.select("document_id").distinct().select("document_id", types).withColumn("text", F.concat(F.lit("the user "), "chunk_id", F.lit(" 12")))
    return G.verify(c.where(~cut), c.where(cut), evidence)


@query(f"WITH {CLAIMS_SQL} SELECT claim_id, list_sort(errors) AS errors, CASE WHEN len(errors) = 0 THEN 'verified' ELSE 'flagged' END AS verification_status FROM verified")
def g4_claim_verification(spark, sf_dir):
    return verified(spark, sf_dir).select("claim_id", F.sort_array("errors").alias("errors"), "verification_status")


@query(f"""WITH {CLAIMS_SQL}, h AS (SELECT document_id, coalesce(nullif(trim(expected_head), ''), trim(subject)) AS subject, count(*) FILTER (len(errors) = 0) AS n FROM verified GROUP BY 1, 2)
SELECT document_id, 'quantity_too_small' AS issue, subject, 'low' AS severity, count(*) AS n FROM h WHERE n < 3 GROUP BY ALL
UNION ALL SELECT document_id, 'local_verifier', subject, CASE WHEN list_has_any(errors, ['format_error', 'missing_evidence', 'potential_conflict', 'head_entity_error', 'head_tail_contradiction']) THEN 'high' ELSE 'medium' END, count(*) FROM verified WHERE len(errors) > 0 GROUP BY ALL""")
def g8_review_items(spark, sf_dir):
    return G.review_items(verified(spark, sf_dir)).groupBy("document_id", "issue", "subject", "severity").agg(F.count("*").alias("n"))


@query(f"WITH {CLAIMS_SQL} SELECT document_id, subject AS head, count(*) FILTER (len(errors) = 0) AS verified FROM verified GROUP BY 1, 2 HAVING count(*) FILTER (len(errors) = 0) < 3")
def a18_head_counts(spark, sf_dir):
    return verified(spark, sf_dir).groupBy("document_id", F.col("subject").alias("head")).agg(F.count_if(F.col("verification_status") == "verified").alias("verified")).where("verified < 3")


@query(f"WITH {CLAIMS_SQL} SELECT name, CAST(sum(h) AS BIGINT) AS as_head, CAST(sum(t) AS BIGINT) AS as_tail FROM (SELECT subject AS name, 1 AS h, 0 AS t FROM claims UNION ALL SELECT object_text, 0, 1 FROM claims) GROUP BY 1")
def a19_entity_counts(spark, sf_dir):
    c = claims(spark, sf_dir)
    sides = c.select(F.explode(F.array(F.struct(F.col("subject").alias("name"), F.lit(1).alias("h"), F.lit(0).alias("t")), F.struct(F.col("object_text").alias("name"), F.lit(0).alias("h"), F.lit(1).alias("t")))).alias("x")).select("x.*")
    return sides.groupBy("name").agg(F.sum("h").alias("as_head"), F.sum("t").alias("as_tail"))


@query(r"""WITH p AS (SELECT p_partkey, p_name AS name, p_brand, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2, 3)
SELECT p_partkey, CASE WHEN regexp_matches(name, '^[\d\s.,:%/-]+$') OR trim(name) = '' OR regexp_matches(lower(name), '\d+\s*(mg|g|ml|%|days?|weeks?|months?|years?|hours?)') THEN 'prune'
 WHEN kind = 'concept' AND n <= 0 THEN 'keep' WHEN kind = 'concept' THEN 'grow' WHEN n = 1 AND length(name) > 36 THEN 'keep' WHEN n > 0 THEN 'grow' ELSE 'keep' END AS decision FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'concept' ELSE 'thing' END AS kind FROM p)""")
def g7_growth_rules(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    p = table(spark, sf_dir, "part").join(n, F.col("p_partkey") == F.col("l_partkey"), "left")
    return p.select("p_partkey", G.growth(F.when(F.col("p_partkey") % 2 == 0, "concept").otherwise("thing"), F.col("p_name"), F.coalesce("n", F.lit(0)), F.lit("tail")).alias("decision"))


@query("""WITH o AS (SELECT source AS project_id, lang AS name, 'language' AS entity_type, list_sort(list_distinct(list(CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END))) AS aliases, '' AS summary FROM documents WHERE n_chars < 3000 GROUP BY 1, 2),
n AS (SELECT source AS project_id, lang AS name, '' AS entity_type, ['vast'] AS aliases, 'has long texts' AS summary FROM documents WHERE n_chars >= 3000 GROUP BY 1, 2)
SELECT coalesce(o.project_id, n.project_id) AS project_id, coalesce(o.name, n.name) AS name, coalesce(nullif(n.entity_type, ''), o.entity_type) AS entity_type, list_sort(list_distinct(list_concat(coalesce(o.aliases, []), coalesce(n.aliases, [])))) AS aliases, coalesce(nullif(n.summary, ''), o.summary) AS summary
FROM o FULL JOIN n ON o.project_id = n.project_id AND o.name = n.name""")
def g6_entity_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.where("n_chars < 3000").groupBy(F.col("source").alias("project_id"), F.col("lang").alias("name")).agg(F.collect_set(F.when(F.col("n_chars") > 1000, "long").otherwise("short")).alias("aliases")).select("project_id", "name", F.lit("language").alias("entity_type"), "aliases", F.lit("").alias("summary"))
    new = d.where("n_chars >= 3000").select(F.col("source").alias("project_id"), F.col("lang").alias("name")).distinct().select("project_id", "name", F.lit("").alias("entity_type"), F.array(F.lit("vast")).alias("aliases"), F.lit("has long texts").alias("summary"))
    return G.merge_entities(old, new)


_TERMS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9_]+'), lambda w: length(w) > 1))"
_MARKERS = " + ".join(f"CAST(contains(low, '{m}') AS INT)" for m in T.FACT_MARKERS)


def _heads(spark, sf_dir):
    """A document's first word with a capital is its head, its language and its second such word are aliases; its lines are
    snippets, its first line the heading of all."""
    d = table(spark, sf_dir, "documents").withColumn("_names", F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,}"), F.lit(0))).where(F.size("_names") > 0)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    heads = d.join(e, "doc_id", "left").select(F.col("doc_id").alias("document_id"), F.get("_names", F.lit(0)).alias("head"), F.array(F.col("lang"), F.coalesce(F.get("_names", F.lit(1)), F.col("lang"))).alias("aliases"), "embedding")
    lines = d.select(F.col("doc_id").alias("document_id"), F.split("text", "\n")[0].alias("heading"), F.posexplode(F.split("text", "\n")).alias("place", "text")).where("text <> ''")
    return heads, lines.select("document_id", F.concat_ws(":", "document_id", "place").alias("snippet_id"), "place", "heading", "text", F.lit(None).cast("array<double>").alias("embedding"))


@query(rf"""WITH n AS (SELECT doc_id, lang, text, regexp_extract_all(text, '[A-Z][a-z]{{4,}}') AS names FROM documents), d AS (SELECT doc_id, text, names[1] AS head, lower(names[1]) AS h, lower(lang) AS a1, lower(coalesce(names[2], lang)) AS a2, string_split(text, chr(10))[1] AS heading FROM n WHERE len(names) > 0),
l AS (SELECT *, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS place FROM d), s AS (SELECT *, lower(t) AS low, {_TERMS.format('t')} AS terms, {_TERMS.format('head')} AS ht, {_TERMS.format("a1 || ' ' || a2")} AS alt FROM l WHERE t <> ''),
c AS (SELECT doc_id, head, place, t, 6 * ((length(low) - length(replace(low, h, ''))) // length(h)) + 4 * ((length(low) - length(replace(low, a1, ''))) // length(a1) + (length(low) - length(replace(low, a2, ''))) // length(a2))
 + 2 * len(list_intersect(ht, terms)) + len(list_intersect(alt, terms)) + {_MARKERS} + CAST(regexp_matches(low, '{T.FACT_VALUE}') AS INT) + CASE WHEN len(list_intersect(ht, {_TERMS.format('heading')})) > 0 THEN 2 ELSE 0 END AS score FROM s),
b AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS nth FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS r FROM b WHERE score > 0 OR (best <= 0 AND nth <= 3)),
k AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS total FROM r WHERE r <= 6) SELECT head, doc_id || ':' || place AS snippet_id, CAST(score AS DOUBLE) AS score FROM k WHERE total <= 3600 OR r = 1""")
def g1_head_context(spark, sf_dir):
    return G.head_context(G.head_scores(*_heads(spark, sf_dir))).select("head", "snippet_id", F.col("score").cast("double").alias("score"))


@query(f"""WITH {{CLAIMS_SQL}}, g AS (SELECT claim_id, document_id, lower(trim(subject)) AS s, lower(trim(predicate)) AS p, lower(trim(coalesce(object_text, ''))) AS o, 'user ' || document_id AS h, subject, predicate, object_text, lo, hi FROM c)
SELECT claim_id AS triple_id, CASE WHEN s = '' OR p = '' OR o = '' THEN ['format_error'] ELSE list_filter([CASE WHEN row_number() OVER (PARTITION BY document_id, h, s, p, o ORDER BY claim_id) > 1 THEN 'duplicate' END, CASE WHEN s <> h THEN 'head_entity_error' END, CASE WHEN s = o THEN 'head_tail_contradiction' END,
 CASE WHEN NOT (contains('the user 3 did click', trim(object_text)) OR contains('the user 3 did click', trim(subject)) OR contains('the user 3 did click', p)) THEN 'missing_evidence' END, CASE WHEN lo IS NOT NULL AND (lo <> o OR hi <> o) THEN 'potential_conflict' END], lambda x: x IS NOT NULL) END AS errors FROM g""".replace("{CLAIMS_SQL}", CLAIMS_SQL))
def g5_generated_errors(spark, sf_dir):
    c = claims(spark, sf_dir)
    cut = F.col("ts") < F.lit(CUT).cast("timestamp_ntz")
    triples = c.where(~cut).select(F.col("claim_id").alias("triple_id"), "document_id", F.concat(F.lit("user "), F.col("document_id").cast("string")).alias("head"), "subject", "predicate", "object_text")
    contexts = c.select("document_id").distinct().select("document_id", F.lit("a").alias("chunk_id"), F.lit("the user 3 did click").alias("text"))
    return G.generated_errors(triples, c.where(cut), contexts).select("triple_id", "errors")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), m AS (SELECT doc_id AS claim_id, i, CASE WHEN contains(t, 'licensed') THEN 4 WHEN contains(t, 'the') THEN 5 END AS p FROM l)
SELECT claim_id, claim_id || ':' || i AS chunk_id, CAST(p AS INT) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY p, i) AS r FROM m WHERE p IS NOT NULL) WHERE r = 1""")
def g3_evidence_resolution(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    chunks = d.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("ordinal", "text")).withColumn("chunk_id", F.concat_ws(":", "document_id", "ordinal"))
    none = F.lit(None).cast("string")
    c = d.select(F.col("doc_id").alias("claim_id"), F.col("doc_id").alias("document_id"), none.alias("sentence_ref"), F.lit(None).cast("int").alias("ordinal"), none.alias("evidence"), F.lit("Licensed").alias("object_text"), F.lit("The").alias("subject"))
    return G.resolve_evidence(c, chunks)


#: Claims of documents: the object is the license line's beginning, the subject the text's first word; every third names a sentence,
#: every fifth an ordinal that isn't there before one that is, every seventh an excerpt of its third line.
_CASCADE_SQL = """d AS (SELECT doc_id, string_split(text, chr(10)) AS l, text FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, l, string_split(l[1], ' ')[1] AS subject, CASE WHEN doc_id % 7 = 0 THEN coalesce(l[3], '') ELSE '' END AS e FROM d),
x AS (SELECT doc_id, subject, trim(e) AS e, unnest(l) AS t, unnest(range(len(l))) AS i FROM c),
p AS (SELECT doc_id, i, CASE WHEN doc_id % 3 = 0 AND i = 1 THEN 1 WHEN doc_id % 5 = 0 AND i = 0 THEN 2 WHEN length(e) >= 8 AND contains(t, e) THEN 3 WHEN length(e) >= 8 AND contains(t, substr(e, 1, 160)) THEN 4 WHEN length(e) >= 8 AND contains(t, substr(e, 1, 80)) THEN 5
 WHEN contains(t, 'Licensed under') THEN 6 WHEN length(trim(subject)) >= 2 AND contains(t, trim(subject)) THEN 7 END AS p FROM x)"""


@query(f"WITH {_CASCADE_SQL} SELECT doc_id AS claim_id, doc_id || ':' || i AS chunk_id, CAST(p AS INT) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, i) AS r FROM p WHERE p IS NOT NULL) WHERE r = 1")
def g3_evidence_cascade(spark, sf_dir):
    """Lines as chunks; each document's strings go over each of its lines once."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    lines = F.split("text", "\n")
    chunks = d.select(F.col("doc_id").alias("document_id"), F.posexplode(lines).alias("ordinal", "text")).withColumn("chunk_id", F.concat_ws(":", "document_id", "ordinal"))
    k = F.col("doc_id")
    claims = d.select(
        k.alias("claim_id"), k.alias("document_id"), F.when(k % 3 == 0, F.array(F.lit("none"), F.lit("chunk-1:sentence-2"))).otherwise(F.array().cast("array<string>")).alias("sentence_refs"),
        F.when(k % 5 == 0, F.array(F.lit(10**9), F.lit(0))).otherwise(F.array().cast("array<int>")).alias("ordinals"), F.when(k % 7 == 0, F.get(lines, F.lit(2))).alias("evidence"), F.lit("Licensed under").alias("object_text"), F.split(lines[0], " ")[0].alias("subject"),
    )
    return ES.resolved(claims, chunks)
