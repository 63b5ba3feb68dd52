"""The training-data queries and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers

from . import bpe, collocations, language_id, line_dedup, media, ngram_join, packing, pii, quality_model, quality_rules, target_encoding, toxicity, warc
from .common import read


def op9_byte_bpe(spark, sf_dir):
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op1_ngram_join(spark, sf_dir):
    return ngram_join.join(read(spark, sf_dir, "documents"), words=3, percent=90)


#: The key of the query's surrogates; a deployment gives its own.
PII_KEY = b"lumenary-example-key"


def op2_pii_surrogates(spark, sf_dir):
    return pii.replace(read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op3_line_windows(spark, sf_dir):
    return line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality_model(spark, sf_dir):
    return quality_model.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_quality_cascade(spark, sf_dir):
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge_measured(quality_rules.measures(documents), quality_rules.order_rules(documents, measured=True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_language_id(spark, sf_dir):
    return language_id.identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_warc_revisits(spark, sf_dir):
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op10_jpeg_thumbnails(spark, sf_dir):
    return media.digests(read(spark, sf_dir, "documents"))


def op11_collocations(spark, sf_dir):
    return collocations.mine(read(spark, sf_dir, "documents"))


def op12_target_encoding(spark, sf_dir):
    return target_encoding.encode(*(read(spark, sf_dir, t) for t in ("sale_lines", "sales", "items", "vendors", "clients")))


def op13_toxicity_distance(spark, sf_dir):
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_pii_surrogates, op3_line_windows, op4_quality_model, op5_quality_cascade, op6_language_id, op7_best_fit_packing, op8_warc_revisits, op9_byte_bpe, op10_jpeg_thumbnails, op11_collocations, op12_target_encoding, op13_toxicity_distance)}

#: Words as arrays: text split at white space, empty strings left out.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP5_MEASURES = rf"""
w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
l AS (SELECT doc_id, t, ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM l WHERE len(ws) >= 3),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM win),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT l.doc_id, t, len(ls) AS n_lines, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(list_aggregate(ws, 'string_agg', '')) AS BIGINT) AS word_chars_or_null,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM l LEFT JOIN cov USING (doc_id)),
mm AS (SELECT *, coalesce(word_chars_or_null, 0) AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
judged AS (
  SELECT *, NOT base_failed AND NOT (
    word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
    OR 100 * len(regexp_extract_all(t, '\p{{L}}')) < 60 * word_chars OR 100 * len(regexp_extract_all(t, '\p{{Lu}}')) > 30 * word_chars
    OR 5 * len(regexp_extract_all(t, '!')) > n_words) AS kept
  FROM mm)"""

OP3_MARKED = r"""
parts AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
worded AS (SELECT doc_id, i, trim(x, E' 	

') AS x, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM parts WHERE trim(x, E' 	

') <> ''),
wins AS (SELECT * FROM (SELECT doc_id, n, x AS a, lead(x, 1) OVER d AS b, lead(x, 2) OVER d AS c FROM worded WINDOW d AS (PARTITION BY doc_id ORDER BY n)) WHERE c IS NOT NULL),
later AS (SELECT doc_id, n FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, n) AS r FROM wins) WHERE r > 1),
gone AS (SELECT DISTINCT w.doc_id, w.i FROM later l, (VALUES (0), (1), (2)) v(k), worded w WHERE w.doc_id = l.doc_id AND w.n = l.n + k),
kept AS (SELECT p.doc_id, string_agg(p.x, chr(10) ORDER BY p.i) AS text FROM parts p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i WHERE g.i IS NULL GROUP BY p.doc_id),
counted AS (SELECT p.doc_id, count(w.i) AS n_lines, count(g.i) AS n_removed FROM parts p LEFT JOIN worded w ON p.doc_id = w.doc_id AND p.i = w.i LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)"""

#: Every n-gram of every piece as a string, counted; cuts and longer candidates by joins on the strings.
OP11_COLLOCATIONS = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded WHERE len(ws) > 0),
totals AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM places GROUP BY lang),
grams AS (SELECT lang, k, ws[i : i + k - 1] AS g, CAST(count(*) AS BIGINT) AS f FROM places, (VALUES (1), (2), (3), (4)) v(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
candidates AS (SELECT * FROM grams WHERE k >= 2 AND f >= 30),
cuts AS (SELECT c.lang, c.k, c.g, c.f, j, a.f AS l, b.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.f) // (a.f + b.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c JOIN grams a ON a.lang = c.lang AND a.g = c.g[1 : j] JOIN grams b ON b.lang = c.lang AND b.g = c.g[j + 1 : c.k]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
inner_parts AS (SELECT lang, f, g[s : s + m - 1] AS g FROM candidates, (VALUES (2), (3)) v(m), (VALUES (1), (2), (3)) u(s) WHERE m < k AND s + m - 1 <= k),
dropped AS (SELECT DISTINCT c.lang, c.g FROM candidates c JOIN inner_parts p ON p.lang = c.lang AND p.g = c.g WHERE CAST(100 AS HUGEINT) * p.f >= CAST(80 AS HUGEINT) * c.f),
ranked AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.f DESC, array_to_string(b.g, ' ')) AS rank, array_to_string(b.g, ' ') AS phrase, b.f AS a, l, r, score
  FROM best b LEFT JOIN dropped d ON d.lang = b.lang AND d.g = b.g WHERE d.g IS NULL)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

#: crc32 by its table, made of eight shifts a byte; each column's history as the running sums of a value less those of the fold.
OP12_ENCODING = """
WITH tab AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS c FROM range(256) r(i)),
lines AS (SELECT sale_id, coalesce(item_id, -1) AS item_id, vendor_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (flag = 'returned') AS BIGINT) AS s FROM sale_lines GROUP BY ALL),
folds AS (SELECT sale_id, coalesce(client_id, -1) AS client_id, sold_at AS t,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, c[(xor(a, b) & 255) + 1])), 4294967295) % 5 AS fold
  FROM sales, tab WHERE sold_at IS NOT NULL),
g AS (SELECT l.*, client_id, t, fold, kind, v.nation_id, segment FROM lines l JOIN folds USING (sale_id) LEFT JOIN items USING (item_id) LEFT JOIN vendors v USING (vendor_id) LEFT JOIN clients USING (client_id)),
events AS (
  SELECT 'a' AS col, '' AS k, fold, t, n, s FROM g UNION ALL SELECT 'i', CAST(item_id AS VARCHAR), fold, t, n, s FROM g UNION ALL SELECT 'v', CAST(vendor_id AS VARCHAR), fold, t, n, s FROM g
  UNION ALL SELECT 'c', CAST(client_id AS VARCHAR), fold, t, n, s FROM g UNION ALL SELECT 'ik', kind, fold, t, n, s FROM g UNION ALL SELECT 'vk', CAST(nation_id AS VARCHAR), fold, t, n, s FROM g UNION ALL SELECT 'ck', segment, fold, t, n, s FROM g),
of_fold AS (SELECT col, coalesce(k, '-') AS k, fold, t, sum(n) AS n, sum(s) AS s FROM events GROUP BY ALL),
of_all AS (SELECT col, k, t, sum(n) AS n, sum(s) AS s FROM of_fold GROUP BY ALL),
run_fold AS (SELECT col, k, fold, t, sum(n) OVER w AS n, sum(s) OVER w AS s FROM of_fold WINDOW w AS (PARTITION BY col, k, fold ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
run_all AS (SELECT col, k, t, sum(n) OVER w AS n, sum(s) OVER w AS s FROM of_all WINDOW w AS (PARTITION BY col, k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT f.col, f.k, f.fold, f.t, CAST(coalesce(a.n, 0) - coalesce(f.n, 0) AS BIGINT) AS n, CAST(coalesce(a.s, 0) - coalesce(f.s, 0) AS BIGINT) AS s FROM run_fold f JOIN run_all a USING (col, k, t)),
base AS (SELECT fold, t, CASE WHEN n < 1 THEN 500000 ELSE (1000000 * s + 50 * 500000) // (n + 50) END AS p FROM h WHERE col = 'a'),
prior AS (SELECT col, k, fold, t, CASE WHEN n < 1 THEN p ELSE (1000000 * s + 50 * p) // (n + 50) END AS p FROM h JOIN base USING (fold, t) WHERE col IN ('ik', 'vk', 'ck'))
SELECT g.sale_id, g.item_id, g.vendor_id, g.n AS n_lines, g.s AS n_returned,
  i.n AS item_n, CASE WHEN i.n < 1 THEN ip.p ELSE (1000000 * i.s + 50 * ip.p) // (i.n + 50) END AS item_rate,
  v.n AS vendor_n, CASE WHEN v.n < 1 THEN vp.p ELSE (1000000 * v.s + 50 * vp.p) // (v.n + 50) END AS vendor_rate,
  c.n AS client_n, CASE WHEN c.n < 1 THEN cp.p ELSE (1000000 * c.s + 50 * cp.p) // (c.n + 50) END AS client_rate
FROM g
JOIN h i ON i.col = 'i' AND i.k = CAST(g.item_id AS VARCHAR) AND i.fold = g.fold AND i.t = g.t JOIN prior ip ON ip.col = 'ik' AND ip.k = coalesce(g.kind, '-') AND ip.fold = g.fold AND ip.t = g.t
JOIN h v ON v.col = 'v' AND v.k = coalesce(CAST(g.vendor_id AS VARCHAR), '-') AND v.fold = g.fold AND v.t = g.t JOIN prior vp ON vp.col = 'vk' AND vp.k = coalesce(CAST(g.nation_id AS VARCHAR), '-') AND vp.fold = g.fold AND vp.t = g.t
JOIN h c ON c.col = 'c' AND c.k = CAST(g.client_id AS VARCHAR) AND c.fold = g.fold AND c.t = g.t JOIN prior cp ON cp.col = 'ck' AND cp.k = coalesce(g.segment, '-') AND cp.fold = g.fold AND cp.t = g.t"""

ORACLE: dict[str, str] = {
    "op12_target_encoding": OP12_ENCODING,
    "op11_collocations": OP11_COLLOCATIONS,
    "op3_line_windows": f"WITH {OP3_MARKED} SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL WHEN n_removed = 0 THEN d.text ELSE coalesce(k.text, '') END AS text, n_lines, n_removed FROM documents d JOIN counted USING (doc_id) LEFT JOIN kept k USING (doc_id)",
    "op8_warc_revisits": """
WITH h AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM f""",
    "op5_quality_cascade": f"WITH {OP5_MEASURES} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged",
}
