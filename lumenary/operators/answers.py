"""Checks of answers: the gate of direct drafts, rule verification, guards of fidelity, citations, redaction of traces."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Routes whose answers need citations (fixed values).
CITED = ["evidence_required", "multi_source_compare", "table_or_metric"]
#: A number, with or without its unit (fixed value).
NUMERIC = r"(?i)\d+\.?\d*\s*(?:kcal|%|Å|angstrom|nm|kg|g|ml|L|°C|K|eV|kJ|mol|mM|μM|kcal/mol)?"
TOKEN = r"[a-z0-9]+|[一-鿿]"
#: When an answer repeats itself (fixed values): words of a phrase and how often it stands, how often one token does, of how
#: many tokens, and tokens below which nothing is said.
GRAM, GRAM_COUNT, TOKEN_COUNT, TOKEN_SHARE, LEAST_TOKENS = 4, 4, 8, 0.5, 12


def draft_reason(insufficient: Column, answer: Column, citations: Column, verification: Column, retry: Column, route: Column, coverage: Column) -> Column:
    """Why a draft may not go out as it is, the first reason of six; null if it may."""
    return (
        F.when(F.coalesce(insufficient, F.lit(False)), "evidence_insufficient")
        .when(F.trim(F.coalesce(answer, F.lit("")), F.lit(" \t\r\n")) == "", "empty_answer")
        .when(F.coalesce(citations, F.lit(0)) == 0, "no_citations")
        .when(verification == "contradicted", "rag_contradicted")
        .when(F.coalesce(retry, F.lit(False)), "draft_verify_retry")
        .when((route == "table_or_metric") & (coverage == "partial"), "coverage_partial")
    )


def tokens(answer: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(answer, F.lit(""))), F.lit(TOKEN), F.lit(0))


def longest_run(ordered: Column) -> Column:
    """How often the most frequent value of a sorted array stands in it."""
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["last"].eqNullSafe(x), a["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(ordered, start, step, lambda a: a["best"])


def phrase_repeats(tok: Column) -> Column:
    """How often the most frequent phrase of GRAM tokens stands in an answer; phrases of digits alone don't count. Hashes of
    the phrases are sorted within the row, so nothing is shuffled."""

    def of(t: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(t) - GRAM)
        part = lambda i: [F.get(t, i + k) for k in range(GRAM)]
        worded = F.filter(places, lambda i: F.concat(*part(i)).rlike("[^0-9]"))
        return longest_run(F.sort_array(F.transform(worded, lambda i: F.xxhash64(*part(i)))))

    return F.when(F.size(tok) >= LEAST_TOKENS, T.let(tok, of)).otherwise(F.lit(0))


def dominant_count(tok: Column) -> Column:
    """How often a token with a letter stands that makes up half of an answer; 0 without one. Such a token is in the middle
    of the sorted tokens."""

    def of(s: Column) -> Column:
        middle = F.array(F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")), F.get(s, F.floor(F.size(s) / 2).cast("int")))
        counts = F.transform(middle, lambda m: F.when(m.rlike("[a-z\\u4e00-\\u9fff]"), F.size(F.filter(s, lambda x: x == m))).otherwise(F.lit(0)))
        return T.let(F.array_max(counts), lambda n: F.when((n >= TOKEN_COUNT) & (n >= TOKEN_SHARE * F.size(s)), n).otherwise(F.lit(0)))

    return F.when(F.size(tok) >= LEAST_TOKENS, T.let(F.sort_array(tok), of)).otherwise(F.lit(0))


def verify(answers: DataFrame) -> DataFrame:
    """Add warnings (codes, in order) and retry_recommended to answers (route, answer, citations: their number,
    table_citations). Questions that need clarification aren't checked; the table rule holds only where nothing else is
    wrong."""
    text = F.trim(F.coalesce("answer", F.lit("")), F.lit(" \t\r\n"))
    checked = F.col("route") != "needs_clarification"
    tok = tokens(F.col("answer"))
    rules = [
        ("empty", text == ""),
        ("repeated_phrase", (text != "") & (phrase_repeats(tok) >= GRAM_COUNT)),
        ("dominant_token", (text != "") & (dominant_count(tok) > 0)),
        ("no_citations", F.col("route").isin(CITED) & (F.coalesce("citations", F.lit(0)) == 0)),
    ]
    first = F.filter(F.array(*[F.when(checked & c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    table = checked & (F.col("route") == "table_or_metric") & ~text.rlike(NUMERIC) & (F.coalesce("table_citations", F.lit(0)) == 0)
    warnings = T.let(first, lambda w: F.when((F.size(w) == 0) & table, F.array(F.lit("no_table_evidence"))).otherwise(w))
    return answers.withColumn("warnings", warnings).withColumn("retry_recommended", F.size("warnings") > 0)


def guard(draft: Column, evidence: Column, synthesis: Column, missing_facts: Column) -> Column:
    """Why a synthesis gives way to its draft, the first of four reasons; null if it stands: it loses anchors of the draft
    that the evidence has, brings numbers that the evidence lacks, loses numbers of tables, or misses expected facts."""
    bare = lambda c: F.transform(T.answer_numbers(c), lambda x: F.replace(x, F.lit("%"), F.lit("")))
    labels = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?i)\btable\s*s?\s*\d+"), F.lit(0)), lambda x: F.regexp_replace(F.lower(x), r"\s+", "")))
    anchors = F.array_intersect(bare(draft), bare(evidence))
    return (
        F.when(F.size(F.array_except(anchors, bare(synthesis))) > 0, "draft_fidelity")
        .when(F.size(F.array_except(bare(synthesis), bare(evidence))) > 0, "unsupported_numbers")
        .when(F.size(F.array_except(F.array_intersect(labels(draft), labels(evidence)), labels(synthesis))) > 0, "table_labels")
        .when(F.coalesce(missing_facts, F.lit(0)) > 0, "expected_facts")
    )


def expected_facts(requested: DataFrame, facts: DataFrame) -> DataFrame:
    """query_id, expected, missing and status of the facts that a question's inventory asks for, (query_id, table_id,
    row_label, column_name), against those that came back (query_id, table_id, row_label, column_name, value): complete or
    missing; unknown where nothing is asked for."""
    key = ["query_id", "table_id", "row_label", "column_name"]
    have = facts.where("value IS NOT NULL").select(*key).distinct().withColumn("_h", F.lit(1))
    g = requested.distinct().join(have, key, "left").groupBy("query_id").agg(F.count("table_id").alias("expected"), F.count_if(F.col("table_id").isNotNull() & F.col("_h").isNull()).alias("missing"))
    return g.withColumn("status", F.when(F.col("expected") == 0, "unknown").when(F.col("missing") > 0, "missing").otherwise("complete"))


PAGE_LIMIT, TABLE_LIMIT, EXCERPT = 2, 5, 120
CITATION = "query_id long, position int, page string, excerpt string, score double, is_table boolean, table_id string"


def dedup_citations(citations: DataFrame) -> DataFrame:
    """The citations (the columns of CITATION) that stay: of equal ones, and of one page's equal excerpts, the first; of a page
    with more than two, those that ``_page`` keeps. Sequential within a question, whose citations are few."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("position").astype(object).where(lambda x: x.notna(), None).to_dict("records")
        seen, chosen = set(), []
        for r in rows:
            keys = [("all", *(r[c] for c in pdf.columns if c != "position"))] + ([("page", r["page"], r["excerpt"])] if r["page"] else [])
            if not seen.intersection(keys):
                chosen.append(r)
                seen.update(keys)
        pages: dict[str, list[dict]] = {}
        for r in chosen:
            pages.setdefault(r["page"] or "", []).append(r)
        out, done = [], set()
        for r in chosen:
            page = r["page"] or ""
            if not page or len(pages[page]) <= PAGE_LIMIT:
                out.append(r)
            elif page not in done:
                out += _page(pages[page])
                done.add(page)
        return pd.DataFrame(out, columns=list(pdf.columns))

    return citations.select(*[x.split()[0] for x in CITATION.split(", ")]).groupBy("query_id").applyInPandas(run, CITATION)


def _page(rows: list[dict]) -> list[dict]:
    """Of one page's citations, tables first, then by score: two, or five where a table is among them, one of each table
    first, and prose only among the first two; excerpts that begin alike count once."""
    rows = sorted(rows, key=lambda r: (bool(r["is_table"]), r["score"] or 0.0), reverse=True)
    tables = any(r["is_table"] for r in rows)
    limit, kept, begun = TABLE_LIMIT if tables else PAGE_LIMIT, [], set()

    def push(r):
        head = (r["excerpt"] or "").strip()[:EXCERPT]
        if head not in begun and len(kept) < limit:
            begun.add(head)
            kept.append(r)

    firsts: dict[str, dict] = {}
    for r in rows:
        if r["is_table"] and r["table_id"]:
            firsts.setdefault(r["table_id"], r)
    for r in [*firsts.values(), *rows]:
        if r["is_table"] or not tables or len(kept) < PAGE_LIMIT:
            push(r)
    return kept


#: Names of keys whose values are hidden, names that are safe all the same, and how hidden values begin (fixed values).
SENSITIVE = ["api_key", "apikey", "authorization", "bearer", "token", "secret", "password", "credential", "provider_response", "raw_response"]
SAFE = ["first_token_ms", "prompt_tokens", "completion_tokens", "tokens_per_second"]
SECRET_STARTS = ("sk-", "bearer ", "basic ", "api-key ", "apikey ")
HIDDEN = "[redacted]"


def secret_like(value: str) -> bool:
    """A known beginning, or a name, an equals sign and sixteen characters without a blank."""
    if len(value) < 8:
        return False
    behind = value.partition("=")[2].strip()
    return value.lower().startswith(SECRET_STARTS) or (len(behind) >= 16 and not any(c in behind for c in " \n\t"))


def redacted(value: object) -> object:
    """Objects without secrets, however deep they are nested in objects and in lists of objects."""
    if not isinstance(value, dict):
        return value

    def of(key: str, v: object) -> object:
        low = key.lower()
        if low in SAFE:
            return v
        if any(s in low for s in SENSITIVE) or (isinstance(v, str) and secret_like(v)):
            return HIDDEN
        return [redacted(x) for x in v] if isinstance(v, list) else redacted(v)

    return {k: of(k, v) for k, v in value.items()}


def redact(df: DataFrame, key: str, payload: str) -> DataFrame:
    """key and payload, JSON without secrets. What isn't JSON, or no object, stays as it is, as do nulls."""

    def one(x):
        try:
            v = json.loads(x) if x is not None else None
        except ValueError:
            return x
        return json.dumps(redacted(v), ensure_ascii=False, separators=(",", ":")) if isinstance(v, dict) else x

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(x) for x in b.column(1).to_pylist()], pa.string())], [key, payload])

    return df.select(key, payload).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, `{payload}` string")
