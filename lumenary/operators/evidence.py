"""Evidence scans beyond the hybrid one, finishing of evidence packs, merged tables, and embeddings with isolated failures."""

from __future__ import annotations

import hashlib
import json
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import lexical
from .retrieval import excerpt_dedup, ranked

#: What a promoted table row gains (fixed value).
TABLE_BOOST = 40.0
#: Words by which passages on limits are known (fixed values; a deployment gives its own).
LIMITATION_ANCHORS = [
    "limitation", "limitations", "unsatisfactory", "overestimation", "overestimated", "deficiency", "deficiencies", "common problem", "radius of gyration", "compactness", "large conformational", "large disordered proteins", "fast-folding", "not fine enough",
]
#: What single anchors add (fixed values).
LIMITATION_BONUS = {"fast-folding": 6.0, "large disordered proteins": 6.0}


#: By what a span of a source is found (fixed values).
LOCATORS = ["page_index", "source_block_id", "paragraph_id", "table_id", "image_relationship_id", "xpath", "css_selector", "element_id", "line_start", "char_start"]


def valid_spans(spans: Column, fields: list[str]) -> Column:
    """Whether there are spans and each has a locator; ``fields`` are the fields that the spans have."""
    own = [f for f in LOCATORS if f in fields]
    located = lambda s: F.array_size(F.array_compact(F.array(*[s[f].cast("string") for f in own]))) > 0
    return F.coalesce((F.size(spans) > 0) & F.forall(spans, located), F.lit(False))


def first_identifier(spans: Column, field: str) -> Column:
    """The first value of a field over spans, in the span itself or else in its metadata (a map); empty ones don't count."""
    of = F.transform(spans, lambda s: F.coalesce(F.nullif(s[field].cast("string"), F.lit("")), F.nullif(s["metadata"][field], F.lit(""))))
    return F.get(F.filter(of, lambda x: x.isNotNull()), F.lit(0))


def profile_supplement(terms: DataFrame, chunks: DataFrame, have: DataFrame, k: int = 3) -> DataFrame:
    """query_id, chunk_id, score and rank of chunks that bring a profile's terms that the evidence lacks.

    terms: query_id, term, asked (whether it shares a token with the question), scientific; chunks: chunk_id, text; have:
    query_id, term. A chunk counts for a question if one of its new terms is asked for: 3 and 1.5 a term, or, with a scientific
    one, 28, 3 a term and up to 5 for shared tokens. Terms meet chunks by their tokens, so that no chunk is put to all.
    """
    new = terms.join(have.select("query_id", "term").distinct(), ["query_id", "term"], "left_anti")
    of_chunk = chunks.select("chunk_id", F.explode(T.tokens(F.col("text"), chemistry=False)).alias("term"))
    g = of_chunk.join(new, "term").groupBy("query_id", "chunk_id").agg(F.count("*").alias("n"), F.max("asked").alias("asked"), F.max("scientific").alias("scientific")).where("asked")
    score = F.when(F.col("scientific"), 28.0 + 3.0 * F.col("n") + F.least("n", F.lit(5))).otherwise(3.0 + 1.5 * F.col("n"))
    return ranked(g.select("query_id", "chunk_id", score.alias("score")), ["query_id"], [F.desc("score"), F.col("chunk_id")], k)


def contextual(text: Column, embedding_text: Column, prefix: Column) -> Column:
    """Whether an embedding text follows the policy: the text itself without a prefix, else prefix, blank line, text."""
    bare = F.coalesce(F.trim(prefix), F.lit("")) == ""
    return F.coalesce(F.when(bare, embedding_text == text).otherwise(embedding_text == F.concat(prefix, F.lit("\n\n"), text)), F.lit(False))


def limitation_score(text: Column, overlap: Column, anchors: list[str] | None = None) -> Column:
    """43 and more for a passage with anchors; null without."""
    low = F.lower(text)
    hits = sum((F.contains(low, F.lit(a)).cast("int") for a in anchors or LIMITATION_ANCHORS), F.lit(0))
    bonus = sum((F.when(F.contains(low, F.lit(a)), b).otherwise(0.0) for a, b in LIMITATION_BONUS.items()), F.lit(0.0))
    return F.when(hits > 0, 43.0 + F.least(overlap, F.lit(8)) + 2.0 * hits + bonus)


#: Stands for the score of a claim without a confidence, which comes last.
UNKNOWN = -1e15


def claim_score(n: np.ndarray, _: np.ndarray, confidence: np.ndarray) -> np.ndarray:
    """Scores to six places, halves away from zero, as Spark rounds; UNKNOWN without a confidence, none with a single key."""
    score, at = np.unique(12.0 + 1.5 * n + confidence, return_inverse=True)
    rounded = [float(Decimal(repr(float(x))).quantize(Decimal("1e-6"), ROUND_HALF_UP)) if x > UNKNOWN / 2 else UNKNOWN for x in score]
    return np.where(n >= 2, np.array(rounded)[at], -np.inf)


def claim_evidence(claims: DataFrame, keys: DataFrame, k: int = 3) -> DataFrame:
    """query_id, chunk_id and score of claims (claim_id, chunk_id, text, confidence) that match two or more of a query's
    keys (query_id, key); the best claim of a chunk, the k best chunks of a query. Keys are few and broadcast as an index, chunk_id
    is a long; no table of claims and queries is made."""
    terms = claims.select(F.col("chunk_id").alias("document_id"), F.lit(0).alias("ordinal"), T.tokens(F.col("text"), chemistry=False).alias("terms"), F.coalesce(F.col("confidence").cast("double"), F.lit(UNKNOWN)).alias("value"))
    queries = keys.groupBy("query_id").agg(F.collect_list("key").alias("terms"))
    found = lexical.best(terms.withColumn("weights", F.array_repeat(F.lit(1), F.size("terms"))), queries, k, claim_score, UNKNOWN, once=True)
    return found.select("query_id", F.col("document_id").alias("chunk_id"), F.when(F.col("score") > UNKNOWN / 2, F.col("score")).alias("score"), "rank")


def supplement(have: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (query_id, term, ...) whose terms ``have`` (query_id, term) doesn't cover yet."""
    return wanted.join(have.select("query_id", "term").distinct(), ["query_id", "term"], "left_anti")


def finalise(rows: DataFrame, limit: int = 8, per_page: int = 5) -> DataFrame:
    """Evidence (query_id, page, structure, score, document_id, text) sorted by structure and score, without repeated
    excerpts, at most ``per_page`` a page and ``limit`` a query. Deduplication goes first, as the cap counts kept rows."""
    order = [F.desc("structure"), F.desc("score"), F.col("document_id")]
    once = excerpt_dedup(rows, order, ["query_id"])
    return ranked(ranked(once, ["query_id", "page"], order, per_page, "_c").drop("_c"), ["query_id"], order, limit)


def fill_tables(requested: DataFrame, found: DataFrame, fetched: DataFrame) -> DataFrame:
    """query_id, table_id and origin of requested tables: found, else fetched directly (which marks the coverage as
    complete by filling, without a look at rows), else missing."""
    f = found.select("query_id", "table_id").distinct().withColumn("_f", F.lit(True))
    g = fetched.select("table_id").distinct().withColumn("_g", F.lit(True))
    j = requested.join(f, ["query_id", "table_id"], "left").join(g, "table_id", "left")
    return j.select("query_id", "table_id", F.when(F.col("_f"), "found").when(F.col("_g"), "filled").otherwise("missing").alias("origin"), (F.col("_f").isNull() & F.col("_g").isNotNull()).alias("coverage_by_fill"))


def merge_continuations(parts: DataFrame) -> DataFrame:
    """Tables cut by page ends put together: parts (document_id, page_index, header, n_rows) of equal headers on adjacent
    pages are one table. Returns document_id, first_page, last_page, header and n_rows."""
    w = W.partitionBy("document_id", "header").orderBy("page_index")
    starts = F.coalesce(F.col("page_index") - F.lag("page_index").over(w) > 1, F.lit(True)).cast("int")
    g = parts.withColumn("_s", starts).withColumn("_g", F.sum("_s").over(w))
    return g.groupBy("document_id", "header", "_g").agg(F.min("page_index").alias("first_page"), F.max("page_index").alias("last_page"), F.sum("n_rows").alias("n_rows")).drop("_g")


def prefix_errors(prefix: Column, text: Column) -> Column:
    """Codes of what is wrong with a generated prefix of a chunk."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    rules = [
        ("empty", F.trim(prefix) == ""),
        ("too_long", F.length(prefix) > 400),
        ("too_many_sentences", F.size(T.sentences(prefix)) > 2),
        ("copy", (F.length(prefix) >= 8) & F.contains(text, prefix)),
        ("new_number", F.size(F.array_except(numbers(prefix), numbers(text))) > 0),
        ("not_chinese", ~prefix.rlike("[\\u3400-\\u9fff]")),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())


def supported_numbers(answer: Column, evidence: Column) -> Column:
    """Whether the evidence has all numbers of an answer, with or without their percent signs."""
    bare = lambda c: F.transform(T.answer_numbers(c), lambda x: F.replace(x, F.lit("%"), F.lit("")))
    return F.size(F.array_except(bare(answer), bare(evidence))) == 0


def embed(df: DataFrame, key: str, text: str, make_embedder) -> DataFrame:
    """key, embedding and error: a row whose embedding fails has the error, and the others theirs."""

    def run(batches):
        embedder = make_embedder()
        for b in batches:
            vectors, errors = [], []
            for t in b.column(1).to_pylist():
                try:
                    vectors.append([float(x) for x in embedder(t)])
                    errors.append(None)
                except Exception as e:  # isolated by design
                    vectors.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())], [key, "embedding", "error"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<double>, error string")


def fingerprint(value: object) -> str:
    """SHA-256 of a value's JSON in one form: sorted keys, no blanks; NaN is refused."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def fingerprints(df: DataFrame, key: str, value: str) -> DataFrame:
    """key and fingerprint of a column of JSON; null and what isn't JSON have none."""

    def one(x):
        try:
            return None if x is None else fingerprint(json.loads(x))
        except ValueError:
            return None

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(x) for x in b.column(1).to_pylist()], pa.string())], [key, "fingerprint"])

    return df.select(key, value).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, fingerprint string")


def claim_rows(claims: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """claim_id, chunk_id, document_id and project_id of claims (claim_id, document_id, chunk_id) whose evidence is a chunk of
    their own document (chunk_id, document_id), in a document that is ready (document_id, project_id, status)."""
    j = claims.select("claim_id", "chunk_id", "document_id").join(chunks.select("chunk_id", "document_id"), ["chunk_id", "document_id"])
    return j.join(documents.where("status = 'ready'").select("document_id", "project_id"), "document_id").select("claim_id", "chunk_id", "document_id", "project_id")


def version_key(pipeline: str, source_sha256: str, config: object, size: int = 12) -> str:
    return f"{pipeline}-{source_sha256[:12]}-{fingerprint(config)[:size]}"
