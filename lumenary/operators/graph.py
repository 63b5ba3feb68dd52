"""Knowledge-graph claims: verification, growth, entities and review items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V

#: Types of entities that are never, or always, worth a page of their own (fixed values).
PRUNE_TYPES = ["date", "time", "dose", "dosage", "measurement", "number", "value"]
GROW_TYPES = ["condition", "component", "concept", "disease", "drug", "entity", "institution", "method", "model", "module", "organization", "person", "procedure", "test", "therapy", "treatment"]
#: Errors that make a review urgent (fixed values).
HIGH_RISK = ["format_error", "missing_evidence", "potential_conflict", "head_entity_error", "head_tail_contradiction"]


def verify(claims: DataFrame, previous: DataFrame, evidence: DataFrame) -> DataFrame:
    """Add errors, a sorted array of codes, and verification_status.

    claims: claim_id, document_id, subject, predicate, object_text, confidence, relation_type, expected_head,
    evidence_chunk_id; previous: subject, predicate, object_text; evidence: chunk_id, document_id, text. A claim is a
    duplicate if an earlier one of its document says the same, and conflicts if a previous claim gives its subject and
    predicate another object: two grouped extremes decide that, whatever the number of previous claims.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    c = claims.withColumns({"_s": low("subject"), "_p": low("predicate"), "_o": low("object_text")})
    prior = previous.select(F.lower("subject").alias("_s"), F.lower("predicate").alias("_p"), F.lower("object_text").alias("_x")).groupBy("_s", "_p").agg(F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    e = evidence.select(F.col("chunk_id").alias("evidence_chunk_id"), "document_id", F.col("text").alias("_text"))
    c = c.join(prior, ["_s", "_p"], "left").join(e, ["evidence_chunk_id", "document_id"], "left")
    c = c.withColumn("_n", F.row_number().over(W.partitionBy("document_id", "_s", "_p", "_o").orderBy("claim_id")))
    fact = F.coalesce(F.col("relation_type") == "source_fact", F.lit(False))
    found = F.col("_text").isNotNull()
    anchored = F.contains("_text", F.trim("subject")) | F.arrays_overlap(T.tokens(F.col("subject"), chemistry=False), T.tokens(F.col("_text"), chemistry=False))
    rules: list[tuple[str, Column]] = [
        ("duplicate", F.col("_n") > 1),
        ("format_error", (F.col("_s") == "") | (F.col("_p") == "") | (F.col("_o") == "")),
        ("head_entity_error", (F.trim("expected_head") != "") & (F.lower(F.trim("expected_head")) != F.col("_s"))),
        ("head_tail_contradiction", F.col("_s") == F.col("_o")),
        ("low_confidence", F.col("confidence") < F.when(fact, 0.45).otherwise(0.6)),
        ("missing_evidence", ~fact & ~found),
        ("potential_conflict", F.col("_min").isNotNull() & ((F.col("_min") != F.col("_o")) | (F.col("_max") != F.col("_o")))),
        ("subject_not_in_evidence", ~fact & found & (F.length("_s") > 2) & (F.col("_p") != "states") & ~anchored),
    ]
    errors = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in rules]), lambda x: x.isNotNull())
    return c.withColumn("errors", errors).select(*claims.columns, "errors", F.when(F.size("errors") == 0, "verified").otherwise("flagged").alias("verification_status"))


def growth(entity_type: Column, name: Column, claim_count: Column, item_type: Column) -> Column:
    """grow, keep or prune."""
    kind = F.lower(F.coalesce(entity_type, F.lit("concept")))
    tail = item_type == "tail"
    return (
        F.when(kind.isin(PRUNE_TYPES) | T.transient_value(name), "prune")
        .when(kind.isin(GROW_TYPES), F.when(tail & (claim_count <= 0), "keep").otherwise("grow"))
        .when(tail & (claim_count == 1) & (F.length(F.trim(name)) > 36), "keep")
        .when(claim_count > 0, "grow")
        .otherwise("keep")
    )


def merge_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (project_id, name): aliases are united and sorted, filled fields of the new side replace the old ones."""
    n = new.select("project_id", "name", F.col("entity_type").alias("_t"), F.col("aliases").alias("_a"), F.col("summary").alias("_s"))
    empty = F.array().cast("array<string>")
    return old.join(n, ["project_id", "name"], "full_outer").select(
        "project_id", "name",
        F.coalesce(F.nullif("_t", F.lit("")), "entity_type").alias("entity_type"),
        F.sort_array(F.array_union(F.coalesce("aliases", empty), F.coalesce("_a", empty))).alias("aliases"),
        F.coalesce(F.nullif("_s", F.lit("")), "summary").alias("summary"),
    )


def review_items(claims: DataFrame, least: int = 3) -> DataFrame:
    """Items for review (document_id, issue, subject, severity): heads with few verified claims, and flagged claims."""
    heads = claims.groupBy("document_id", F.coalesce(F.nullif(F.trim("expected_head"), F.lit("")), F.trim("subject")).alias("subject")).agg(F.count_if(F.col("verification_status") == "verified").alias("n"))
    few = heads.where(F.col("n") < least).select("document_id", F.lit("quantity_too_small").alias("issue"), "subject", F.lit("low").alias("severity"))
    high = F.arrays_overlap("errors", F.array(*map(F.lit, HIGH_RISK)))
    flagged = claims.where(F.size("errors") > 0).select("document_id", F.lit("local_verifier").alias("issue"), "subject", F.when(high, "high").otherwise("medium").alias("severity"))
    return few.unionByName(flagged)


def resolve_evidence(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """claim_id, chunk_id and priority of each claim's evidence: the sentence it names, else its ordinal, else the first
    chunk with its evidence's beginning, its object or its subject.

    claims: claim_id, document_id, sentence_ref, ordinal, evidence, object_text, subject; chunks: document_id, chunk_id,
    ordinal, text. The first two are equi-joins; only claims that neither finds are looked for in their document's texts,
    and of what they meet there the least (priority, ordinal) is kept by a grouped minimum.
    """
    c = chunks.select("document_id", "chunk_id", F.col("ordinal").alias("_at"), F.lower("text").alias("_t"))
    best = F.min_by(F.struct("chunk_id", F.col("_p").alias("priority")), F.struct("_p", "_at", "chunk_id")).alias("_b")
    named = claims.join(c.select("document_id", F.col("chunk_id").alias("sentence_ref"), "chunk_id", "_at"), ["document_id", "sentence_ref"]).select("claim_id", "chunk_id", "_at", F.lit(1).alias("_p"))
    placed = claims.join(c.select("document_id", F.col("_at").alias("ordinal"), "chunk_id", "_at"), ["document_id", "ordinal"]).select("claim_id", "chunk_id", "_at", F.lit(2).alias("_p"))
    direct = named.unionByName(placed).groupBy("claim_id").agg(best)
    has = lambda x: (F.length(F.trim(x)) > 0) & F.contains("_t", F.lower(F.trim(x)))
    priority = F.when(has(F.substring("evidence", 1, 60)), 3).when(has("object_text"), 4).when(has("subject"), 5)
    left = claims.join(direct.select("claim_id"), "claim_id", "left_anti").join(c, "document_id").withColumn("_p", priority).where("_p IS NOT NULL")
    return direct.unionByName(left.groupBy("claim_id").agg(best)).select("claim_id", "_b.chunk_id", "_b.priority")


def generated_errors(triples: DataFrame, previous: DataFrame, contexts: DataFrame) -> DataFrame:
    """Add errors, a sorted array of codes, to triples that a model made for a head.

    triples: triple_id, document_id, head, subject, predicate, object_text; previous: subject, predicate, object_text;
    contexts: document_id, chunk_id, text. A triple without one of its parts is a format_error and nothing else. It has
    evidence if a context of its document holds its object's beginning, its subject or its predicate; that is a
    grouped fact, so a document's triples and contexts meet, but no pair of them is kept.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    t = triples.withColumns({"_h": low("head"), "_s": low("subject"), "_p": low("predicate"), "_o": low("object_text")})
    prior = previous.select(F.lower(F.trim("subject")).alias("_s"), F.lower(F.trim("predicate")).alias("_p"), F.lower(F.trim("object_text")).alias("_x")).groupBy("_s", "_p").agg(F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    c = contexts.select("document_id", F.col("text").alias("_t"))
    has = lambda x: (x != "") & F.contains("_t", x)
    found = has(F.substring(F.trim("object_text"), 1, 80)) | has(F.trim("subject")) | ((F.col("_p") != "") & F.contains(F.lower("_t"), F.col("_p")))
    matched = t.select("triple_id", "document_id", "subject", "object_text", "_p").join(c, "document_id").where(found).select("triple_id").distinct().withColumn("_e", F.lit(True))
    t = t.join(matched, "triple_id", "left").join(prior, ["_s", "_p"], "left")
    t = t.withColumn("_n", F.row_number().over(W.partitionBy("document_id", "_h", "_s", "_p", "_o").orderBy("triple_id")))
    rules = [
        ("duplicate", F.col("_n") > 1),
        ("head_entity_error", F.col("_s") != F.col("_h")),
        ("head_tail_contradiction", F.col("_s") == F.col("_o")),
        ("missing_evidence", F.col("_e").isNull()),
        ("potential_conflict", F.col("_min").isNotNull() & ((F.col("_min") != F.col("_o")) | (F.col("_max") != F.col("_o")))),
    ]
    errors = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in rules]), lambda x: x.isNotNull())
    broken = (F.col("_s") == "") | (F.col("_p") == "") | (F.col("_o") == "")
    return t.select(*triples.columns, F.when(broken, F.array(F.lit("format_error"))).otherwise(errors).alias("errors"))


def head_scores(heads: DataFrame, snippets: DataFrame) -> DataFrame:
    """head, snippet_id, place, text and score of a document's snippets for each of its heads.

    heads: document_id, head, aliases, embedding; snippets: document_id, snippet_id, place, heading, text, embedding. Mentions
    of the head and of its aliases, shared terms, words of facts, a value with a unit, the heading and the vectors' cosine
    count. A head without any hit gets its document's first three snippets, with a score of zero.
    """
    terms = lambda c: T.tokens(c, chemistry=False)
    count = lambda text, x: F.when(x != "", ((F.length(text) - F.length(F.replace(text, x, F.lit("")))) / F.length(x)).cast("int")).otherwise(0)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    h = heads.select("document_id", "head", F.transform("aliases", lambda a: F.lower(a)).alias("_aliases"), F.col("embedding").alias("_v"))
    j = h.join(snippets, "document_id").withColumns({"_low": F.lower("text"), "_terms": terms(F.col("text")), "_head": terms(F.col("head"))})
    alias_terms = F.array_distinct(F.flatten(F.transform("_aliases", lambda a: F.filter(F.regexp_extract_all(a, F.lit("[a-z0-9_]+"), F.lit(0)), lambda w: F.length(w) > 1))))
    score = (
        6 * count(F.col("_low"), F.lower("head"))
        + 4 * total(F.transform("_aliases", lambda a: count(F.col("_low"), a)))
        + 2 * F.size(F.array_intersect("_head", "_terms"))
        + F.size(F.array_intersect(alias_terms, F.col("_terms")))
        + total(F.transform(F.array(*map(F.lit, T.FACT_MARKERS)), lambda m: F.contains(F.col("_low"), m).cast("int")))
        + F.col("text").rlike("(?i)" + T.FACT_VALUE).cast("int")
        + F.when(F.size(F.array_intersect("_head", terms(F.col("heading")))) > 0, 2).otherwise(0)
        + F.when(F.col("_v").isNotNull() & F.col("embedding").isNotNull(), F.greatest(V.cosine(F.col("_v"), F.col("embedding")), F.lit(0.0)) * 4).otherwise(0.0)
    )
    scored = j.select("document_id", "head", "snippet_id", "place", "text", F.round(score, 4).alias("score"))
    w = W.partitionBy("document_id", "head")
    ranked = scored.withColumn("_best", F.max("score").over(w)).withColumn("_at", F.row_number().over(w.orderBy("place", "snippet_id")))
    return ranked.where((F.col("score") > 0) | ((F.col("_best") <= 0) & (F.col("_at") <= 3))).drop("_best", "_at")


def head_context(snippets: DataFrame, budget: int = 3600, most: int = 6) -> DataFrame:
    """The best snippets (document_id, head, snippet_id, place, score, text) of each head, until the next one would break the
    budget of characters, but one in any case: a running sum is exact, as nothing behind a break is taken."""
    w = W.partitionBy("document_id", "head").orderBy(F.desc("score"), "place", "snippet_id")
    s = snippets.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return s.withColumn("_sum", F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, 0))).where((F.col("_sum") <= budget) | (F.col("_r") == 1)).drop("_sum", "_r")
