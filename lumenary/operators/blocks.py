"""Blocks of tables and figures against questions: matching, ranking, promotion and the scan of documents' own tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from .evidence import TABLE_BOOST
from .retrieval import ranked

#: Keys of terms that any table of results has, and names of models (fixed values).
BROAD = ["accuracy", "auc", "error", "errors", "f1", "mae", "metric", "metrics", "mse", "performance", "precision", "recall", "rmse", "score", "scores"]
MODEL = r"^(amber|charmm|gaff|opls|c\d+|ff\d+)[a-z0-9]*$"
#: Metrics of which a table may spell the name out: in its key stand one of these, all words of which count (fixed values).
SPELLED = {"hfe": [["hfe"], ["hydration", "free"]], "pka": [["pka"]], "rmse": [["rmse"], ["rootmeansquare"]], "hvap": [["hvap"], ["vaporizationenthalpy"]]}
#: What must stand beside a metric for it to be enough (fixed values).
PHRASES = {"hfe": [["hydration", "free"]], "pka": [["pka"]], "rmse": [["binding"]], "hvap": [["vaporization"], ["enthalpy"]]}
#: Weights of what a block has of a question (fixed values).
FACET, ANCHOR, DATASET, SPECIFIC, NONE_SPECIFIC, METRIC, DIGIT, PLACE = 6.0, 6.0, 8.0, 4.0, -2.5, 2.0, 1.5, 0.01
TABLE_BASE, FIGURE_BASE = 40.0, 30.0


def matches_term(term: Column, low: Column, key: Column) -> Column:
    """Whether a term stands in a text, given in small letters and as its key: plain words as words, others by their key."""
    plain = term.rlike("^[a-z][a-z0-9]*$")
    word = F.rlike(low, F.concat(F.lit(r"(^|[^a-z0-9\-])"), term, F.lit(r"([^a-z0-9\-]|$)")))
    of = T.lookup_key(term)
    return F.when(plain, word).otherwise((of != "") & F.contains(key, of))


def is_model(term: Column) -> Column:
    return T.lookup_key(term).rlike(MODEL)


def is_specific(term: Column) -> Column:
    return (T.lookup_key(term) != "") & ~is_model(term) & ~T.lookup_key(term).isin(BROAD)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def block_score(question: Column, block: Column, place: Column) -> Column:
    """How well a block answers a question: shared tokens, its facets, figures, tables, datasets and terms, a metric, a digit,
    and its place among the blocks."""

    def of(low: Column, key: Column, terms: Column) -> Column:
        has = lambda x: F.contains(low, F.lower(x))
        weight = lambda t: F.when(is_model(t), 1.0).when(T.lookup_key(t).isin(BROAD), 1.5).otherwise(4.0)
        met = F.filter(terms, lambda t: matches_term(t, low, key))
        specific, hit = F.size(F.filter(terms, is_specific)), F.size(F.filter(met, is_specific))
        return (
            F.size(F.array_intersect(T.tokens(question), T.tokens(block)))
            + FACET * F.size(F.filter(C.facets(question), has))
            + ANCHOR * F.size(F.filter(C.figure_table_anchors(question), has))
            + DATASET * F.size(F.filter(C.dataset_anchors(question), has))
            + _total(F.transform(met, weight))
            + F.when(specific == 0, 0.0).when(hit > 0, hit * SPECIFIC).otherwise(NONE_SPECIFIC)
            + F.when(C.any_of(low, ["f1", "auc", "precision", "recall", "score", "指标"]), METRIC).otherwise(0.0)
            + F.when(low.rlike(r"\d"), DIGIT).otherwise(0.0)
            - PLACE * place
        )

    b = F.coalesce(block, F.lit(""))
    return T.let(F.lower(b), lambda low: T.let(T.lookup_key(b), lambda key: T.let(C.table_terms(question), lambda terms: of(low, key, terms))))


def _any_words(key: Column, options: list[list[str]]) -> Column:
    found = F.lit(False)
    for words in options:
        every = F.lit(True)
        for w in words:
            every = every & F.contains(key, F.lit(w))
        found = found | every
    return found


def block_matches(question: Column, block: Column) -> Column:
    """Whether a table's row or block is about a question: it names the figure, table or dataset that the question names, or has
    two of its specific terms (one, if it has only one); without any of these, two of its tokens."""

    def of(low: Column, key: Column, terms: Column) -> Column:
        named = F.concat(C.figure_table_anchors(question), C.dataset_anchors(question))
        specific = F.filter(terms, is_specific)
        hits = F.size(F.filter(specific, lambda t: matches_term(t, low, key)))
        tokens = F.size(F.array_intersect(T.tokens(question), T.tokens(block))) >= 2
        by_name = F.exists(named, lambda n: (F.length(T.lookup_key(n)) >= 3) & F.contains(key, T.lookup_key(n)))
        return (key != "") & (by_name | F.when(F.size(specific) > 0, hits >= F.least(F.size(specific), F.lit(2))).otherwise((F.size(named) == 0) & tokens))

    b = F.coalesce(block, F.lit(""))
    return T.let(F.lower(b), lambda low: T.let(T.lookup_key(b), lambda key: T.let(C.table_terms(question), lambda terms: of(low, key, terms))))


def group_matches(question: Column, group: Column) -> Column:
    """Whether a whole table is about a question: two specific terms; or it matches as a block and has a metric or a thing that
    the question names; or both of these; or a metric that the table spells out."""

    def of(low: Column, key: Column, terms: Column, asked: Column) -> Column:
        hits = {m: F.contains(asked, F.lit(m)) & _any_words(key, options) for m, options in SPELLED.items()}
        metric, phrase = F.lit(False), F.lit(False)
        for m, hit in hits.items():
            metric, phrase = metric | hit, phrase | (hit & _any_words(key, PHRASES[m]))
        met = F.filter(terms, lambda t: is_specific(t) & matches_term(t, low, key))
        two = F.size(F.array_distinct(F.transform(met, T.lookup_key))) >= 2
        thing = F.exists(met, lambda t: ~T.lookup_key(t).isin([*SPELLED, "shift"]))
        return two | (block_matches(question, group) & (metric | thing)) | phrase | (metric & thing)

    g = F.coalesce(group, F.lit(""))
    return T.let(F.lower(g), lambda low: T.let(T.lookup_key(g), lambda key: T.let(C.table_terms(question), lambda terms: of(low, key, terms, T.lookup_key(question)))))


def promote(candidates: DataFrame, promotion: bool = True) -> DataFrame:
    """Candidates (question, text, score) of questions about tables or metrics: rows without a table's data are dropped (for
    metrics, rows without a metric's numbers), tables that don't match as well, unless the question only points at a table;
    tables that stay gain TABLE_BOOST and their block score. Other questions' candidates stay as they are."""
    q, t = F.col("question"), F.col("text")
    table_q, pointing = C.is_table(q), C.is_table_reference(q)
    first = table_q | C.is_metric(q) | pointing
    data = T.table_data(t)
    kept = ~first | F.when(data, block_matches(q, t) | pointing).otherwise(~table_q & T.metric_numbers(t))
    gain = F.when(first & data, TABLE_BOOST + block_score(q, t, F.lit(0))).otherwise(0.0) if promotion else F.lit(0.0)
    return candidates.where(kept).withColumn("score", F.round(F.col("score") + gain, 6)).withColumn("evidence_kind", F.when(first & data, "table"))


def own_tables(documents: DataFrame, questions: DataFrame, limit: int = 5, kind: str = "tables") -> DataFrame:
    """query_id, document_id, ordinal and score of the tables (or figures) in documents' metadata (document_id, metadata: JSON
    with document_intelligence) that answer questions (query_id, document_id, question), a question being put to the
    documents that it was routed to. The best ``limit`` of each question."""
    schema = f"struct<document_intelligence:struct<{kind}:array<struct<markdown:string,caption:string,page_label:string>>>>"
    items = documents.select("document_id", F.posexplode(F.from_json("metadata", schema)["document_intelligence"][kind]).alias("ordinal", "x"))
    block = F.concat_ws("\n", F.nullif(F.col("x.caption"), F.lit("")), F.nullif(F.col("x.markdown"), F.lit("")))
    j = questions.join(items.select("document_id", "ordinal", block.alias("block")), "document_id").where("block <> ''")
    if kind == "tables":
        j = j.where(T.table_data(F.col("block")) & (block_matches(F.col("question"), F.col("block")) | C.is_table_reference(F.col("question"))))
    base = TABLE_BASE if kind == "tables" else FIGURE_BASE
    score = base + block_score(F.col("question"), F.col("block"), F.lit(0)) + F.greatest(F.lit(0.0), 2.0 - F.col("ordinal") * 0.01)
    return ranked(j.select("query_id", "document_id", "ordinal", F.round(score, 6).alias("score")), ["query_id"], [F.desc("score"), F.col("document_id"), F.col("ordinal")], limit)
