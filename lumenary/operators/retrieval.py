"""Retrieval: lexical overlap by an inverted index, hybrid scores, ranking, caps and merging."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from ..functions import vectors as V
from ..sources.scratch import cut
from . import knn, lexical

#: Documents in which a route term is rare.
RARE = 3
#: How many candidates are taken (fixed values): contexts, tables and formulas of an answer, and vectors for a limit.
CONTEXTS, CANONICAL_TABLES, FORMULAS = 8, 24, 24


def vector_fetch(limit: int) -> int:
    return max(20 * limit, 50)


#: Rows that a join broadcasts at most; more are shuffled.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """``df``, a table that is cheap to count, to be broadcast where it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


#: What a route term counts beside 1 where both counts are summed at once.
ROUTE = 1 << 32


def shared(queries: DataFrame, documents: DataFrame, least: int = 1, route_length: int = 6) -> DataFrame:
    """query_id, document_id, overlap and route_overlap of all pairs with ``least`` tokens or more in common, of documents that
    each have a document_id of their own. The queries' index is broadcast and a document counted where it stands: no shuffle."""
    weights = F.transform("terms", lambda t: F.when(F.length(t) >= route_length, ROUTE + 1).otherwise(1))
    texts = documents.select("document_id", F.lit(0).alias("ordinal"), T.tokens(F.col("text")).alias("terms")).withColumn("weights", weights)
    found = lexical.pairs(texts, queries.select("query_id", T.tokens(F.col("text")).alias("terms")), lambda total: total % ROUTE >= least)
    return found.select("query_id", "document_id", (F.col("total") % ROUTE).alias("overlap"), F.floor(F.col("total") / ROUTE).alias("route_overlap"))


def overlaps(queries: DataFrame, documents: DataFrame, route_length: int = 6) -> DataFrame:
    """query_id, document_id, overlap, route_overlap and rare of all pairs with a token in common.

    Route terms are the query's tokens of ``route_length`` characters or more; rare ones occur in few documents.
    """
    rare = small(rare_pairs(queries, documents, route_length))
    return shared(queries, documents, 1, route_length).join(rare, ["query_id", "document_id"], "left").withColumn("rare", F.coalesce("rare", F.lit(0).cast("long")))


def lexical_bonus(overlap: Column, route: Column) -> Column:
    return F.least(overlap * 0.05 + route * 0.08, F.lit(0.4))


def rare_bonus(rare: Column) -> Column:
    return F.least(rare * 0.6, F.lit(1.2))


#: The most that lexical bonuses add to a score without a rare term, and the best score without a vector.
MOST_LEXICAL, MOST_WITHOUT = 0.4, 1.2


def rare_pairs(queries: DataFrame, documents: DataFrame, route_length: int = 6) -> DataFrame:
    """query_id, document_id and rare: how many of the query's route terms the document has that few documents have. Only
    documents' terms that a query has are counted; a rare one stands for RARE rows at most. Written, as it is small.

    A term's documents are told by the least and the greatest id and by all ids' exclusive or, which is the third of three:
    a pass over the texts counts them in the tasks, and neither words nor lists of documents are shuffled.
    """
    q = cut(queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).where(F.length("term") >= route_length))
    rare = lexical.scarce(documents, q.select("term").distinct(), RARE, route_length)
    third = F.col("a").bitwiseXOR(F.col("b")).bitwiseXOR(F.col("x"))
    ids = F.when(F.col("n") == 1, F.array("a")).when(F.col("n") == 2, F.array("a", "b")).otherwise(F.array("a", "b", third))
    return cut(rare.select("term", F.explode(ids).alias("document_id")).join(q, "term").groupBy("query_id", "document_id").agg(F.count("*").alias("rare")))


def best_without(queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """query_id and document_id of the k documents that score best for each query by their overlap alone, rare terms aside."""
    texts = documents.select("document_id", F.lit(0).alias("ordinal"), T.tokens(F.col("text")).alias("terms")).withColumn("weights", F.transform("terms", lambda t: F.when(F.length(t) >= 6, 2).otherwise(1)))
    return lexical.best(texts, queries.select("query_id", T.tokens(F.col("text")).alias("terms")), k, lambda total, *_: np.minimum(0.3 + total * 0.1, MOST_WITHOUT), 0.0)


def hybrid(queries: DataFrame, documents: DataFrame, vectors: DataFrame, k: int = 8, size: int = 64) -> DataFrame:
    """query_id, document_id, score and rank of the k best documents of each query; written, so that what joins them to texts
    or vectors broadcasts them, and doesn't shuffle the texts.

    With a vector on both sides the score is ten times the cosine plus small lexical bonuses, without it the overlap
    alone. Scores of zero or less are dropped; ties go to the lesser document_id.

    No table of all pairs with a common word is made. The k nearest score ten times their cosine at least, and a document
    without a rare term gains 0.4 at most: so only those within 0.04 of the k-th nearest cosine, and those with a rare
    term, can be among the best, and only their overlaps are counted. Pairs without a vector score 1.2 at most: they
    are looked at for queries alone whose k-th nearest scores no more, and only the k best of each.
    """
    vectors = vectors.join(documents.select("document_id"), "document_id", "left_semi")
    nearest = knn.top_k(vectors, queries.where("embedding IS NOT NULL"), k, size).groupBy("query_id").agg(F.min("cosine").alias("kth"), F.count("*").alias("n"))
    kth = queries.select("query_id").join(nearest.where(F.col("n") >= k), "query_id", "left")
    floors = cut(kth.select("query_id", F.coalesce("kth", F.lit(-1.0)).alias("floor")))
    asked = queries.where("embedding IS NOT NULL").join(floors, "query_id").select("query_id", "embedding", (F.col("floor") - MOST_LEXICAL / 10 - 1e-6).alias("least"))
    near = knn.within(vectors, asked, size)
    rare = rare_pairs(queries, documents)
    some = near.select("query_id", "document_id").unionByName(rare.select("query_id", "document_id"))
    low = floors.where(10 * F.col("floor") <= MOST_WITHOUT)
    if not low.isEmpty():
        # The k-th nearest of these queries scores so little that documents without a vector may come in: the k best of them.
        few = queries.join(low, "query_id", "left_semi")
        for asking, texts in ((few.where("embedding IS NULL"), documents), (few.where("embedding IS NOT NULL"), documents.join(vectors, "document_id", "left_anti"))):
            some = some.unionByName(best_without(asking, texts, k).select("query_id", "document_id"))
    some = cut(some.distinct())
    wanted = small(cut(some.select("document_id").distinct()))
    terms = lambda df, key, out: df.select(key, T.tokens(F.col("text")).alias(out))
    pairs = some.join(terms(queries, "query_id", "_qt"), "query_id").join(terms(documents.join(wanted, "document_id", "left_semi"), "document_id", "_dt"), "document_id")
    shared = F.array_intersect("_qt", "_dt")
    counts = pairs.select("query_id", "document_id", F.size(shared).cast("long").alias("overlap"), F.size(F.filter(shared, lambda t: F.length(t) >= 6)).cast("long").alias("route_overlap"))
    counts = counts.join(rare, ["query_id", "document_id"], "left").withColumn("rare", F.coalesce("rare", F.lit(0).cast("long")))
    sided = counts.join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id").join(vectors.join(wanted, "document_id", "left_semi").select("document_id", "embedding"), "document_id", "left")
    both = F.col("_q").isNotNull() & F.col("embedding").isNotNull()
    sided = sided.withColumn("cosine", F.when(both, F.round(V.cosine(F.col("embedding"), F.col("_q")), 9)))
    total = F.col("overlap") + F.col("route_overlap")
    with_vector = 10 * F.col("cosine") + lexical_bonus(F.col("overlap"), F.col("route_overlap")) + rare_bonus(F.col("rare"))
    score = F.when(F.col("cosine").isNotNull(), with_vector).when(total > 0, F.least(0.3 + total * 0.1 + rare_bonus(F.col("rare")), F.lit(MOST_WITHOUT))).otherwise(0.0)
    scored = sided.select("query_id", "document_id", F.round(score, 6).alias("score")).where("score > 0")
    return small(cut(ranked(scored, ["query_id"], [F.desc("score"), F.col("document_id")], k)))


def with_supplement(routed: DataFrame, near: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, document_id and origin of routed documents and of the whole library's nearest, a document that is both being
    routed. The nearest are left out for questions (query_id, question, explicit_scope, locked) with a scope of their own, about
    a document as a whole, or about a table, metric or figure of documents that they are locked to."""
    q = F.col("question")
    structured = C.is_table(q) | C.is_metric(q) | C.is_table_reference(q) | C.is_figure(q)
    open_ = questions.where(~(F.col("explicit_scope") | C.is_overview(q) | (F.col("locked") & structured))).select("query_id")
    r = routed.select("query_id", "document_id", F.lit("routed").alias("origin"), F.lit(0).alias("_o"))
    n = near.join(open_, "query_id", "left_semi").select("query_id", "document_id", F.lit("supplement").alias("origin"), F.lit(1).alias("_o"))
    return r.unionByName(n).groupBy("query_id", "document_id").agg(F.min_by("origin", "_o").alias("origin"))


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The k first rows of each group, numbered from 1; Spark limits the groups before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def nearest_mark(rows: DataFrame, mark: Column, by: list[str], place: str) -> DataFrame:
    """``rows`` with distance, that of the nearest marked row of their group by ``place`` (0 for a marked row itself, null in a
    group without any): the last mark before and the first one behind, by two passes over the sorted group."""
    here = F.when(mark, F.col(place))
    last = lambda order: F.last(here, ignorenulls=True).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    before, behind = last(F.col(place)), last(F.desc(place))
    return rows.withColumn("distance", F.least(F.col(place) - before, behind - F.col(place)))


def support_hint(score: Column, term_in_text: Column) -> Column:
    return F.when(score >= 15, "direct").when((score >= 5) | term_in_text, "contextual").otherwise("weak")


def overview_score(text: Column, ordinal: Column, page: Column) -> Column:
    """How much a piece of prose says about its document as a whole. A pattern is tried only on texts that hold one of its words."""
    add = lambda cond, value: F.when(cond, float(value)).otherwise(0.0)

    def word(t: Column, words: list[str], pattern: str) -> Column:
        some = F.lit(False)
        for w in words:
            some = some | F.contains(t, F.lit(w))
        return some & t.rlike(rf"(^|[^a-z0-9_])({pattern})([^a-z0-9_]|$)")

    def of(low: Column, head: Column) -> Column:
        return (
            F.lit(20.0) + add(F.coalesce(page <= 2, F.lit(False)), 28)
            + F.when(ordinal <= 8, F.greatest(F.lit(0.0), 18.0 - ordinal * 1.5)).otherwise(0.0)
            + add(F.contains(head, F.lit("abstract")), 26) + add(word(head, ["introduction"], "introduction"), 20)
            + add(word(low, ["introduce", "propose", "present", "develop", "study", "show", "demonstrate"], r"we\s+(introduce|propose|present|develop|study|show|demonstrate)"), 18)
            + add(word(low, ["method", "approach", "framework", "algorithm", "model"], "method|approach|framework|algorithm|model"), 8) + add(word(head, ["conclusion"], "conclusions?"), 14)
            - add(word(head, ["appendix", "reference", "acknowledgement"], "appendix|references|acknowledgements?"), 18) - add(word(head, ["table"], r"table\s+\d+"), 16)
            + F.least(F.length(text) / 500.0, F.lit(4.0))
        )

    return T.let(F.lower(text), lambda low: T.let(F.substring(low, 1, 240), lambda head: of(low, head)))


def excerpt_dedup(df: DataFrame, order: list[Column], by: list[str], text: str = "text", width: int = 180) -> DataFrame:
    """One row, the first in ``order``, of those whose excerpts' beginnings agree but for white space."""
    key = F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, width)
    return ranked(df.withColumn("_key", key), [*by, "_key"], order, 1, "_r").drop("_key", "_r")


def pack_budget(df: DataFrame, schema: str, budget: int = 6000, fallback: int = 120) -> DataFrame:
    """Greedy packing of each query's rows (query_id, rank, document_id, tokens) into a token budget: a row that doesn't fit
    is tried as an excerpt of ``fallback`` tokens, else skipped, and later rows may still fit. Sequential by nature; a
    query's candidates are few, as they come ranked and cut."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, out = budget, []
        for r in pdf.sort_values("rank").itertuples():
            used, kind = (r.tokens, "full") if r.tokens <= left else (min(fallback, r.tokens), "excerpt")
            if used <= left:
                left -= used
                out.append((r.query_id, r.rank, r.document_id, used, kind))
        return pd.DataFrame(out, columns=["query_id", "rank", "document_id", "used", "kind"])

    return df.groupBy("query_id").applyInPandas(run, schema)
