"""Routing of questions to documents: the score of a document, and the cascade that decides which documents a question gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: What a shared token of a document's parts counts, and what selectors and names do (fixed values).
WEIGHTS = {"profile": 1, "raw": 1, "title": 3, "alias": 5, "key": 2}
SELECTOR, INTRODUCED, PRIMARY, EXACT_ALIAS, LEAST = 4, 12, 18, 18, 2.0
#: Verbs behind "we" and behind "this paper", by which a document says what it brings (fixed values).
WE, THIS, CHINESE = r"introduc\w*|creat\w*|propos\w*|develop\w*|present\w*", r"introduc\w*|propos\w*|develop\w*|present\w*", "引入|提出|开发|构建"
#: When the best match is obvious (fixed values).
OBVIOUS, AHEAD, TIMES = 10, 8, 1.75


def score(question: Column, parts: dict[str, Column], selectors: Column, introduced: Column, primary: Column, exact: Column) -> Column:
    """A document's score: weighted overlaps of the question's tokens with each of its ``parts``, how many selectors it has, how
    many of them it introduces, how many are its own subject, and whether an alias stands in the question."""
    q = T.tokens(question)
    total = sum((F.size(F.array_intersect(q, T.tokens(c))) * WEIGHTS[k] for k, c in parts.items()), F.lit(0))
    return (total + selectors * SELECTOR + introduced * INTRODUCED + primary * PRIMARY + F.when(exact, EXACT_ALIAS).otherwise(0)).cast("double")


def introduces(selectors: Column, text: Column) -> Column:
    """How many selectors a text introduces: behind "we propose", "this paper presents" and the like, in the same sentence, at most 240
    characters on."""
    lead = rf"(?i)(?:\bwe\s+(?:{WE})|\bthis\s+(?:paper|work|study)\s+(?:{THIS})|本文(?:{CHINESE}))[^.\n]{{0,240}}"
    quoted = lambda s: F.regexp_replace(s, r"([^\w\s])", r"\\$1")
    return F.size(F.filter(selectors, lambda s: (s != "") & F.rlike(F.coalesce(text, F.lit("")), F.concat(F.lit(lead), quoted(s)))))


def decide(matches: DataFrame, limit: int = 5) -> DataFrame:
    """query_id, document_id, decision and locked of the documents that each question gets.

    matches: query_id, document_id, score and the facts subject_locked, explicit, primary, exact_alias, introduced (of the
    document) and cross_paper (of the question). The first that holds decides: a document whose subject the question
    locks, one that it names outright, its primary subject, an exact alias (all of them, if there are several), a
    question across papers, the only document that introduces what is asked for, a best one far ahead, the ``limit`` best.
    """
    w = W.partitionBy("query_id")
    by_score = w.orderBy(F.desc("score"), "document_id")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = lambda c: F.sum(flag(c).cast("int")).over(w)
    first = lambda c: flag(c) & (F.sum(flag(c).cast("int")).over(by_score.rowsBetween(W.unboundedPreceding, 0)) == 1)
    m = matches.withColumn("_rank", F.row_number().over(by_score))
    best, second = F.max("score").over(w), F.max(F.when(F.col("_rank") == 2, F.col("score"))).over(w)
    obvious = (best >= OBVIOUS) & (second.isNull() | (best >= second + AHEAD) | (best >= second * TIMES))
    several = max(limit, 5)
    ways = [  # decision, whether it holds, the rows that it keeps, whether they are locked
        ("subject", n("subject_locked") > 0, first("subject_locked"), True),
        ("explicit", n("explicit") > 0, first("explicit"), True),
        ("primary", n("primary") > 0, first("primary"), True),
        ("alias", n("exact_alias") == 1, flag("exact_alias"), True),
        ("aliases", n("exact_alias") > 1, flag("exact_alias") & (F.sum(flag("exact_alias").cast("int")).over(by_score.rowsBetween(W.unboundedPreceding, 0)) <= several), False),
        ("cross_paper", flag("cross_paper"), F.col("_rank") <= several, False),
        ("introduced", n("introduced") == 1, flag("introduced"), True),
        ("obvious", obvious, F.col("_rank") == 1, True),
        ("top_k", F.lit(True), F.col("_rank") <= limit, False),
    ]
    decision = F.coalesce(*[F.when(holds, F.lit(name)) for name, holds, _, _ in ways])
    decided = m.withColumns({"_decision": decision, **{f"_keep_{name}": keep for name, _, keep, _ in ways}})
    kept, locked = F.lit(False), F.lit(False)
    for name, _, _, lock in ways:
        chosen = F.col("_decision") == name
        kept, locked = kept | (chosen & F.col(f"_keep_{name}")), locked | (chosen & F.lit(lock))
    return decided.where(kept).select("query_id", "document_id", F.col("_decision").alias("decision"), locked.alias("locked"))
