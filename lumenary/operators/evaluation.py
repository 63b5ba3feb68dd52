"""Evaluation of retrieval runs and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import answers as A

#: Penalties by severity (fixed values).
PENALTIES = {"info": 0.0, "warning": 0.05, "error": 0.15, "fatal": 0.35}


def recall(results: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """query_id and hit_k: whether an expected document is among the first k results (query_id, document_id, rank).
    Queries without results count as missed."""
    joined = expected.join(results, ["query_id", "document_id"], "left")
    return joined.groupBy("query_id").agg(*[F.coalesce(F.max((F.col("rank") <= k).cast("int")), F.lit(0)).alias(f"hit_{k}") for k in ks])


def ratio(valid: Column, total: Column, empty: float) -> Column:
    """valid / total to six places, half to even; ``empty`` where there is nothing."""
    return F.when(total == 0, F.lit(empty)).otherwise(F.bround(valid / total, 6))


def quality(issues: DataFrame, by: str = "document_id") -> DataFrame:
    """score, status and accepted of documents by their issues (severity, repairable)."""
    penalty = F.element_at(F.create_map(*[x for k, v in PENALTIES.items() for x in (F.lit(k), F.lit(v))]), F.col("severity"))
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    g = issues.groupBy(by).agg(F.sum(penalty).alias("_p"), has(F.col("severity") == "fatal").alias("_f"), has("repairable").alias("_r"), has(F.col("severity") == "warning").alias("_w"))
    status = F.when(F.col("_f"), "rejected").when(F.col("_r"), "validation_failed").when(F.col("_w"), "accepted_with_warnings").otherwise("accepted")
    return g.select(by, F.round(F.greatest(F.lit(0.0), 1.0 - F.col("_p")), 6).alias("score"), status.alias("status"), status.startswith("accepted").alias("accepted"))


def repetition(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """repeats, how often the most frequent phrase of an answer stands in it, and dominant, how often a token that makes up
    half of it does, of the answers that repeat themselves by one of these. Rows are judged by themselves: no shuffle."""
    tok = df.select(*by, A.tokens(F.col(text)).alias("_t"))
    judged = tok.select(*by, A.phrase_repeats(F.col("_t")).cast("long").alias("repeats"), A.dominant_count(F.col("_t")).cast("long").alias("dominant"))
    return judged.where((F.col("repeats") >= A.GRAM_COUNT) | (F.col("dominant") > 0))
