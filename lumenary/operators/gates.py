"""Gates of an index: the twelve integrity ratios over active versions, and the rules that a parsed document must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

#: The strict gates, in order (fixed values).
GATES = [
    "parse_completeness", "source_fidelity_completeness", "structured_limit_completeness", "contextual_prefix_completeness", "plain_embedding_completeness", "embedding_completeness",
    "table_validation_rate", "source_span_validity", "artifact_link_validity", "config_identity_completeness", "source_version_identity_completeness", "child_token_limit_completeness",
]
#: Gates that nothing to judge passes; the others fail then.
PASS_EMPTY = ["table_validation_rate", "artifact_link_validity"]


def _gate(name: str, valid: Column) -> list[Column]:
    return [F.count_if(F.coalesce(valid, F.lit(False))).alias(f"{name}_valid"), F.count("*").alias(f"{name}_total")]


def integrity(versions: DataFrame, children: DataFrame, tables: DataFrame, links: DataFrame, config: Column, dimensions: int, most_tokens: int) -> DataFrame:
    """gate, valid, total and ratio (six places) of the twelve gates.

    versions, the active ones: completed, source_fidelity, structured_limit (their checkpoints' values), config (its hash),
    source_hash, stored_hash; children: text, embedding_text, prefix, embedding, n_spans, n_tokens; tables: accepted; links:
    ok. ``config`` is the hash that versions must have. Four aggregates, each of one row; counts merge on the map side.
    """
    prefixed = F.trim(F.coalesce("prefix", F.lit(""))) != ""
    plain = F.when(prefixed, F.col("embedding_text") == F.concat("prefix", F.lit("\n\n"), "text")).otherwise(F.col("embedding_text") == F.col("text"))
    parts = [
        versions.agg(
            *_gate("parse_completeness", F.col("completed")), *_gate("source_fidelity_completeness", F.col("source_fidelity") == 1.0), *_gate("structured_limit_completeness", F.col("structured_limit") == 1.0),
            *_gate("config_identity_completeness", F.col("config") == config), *_gate("source_version_identity_completeness", F.col("source_hash") == F.col("stored_hash")),
        ),
        children.agg(
            *_gate("contextual_prefix_completeness", prefixed), *_gate("plain_embedding_completeness", plain), *_gate("embedding_completeness", V.valid(F.col("embedding"), dimensions)),
            *_gate("source_span_validity", F.col("n_spans") > 0), *_gate("child_token_limit_completeness", F.col("n_tokens") <= most_tokens),
        ),
        tables.agg(*_gate("table_validation_rate", F.col("accepted"))),
        links.agg(*_gate("artifact_link_validity", F.col("ok"))),
    ]
    out = None
    for p in parts:
        names = [c.removesuffix("_valid") for c in p.columns if c.endswith("_valid")]
        rows = p.select(F.inline(F.array(*[F.struct(F.lit(n).alias("gate"), F.col(f"{n}_valid").alias("valid"), F.col(f"{n}_total").alias("total")) for n in names])))
        out = rows if out is None else out.unionByName(rows)
    empty = F.when(F.col("gate").isin(PASS_EMPTY), 1.0).otherwise(0.0)
    return out.withColumn("ratio", F.when(F.col("total") == 0, empty).otherwise(F.bround(F.col("valid") / F.col("total"), 6)))


def document_issues(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """document_id, code, severity and repairable of what parsed documents lack.

    documents: document_id, expected_pages, parsed_pages (an array), assets (an array of paths), has_abstract; blocks:
    document_id, reading_order, block_type, text, caption, retrievable. Pages must all be there, content must be, the reading
    order must be 0 to n-1, assets must be paths of the bundle's own, an abstract is wanted, figures need a caption or a
    text and formulas a text. One grouped aggregate over the blocks.
    """
    text = F.trim(F.coalesce("text", F.lit(""))) != ""
    of = blocks.groupBy("document_id").agg(
        F.count_if(F.coalesce("retrievable", F.lit(True)) & text).alias("_content"), F.count("*").alias("_n"), F.count_distinct("reading_order").alias("_orders"), F.min("reading_order").alias("_least"), F.max("reading_order").alias("_most"),
        F.count_if((F.col("block_type") == "figure") & ~text & (F.trim(F.coalesce("caption", F.lit(""))) == "")).alias("_figures"), F.count_if((F.col("block_type") == "formula") & ~text).alias("_formulas"),
    )
    d = documents.join(of, "document_id", "left")
    pages = F.when(F.col("expected_pages") > 0, F.size(F.array_except(F.sequence(F.lit(0), F.col("expected_pages") - 1), "parsed_pages"))).otherwise(0)
    disorder = (F.col("_orders") != F.col("_n")) | (F.col("_least") != 0) | (F.col("_most") != F.col("_n") - 1)
    unsafe = F.exists(F.coalesce("assets", F.array().cast("array<string>")), lambda p: p.startswith("/") | p.rlike(r"(^|/)\.\.(/|$)") | p.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"))
    rules = [
        ("page_missing", pages > 0, "fatal", False),
        ("content_empty", F.coalesce("_content", F.lit(0)) == 0, "fatal", False),
        ("reading_order_invalid", F.coalesce(disorder, F.lit(False)), "fatal", False),
        ("asset_path_unsafe", unsafe, "error", False),
        ("abstract_missing", ~F.coalesce("has_abstract", F.lit(False)), "warning", False),
        ("figure_empty", F.coalesce("_figures", F.lit(0)) > 0, "error", True),
        ("formula_empty", F.coalesce("_formulas", F.lit(0)) > 0, "error", True),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("code"), F.lit(s).alias("severity"), F.lit(r).alias("repairable"))) for n, c, s, r in rules]), lambda x: x.isNotNull())
    return d.select("document_id", F.inline(found))
