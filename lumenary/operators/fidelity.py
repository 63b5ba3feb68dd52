"""Audits of chunks against their source: one row for each thing that can't be made whole again from the chunks.

All audits are joins and windows over the source's and the chunks' rows; none walks a document. A document without rows in the
result is kept whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Most tokens of a child (fixed value).
CHILD_TOKENS = 600


def texts(children: DataFrame, most: int = CHILD_TOKENS, tokens: Callable[[Column], Column] = T.token_estimate) -> DataFrame:
    """document_id, source_id and reason of children (document_id, chunk_id, text, embedding_text, token_count) whose text for
    the embedding is another than their own, whose count of tokens isn't what counting yields, or is beyond ``most``."""
    n = tokens(F.col("text"))
    rules = [
        ("child_embedding_text_differs_from_source_text", ~F.col("embedding_text").eqNullSafe(F.col("text"))),
        ("child_token_count_mismatch", ~F.col("token_count").eqNullSafe(n)),
        ("child_token_limit_exceeded", n > most),
    ]
    return children.select("document_id", F.col("chunk_id").alias("source_id"), F.explode(F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in rules]), lambda x: x.isNotNull())).alias("reason"))


def tiling(wholes: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
    """``by``, source_id and reason of parts (``by``, source_id, begin, end) that don't tile their whole (``by``, length): a part
    that begins behind or before the end of the one before it, or is empty or reversed; a whole whose parts end elsewhere than
    it does, or that has none. source_id is null for what concerns a whole. A whole of no length needs no part."""
    w = W.partitionBy(*by).orderBy("begin", "end", "source_id")
    p = parts.select(*by, "source_id", "begin", "end", F.coalesce(F.lag("end").over(w), F.lit(0)).alias("_before"))
    reason = F.when(F.col("end") <= F.col("begin"), "empty_part").when(F.col("begin") > F.col("_before"), "gap_before_part").when(F.col("begin") < F.col("_before"), "overlap_with_part_before")
    bad = p.withColumn("reason", reason).where("reason IS NOT NULL").select(*by, "source_id", "reason")
    ends = parts.groupBy(*by).agg(F.max("end").alias("_end"))
    j = wholes.join(ends, by, "left")
    whole = F.when(F.col("_end").isNull() & (F.col("length") > 0), "no_part").when(F.col("_end") < F.col("length"), "end_not_covered").when(F.col("_end") > F.col("length"), "beyond_the_end")
    return bad.unionByName(j.select(*by, F.lit(None).cast(parts.schema["source_id"].dataType).alias("source_id"), whole.alias("reason")).where("reason IS NOT NULL"))


def units(source: DataFrame, children: DataFrame) -> DataFrame:
    """document_id, source_id and reason of narrative units (document_id, unit_id, block_type, begin, end, text) that no child
    (document_id, chunk_id, block_type, begin, end, text) of their type holds: in its span and, to the letter, in its text.

    Children of a type are ordered and tile, but for faults that ``tiling`` reports; so the child that holds a unit is the
    last one that begins with it or before: one sorted pass over both.
    """
    both = source.select("document_id", "block_type", "begin", F.lit(1).alias("_order"), F.struct("unit_id", "end", "text").alias("_unit"), F.lit(None).cast("struct<end:long,text:string>").alias("_child")).unionByName(
        children.select("document_id", "block_type", "begin", F.lit(0).alias("_order"), F.lit(None).alias("_unit"), F.struct(F.col("end").cast("long").alias("end"), "text").alias("_child"))
    )
    w = W.partitionBy("document_id", "block_type").orderBy("begin", "_order", F.col("_child.end")).rowsBetween(W.unboundedPreceding, 0)
    at = both.withColumn("_child", F.last("_child", ignorenulls=True).over(w)).where("_unit IS NOT NULL")
    held = (F.col("_child.end") >= F.col("_unit.end")) & F.contains(F.col("_child.text"), F.col("_unit.text"))
    return at.where(~F.coalesce(held, F.lit(False))).select("document_id", F.col("_unit.unit_id").alias("source_id"), F.lit("narrative_source_unit_not_reconstructable").alias("reason"))


def fragments(source: DataFrame, pieces: DataFrame) -> DataFrame:
    """source_id and reason of texts (source_id, text) that their pieces (source_id, begin, end, fragment) don't make up: each as
    long as its span, equal where they begin together, one behind the other, the whole text in the end. A text that is empty
    needs none."""
    p = pieces.distinct().withColumn("_ok", (F.length("fragment") == F.col("end") - F.col("begin")) & (F.col("begin") >= 0)).where("_ok")
    w = W.partitionBy("source_id").orderBy("begin", "end", "fragment")
    chained = p.withColumn("_fits", F.col("begin") == F.coalesce(F.lag("end").over(w), F.lit(0)))
    j = chained.join(source.select("source_id", F.col("text").alias("_whole")), "source_id")
    same = F.substring(F.col("_whole"), F.col("begin") + 1, F.length("fragment")) == F.col("fragment")
    g = j.groupBy("source_id").agg(F.min(F.col("_fits") & same).alias("_all"), F.max("end").alias("_end"))
    out = source.join(g, "source_id", "left").where((F.coalesce(F.length("text"), F.lit(0)) > 0) & ~F.coalesce(F.col("_all") & (F.col("_end") == F.length("text")), F.lit(False)))
    return out.select("source_id", F.lit("source_fragments_not_reconstructable").alias("reason"))


def tables(source: DataFrame, chunks: DataFrame) -> DataFrame:
    """table_id, detail and reason of what chunks lose of tables (table_id, block_id, caption, headers, rows, footnotes).

    Chunks (table_id, chunk_id, parent_id, chunk_role, source_block_ids, text, headers, row_indices, rows) must have a parent that
    names the table's block, with a child, and each of them names it. The caption and the footnotes stand in a text, or are a
    caption of a chunk; the headers are a chunk's, or stand in a text as a row; every row is, by its number, a row of a chunk.
    """
    parents = source.select("table_id", "block_id").join(chunks.where("chunk_role = 'parent'").select("table_id", F.col("chunk_id").alias("_p"), "source_block_ids"), "table_id").where(F.array_contains("source_block_ids", F.col("block_id"))).select("table_id", "_p")
    of = F.when(F.col("chunk_role") == "parent", F.col("chunk_id")).otherwise(F.col("parent_id"))
    own = chunks.withColumn("_p", of).join(parents, ["table_id", "_p"], "left_semi")
    has = own.groupBy("table_id").agg(F.count_if(F.col("chunk_role") == "child").alias("_children"))
    j = source.join(has, "table_id", "left")
    missing = j.where(F.coalesce("_children", F.lit(0)) == 0).select("table_id", F.lit(None).cast("string").alias("detail"), F.lit("structured_source_missing_from_chunk_graph").alias("reason"))
    present = j.where("_children > 0").drop("_children")
    here = present.select("table_id", "block_id", "caption", "headers", "footnotes").join(own.select("table_id", "chunk_id", "source_block_ids", "text", F.col("headers").alias("_headers")), "table_id")
    provenance = here.where(~F.coalesce(F.array_contains("source_block_ids", F.col("block_id")), F.lit(False))).select("table_id", F.col("chunk_id").alias("detail"), F.lit("structured_source_provenance_missing").alias("reason"))
    line = F.concat(F.lit("| "), F.array_join("headers", " | "), F.lit(" |"))
    said = F.struct(F.lit("").alias("d"), F.lit("table_caption_not_reconstructable").alias("r"), ((F.coalesce("caption", F.lit("")) == "") | F.contains("text", F.col("caption"))).alias("ok"))
    head = F.struct(F.lit("").alias("d"), F.lit("table_headers_not_reconstructable").alias("r"), ((F.coalesce(F.size("headers"), F.lit(0)) <= 0) | F.col("_headers").eqNullSafe(F.col("headers")) | F.contains("text", line)).alias("ok"))
    notes = F.transform(F.coalesce("footnotes", F.array().cast("array<string>")), lambda x: F.struct(x.alias("d"), F.lit("table_footnote_not_reconstructable").alias("r"), F.contains(F.col("text"), x).alias("ok")))
    words = here.select("table_id", F.explode(F.concat(F.array(said, head), notes)).alias("_s")).groupBy("table_id", F.nullif("_s.d", F.lit("")).alias("detail"), F.col("_s.r").alias("reason")).agg(F.max(F.coalesce("_s.ok", F.lit(False))).alias("_ok")).where("NOT _ok").drop("_ok")
    kept = own.where(F.size("row_indices") == F.size("rows")).select("table_id", F.explode(F.arrays_zip("row_indices", "rows")).alias("_r")).select("table_id", F.col("_r.row_indices").alias("_i"), F.col("_r.rows").alias("_row")).distinct()
    rows = present.select("table_id", F.posexplode("rows").alias("_i", "_row")).join(kept.withColumn("_k", F.lit(1)), ["table_id", "_i", "_row"], "left").where("_k IS NULL").select("table_id", F.concat(F.lit("row "), F.col("_i").cast("string")).alias("detail"), F.lit("table_rows_not_reconstructable").alias("reason"))
    return missing.unionByName(provenance).unionByName(words).unionByName(rows)
