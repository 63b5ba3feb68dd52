"""Versioned scans: which chunks of which parse version a question may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active_child(active: Column, version: Column, role: Column, block: Column) -> Column:
    """Children of the active version, or of a document that has none yet, whose older rows may lack version, role or type."""
    current = active.isNotNull() & (active != "legacy") & (version == active) & (role == "child") & block.isNotNull() & (block != "reference")
    legacy = (active.isNull() | (active == "legacy")) & (version.isNull() | (version == "legacy")) & (role.isNull() | (role == "child")) & (block.isNull() | (block != "reference"))
    return F.coalesce(current, F.lit(False)) | F.coalesce(legacy, F.lit(False))


def select_children(chunks: DataFrame, documents: DataFrame, shadow: DataFrame | None = None) -> DataFrame:
    """Chunks (document_id, parse_version, chunk_role, block_type, ...) that documents (document_id,
    active_parse_version) select; ``shadow`` (document_id, version_key) overrides the active version where it has one."""
    d = documents.select("document_id", "active_parse_version")
    if shadow is not None:
        d = d.join(shadow.where(F.trim("version_key") != "").select("document_id", F.col("version_key").alias("_shadow")), "document_id", "left")
    else:
        d = d.withColumn("_shadow", F.lit(None).cast("string"))
    joined = chunks.join(d, "document_id")
    shadowed = (F.col("parse_version") == F.col("_shadow")) & (F.col("chunk_role") == "child") & F.col("block_type").isNotNull() & (F.col("block_type") != "reference")
    keep = F.when(F.col("_shadow").isNotNull(), F.coalesce(shadowed, F.lit(False))).otherwise(active_child(F.col("active_parse_version"), F.col("parse_version"), F.col("chunk_role"), F.col("block_type")))
    return joined.where(keep).select(*[chunks[c] for c in chunks.columns])


def upsert(index: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Delete-then-insert by ``keys``: what ``rows`` has replaces what ``index`` has under the same keys."""
    return index.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows.select(*index.columns))


def next_pointers(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """Version activation, all or nothing: each candidate (document_id, version_key, expected, indexed, embedded) becomes
    active only if the counts of all candidates agree; replaced versions are superseded."""
    ok = candidates.agg(F.coalesce(F.bool_and((F.col("expected") == F.col("indexed")) & (F.col("expected") == F.col("embedded")) & (F.col("expected") > 0)), F.lit(False)).alias("_ok"))
    joined = documents.join(candidates.select("document_id", "version_key"), "document_id", "left").join(F.broadcast(ok))  # one row
    move = F.col("_ok") & F.col("version_key").isNotNull()
    return joined.select("document_id", F.when(move, F.col("version_key")).otherwise(F.col("active_parse_version")).alias("active_parse_version"), F.when(move & ~F.col("active_parse_version").eqNullSafe(F.col("version_key")), F.col("active_parse_version")).alias("superseded_version"))


#: Rows that a task compares, and copies of a row that are laid out at once.
PART_ROWS, COPIES = 2_000_000, 100_000


def unmatched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``key`` of the rows of either side that the other side has no row for, as often as they stand there; null meets nothing.

    Both sides' rows are counted by key in parts of PART_ROWS rows, as many as the tables need, so that a task's memory
    doesn't grow with them; a frequent key is one row of counts.
    """
    parts = -(-(a.count() + b.count()) // PART_ROWS) or 1
    rows = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionAll(b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    n = rows.repartition(parts, key).groupBy(key).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    alone = n.where(F.col(key).isNull() | (F.col("_a") == 0) | (F.col("_b") == 0)).withColumn("_n", F.col("_a") + F.col("_b"))
    begins = alone.select(key, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES).cast("long"))).alias("_at"))
    return begins.select(key, F.explode(F.array_repeat(F.lit(True), F.least(F.col("_n") - F.col("_at"), F.lit(COPIES)).cast("int"))).alias("_one")).select(key)
