"""Evidence of claims among their document's chunks, all of a document's strings looked for in one scan of each chunk."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How much of an excerpt is looked for, one after the other, and what is too short to be looked for (fixed values).
EXCERPTS, EXCERPT_LEAST, OBJECT_MOST, OBJECT_LEAST, SUBJECT_LEAST = (160, 80), 8, 120, 6, 2
#: Chunks of a document that are scanned together; a document of more is several groups.
GROUP = 2000


def patterns(claims: DataFrame) -> DataFrame:
    """claim_id, document_id, priority and pattern: the strings that a claim is looked for by, as the cascade has them: its excerpt
    whole, then its beginnings, then its object's beginning, then its subject."""
    e, o, s = (F.trim(F.coalesce(c, F.lit(""))) for c in ("evidence", "object_text", "subject"))
    of = lambda p, text, least: F.when(F.length(text) >= least, F.struct(F.lit(p).alias("priority"), text.alias("pattern")))
    some = [of(3, e, EXCERPT_LEAST), *[of(4 + i, F.substring(e, 1, n), EXCERPT_LEAST) for i, n in enumerate(EXCERPTS)]]
    some += [F.when(F.length(o) >= OBJECT_LEAST, F.struct(F.lit(6).alias("priority"), F.substring(o, 1, OBJECT_MOST).alias("pattern"))), of(7, s, SUBJECT_LEAST)]
    return claims.select("claim_id", "document_id", F.explode(F.filter(F.array(*some), lambda x: x.isNotNull())).alias("_p")).select("claim_id", "document_id", "_p.priority", "_p.pattern")


def first_chunks(strings: DataFrame, chunks: DataFrame, group: int = GROUP) -> DataFrame:
    """document_id, pattern, ordinal and chunk_id: the first chunk (document_id, chunk_id, ordinal, text) of each string
    (document_id, pattern) that is in one.

    Chunks go in groups of consecutive ordinals, and a document's distinct strings to each of its groups, where an automaton
    of them scans every chunk once: no claim meets a chunk as a row. Groups' first chunks merge by their minimum.
    """
    named = strings.select("document_id", "pattern").distinct()
    placed = chunks.withColumn("_group", F.floor(F.col("ordinal") / group).cast("long"))
    groups = placed.select("document_id", "_group").distinct()
    sent = named.join(groups, "document_id").withColumnsRenamed({"document_id": "_d", "_group": "_g"})
    kind = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}

    def scan(own: pa.Table, wanted: pa.Table) -> pa.Table:
        left: set[str] = set(wanted.column("pattern").to_pylist())
        found: list[tuple[str, int, object]] = []
        if left and own.num_rows:
            machine = ahocorasick.Automaton()
            for p in left:
                machine.add_word(p, p)
            machine.make_automaton()
            rows = sorted(zip(own.column("ordinal").to_pylist(), own.column("chunk_id").to_pylist(), own.column("text").to_pylist(), strict=True), key=lambda r: r[:2])
            for ordinal, chunk, text in rows:
                here = {p for _, p in machine.iter(text or "")} & left if text else set()
                found += [(p, ordinal, chunk) for p in here]
                left -= here
                if not left:
                    break
        document = own.column("document_id")[0].as_py() if own.num_rows else None
        return pa.table({
            "document_id": pa.array([document] * len(found), own.schema.field("document_id").type), "pattern": pa.array([p for p, _, _ in found], pa.string()),
            "ordinal": pa.array([o for _, o, _ in found], pa.int32()), "chunk_id": pa.array([c for _, _, c in found], own.schema.field("chunk_id").type),
        })

    schema = f"document_id {kind['document_id']}, pattern string, ordinal int, chunk_id {kind['chunk_id']}"
    both = placed.select("document_id", "_group", "chunk_id", F.col("ordinal").cast("int").alias("ordinal"), "text").groupBy("document_id", "_group").cogroup(sent.groupBy("_d", "_g"))
    each = both.applyInArrow(scan, schema)
    return each.groupBy("document_id", "pattern").agg(F.min(F.struct("ordinal", "chunk_id")).alias("_m")).select("document_id", "pattern", "_m.ordinal", "_m.chunk_id")


def resolved(claims: DataFrame, chunks: DataFrame, group: int = GROUP) -> DataFrame:
    """claim_id, chunk_id and priority of each claim's evidence; claims without any are left out.

    claims: claim_id, document_id, sentence_refs (chunk-n:sentence-m), ordinals, evidence, object_text, subject. The first of the
    sentences whose chunk is there counts (1), else the first of the ordinals (2), else the first chunk with the excerpt
    (3) or its beginning (4, 5), its object (6) or its subject (7), to the letter. Of chunks with one ordinal the least
    id counts. Only claims that the first two don't find are searched for.
    """
    c = chunks.groupBy("document_id", "ordinal").agg(F.min("chunk_id").alias("chunk_id"))
    refs = claims.select("claim_id", "document_id", F.posexplode("sentence_refs").alias("_i", "_r")).select("claim_id", "document_id", F.lit(1).alias("priority"), "_i", F.nullif(F.regexp_extract("_r", r"^chunk-(\d+):sentence-\d+", 1), F.lit("")).cast("int").alias("ordinal"))
    direct = refs.unionByName(claims.select("claim_id", "document_id", F.lit(2).alias("priority"), F.posexplode("ordinals").alias("_i", "ordinal")))
    least = F.min_by(F.struct("chunk_id", "priority"), F.struct("priority", "_i")).alias("_b")
    known = direct.join(c, ["document_id", "ordinal"]).groupBy("claim_id").agg(least)
    strings = patterns(claims.join(known.select("claim_id"), "claim_id", "left_anti"))
    searched = strings.join(first_chunks(strings, chunks, group).drop("ordinal"), ["document_id", "pattern"]).withColumn("_i", F.lit(0)).groupBy("claim_id").agg(least)
    return known.unionByName(searched).select("claim_id", "_b.chunk_id", "_b.priority")
