from lumenary.operators import chunking
from lumenary.operators import fidelity as FI
from lumenary.operators import structures as ST
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def reasons(df):
    return sorted(r.reason for r in df.collect())


def test_real_chunks_pass_and_each_change_is_found(spark):
    """What the chunkers make of the documents tiles them and holds their sentences; one change at a time is reported."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 0").select("doc_id", "text").distinct()
    families = chunking.families(docs).cache()
    own = families.where("child = -1").select("doc_id", F.col("parent").alias("source_id"), "begin", "end").cache()
    wholes = docs.select("doc_id", F.length("text").alias("length"))
    assert FI.tiling(wholes, own, ["doc_id"]).count() == 0
    assert set(reasons(FI.tiling(wholes, own.where("source_id > 0"), ["doc_id"]))) == {"gap_before_part", "no_part"}
    assert set(reasons(FI.tiling(wholes, own.withColumn("end", F.col("end") + 1), ["doc_id"]))) == {"overlap_with_part_before", "beyond_the_end"}
    assert set(reasons(FI.tiling(wholes, own.withColumn("end", F.when(F.col("source_id") == 0, F.col("begin")).otherwise(F.col("end"))), ["doc_id"]))) == {"empty_part", "gap_before_part", "end_not_covered"}
    inner = families.where("child >= 0").select("doc_id", "parent", F.col("child").alias("source_id"), "begin", "end")
    parents = own.select("doc_id", F.col("source_id").alias("parent"), F.col("begin").alias("_b"), (F.col("end") - F.col("begin")).alias("length"))
    assert FI.tiling(parents, inner.join(parents, ["doc_id", "parent"]).select("doc_id", "parent", "source_id", (F.col("begin") - F.col("_b")).alias("begin"), (F.col("end") - F.col("_b")).alias("end")), ["doc_id", "parent"]).count() == 0


def test_units_and_texts(spark):
    units = spark.createDataFrame([(1, "u1", "narrative", 0, 4, "abc."), (1, "u2", "narrative", 4, 8, "def."), (1, "u3", "appendix", 0, 3, "xyz"), (2, "u1", "narrative", 0, 2, "no")], "document_id long, unit_id string, block_type string, begin long, end long, text string")
    kinds = "document_id long, chunk_id string, block_type string, begin int, end int, text string, embedding_text string, token_count long"
    good = [(1, "c1", "narrative", 0, 4, "abc.", "abc.", 1), (1, "c2", "narrative", 4, 8, "abc.def.", "abc.def.", 2), (1, "c3", "appendix", 0, 3, "xyz", "xyz", 1), (2, "c1", "narrative", 0, 2, "no", "no", 1)]
    assert FI.units(units, spark.createDataFrame(good, kinds)).count() == 0 and FI.texts(spark.createDataFrame(good, kinds)).count() == 0

    def lost(change):
        rows = [r for r in map(change, good) if r]
        return sorted((r.document_id, r.source_id) for r in FI.units(units, spark.createDataFrame(rows, kinds)).collect())

    assert lost(lambda r: None if r[1] == "c2" else r) == [(1, "u2")]
    assert lost(lambda r: (*r[:5], "dxf.", *r[6:]) if r[1] == "c2" else r) == [(1, "u2")]
    # Of its type: the narrative child at the same place doesn't hold the appendix.
    assert lost(lambda r: (r[0], r[1], "narrative", *r[3:])) == [(1, "u3")]
    bad = [(1, "a", "narrative", 0, 1, "x", "y", 1), (1, "b", "narrative", 0, 1, "x", None, 1), (1, "c", "narrative", 0, 1, "x" * 40, "x" * 40, 9), (1, "d", "narrative", 0, 1, "x" * 4000, "x" * 4000, 1000)]
    got = sorted((r.source_id, r.reason) for r in FI.texts(spark.createDataFrame(bad, kinds)).collect())
    assert got == [("a", "child_embedding_text_differs_from_source_text"), ("b", "child_embedding_text_differs_from_source_text"), ("c", "child_token_count_mismatch"), ("d", "child_token_limit_exceeded")]


def test_fragments(spark):
    source = spark.createDataFrame([(1, "abcdef"), (2, ""), (3, "xy"), (4, "abab")], "source_id long, text string")
    kinds = "source_id long, begin int, end int, fragment string"
    good = [(1, 0, 4, "abcd"), (1, 4, 6, "ef"), (1, 4, 6, "ef"), (3, 0, 2, "xy"), (4, 0, 2, "ab"), (4, 2, 4, "ab")]
    lost = lambda rows: sorted(r.source_id for r in FI.fragments(source, spark.createDataFrame(rows, kinds)).collect())
    assert lost(good) == [] and lost(good[:1]) == [1, 3, 4] and lost([*good, (1, 4, 6, "eg")]) == [1] and lost([*good[:5], (4, 2, 4, "ba")]) == [4]
    assert lost([*good, (1, 4, 9, "ef")]) == []  # a piece that isn't as long as its span counts for nothing


def test_tables(spark):
    caption, headers, rows, notes = "Caption", ["k", "n"], [["a", "1*"], ["b", "2"], ["b", "3"]], ["* a mark", "no mark"]
    source = spark.createDataFrame([("t", "b1", caption, headers, rows, notes)], "table_id string, block_id string, caption string, headers array<string>, rows array<array<string>>, footnotes array<string>")
    kinds = "table_id string, chunk_id string, parent_id string, chunk_role string, source_block_ids array<string>, text string, headers array<string>, row_indices array<int>, rows array<array<string>>"
    made = ST.table_chunks(caption, headers, rows, notes, 14)
    good = [("t", f"c{i}", None if role == "parent" else "c0", role, ["b1"], text, headers, some if len(columns) == 2 and begin is None else [], [rows[r] for r in some] if len(columns) == 2 and begin is None else []) for i, (role, _, some, columns, begin, _, text) in enumerate(made)]

    def found(chunks):
        return sorted((r.reason, r.detail) for r in FI.tables(source, spark.createDataFrame(chunks, kinds)).collect())

    assert len(good) > 3 and found(good) == []
    assert found(good[:1]) == [("structured_source_missing_from_chunk_graph", None)] == found(good[1:])
    cut = [(*c[:5], c[5].replace("Caption", "").replace("no mark", ""), None, c[7], c[8]) for c in good]
    assert found(cut) == [("table_caption_not_reconstructable", None), ("table_footnote_not_reconstructable", "no mark")]
    assert found([(*c[:5], c[5].replace("| k | n |", ""), ["k"], [i for i in c[7] if i != 1], [r for i, r in zip(c[7], c[8], strict=True) if i != 1]) for c in good]) == [("table_headers_not_reconstructable", None), ("table_rows_not_reconstructable", "row 1")]
    assert found([*good[:-1], (*good[-1][:4], ["other"], *good[-1][5:])])[-1][0] == "structured_source_provenance_missing"
