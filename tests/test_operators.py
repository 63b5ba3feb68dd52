import random

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st
from lumenary.operators import chunking, graph, knn, retrieval, tables, versions
from pyspark.sql import functions as F


def test_active_children_tolerates_nulls(spark):
    docs = spark.createDataFrame([(1, "v1"), (2, None), (3, "legacy")], "document_id long, active_parse_version string")
    rows = [(1, "v1", "child", "narrative"), (1, "v0", "child", "narrative"), (1, "v1", "child", None), (1, "v1", "parent", "narrative"), (2, None, None, None), (2, None, None, "reference"), (3, "legacy", "child", "x"), (3, "v1", "child", "x")]
    chunks = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, document_id long, parse_version string, chunk_role string, block_type string")
    assert sorted(r.id for r in versions.select_children(chunks, docs).collect()) == [0, 4, 6]
    shadow = spark.createDataFrame([(1, "v0"), (3, " ")], "document_id long, version_key string")
    assert sorted(r.id for r in versions.select_children(chunks, docs, shadow).collect()) == [1, 4, 6]


def test_activation_is_all_or_nothing(spark):
    docs = spark.createDataFrame([(1, "v1"), (2, None)], "document_id long, active_parse_version string")
    bad = spark.createDataFrame([(1, "v2", 3, 3, 3), (2, "v2", 3, 2, 3)], "document_id long, version_key string, expected long, indexed long, embedded long")
    assert {r.document_id: r.active_parse_version for r in versions.next_pointers(docs, bad).collect()} == {1: "v1", 2: None}
    assert {r.document_id: r.active_parse_version for r in versions.next_pointers(docs, bad.where("document_id = 1")).collect()} == {1: "v2", 2: None}


def test_knn_breaks_ties_and_skips_bad_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [0.0, 1.0]), (7, [float("nan"), 1.0])], "document_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r.document_id, r.cosine) for r in knn.top_k(v, q, 3, 2).orderBy(F.desc("cosine"), "document_id").collect()] == [(1, 1.0), (2, 1.0), (6, 0.0)]


def test_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([(1, 1, 10, 50), (1, 2, 11, 60), (1, 3, 12, 30)], "query_id long, rank int, document_id long, tokens long")
    got = retrieval.pack_budget(rows, "query_id long, rank int, document_id long, used long, kind string", budget=85, fallback=40).orderBy("rank").collect()
    assert [(r.document_id, r.used, r.kind) for r in got] == [(10, 50, "full"), (12, 30, "full")] or [(r.document_id, r.used, r.kind) for r in got] == [(10, 50, "full"), (12, 30, "excerpt")]


def test_required_slots(spark):
    rows = spark.createDataFrame([(1, i, "table" if i == 9 else "prose") for i in range(1, 10)], "query_id long, rank int, kind string")
    got = chunking.required_slots(rows, "query_id long, rank int, kind string", 3).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 9]


def test_html_spans_are_anchored_once():
    html = "<table><tbody><tr><th rowspan=2>a</th><td colspan='2'>b</td></tr><tr><td>c</td><td>d</td></tr></tbody><tbody><tr><td rowspan=9>e<td>f</tr></table>"
    assert [x[1:] for x in tables.html_cells(html)] == [(0, 0, 2, 1, True, "a"), (0, 1, 1, 2, False, "b"), (1, 1, 1, 1, False, "c"), (1, 2, 1, 1, False, "d"), (2, 0, 1, 1, False, "e"), (2, 1, 1, 1, False, "f")]


def test_facts_fill_labels_and_skip_dashes(spark):
    m = "| m | a | b |\n|---|---|---|\n| x | 1 | - |\n|  | 2 | 3 |\n| m | a | b |"
    got = tables.facts(spark.createDataFrame([("t", m)], "table_id string, markdown string")).collect()
    assert sorted((r.row_label, r.column_name, r.value) for r in got) == [("x", "a", "1"), ("x", "a", "2"), ("x", "b", "3")]


def test_validate_finds_overlaps_and_gaps(spark):
    c = spark.createDataFrame([("t", 0, 0, 2, 1), ("t", 1, 0, 1, 1), ("t", 1, 2, 1, 1)], "table_id string, row_index int, column_index int, rowspan int, colspan int")
    assert {(r.code, r.n) for r in tables.validate(c).collect()} == {("overlap", 1), ("gap", 3)}


def test_claim_rules(spark):
    claims = spark.createDataFrame(
        [(1, 1, "Aspirin", "treats", "pain", 0.9, "relation", "", "c1"), (2, 1, "aspirin", "Treats", "Pain", 0.9, "relation", "", "c1"), (3, 1, "X", "is", "x", 0.5, "source_fact", "", None), (4, 1, "", "is", "y", 0.9, "relation", "Q", None)],
        "claim_id long, document_id long, subject string, predicate string, object_text string, confidence double, relation_type string, expected_head string, evidence_chunk_id string",
    )
    previous = spark.createDataFrame([("aspirin", "treats", "fever")], "subject string, predicate string, object_text string")
    evidence = spark.createDataFrame([("c1", 1, "Aspirin helps.")], "chunk_id string, document_id long, text string")
    got = {r.claim_id: r.errors for r in graph.verify(claims, previous, evidence).collect()}
    assert got == {1: ["potential_conflict"], 2: ["duplicate", "potential_conflict"], 3: ["head_tail_contradiction"], 4: ["format_error", "head_entity_error", "missing_evidence"]}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?。\nA1", max_size=400), st.integers(1, 20))
@example("1111111111?11111", 3)
def test_chunks_tile_the_text(text, most):
    assert "".join(text[a:b] for a, b in chunking.sentences(text)) == text
    got = chunking.chunk(text, target=most // 2, most=most, overlap=3)
    assert "".join(text[a:b] for a, b, _ in got) == text
    assert all(chunking.count_tokens(t) <= most for _, _, t in got)


def test_sentences_keep_abbreviations_and_decimals():
    t = "See Fig. 2.5 by J. Doe et al. here. Next one! 水。End"
    assert [t[a:b].strip() for a, b in chunking.sentences(t)] == ["See Fig. 2.5 by J. Doe et al. here.", "Next one!", "水。", "End"]


def test_copied_share():
    assert chunking.copied_share("the quick brown fox", "quick brown") == 1.0
    assert chunking.copied_share("abc", "abc") == 0.0


def test_overlaps_equal_sets(spark):
    random.seed(3)
    v = [f"word{i}" for i in range(30)]
    docs = [(i, " ".join(random.choices(v, k=10))) for i in range(40)]
    qs = [(i, " ".join(random.choices(v, k=5))) for i in range(5)]
    got = {(r.query_id, r.document_id): r.overlap for r in retrieval.overlaps(spark.createDataFrame(qs, "query_id long, text string"), spark.createDataFrame(docs, "document_id long, text string")).collect()}
    want = {(q, d): n for q, a in qs for d, b in docs if (n := len(set(a.split()) & set(b.split())))}
    assert got == want


def test_snippets_of_long_texts(spark, tmp_path):
    from lumenary.functions import text as T
    from lumenary.plans import passages
    from pyspark.sql import functions as F

    long = " ".join(f"Sentence number {i} is here." for i in range(400)) + "\n" + "x" * 500 + "? 完。"
    df = spark.createDataFrame([(1, long, len(long)), (2, "A. B!", None), (3, None, None), (4, "", 0)], "doc_id long, text string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, passages.c5_packed_snippets(spark, str(tmp_path)).collect()))
    want = sorted(map(tuple, df.select("doc_id", F.posexplode(T.packed_snippets(T.sentences(F.col("text")), 320))).collect()))
    assert got == want and {r[0] for r in got} == {1, 2} and max(len(r[2]) for r in got if "x" * 9 not in r[2]) <= 320


def test_short_tails_are_rebalanced():
    group = lambda sizes: chunking.group(["w" * 4 * n for n in sizes], 400, 600, least=180)
    assert group([450, 200, 300, 150]) == [(0, 1), (1, 2), (2, 4)]
    total = lambda sizes: lambda a, z: sum(sizes[a:z])
    assert chunking.rebalanced([(0, 2), (2, 3)], total([300, 150, 100]), 180, 600) == [(0, 3)]
    assert chunking.rebalanced([(0, 3), (3, 4)], total([300, 150, 100, 100]), 180, 600) == [(0, 2), (2, 4)]
    assert chunking.rebalanced([(0, 1), (1, 2)], total([550, 100]), 180, 600) == [(0, 1), (1, 2)]
