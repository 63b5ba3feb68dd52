import re

import pytest
from lumenary.operators import blocks as B
from lumenary.operators import chunking, gates
from lumenary.operators import graph as G
from lumenary.operators import structures as ST
from lumenary.operators import tables as TB
from lumenary.sources import sinks
from pyspark.sql import functions as F


def test_table_chunks_cover_the_table():
    rows = [["a", "1", "x*"], ["", "2", "y"], ["b", "3", "long " * 40], ["b", "4", "z"]]
    for most in (12, 30, 500):
        parent, *children = ST.table_chunks("Caption", ["k", "n", "t"], rows, ["* a mark", "no mark here"], most)
        assert parent[0] == "parent" and all(c[0] == "child" for c in children)
        said = {(r, c) for x in children if x[4] is None for r in x[2] for c in x[3]}
        pieces = {}
        for x in children:
            if x[4] is not None and x[2]:
                pieces.setdefault((x[2][0], x[3][0]), []).append((x[4], x[5]))
        for (r, c), spans in pieces.items():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] == len(rows[r][c]) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert said | set(pieces) == {(r, c) for r in range(4) for c in range(3)}
        assert any("* a mark" in x[6] for x in children) and "".join(x[6] for x in children if not x[2] and x[4] is not None).endswith("no mark here")
    assert [x[2] for x in ST.table_chunks(None, ["k", "n", "t"], rows, [], 500)[1:]] == [[0, 1], [2, 3]]


def test_figure_chunks_tile_the_description():
    parent, *children = ST.figure_chunks("Fig. 1", "a.png", "word " * 100, ["nearby text"], 60)
    assert parent[0] == "parent" and "".join(("word " * 100)[a:b] for _, _, a, b, _ in children) == "word " * 100
    assert all(x[4].startswith("Fig. 1\n\n![](a.png)") for x in children)
    assert [x[4] for x in ST.figure_chunks("C", None, None, ["N"], 60)] == ["C\n\nN", "C\n\nN"]


def table(name, region=None, box=None, block=None):
    return {"table_id": name, "region_id": region, "box": box, "block_id": block}


def test_inventories_match_in_one_way_only():
    a, b = (0, 0, 10, 10), (20, 0, 30, 10)
    assert ST.match_inventory([table("x", box=a), table("y", "r")], [table("p", "r", b), table("q", box=(0, 0, 10, 9))]) == [("x", "q", "normalized_bbox"), ("y", "p", "source_region_id")]
    assert ST.match_inventory([table("x", box=a), table("y", box=a)], [table("p", box=a), table("q", box=a)]) is None
    assert ST.match_inventory([table("x", box=a)], [table("p", box=b)]) is None
    assert ST.match_inventory([table("x", block="1"), table("y", block="1")], [table("p", block="1")]) is None
    assert ST.match_inventory([], []) == []


def test_html_tables_as_markdown():
    html = "<table><tr><th rowspan=2>a|b</th><th colspan=2>c</th></tr><tr><td>1</td></tr></table>"
    assert TB.html_markdown(html).split("\n") == ["| a\\|b | c | c |", "| --- | --- | --- |", "| a\\|b | 1 |  |"]
    assert TB.html_markdown(" <p>x</p> ") == "<p>x</p>"


def test_parents_and_children_tile():
    text = "".join(f"Sentence number {i} of a long text stands here, etc. and goes on. " for i in range(700))
    rows = chunking.family(text)
    parents = [r for r in rows if r[1] < 0]
    assert "".join(r[4] for r in parents) == text and all(chunking.count_tokens(r[4]) <= 1800 for r in parents)
    for p in parents:
        children = [r for r in rows if r[0] == p[0] and r[1] >= 0]
        assert children[0][2] == p[2] and children[-1][3] == p[3] and all(a[3] == b[2] for a, b in zip(children, children[1:], strict=False))
    assert [text[a:b] for a, b in chunking.sentences("See etc. and so on. Next, e.g. this. Done etc. Then")] and len(chunking.sentences("x etc. and so on. Done etc. Then")) == 3


def plain_block_score(question_terms, facets, anchors, datasets, tokens, block, key):
    low, score = block.lower(), float(tokens)
    score += 6 * sum(f.lower() in low for f in facets) + 6 * sum(a.lower() in low for a in anchors) + 8 * sum(d.lower() in low for d in datasets)
    specific = [t for t in question_terms if not re.match(B.MODEL, t.lower()) and t.lower() not in B.BROAD]
    met = [t for t in question_terms if (re.search(rf"(^|[^a-z0-9\-]){t}([^a-z0-9\-]|$)", low) if re.fullmatch("[a-z][a-z0-9]*", t) else re.sub("[^a-z0-9]", "", t.lower()) in key)]
    score += sum(1.0 if re.match(B.MODEL, t.lower()) else 1.5 if t.lower() in B.BROAD else 4.0 for t in met)
    if specific:
        hits = sum(t in specific for t in met)
        score += 4.0 * hits if hits else -2.5
    return score + 2 * any(m in low for m in ("f1", "auc", "precision", "recall", "score")) + 1.5 * bool(re.search(r"\d", block))


def test_block_scores(spark):
    q = "RMSE of amber99 against OPLS on NYT in Table 3 for binding"
    block = "Table 3: NYT binding energies\n| amber99 | rmse 1.2 |"
    key = re.sub("[^a-z0-9]", "", block.lower())
    want = plain_block_score(["RMSE", "amber99", "against", "OPLS", "NYT", "binding"], ["Table 3", "NYT"], ["Table 3"], ["NYT"], 5, block, key)
    row = spark.createDataFrame([(q, block)], "question string, block string").select(B.block_score(F.col("question"), F.col("block"), F.lit(0)).alias("s"), B.block_matches(F.col("question"), F.col("block")).alias("m"), B.group_matches(F.col("question"), F.col("block")).alias("g")).first()
    assert (row.s, row.m, row.g) == (want, True, True)


def test_promotion_of_tables(spark):
    table_text = "| solvent | rmse |\n|---|---|\n| water | 1.5 |"
    rows = [(1, "rmse of water in Table 2", table_text, 1.0), (1, "rmse of water in Table 2", "prose of water", 1.0), (2, "what is water", "prose", 1.0), (3, "the accuracy of copper", "accuracy is 5", 1.0), (3, "the accuracy of copper", table_text, 1.0), (4, "展开第二张", table_text, 1.0)]
    got = B.promote(spark.createDataFrame(rows, "id int, question string, text string, score double")).collect()
    assert [(r.id, r.evidence_kind) for r in got] == [(1, "table"), (2, None), (3, None), (4, "table")] and got[0].score > 41 and got[1].score == 1.0


def test_generated_triples(spark):
    t = spark.createDataFrame([(1, 1, "H", "H", "is", "thing"), (2, 1, "H", "h", "IS", "Thing"), (3, 1, "H", "X", "p", "x"), (4, 1, "H", "", "p", "o"), (5, 1, "H", "H", "was", "nowhere")], "triple_id long, document_id long, head string, subject string, predicate string, object_text string")
    before = spark.createDataFrame([("h", "was", "other")], "subject string, predicate string, object_text string")
    contexts = spark.createDataFrame([(1, "c", "the thing is here")], "document_id long, chunk_id string, text string")
    got = {r.triple_id: sorted(r.errors) for r in G.generated_errors(t, before, contexts).collect()}
    assert got == {1: [], 2: ["duplicate"], 3: ["head_entity_error", "head_tail_contradiction", "missing_evidence"], 4: ["format_error"], 5: ["missing_evidence", "potential_conflict"]}


def test_kinds_that_grow(spark):
    rows = [("concept", "x", 0, "entity"), ("concept", "x", 0, "tail"), ("Dosage", "x", 5, "entity"), ("thing", "3 weeks", 5, "entity"), ("thing", "y" * 40, 1, "tail"), ("thing", "y", 0, "entity"), ("institution", "z", 1, "tail")]
    df = spark.createDataFrame(rows, "t string, n string, c int, i string")
    assert [r.g for r in df.select(G.growth(F.col("t"), F.col("n"), F.col("c"), F.col("i")).alias("g")).collect()] == ["grow", "keep", "prune", "prune", "keep", "keep", "grow"]


def test_document_rules(spark):
    d = spark.createDataFrame([(1, 2, [0, 1], ["a/b.png"], True), (2, 3, [0], ["/etc/x"], False), (3, 0, [], None, True)], "document_id long, expected_pages int, parsed_pages array<int>, assets array<string>, has_abstract boolean")
    b = spark.createDataFrame([(1, 0, "narrative", "t", None, True), (1, 1, "figure", "", "c", True), (2, 0, "formula", " ", None, True), (2, 2, "figure", None, "", True)], "document_id long, reading_order int, block_type string, text string, caption string, retrievable boolean")
    got = {(r.document_id, r.code) for r in gates.document_issues(d, b).collect()}
    assert got == {(2, c) for c in ("page_missing", "content_empty", "reading_order_invalid", "asset_path_unsafe", "abstract_missing", "figure_empty", "formula_empty")} | {(3, "content_empty")}


def test_bundles_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    for n in (3, 5):
        sinks.write_bundle(spark.range(n), path)
        assert sinks.load_bundle(spark, path).count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["b"]
    spark.range(1).write.mode("overwrite").parquet(f"{sinks.current(spark, path)}/data")
    with pytest.raises(ValueError):
        sinks.load_bundle(spark, path)


def test_a_bundle_that_fails_leaves_the_old_one(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/b"
    sinks.write_bundle(spark.range(3), path)
    with monkeypatch.context() as m:
        m.setattr(sinks, "_point", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            sinks.write_bundle(spark.range(5), path)
    assert sinks.load_bundle(spark, path).count() == 3
    begun = sinks.load_bundle(spark, path)
    manifest = sinks.write_bundle(spark.range(7).repartition(3), path, keep=3)
    assert sum(r.rows for r in manifest.collect()) == 7 and len(manifest.collect()) == 3
    assert begun.count() == 3 and sinks.load_bundle(spark, path).count() == 7
    sinks.write_bundle(spark.range(0), path, keep=1)
    assert sinks.load_bundle(spark, path).count() == 0 and len(list((tmp_path / "b/versions").iterdir())) == 1
