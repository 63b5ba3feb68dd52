import json

import pytest
from lumenary.sources import adapters as A
from lumenary.sources import sinks
from lumenary.streaming.ingest import compact, current, ingest


def test_dispatch_and_files(spark, tmp_path):
    (tmp_path / "a.MD").write_text("# x")
    (tmp_path / "b.bin").write_bytes(b"\0")
    got = {r.path.rsplit("/", 1)[1]: r.format for r in A.read_files(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.MD": "markdown", "b.bin": "text"}


def test_markdown():
    md = "# Title\n\nSome *text*\nmore.\n\nSetext\n---\n| a | b |\n|---|---|\n| 1 | 2 |\n\n$$\nx^2\n$$\n\n```py\n# no heading\n```\n![alt](x.png)\n## 3. References\nSomeone 2020"
    assert [x[:2] for x in A.markdown_blocks(md)] == [("heading", 1), ("paragraph", 0), ("heading", 2), ("table", 0), ("formula", 0), ("code", 0), ("figure", 0), ("heading", 2), ("reference", 0)]
    assert A.markdown_blocks(None) == [] and A.markdown_blocks("") == []


def test_html():
    h = "<html><nav>menu</nav><h2>Head</h2><p>One <b>two</b></p><script>x()</script><pre>a\n b</pre><img alt='pic'><p></p></html>"
    assert A.html_blocks(h) == [("heading", 2, "Head"), ("paragraph", 0, "One two"), ("code", 0, "a\n b"), ("figure", 0, "pic")]
    assert A.html_blocks(None) == []


def test_layout(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([[{"type": "title", "text": "T"}, {"type": "paragraph", "content": "P"}], []]))
    got = [(r.page_index, r.type, r.text) for r in A.layout_items(spark, f"file://{tmp_path}").orderBy("page_index", "ordinal").collect()]
    assert got == [(0, "title", "T"), (0, "paragraph", "P"), (1, None, None)]


def test_reports(spark, tmp_path):
    for name, text in (("a", '{"x": 1}'), ("b", "{bad"), ("c", "[1]")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(text)
    assert sorted((r.path.rsplit("/", 2)[1], r.ok) for r in A.reports(spark, f"file://{tmp_path}").collect()) == [("a", True), ("b", False), ("c", False)]


def test_bundle_and_copy(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "k")
    path = f"file://{tmp_path}/bundle"
    sinks.write_bundle(df, path)
    assert sinks.verify_copy(df, sinks.load_bundle(spark, path))
    df.limit(3).write.mode("overwrite").parquet(f"{sinks.current(spark, path)}/data")
    with pytest.raises(ValueError):
        sinks.load_bundle(spark, path)
    with pytest.raises(ValueError):
        sinks.copy_missing(df, spark.range(20, 21).withColumnRenamed("id", "k"), ["k"])


def test_index_overwrites_only_its_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    schema = "chunk_id long, document_id long, parse_version string"
    sinks.write_index(spark.createDataFrame([(1, 1, "v1"), (2, 2, "v1")], schema), path)
    sinks.write_index(spark.createDataFrame([(3, 1, "v1")], schema), path)
    assert sorted(r.chunk_id for r in spark.read.parquet(path).collect()) == [2, 3]


def test_stream_is_idempotent(spark, tmp_path):
    schema = "document_id long, parse_version string, text string"
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for rows in ([(1, "v1", "a"), (2, "v1", "b"), (2, "v1", "B")], [(2, "v1", "c"), (3, "v1", "d")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest(spark, source, schema, target, f"file://{tmp_path}/cp", order="text").awaitTermination()
    held = lambda where: sorted((r.document_id, r.text) for r in current(spark, where, schema).collect())
    assert held(target) == [(1, "a"), (2, "c"), (3, "d")]
    spark.createDataFrame([(3, "v1", "broken")], schema).write.parquet(f"{target}/batch=000000000009")
    (tmp_path / "out" / "batch=000000000009" / "_SUCCESS").unlink()
    assert held(target) == [(1, "a"), (2, "c"), (3, "d")]
    compact(spark, target, schema, f"file://{tmp_path}/small")
    assert held(f"file://{tmp_path}/small") == [(1, "a"), (2, "c"), (3, "d")] and current(spark, f"file://{tmp_path}/none", schema).count() == 0
