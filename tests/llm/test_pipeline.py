import corpus_pipeline
import public_tokenizers
from lumenary.llm import ngram_join, packing, pii
from lumenary.llm.common import written
from pyspark.sql import functions as F

from tests.llm.test_lines_and_rules import brute_lines
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert not [r.doc_id for r in kept if labels.get(r.doc_id) == 0]
    rows = [(r.doc_id, r.text) for r in kept]
    lines = {k: v[0] for k, v in brute_lines(rows).items()}
    order = sorted(lines)
    groups = brute([lines[k] for k in order], 5, 80)
    stay = {order[i]: lines[order[i]] for i, (_, c, _) in groups.items() if c == i}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(stay)
    clean = pii.replace(spark.createDataFrame(sorted(stay.items()), "doc_id long, text string"), corpus_pipeline.PII_KEY)
    want = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packing.pieces(clean, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    filled: dict[int, list[tuple[int, int]]] = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in filled.values():
        v.sort()
        assert v[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(v, v[1:], strict=False)) and sum(v[-1]) <= 2048


def test_columns_between_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs.limit(40), SF), "stage")
        assert docs.columns == corpus_pipeline.COLUMNS and docs.where(F.col("n_chars") != F.length("text")).isEmpty()
    assert ngram_join.join(docs).columns == ["doc_id", "n_shingles", "component_id", "n_links"]


def test_rows_without_an_id_or_with_the_same_one(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (5, text("b")), (5, text("b")), (7, text("c")), (7, text("d")), (3, text("c") + " more"), (None, None), (9, "")]
    docs = spark.createDataFrame([(k, t, "en", "x", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    want = [(None, text("a")), (5, text("b")), (7, text("d")), (3, text("c") + " more"), (None, None), (9, "")]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, want))
