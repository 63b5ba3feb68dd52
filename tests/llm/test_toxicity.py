import random
import zlib

import numpy as np
import zstandard
from lumenary.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def test_held_out_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = X.classify(docs.select("doc_id", "text"), labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all() and (got.predicted == (got.score >= 0.7)).all()
    m = got.merge(labels.toPandas(), on="doc_id")
    m = m[m.held_out]
    rank, y = m.score.rank().values, m.toxic.values
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    # Toxic rows: 0.11 of all. 0.08 of those hold no word that the others have.
    assert auc > 0.97 and (m.predicted[y == 1] == 1).mean() > 0.85 and (m.predicted[y == 0] == 1).mean() < 0.01
    # Equal texts have equal scores.
    same = got.merge(docs.select("doc_id", "text").toPandas(), on="doc_id").groupby("text").score.nunique()
    assert (same == 1).all()


def test_lengths_against_one_call_a_window():
    r = random.Random(4)
    toxic, ordinary = b"\0\0 idiot \0\0 moron \0", b"the thing and the other"
    lengths = X.Lengths(toxic, ordinary)
    for n in (0, 1, 31, 32, 33, 127, 128, 129, 500):
        b = X.body("".join(r.choices(["Idiot ", "the ", "é", "x"], k=n)))
        at = list(X.starts(len(b)))
        assert at[0] == 0 and at[-1] + X.WINDOW >= len(b) and all(y - x == X.STEP for x, y in zip(at, at[1:], strict=False))
        got = lengths(b)
        for row, content in zip(got, (toxic, ordinary, b""), strict=True):
            fresh = X.compressor(content)
            assert [int(v) for v in row] == [len(fresh(X.LEAD + b[i : i + X.WINDOW])) for i in at]
    plain, hit = lengths(X.body("x" * 3 + " good words ")), lengths(X.body("x" * 3 + " a moron here "))
    assert plain[2, 0] == plain[0, 0] and hit[2, 0] - hit[0, 0] >= X.HIT


def test_passages_and_telling_grams():
    toxic = [X.body(f"some {w} words of {i}") for i in range(12) for w in ("scumbag", "lovely")]
    ordinary = [X.body(f"some lovely words of {i}") for i in range(12, 60)]
    marked = X.telling(toxic, ordinary)
    runs = X.passages(X.body("words SCUMBAG words"), marked)
    assert any(b"scumbag" in p for p in runs) and X.passages(X.body("some lovely words"), marked) == [] and X.telling([], ordinary).size == 0
    assert X.dictionary([], 1024) == b"" and X.dictionary([b"abc"], 2) == b"ab"


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a", "z"), (3, "a", "z"), (4, "b " * 200_000, "k"), (None, "a b", "n")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (2, 1), (3, 7), (4, 0), (9, 1)], "doc_id long, toxic int")
    got = X.classify(docs, labels).collect()
    assert len(got) == 6 and len({r.score for r in got}) == 1 and all(0 < r.score < 1 for r in got) and [r.held_out for r in got if r.doc_id is None] == [False]
    assert X.classify(docs.limit(0), labels.limit(0)).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.withColumn("toxic", X.F.when(X.held_out("doc_id"), 1 - X.F.col("toxic")).otherwise(X.F.col("toxic")))
    a, b = X.fit(docs, labels), X.fit(docs, turned)
    assert a.toxic == b.toxic and a.ordinary == b.ordinary and np.array_equal(a.weights, b.weights) and len(a.toxic) > 500 and isinstance(zstandard.ZstdCompressionDict(a.ordinary).dict_id(), int)
