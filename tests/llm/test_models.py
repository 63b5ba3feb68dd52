import math
import random
import re
import zlib

import numpy as np
import pytest
from lumenary.llm import language_id, quality_model

SF = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_model.classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    m = got.merge(labels.toPandas(), on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m.quality).mean() > 0.9
    assert (m[m.quality == 1].predicted == 1).mean() > 0.95


def test_word_vectors_alone_tell_quality(spark):
    """At sf0.1; a score takes nothing but the pooled vectors, their lengths and mean deviation."""
    large = SF.replace("0.01", "0.1")
    docs, labels = spark.read.parquet(f"{large}/documents.parquet"), spark.read.parquet(f"{large}/labels.parquet")
    m = quality_model.classify(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    m = m[m.held_out]
    rank, y = m.score.rank().values, m.quality.values
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc >= 0.995 and (m.predicted == y).mean() > 0.975 and (m.predicted[y == 1] == 1).mean() > 0.99 and (m.predicted[y == 0] == 1).mean() < 0.13
    assert quality_model.inputs([quality_model.shortened(np.zeros((1, quality_model.POOLED)))[0]]).shape == (1, quality_model.POOLED + 4)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a", "z"), (3, "a", "z"), (4, "b " * 50_000, "k"), (None, "a b", "n")], "doc_id long, text string, key string")
    labels = spark.createDataFrame([(1, None), (2, 1), (3, 7)], "doc_id long, quality int")
    got = quality_model.classify(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 3}) == 1
    assert quality_model.classify(docs.limit(0), labels.limit(0)).count() == 0


def brute_features(texts):
    """Index vectors, contexts and pooling word by word."""
    h = quality_model.Words()
    def index(w):
        place, sign = quality_model.index_vectors(h(w))
        v = np.zeros(quality_model.SIZE, int)
        for p, s in zip(place[0], sign[0], strict=True):
            v[p] += s
        return v

    words = [(t or "").split() for t in texts]
    sums = {}
    for ws in words:
        for i, w in enumerate(ws):
            near = [ws[j] for j in range(max(0, i - quality_model.REACH), min(len(ws), i + quality_model.REACH + 1)) if j != i]
            sums[w] = sums.get(w, 0) + sum((index(x) for x in near), np.zeros(quality_model.SIZE, int))
    vectors = {w: np.rint(127 * v / max(np.linalg.norm(v), 1e-9)) / 127 for w, v in sums.items()}
    out = []
    for ws in words:
        v = np.array([vectors[w] for w in ws]) if ws else np.zeros((1, quality_model.SIZE))
        types = np.array([vectors[w] for w in set(ws)]) if ws else v
        out.append(np.concatenate([v.mean(axis=0), v.std(axis=0), types.mean(axis=0)]))
    return np.array(out)


@pytest.mark.parametrize("top, held", [(0, 5), (20, 50), (1 << 18, 1 << 20)])
def test_pooled_vectors_against_plain_sums(spark, monkeypatch, top, held):
    monkeypatch.setattr(quality_model, "FREQUENT", top)
    monkeypatch.setattr(quality_model, "HELD_WORDS", held)
    monkeypatch.setattr(quality_model, "STATE_WORDS", held)
    monkeypatch.setattr(quality_model, "CHUNK", 40)
    monkeypatch.setattr(quality_model, "BUCKET_ROWS", 10)
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(90)]
    texts = [" ".join(r.choice(vocabulary[: r.choice([5, 90])]) for _ in range(r.randint(0, 60))) for _ in range(50)] + [None, "alone", "the the the " * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.key: quality_model.lengthened([x.x])[0] for x in quality_model.features(df).collect()}
    have, want, n = np.array([got[i] for i in range(len(texts))]), brute_features(texts), quality_model.SIZE
    # Means travel in 16 bits: a variance of nearly nothing, and so its root, is only as good as they are.
    have[:, n : 2 * n], want[:, n : 2 * n] = have[:, n : 2 * n] ** 2, want[:, n : 2 * n] ** 2
    assert np.allclose(have, want, atol=2e-3)


def test_packed_arrays():
    r = np.random.default_rng(1)
    for n in (0, 1, 300):
        a, b, c = np.sort(r.integers(0, 2**63, n).astype(np.uint64)), r.integers(-5, 70_000, n), r.integers(-128, 128, (n, quality_model.SIZE))
        assert all((x == y).all() for x, y in zip(quality_model.unpack(quality_model.pack(a, b, c), (1, 1, quality_model.SIZE)), (a, b, c), strict=True))


def test_temperature_lowers_the_loss():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 6))
    y = (x[:, 0] + 0.5 * r.normal(size=600) > 0).astype(float)
    net = quality_model.train(x, y)
    assert net.temperature > 0 and ((net.scores(x) > 0.5) == y).mean() > 0.8


def brute_fusion(rows, names):
    """The posterior of each page by plain sums."""
    n, k = len(names), language_id.PARENT_WEIGHT
    p = [np.exp(np.array(r["loglik"]) - max(r["loglik"])) for r in rows]
    p = [x / x.sum() for x in p]
    out = []
    for i, r in enumerate(rows):
        total = lambda f: sum((p[j] for j, s in enumerate(rows) if j != i and f(s)), np.zeros(n))  # noqa: B023, E731
        everything = total(lambda s: True)
        prior = (everything + 1) / (everything.sum() + n)
        for f in (lambda s: s["suffix"] == r["suffix"], lambda s: s["domain"] == r["domain"], lambda s: s["host"] == r["host"]):  # noqa: B023
            v = total(f)
            prior = (v + k * prior) / (v.sum() + k)
        logs = np.array(r["loglik"]) + np.log(prior)
        if r["declared"]:
            d = total(lambda s: s["declared"] == r["declared"])  # noqa: B023
            own = np.array([float(n) if name == r["declared"] else 1.0 for name in names])
            logs = logs + np.log((d + own) / (everything + n))
        q = np.exp(logs - logs.max())
        out.append(q / q.sum())
    return out


def test_language_fusion_against_plain_sums(spark):
    labelled = spark.read.parquet(f"{SF}/documents.parquet")
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(60).select("page_id", "url", "html")
    extra = spark.createDataFrame([(9001, None, None), (9002, "https://x.fr/a", ""), (9003, "nonsense", "<html lang=de><p>und der die das</p>")], "page_id long, url string, html string")
    pages = pages.unionByName(extra)
    names, table = language_id.fit(labelled)
    rows = [r.asDict() for r in language_id.features(pages, names, table).collect()]
    want = dict(zip([r["page_id"] for r in rows], brute_fusion(rows, names), strict=True))
    got = {r.page_id: r for r in language_id.identify(pages.withColumn("lang", pages.url), labelled).collect()}
    assert len(got) == 63
    for k, r in got.items():
        assert math.isclose(r.confidence, want[k].max(), rel_tol=1e-6) and want[k][names.index(r.lang)] >= want[k].max() - 1e-9
    assert language_id.identify(pages.limit(0), labelled).count() == 0


def test_language_accuracy(spark):
    labelled, pages = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/pages.parquet")
    got = language_id.identify(pages, labelled).toPandas()
    assert (got.lang == got.declared).mean() > 0.95


def test_fit_bound():
    r = random.Random(0)
    assert language_id.cells("".join(r.choices("abc ", k=1000))).max() < language_id.CELLS and len(language_id.cells("")) == 0


def test_pages_without_labelled_texts_ties_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "https://a.fr/x", "<html lang='de'>und der die das"), (1, "https://a.fr/x", "<html lang='de'>und der die das"), (2, None, "123 " * 50_000)], "page_id long, url string, html string")
    none = spark.createDataFrame([], "text string, lang string")
    assert [(r.lang, r.declared, r.host) for r in language_id.identify(pages.where("page_id = 1"), none).collect()] == [(None, "de", "a.fr")] * 2
    same = spark.createDataFrame([("abc abc", "fr"), ("abc abc", "en")], "text string, lang string")
    got = language_id.identify(pages, same).collect()
    assert len(got) == 3 and len({(r.lang, round(r.confidence, 9)) for r in got if r.page_id == 1}) == 1
    assert [r.text_lang for r in got if r.page_id == 2] == ["en"]


def test_likelihoods_against_plain_counts(spark):
    labelled = spark.createDataFrame([("the cat and the hat", "en"), ("der hund und die katze", "de"), ("Der Hut!", "DE")], "text string, lang string")
    pages = spark.createDataFrame([(1, "https://x.de/a", "<html lang=en><script>the the</script><p>Die Katze</p> 12 und"), (2, None, "")], "page_id long, url string, html string")

    def plain(text):
        t = " " + re.sub(r"[^a-zäöüß]+", " ", text.lower()) + " "
        out = []
        for a, b, c in zip(t, t[1:], t[2:], strict=False):
            h = ((ord(a) * 0x9E3779B1 + ord(b)) * 0x85EBCA77 + ord(c)) % 2**64
            out.append((h ^ (h >> 15)) % language_id.CELLS)
        return out

    names, table = language_id.fit(labelled)
    counts = {"de": plain("der hund und die katze") + plain("Der Hut!"), "en": plain("the cat and the hat")}
    got = {r.page_id: r.loglik for r in language_id.features(pages, names, table).collect()}
    found = plain("  Die Katze  12 und")
    for k, name in enumerate(names):
        logs = [math.log((counts[name].count(c) + 0.5) / (len(counts[name]) + 0.5 * language_id.CELLS)) for c in found]
        assert math.isclose(got[1][k], np.mean(logs) * min(len(found) * 0.25, 400), rel_tol=1e-4)
    assert names == ["de", "en"] and got[2] == [0.0, 0.0]
