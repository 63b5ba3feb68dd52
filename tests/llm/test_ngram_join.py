import random

import numpy as np
import pytest
from lumenary.llm import ngram_join as J
from lumenary.llm.components import connected_components


def brute(texts, words, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    n = len(sets)
    up, degree = list(range(n)), [0] * n

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                degree[i] += 1
                degree[j] += 1
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i), degree[i]) for i in range(n)}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(80)]
    out = ["", None, " \t\n", "One\x0btwo", "one TWO", "É é", "é é"]
    for _ in range(25):
        base = r.choices(vocabulary, k=r.choice([1, 2, 3, 4, 6, 9, 10, 11, 15, 30, 60, 150]))
        for _ in range(8):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 15))):
                k = r.randrange(len(t))
                t[k : k + r.randint(0, 1)] = [r.choice(vocabulary)] * r.randint(0, 1) or [t[k]]
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize("seed, words, percent, block", [(1, 3, 90, 1 << 18), (2, 5, 80, 1 << 18), (3, 5, 80, 1500)])
def test_join_against_all_pairs(spark, monkeypatch, seed, words, percent, block):
    monkeypatch.setattr(J, "BLOCK_NGRAMS", block)  # a small bound makes many blocks and pairs of blocks
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, node string, keys string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in J.join(df, words, percent).collect()}
    assert got == brute(texts, words, percent)


def test_repeated_rows_are_copies(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(5, text), (5, text), (6, text + " x"), (7, "other words")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in J.join(df, 3, 90).collect()) == [(5, 5, 2), (5, 5, 2), (6, 5, 2), (7, 7, 0)]


def test_empty_table(spark):
    assert J.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_key(percent):
    r = np.random.default_rng(percent)
    for _ in range(300):
        n = int(r.integers(1, 200))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        most = len(a) * (100 - percent) // percent
        b = np.union1d(a, r.integers(0, 2**63, int(r.integers(0, most + 1))).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        drop = int(r.integers(0, 3))
        b = np.delete(b, r.choice(len(b), min(drop, len(b) - 1), replace=False))
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= percent * (len(a) + len(b) - shared) and shared < max(len(a), len(b)):
            small = min(a, b, key=len)
            g = J.size_class(len(small), percent)
            keys = [np.concatenate([k[(k & np.uint64((1 << J.CLASS_BITS) - 1)) == np.uint64(g)] for k, _ in J.fragment_keys(x, percent)]) for x in (a, b)]
            assert len(np.intersect1d(*keys)) >= J.agreements(g, percent)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    random.Random(0).shuffle(edges)
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def test_pruning_keeps_every_link(spark, monkeypatch):
    monkeypatch.setattr(J, "FEW", 3)  # most fragments then count as shared by many
    texts = corpus(9)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in J.join(df, 5, 80).collect()}
    assert got == brute(texts, 5, 80)


def test_bitmaps_bound_the_difference():
    r = np.random.default_rng(3)
    for n, m in ((5, 7), (700, 650), (3000, 20_000)):
        a, b = (np.unique(r.integers(0, 2**63, x).astype(np.uint64)) for x in (n, m))
        b = np.union1d(a[: n // 2], b)
        x, y = J.bitmap(a), J.bitmap(b)
        for width in (min(len(x), len(y)), J.BITS // 8):
            assert np.bitwise_count(J.folded(x, width) ^ J.folded(y, width)).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("chunk, block", [(8192, 1 << 18), (5, 1500)])
def test_a_third_of_all_rows_are_near_copies(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(J, "CHUNK", chunk)
    monkeypatch.setattr(J, "FEW", 8)
    monkeypatch.setattr(J, "BLOCK_NGRAMS", block)
    r = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    texts = corpus(5) + [" ".join(r.choice(["x", "y", "z"]) if r.random() < 0.01 else w for w in base) for _ in range(110)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.n_links) for x in J.join(df, 5, 80).collect()}
    assert got == brute(texts, 5, 80)


def test_null_and_shared_keys(spark):
    text = lambda w, n=60: " ".join(f"{w}{i}" for i in range(n))
    rows = [(None, text("a")), (None, text("a") + " more"), (None, text("b")), (4, text("c")), (4, text("d")), (2, text("d") + " x"), (9, text("a", 59)), (None, None), (9, "")]
    got = J.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 3, 90).collect()
    want = [(None, 58, 9, 2), (None, 59, 9, 2), (9, 57, 9, 2), (None, 58, None, 0), (4, 58, 4, 0), (4, 58, 2, 1), (2, 59, 2, 1), (None, 0, None, 0), (9, 0, 9, 0)]
    assert sorted(map(repr, (tuple(x) for x in got))) == sorted(map(repr, want))


def test_a_very_long_text(spark):
    r = random.Random(6)
    long = [f"w{r.randrange(30_000)}" for _ in range(60_000)]
    other = [w if r.random() > 0.01 else "new" for w in long]
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[:30_000])), (4, "short")]
    got = {x.doc_id: (x.component_id, x.n_links) for x in J.join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}
