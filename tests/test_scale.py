"""What must not grow: shuffles of texts, tables of pairs, batches held whole. Results against plain versions."""

import random
from collections import Counter

import numpy as np
from lumenary.functions import normalise as N
from lumenary.functions import text as T
from lumenary.operators import chunking, evidence, knn, lexical, retrieval, versions
from lumenary.plans import catalog, packs
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain_tokens(text):
    import re

    low = re.sub("[δ∆Δ]", "delta ", (text or "").lower())
    low = re.sub(r"\bdelta\s*h\s*[-_ ]?\s*vap\b", "delta h vap hvap", low)
    low = re.sub(r"\bh\s*[-_ ]?\s*vap\b", "h vap hvap", low)
    words, runs = [w for w in re.findall("[a-z0-9_]+", low) if len(w) > 1], re.findall("[一-鿿]+", low)
    found = [*words, *runs, *(r[i : i + 2] for r in runs if len(r) > 1 for i in range(len(r) - 1))]
    found += ["delta", "vap"] * ("hvap" in words) + ["hvap"] * ("delta" in words and "vap" in words)
    return list(dict.fromkeys(found))


def test_tokens_against_plain_ones(spark):
    r = random.Random(1)
    parts = ["δ", "∆", "Δ", "delta", "h", "H", "vap", "Vap", "hvap", "evaporate", " ", "  ", "-", "_", "\n", "水", "水分子", ". é", "ab", "x", "12", "Tion."]
    texts = [None, "", *("".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(600))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: x.w for x in df.select("i", T.tokens(F.col("t")).alias("w")).collect()}
    assert got == {i: plain_tokens(t) for i, t in enumerate(texts)}


def test_token_sets_against_the_expression(spark):
    r = random.Random(11)
    parts = ["δ", "Δ", "delta", "h", "vap", "hvap", "evaporate", " ", "-", "_", "\n", "水", "水分子", "水分子加热蒸发", ". é", "İ", "ab", "x", "123456", "Tion."]
    texts = [None, "", *("".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(600))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.spelled(F.col("t")).alias("s"), T.tokens(F.col("t")).alias("w")).collect()
    for least in (1, 2, 3, 4, 5, 6, 9):
        assert [T.token_set(x.s, least) for x in got] == [{w for w in x.w if len(w) >= least} for x in got]


def some(spark, seed, docs=60, most=9):
    r = random.Random(seed)
    words = [f"word{i}" for i in range(20)] + [f"w{i}" for i in range(10)] + [f"rareword{i}" for i in range(30)]
    text = lambda n: " ".join(r.choices(words, k=n))
    d = [(i * 7 - 50, text(r.randint(0, most))) for i in range(docs)] + [(10_000, None)]
    q = [(i, text(r.randint(0, 8))) for i in range(7)]
    return spark.createDataFrame(q, "query_id long, text string"), spark.createDataFrame(d, "document_id long, text string").repartition(3), q, d


def test_rare_pairs_and_overlaps_against_sets(spark):
    for seed in range(3):
        q, d, qs, ds = some(spark, seed)
        sets = {k: set((t or "").split()) for k, t in ds}
        n = Counter(w for s in sets.values() for w in s)
        want = {}
        for i, t in qs:
            for k, s in sets.items():
                both = s & set(t.split())
                if both:
                    want[i, k] = len(both), sum(len(w) >= 6 for w in both), sum(len(w) >= 6 and n[w] <= retrieval.RARE for w in both)
        got = {(x.query_id, x.document_id): (x.overlap, x.route_overlap, x.rare) for x in retrieval.overlaps(q, d).collect()}
        assert got == want and {1, 2, 3} <= {n[w] for w in n if len(w) >= 6}
        assert {(x.query_id, x.document_id): x.rare for x in retrieval.rare_pairs(q, d).collect()} == {k: v[2] for k, v in want.items() if v[2]}


def test_scarce_terms_are_counted_in_the_tasks(spark, monkeypatch):
    """Whatever tasks a term's documents are in and whatever a block holds; no word becomes a row."""
    monkeypatch.setattr(lexical, "SCARCE_ROWS", 3)
    for seed, block in ((0, 500_000), (1, 7)):
        monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
        _, d, _, ds = some(spark, seed)
        places = {}
        for k, t in ds:
            for w in set((t or "").split()):
                places.setdefault(w, []).append(k)
        asked = [*places, "missing"]
        df = lexical.scarce(d, spark.createDataFrame([(w,) for w in asked], "term string"), 3, 6)
        assert "Generate" not in (p := plan(df)) and "Join" not in p
        want = {w: k for w in asked if len(w) >= 6 and 1 <= len(k := places.get(w, [])) <= 3}
        got = {x.term: x for x in df.collect()}
        assert got.keys() == want.keys() and {1, 2, 3} == {x.n for x in got.values()}
        for w, x in got.items():
            k = want[w]
            assert (x.n, x.a, x.b, x.x) == (len(k), min(k), max(k), int(np.bitwise_xor.reduce(np.array(k))))


def test_overlaps_shuffle_nothing(spark):
    q, d, qs, ds = some(spark, 5)
    df = retrieval.shared(q, d.coalesce(1), 2)
    assert "Join" not in plan(df) and "Aggregate" not in plan(df)
    assert {(x.query_id, x.document_id) for x in df.collect()} == {(i, k) for i, t in qs for k, s in ds if len(set(t.split()) & set((s or "").split())) >= 2}


def test_hybrid_is_small_and_joins_texts_without_a_shuffle(spark):
    q, d, _, _ = some(spark, 6)
    v = spark.createDataFrame([(i * 7 - 50, [float(np.cos(i)), float(np.sin(i))]) for i in range(40)], "document_id long, embedding array<double>")
    best = retrieval.hybrid(q.join(v.withColumnRenamed("document_id", "query_id"), "query_id", "left"), d, v, 5, 2)
    joined = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in (p := plan(best.join(d, "document_id"))) and "SortMergeJoin" not in p
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joined)


def best_of_few(monkeypatch):
    monkeypatch.setattr(retrieval, "hybrid", lambda q, d, v: F.broadcast(d.select(F.lit(1).cast("long").alias("query_id"), "document_id", F.lit(1.0).alias("score"), F.lit(1).alias("rank")).limit(4)))


def test_tokens_are_estimated_of_the_best_alone(spark, monkeypatch):
    best_of_few(monkeypatch)
    p = plan(catalog.QUERIES["b1_budget_packing"](spark, "/root/testdata/sf0.001"))
    assert p.index("FLOOR(") < p.index("BroadcastHashJoin")


def test_kinds_are_told_of_the_best_alone(spark, monkeypatch):
    best_of_few(monkeypatch)
    p = plan(catalog.QUERIES["w6_required_slots"](spark, "/root/testdata/sf0.001"))
    assert p.index("Contains(") < p.index("BroadcastHashJoin")


def test_steps_of_the_scan_are_bounded(spark, monkeypatch):
    """The same result whatever a step holds; a document's best text alone counts where that is asked for."""
    r = random.Random(7)
    words = [f"t{i}" for i in range(12)]
    rows = [(d, o, r.sample(words, r.randint(0, 9)), r.choice([0.0, 0.5, 0.25])) for d in range(30) for o in range(r.randint(1, 5))]
    texts = spark.createDataFrame(rows, "document_id long, ordinal int, terms array<string>, value double").repartition(4).withColumn("weights", F.transform("terms", lambda t: F.length(t)))
    asked = [(i, r.sample(words, 4)) for i in range(6)]
    queries = spark.createDataFrame(asked, "query_id long, terms array<string>")
    each = {}
    for q, terms in asked:
        for d, o, have, value in rows:
            if both := set(terms) & set(have):
                each[q, d, o] = sum(map(len, both)) + value
    for once in (False, True):
        want = []
        for q, _ in asked:
            left = sorted((-s, d, o) for (x, d, o), s in each.items() if x == q)
            if once:
                left = [x for i, x in enumerate(left) if x[1] not in {y[1] for y in left[:i]}]
            want += [(q, d, o, -s) for s, d, o in left[:3]]
        got = lexical.best(texts, queries, 3, lambda total, _, value: total + value, 0.0, once).collect()
        assert sorted((x.query_id, x.document_id, x.ordinal, x.score) for x in got) == sorted(want)


def test_claims_meet_keys_without_a_table_of_pairs(spark):
    r = random.Random(8)
    words = [f"k{i}" for i in range(12)]
    claims = [(i, r.randint(0, 15), " ".join(r.choices(words, k=r.randint(0, 8))), r.choice([None, -100.0, 0.5, 0.1234565, 0.9])) for i in range(120)]
    keys = [(q, w) for q in range(6) for w in r.sample(words, 4)]
    df = evidence.claim_evidence(spark.createDataFrame(claims, "claim_id long, chunk_id long, text string, confidence double").repartition(4), spark.createDataFrame(keys, "query_id long, key string"))
    assert "Join" not in plan(df)
    want = []
    for q in range(6):
        best = {}
        for _, c, text, conf in claims:
            n = len({k for x, k in keys if x == q} & set(text.split()))
            if n >= 2:
                best.setdefault(c, []).append(None if conf is None else round(12 + 1.5 * n + conf + 1e-10, 6))
        tops = {c: max((x for x in s if x is not None), default=None) for c, s in best.items()}
        order = sorted(tops, key=lambda c: (tops[c] is None, -(tops[c] or 0), c))[:3]
        want += [(q, c, tops[c], i) for i, c in enumerate(order, 1)]
    assert sorted(map(tuple, df.collect()), key=lambda x: (x[0], x[3])) == want


def test_unmatched_rows_come_as_often_as_they_stand(spark, monkeypatch):
    monkeypatch.setattr(versions, "PART_ROWS", 50)
    monkeypatch.setattr(versions, "COPIES", 7)
    r = random.Random(9)
    a, b = ([r.choice([None, *range(60)]) for _ in range(n)] + [x] * 100 for n, x in ((90, 500), (40, 501)))
    df = versions.unmatched(*(spark.createDataFrame([(x,) for x in v], "k long") for v in (a, b)), "k")
    got = Counter(x.k for x in df.collect())
    assert got == Counter([x for x in a if x is None or x not in b] + [x for x in b if x is None or x not in a])
    assert "SortMergeJoin" not in (p := plan(df)) and "REPARTITION_BY_NUM" in p
    none = spark.createDataFrame([], "k long")
    assert versions.unmatched(none, none, "k").count() == 0


def test_packs_read_lines_of_routed_documents_alone(spark):
    sf = "/root/testdata/sf0.001"
    only = spark.createDataFrame([(3,), (8,)], "document_id long")
    some = lambda df: sorted(map(repr, df.collect()))
    assert some(packs.families(spark, sf, only)) == some(packs.families(spark, sf).where("document_id IN (3, 8)"))


def test_batches_are_held_in_slices(spark):
    import pyarrow as pa

    assert [b.num_rows for b in chunking.slices([pa.record_batch({"a": list(range(300))})])] == [128, 128, 44] and knn.CELLS <= 1 << 20
    texts = [None, "", "Ein Ver-\nfahren", *(f"Text {i} x" for i in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    assert [x.m for x in df.select("i", N.match_texts("t").alias("m")).orderBy("i").collect()] == [N.match_text(t) for t in texts]
    assert df.limit(0).select(N.match_texts("t")).collect() == []


def test_text_layers_against_plain_ones(spark):
    import re

    r = random.Random(10)
    parts = ["ab ", "x = 1 ", "水 ", "é", "....", "\ufffd", "word12 ", "\t", "\n", " - ", "+", "∑ "]
    texts = [None, "", *("".join(r.choices(parts[: r.randint(2, 12)], k=r.choice([3, 15, 40, 80]))) for _ in range(500))]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", T.text_layer_quality(F.col("t")).alias("q"), T.formula_noise(F.col("t")).alias("n"))
    assert "regexp_replace" not in plan(got)
    found = set()
    for x in got.collect():
        t = (x.t or "").strip(" \t\n\r")
        density = len(re.findall("[\u4e00-\u9fffA-Za-z0-9]", t)) / max(1, len(t))
        words = re.findall("[A-Za-z0-9]+", x.t or "")
        want = "low" if len(t) < 40 or "\ufffd" in t or density < 0.28 else "high" if len(t) > 120 and density >= 0.4 else "medium"
        noise = len(words) >= 12 and sum(len(w) <= 2 for w in words) >= 0.8 * len(words) and len(re.findall(r"[-+=/*^;∑∫√]", x.t or "")) >= 8
        assert (x.q, x.n) == (want, noise)
        found.add((x.q, x.n))
    assert len(found) >= 4
