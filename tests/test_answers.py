import numpy as np
import pytest
from lumenary.functions import citations as CI
from lumenary.functions import classify as C
from lumenary.functions import text as T
from lumenary.operators import answers as AN
from lumenary.operators import knn
from lumenary.operators import retrieval as R
from pyspark.sql import functions as F

from tests.test_functions import one

CASES = [
    ("multi_source_compare", ["compare A and B", "difference between X and Y", "versus", "vs", "对比一下", "比较方法", "区别是什么", "不同点", "相比而言"]),
    ("table_or_metric", ["table of contents", "metric value", "parameter x value", "parameter x 值", "value is 42", "这是什么表", "指标是多少", "参数设置的值", "列出所有参数", "参数是多少", "表 3 中的参数", "数值结果", "100 kcal", "50%", "1.5 Å", "angstrom units"]),
    ("simple_rag", ["torsional parameters", "5 kj and 3 nm", "what is it"]),
    ("evidence_required", ["原文在哪", "give a reference"]),
    ("complex_multi_hop", ["1. what\n2. why", "先找到它"]),
]


def test_routes(spark):
    rows = [(w, q) for w, qs in CASES for q in qs]
    got = spark.createDataFrame(rows, "want string, q string").select("want", "q", C.route(F.col("q")).alias("got")).collect()
    assert [(r.q, r.got) for r in got] == [(r.q, r.want) for r in got]


@pytest.mark.parametrize(
    "kind, yes, no",
    [
        (C.is_table_reference, ["现在展开第二张", "这张表", "刚才的表格"], ["论文中有哪些表格", None]),
        (C.is_overview, ["这篇文章讲了什么", "Summarize the paper", "上一轮问题：总结\n当前追问：main points?"], ["summarize Table 2", "总结研究方法", "上一轮问题：总结\n当前追问：why", "what does CHARMM cover overview"]),
        (C.is_mechanism, ["为什么会这样", "why is that"], ["为什么表格", "总结为什么", "what"]),
        (C.is_metric, ["pKa shift", "the F 1", "得分"], ["pKa", "half 12", "accurate"]),
        (C.heading_only, ["# Introduction", "", "Results 3", "short text"], ["word " * 12 + "and a longer sentence here", "中文内容" * 20]),
        (C.high_risk, ["which method", "any advice"], ["should I", "is it safe"]),
    ],
)
def test_kinds_of_questions(spark, kind, yes, no):
    rows = [(q, True) for q in yes] + [(q, False) for q in no]
    got = spark.createDataFrame(rows, "q string, want boolean").select("q", "want", kind(F.col("q")).alias("got")).collect()
    assert [(r.q, r.got) for r in got] == [(r.q, r.want) for r in got]


def test_what_questions_name(spark):
    q = "Compare Table S 2 and fig. 3, TABLE s 2, on NYT and the Generator for 验证器; open-set recall of 12-A"
    assert one(spark, C.facets(F.col("q")), q=q) == ["Table S 2", "fig. 3", "NYT", "Generator", "Verifier"]
    assert one(spark, C.table_terms(F.col("q")), q="What is the open-set recall of Open-Set models and 12-A in the table?") == ["open-set", "models", "12-A"]
    assert one(spark, C.follow_up(F.col("q"), F.lit("前一个")), q=" 第二点呢 ") == "上一轮问题：前一个\n当前追问：第二点呢"
    assert one(spark, C.follow_up(F.col("q"), F.lit("x")), q="x" * 31) == "x" * 31


def test_citation_markers(spark):
    t = "a [[2]] b [1, 2,3] [[sources/x.md]] [[Name]] [[Name](u)] [label] [link](u) [系统提示：x] [4]"
    assert one(spark, CI.normalised(F.col("t")), t=t) == "a [2] b [1][2][3]  Name Name  [link](u) [系统提示：x] [4]"
    assert one(spark, CI.renumbered(F.col("t"), F.array(F.lit(3), F.lit(2))), t="a [1] [2], [3]") == "a  [1], [0]"
    assert one(spark, CI.returned_only(F.col("t"), F.lit(2)), t="a [1] [2]") == "a [1] "
    assert [one(spark, CI.ensured(F.col("t"), F.lit(2)), t=t) for t in ("a [1]", "a [5]", "  ", "b\n")] == ["a [1]", "a [5] [0]", "  ", "b[0]"]


def test_redaction():
    v = {"k": 1, "Api_Key": "x", "prompt_tokens": 5, "n": {"secret_a": 1, "b": "Bearer abc"}, "l": [{"password": 2}, "sk-not-an-object"], "u": "a=0123456789abcdef", "w": "a=0123456789 abcdef", "s": "sk-12"}
    assert AN.redacted(v) == {"k": 1, "Api_Key": "[redacted]", "prompt_tokens": 5, "n": {"secret_a": "[redacted]", "b": "[redacted]"}, "l": [{"password": "[redacted]"}, "sk-not-an-object"], "u": "[redacted]", "w": "a=0123456789 abcdef", "s": "sk-12"}


def test_citations_of_one_page(spark):
    rows = [(1, i, "p", f"row {i}" if i < 7 else f"prose {i}", float(i), i < 7, f"t{i % 3}" if i < 7 else None) for i in range(10)] + [(2, 0, "p", "a", 1.0, False, None), (2, 1, "p", "a", 2.0, False, None), (2, 2, None, "a", 1.0, False, None), (2, 3, None, "a", 1.0, False, None)]
    got = AN.dedup_citations(spark.createDataFrame(rows, AN.CITATION)).collect()
    assert [r.position for r in got if r.query_id == 1] == [6, 5, 4, 3, 2]
    assert sorted(r.position for r in got if r.query_id == 2) == [0, 2]


def test_answers_are_verified(spark):
    words = " ".join(f"w{i}" for i in range(20))
    rows = [("needs_clarification", "", 0, 0), ("simple_rag", "", 0, 0), ("simple_rag", "改进了。" * 8, 0, 0), ("simple_rag", "no no no no no no a b c d e f", 1, 0), ("table_or_metric", words.replace("w", "") + " x", 0, 0), ("table_or_metric", "no number here", 1, 0), ("table_or_metric", "no number here", 1, 1), ("simple_rag", "1 2 3 4 " * 6, 1, 0)]
    got = AN.verify(spark.createDataFrame(rows, "route string, answer string, citations int, table_citations int")).collect()
    assert [r.warnings for r in got] == [[], ["empty"], ["repeated_phrase"], [], ["no_citations"], ["no_table_evidence"], [], []]
    assert one(spark, AN.dominant_count(AN.tokens(F.col("t"))), t="ab " * 8 + "c d e f g h i j") == 8


def test_expected_facts(spark):
    asked = spark.createDataFrame([(1, "t", "r", "c"), (1, "t", "r", "d"), (2, "t", "r", "c"), (3, None, None, None)], "query_id long, table_id string, row_label string, column_name string")
    facts = spark.createDataFrame([(1, "t", "r", "c", "5"), (1, "t", "r", "d", None), (2, "t", "r", "c", "1")], "query_id long, table_id string, row_label string, column_name string, value string")
    assert sorted((r.query_id, r.missing, r.status) for r in AN.expected_facts(asked, facts).collect()) == [(1, 1, "missing"), (2, 0, "complete"), (3, 0, "unknown")]


def test_nearest_rows_with_ties(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELLS", 64)
    r = np.random.default_rng(1)
    v = r.integers(-1, 2, (300, 4)).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 4)]
    df = spark.createDataFrame(rows, "document_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame(rows[:20], "query_id long, embedding array<double>")
    got = {(x.query_id, x.document_id) for x in knn.top_k(df, q, 5, 4).collect()}
    want = set()
    for i in range(20):
        n = [(-round(float(v[i] @ v[j] / max(np.linalg.norm(v[i]) * np.linalg.norm(v[j]), 1e-300)), 9), j) for j in range(300) if v[j].any()]
        want |= {(i, j) for _, j in sorted(n)[:5]}
    assert got == want


def test_hybrid_against_all_pairs(spark):
    r = np.random.default_rng(2)
    vocabulary = [f"word{i}" for i in range(60)] + [f"rare{i}" for i in range(200)] + ["a1", "b2"]
    text = lambda n: " ".join(r.choice(vocabulary, n))
    docs = [(i, text(15)) for i in range(150)]
    vectors = [(i, r.normal(size=4).tolist()) for i in range(0, 150, 2)]
    queries = [(i, text(10), r.normal(size=4).tolist() if i % 4 else None) for i in range(16)]
    d, v = spark.createDataFrame(docs, "document_id long, text string"), spark.createDataFrame(vectors, "document_id long, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id long, text string, embedding array<double>")
    frequency: dict[str, int] = {}
    for _, t in docs:
        for w in set(t.split()):
            frequency[w] = frequency.get(w, 0) + 1
    of, want = dict(vectors), []
    for i, t, e in queries:
        found = []
        for k, u in docs:
            both = set(t.split()) & set(u.split())
            route, rare = sum(len(w) >= 6 for w in both), sum(len(w) >= 6 and frequency[w] <= 3 for w in both)
            if e and k in of:
                a, b = np.array(e), np.array(of[k])
                s = 10 * round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9) + min(len(both) * 0.05 + route * 0.08, 0.4) + min(rare * 0.6, 1.2)
            else:
                s = min(0.3 + (len(both) + route) * 0.1 + min(rare * 0.6, 1.2), 1.2) if both else 0
            if s > 0:
                found.append((-round(s, 6), k))
        want += [(i, k) for _, k in sorted(found)[:8]]
    assert sorted((x.query_id, x.document_id) for x in R.hybrid(q, d, v, 8, 4).collect()) == sorted(want)


def test_names_of_files_and_titles(spark):
    assert [one(spark, T.safe_filename(F.col("t")), t=t) for t in ("../a b.pdf", "C:\\x\\.y", "表 1.md", "")] == ["a_b.pdf", "y", "表_1.md", "upload"]
    assert one(spark, T.readable_title(F.col("t")), t="a-new_title") == "A New Title"


def test_route_scores(spark):
    from lumenary.operators import routing as RT

    q = F.lit("alpha beta gamma9")
    parts = {"profile": F.lit("alpha"), "raw": F.lit("alpha beta"), "title": F.lit("beta x"), "alias": F.lit("gamma9"), "key": F.lit("none")}
    text = F.lit("Here we propose, with care, C++ amber-2. We used OPLS. 本文提出了X1模型. This paper presents\nnothing of Y")
    row = spark.range(1).select(RT.score(q, parts, F.lit(2), F.lit(1), F.lit(1), F.lit(True)).alias("s"), RT.introduces(F.array(*map(F.lit, ["amber-2", "OPLS", "X1", "Y", "C++", ""])), text).alias("n")).first()
    assert (row.s, row.n) == (1 + 2 + 3 + 5 + 8 + 12 + 18 + 18, 3)
