import pytest
from lumenary.functions import classify as C
from lumenary.functions import text as T
from lumenary.functions import vectors as V
from pyspark.sql import functions as F


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_")).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [("The ΔHvap of H2O", {"the", "delta", "vap", "hvap", "of", "h2o"}), ("水的密度 a", {"水的密度", "水的", "的密", "密度"}), ("δ x", {"delta"}), ("水", {"水"}), ("", set()), (None, set())],
)
def test_tokens(spark, text, want):
    assert set(one(spark, T.tokens(F.col("t")), t=text)) == want


@pytest.mark.parametrize("cell, want", [("2.0 0.2", True), ("+ 0.9 0.2", True), ("1 ± 2", True), ("80.5%", True), ("-3", True), ("a 3", False), ("", False), ("+", False), ("3 kg", False)])
def test_numeric_cell(spark, cell, want):
    assert one(spark, T.numeric_cell(F.col("c")), c=cell) is want


def test_keys(spark):
    assert one(spark, T.lookup_key(F.col("t")), t="α-Helix (x)") == "helixx"
    assert one(spark, T.fact_key(F.col("t")), t="α-Helix") == "alphahelix"
    assert one(spark, T.scientific_key(F.col("t")), t=r"\mathrm{C_{6}} H₂ γ") == "c6h2gamma"


def test_citations_and_numbers(spark):
    assert one(spark, T.citation_markers(F.col("t")), t="a [[2]] b [1, 2,3]") == "a [2] b [1][2][3]"
    assert one(spark, T.answer_numbers(F.col("t")), t="5 and 42% in [12] of 2.350") == ["42%", "2.350"]
    assert one(spark, T.unit_suffix(F.col("t")), t="12.5 kcal") == "kcal"
    assert one(spark, T.page_number(F.col("t")), t="p. 12") == 12


@pytest.mark.parametrize(
    "q, want",
    [("  ", "needs_clarification"), (None, "needs_clarification"), ("First find x, then calculate y", "complex_multi_hop"), ("1. what\n2. why", "complex_multi_hop"), ("SUVs on the road", "multi_source_compare"), ("表面张力", "table_or_metric"), ("it has 5 kcal", "table_or_metric"), ("cite me", "evidence_required"), ("what is it", "simple_rag")],
)
def test_route(spark, q, want):
    assert one(spark, C.route(F.col("q")), q=q) == want


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    x = spark.range(1).select(V.cosine(v(1, 0), v(1, 1)).alias("a"), V.cosine(v(0, 0), v(1, 1)).alias("b"), V.valid(v(1, float("nan")), 2).alias("c"), V.valid(v(1), 2).alias("d"), V.normalised(v(0, 0)).alias("e"), V.distance_score(F.lit(0.25)).alias("f")).first()
    assert (round(x.a, 6), x.b, x.c, x.d, x.e, x.f) == (0.707107, 0.0, False, False, None, 7.5)


def test_all_orders_are_judged(spark, tmp_path):
    from lumenary.plans import text as P

    rows = [(1, 400000.5, "5-LOW"), (2, 300000.0, "5-LOW"), (3, 150000.0, "5-LOW"), (4, 10.0, "5-LOW"), (5, None, "5-LOW")]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r[0]: r[1] for r in P.s13_numeric_cells(spark, str(tmp_path)).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True}
