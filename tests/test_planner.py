from lumenary.operators import planner as P
from pyspark.sql import functions as F

INVENTORY = [("d1", "v4", "table-7"), ("d1", "v4", "table-8"), ("d2", "v1", "t"), ("d2", "v2", "table-8")]
QUESTIONS = {
    1: ("Table 7 的 binding RMSE 是多少？", [0, 1]),
    2: ("Table 7 and Table 9: the accuracy", [0, 1]),
    3: ("Table 8 accuracy", [0, 1, 3]),
    4: ("What about the accuracy?", [0]),
    5: ("What about the accuracy?", [0, 1]),
    6: ("那 C36 呢？", [0]),
    7: ("Table 7?", [0]),
    8: ("Table S7 row 3: Asp, C6 和 exptl values", [0]),
    9: ("the total row of binding energies", [0]),
    10: ("第 2 行 average row accuracy", [0]),
    11: (None, [0]),
    12: ("accuracy", []),
    13: ("Table 7 and Table 8 mean row accuracy, F1 values", [0, 1]),
}
WANT = {
    1: [("table-7", None, None, "binding rmse")],
    4: [("table-7", None, None, "accuracy")],
    7: [("table-7", None, None, "")],
    8: [("table-7", 3, None, x) for x in ("asp", "c6", "exptl")],
    9: [("table-7", None, "total", "binding energie")],
    10: [("table-7", 2, None, "accuracy")],
    13: [(t, None, "mean", c) for t in ("table-7", "table-8") for c in ("accuracy", "f1")],
}


def plan(spark):
    q = spark.createDataFrame([(i, t) for i, (t, _) in QUESTIONS.items()], "query_id long, question string")
    inventory = spark.createDataFrame([(i, *INVENTORY[k]) for i, (_, ks) in QUESTIONS.items() for k in ks], "query_id long, document_id string, parse_version string, table_id string")
    return P.planned(q, inventory)


def test_demands_are_read_and_bound(spark):
    got = {}
    for r in plan(spark).collect():
        got.setdefault((r.query_id, r.status), []).append((r.table_id, r.row_index, r.row_label, r.column))
    assert {i for i, s in got if s == "resolved"} == set(WANT)
    for i, want in WANT.items():
        assert sorted(got[i, "resolved"], key=repr) == sorted(want, key=repr), i
    assert all(v == [(None, None, v[0][2], None)] or s == "resolved" for (_, s), v in got.items() if s == "unknown" and v[0][1] is None)
    assert {i for i, s in got if s == "unknown"} == set(QUESTIONS) - set(WANT)


def test_facts_meet_demands(spark):
    columns = "query_id long, document_id string, parse_version string, table_id string, row_index int, row_label string, column_name string, term string"
    facts = [
        (1, "d1", "v4", "table-7", 2, "OPLS5", "binding RMSE", None), (4, "d1", "v4", "table-8", 2, "x", "accuracy", None), (7, "d1", "v4", "table-7", 1, "x", "y", None), (8, "d1", "v4", "table-7", 3, "x", "Asp", "C6"),
        (9, "d1", "v4", "table-7", 5, "Totals", "binding energies", None), (10, "d1", "v4", "table-7", 2, None, None, "Accuracy"), (13, "d1", "v4", "table-7", 9, "mean", "accuracy", "f1"), (13, "d1", "v4", "table-8", 9, "other", "accuracy", "f1"),
    ]
    got = {r.query_id: (r.expected, r.missing, r.status) for r in P.answered(plan(spark), spark.createDataFrame(facts, columns)).collect()}
    assert got[1] == (1, 0, "complete") and got[4] == (1, 1, "missing") and got[7] == (1, 0, "complete") and got[8] == (3, 1, "missing")
    assert got[9] == (1, 0, "complete") and got[10] == (1, 0, "complete") and got[13] == (4, 2, "missing") and got[2] == (0, 0, "unknown") and len(got) == 13


def test_an_item_that_is_only_a_quantity_names_no_column(spark):
    df = spark.createDataFrame([("values, C6 value and the",), ("",)], "q string").select(P.columns(F.col("q")).alias("c"))
    assert [r.c for r in df.collect()] == [["c6"], []]
