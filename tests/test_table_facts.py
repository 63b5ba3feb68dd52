from lumenary.operators import table_facts as TF
from pyspark.sql import functions as F


def table(*texts):
    return TF.table_of([(f"c{i}", t) for i, t in enumerate(texts)])


def test_levels_of_headers():
    t = table("Table 1\n| Group | OPLS4 | OPLS4 | x |\n|---|---|---|---|\n| Group | Edgewise | Pairwise | |\n| a | 1 | 2 | 3 |", "| Group | OPLS4 | OPLS4 | x |\n|---|---|---|---|\n| Group | Edgewise | Pairwise | |\n| | 4 | 5 ± 1 | - |")
    assert t["caption"] == "Table 1" and t["headers"] == ["Group", "OPLS4 Edgewise", "OPLS4 Pairwise", "x"] and t["rows"] == [["a", "1", "2", "3"], ["", "4", "5 ± 1", "-"]]
    assert t["labels"] == ["a", "a"] and t["row_chunks"] == ["c0", "c1"] and t["flags"] == ["header_like_data_row"]
    # Another name for columns with numbers below is dropped; without numbers it is data.
    assert table("| G | A | B |\n| G | first | second |\n| r | 1 | 2 |")["headers"] == ["G", "A", "B"]
    words = table("| G | A | B |\n| G | first | second |\n| r | x | y |")
    assert words["rows"] == [["G", "first", "second"], ["r", "x", "y"]] and words["flags"] == []
    # An empty header that numbers stand under is filled; one that words stand under isn't.
    assert table("| G | | B |\n| | A | B |\n| r | 1 | 2 |")["headers"] == ["G", "G A", "B"]
    assert len(table("| G | | B |\n| | A | B |\n| r | x | 2 |")["rows"]) == 2
    # Three levels, one after another.
    assert table("| G | X | X |\n| G | Y | Y |\n| G | a | b |\n| r | 1 | 2 |")["headers"] == ["G", "X Y a", "X Y b"]


def test_odd_tables():
    assert table("only words")["flags"] == ["no_table_rows"] and table("only words")["rows"] == []
    assert table("| a | b |\n|---|---|")["flags"] == ["no_data_rows"]
    assert table("| a | b |\n| 1 | x | surplus |\n| only |")["rows"] == [["1", "x"], ["only", ""]]
    assert table("| Rank | Model | Score |\n| 1 | net | 3 |\n| 2 | tree | 4 |")["labels"] == ["net", "tree"]
    assert table("| k | l | v |\n| a | x | 1 |\n| | y | 2 |\n| b | | 3 |")["labels"] == ["a / x", "a / y", "b / y"]
    assert table("| n | n | n |\n| a | 1 | 2 |")["headers"] == ["n", "n 2", "n 3"]


def test_numeric_cells():
    assert all(map(TF.numeric, ["1", "-1.5%", "2.0 ± 0.2", "2.0 0.2", "+ 0.9 0.2", "1 +/- 2"])) and not any(map(TF.numeric, ["", "a", "1 a", "+", "1 -", "1."]))


def test_fallbacks(spark):
    chunks = [(1, "v1", "t", 0, "c0", "| Property | C36m | Drude value | note |\n| C6 | 1 | 2 | - |\n| μ (D) | 3 | 4 | x |\n| γ surface | 5 | | y |")]
    t = TF.assembled(spark.createDataFrame(chunks, "document_id long, parse_version string, table_id string, ordinal int, chunk_id string, text string"))

    def ask(question):
        return {(r.row_label, r.column_name, r.value, r.rows_by, r.columns_by) for r in TF.selected(t.withColumn("question", F.lit(question))).collect()}

    assert ask("C6 in Drude") == {("C6", "Drude value", "2", "exact", "strong")}
    # An alias adds its rows to those that are named; a row without a value is no fact.
    assert ask("C6 和 偶极矩 Drude") == {("C6", "Drude value", "2", "exact", "strong"), ("μ (D)", "Drude value", "4", "exact", "strong")}
    assert {x[0] for x in ask("表面张力 of C36m")} == {"γ surface"} and {x[3:] for x in ask("表面张力 of C36m")} == {("matched", "strong")}
    # "value" selects no column by itself, though it is a part of a header: it still selects weakly.
    assert {(x[1], x[4]) for x in ask("which value of C6")} == {("Drude value", "weak")}
    assert ask("zzz") == {(a, b, c, "all", "all") for a, b, c in [("C6", "C36m", "1"), ("C6", "Drude value", "2"), ("μ (D)", "C36m", "3"), ("μ (D)", "Drude value", "4"), ("μ (D)", "note", "x"), ("γ surface", "C36m", "5"), ("γ surface", "note", "y")]}
    assert TF.selected(t.limit(0).withColumn("question", F.lit("q"))).count() == 0 and len(ask(None)) == 7
