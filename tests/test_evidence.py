import io
import zipfile

from lumenary.functions import normalise as N
from lumenary.functions import text as T
from lumenary.operators import evidence as E
from lumenary.sources.office import docx_blocks
from pyspark.sql import functions as F


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>One </w:t><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b|c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("word/document.xml", xml)
    assert docx_blocks(f.getvalue()) == [("heading", 2, "Head"), ("paragraph", 0, "One two"), ("table", 0, "| a | b\\|c |\n|---|---|")]
    assert docx_blocks(b"no zip") == docx_blocks(None) == []


def test_failures_are_isolated(spark):
    def make():
        def f(t):
            if t is None:
                raise ValueError("no text")
            return [float(len(t))]

        return f

    got = {r.k: (r.embedding, r.error) for r in E.embed(spark.createDataFrame([(1, "abc"), (2, None)], "k long, t string"), "k", "t", make).collect()}
    assert got == {1: ([3.0], None), 2: (None, "ValueError: no text")}


def test_prefix_rules(spark):
    df = spark.createDataFrame([("In 1999 it rose. It fell. It rose.", "It rose in 1998"), ("", "x"), ("A good summary", "text of A good summary here")], "p string, t string")
    assert [r[0] for r in df.select(E.prefix_errors(F.col("p"), F.col("t"))).collect()] == [["too_many_sentences", "new_number", "not_chinese"], ["empty", "not_chinese"], ["copy", "not_chinese"]]


def test_table_data(spark):
    texts = ["| a | b |\n|---|---|\n| 1 | 2 |", "| a | b |\n| x | 2 |", "| a | b |", "no table", "| a | b |\n\n| 1 | 2 |", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(T.table_data(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False, False]


def test_normalisation():
    assert N.table_cell(r"\mathrm{\text{C}} 0 . 1 \pm 2") == "C 0.1 ± 2"
    assert N.match_text("Exam-\nple ﬁne\u00adly  X") == "example finely x"


def test_fingerprints():
    assert E.fingerprint({"b": 1, "a": [2]}) == E.fingerprint({"a": [2], "b": 1})
    assert E.version_key("v1", "ab" * 32, {}).startswith("v1-abababababab-")


def test_snippets_and_overlap(spark):
    df = spark.createDataFrame([(["aa", "bb", "ccccc", "d"], "xyz hello", "hello world")], "p array<string>, a string, b string")
    r = df.select(T.packed_snippets(F.col("p"), 5).alias("s"), T.without_overlap(F.col("a"), F.col("b"), 3).alias("o")).first()
    assert (r.s, r.o) == (["aa bb", "ccccc", "d"], " world")
