import random

from lumenary.llm import line_dedup, quality_rules
from pyspark.sql import functions as F


def brute_lines(rows):
    occurrences = {}
    worded = {}
    for k, t in rows:
        lines = [(i, x.strip(line_dedup.WHITE)) for i, x in enumerate((t or "").split("\n")) if x.strip(line_dedup.WHITE)]
        worded[k] = lines
        for n in range(len(lines) - 2):
            occurrences.setdefault(tuple(x for _, x in lines[n : n + 3]), []).append((k, n))
    gone = {}
    for places in occurrences.values():
        for k, n in sorted(places)[1:]:
            gone.setdefault(k, set()).update(worded[k][n + j][0] for j in range(3))
    return {k: (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(k, ())), len(worded[k]), len(gone.get(k, ()))) for k, t in rows}


def test_lines_against_brute_force(spark):
    r = random.Random(5)
    lines = ["alpha", " beta", "gamma ", "", "delta", "\t", "ε"]
    rows = [(i, "\n".join(r.choices(lines, k=r.randint(0, 14)))) for i in range(120)] + [(500, None), (501, ""), (502, "\n\n")]
    rows.append((600, "\n".join(r.choices(lines, k=20_000))))
    df = spark.createDataFrame([(*x, 7, "a", 1, 2) for x in rows], "doc_id long, text string, n_lines int, _key string, covered int, _row int").repartition(4)
    found = line_dedup.dedup(df)
    assert found.columns == ["doc_id", "text", "_key", "covered", "_row", "n_lines", "n_removed"]
    got = {x.doc_id: (x.text, x.n_lines, x.n_removed) for x in found.collect()}
    assert got == brute_lines(rows)


def test_repeated_rows_lose_nothing(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd")], "doc_id long, text string")
    assert sorted((x.doc_id, x.text) for x in line_dedup.dedup(df).collect()) == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "d")]
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_null_keys_and_keys_of_several_texts(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nx"), (1, "y\na\nb\nc"), (None, "a\nb\nc"), (None, "a\nb\nc"), (None, None)], "doc_id long, text string")
    got = sorted(((x.doc_id, x.text) for x in line_dedup.dedup(df).collect()), key=repr)
    assert got == sorted([(1, "x"), (1, "y"), (None, "a\nb\nc"), (None, "a\nb\nc"), (None, None)], key=repr)


def brute_measures(t):
    import re

    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_measures_against_brute_force(spark):
    r = random.Random(2)
    texts = [" ".join(r.choices(["a", "b", "c#", "dé", "\n", "e\x0bf", "😀", "a\n"], k=r.randint(0, 60))) for _ in range(150)] + [None, "", " ", "a b c a b c", "a a a a", "x" * 1000, " ".join(["w"] * 3000)]
    df = spark.createDataFrame([(i, t, "keep", 3, "w") for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_words int, _words string").repartition(3)
    rows = quality_rules.measures(df).collect()
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in rows}
    assert got == {i: brute_measures(t) for i, t in enumerate(texts)} and {x._words for x in rows} == {"w"}


def brute_verdict(t):
    import regex

    n, chars, symbols, dup, repeat = brute_measures(t)
    n_lines = len([x for x in (t or "").split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)])
    letters, capitals = (len(regex.findall(p, t or "")) for p in (r"\p{L}", r"\p{Lu}"))
    return {
        "few_words": n < 50, "repeated_windows": 100 * repeat > 50 * n, "word_length": chars < 2 * n or chars > 12 * n, "symbols": 10 * symbols > n, "repeated_lines": 2 * dup > n_lines,
        "few_letters": 100 * letters < 60 * chars, "capitals": 100 * capitals > 30 * chars, "exclamations": 5 * (t or "").count("!") > n,
    }


def test_verdicts_against_brute_force(spark):
    r = random.Random(3)
    kinds = [["word", "other", "thing", "new", "clean"], ["A", "I", "b"], ["WORD", "Other", "x"], ["a#", "b", "cc"], ["12", "345", "one"], ["yes!", "no!!", "word"], ["line\n", "word"], ["x" * 30, "yy"], [f"w{i}" for i in range(400)]]
    texts = [" ".join(r.choices(r.choice(kinds) + [f"v{i}" for i in range(r.choice([0, 10, 300]))], k=r.choice([10, 49, 50, 51, 200]))) for _ in range(250)] + [None, "", "word " * 3000]
    df = spark.createDataFrame([(i, t, "t", True) for i, t in enumerate(texts)], "doc_id long, text string, failed_rule string, w boolean").repartition(3)
    order = list(reversed(quality_rules.RULES))
    got = {x.doc_id: (x.failed_rule, x.kept) for x in quality_rules.judge(df, order=order).collect()}
    for i, t in enumerate(texts):
        want = brute_verdict(t)
        assert got[i] == (next((x.name for x in order if want[x.name]), None), not any(want.values())), (t, want)
    assert got == {x.doc_id: (x.failed_rule, x.kept) for x in quality_rules.judge_measured(quality_rules.measures(df), order).collect()}


def test_order_by_rejection_per_cost(spark):
    slow = lambda t, w: quality_rules.mostly_repeated(F.flatten(F.array_repeat(w, 8)))
    rules = (quality_rules.Rule("slow", slow, None, (0, 8 * quality_rules.WINDOWS)), quality_rules.Rule("never", lambda t, w: F.size(w) < 0, None), quality_rules.Rule("quick", lambda t, w: F.size(w) > 10, None))
    df = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(300 + i))) for i in range(200)], "doc_id long, text string")
    orders = {tuple(x.name for x in quality_rules.order_rules(df, rules)) for _ in range(3)}
    assert orders == {("quick", "slow", "never")}


def test_real_rules_have_one_order(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for measured in (False, True):
        orders = {tuple(x.name for x in quality_rules.order_rules(df.repartition(1 + k), measured=measured)) for k in range(10)}
        assert len(orders) == 1 and set(*orders) == {x.name for x in quality_rules.RULES}
        # What costs a comparison and rejects goes before what scans the text; a rule that rejects nothing has nothing to give.
        order = list(*orders)
        assert order.index("few_words") < min(map(order.index, ("few_letters", "capitals", "exclamations")))
    sample = df.limit(300)
    rejected = {r.name: sample.where(r.rejects(F.coalesce("text", F.lit("")), quality_rules.words(F.coalesce("text", F.lit(""))))).count() for r in quality_rules.RULES}
    cost = {r.name: quality_rules.COMPARE * 300 + r.cost[0] * sample.agg(F.sum(F.length("text"))).first()[0] + r.cost[1] * sample.agg(F.sum(F.size(quality_rules.words(F.col("text"))))).first()[0] for r in quality_rules.RULES}
    gains = [rejected[r.name] / cost[r.name] for r in quality_rules.order_rules(sample)]
    assert gains == sorted(gains, reverse=True)


def test_order_changes_no_verdict(spark):
    texts = ["word " * 60, "Clean words of many kinds stand here. " * 2, None, " ".join(f"word{i}" for i in range(80)), " ".join(f"WORD{i}!" for i in range(80)), " ".join(f"w{i}###" for i in range(80))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    verdicts = [{x.doc_id: x.kept for x in quality_rules.judge(df, order=order).collect()} for order in (list(quality_rules.RULES), list(reversed(quality_rules.RULES)), None)]
    assert verdicts[0] == verdicts[1] == verdicts[2] == {0: False, 1: False, 2: False, 3: True, 4: False, 5: False}
    assert quality_rules.judge(df.limit(0)).count() == 0
