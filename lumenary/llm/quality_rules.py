"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a condition that rejects a document, written over measures that are expressions of the text and its words: a rule
that a document doesn't reach costs it nothing. The cascade estimates on a sample what each rule costs, by the characters and
words that its expression goes through and stated unit costs, and what share it rejects, orders the rules by rejection per
cost, and evaluates them as one ``CASE``, which stops at the first rule that rejects. Where measures are at hand as columns,
rules over them cost no more than a comparison, and the order is that of the expressions that then run. The order changes the
time and the name that is reported, never the verdict; the same rows give the same order, however they are partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]"
#: Rows of the sample, and the shares in which rows are told by their hash.
SAMPLE_ROWS, SHARES = 1000, 1 << 40
#: Nanoseconds of unit work, as timed once on 25 MB of prose on one core: a comparison of numbers; going once through a character
#: by joining or splitting, by a pattern of few signs, or by one of Unicode classes; a word of three-word windows.
COMPARE, JOIN, SIGNS, CLASSES, WINDOWS = 5, 15, 20, 25, 90


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once a row however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE + "+"), lambda w: w != "")


def count_of(text: Column, runs: str) -> Column:
    """How many code points lie in matches of a pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, runs, ""))


def windows(word: Column) -> Column:
    """Hashes of the three-word windows; none of fewer words."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(word) - 3), lambda i: F.xxhash64(F.get(word, i), F.get(word, i + 1), F.get(word, i + 2)))
    return F.when(F.size(word) >= 3, hashes).otherwise(F.array().cast("array<bigint>"))


def covered_words(hashes: Column) -> Column:
    """How many words lie in windows that occur twice or more, by sorting the windows' hashes."""

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def places(ordered: Column) -> Column:
        again = F.filter(ordered, lambda x, k: x["h"].eqNullSafe(F.get(ordered, k + 1)["h"]) | x["h"].eqNullSafe(F.get(ordered, k - 1)["h"]))
        return F.array_sort(F.transform(again, lambda x: x["i"]))

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(pairs, places), covered)


def repeated_words(word: Column) -> Column:
    """n_repeat_words; windows are sorted only where some repeat."""
    some = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered_words(h)).otherwise(F.lit(0))
    return let(word, lambda w: let(windows(w), some)).cast("long")


def mostly_repeated(word: Column) -> Column:
    """Whether n_repeat_words are more than half of all words. Each window that is spared by counting distinct ones stands for
    two windows at most, and so for six words: few of them decide alone."""

    def decide(w: Column, h: Column) -> Column:
        spared = F.size(h) - F.size(F.array_distinct(h))
        return F.when(12 * spared > F.size(w), 2 * covered_words(h) > F.size(w)).otherwise(F.lit(False))

    return let(word, lambda w: let(windows(w), lambda h: decide(w, h)))


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def duplicate_lines(line: Column) -> Column:
    return F.size(line) - F.size(F.array_distinct(line))


def n_symbols(text: Column) -> Column:
    return count_of(text, "[#*$%&|<>]+")


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed. A null text has no words;
    columns of these names are replaced, all others stay, whatever their names."""
    value = F.coalesce(F.col(f"_row.`{text}`"), F.lit(""))
    named = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")).select("_row", value.alias("_text"), words(value).alias("_words"))
    made = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": n_symbols(F.col("_text")).cast("long"),
        "n_dup_lines": let(lines(F.col("_text")), duplicate_lines).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")),
        "n_lines": F.size(lines(F.col("_text"))).cast("long"),
    }
    kept = [c for c in df.columns if c not in (*made, "base_failed")]
    out = named.select(*[F.col(f"_row.`{c}`") for c in kept], *[v.alias(k) for k, v in made.items()])
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _chars(w: Column) -> Column:
    return F.length(F.array_join(w, ""))


@dataclass(frozen=True)
class Rule:
    """``rejects`` of a text, which isn't null, and of its words; ``known`` says the same of a text and the columns that
    ``measures`` adds, where these are there anyway. Each has a cost in nanoseconds, by character and by word."""

    name: str
    rejects: Callable[[Column, Column], Column]
    known: Callable[[Column], Column]
    cost: tuple[float, float] = (0, 0)
    known_cost: tuple[float, float] = (0, 0)


#: Thresholds follow published web-corpus filters: mean word length, symbols a word, repeated lines, letters and case.
RULES = (
    Rule("few_words", lambda t, w: F.size(w) < 50, lambda t: F.col("n_words") < 50),
    Rule("repeated_windows", lambda t, w: mostly_repeated(w), lambda t: 2 * F.col("n_repeat_words") > F.col("n_words"), (0, WINDOWS)),
    Rule("word_length", lambda t, w: let(_chars(w), lambda n: (n < 2 * F.size(w)) | (n > 12 * F.size(w))), lambda t: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words")), (JOIN, 0)),
    Rule("symbols", lambda t, w: 10 * n_symbols(t) > F.size(w), lambda t: 10 * F.col("n_symbols") > F.col("n_words"), (SIGNS, 0)),
    Rule("repeated_lines", lambda t, w: let(lines(t), lambda x: 2 * duplicate_lines(x) > F.size(x)), lambda t: 2 * F.col("n_dup_lines") > F.col("n_lines"), (JOIN, 0)),
    Rule("few_letters", lambda t, w: 100 * count_of(t, r"\p{L}+") < 60 * _chars(w), lambda t: 100 * count_of(t, r"\p{L}+") < 60 * F.col("word_chars"), (JOIN + CLASSES, 0), (CLASSES, 0)),
    Rule("capitals", lambda t, w: 100 * count_of(t, r"\p{Lu}+") > 30 * _chars(w), lambda t: 100 * count_of(t, r"\p{Lu}+") > 30 * F.col("word_chars"), (JOIN + CLASSES, 0), (CLASSES, 0)),
    Rule("exclamations", lambda t, w: 5 * count_of(t, "!+") > F.size(w), lambda t: 5 * count_of(t, "!+") > F.col("n_words"), (SIGNS, 0), (SIGNS, 0)),
)


def first_of(rules: list[Rule] | tuple[Rule, ...], rejects: Callable[[Rule], Column]) -> Column:
    """The cascade: the name of the first rule that rejects; null if none does."""
    first = F.lit(None).cast("string")
    for rule in reversed(rules):
        first = F.when(rejects(rule), rule.name).otherwise(first)
    return first


def verdict(text: Column, rules: list[Rule] | tuple[Rule, ...]) -> Column:
    """The name of the first rule, in the given order, that rejects ``text``; null if none does. Words are cut once."""
    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda w: first_of(rules, lambda rule: rule.rejects(t, w))))


def order_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, text: str = "text", measured: bool = False) -> list[Rule]:
    """Rules by rejection per cost, highest first, as estimated on a sample of ``rows`` rows at most: those of least hash among
    a share of the table that holds twice as many. They decide the order only.

    One job counts, over the sample, each rule's rejections and the characters and words that its expression goes through;
    ``measured`` asks for the order of the rules over the columns of ``measures``. Ties keep the given order, as does an empty
    table. No clock is asked, so that the order is the same in every run.
    """
    total = df.count()
    if not total:
        return list(rules)
    place = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    share = math.ceil(min(1.0, 2 * rows / total) * SHARES)
    sample = df.withColumn("_place", place).where(F.pmod("_place", F.lit(SHARES)) < share).orderBy("_place").limit(rows).select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    t = F.col("text")
    if measured:
        sample, verdicts = measures(sample), [rule.known(t) for rule in rules]
        sums = [F.sum(F.length(t)).alias("chars"), F.sum("n_words").alias("words")]
    else:
        sample = sample.withColumn("_words", words(t))
        verdicts, sums = [rule.rejects(t, F.col("_words")) for rule in rules], [F.sum(F.length(t)).alias("chars"), F.sum(F.size("_words")).alias("words")]
    found = sample.agg(F.count("*").alias("n"), *sums, *[F.count_if(v).alias(f"r{k}") for k, v in enumerate(verdicts)]).first()
    if not found["n"]:
        return list(rules)

    def gain(k: int) -> float:
        by_char, by_word = rules[k].known_cost if measured else rules[k].cost
        return found[f"r{k}"] / (COMPARE * found["n"] + by_char * found["chars"] + by_word * found["words"])

    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-gain(k), k))]


def judge_measured(measured: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Add failed_rule and kept to the rows of ``measures`` by a cascade that takes the measures as they are."""
    failed = first_of(rules, lambda rule: rule.known(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    return measured.select(*[F.col(f"`{c}`") for c in measured.columns if c not in ("failed_rule", "kept")], failed.alias("failed_rule")).withColumn("kept", F.col("failed_rule").isNull())


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", order: list[Rule] | None = None) -> DataFrame:
    """Add failed_rule and kept by the cascade in its measured order, or in the given one, as from an earlier run.

    Null and empty texts fail by few_words; repeated rows are judged alike; other columns stay, and such as are called
    failed_rule or kept are replaced.
    """
    if text not in df.columns:
        raise ValueError(f"a column {text} is needed")
    others = [F.col(f"`{c}`") for c in df.columns if c not in ("failed_rule", "kept")]
    failed = verdict(F.col(f"`{text}`"), order or order_rules(df, rules, text=text))
    return df.select(*others, failed.alias("failed_rule")).withColumn("kept", F.col("failed_rule").isNull())
