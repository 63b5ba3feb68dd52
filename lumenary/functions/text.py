"""Text functions as column expressions."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "\\u4e00-\\u9fff"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def spelled(text: Column) -> Column:
    """The lower-case text in which Greek delta is a word, and spellings of the enthalpy of vaporisation have all their words.
    They are looked for in texts alone that hold a part of one."""

    def of(t: Column) -> Column:
        letters = F.contains(t, F.lit("\u03b4")) | F.contains(t, F.lit("\u2206")) | F.contains(t, F.lit("\u0394"))
        named = F.when(letters, F.regexp_replace(t, "[\u03b4\u2206\u0394]", "delta ")).otherwise(t)
        one = lambda x: F.regexp_replace(F.regexp_replace(x, r"\bdelta\s*h\s*[-_ ]?\s*vap\b", "delta h vap hvap"), r"\bh\s*[-_ ]?\s*vap\b", "h vap hvap")
        return let(named, lambda x: F.when(F.contains(x, F.lit("vap")), one(x)).otherwise(x))

    return let(F.lower(F.coalesce(text, F.lit(""))), of)


def tokens(text: Column, chemistry: bool = True) -> Column:
    """Distinct lexical tokens: Latin words of two or more characters; runs of CJK characters whole and as bigrams.

    Greek delta becomes a word, and spellings of the enthalpy of vaporisation share their tokens. A null text has none.
    """
    none = F.array().cast("array<string>")

    def of(t: Column) -> Column:
        words = F.regexp_extract_all(t, F.lit("[a-z0-9_]{2,}"), F.lit(0))

        def cjk(runs: Column) -> Column:
            pairs = F.flatten(F.transform(F.filter(runs, lambda r: F.length(r) > 1), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
            return F.concat(runs, pairs)

        ascii_only = F.octet_length(t) == F.length(t)
        found = F.concat(words, F.when(ascii_only, none).otherwise(let(F.regexp_extract_all(t, F.lit(f"[{CJK}]+"), F.lit(0)), cjk)))
        if chemistry:
            has = lambda w: F.array_contains(words, w)
            more = F.concat(found, F.when(has("hvap"), F.array(F.lit("delta"), F.lit("vap"))).otherwise(none), F.when(has("delta") & has("vap"), F.array(F.lit("hvap"))).otherwise(none))
            found = F.when(F.contains(t, F.lit("vap")), more).otherwise(found)
        return F.array_distinct(found)

    return let(spelled(text) if chemistry else F.lower(F.coalesce(text, F.lit(""))), of)


_RUNS = re.compile("[\u4e00-\u9fff]+")


@cache
def _words(least: int) -> re.Pattern:
    return re.compile(f"[a-z0-9_]{{{max(2, least)},}}")


def token_set(text: str, least: int = 1) -> set[str]:
    """``tokens`` of ``least`` characters or more of a text from ``spelled``, for loops within a task: a text's words take an
    eighth of the time that the expression takes."""
    found = set(_words(least).findall(text))
    if not text.isascii():
        for run in _RUNS.findall(text):
            found |= {t for t in (run, *(run[i : i + 2] for i in range(len(run) - 1 if least <= 2 else 0))) if len(t) >= least}
    if least <= 5 and "vap" in text:
        words = set(_words(2).findall(text))
        more = {"delta", "vap"} if "hvap" in words else {"hvap"} if {"delta", "vap"} <= words else set()
        found |= {t for t in more if len(t) >= least}
    return found


def attachment_tokens(text: Column) -> Column:
    """Tokens of attachments: mixed runs stay joined, single characters count, repetitions stay."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z0-9{CJK}]+"), F.lit(0))


#: Greek letters and their names (fixed values).
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu",
    "ν": "nu", "ξ": "xi", "ο": "omicron", "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau", "υ": "upsilon", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega",
}


def greek_names(text: Column) -> Column:
    for letter, name in GREEK.items():
        text = F.replace(text, F.lit(letter), F.lit(name))
    return text


def lookup_key(text: Column) -> Column:
    """Key by which tables are looked up: lower-case ASCII letters and digits; Greek letters vanish."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def fact_key(text: Column) -> Column:
    """Key of facts: as ``lookup_key``, but Greek letters become their names."""
    return F.regexp_replace(greek_names(F.lower(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "")


def scientific_key(text: Column, rounds: int = 4) -> Column:
    """Key of scientific terms: LaTeX wrappers stripped (nested up to ``rounds`` deep), subscripts folded, Greek named."""
    t = F.coalesce(text, F.lit(""))
    for _ in range(rounds):
        t = F.regexp_replace(t, r"\\(?:mathrm|mathbf|mathit|text|textbf|operatorname|rm)\s*\{([^{}]*)\}", "$1")
        t = F.regexp_replace(t, r"[_^]\{([^{}]*)\}", "$1")
    t = F.translate(t, "₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹", "01234567890123456789")
    return F.regexp_replace(greek_names(F.lower(F.replace(t, F.lit("\\"), F.lit("")))), "[^a-z0-9]+", "")


def has_alias(text: Column, alias: str) -> Column:
    """Whether ``alias`` stands in the text as a word; hyphens and underscores belong to words."""
    return F.lower(text).rlike(r"(^|[^a-z0-9_\-])" + "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in alias.lower()) + r"([^a-z0-9_\-]|$)")


def numeric_cell(text: Column) -> Column:
    """Whether a cell holds numbers only: signs, percentages, and values with an uncertainty."""
    number = r"[+-]?\d+(\.\d+)?%?"
    cleaned = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*(±|\+/-)\s*", " "))
    return cleaned.rlike(rf"^([+-]\s+)?{number}(\s+([+-]\s+)?{number})*$")


def first_float(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"-?\d+(\.\d+)?", 0).try_cast("double")


def text_layer_quality(text: Column) -> Column:
    """high, medium or low, by length, density of letters and digits, and replacement characters."""

    def of(t: Column) -> Column:
        n = F.length(t)
        kept = F.array_join(F.regexp_extract_all(t, F.lit(f"[{CJK}A-Za-z0-9]+"), F.lit(0)), "")  # a replacement of what lies between takes ten times as long
        density = F.length(kept) / n
        judged = let(density, lambda d: F.when(d < 0.28, "low").when((n > 120) & (d >= 0.4), "high").otherwise("medium"))
        return F.when((n < 40) | F.contains(t, F.lit("\ufffd")), "low").otherwise(judged)

    return let(F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r")), of)


def formula_noise(text: Column) -> Column:
    """Whether a text looks like the debris of a formula: short tokens and operators."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    short = lambda ws: F.size(F.filter(ws, lambda w: F.length(w) <= 2)) >= 0.8 * F.size(ws)
    operators = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[-+=/*^;∑∫√]"))
    return F.when(operators < 8, False).otherwise(let(words, lambda ws: (F.size(ws) >= 12) & short(ws)))


#: A value with its unit (fixed value), and words by which sentences with facts are known (fixed values).
FACT_VALUE = r"\d+\s*个?\s*(天|周|月|年|小时|分钟|mg|g|ml|%|次|days?|weeks?|months?|years?|hours?)|[一二三四五六七八九十两]+个?(天|周|月|年|小时|分钟)"
FACT_MARKERS = [
    "建议", "复查", "随访", "诊断", "用药", "剂量", "治疗", "检查", "结果", "结论", "风险", "时间",
    "recommended", "recommendation", "follow-up", "follow up", "diagnosis", "medication", "dose", "treatment", "result", "conclusion", "risk",
]


def transient_value(name: Column) -> Column:
    """Whether a name is a passing value: a number with a unit, or digits and separators only."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return (n == "") | n.rlike("(?i)" + FACT_VALUE) | n.rlike(r"^[\d\s.,:%/-]+$")


def page_number(label: Column) -> Column:
    """First digits of a page label."""
    return F.nullif(F.regexp_extract(F.coalesce(label, F.lit("")), r"\d+", 0), F.lit("")).cast("int")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def byte_estimate(text: Column) -> Column:
    """Tokens where no tokenizer is at hand: bytes of UTF-8."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def anchor_window(text: Column, anchor: Column, width: int) -> Column:
    """The text around the first occurrence of ``anchor``, a quarter of the width before it; its beginning without one."""
    at = F.instr(F.lower(text), F.lower(anchor)) - 1
    begin = F.when(at < 0, 0).otherwise(F.greatest(F.lit(0), at - width // 4))
    return F.substring(text, begin + 1, F.least(F.length(text) - begin, F.lit(width)))


def answer_numbers(text: Column) -> Column:
    """Numbers that an answer must support: with their percent sign, single digits and citation markers left out."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[\d+\]", " ")
    return F.array_distinct(F.filter(F.regexp_extract_all(bare, F.lit(r"\d+(?:\.\d+)?%?"), F.lit(0)), lambda x: F.length(x) > 1))


def synthesis_numbers(text: Column) -> Column:
    """Numbers of a synthesis: without citation markers, numbers of tables and digits within words."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[\s*\d+\s*\]", " "), r"(?i)\btable\s*(?:s\s*)?\d+(?:\.\d+)?\b", " ")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?<![A-Za-z0-9_])\d+(?:\.\d+)?(?![A-Za-z0-9_.])"), F.lit(0)))


def unsupported_numbers(synthesis: Column, evidence: Column) -> Column:
    """Numbers of a synthesis that its evidence has in no spelling: 21 and 21.0 are one, 80 and 80.5 aren't."""
    have = F.transform(synthesis_numbers(evidence), lambda x: x.cast("double"))
    return let(have, lambda h: F.filter(synthesis_numbers(synthesis), lambda x: ~F.array_contains(h, x.cast("double"))))


#: Other spellings of some selectors (fixed values): looked for in the raw text, whatever its case.
SPELLINGS = {"mu": r"μ|\bmu\b|\bdipole\b|\(D\)", "dipole": r"μ|\bmu\b|\bdipole\b|\(D\)", "gamma": r"γ|\bgamma\b|\bsurface\s+tension\b"}


def citation_markers(text: Column) -> Column:
    """Markers in one form: [[n]] becomes [n], and [a, b] becomes [a][b]."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[\[(\d+)\]\]", "[$1]")
    for _ in range(6):
        t = F.regexp_replace(t, r"\[(\d+)\s*,\s*(\d[\d,\s]*)\]", "[$1][$2]")
    return t


def safe_filename(name: Column, most: int = 120) -> Column:
    """A file's name without folders and signs that file systems don't take; "upload" where nothing is left."""
    bare = F.regexp_replace(F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\\\]*)$", 1), r"[^\w.\-\u4e00-\u9fff]+", "_")
    bare = F.substring(F.regexp_replace(bare, r"^[._]+|[._]+$", ""), 1, most)
    return F.when(bare == "", F.lit("upload")).otherwise(bare)


def readable_title(slug_: Column) -> Column:
    """A title of a slug: its words, with capitals."""
    return F.initcap(F.trim(F.regexp_replace(F.coalesce(slug_, F.lit("")), "[-_]+", " ")))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def fact_id(table: Column, row: Column, column: Column, value: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", table, row, column, value), 256), 1, 16)


def unit_suffix(value: Column) -> Column:
    """The unit behind a number; empty without one."""
    return F.regexp_extract(F.coalesce(value, F.lit("")), r"^[+-]?\d+(\.\d+)?\s*([A-Za-z%°/]+)$", 2)


def sentences(text: Column) -> Column:
    """Parts that end in a full stop, question or exclamation mark (Latin or CJK), or at a line's end."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^.!?。！？\\n]+[.!?。！？]?"), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")


def table_data(text: Column) -> Column:
    """Whether a text holds a table with data: contiguous rows of pipes; behind a separator row any row with two filled
    cells, without one a header of two cells and a later row of two cells with a number."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))

    def of(ls: Column) -> Column:
        def row(x: Column) -> Column:
            return F.startswith(x, F.lit("|")) & (F.length(x) > 1)

        def separator(x: Column) -> Column:
            return x.rlike(r"^\|[\s:|-]+\|?$")

        def cells(x: Column) -> Column:
            return F.size(F.filter(F.split(x, r"\|"), lambda c: F.trim(c) != ""))

        with_separator = F.exists(F.transform(ls, lambda x, i: row(x) & ~separator(x) & (cells(x) >= 2) & F.coalesce(separator(F.get(ls, i - 1)) | separator(F.get(ls, i - 2)), F.lit(False))), lambda b: b)
        plain = F.exists(F.transform(ls, lambda x, i: row(x) & (cells(x) >= 2) & x.rlike(r"\d") & F.coalesce(row(F.get(ls, i - 1)) & (cells(F.get(ls, i - 1)) >= 2), F.lit(False))), lambda b: b)
        return with_separator | plain

    return let(lines, of)


def metric_numbers(text: Column) -> Column:
    """A metric's name and a digit somewhere."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.rlike(r"(^|[^a-z0-9_])(auc|f1|precision|recall|accuracy|rmse|mae|score)([^a-z0-9_]|$)") & low.rlike(r"\d")


def selector_in_text(selector: str, text: Column) -> Column:
    """Lower-case selectors need word boundaries on the raw text; others are looked for in its key."""
    import re

    key = re.sub("[^a-z0-9]+", "", selector.lower())
    other = F.coalesce(text, F.lit("")).rlike("(?iu)" + SPELLINGS[key]) if key in SPELLINGS else F.lit(False)
    if re.fullmatch(r"[a-z][a-z0-9]*", selector):
        return other | F.lower(text).rlike(rf"(^|[^a-z0-9\-]){selector}([^a-z0-9\-]|$)")
    return other | F.contains(scientific_key(text), scientific_key(F.lit(selector)))


def term_matches(term: str, text: Column) -> Column:
    """Whether a required term stands in a text: numbers exactly (2.35 isn't 2.350), words by their key."""
    import re

    if re.fullmatch(r"-?\d+(\.\d+)?", term):
        return text.rlike(rf"(^|[^0-9.]){re.escape(term)}([^0-9.]|\.[^0-9]|\.?$)")
    return F.contains(scientific_key(text), scientific_key(F.lit(term)))


def without_overlap(before: Column, after: Column, least: int = 8, most: int = 200) -> Column:
    """``after`` without the longest beginning, from ``least`` characters on, with which ``before`` ends."""
    sizes = F.filter(F.sequence(F.lit(most), F.lit(least), F.lit(-1)), lambda n: (F.length(after) >= n) & F.endswith(before, F.substring(after, F.lit(1), n)))
    return F.substring(after, F.coalesce(F.get(sizes, F.lit(0)), F.lit(0)) + 1, F.length(after))


def metric_header(header: Column) -> tuple[Column, Column]:
    """Dataset and metric of a column's header such as "NYT F1" or "WEB Precision 2"; words for a row's subject are no
    datasets (fixed values)."""
    pattern = r"(?i)^(.+?)\s+(F1|AUC|Precision|Recall|Accuracy)(?:\s+\d+)?$"
    clean = F.trim(F.regexp_replace(F.coalesce(header, F.lit("")), r"\s+", " "))
    dataset = F.trim(F.regexp_extract(clean, pattern, 1))
    named = (dataset != "") & ~F.lower(dataset).isin("model", "variant", "method", "approach", "system")
    return F.when(named, dataset), F.when(named, F.regexp_extract(clean, pattern, 2))


def key_facts(text: Column, most: int = 12) -> Column:
    """Sentences of six characters or more that hold a value with a unit or a marker, each once."""
    return F.slice(F.array_distinct(F.filter(sentences(text), lambda s: (F.length(s) >= 6) & F.lower(s).rlike(FACT_VALUE + "|" + "|".join(FACT_MARKERS)))), 1, most)


def packed_snippets(parts: Column, most: int) -> Column:
    """Parts joined by blanks, in order, into snippets of at most ``most`` characters; a longer part stands alone."""
    start = F.array(F.lit("")).cast("array<string>")

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = F.length(last) + 1 + F.length(x) <= most
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", F.nullif(last, F.lit("")), x)))
        return F.when((last == "") | fits, joined).otherwise(F.concat(acc, F.array(x)))

    return F.filter(F.aggregate(parts, start, add), lambda s: s != "")
