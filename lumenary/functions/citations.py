"""Citation markers of answers as column expressions. Markers are zero-based: [0] cites the first context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

MARKER = r"\[(\d+)\]"
#: Notices that look like a label in brackets and stay (fixed values).
NOTICES = "系统提示|System notice"
#: Links to pages of the library itself, which vanish (fixed value).
INTERNAL = r"(sources|entities|queries)/[^\s\]]+"


def normalised(answer: Column) -> Column:
    """Markers in one form: [[1]] and [1, 2] become [1] and [1][2]; internal links vanish, other links become their text, and
    labels in brackets that stand for nothing vanish."""
    t = F.coalesce(answer, F.lit(""))
    t = F.regexp_replace(t, r"\[\[(\d+)\]\]", "[$1]")
    t = F.regexp_replace(t, r"\[\[([^\]]+)\]\([^)]+\)\]", "$1")
    # Lists of numbers, whatever their length, are cut at their commas one by one.
    lists = r"\[(?:\d+\s*,\s*)+\d+\]"
    parts, found = F.split(t, lists), F.regexp_extract_all(t, F.lit(lists), F.lit(0))
    t = F.array_join(F.flatten(F.zip_with(parts, F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"\s*,\s*", "]["), r"\s+", "")), lambda p, x: F.array(p, F.coalesce(x, F.lit(""))))), "")
    t = F.regexp_replace(t, rf"\[\[\s*{INTERNAL}\s*\]\]", "")
    t = F.regexp_replace(t, r"\[\[([^\]]+)\]\]", "$1")
    return F.regexp_replace(t, rf"\[(?!\s*\d+\s*\])(?!\s*(?:{NOTICES}))[^\]\n]+\](?!\()", "")


def _markers(answer: Column, becomes) -> Column:
    """``answer`` with each marker replaced by what ``becomes`` makes of its number."""

    def of(t: Column) -> Column:
        numbers = F.regexp_extract_all(t, F.lit(MARKER), F.lit(1))
        return F.array_join(F.flatten(F.zip_with(F.split(t, MARKER), F.transform(numbers, lambda n: becomes(n.cast("int"))), lambda p, x: F.array(p, F.coalesce(x, F.lit(""))))), "")

    return let(answer, of)


def _marker(number: Column) -> Column:
    return F.concat(F.lit("["), number.cast("string"), F.lit("]"))


def renumbered(answer: Column, selected: Column) -> Column:
    """Markers by their place in ``selected``, an array of contexts' numbers; markers of others vanish."""
    return _markers(normalised(answer), lambda n: let(F.array_position(selected, n), lambda at: F.when(at > 0, _marker(at - 1)).otherwise(F.lit(""))))


def returned_only(answer: Column, count: Column) -> Column:
    """Without markers beyond the citations that are returned."""
    return _markers(F.coalesce(answer, F.lit("")), lambda n: F.when(n < count, _marker(n)).otherwise(F.lit("")))


def ensured(answer: Column, count: Column) -> Column:
    """With [0] at the end if citations are returned and no marker is valid; an empty answer stays empty."""
    t = F.coalesce(answer, F.lit(""))
    valid = F.exists(F.regexp_extract_all(t, F.lit(r"(?<!\[)\[(\d+)\](?!\])"), F.lit(1)), lambda n: n.cast("int") < count)
    bare = F.regexp_replace(t, r"\s+$", "")
    return F.when((count <= 0) | (bare == "") | valid, t).otherwise(F.concat(bare, F.when(t.rlike(r"[ \n]$"), "").otherwise(" "), F.lit("[0]")))


def stripped(answer: Column) -> Column:
    return F.regexp_replace(normalised(answer), MARKER, "")
