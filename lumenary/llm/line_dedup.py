"""Line deduplication by overlapping three-line windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 3
WHITE = " \t\n\x0b\f\r"


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """_row, the whole row, so that no column of it can clash with ours; _key and _own, its key and its text's hash, which tell
    rows apart."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")).select("_row", F.col(f"_row.`{key}`").alias("_key"), F.xxhash64(F.col(f"_row.`{text}`")).alias("_own"))


def covered(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_key, _own and _covered: the numbers (from 0, among lines with a word) of lines that lie in a later occurrence of a
    window, for the rows of ``_rows``. Rows without such lines are left out.

    A window is three consecutive lines with a word, compared without surrounding white space by a 128-bit hash. Its first
    occurrence, by (key, line number), stays. Counting merges on the map side, so a window that a third of all rows share
    is one row a task; repeated windows are written, so that both sides of the join of occurrences with them come straight
    from a shuffle and Spark can split a hot window.
    """
    value = F.coalesce(F.col(f"_row.`{text}`"), F.lit(""))
    lines = F.filter(F.transform(F.split(value, "\n"), lambda x: F.trim(x, F.lit(WHITE))), lambda x: x != "")
    at = lambda i, k: F.get(F.col("_lines"), i + k)
    hashes = F.transform(F.sequence(F.lit(0), F.size("_lines") - WINDOW), lambda i: F.struct(F.xxhash64(at(i, 0), at(i, 1), at(i, 2)).alias("a"), F.xxhash64(at(i, 2), F.lit("|"), at(i, 0), at(i, 1)).alias("b")))
    occurrences = _rows(df, key, text).select("_key", "_own", lines.alias("_lines")).where(F.size("_lines") >= WINDOW).select("_key", "_own", F.posexplode(hashes).alias("_at", "_hash"))
    occurrences = occurrences.select("_key", "_own", "_at", "_hash.a", "_hash.b")
    place = F.struct("_key", "_at", "_own")
    repeated = written(occurrences.groupBy("a", "b").agg(F.count("*").alias("_n"), F.min(place).alias("_first")).where("_n > 1").select("a", "b", "_first"), "windows")
    later = occurrences.join(repeated, ["a", "b"]).where(~place.eqNullSafe(F.col("_first")))
    spread = F.explode(F.array(*[F.col("_at") + k for k in range(WINDOW)])).alias("_line")
    return later.select("_key", "_own", spread).groupBy("_key", "_own").agg(F.collect_set("_line").alias("_covered"))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove the covered lines; add n_lines (lines with a word) and n_removed.

    Lines without a word stay where they are. A text of which nothing but such lines stays becomes them; null texts stay
    null, with no lines. Rows with equal key, null included, and equal text (repeated rows) are one occurrence and lose
    nothing to each other; rows with equal key and other texts are occurrences of their own. Null keys come first. Other
    columns stay, whatever their names; columns that are called n_lines or n_removed are replaced. An empty table gives an
    empty result.
    """
    found = covered(df, key, text).withColumnsRenamed({"_key": "_k", "_own": "_o"})
    joined = _rows(df, key, text).join(found, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_own") == F.col("_o")), "left").drop("_key", "_own", "_k", "_o")
    joined = joined.withColumn("_parts", F.split(F.coalesce(F.col(f"_row.`{text}`"), F.lit("")), "\n"))
    worded = F.filter(F.transform("_parts", lambda x, i: F.when(F.trim(x, F.lit(WHITE)) != "", i)), lambda i: i.isNotNull())
    marked = joined.withColumn("_worded", worded)
    kept = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.transform("_covered", lambda n: F.get("_worded", n)))
    clean = F.when(F.col("_covered").isNull(), F.col(f"_row.`{text}`")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_parts", i)), "\n"))
    return marked.select(
        *[clean.alias(text) if c == text else F.col(f"_row.`{c}`") for c in df.columns if c not in ("n_lines", "n_removed")],
        F.size("_worded").cast("long").alias("n_lines"),
        F.coalesce(F.size("_covered"), F.lit(0)).cast("long").alias("n_removed"),
    )
