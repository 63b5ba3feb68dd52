"""Tables that go on over pages: fragments name what they continue, and become one table.

The graph is checked and resolved for all documents at once: a fragment's root and its distance from it come by pointer
doubling, so that a chain of n fragments takes log n rounds; whatever has no root after as many rounds is on a cycle or behind
one. A document with anything wrong is reported and left as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import cut

#: What can be wrong with a fragment.
CODES = ("duplicate_id", "unknown_parent", "branch", "cycle", "source_page", "page_gap", "header_mismatch")


def _parent() -> Column:
    return F.nullif(F.trim(F.coalesce("continuation_of", F.lit(""))), F.lit(""))


def resolved(fragments: DataFrame) -> DataFrame:
    """document_id, table_id, root and depth of fragments (document_id, table_id, continuation_of); root is null where none is
    reached. Parents that aren't there count as none; ids must be unique within a document."""
    ids = fragments.select("document_id", "table_id")
    edges = fragments.select("document_id", "table_id", _parent().alias("_to")).join(ids.withColumnRenamed("table_id", "_to"), ["document_id", "_to"], "left_semi")
    found = edges.groupBy("document_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    at = cut(ids.join(edges, ["document_id", "table_id"], "left").select("document_id", "table_id", F.coalesce("_to", "table_id").alias("at"), F.col("_to").isNotNull().cast("long").alias("depth")))
    roots = at.where("depth = 0").select("document_id", F.col("table_id").alias("at"), F.lit(True).alias("_root"))
    for _ in range(found.bit_length()):
        beyond = at.select("document_id", F.col("table_id").alias("at"), F.col("at").alias("_next"), F.col("depth").alias("_more"))
        at = cut(at.join(beyond, ["document_id", "at"]).select("document_id", "table_id", F.col("_next").alias("at"), (F.col("depth") + F.col("_more")).alias("depth")))
    return at.join(roots, ["document_id", "at"], "left").select("document_id", "table_id", F.when(F.col("_root"), F.col("at")).alias("root"), F.when(F.col("_root"), F.col("depth")).alias("depth"))


def _fragments(fragments: DataFrame) -> DataFrame:
    pages = F.array_distinct(F.filter("pages", lambda p: p.isNotNull()))
    return fragments.withColumn("_page", F.when(F.size(pages) == 1, F.get(pages, F.lit(0)))).withColumn("_parent", _parent())


def problems(fragments: DataFrame) -> DataFrame:
    """document_id, table_id and code of what is wrong with fragments (document_id, table_id, continuation_of, pages, headers, rows).

    An id occurs once in its document; what a fragment continues is there, and continued by no other; there is no cycle. A
    fragment that continues another or is continued lies on one page, the next one after its predecessor's, and has the
    root's headers. Documents whose ids repeat are only reported for that, as nothing else can be told of them.
    """
    f = _fragments(fragments)
    repeated = f.groupBy("document_id", "table_id").agg(F.count("*").alias("n")).where("n > 1").select("document_id", "table_id", F.lit("duplicate_id").alias("code"))
    f = f.join(repeated.select("document_id").distinct(), "document_id", "left_anti")
    own = f.select("document_id", "table_id", "_parent", "_page", "headers")
    up = own.select("document_id", F.col("table_id").alias("_parent"), F.col("_page").alias("_before"), F.lit(True).alias("_there"))
    linked = own.where("_parent IS NOT NULL").join(up, ["document_id", "_parent"], "left")
    unknown = linked.where("_there IS NULL").select("document_id", "table_id", F.lit("unknown_parent").alias("code"))
    linked = linked.where("_there")
    branch = linked.groupBy("document_id", F.col("_parent").alias("table_id")).agg(F.count("*").alias("n")).where("n > 1").select("document_id", "table_id", F.lit("branch").alias("code"))
    root = resolved(f)
    cycle = root.where("root IS NULL").select("document_id", "table_id", F.lit("cycle").alias("code"))
    in_chain = linked.select("document_id", F.explode(F.array("table_id", "_parent")).alias("table_id")).distinct()
    page = own.where("_page IS NULL").join(in_chain, ["document_id", "table_id"], "left_semi").select("document_id", "table_id", F.lit("source_page").alias("code"))
    gap = linked.where(F.col("_page") != F.col("_before") + 1).select("document_id", "table_id", F.lit("page_gap").alias("code"))
    heads = own.select("document_id", F.col("table_id").alias("root"), F.col("headers").alias("_want"))
    other = own.join(root.where("depth > 0"), ["document_id", "table_id"]).join(heads, ["document_id", "root"]).where(~F.col("headers").eqNullSafe(F.col("_want"))).select("document_id", "table_id", F.lit("header_mismatch").alias("code"))
    out = repeated
    for part in (unknown, branch, cycle, page, gap, other):
        out = out.unionByName(part)
    return out


def merged(fragments: DataFrame, wrong: DataFrame | None = None) -> DataFrame:
    """One row for each root of documents without problems: document_id, table_id, table_ids, headers, rows, cells' origins,
    spans, footnotes and status.

    Fragments follow each other by their distance from the root. A first row that repeats the header is left out of the rows
    and counted in n_repeated_headers; ``origins`` tells of each merged row the fragment, its page and the row's number there.
    Spans and footnotes are kept once each, in order, empty footnotes left out. A root's fragments are gathered in one row,
    which a table's pages bound. ``wrong`` are the fragments' ``problems``, where they are known already.
    """
    wrong = problems(fragments) if wrong is None else wrong
    f = _fragments(fragments).join(wrong.select("document_id").distinct(), "document_id", "left_anti")
    r = f.join(resolved(f), ["document_id", "table_id"])
    rows = F.coalesce("rows", F.array().cast("array<array<string>>"))
    repeats = (F.col("depth") > 0) & F.coalesce(F.get(rows, F.lit(0)) == F.col("headers"), F.lit(False))
    kept = F.when(repeats, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    origin = F.transform(kept, lambda _, i: F.struct(F.col("table_id").alias("table_id"), F.col("_page").alias("page"), (i + F.when(repeats, 2).otherwise(1)).cast("int").alias("row")))
    piece = F.struct("depth", "table_id", "headers", kept.alias("rows"), origin.alias("origins"), F.coalesce("spans", F.array().cast("array<string>")).alias("spans"), F.coalesce("footnotes", F.array().cast("array<string>")).alias("footnotes"), repeats.cast("int").alias("repeated"), F.col("_page").alias("page"))
    g = r.groupBy("document_id", "root").agg(F.array_sort(F.collect_list(piece), lambda a, b: (a["depth"] - b["depth"]).cast("int")).alias("_p"))
    each = lambda name: F.flatten(F.transform("_p", lambda x: x[name]))
    notes = F.array_distinct(F.filter(F.transform(each("footnotes"), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False))))
    return g.select(
        "document_id", F.col("root").alias("table_id"), F.transform("_p", lambda x: x["table_id"]).alias("table_ids"), F.col("_p")[0]["headers"].alias("headers"), each("rows").alias("rows"), each("origins").alias("origins"),
        F.array_distinct(each("spans")).alias("spans"), notes.alias("footnotes"), F.aggregate("_p", F.lit(0), lambda a, x: a + x["repeated"]).alias("n_repeated_headers"),
        F.when(F.size("_p") > 1, "cross_page_merged").otherwise("single").alias("status"), F.col("_p")[0]["page"].alias("first_page"),
    )


def ordered(tables: DataFrame) -> DataFrame:
    """With position: a document's merged tables by their first page, then id; tables without a page come last."""
    return tables.withColumn("position", F.row_number().over(W.partitionBy("document_id").orderBy(F.asc_nulls_last("first_page"), "table_id")))
