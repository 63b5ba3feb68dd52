"""Tables as data: Markdown grids, facts, spans and checks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

FACTS = "table_id string, row_index int, row_label string, column_name string, value string"


def grid(markdown: Column) -> Column:
    """The cells of a Markdown table, row by row; separator rows and repeated headers are left out."""
    rows = F.filter(F.transform(F.split(markdown, "\n"), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("|")) & ~x.rlike(r"^\|[\s:|-]+\|$"))
    cells = F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(r, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
    return T.let(cells, lambda g: F.filter(g, lambda r, i: (i == 0) | (r != F.get(g, F.lit(0)))))


def facts(tables: DataFrame, by: str = "table_id", text: str = "markdown") -> DataFrame:
    """A row for each filled cell behind the first column: table, row, row label, column and value, with blank labels
    filled from above. Cells that hold dashes only are left out."""
    g = tables.select(by, T.let(grid(F.col(text)), lambda x: x).alias("_g"))
    rows = g.select(by, F.get("_g", F.lit(0)).alias("_head"), F.posexplode(F.filter("_g", lambda _, i: i > 0)).alias("row_index", "_cells"))
    w = W.partitionBy(by).orderBy("row_index").rowsBetween(W.unboundedPreceding, 0)
    labelled = rows.withColumn("row_label", F.last(F.nullif(F.get("_cells", F.lit(0)), F.lit("")), ignorenulls=True).over(w))
    cells = labelled.select(by, "row_index", "row_label", "_head", F.posexplode("_cells").alias("_c", "value"))
    return cells.where((F.col("_c") > 0) & (F.col("value") != "") & ~F.col("value").rlike("^[-–—]+$")).select(by, "row_index", "row_label", F.get("_head", F.col("_c")).alias("column_name"), "value")


#: Rows of datasets' metrics that a table gives at most (fixed value).
MOST_METRICS = 24


def metric_values(tables: DataFrame, by: str = "table_id", text: str = "markdown") -> DataFrame:
    """The table, model (the row's label), dataset and values (a map from metric to value) of tables whose headers name a dataset
    and a metric; values without a digit don't count. Equal rows of one model and dataset are one, and each table gives the
    first MOST_METRICS."""
    dataset, metric = T.metric_header(F.col("column_name"))
    f = facts(tables, by, text).withColumns({"dataset": F.upper(dataset), "metric": F.initcap(metric)}).where(F.col("metric").isNotNull() & F.col("value").rlike(r"\d"))
    named = f.withColumn("metric", F.when(F.upper("metric").isin("F1", "AUC"), F.upper("metric")).otherwise(F.col("metric")))
    g = named.groupBy(by, "row_index", F.col("row_label").alias("model"), "dataset").agg(F.sort_array(F.collect_list(F.struct("metric", "value"))).alias("values"))  # five metrics at most
    once = g.groupBy(by, "model", "dataset", "values").agg(F.min("row_index").alias("row_index"))
    w = W.partitionBy(by).orderBy("row_index", "dataset")
    return once.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= MOST_METRICS).select(by, "model", "dataset", F.map_from_entries("values").alias("values"))


def assemble(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Whole tables from their chunks (document_id, parse_version, table_id, ordinal, chunk_id, text): the first line that
    isn't a row is the caption, the first row the header, and repetitions of it in later chunks are dropped.

    Order-dependent by nature, and bounded by one table."""
    schema = "document_id long, parse_version string, table_id string, caption string, markdown string, row_count int, source_chunk_ids array<string>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ordinal", "chunk_id"])
        caption, header, rows = None, None, []
        for t in pdf[text]:
            for line in (t or "").splitlines():
                line = line.strip()
                if not (line.startswith("|") and "|" in line[1:]):
                    caption = caption or line or None
                elif re.fullmatch(r"\|[\s:|-]+\|?", line) or line == header:
                    continue
                elif header is None:
                    header = line
                else:
                    rows.append(line)
        first = pdf.iloc[0]
        lines = ([header, "|" + "---|" * (header.count("|") - 1), *rows]) if header else [caption or ""]
        return pd.DataFrame([(first["document_id"], first["parse_version"], first["table_id"], caption, "\n".join(lines), len(rows), list(dict.fromkeys(pdf["chunk_id"])))], columns=["document_id", "parse_version", "table_id", "caption", "markdown", "row_count", "source_chunk_ids"])

    return chunks.groupBy("document_id", "parse_version", "table_id").applyInPandas(run, schema)


def validate(cells: DataFrame) -> DataFrame:
    """table_id, code and n of what is wrong with cells (table_id, row_index, column_index, rowspan, colspan): places that
    two cells cover, and places of the grid that none covers."""
    covered = cells.select("table_id", F.explode(F.sequence(F.col("row_index"), F.col("row_index") + F.col("rowspan") - 1)).alias("r"), "column_index", "colspan").select("table_id", "r", F.explode(F.sequence(F.col("column_index"), F.col("column_index") + F.col("colspan") - 1)).alias("c"))
    counted = covered.groupBy("table_id", "r", "c").agg(F.count("*").alias("n"))
    overlap = counted.where("n > 1").groupBy("table_id").agg(F.count("*").alias("n")).select("table_id", F.lit("overlap").alias("code"), "n")
    size = counted.groupBy("table_id").agg(((F.max("r") + 1) * (F.max("c") + 1) - F.count("*")).alias("n")).where("n > 0")
    return overlap.unionByName(size.select("table_id", F.lit("gap").alias("code"), "n"))


def html_markdown(html: str | None) -> str:
    """The first tables of a piece of HTML as one Markdown table, as an older reader made it: a cell's text stands in every place
    that it spans, rows are filled up to the widest, and the first is the header. Without a table, the HTML itself."""
    grid: dict[tuple[int, int], str] = {}
    at, last = -1, None
    for t, r, c, rs, cs, _, text in html_cells(html or ""):
        if (t, r) != last:
            at, last = at + 1, (t, r)
        cell = text.replace("\\", "\\\\").replace("|", "\\|")
        grid |= {(at + i, c + j): cell for i in range(rs) for j in range(cs)}
    if not grid:
        return (html or "").strip()
    height, width = (max(k[x] for k in grid) + 1 for x in (0, 1))
    lines = ["| " + " | ".join(grid.get((r, c), "") for c in range(width)) + " |" for r in range(height)]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


#: Most columns that a cell spans, as browsers have it (fixed value).
COLUMNS_SPANNED = 1000


def html_cells(html: str) -> Iterator[tuple[int, int, int, int, int, bool, str]]:
    """Cells of the tables in a piece of HTML: table, row, column, rowspan, colspan, header and text. A span is anchored at
    its cell; rowspans end with their row group, colspans at COLUMNS_SPANNED columns."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.table, self.open, self.out, self.groups = -1, [], [], []

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            if tag == "table":
                self.table += 1
                self.open.append({"id": self.table, "row": -1, "group": 0, "cell": None})
            elif self.open and tag in ("thead", "tbody", "tfoot"):
                self.open[-1]["group"] += 1
            elif self.open and tag == "tr":
                self.close_cell()
                self.open[-1]["row"] += 1
            elif self.open and tag in ("td", "th"):
                self.close_cell()
                top = self.open[-1]
                span = [max(1, int(x)) if (x := a.get(k) or "1").isdigit() else 1 for k in ("rowspan", "colspan")]
                top["row"] = max(top["row"], 0)
                top["cell"] = [top["id"], top["row"], top["group"], *span, tag == "th", []]

        def handle_endtag(self, tag):
            if self.open and tag in ("td", "th", "tr"):
                self.close_cell()
            elif self.open and tag == "table":
                self.close_cell()
                self.open.pop()

        def handle_data(self, data):
            if self.open and self.open[-1]["cell"]:
                self.open[-1]["cell"][-1].append(data)

        def close_cell(self):
            if self.open and self.open[-1]["cell"]:
                self.out.append(self.open[-1]["cell"])
                self.open[-1]["cell"] = None

    reader = Reader()
    reader.feed(html or "")
    reader.close()
    last: dict[tuple[int, int], int] = {}
    for t, r, g, *_ in reader.out:
        last[t, g] = max(last.get((t, g), 0), r)
    taken: dict[int, set[tuple[int, int]]] = {}
    for t, r, g, rs, cs, head, parts in reader.out:
        used, c = taken.setdefault(t, set()), 0
        while (r, c) in used:
            c += 1
        rs, cs = min(rs, last[t, g] - r + 1), min(cs, COLUMNS_SPANNED)
        used.update((r + i, c + j) for i in range(rs) for j in range(cs))
        yield t, r, c, rs, cs, head, " ".join("".join(parts).split())
