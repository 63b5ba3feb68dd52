"""Readers of raw files and texts: dispatch, text, Markdown and HTML adapters, layout JSON, reports."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Formats by suffix (fixed values); other suffixes are text.
FORMATS = {"pdf": "pdf", "docx": "docx", "html": "html", "htm": "html", "xhtml": "html", "md": "markdown", "markdown": "markdown", "txt": "text"}
BLOCKS = "ordinal int, block_type string, level int, text string"


def format_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    out = F.lit("text")
    for k, v in FORMATS.items():
        out = F.when(suffix == k, v).otherwise(out)
    return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, format, content_hash and content of files, through Spark's reader."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return b.select("path", format_of(F.col("path")).alias("format"), F.sha2("content", 256).alias("content_hash"), "content")


def paragraphs(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Blank-line-separated paragraphs: key, ordinal, line_start, line_end (from 0) and text. Native."""
    value = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "^﻿", ""), "\r\n?", "\n")
    lines = df.select(key, F.posexplode(F.split(value, "\n")).alias("_i", "_x"))
    filled = F.trim("_x") != ""
    w = W.partitionBy(key).orderBy("_i")
    starts = (filled & ~F.coalesce(F.lag(filled).over(w), F.lit(False))).cast("int")
    g = lines.withColumn("_f", filled).withColumn("_g", F.sum(starts).over(w)).where("_f")
    return g.groupBy(key, (F.col("_g") - 1).cast("int").alias("ordinal")).agg(F.min("_i").alias("line_start"), F.max("_i").alias("line_end"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]), "\n").alias("text"))


def markdown_blocks(text: str | None) -> list[tuple[str, int, str]]:
    """Type, level and text of the blocks of a Markdown text; what stands under a heading of references is reference."""
    out: list[tuple[str, int, str]] = []
    lines, i, reference = (text or "").lstrip("﻿").splitlines(), 0, False
    while i < len(lines):
        line = lines[i].strip()
        if not line:
            i += 1
        elif m := re.match(r"(```+|~~~+)", line):
            j = i + 1
            while j < len(lines) and not lines[j].strip().startswith(m.group()):
                j += 1
            out.append(("code", 0, "\n".join(lines[i + 1 : j])))
            i = j + 1
        elif line.startswith("$$"):
            j = i
            while not (lines[j].strip().endswith("$$") and (j > i or len(line) > 3)) and j + 1 < len(lines):
                j += 1
            out.append(("formula", 0, "\n".join(lines[i : j + 1]).strip().strip("$").strip()))
            i = j + 1
        elif (m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line)) or (i + 1 < len(lines) and re.fullmatch(r"=+|-{2,}", lines[i + 1].strip()) and not line.startswith("|")):
            level = len(m[1]) if m else 1 if lines[i + 1].strip()[0] == "=" else 2
            title = m[2] if m else line
            reference = re.sub(r"^[\d.\s]+", "", title).strip().lower() in ("references", "bibliography", "参考文献")
            out.append(("heading", level, title))
            i += 1 if m else 2
        elif line.startswith("|"):
            j = i
            while j < len(lines) and lines[j].strip().startswith("|"):
                j += 1
            out.append(("table", 0, "\n".join(x.strip() for x in lines[i:j])))
            i = j
        elif m := re.fullmatch(r"!\[([^\]]*)\]\(([^)]*)\)", line):
            out.append(("figure", 0, m[1] or m[2]))
            i += 1
        else:
            j = i
            while j < len(lines) and lines[j].strip() and not re.match(r"#{1,6}\s|\||```|~~~|\$\$|!\[", lines[j].strip()) and not (j + 1 < len(lines) and j > i and re.fullmatch(r"=+|-{2,}", lines[j + 1].strip())):
                j += 1
            j = max(j, i + 1)
            out.append(("reference" if reference else "paragraph", 0, "\n".join(x.strip() for x in lines[i:j])))
            i = j
    return out


class _Blocks(HTMLParser):
    """Blocks in document order; what nav, script and style hold is left out."""

    SKIP = {"nav", "script", "style", "noscript", "template", "header", "footer", "aside"}
    KEEP = {"p": "paragraph", "li": "paragraph", "pre": "code", "figcaption": "caption", "blockquote": "paragraph", "math": "formula", "td": "cell", "th": "cell", "title": ""}

    def __init__(self):
        super().__init__()
        self.out, self.buffer, self.kind, self.level, self.skipped = [], [], "paragraph", 0, 0

    def flush(self):
        text = "".join(self.buffer)
        text = text.strip("\n") if self.kind == "code" else " ".join(text.split())
        if text and self.kind:
            self.out.append((self.kind, self.level, text))
        self.buffer, self.kind, self.level = [], "paragraph", 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skipped += 1
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.kind, self.level = "heading", int(tag[1])
        elif tag in self.KEEP:
            self.flush()
            self.kind = self.KEEP[tag]
        elif tag == "br":
            self.buffer.append("\n")
        elif tag == "img":
            alt = dict(attrs).get("alt")
            if alt:
                self.flush()
                self.out.append(("figure", 0, alt))
        elif tag in ("div", "section", "article", "table", "tr", "ul", "ol", "figure", "body"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag in self.KEEP or re.fullmatch("h[1-6]", tag) or tag in ("div", "section", "article", "table", "tr", "body", "figure"):
            self.flush()

    def handle_data(self, data):
        if not self.skipped:
            self.buffer.append(data)


def html_blocks(html: str | None) -> list[tuple[str, int, str]]:
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.out


def blocks(df: DataFrame, key: str, column: str, parse) -> DataFrame:
    """A row for each block that ``parse`` finds in ``column``: key, ordinal, block_type, level and text."""

    def run(batches):
        for b in batches:
            rows = [(k, i, *x) for k, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for i, x in enumerate(parse(t))]
            kinds = (b.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [key, "ordinal", "block_type", "level", "text"])

    return df.select(key, column).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {BLOCKS}")


def layout_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of layout JSON (pages of items with type and text): path, page_index, ordinal, type and text."""
    schema = "array<array<struct<type:string,text:string,content:string,level:int>>>"
    pages = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("p"))
    items = pages.select("path", F.posexplode("p").alias("page_index", "items")).select("path", "page_index", F.posexplode_outer("items").alias("ordinal", "x"))
    return items.select("path", "page_index", "ordinal", "x.type", F.coalesce("x.text", "x.content").alias("text"))


def missing_pages(expected: DataFrame, parsed: DataFrame, by: str = "document_id") -> DataFrame:
    """Parsed pages (by, page_index, text) with the texts of expected pages that are missing, numbered anew from 0."""
    lost = expected.join(parsed.select(by, "page_index").distinct(), [by, "page_index"], "left_anti").where("trim(text) <> ''")
    both = parsed.select(by, "page_index", "text").unionByName(lost.select(by, "page_index", "text"))
    return both.withColumn("ordinal", F.row_number().over(W.partitionBy(by).orderBy("page_index", "text")) - 1)


def repeated_margins(pages: DataFrame, by: str = "document_id", least: int = 20) -> DataFrame:
    """Lines among the first or last two filled ones of a page that stand so on two or more pages of a document."""
    lines = F.filter(F.transform(F.split("text", "[\r\n]+"), lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))), lambda x: x != "")
    margins = pages.select(by, "page_index", lines.alias("_l")).select(by, "page_index", F.explode(F.array_distinct(F.concat(F.slice("_l", 1, 2), F.when(F.size("_l") >= 2, F.slice("_l", -2, 2)).otherwise(F.col("_l"))))).alias("line"))
    return margins.where(F.length("line") >= least).groupBy(by, "line").agg(F.count_distinct("page_index").alias("n_pages")).where("n_pages >= 2")


def reports(spark: SparkSession, path: str) -> DataFrame:
    """manifest.json files under a tree: path, modified, ok (whether they hold an object) and the text; newest first."""
    t = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").text(path)
    ok = F.coalesce(F.try_parse_json("value").isNotNull() & F.startswith(F.trim("value"), F.lit("{")), F.lit(False))
    return t.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), ok.alias("ok"), "value").orderBy(F.desc("modified"), "path")


def attachments(texts: DataFrame) -> DataFrame:
    """Texts attached to sessions (session_id, attachment_id, text) as chunks: paragraphs stay as they are in one chunk, NUL
    characters go, blank texts have none. Adds ordinal and token_estimate."""
    t = texts.withColumn("text", F.replace(F.coalesce("text", F.lit("")), F.lit("\u0000"), F.lit(""))).where(F.trim("text") != "")
    return t.withColumn("ordinal", F.lit(0)).withColumn("token_estimate", T.token_estimate(F.col("text")))
