"""Tables put together from their chunks, with headers of several rows, and the cells that answer a question.

Assembling a table is sequential and bounded by it. Selecting goes over all pairs of a question and a table as expressions of one
row: which columns and rows are taken falls back from what the question names exactly to all there is.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: What a question in Chinese may call rows of tables in English (fixed values).
ALIASES = {
    "偶极矩": ["mu", "dipole"], "表面张力": ["surface", "tension", "gamma"], "焓": ["enthalpy", "hvap", "vap"], "水化": ["hydration", "hfe"], "结合": ["binding", "hfe"],
    "误差": ["rmse", "error"], "角度": ["theta", "angle", "torsion"], "实验": ["exp", "exptl"], "半径": ["radius", "rg"], "热容": ["heat", "capacity"],
}
#: Words that select no column by themselves, and headers that hold rows' names where a number comes first (fixed values).
GENERIC = ["alpha", "group", "groups", "metric", "metrics", "model", "models", "number", "numbers", "objective", "objectives", "pair", "pairs", "param", "parameter", "parameters", "params", "row", "rows", "solving", "structure", "structures", "table", "tables", "value", "values"]
LABELS = ["Model", "Variant", "Method", "Approach", "System", "Dataset", "Name"]

NUMBER = re.compile(r"[-+]?\d+(?:\.\d+)?%?")


def key(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", "".join(T.GREEK.get(c, c) for c in (text or "").lower()))


def numeric(cell: str) -> bool:
    """Whether a cell holds numbers only, with signs apart and uncertainties allowed."""
    parts = re.sub(r"\s*(±|\+/-)\s*", " ", cell).split()
    joined = re.sub(r"(^| )([+-]) (?=\d)", r"\1", " ".join(parts)).split()
    return bool(joined) and all(NUMBER.fullmatch(p) for p in joined)


def cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def header_role(header: list[str], row: list[str], numbers: set[int]) -> str | None:
    """What a row of words under a header is: ``compose``, a second level of it; ``drop``, another name for it; None, data.

    It must be as wide, have two filled cells and no number, and repeat the header's first cell or leave it empty. It is a
    second level if it tells apart a repeated group, or fills an empty header and also renames a column, repeats a group
    of its own, or has numbers below. It is another name if each column that it renames has numbers below.
    """
    filled = [c for c in row if c]
    if len(header) != len(row) or len(filled) < 2 or any(map(numeric, filled)):
        return None
    top, low = [key(c) for c in header], [key(c) for c in row]
    if top[0] and low[0] and top[0] != low[0]:
        return None
    rest = range(1, len(row))
    fills = [i for i in rest if row[i] and not header[i]]
    renames = [i for i in rest if row[i] and header[i] and low[i] != top[i]]
    if any(top[i] == top[i - 1] for i in renames):
        return "compose"
    if fills:
        groups = any(row[i] and row[i - 1] and low[i] == low[i - 1] for i in rest)
        return "compose" if renames or groups or numbers & set(fills) else None
    return "drop" if renames and numbers >= set(renames) else None


def composed(header: list[str], row: list[str]) -> list[str]:
    """Both levels as one: a group's name goes over the columns that leave it empty."""
    out, group = [], ""
    for top, low in zip(header, row, strict=True):
        group = top or group
        out.append(top if not low else f"{group} {low}" if group and key(group) != key(low) else group or low)
    return out


def distinct(headers: list[str]) -> list[str]:
    """Repeated names get their number."""
    seen: dict[str, int] = {}
    out = []
    for h in headers:
        seen[h] = seen.get(h, 0) + 1
        out.append(f"{h} {seen[h]}" if h and seen[h] > 1 else h)
    return out


def table_of(texts: list[tuple[str, str]]) -> dict:
    """A table from its chunks' (id, text) in order."""
    caption, lines = None, []
    for chunk, text in texts:
        for line in map(str.strip, (text or "").splitlines()):
            if line.startswith("|") and "|" in line[1:]:
                lines.append((cells(line), chunk))
            elif line and caption is None:
                caption = line
    rule = lambda row: all(re.fullmatch(r":?-{3,}:?", c or "---") for c in row)
    line_key = lambda row: key("".join(row))
    out = {"caption": caption, "headers": [], "rows": [], "labels": [], "label_columns": [], "row_chunks": [], "flags": []}
    if not lines:
        return out | {"flags": ["no_table_rows"]}
    header = next((row for row, _ in lines if not rule(row)), lines[0][0])
    data = [(row, chunk) for row, chunk in lines if not rule(row) and line_key(row) not in ("", line_key(header))]
    numbers = {i for row, _ in data for i, c in enumerate(row) if numeric(c)}
    while found := next(((row, role) for row, _ in data if (role := header_role(header, row, numbers))), None):
        header = composed(header, found[0]) if found[1] == "compose" else header
        data = [(row, chunk) for row, chunk in data if line_key(row) != line_key(found[0])]
        out["flags"] = ["header_like_data_row"]
    width = len(header)
    rows = [(row + [""] * width)[:width] for row, _ in data]
    value = {i for row in rows for i, c in enumerate(row) if numeric(c)}
    lead = next((i for i in range(width) if i in value), width)
    labels = list(range(lead)) or next(([i] for name in LABELS for i in range(width) if i not in value and key(header[i]) == key(name)), [0])
    named, last = [], dict.fromkeys(labels, "")
    for row in rows:
        last |= {i: row[i] for i in labels if row[i]}
        named.append(" / ".join(x for i in labels if (x := last[i])) or next((c for c in row if c and not numeric(c)), ""))
    return out | {"headers": distinct(header), "rows": rows, "labels": named, "label_columns": labels, "row_chunks": [chunk for _, chunk in data], "flags": out["flags"] + ([] if rows else ["no_data_rows"])}


SCHEMA = "document_id long, parse_version string, table_id string, caption string, headers array<string>, rows array<array<string>>, labels array<string>, label_columns array<int>, row_chunks array<string>, flags array<string>"


def assembled(chunks: DataFrame) -> DataFrame:
    """Whole tables of chunks (document_id, parse_version, table_id, ordinal, chunk_id, text): caption, headers of one level,
    rows as wide as they are, each row's label (parents' names filled down, levels joined by a slash), the columns that
    labels come from, each row's chunk, and what is odd about the table. Repeated headers and rules are dropped."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ordinal", "chunk_id"])
        first = pdf.iloc[0]
        made = table_of(list(zip(pdf["chunk_id"], pdf["text"], strict=True)))
        return pd.DataFrame([{"document_id": first["document_id"], "parse_version": first["parse_version"], "table_id": first["table_id"], **made}])

    return chunks.groupBy("document_id", "parse_version", "table_id").applyInPandas(run, SCHEMA)


def terms_of(question: Column) -> Column:
    """Keys that a question matches by: the whole of it, its words of two characters and more, and its aliases."""
    words = F.filter(F.regexp_extract_all(F.lower(question), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 2)
    return F.filter(F.array_distinct(F.concat(F.array(T.fact_key(question)), words, aliases_of(question))), lambda k: k != "")


def aliases_of(question: Column) -> Column:
    some = [F.when(F.contains(question, F.lit(k)), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in ALIASES.items()]
    return F.concat(*some)


def either(terms: Column, of: Column) -> Column:
    """Whether one of the terms is part of a key, or the key of a term."""
    return F.exists(terms, lambda t: F.contains(of, t) | F.contains(t, of))


def selected(pairs: DataFrame) -> DataFrame:
    """Facts of pairs of a question and a table: ``pairs`` with row_index, row_label, column_name, value, chunk_id, and how the
    columns and rows were chosen.

    ``pairs`` have question and the columns of ``assembled``. Columns behind the labels' ones: those that share a telling word
    of three characters with the question (strong), else those that share any (weak), else all. Rows: those whose whole label
    stands in the question, and with them those that an alias of the question names (exact); else those that share a word
    (matched), else all. Empty cells and dashes are no facts; a pair without any yields no row.
    """
    columns = F.filter(F.transform("headers", lambda h, i: F.struct(i.alias("i"), h.alias("name"), T.fact_key(h).alias("key"))), lambda c: (c["key"] != "") & ~F.array_contains("label_columns", c["i"]))
    rows = F.transform("labels", lambda x, i: F.struct(i.alias("i"), x.alias("name"), T.fact_key(x).alias("key")))
    p = pairs.select(F.struct(*pairs.columns).alias("_p"), F.coalesce("question", F.lit("")).alias("_q"), columns.alias("_columns"), rows.alias("_rows"))
    p = p.select("*", T.fact_key(F.col("_q")).alias("_key"), terms_of(F.col("_q")).alias("_terms"), aliases_of(F.col("_q")).alias("_aliases"))
    telling = F.filter("_terms", lambda t: (F.length(t) >= 3) & ~t.isin(GENERIC))
    short = F.filter("_terms", lambda t: F.length(t) >= 2)
    p = p.withColumn("_telling", telling).withColumn("_short", short)
    p = p.withColumn("_strong", F.filter("_columns", lambda c: either(F.col("_telling"), c["key"]))).withColumn("_weak", F.filter("_columns", lambda c: F.contains("_key", c["key"]) | either(F.col("_short"), c["key"])))
    exact = F.filter("_rows", lambda r: (r["key"] != "") & F.contains("_key", r["key"]))
    matched = F.filter("_rows", lambda r: (r["key"] != "") & (F.contains("_key", r["key"]) | either(F.col("_terms"), r["key"])))
    p = p.withColumn("_exact", exact).withColumn("_matched", matched)
    named = F.filter("_matched", lambda r: F.array_contains("_exact", r) | either(F.col("_aliases"), r["key"]))
    chosen_rows = F.when(F.size("_exact") > 0, named).when(F.size("_matched") > 0, F.col("_matched")).otherwise(F.col("_rows"))
    chosen_columns = F.when(F.size("_strong") > 0, F.col("_strong")).when(F.size("_weak") > 0, F.col("_weak")).otherwise(F.col("_columns"))
    rows_by = F.when(F.size("_exact") > 0, "exact").when(F.size("_matched") > 0, "matched").otherwise("all")
    columns_by = F.when(F.size("_strong") > 0, "strong").when(F.size("_weak") > 0, "weak").otherwise("all")
    each = p.select("_p", rows_by.alias("rows_by"), columns_by.alias("columns_by"), F.explode(chosen_rows).alias("_r"), chosen_columns.alias("_c")).select("_p", "rows_by", "columns_by", "_r", F.explode("_c").alias("_c"))
    value = F.trim(F.get(F.get(F.col("_p.rows"), F.col("_r.i")), F.col("_c.i")))
    out = each.select("_p.*", F.col("_r.i").alias("row_index"), F.col("_r.name").alias("row_label"), F.col("_c.name").alias("column_name"), value.alias("value"), F.get(F.col("_p.row_chunks"), F.col("_r.i")).alias("chunk_id"), "rows_by", "columns_by")
    return out.where((F.coalesce("value", F.lit("")) != "") & ~F.col("value").rlike("^[-–—]+$")).drop("headers", "rows", "labels", "label_columns", "row_chunks", "flags", "caption")
