"""Chunks of tables, figures and formulas, and the matching of tables with their repaired versions."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunking import count_tokens, windows

CHUNKS = "chunk_role string, ordinal int, rows array<int>, columns array<int>, begin int, end int, text string"


def _line(cells: list[str]) -> str:
    return "| " + " | ".join(c or "" for c in cells) + " |"


def table_text(caption: str | None, headers: list[str], rows: list[list[str]], notes: list[str]) -> str:
    body = [_line(headers), "|" + "---|" * len(headers), *map(_line, rows)]
    return "\n".join([*([caption] if caption else []), *body, *notes])


def row_groups(rows: list[list[str]]) -> list[list[int]]:
    """Consecutive rows of one label; a blank label goes with the one above."""
    out: list[list[int]] = []
    last = None
    for i, r in enumerate(rows):
        label = (r[0] or "").strip() if r else ""
        if out and (not label or label == last):
            out[-1].append(i)
        else:
            out.append([i])
        last = label or last
    return out


def note_mark(note: str) -> str:
    """What a footnote is called by: its first sign or two before a blank; empty without one."""
    m = re.match(r"\s*(\S{1,2})[\s:.)]", note)
    return m.group(1) if m else ""


def table_chunks(caption: str | None, headers: list[str], rows: list[list[str]], notes: list[str], most: int, count: Callable[[str], int] = count_tokens) -> list[tuple]:
    """A table's chunks: its parent, the whole of it, and children of at most ``most`` tokens. Children are groups of rows; a
    group that is too long is cut between rows, a row between columns, and a cell into windows that tile it. Footnotes go with
    the rows that have their mark, as far as they fit; the others are children of their own, cut in the same way."""
    out: list[tuple] = [("parent", 0, list(range(len(rows))), list(range(len(headers))), None, None, table_text(caption, headers, rows, notes))]
    said: set[int] = set()

    def child(some: list[int], columns: list[int], text: str, begin: int | None = None, end: int | None = None):
        out.append(("child", len(out) - 1, some, columns, begin, end, text))

    def of(some: list[int], columns: list[int]) -> str:
        pick = lambda r: [r[c] if c < len(r) else "" for c in columns]
        return table_text(caption, pick(headers), [pick(rows[i]) for i in some], [])

    every = list(range(len(headers)))
    for g in row_groups(rows):
        part: list[int] = []
        for i in [*g, None]:
            if i is not None and count(of([*part, i], every)) <= most:
                part.append(i)
                continue
            if part:
                text = of(part, every)
                for k, n in enumerate(notes):
                    mark = note_mark(n)
                    if mark and any(mark in (c or "") for r in part for c in rows[r]) and count(f"{text}\n{n}") <= most:
                        text, _ = f"{text}\n{n}", said.add(k)
                child(part, every, text)
            part = []
            if i is None:
                break
            if count(of([i], every)) <= most:
                part = [i]
                continue
            columns: list[int] = []
            for c in [*every, None]:  # a row that is too long: by columns
                if c is not None and count(of([i], [*columns, c])) <= most:
                    columns.append(c)
                    continue
                if columns:
                    child([i], columns, of([i], columns))
                columns = []
                if c is None:
                    break
                if count(of([i], [c])) <= most:
                    columns = [c]
                    continue
                cell = rows[i][c] if c < len(rows[i]) else ""
                for a, b in windows(cell or "", max(1, most - count(f"{headers[c]}: ")), count):
                    child([i], [c], f"{headers[c]}: {cell[a:b]}", a, b)
    for k, n in enumerate(notes):
        if k not in said:
            for a, b in windows(n, most, count):
                child([], [], n[a:b], a, b)
    return out


def chunk_tables(tables: DataFrame, most: int = 600) -> DataFrame:
    """table_id and the columns of CHUNKS, for tables (table_id, caption, headers, rows, notes)."""

    def run(batches):
        for b in batches:
            got = [(r["table_id"], *c) for r in b.to_pylist() for c in table_chunks(r["caption"], r["headers"] or [], r["rows"] or [], r["notes"] or [], most)]
            kinds = (b.schema.field(0).type, pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate(kinds)], ["table_id", "chunk_role", "ordinal", "rows", "columns", "begin", "end", "text"])

    return tables.select("table_id", "caption", "headers", "rows", "notes").mapInArrow(run, f"table_id {tables.schema['table_id'].dataType.simpleString()}, {CHUNKS}")


def figure_chunks(caption: str | None, asset: str | None, description: str | None, nearby: list[str], most: int, count: Callable[[str], int] = count_tokens) -> list[tuple[str, int, int | None, int | None, str]]:
    """A figure's (or formula's) parent and its children: windows that tile its description, each with caption, asset and, where
    the parent fits, the paragraphs nearby. Without a description the parent's text is cut."""
    frame = [x for x in (caption, f"![]({asset})" if asset else None) if x]
    parent = "\n\n".join(dict.fromkeys([*frame, *([description] if description else []), *nearby]))
    around = nearby if count(parent) <= most else []
    wrap = (lambda x: "\n\n".join(dict.fromkeys([*frame, x, *around]))) if description else (lambda x: x)
    payload = description or parent
    room = max(1, most - (count(wrap("")) if description else 0))
    return [("parent", 0, None, None, parent), *[("child", i, a, b, wrap(payload[a:b])) for i, (a, b) in enumerate(windows(payload, room, count))]]


def overlap(a: tuple[float, float, float, float] | None, b: tuple[float, float, float, float] | None) -> float:
    """Intersection of two boxes (left, top, right, bottom) by their union."""
    if not a or not b:
        return 0.0
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    area = lambda x: max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1])
    union = area(a) + area(b) - both
    return both / union if union > 0 else 0.0


#: From which overlap on two boxes are one place.
SAME_BOX = 0.8
INVENTORY = "document_id long, side string, table_id string, region_id string, box array<double>, block_id string"


def match_inventory(originals: list[dict], repaired: list[dict]) -> list[tuple[str, str, str]] | None:
    """Each original table with its repaired version and what tells it: the region's id, else the box, else the block's id. All
    originals must find one, and there must be no second way to match them; else there is no answer."""
    edges: list[dict[int, str]] = []
    for o in originals:
        ways = (
            ("source_region_id", lambda r, o=o: o["region_id"] is not None and r["region_id"] == o["region_id"]),
            ("normalized_bbox", lambda r, o=o: overlap(o["box"], r["box"]) >= SAME_BOX),
            ("source_block_id", lambda r, o=o: o["block_id"] is not None and r["block_id"] == o["block_id"]),
        )
        edges.append(next((found for name, same in ways if (found := {j: name for j, r in enumerate(repaired) if same(r)})), {}))
    taken: dict[int, int] = {}

    def place(i: int, tried: set[int], barred: tuple[int, int] | None = None) -> bool:
        for j in edges[i]:
            if j in tried or (i, j) == barred:
                continue
            tried.add(j)
            if j not in taken or place(taken[j], tried, barred):
                taken[j] = i
                return True
        return False

    if not all(place(i, set()) for i in range(len(originals))):
        return None
    chosen = {i: j for j, i in taken.items()}
    for i, j in chosen.items():  # unique: without any one of its edges, the same repaired tables can't all be matched again
        kept, swapped = dict(taken), False
        del taken[j]
        if place(i, set(), (i, j)):
            swapped = set(taken) == set(kept)
        taken.clear()
        taken.update(kept)
        if swapped:
            return None
    return [(originals[i]["table_id"], repaired[j]["table_id"], edges[i][j]) for i, j in sorted(chosen.items())]


def match_inventories(tables: DataFrame) -> DataFrame:
    """document_id, original, repaired and basis, from the tables (INVENTORY; side is original or repaired) of documents; a
    document whose tables can't be matched, or in several ways, has none. Sequential within a document, whose tables are few."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
        sides = [sorted((r for r in rows if r["side"] == s), key=lambda r: r["table_id"]) for s in ("original", "repaired")]
        for r in rows:
            r["box"] = None if r["box"] is None else tuple(r["box"])
        found = match_inventory(*sides) or []
        return pd.DataFrame([(pdf["document_id"].iloc[0], *x) for x in found], columns=["document_id", "original", "repaired", "basis"])

    return tables.groupBy("document_id").applyInPandas(run, "document_id long, original string, repaired string, basis string")
