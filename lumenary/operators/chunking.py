"""Chunking: lossless sentences, semantic grouping, overlap, windows and simple packers."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Words whose full stop doesn't end a sentence, and such as may: there the next word decides (fixed values).
ABBREVIATIONS = {"fig", "figs", "eq", "eqs", "ref", "refs", "vs", "dr", "mr", "mrs", "prof", "no", "cf", "approx", "resp"}
MAY_END = {"etc", "al", "e.g", "i.e"}
END = re.compile(r"[.!?。！？]+[\"'”’)\]」』]*")


#: Texts of a batch that are held as Python's own at once, with what is made of them.
SLICE = 128


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut into some of few rows."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences, with the white space behind each; together they are the whole text."""
    out, begin = [], 0
    for m in END.finditer(text):
        at, sign = m.end(), text[m.start()]
        if sign == ".":
            word = re.search(r"[\w.]*$", text[max(0, m.start() - 20) : m.start()]).group()
            if at < len(text) and not text[at].isspace() or word.lower() in ABBREVIATIONS or re.fullmatch(r"[A-Z](\.[A-Z])*", word):
                continue
            after = text[at : at + 200].lstrip()
            if word.lower() in MAY_END and after and not (after[0].isupper() or "\u4e00" <= after[0] <= "\u9fff"):
                continue
        while at < len(text) and text[at].isspace():
            at += 1
        if at > begin:
            out.append((begin, at))
            begin = at
    if begin < len(text):
        out.append((begin, len(text)))
    return out


def count_tokens(text: str) -> int:
    return max(1, len(text) // 4)


def hashing_embedder(size: int = 32) -> Callable[[str], np.ndarray]:
    """A deterministic embedding for tests and plans without a model: signed counts of hashed words, unit length."""
    import xxhash

    def embed(text: str) -> np.ndarray:
        v = np.zeros(size)
        for w in re.findall(r"\w+", text.lower()):
            h = xxhash.xxh32_intdigest(w)
            v[h % size] += 1 if h & 0x8000 else -1
        n = np.linalg.norm(v)
        return v / n if n else v

    return embed


def group(parts: list[str], target: int, most: int, percentile: int = 20, embed=None, count=count_tokens, least: int = 0) -> list[tuple[int, int]]:
    """Ranges of consecutive parts of at most ``most`` tokens each. Of the boundaries beyond ``target`` that still fit, the
    earliest among those of lowest similarity is taken; a part that is too long stands alone. A last range of fewer than
    ``least`` tokens joins the one before it or takes parts of it, if the limits allow."""
    if not parts:
        return []
    embed = embed or hashing_embedder()
    sizes = np.array([count(p) for p in parts])
    total = np.concatenate([[0], np.cumsum(sizes)])
    size = lambda a, z: count("".join(parts[a:z]))
    vectors = [embed(p) for p in parts]
    near = [float(a @ b) for a, b in zip(vectors, vectors[1:], strict=False)]
    out, at = [], 0
    while at < len(parts):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        while stop > at + 1 and size(at, stop) > most:  # parts' tokens may be fewer than those of the parts together
            stop -= 1
        if stop >= len(parts):
            out.append((at, len(parts)))
            break
        choices = [i for i in range(at + 1, stop + 1) if total[i] - total[at] >= target] or [stop]
        lowest = sorted(choices, key=lambda i: (near[i - 1], i))[: math.ceil(len(choices) * percentile / 100)]
        cut = min(lowest)
        out.append((at, cut))
        at = cut
    return rebalanced(out, size, least, most)


def rebalanced(ranges: list[tuple[int, int]], size: Callable[[int, int], int], least: int, most: int) -> list[tuple[int, int]]:
    """The last range merged or filled up; ``size`` has the tokens of a range of parts."""
    if len(ranges) < 2 or size(*ranges[-1]) >= least:
        return ranges
    (a, cut), (_, z) = ranges[-2:]
    if size(a, z) <= most:
        return [*ranges[:-2], (a, z)]
    if size(a, cut) > most:
        return ranges
    while size(cut, z) < least and cut - a > 1:
        cut -= 1
    fits = least <= size(cut, z) <= most and size(a, cut) >= least
    return [*ranges[:-2], (a, cut), (cut, z)] if fits else ranges


def windows(text: str, most: int, count=count_tokens) -> list[tuple[int, int]]:
    """Spans that tile a text that is too long, each of at most ``most`` tokens (one code point at least)."""
    out, at = [], 0
    while at < len(text):
        lo, hi = at + 1, len(text)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if count(text[at:mid]) <= most:
                lo = mid
            else:
                hi = mid - 1
        out.append((at, lo))
        at = lo
    return out


def chunk(text: str | None, target: int = 400, most: int = 600, overlap: int = 50, percentile: int = 20, least: int = 180) -> list[tuple[int, int, str]]:
    """Begin, end and text of a document's chunks. Spans tile the text; the text of a chunk also has the last whole
    sentences of the one before it, up to ``overlap`` tokens, if they fit."""
    spans = [(a + x, a + y) for a, b in sentences(text or "") for x, y in (windows(text[a:b], most) if count_tokens(text[a:b]) > most else [(0, b - a)])]
    out: list[tuple[int, int, str]] = []
    groups = group([text[a:b] for a, b in spans], target, most, percentile, least=min(least, target))
    for i, (lo, hi) in enumerate(groups):
        begin, end, lead = spans[lo][0], spans[hi - 1][1], spans[lo][0]
        if i:
            for a, _ in reversed(spans[groups[i - 1][0] : lo]):
                if count_tokens(text[a:begin]) > overlap or count_tokens(text[a:end]) > most:
                    break
                lead = a
        out.append((begin, end, text[lead:end]))
    return out


#: Limits of parents and of the children in them: least, target and most tokens (fixed values).
PARENT, CHILD = (500, 1200, 1800), (180, 400, 600)


def family(text: str | None, parent: tuple[int, int, int] = PARENT, child: tuple[int, int, int] = CHILD, overlap: int = 50) -> list[tuple[int, int, int, int, str]]:
    """A document's parents and their children: the parent's number, the child's in it (-1 for the parent itself), begin, end and
    text. Parents tile the text, the children of each tile it, and a child's text leads in with sentences of the same parent."""
    out = []
    for i, (a, b, _) in enumerate(chunk(text, parent[1], parent[2], 0, least=parent[0])):
        out.append((i, -1, a, b, text[a:b]))
        out += [(i, k, a + x, a + y, t) for k, (x, y, t) in enumerate(chunk(text[a:b], child[1], child[2], overlap, least=child[0]))]
    return out


def families(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each parent and child: key, parent, child (-1: the parent itself), begin, end, text."""

    def run(batches):
        for b in slices(batches):
            rows = [(k, *c) for k, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for c in family(t)]
            kinds = (b.schema.field(0).type, *[pa.int32()] * 4, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [key, "parent", "child", "begin", "end", "text"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, parent int, child int, begin int, end int, text string")


def chunks(df: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """A row for each chunk: key, ordinal, begin, end, text. Null and empty texts have none."""

    def run(batches):
        for b in slices(batches):
            rows = [(k, i, *c) for k, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for i, c in enumerate(chunk(t, **limits))]
            kinds = (b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [key, "ordinal", "begin", "end", "text"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, ordinal int, begin int, end int, text string")


PLAIN_SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]?")


def pack(parts: list[str], most: int) -> list[str]:
    """``functions.text.packed_snippets`` in one pass over the parts."""
    out: list[list[str]] = []
    size = 0
    for p in parts:
        if out and size + 1 + len(p) <= most:
            out[-1].append(p)
            size += 1 + len(p)
        else:
            out.append([p])
            size = len(p)
    return [" ".join(x) for x in out]


def snippets(df: DataFrame, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each snippet: key, ordinal, snippet. Texts of any length; the array fold of ``packed_snippets`` copies all
    snippets for each sentence. Null and blank texts have none."""

    def run(batches):
        for b in slices(batches):
            for k, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = pack([x for m in PLAIN_SENTENCE.findall(t or "") if (x := m.strip(" "))], most)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(got), b.schema.field(0).type), pa.array(range(len(got)), pa.int32()), pa.array(got, pa.string())], [key, "ordinal", "snippet"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, ordinal int, snippet string")


def required_slots(df: DataFrame, schema: str, limit: int, kinds: tuple[str, ...] = ("table", "figure", "formula")) -> DataFrame:
    """The first ``limit`` rows of each query (query_id, rank, kind), of which the first of each of ``kinds`` survives in
    the place of the last rows of no such kind. Sequential over a query's few ranked rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        must = [i for k in kinds for i in pdf.index[pdf["kind"] == k][:1]][:limit]
        rest = [i for i in pdf.index if i not in must][: limit - len(must)]
        return pdf.loc[sorted([*must, *rest], key=lambda i: pdf.at[i, "rank"])]

    return df.groupBy("query_id").applyInPandas(run, schema)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each sign of ``b``: one addition of long integers for each sign of
    ``a``, in place of a row of the table."""
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    every = (1 << len(b)) - 1
    row = every
    for c in a:
        met = row & at.get(c, 0)
        row = ((row + met) | (row - met)) & every
    return len(b) - row.bit_count()


def copied_share(a: str, b: str, least: int = 8) -> float:
    """Length of the longest common subsequence of two texts by the length of ``b``; 0 where it is shorter than ``least``."""
    n = common_subsequence(a, b)
    return n / len(b) if n >= least and b else 0.0


#: The share of a child that a prefix may not have in order, and the least signs (fixed values).
COPIED, COPIED_LEAST = 0.75, 8


def copies_most(prefix: str, child: str) -> bool:
    """Whether a prefix has three quarters of a child's signs, eight at least, in order. One that is too short isn't compared."""
    if len(child) < COPIED_LEAST or min(len(child), len(prefix)) / len(child) < COPIED:
        return False
    return copied_share(prefix, child, COPIED_LEAST) >= COPIED


@F.pandas_udf(BooleanType())
def copied_children(prefixes: pd.Series, children: pd.Series) -> pd.Series:
    return pd.Series([copies_most(p or "", c or "") for p, c in zip(prefixes, children, strict=True)], dtype="boolean")
