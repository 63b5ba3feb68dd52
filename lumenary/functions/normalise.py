"""Normalisation that needs an exact order of rules; batches of texts in Python."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

LATEX = re.compile(r"\\(?:mathrm|mathbf|mathit|text|textbf|operatorname|rm)\s*\{([^{}]*)\}")
#: Braces of a subscript or superscript, which may stand within a wrapper's.
SCRIPT = re.compile(r"([_^])\{([^{}]*)\}")


def table_cell(text: str | None) -> str:
    """A cell as OCR or LaTeX left it, in plain form: wrappers stripped, signs named, digits that came apart put together."""
    t = text or ""
    while (n := LATEX.sub(r"\1", SCRIPT.sub(r"\1\2", t))) != t:
        t = n
    for a, b in ((r"\pm", "±"), (r"\times", "×"), (r"\%", "%"), (r"\cdot", "·"), ("$", ""), ("{", ""), ("}", "")):
        t = t.replace(a, b)
    t = re.sub(r"(\d)\s+\.\s+(\d)", r"\1.\2", t)
    t = re.sub(r"(\d)\s+\.(\d)|(\d)\.\s+(\d)", lambda m: f"{m[1] or m[3]}.{m[2] or m[4]}", t)
    return " ".join(t.split())


def match_text(text: str | None) -> str:
    """For matching across layouts: NFKC, soft hyphens gone, words that a line's end broke put together, blanks single."""
    t = unicodedata.normalize("NFKC", (text or "").replace("\u00ad", ""))
    t = re.sub(r"(?<=[a-z])-\s*\n\s*(?=[a-z])", "", t)
    return " ".join(t.split()).casefold()


#: What becomes something else than itself in small letters: a hyphen at a line's end before a word, soft hyphens, white space.
SPECIAL = re.compile(r"-\s*\r?\n\s*(?=\w)|\xad|\s+|[^\s\xad-]+|-")


def match_offsets(text: str | None, ignored: list[tuple[int, int]] = ()) -> tuple[str, list[int]]:
    """A text for matching, and for each of its signs the place in the source that it comes from.

    Signs are folded by NFKC and case, one at a time, so that one of the source may become several; words that a line's end
    broke are put together, soft hyphens vanish, white space is a single blank, none at the ends. ``ignored`` spans of the
    source (repeated margins) are passed over. Places never fall.
    """
    t, out, places = text or "", [], []
    at, spans = 0, sorted(ignored)
    gaps = [(0, 0), *spans, (len(t), len(t))]
    for (_, begin), (end, _) in zip(gaps, gaps[1:], strict=False):
        at = max(at, begin)
        while at < end:
            m = SPECIAL.match(t, at)
            stop = min(m.end(), end)
            run = t[at:stop]
            if run.isspace():
                if out and out[-1] != " ":
                    out.append(" ")
                    places.append(at)
            elif run[0] == "-" and len(m.group()) > 1 and at and t[at - 1].isalnum():
                stop = m.end()
            elif run[0] == "-" and len(run) > 1:
                out.append("-")
                places.append(at)
                stop = at + 1
            elif run != "\xad":
                if run.isascii():
                    out.extend(run.lower())
                    places.extend(range(at, stop))
                else:
                    for i, c in enumerate(run, at):
                        folded = unicodedata.normalize("NFKC", c).casefold()
                        out.extend(folded)
                        places.extend([i] * len(folded))
            at = stop
    while out and out[-1] == " ":
        out.pop()
        places.pop()
    return "".join(out), places


def source_span(text: str | None, needle: str | None, ignored: list[tuple[int, int]] = ()) -> tuple[int, int] | None:
    """Where a needle stands in a text when both are read for matching: the source's span from its first sign to its last."""
    whole, places = match_offsets(text, ignored)
    wanted = match_offsets(needle)[0]
    at = whole.find(wanted) if wanted else -1
    return None if at < 0 else (places[at], places[at + len(wanted) - 1] + 1)


@F.pandas_udf(StructType([StructField("begin", IntegerType()), StructField("end", IntegerType())]))
def source_spans(texts: pd.Series, needles: pd.Series) -> pd.DataFrame:
    found = [source_span(t, n) for t, n in zip(texts, needles, strict=True)]
    return pd.DataFrame({"begin": pd.array([f and f[0] for f in found], "Int32"), "end": pd.array([f and f[1] for f in found], "Int32")})


@F.pandas_udf(StringType())
def table_cells(s: pd.Series) -> pd.Series:
    return s.map(table_cell)


#: Texts of a batch that are held as Python's own at once.
SLICE = 128


@F.arrow_udf(StringType())
def match_texts(texts: pa.Array) -> pa.Array:
    return pa.chunked_array([pa.array(map(match_text, texts[at : at + SLICE].to_pylist()), pa.string()) for at in range(0, len(texts), SLICE)], pa.string()).combine_chunks()
