"""Evidence packs: what retrieval found becomes what an answer is written from.

Stages over all questions at once: versions are checked again and hits get their parents' and neighbours' text; a pack's order,
reservations, deduplication, caps and slots are windows; the last step, fitting a pack into a token budget with what was
chosen before, goes question by question over the few pieces that are left.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from .retrieval import CANONICAL_TABLES, CONTEXTS

#: Token budgets of a draft and of a piece's neighbours, parents shown in full, tables with a reserved piece, pieces a page,
#: and characters of a rescued window (fixed values).
BUDGET, NEIGHBOUR_BUDGET, PARENTS, RESERVED, PER_PAGE, RESCUED = 6000, 900, 6, 8, 5, 400
#: Kinds that keep a place in a pack that is cut (fixed values).
SLOTS = ["table", "figure", "formula", "profile-term"]
#: What a rescued window is laid around: shares, measured values and hyphenated terms. A domain adds its own.
PHRASES = (r"\b\d+(?:\.\d+)?\s*%", r"\b\d+(?:\.\d+)?\s*(?:kcal(?:\s*/\s*mol|\s+mol)?|milliseconds?|kT|K)\b", r"\b[a-z]+(?:-[a-z]+)+(?:\s+[a-z]+)?\b")


def checked(contexts: DataFrame, chunks: DataFrame, documents: DataFrame, shadow: DataFrame | None = None) -> DataFrame:
    """The contexts (query_id, chunk_id, score, kind) with their chunk's fields, without those of another version than the
    document's active one, or than ``shadow``'s (document_id, version) where it names one.

    Chunks of the legacy version, and contexts without a chunk, stay as they are; others must be children and no references.
    """
    found = contexts.join(chunks, "chunk_id", "left").join(documents.select("document_id", "active_parse_version"), "document_id", "left")
    if shadow is not None:
        found = found.join(shadow.select("document_id", F.col("version").alias("_shadow")), "document_id", "left").withColumn("active_parse_version", F.coalesce("_shadow", "active_parse_version")).drop("_shadow")
    legacy = F.col("parse_version").isNull() | (F.col("parse_version") == "legacy")
    current = F.col("parse_version").eqNullSafe(F.col("active_parse_version")) & F.col("chunk_role").eqNullSafe(F.lit("child")) & ~F.col("block_type").eqNullSafe(F.lit("reference"))
    return found.where(legacy | current).withColumn("legacy", legacy).drop("active_parse_version")


def expanded(contexts: DataFrame, chunks: DataFrame, questions: DataFrame, tokens=T.token_estimate) -> DataFrame:
    """``checked`` contexts with prompt: the parent's text for prose (the chunk's own for tables, legacy chunks and chunks
    without a valid parent), the child where its parent doesn't hold it, and for questions about documents as a whole the
    neighbours that fit into NEIGHBOUR_BUDGET together, the previous one first.

    Parents and neighbours must be of the same document and version. All of them come by one join on their ids.
    """
    table = F.col("block_type").eqNullSafe(F.lit("table"))
    wide = questions.select("query_id", (C.is_overview(F.col("question")) | C.is_cross_paper(F.col("question"))).alias("_wide"))
    c = contexts.join(wide, "query_id", "left").withColumn("_wide", F.coalesce("_wide", F.lit(False)) & ~table & ~F.col("legacy"))
    needed = F.array(F.struct(F.lit("parent").alias("as"), F.col("parent_chunk_id").alias("id")), *[F.struct(F.lit(n).alias("as"), F.when(F.col("_wide"), F.col(f"{n}_chunk_id")).alias("id")) for n in ("previous", "next")])
    links = c.where(~F.col("legacy")).select("query_id", "chunk_id", "document_id", "parse_version", F.explode(needed).alias("_n")).where("_n.id IS NOT NULL")
    other = chunks.select(F.col("chunk_id").alias("_id"), F.col("document_id").alias("_d"), F.col("parse_version").alias("_v"), F.col("chunk_role").alias("_role"), F.col("block_type").alias("_block"), F.trim("text").alias("_text"))
    valid = (F.col("_d") == F.col("document_id")) & F.col("_v").eqNullSafe(F.col("parse_version"))
    valid = valid & F.when(F.col("_n.as") == "parent", F.col("_role") == "parent").otherwise((F.col("_role") == "child") & ~F.col("_block").eqNullSafe(F.lit("reference")))
    texts = links.join(other, F.col("_n.id") == F.col("_id")).where(valid).groupBy("query_id", "chunk_id").agg(*[F.max(F.when(F.col("_n.as") == n, F.col("_text"))).alias(f"_{n}") for n in ("parent", "previous", "next")])
    c = c.join(texts, ["query_id", "chunk_id"], "left")
    own = F.trim("text")
    body = F.coalesce(F.when(~table, F.col("_parent")), own)
    cost = lambda n: F.when(F.coalesce(F.col(n), F.lit("")) != "", tokens(F.col(n)))
    before = F.when(cost("_previous") <= NEIGHBOUR_BUDGET, F.col("_previous"))
    left = NEIGHBOUR_BUDGET - F.when(before.isNotNull(), cost("_previous")).otherwise(0)
    near = F.concat_ws("\n\n", before, F.when(cost("_next") <= left, F.col("_next")))
    parts = F.array(body, F.when((own != "") & ~table & ~F.contains(body, own), F.concat(F.lit("Matched child:\n"), own)), F.when(near != "", F.concat(F.lit("Neighbor context:\n"), near)))
    prompt = F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n\n")
    return c.withColumns({"prompt": F.when(F.col("legacy"), F.col("text")).otherwise(prompt), "excerpt": F.col("text")}).drop("_wide", "_parent", "_previous", "_next")


def structure(kind: Column, text: Column, question: Column, table_query: Column) -> Column:
    """What the first key of a pack's order counts: figures that are named 4, formulas that are asked for 4, tables that are
    named 3, other tables 2 (fixed values). Questions that ask for no table or metric only lift formulas."""
    named = lambda start: F.exists(C.figure_table_anchors(question), lambda a: F.lower(a).startswith(start) & F.contains(F.lower(text), F.lower(a)))
    formula = (kind == "formula") & C.is_formula(question)
    tables = F.when((kind == "figure") & named("fig"), 4).when(formula, 4).when((kind == "table") & named("table"), 3).when(kind == "table", 2).otherwise(0)
    return F.when(table_query, tables).when(formula, 4).otherwise(0)


def relevance(text: Column, question: Column) -> Column:
    """100 for each figure or table that the question names and the text has, 3 for each of its table terms (fixed values)."""
    key = T.lookup_key(text)
    found = lambda terms: F.size(F.filter(terms, lambda a: (T.lookup_key(a) != "") & F.contains(key, T.lookup_key(a))))
    return (100.0 * found(C.figure_table_anchors(question)) + 3.0 * found(C.table_terms(question))).cast("double")


def finalised(contexts: DataFrame, questions: DataFrame) -> DataFrame:
    """The pack of each question: query_id, position (from 1) and the contexts' columns.

    ``contexts`` have query_id, chunk_id, document_id, parse_version, table_id, block_type, kind, page (may be null), label, text,
    score, and anchors (names of things that a profile's term proves, empty for others). Order: structure, relevance, tables,
    score, chunk_id. For questions about tables, of which two or more match, each matching table's best child comes first, up
    to RESERVED. A repeated excerpt (for tables: chunk) of a page is dropped, then pieces beyond a page's PER_PAGE (no bound
    for profile terms; the limit for questions about tables). Where more are left than the limit, profile terms that prove
    something first come first, the first of each kind of SLOTS keeps a place, and others fill up in order. All of it is
    windows: a greedy choice that skips while required pieces need the open places takes the required ones and the first
    of the others, as many as places are left.
    """
    q = F.col("question")
    asked = questions.select("query_id", "question", (C.is_table(q) | C.is_metric(q)).alias("_tq"))
    c = contexts.join(asked, "query_id")
    of = W.partitionBy("query_id")
    is_table = F.col("kind") == "table"
    modern = is_table & F.col("parse_version").isNotNull() & (F.col("parse_version") != "legacy")
    c = c.withColumn("_canonical", F.col("_tq") & F.coalesce(F.max(modern).over(of), F.lit(False)))
    c = c.withColumn("_limit", F.when(F.col("_canonical"), CANONICAL_TABLES).otherwise(CONTEXTS))
    c = c.withColumn("_rel", F.when(F.col("_tq"), relevance(F.col("text"), q)).otherwise(0.0)).withColumn("_str", structure(F.col("kind"), F.col("text"), q, F.col("_tq")))
    order = [F.desc("_str"), F.desc("_rel"), F.desc(F.when(F.col("_tq") & is_table, 1).otherwise(0)), F.desc("score"), F.col("chunk_id")]
    c = c.withColumn("_o", F.row_number().over(of.orderBy(*order)))

    # A place in front for the best child of each of several matching tables.
    group = W.partitionBy("query_id", "document_id", "parse_version", "table_id")
    member = F.col("_tq") & F.col("block_type").eqNullSafe(F.lit("table")) & F.col("table_id").isNotNull()
    c = c.withColumn("_group", F.when(member, F.max(F.when(member, F.col("_rel"))).over(group)))
    c = c.withColumn("_rep", member & (F.col("_group") > 0) & (F.row_number().over(group.orderBy(F.desc(F.when(member, F.col("_rel"))), F.desc("score"), "chunk_id")) == 1))
    c = c.withColumn("_reps", F.count_if("_rep").over(of)).withColumn("_turn", F.row_number().over(of.orderBy(F.desc("_rep"), F.desc("_group"), F.desc("score"), "chunk_id")))
    first = F.col("_rep") & (F.col("_reps") >= 2) & (F.col("_turn") <= F.least(F.lit(RESERVED), F.col("_limit")))
    c = c.withColumn("_o", F.row_number().over(of.orderBy(F.desc(first), F.when(first, F.col("_turn")), "_o")))

    # Repeated excerpts, then pages.
    squeezed = F.substring(F.regexp_replace(F.trim("text"), r"\s+", " "), 1, 180)
    where = F.coalesce(F.col("page"), F.col("document_id").cast("string"))
    key = F.struct(where.alias("w"), F.col("label").alias("l"), is_table.alias("t"), F.when(is_table, F.col("chunk_id")).otherwise(squeezed).alias("x"))
    profile = F.col("kind") == "profile-term"
    repeated = W.partitionBy("query_id", "_key").orderBy("_o")
    c = c.withColumn("_key", key).withColumn("_first", (F.row_number().over(repeated) == 1).cast("int"))
    before = F.sum("_first").over(W.partitionBy("query_id", "page").orderBy("_o")) - F.col("_first")
    # What a full page doesn't take can't make a later profile term of the page a repetition.
    c = c.withColumn("_n", before).where(F.col("page").isNull() | profile | (F.col("_n") < F.when(F.col("_tq"), F.col("_limit")).otherwise(PER_PAGE)))
    c = c.withColumn("_n", F.row_number().over(repeated)).where("_n = 1")

    # Slots. A profile term counts in front if it proves something that none before it, in their own order, proves.
    c = c.withColumn("_total", F.count("*").over(of))
    c = c.withColumn("_p", F.when(profile & ~F.col("_canonical"), F.row_number().over(of.orderBy(F.desc(profile), F.desc("score"), "_o"))))
    seen = c.where("_p IS NOT NULL").select("query_id", "_p", F.explode("anchors").alias("_a")).groupBy("query_id", "_a").agg(F.min("_p").alias("_p")).select("query_id", "_p").distinct()
    c = c.join(seen.withColumn("_new", F.lit(True)), ["query_id", "_p"], "left").withColumn("_new", F.coalesce("_new", F.lit(False)) & (F.col("_total") > F.col("_limit")))
    kind_first = F.row_number().over(W.partitionBy("query_id", "kind").orderBy("_o")) == 1
    required = (F.col("kind").isin(SLOTS) & kind_first & ~(profile & F.col("_canonical"))) | F.col("_new")
    c = c.withColumn("_req", required).withColumn("_rank", F.row_number().over(of.orderBy(F.desc("_new"), F.desc("_req"), F.when(F.col("_new"), F.col("_p")), "_o")))
    c = c.where((F.col("_total") <= F.col("_limit")) | (F.col("_rank") <= F.col("_limit")))
    position = F.row_number().over(of.orderBy(F.desc("_new"), F.when(F.col("_new"), F.col("_p")), "_o"))
    return c.withColumn("position", position).select("query_id", "position", *[x for x in contexts.columns if x != "query_id"])


def without_overlap(text: str, before: list[str]) -> str:
    """``text`` without its longest beginning that an earlier one ends in: three words or eight characters at least, and never
    all of it."""
    now = (text or "").strip()
    words, best = now.split(), ""
    for prior in before:
        prior = (prior or "").strip()
        ends = prior.split()
        found = ""
        if len(words) >= 4 and len(ends) >= 3:
            found = next((x for n in range(min(len(words) - 1, len(ends)), 2, -1) if words[:n] == ends[-n:] and (x := " ".join(words[:n]))), "")
        elif prior:
            found = next((now[:n] for n in range(min(len(now) - 1, len(prior)), 7, -1) if prior.endswith(now[:n])), "")
        best = max(best, found, key=len)
    return now[len(best) :].lstrip() if best and len(best) < len(now) and now.startswith(best) else now


def rescued(text: str, question: str, phrases: tuple[str, ...] = PHRASES, width: int = RESCUED) -> str:
    """The window round the first phrase of ``text`` that shares a word with the question, else round its first phrase; empty
    without one. A quarter of it lies before the phrase."""
    asked = set(re.findall(r"[a-z0-9]+", question.lower()))
    places = [m for p in phrases for m in re.finditer(p, text, re.IGNORECASE)]
    near = [m.start() for m in places if asked & set(re.findall(r"[a-z0-9]+", m.group().lower()))]
    if not places:
        return ""
    end = min(len(text), max(0, min(near or [m.start() for m in places]) - width // 4) + width)
    return text[max(0, end - width) : end]


def estimated(text: str) -> int:
    return max(1, len(text) // 4)


def fit(pieces: list[dict], question: str, tables_first: bool, budget: int = BUDGET, tokens=estimated) -> list[tuple[dict, str, str]]:
    """The pieces, in order, that a budget takes, each with its form and text: full, excerpt or rescued.

    A piece has prompt, excerpt, parent_chunk_id, is_table and score. What counts is the numbered text of all chosen ones
    together. A piece whose parent would be one too many, or that doesn't fit, is tried as its excerpt, then, but for tables,
    as a rescued window; else it is skipped, and later pieces are still tried.
    """
    if tables_first:
        asked = set(re.findall(r"[a-z0-9]+", question.lower()))
        shared = lambda p: len(asked & set(re.findall(r"[a-z0-9]+", p["excerpt"].lower())))
        pieces = sorted((p for p in pieces if p["is_table"]), key=lambda p: (-shared(p), -p["score"])) + [p for p in pieces if not p["is_table"]]
    chosen: list[tuple[dict, str, str]] = []
    parents: set[str] = set()

    def fits(text: str) -> bool:
        return tokens("\n\n".join(f"[{i}] {x}" for i, x in enumerate([*(x for _, _, x in chosen), text]))) <= budget

    for p in pieces:
        parent, table = p["parent_chunk_id"], p["is_table"]
        full = p["prompt"] if table else without_overlap(p["prompt"], [x for _, _, x in chosen])
        if (table or not parent or parent in parents or len(parents) < PARENTS) and full.strip() and fits(full):
            chosen.append((p, "full", full))
            if parent and not table:
                parents.add(parent)
            continue
        excerpt = (p["excerpt"] or "").strip()
        if excerpt and fits(excerpt):
            chosen.append((p, "excerpt", excerpt))
        elif excerpt and not table and (window := rescued(p["prompt"], question)) and fits(window):
            chosen.append((p, "rescued", window))
    return chosen


PACKED = "query_id long, place int, chunk_id string, form string, text string"


def packed(packs: DataFrame, questions: DataFrame, budget: int = BUDGET, tokens=estimated) -> DataFrame:
    """query_id, place (from 0), chunk_id, form and text of what fits into a question's budget. ``packs`` come from
    ``finalised``, so that a question has some dozens of pieces at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("position").to_dict("records")
        got = fit(rows, rows[0]["question"] or "", bool(rows[0]["tables_first"]), budget, tokens)
        return pd.DataFrame([(r["query_id"], i, r["chunk_id"], form, text) for i, (r, form, text) in enumerate(got)], columns=["query_id", "place", "chunk_id", "form", "text"])

    q = F.col("question")
    asked = questions.select("query_id", "question", (C.is_table(q) | C.is_metric(q)).alias("tables_first"))
    is_table = F.col("block_type").eqNullSafe(F.lit("table")) | (F.col("kind") == "table")
    rows = packs.join(asked, "query_id").select("query_id", "position", "chunk_id", "question", "tables_first", F.coalesce("prompt", F.lit("")).alias("prompt"), F.coalesce("excerpt", F.lit("")).alias("excerpt"), "parent_chunk_id", is_table.alias("is_table"), "score")
    return rows.groupBy("query_id").applyInPandas(run, PACKED)
