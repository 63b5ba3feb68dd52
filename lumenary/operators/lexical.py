"""Weighted overlap of texts with a stated query set, without a table of pairs.

The queries' inverted index is broadcast, a block of queries at a time. Each task scores its texts against it, in steps of
bounded size. ``best`` keeps the best k of each query in the task, so that what is shuffled is k rows a query and task, however
many texts share a word with a query; ``pairs`` gives all that overlap enough and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .chunking import slices

#: Queries whose index is broadcast at once.
BLOCK_QUERIES = 20_000
#: Meetings of a text's term with a query that a task holds at once.
MEETINGS = 1 << 19
#: Terms that are looked for at once.
BLOCK_TERMS = 500_000
#: Rows that a task hands over at once.
SCARCE_ROWS = 10_000


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """Query ids, the queries' terms, and the places of the queries that have a term: those from its begin to the next one's.
    From queries (query_id, terms); a term that a query has twice counts twice."""
    rows = queries.select("query_id", "terms").orderBy("query_id")
    for at in range(0, max(1, rows.count()), BLOCK_QUERIES):
        got = rows.offset(at).limit(BLOCK_QUERIES).collect()
        index: dict[str, list[int]] = {}
        for i, r in enumerate(got):
            for t in r["terms"] or ():
                index.setdefault(t, []).append(i)
        begins = np.concatenate([[0], np.cumsum([len(x) for x in index.values()], dtype=np.int64)]).astype(np.int64)
        yield np.array([r["query_id"] for r in got], np.int64), pa.array(index, pa.string()), begins, np.array([i for x in index.values() for i in x], np.int64)


def _met(batch: pa.RecordBatch, n: int, terms: pa.Array, begins: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the batch (terms and weights being its columns 2 and 3), places of queries and summed weights, for each text and
    query with a common term; all of a text in one step."""
    lists, weights = batch.column(2), batch.column(3)
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    p = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
    hit = p >= 0
    row, p, w = np.repeat(np.arange(batch.num_rows), size)[hit], p[hit], weights.flatten().to_numpy(zero_copy_only=False)[hit]
    long = begins[p + 1] - begins[p]
    upto = np.concatenate([[0], np.cumsum(long)])  # meetings before each term
    first = np.searchsorted(row, np.arange(batch.num_rows + 1))
    wide = max(1, MEETINGS // max(1, n))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(upto[first], upto[first[at]] + MEETINGS, side="right")) - 1
        end = min(max(end, at + 1), at + wide, batch.num_rows)
        a, b = first[at], first[end]
        total = upto[b] - upto[a]
        if total:
            each = long[a:b]
            q = places[np.repeat(begins[p[a:b]] - (upto[a:b] - upto[a]), each) + np.arange(total)]
            key = np.repeat((row[a:b] - at) * n, each) + q
            if total * 4 < (end - at) * n:  # few meetings: only the queries that the texts meet are counted
                met, place = np.unique(key, return_inverse=True)
                sums = np.bincount(place, weights=np.repeat(w[a:b], each))
            else:
                sums = np.bincount(key, weights=np.repeat(w[a:b], each), minlength=(end - at) * n)
                met = np.flatnonzero(sums)
                sums = sums[met]
            yield at + met // n, met % n, sums
        at = end


def _columns(texts: DataFrame) -> DataFrame:
    value = F.col("value").cast("double") if "value" in texts.columns else F.lit(0.0)
    return texts.select(F.col("document_id").cast("long"), F.col("ordinal").cast("int"), "terms", "weights", value.alias("value"))


def _scanned(texts: DataFrame, queries: DataFrame, scan, schema: str) -> DataFrame:
    out, rows = None, _columns(texts)
    for block in _blocks(queries):
        part = rows.mapInArrow(scan(texts.sparkSession.sparkContext.broadcast(block)), schema)
        out = part if out is None else out.unionByName(part)
    return out


def best(texts: DataFrame, queries: DataFrame, k: int, score: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], least: float, once: bool = False) -> DataFrame:
    """query_id, document_id, ordinal, score (of ``least`` or more) and rank of the k best texts of each query.

    texts: document_id, ordinal, terms and weights (arrays of one length), perhaps value; queries: query_id, terms. ``score``
    makes scores of texts' summed weights, ordinals and values (arrays of one length); queries without a common term have
    none. Ties go to the lesser document_id, then ordinal. ``once``: of a document's texts, the best alone counts.
    """

    def scan(shared):
        def run(batches):
            ids, *index = shared.value
            found: list[tuple[np.ndarray, ...]] = []
            held, floor = 0, np.full(len(ids), -np.inf)

            def cut():
                q, s, d, o = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((o, d, -s, q))
                if once:
                    of = np.lexsort((np.arange(len(order)), d[order], q[order]))  # places in order, a query's document together
                    new = np.ones(len(of), bool)
                    new[1:] = (q[order][of][1:] != q[order][of][:-1]) | (d[order][of][1:] != d[order][of][:-1])
                    order = order[np.sort(of[new])]
                first = np.searchsorted(q[order], q[order])
                order = order[np.arange(len(order)) - first < k]
                q, s, d, o = q[order], s[order], d[order], o[order]
                full = np.flatnonzero(np.bincount(q, minlength=len(ids)) >= k)
                worst = np.full(len(ids), np.inf)
                np.minimum.at(worst, q, s)
                floor[full] = worst[full]
                return [(q, s, d, o)]

            for b in batches:
                docs, ordinals, values = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 4))
                for row, q, total in _met(b, len(ids), *index):
                    s = score(total, ordinals[row], values[row])
                    good = (s >= least) & (s >= floor[q])
                    if good.any():
                        row = row[good]
                        found.append((q[good], s[good].astype(np.float64), docs[row], ordinals[row]))
                        held += len(row)
                    if held > 4 * k * max(1000, len(ids)):
                        found = cut()
                        held = len(found[0][0])
            if found:
                q, s, d, o = cut()[0]
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(d), pa.array(o.astype(np.int32)), pa.array(s)], ["query_id", "document_id", "ordinal", "score"])

        return run

    out = _scanned(texts, queries, scan, "query_id long, document_id long, ordinal int, score double")
    if once:
        first = F.row_number().over(W.partitionBy("query_id", "document_id").orderBy(F.desc("score"), "ordinal"))
        out = out.withColumn("_o", first).where("_o = 1").drop("_o")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "ordinal"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def pairs(texts: DataFrame, queries: DataFrame, least: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """query_id, document_id, ordinal and total of all texts and queries with a common term whose summed weights ``least``
    lets pass; texts and queries as for ``best``. Each text is counted where it stands."""

    def scan(shared):
        def run(batches):
            ids, *index = shared.value
            for b in batches:
                docs, ordinals = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                for row, q, total in _met(b, len(ids), *index):
                    good = least(total)
                    row, q, total = row[good], q[good], total[good]
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(docs[row]), pa.array(ordinals[row]), pa.array(total.astype(np.int64))], ["query_id", "document_id", "ordinal", "total"])

        return run

    return _scanned(texts, queries, scan, "query_id long, document_id long, ordinal int, total long")


def scarce(texts: DataFrame, terms: DataFrame, most: int, least: int) -> DataFrame:
    """term, n (1 to ``most``) and a, b and x, the least, the greatest and the exclusive or of their ids, of the ``terms`` (term,
    each once) of ``least`` characters or more that ``most`` of the ``texts`` (document_id, text) or fewer have.

    A task looks for a term until more than ``most`` of its texts have it, so that it gives ``most`` rows a term at most.
    """

    def scan(shared):
        def run(batches):
            left, met = set(shared.value), {}
            for b in slices(batches):
                for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for t in left.intersection(T.token_set(text, least)) if left else ():
                        have = met.setdefault(t, [])
                        have.append(d)
                        if len(have) > most:
                            left.discard(t)
            # a frequent term is one row
            rows = [(t, d, n) for t, have in met.items() for d, n in ([(x, 1) for x in have] if len(have) <= most else [(have[0], len(have))])]
            for at in range(0, len(rows), SCARCE_ROWS):
                t, d, n = zip(*rows[at : at + SCARCE_ROWS], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(d, pa.int64()), pa.array(n, pa.int64())], ["term", "document_id", "n"])

        return run

    rows, asked = texts.select(F.col("document_id").cast("long"), T.spelled(F.col("text")).alias("text")), terms.orderBy("term")
    out = None
    for at in range(0, max(1, asked.count()), BLOCK_TERMS):
        block = [r[0] for r in asked.offset(at).limit(BLOCK_TERMS).collect()]
        part = rows.mapInArrow(scan(texts.sparkSession.sparkContext.broadcast(block)), "term string, document_id long, n long")
        out = part if out is None else out.unionByName(part)
    d = F.col("document_id")
    return out.groupBy("term").agg(F.sum("n").alias("n"), F.min(d).alias("a"), F.max(d).alias("b"), F.bit_xor(d).alias("x")).where(F.col("n") <= most)
