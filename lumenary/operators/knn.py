"""Exact nearest neighbours of a stated query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries that are broadcast at once; more are scored in blocks of as many.
BLOCK_QUERIES = 20_000
#: Scores that a task holds at once.
CELLS = 1 << 20
FOUND = "query_id long, document_id long, cosine double"


def _blocks(queries: DataFrame, size: int, *extra: str) -> Iterator[tuple[np.ndarray, ...]]:
    """Query ids, their unit vectors and further columns, a block at a time."""
    rows = queries.where(F.size("embedding") == size).select("query_id", "embedding", *extra).orderBy("query_id")
    n = rows.count()
    for at in range(0, max(n, 1), BLOCK_QUERIES):
        got = rows.offset(at).limit(BLOCK_QUERIES).collect()
        q = np.array([r[1] for r in got], np.float64).reshape(len(got), size)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        yield np.array([r[0] for r in got], np.int64), q, *(np.array([r[2 + i] for r in got]) for i in range(len(extra)))


def _unions(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _units(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a batch's rows; vectors that are zero or not finite are left out."""
    e = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    norm = np.linalg.norm(e, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return batch.column(0).to_numpy()[good], e[good] / norm[good][:, None]


def _scores(batches, q: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of rows, and their cosines (rounded to nine places) with all queries, as many at once as CELLS allows."""
    step = max(1, CELLS // max(1, len(q)))
    for b in batches:
        ids, e = _units(b, size)
        for at in range(0, len(ids), step):
            yield ids[at : at + step], np.round(q @ e[at : at + step].T, 9)


def _out(ids: np.ndarray, q: np.ndarray, d: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(d.astype(np.int64)), pa.array(s)], ["query_id", "document_id", "cosine"])


def first_k(q: np.ndarray, s: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each query, by falling score and then by id."""
    order = np.lexsort((d, -s, q))
    first = np.searchsorted(q[order], q[order])
    return order[np.arange(len(order)) - first < k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, size: int) -> DataFrame:
    """query_id, document_id and cosine (rounded to nine places) of the k nearest rows of each query.

    vectors: document_id long, embedding; queries: query_id long, embedding. Each task multiplies its batches with the
    broadcast queries and keeps k rows a query, so that what is shuffled is k rows a query and task. Rows whose vector is
    null, of another length, zero or not finite are left out. Ties go to the lesser document_id.
    """

    def scan(shared):
        def run(batches):
            ids, vs = shared.value
            q, d, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for docs, scores in _scores(batches, vs, size):
                least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(ids), -2.0)
                i, j = np.nonzero(scores >= least[:, None])
                q, d, s = np.concatenate([q, i]), np.concatenate([d, docs[j]]), np.concatenate([s, scores[i, j]])
                kept = first_k(q, s, d, k)
                q, d, s = q[kept], d[kept], s[kept]
            if len(q):
                yield _out(ids, q, d, s)

        return run

    rows = vectors.where(F.size("embedding") == size).select("document_id", "embedding")
    out = _unions([rows.mapInArrow(scan(vectors.sparkSession.sparkContext.broadcast(b)), FOUND) for b in _blocks(queries, size)])
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "document_id"))
    return out.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def within(vectors: DataFrame, queries: DataFrame, size: int) -> DataFrame:
    """query_id, document_id and cosine of all rows whose cosine is the query's ``least`` or more."""

    def scan(shared):
        def run(batches):
            ids, vs, least = shared.value
            for docs, scores in _scores(batches, vs, size):
                i, j = np.nonzero(scores >= least[:, None])
                if len(i):
                    yield _out(ids, i, docs[j], scores[i, j])

        return run

    rows = vectors.where(F.size("embedding") == size).select("document_id", "embedding")
    return _unions([rows.mapInArrow(scan(vectors.sparkSession.sparkContext.broadcast(b)), FOUND) for b in _blocks(queries, size, "least")])
