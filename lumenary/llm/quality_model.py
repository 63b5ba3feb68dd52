"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Each word has an index vector of its own, drawn from its full hash, and a word vector: the sum of the index vectors of its
neighbours in all texts, scaled to unit length. Nothing is shared between words.

1. Tasks sum contexts by word and send them to buckets, which are ranges of the words' hashes; a grouped sum per bucket makes
   the vocabulary, which is written.
2. The FREQUENT most frequent words' vectors are broadcast, a table of fixed size. Each document's words are pooled from it;
   words that aren't in it go to their buckets, with the document's number and their count.
3. There they meet their contexts, which go to the document's bucket and complete its pooled vector. So every word of every
   text counts by its own vector, whatever the vocabulary's size.
4. The network is trained on the driver on a bounded number of labelled documents, and scores all documents in tasks.

Words and contexts travel as packed arrays, a row for each task and bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, written

#: Length of a word vector, and how many of an index vector's entries are +1 or -1.
SIZE, NONZERO = 32, 2
#: Neighbours to either side that a word's vector sums.
REACH = 2
#: Words whose vectors are broadcast.
FREQUENT = 1 << 18
#: Documents for which there is a bucket, about.
BUCKET_ROWS = 4000
#: Words at once, distinct words that a task holds, and words without a vector that it holds.
CHUNK, STATE_WORDS, HELD_WORDS = 1 << 17, 450_000, 1 << 18
#: Labelled rows that training uses at most, those of least hash; the network's memory and time are bounded by it.
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 60, 128, 0.005, 1e-3, 7
#: Temperatures that are tried.
TEMPERATURES = np.geomspace(0.05, 20, 61)
CACHE_WORDS = 400_000
#: Numbers of a pooled vector, which lie between -1 and 1 and travel in 16 bits.
POOLED = 3 * SIZE


class Words:
    """Hashes of a text's words, cut at ASCII white space."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8").split()
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def index_vectors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (n x NONZERO) and signs of the entries of words' index vectors, 16 bits of the hash each; where two entries
    share a place they add up."""
    bits = (h[:, None] >> (np.arange(NONZERO, dtype=np.uint64) * np.uint64(16))) & np.uint64(0xFFFF)
    return (bits % np.uint64(SIZE)).astype(np.int64), (1 - 2 * (bits >> np.uint64(15)).astype(np.int8)).astype(np.int8)


def contexts(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, their counts, and the sums of the index vectors of their neighbours in the same text, for texts laid end
    to end."""
    words, inv, counts = np.unique(h, return_inverse=True, return_counts=True)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    place, sign = index_vectors(h)
    total = np.zeros(len(words) * SIZE)
    for d in range(1, REACH + 1):
        a = np.flatnonzero(text[d:] == text[:-d])
        own, near = np.concatenate([a, a + d]), np.concatenate([a + d, a])
        total += np.bincount((inv[own][:, None] * SIZE + place[near]).ravel(), weights=sign[near].ravel(), minlength=len(total))
    return words, counts.astype(np.int32), np.rint(total).astype(np.int32).reshape(-1, SIZE)


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and sums by word, words sorted. The parts are given up, so that they are held no longer than need be."""
    h, n, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    v = v[order]
    if not len(h):
        return h, n, v
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    # Sums that may leave 32 bits are made with 64.
    wide = np.int64 if max(int(n.max()), int(np.abs(v).max(initial=0))) * int(np.diff(first, append=len(h)).max()) >= 1 << 31 else None
    return h[first], np.add.reduceat(n, first, dtype=wide), np.add.reduceat(v, first, axis=0, dtype=wide)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length in few bytes: signed integers as narrow as they may be, unsigned ones, which should rise, by their
    differences, and all of them byte plane by byte plane, so that empty planes cost nothing."""
    out = [len(arrays[0]).to_bytes(8, "little")]
    for a in arrays:
        if a.dtype.kind == "u":
            a, kind = np.diff(a, prepend=np.uint64(0)), "u8"
        else:
            kind = next((k for k in ("i1", "i2", "i4") if not a.size or (-(1 << 8 * int(k[1]) - 1) <= a.min() and a.max() < 1 << 8 * int(k[1]) - 1)), "i8")
        planes = np.ascontiguousarray(a.astype(f"<{kind}")).view(np.uint8).reshape(-1, int(kind[1]))
        out += [kind.encode(), planes.T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(raw: bytes, widths: tuple[int, ...]) -> list[np.ndarray]:
    """What ``pack`` packed; a width over 1 makes a matrix. Signed numbers come back as int32, or int64 if they are wider."""
    data = zstandard.ZstdDecompressor().decompress(raw)
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for w in widths:
        kind = np.dtype("<" + data[at : at + 2].decode())
        planes = np.frombuffer(data, np.uint8, n * w * kind.itemsize, at + 2)
        at += 2 + planes.size
        a = np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()
        a = np.cumsum(a, dtype=np.uint64) if kind.kind == "u" else a if kind.itemsize == 8 else a.astype(np.int32)
        out.append(a.reshape(n, w) if w > 1 else a)
    return out


def shortened(x: np.ndarray) -> list[bytes]:
    """Rows as bytes, 16 bits a number."""
    return [r.tobytes() for r in x.astype("<f2")]


def lengthened(raw: list[bytes]) -> np.ndarray:
    """What ``shortened`` made."""
    return np.frombuffer(b"".join(raw), "<f2").reshape(-1, POOLED).astype(np.float64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the order of hashes."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of a sorted array."""
    if len(bucket):
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
            yield int(bucket[a]), slice(a, b)


def _wide(v: np.ndarray) -> np.ndarray:
    """Rows that don't fit a byte an entry."""
    return (v.max(axis=1, initial=0) > 127) | (v.min(axis=1, initial=0) < -128)


def _rows(kinds: list[pa.DataType], names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def vocabulary(df: DataFrame, buckets: int, text: str = "text") -> DataFrame:
    """Rows (bucket, data): the bucket's words, counts and context sums over all texts, packed; of most words the sums are small
    and are packed apart from the others, so that a bucket has two rows at most."""

    def run(batches):
        words, parts, held = Words(), [], 0

        def sent(state) -> pa.RecordBatch:
            rows = []
            for some in (_wide(state[2]), ~_wide(state[2])):
                h, n, v = (a[some] for a in state)
                rows += [(b, pack(h[s], n[s], v[s])) for b, s in _slices(bucket_of(h, buckets))]
            return _rows([pa.int64(), pa.binary()], ["bucket", "data"], rows)

        for batch in batches:
            lists = [words(t) for t in batch.column(0).to_pylist()]
            at = 0
            while at < len(lists):
                stop, n = at, 0
                while stop < len(lists) and (n == 0 or n + len(lists[stop]) <= CHUNK):
                    n += len(lists[stop])
                    stop += 1
                if n:
                    parts.append(contexts(np.concatenate(lists[at:stop]), np.cumsum([len(x) for x in lists[at:stop]])))
                    held += len(parts[-1][0])
                at = stop
                if held > 3 * STATE_WORDS // 2:
                    parts.append(merged(parts))
                    held = len(parts[0][0])
                    if held > STATE_WORDS:
                        yield sent(parts[0])
                        parts, held = [], 0
        if parts:
            yield sent(merged(parts))

    def whole(group: pa.Table) -> pa.Table:
        state = merged([tuple(unpack(x, (1, 1, SIZE))) for x in group["data"].to_pylist()])
        b = group["bucket"][0].as_py()
        some = _wide(state[2])
        return pa.Table.from_batches([_rows([pa.int64(), pa.binary()], ["bucket", "data"], [(b, pack(*(a[k] for a in state))) for k in (some, ~some) if k.any()])])

    return df.select(text).mapInArrow(run, "bucket long, data binary").groupBy("bucket").applyInArrow(whole, "bucket long, data binary")


def unit(v: np.ndarray) -> np.ndarray:
    """Word vectors of context sums: unit length, in 127ths, as they are broadcast."""
    norm = np.maximum(np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True), 1e-9)
    return np.rint(127 * v / norm).astype(np.int8)


def frequent(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and vectors of the most frequent words, FREQUENT at most. Counts are compared by their magnitude, in
    eighths of a doubling, of which there are some hundreds whatever the corpus."""

    def magnitude(n: np.ndarray) -> np.ndarray:
        return np.floor(8 * np.log2(n)).astype(np.int64)

    def count(batch):
        m, k = np.unique(np.concatenate([magnitude(unpack(x, (1, 1, SIZE))[1]) for x in batch.column(0).to_pylist()]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(k)], ["m", "k"])

    levels = sorted(((r["m"], r["k"]) for r in map_batches(words.select("data"), "m long, k long", lambda: count).groupBy("m").agg(F.sum("k").alias("k")).collect()), reverse=True)
    total, least = 0, None
    for m, k in levels:
        total += k
        if total > FREQUENT:
            break
        least = m
    if least is None:
        return np.zeros(0, np.uint64), np.zeros((0, SIZE), np.int8)

    def choose(batch):
        for x in batch.column(0).to_pylist():
            h, n, v = unpack(x, (1, 1, SIZE))
            some = magnitude(n) >= least
            yield pa.RecordBatch.from_arrays([pa.array([h[some].tobytes()], pa.binary()), pa.array([unit(v[some]).tobytes()], pa.binary())], ["h", "v"])

    got = map_batches(words.select("data"), "h binary, v binary", lambda: choose).collect()
    h, v = np.frombuffer(b"".join(r["h"] for r in got), np.uint64), np.frombuffer(b"".join(r["v"] for r in got), np.int8).reshape(-1, SIZE)
    order = np.argsort(h)
    return h[order], v[order]


def pooled(documents: DataFrame, known: tuple[np.ndarray, np.ndarray], buckets: int, key: str, text: str) -> DataFrame:
    """Rows of two kinds. Documents: kind 0, id (a number of the row's own), key, n (its words), types (its distinct words), data
    (what its frequent words add to the means of vectors, of their squares and of distinct words' vectors). Other words: kind 1, id (their bucket), data (words, documents' ids, counts)."""
    shared = documents.sparkSession.sparkContext.broadcast(known)
    names, kind = ["kind", "id", "key", "n", "types", "data"], documents.schema[key].dataType
    rows = documents.select(F.monotonically_increasing_id().alias("_id"), F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))

    def run(batches):
        words, (top, vectors) = Words(), shared.value
        vectors = vectors.astype(np.float32) / 127
        rest, held = [], 0

        def flush(batch_kind):
            h, i, c = (np.concatenate(x) for x in zip(*rest, strict=True))
            order = np.argsort(h, kind="stable")
            h, i, c = h[order], i[order], c[order]
            sent = [(1, b, None, None, None, pack(h[s], i[s], c[s])) for b, s in _slices(bucket_of(h, buckets))]
            return _rows([pa.int32(), pa.int64(), batch_kind, pa.int64(), pa.int64(), pa.binary()], names, sent)

        key_kind = pa.int64()
        for batch in batches:
            key_kind, sums, sizes, types = batch.schema.field(1).type, [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h = words(t)
                u, c = np.unique(h, return_counts=True)
                at = np.minimum(np.searchsorted(top, u), max(len(top) - 1, 0))
                hit = top[at] == u if len(top) else np.zeros(len(u), bool)
                v, w = vectors[at[hit]], c[hit].astype(np.float32)
                sizes.append(len(h))
                types.append(len(u))
                n = max(1, len(h))
                sums.append(np.concatenate([w @ v / n, w @ (v * v) / n, v.sum(axis=0) / max(1, len(u))]))
                if not hit.all():
                    rest.append((u[~hit], np.full(int((~hit).sum()), i, np.int64), c[~hit].astype(np.int64)))
                    held += len(rest[-1][0])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), np.int32)), batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(types, pa.int64()), pa.array(shortened(np.array(sums)), pa.binary())], names)
            if held > HELD_WORDS:
                yield flush(key_kind)
                rest, held = [], 0
        if rest:
            yield flush(key_kind)

    return rows.mapInArrow(run, f"kind int, id long, key {kind.simpleString()}, n long, types long, data binary")


def completed(rows: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """key and x, the pooled vector (mean and deviation of the words' vectors, and mean of the distinct words'), of each document, from the rows of ``pooled`` and ``vocabulary``."""
    key = rows.schema["key"].dataType.simpleString()

    def resolve(group: pa.Table) -> pa.Table:
        """A bucket's words meet their contexts, which go to the documents' buckets."""
        kinds, data = group["kind"].to_pylist(), group["data"].to_pylist()
        asked = [unpack(x, (1, 1, 1)) for k, x in zip(kinds, data, strict=True) if k == 1]
        out = []
        if asked:
            top, _, sums = merged([tuple(unpack(x, (1, 1, SIZE))) for k, x in zip(kinds, data, strict=True) if k == 2])
            h, i, c = (np.concatenate(x) for x in zip(*asked, strict=True))
            v, i = sums[np.searchsorted(top, h)], i.astype(np.int64)
            to = i % buckets
            order = np.argsort(to, kind="stable")
            v, i, c, to = v[order], i[order], c[order], to[order]
            out = [(b, pack(i[s], c[s], v[s])) for b, s in _slices(to)]
        return pa.Table.from_batches([_rows([pa.int64(), pa.binary()], ["bucket", "data"], out)])

    asked = rows.where("kind = 1").select("kind", F.col("id").alias("bucket"), "data")
    met = asked.unionByName(words.select(F.lit(2).alias("kind"), "bucket", "data")).groupBy("bucket").applyInArrow(resolve, "bucket long, data binary")

    def finish(group: pa.Table) -> pa.Table:
        ids = group["id"].to_numpy()
        own = np.flatnonzero(group["kind"].to_numpy() == 0)
        table = group.take(pa.array(own[np.argsort(ids[own], kind="stable")]))
        ids, n, types = table["id"].to_numpy(), *(np.maximum(table[c].to_numpy(), 1)[:, None] for c in ("n", "types"))
        means = lengthened(table["data"].to_pylist())
        for k, x in zip(group["kind"].to_pylist(), group["data"].to_pylist(), strict=True):
            if k == 1:
                i, c, v = unpack(x, (1, 1, SIZE))
                u = unit(v) / 127.0
                at = np.searchsorted(ids, i)
                share = (c / n[at, 0])[:, None]
                np.add.at(means, at, np.column_stack([u * share, u * u * share, u / types[at]]))
        mean, square, of_types = means[:, :SIZE], means[:, SIZE : 2 * SIZE], means[:, 2 * SIZE :]
        x = np.column_stack([mean, np.sqrt(np.maximum(square - mean * mean, 0)), of_types])
        return pa.table({"key": table["key"], "x": pa.array(shortened(x), pa.binary())})

    own = rows.where("kind = 0").withColumn("bucket", F.col("id") % buckets)
    rest = met.select(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("id"), F.lit(None).cast(key).alias("key"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("types"), "data", "bucket")
    return own.unionByName(rest).groupBy("bucket").applyInArrow(finish, f"key {key}, x binary")


def features(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and x of every row, as a written table."""
    buckets = max(1, -(-documents.count() // BUCKET_ROWS))
    words = written(vocabulary(documents, buckets, text), "vocabulary")
    rows = written(pooled(documents, frequent(words), buckets, key, text), "pooled")
    out = written(completed(rows, words, buckets), "features")
    discard(words, rows)
    return out


def inputs(raw: list[bytes]) -> np.ndarray:
    """What the network gets: the pooled vectors, the lengths of both means and of their difference, and the mean deviation. Nothing
    of a text counts but by its words' vectors."""
    x = lengthened(raw)
    mean, of_types = x[:, :SIZE], x[:, 2 * SIZE :]
    lengths = [np.linalg.norm(v, axis=1) for v in (mean, of_types, mean - of_types)]
    return np.column_stack([x, *lengths, x[:, SIZE : 2 * SIZE].mean(axis=1)])


@dataclass
class Network:
    """Two layers (tanh, logistic) over standardised features, and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _loss(logits: np.ndarray, y: np.ndarray, t: float) -> float:
    z = logits / t
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the log loss, with all rows in a new order each epoch; a fifth of the rows is kept apart to choose the
    temperature. Without rows, or with one label only, the scores are that label's smoothed share."""
    mean, scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    share = (y.sum() + 1) / (len(y) + 2)
    if len(x) < 10 or len(np.unique(y)) < 2:
        return Network(mean, scale, np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), math.log(share / (1 - share)))
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(x))
    held, own = order[: len(x) // 5], order[len(x) // 5 :]
    z = (x - mean) / scale
    p = [rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.array(0.0)]
    m, s, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(own)
        for at in range(0, len(own), BATCH):
            rows = order[at : at + BATCH]
            a, b = z[rows], y[rows]
            h = np.tanh(a @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - b) / len(rows)
            g = (e[:, None] * p[2]) * (1 - h * h)
            grads = [a.T @ g + DECAY * p[0], g.sum(axis=0), h.T @ e + DECAY * p[2], np.array(e.sum())]
            step += 1
            for k, d in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * d
                s[k] = 0.999 * s[k] + 0.001 * d * d
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3]))
    logits = net.logits(x[held])
    net.temperature = float(min((_loss(logits, y[held], t), t) for t in TEMPERATURES)[1])
    return net


def held_out(key: str) -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def fit(rows: DataFrame, labels: DataFrame, key: str = "doc_id", most: int = TRAIN_ROWS) -> Network:
    """The network, from the features of labelled documents that aren't held out: all of them, or those of the ``most`` labels of
    least hash where there are more. Labels other than 0 and 1, and labels without a document, count for nothing."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(key)).select(F.col(key).alias("key"), F.col("quality").cast("int").alias("label")).distinct()
    known = known.orderBy(F.xxhash64("key"), "key", "label").limit(most)
    got = rows.join(F.broadcast(known), "key").select(F.col("key").cast("string"), "label", "x").distinct().collect()  # bounded by ``most``
    got.sort(key=lambda r: (r["key"], r["label"], r["x"]))
    return train(inputs([r["x"] for r in got]), np.array([r["label"] for r in got], np.float64))


def score(rows: DataFrame, net: Network, key: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    def step(batch):
        s = net.scores(inputs(batch.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [key, "score", "predicted"])

    return map_batches(rows.select("key", "x"), f"{key} {rows.schema['key'].dataType.simpleString()}, score double, predicted int", lambda: step)


def classify(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, score and predicted of every document.

    Null and empty texts are scored by their zero vector; repeated rows get equal rows; other columns are left out. Labels
    train only where crc32 of the key mod 5 isn't 0, and neither they nor the key enter a score otherwise. A null key isn't
    held out. An empty table gives an empty result.
    """
    rows = features(documents, key, text)
    net = fit(rows, labels, key)
    return score(rows, net, key).select(key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "score", "predicted")
