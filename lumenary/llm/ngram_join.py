"""N-gram Jaccard join by vertical partitioning.

A document is its set of word n-grams, held as 64-bit hashes; the global order of n-grams is that of the hashes, and
fragments are ranges of that order. Equal sets are one set, a node, from the start; a set's identity is a 126-bit hash.

1. Candidates. Sets that link differ in few n-grams, so of many fine fragments they agree on some entirely: on ``agreements``
   at least of the fragments that are laid out for the size of the smaller. Each set yields the hashes of its fine fragments, once for its
   own class of sizes and once for the class below. Whole fragments are shared by near copies, hardly by texts that have a
   passage in common, and where they are, then not often enough; so no n-gram needs a cap.
2. Pruning. Sets' sketches are parity bitmaps: how many bits of two of them differ bounds from below in how many n-grams the
   sets differ. Pairs that share fragments with few others are counted and judged one by one; sets that share one with
   many are compared chunk by chunk by their bitmaps, and only a spanning forest of what may link comes out.
3. Families, the components of what may link, go into blocks of bounded weight; heavy ones are cut into several blocks, of
   which all pairs are compared. Each set is sent only to the block pairs of its own family.
4. Verification. The order is cut into FRAGMENTS. Each block pair and fragment is a task of its own, which counts partial
   overlaps and drops pairs that differ too much there already; the partial counts are summed per pair, and tell the links.
   Counts of a block pair are one matrix, so that pairs within a large group never become rows.
5. Components of the links.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, small, written
from .components import connected_components

#: N-grams in one block, about.
BLOCK_NGRAMS = 1 << 18
#: A set weighs this many n-grams at least, so that a block has a bounded number of sets.
LEAST_WEIGHT = 256
#: Fragments of the order in which a block pair's overlaps are counted apart.
FRAGMENTS = 4
#: Bits of the shortest sketch.
BITS = 1024
#: Sets that may share a fine fragment for their pairs to become rows, and sets in a chunk of one that more share.
FEW, CHUNK = 64, 8192
#: Bits of a fine fragment's key that hold its class.
CLASS_BITS = 12
#: Fine fragments' rows that a task hands on at once.
ROWS_AT_ONCE = 1 << 18
#: Words whose hashes one task remembers.
CACHE_WORDS = 400_000
#: N-grams that more sets of a block pair have are counted by matrix products.
RARE = 10

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sets of hashed word n-grams: ASCII letters lower-cased, words cut at ASCII white space."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.n, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            out = _mix(out * _M1 + h[j : len(h) - k + 1 + j])
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def identity(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, of 63 bits each."""
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return h >> 65, h & (1 << 63) - 1


def links(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b with so many n-grams in common are similar enough."""
    return 100 * shared >= percent * (a + b - shared)


def most_apart(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The most n-grams in which sets of sizes a and b that link can differ."""
    return (a + b) * (100 - percent) // (100 + percent)


_starts: dict[int, list[int]] = {}


def _class_start(g: int, percent: int) -> int:
    """The least size of class g: each begins one beyond what can link with the sizes below the class before."""
    starts = _starts.setdefault(percent, [1])
    while len(starts) <= g:
        starts.append(100 * starts[-1] // percent + 1)
    return starts[g]


def size_class(n: int, percent: int) -> int:
    """Classes of sizes; sets that link are in the same one or in neighbouring ones."""
    g = int(math.log(n) / math.log(100 / percent))
    while _class_start(g + 1, percent) <= n:
        g += 1
    while _class_start(g, percent) > n:
        g -= 1
    return g


def most_different(g: int, percent: int) -> int:
    """D: the most n-grams in which two sets can differ that link, the smaller of them in class g.

    If 100 I >= p U then U - I <= (100 - p) U / 100, and U <= 100 min / p.
    """
    least = _class_start(g + 1, percent) - 1  # the largest size in class g
    return (100 - percent) * (100 * least // percent) // 100


def agreements(g: int, percent: int) -> int:
    """On how many fine fragments two sets agree at least that link, the smaller of them in class g."""
    return 1 + most_different(g, percent) // 8


def fine_fragments(g: int, percent: int) -> int:
    """How many fine fragments there are for class g: D of them may hold a difference, ``agreements`` are without, and a few
    more stand for those that hold none of a set's n-grams."""
    d = most_different(g, percent) + agreements(g, percent)
    return d + 1 + math.ceil(d * math.exp(-0.8 * (_class_start(g + 1, percent) - 1) / d))


def fragment_keys(s: np.ndarray, percent: int) -> list[tuple[np.ndarray, bool]]:
    """Keys of a set's fine fragments (a hash, and the class in the lowest bits), for the set's own class of sizes and the one
    below; and whether the class is its own.

    If a set has ``agreements`` filled fragments more than it has n-grams that its links may lack or add, then it agrees
    with them on as many filled ones, and its empty ones say nothing; else they count as well. A set that can link with
    none but its equals has no keys.
    """
    n = len(s)
    reach = (100 - percent) * (n * 100 // percent) // 100
    if not reach:
        return []
    own, out = size_class(n, percent), []
    for g in (own, own - 1):
        if g < 0 or not most_different(g, percent):
            continue
        m = fine_fragments(g, percent)
        part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        salt = np.uint64((g + 1) * int(_M3) % 2**64)
        number, value = part[first], np.add.reduceat(_mix(s + salt), first)
        if len(first) < min(reach, most_different(g, percent)) + agreements(g, percent):
            missing = np.setdiff1d(np.arange(m, dtype=np.uint64), number, assume_unique=True)
            number, value = np.concatenate([number, missing]), np.concatenate([value, np.zeros(len(missing), np.uint64)])
        keys = _mix(value ^ _mix((number + np.uint64(1)) * _M1 + salt))
        out.append((keys >> np.uint64(CLASS_BITS) << np.uint64(CLASS_BITS) | np.uint64(g), g == own))
    return out


def bitmap(s: np.ndarray) -> bytes:
    """The parity of the number of n-grams in each of a power of two of cells, twice as many as n-grams at least."""
    bits = BITS
    while bits < 2 * len(s):
        bits *= 2
    cells = np.bincount(((s >> np.uint64(16)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((cells & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap of so many bytes: that of half the cells is the exclusive or of its halves."""
    x = np.frombuffer(bits, np.uint64)
    while 8 * len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def signatures(df: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """Of each document: doc, the text's own hash, n_shingles, the set's identity (h, h2), its shortest sketch, and its bitmap if
    that is longer."""

    def make():
        shingle = Shingler(words)

        def step(batch):
            sets = [shingle(t) for t in batch.column(2).to_pylist()]
            same = [identity(s) for s in sets]
            maps = [bitmap(s) for s in sets]
            cols = [
                *batch.columns[:2],
                pa.array([len(s) for s in sets], pa.int64()),
                *[pa.array([x[i] for x in same], pa.int64()) for i in (0, 1)],
                pa.array([folded(m, BITS // 8).tobytes() for m in maps], pa.binary()),
                pa.array([m if 8 * len(m) > BITS else None for m in maps], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc", "own", "n_shingles", "h", "h2", "sketch", "bits"])

        return step

    return map_batches(df.select(key, F.xxhash64(text), text), "doc long, own long, n_shingles long, h long, h2 long, sketch binary, bits binary", make)


def fragment_rows(df: DataFrame, words: int, percent: int, text: str) -> DataFrame:
    """Rows (key, node) of documents' fine fragments; a node is twice the first hash of the identity, plus one under the
    set's own class. Copies within one batch yield the rows of one of them."""

    def make():
        shingle = Shingler(words)

        def step(batch):
            seen, keys, nodes, held = set(), [], [], 0
            for t in batch.column(0).to_pylist():
                s = shingle(t)
                h = identity(s)[0]
                if not len(s) or h in seen:
                    continue
                seen.add(h)
                for k, own in fragment_keys(s, percent):
                    keys.append(k.view(np.int64))
                    nodes.append(np.full(len(k), 2 * h + own - (1 << 63), np.int64))
                    held += len(k)
                if held >= ROWS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, nodes)], ["key", "node"])
                    keys, nodes, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, nodes)], ["key", "node"])

        return step

    return map_batches(df.select(text), "key long, node long", make)


def meetings(rows: DataFrame, percent: int, few: int) -> DataFrame:
    """Rows (a, b, key) from rows (key, node): the pairs of sets that share a fine fragment with at most ``few`` sets, the
    smaller of them in its class, once for each such fragment, with the class in place of the key; and rows (node, null,
    key) of fragments that more share.

    Each task reads its fragments sorted, and holds no more of one than ``few`` rows.
    """

    def hash_of(node: np.ndarray) -> np.ndarray:
        return (node.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(1)

    def batch(a, b, key):
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(np.zeros(len(a), np.int64) if b is None else b.astype(np.int64), mask=np.ones(len(a), bool) if b is None else None), pa.array(key)], ["a", "b", "key"])

    def emit(k, v):
        """Of whole fragments."""
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.repeat(np.diff(first, append=len(k)), np.diff(first, append=len(k)))
        hot = size > few
        if hot.any():
            yield batch(hash_of(v[hot]), None, k[hot])
        chosen = (size > 1) & ~hot
        k, v = k[chosen], v[chosen]
        for d in range(1, few):
            at = np.flatnonzero(k[d:] == k[:-d])
            if not len(at):
                break
            at = at[((v[at] | v[at + d]) & 1) == 1]
            a, b = hash_of(v[at]), hash_of(v[at + d])
            yield batch(np.minimum(a, b), np.maximum(a, b), k[at] & ((1 << CLASS_BITS) - 1))

    def run(batches):
        key, node = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the last fragment's rows, which may go on
        hot, last = None, None  # a fragment that more than ``few`` share, and its last node
        for b in batches:
            k, v = (b.column(i).to_numpy() for i in (0, 1))
            if hot is not None:
                n = int(np.searchsorted(k, hot, side="right"))
                more = v[:n][np.concatenate([[last], v[:n][:-1]]) != v[:n]] if n else v[:0]
                if len(more):
                    yield batch(hash_of(more), None, np.full(len(more), hot))
                    last = more[-1]
                k, v = k[n:], v[n:]
                if not len(k):
                    continue
                hot = None
            k, v = np.concatenate([key, k]), np.concatenate([node, v])
            if not len(k):
                continue
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
            k, v = k[new], v[new]
            cut = int(np.searchsorted(k, k[-1]))
            if cut:
                yield from emit(k[:cut], v[:cut])
            key, node = k[cut:], v[cut:]
            if len(key) > few:
                yield batch(hash_of(node), None, key)
                hot, last = key[-1], node[-1]
                key, node = key[:0], node[:0]
        if len(key):
            yield from emit(key, node)

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long, key long")


def agreeing(met: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes' ids, from the rows of ``meetings`` that are pairs: those that agree on enough fine fragments, and
    whose sizes and sketches allow a link."""
    enough = F.array(*[F.lit(agreements(g, percent)) for g in range(1 << CLASS_BITS) if _class_start(g, percent) < 1 << 31])
    need = F.coalesce(F.try_element_at(enough, F.col("g").cast("int") + 1), F.lit(1))
    pairs = met.where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"), F.min("key").alias("g")).where(F.col("n") >= need).select("a", "b")
    side = lambda x: nodes.select(F.col("h").alias(x), F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def step(batch):
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, BITS // 64) for i in (4, 5))
        a, b = (batch.column(i).to_numpy() for i in (2, 3))
        good = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most_apart(a, b, percent)
        yield pa.RecordBatch.from_arrays([pa.array(batch.column(i).to_numpy()[good]) for i in (0, 1)], ["a", "b"])

    return map_batches(joined.select("id_a", "id_b", "n_a", "n_b", "s_a", "s_b"), "a long, b long", lambda: step)


def sift(group: pa.Table, percent: int) -> pa.Table:
    """Edges (a, b) that connect the sets of one chunk pair that may link, by their bitmaps."""
    ids, order = np.unique(group["id"].to_numpy(), return_index=True)
    n = group["n"].to_numpy()[order]
    order = order[np.argsort(n, kind="stable")]  # by size, so that a set's partners are a range
    ids, n, side = (group[c].to_numpy()[order] for c in ("id", "n", "side"))
    raw = group["bits"].take(pa.array(order)).to_pylist()
    width = min(map(len, raw))
    bits = np.stack([folded(r, width) for r in raw])
    label, both = np.arange(len(ids)), bool(side.any())
    a, b = [], []
    for i, stop in enumerate(np.searchsorted(n, 100 * n // percent, side="right").tolist()):
        ok = label[i + 1 : stop] != label[i]
        if both:
            ok &= side[i + 1 : stop] != side[i]
        j = np.flatnonzero(ok) + i + 1
        if len(j):
            j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64) <= most_apart(n[j], n[i], percent)]
        for x in j[np.unique(label[j], return_index=True)[1]].tolist():  # one edge to each family
            a.append(int(ids[i]))
            b.append(int(ids[x]))
            label[label == label[x]] = label[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def crowded(met: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of nodes' ids that connect what may link among the sets of fine fragments that many share. A fragment with
    more than CHUNK sets is dealt over chunks, whose pairs are separate tasks."""
    hot = met.where("b IS NULL").select("key", F.col("a").alias("h"))
    chunks = small(hot.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")).where("chunks > 1"))
    full = nodes.select("h", "id", "n", F.coalesce("bits", "sketch").alias("bits"))
    dealt = hot.join(full, "h").join(chunks, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")))
    sent = dealt.select("key", "id", "n", "bits", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    sides = sent.select("key", "id", "n", "bits", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"))
    return sides.groupBy("key", "p", "q").applyInArrow(lambda t: sift(t, percent), "a long, b long")


def overlaps(which: np.ndarray, grams: np.ndarray, n: int, cut: int) -> np.ndarray:
    """Numbers of common n-grams of n sets, as a matrix: of the sets before ``cut`` with those behind it, or, if ``cut`` is
    n, of all, of which only the upper half counts. ``which`` says whose each of ``grams`` is."""
    square = cut == n
    total = np.zeros((cut, n if square else n - cut), np.int32)
    if not len(grams):
        return total
    low, wide = (0 if square else cut), total.shape[1]
    order = np.argsort(grams, kind="stable")
    g, w = grams[order], which[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    size = np.diff(first, append=len(g))
    found = []
    for z in range(2, RARE + 1):  # n-grams of few sets: their pairs
        f = first[size == z]
        for x in range(z if len(f) else 0):
            for y in range(x + 1, z):
                i, j = w[f + x], w[f + y]
                if not square:
                    across = (i < cut) & (j >= cut)
                    i, j = i[across], j[across]
                found.append(i * wide + j - low)
    if found:
        total += np.bincount(np.concatenate(found), minlength=total.size).reshape(total.shape).astype(np.int32)
    many = np.flatnonzero(size > RARE)
    for at in range(0, len(many), 512):  # of many sets: a product of matrices
        some = many[at : at + 512]
        x = np.zeros((n, len(some)), np.float32)
        x[w[np.concatenate([np.arange(first[i], first[i] + size[i]) for i in some])], np.repeat(np.arange(len(some)), size[some])] = 1
        total += (x[:cut] @ x[low:].T).astype(np.int32)
    return np.triu(total, 1) if square else total


PAIR = "g long, p int, q int"


def partial(group: pa.Table, percent: int) -> pa.Table:
    """The partial overlaps of one block pair in one fragment of the order: a matrix. Pairs that differ there in more n-grams
    than any two links of their sizes do count nothing; what is left of them can't make a link."""
    ids, order = np.unique(group["id"].to_numpy(), return_index=True)
    order = order[np.argsort(group["side"].to_numpy()[order], kind="stable")]
    ids, n, copies, side = (group[c].to_numpy()[order] for c in ("id", "n", "copies", "side"))
    cut = int((side == 0).sum())
    sets = [np.frombuffer(x, np.uint64) for x in group["grams"].take(pa.array(order)).to_pylist()]
    size = np.array([len(s) for s in sets], np.int64)
    shared = overlaps(np.repeat(np.arange(len(ids)), size), np.concatenate(sets), len(ids), cut)
    low = 0 if cut == len(ids) else cut
    for i in range(cut):
        at = np.flatnonzero(shared[i])
        shared[i, at[size[i] + size[low:][at] - 2 * shared[i, at] > most_apart(n[i], n[low:][at], percent)]] = 0
    wide = shared.astype(np.uint8 if shared.max(initial=0) < 256 else np.int32)
    return pa.table({
        **{c: pa.array([group[c][0].as_py()], t) for c, t in (("g", pa.int64()), ("p", pa.int32()), ("q", pa.int32()))},
        "cut": pa.array([cut], pa.int32()),
        **{c: pa.array([x.astype(np.int64).tobytes()], pa.binary()) for c, x in (("ids", ids), ("n", n), ("copies", copies))},
        "counts": pa.array([zlib.compress(wide.tobytes(), 1)], pa.binary()),
    })


def labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of each of 0..n-1, the least one that edges (a, b) reach from it."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def summed(group: pa.Table, percent: int) -> pa.Table:
    """The links of one block pair, from its partial overlaps: rows (a, b, n) with n null for edges that connect the same sets
    as the links do, and (a, a, links of a weighted by copies)."""
    cut = group["cut"][0].as_py()
    ids, n, copies = (np.frombuffer(group[c][0].as_py(), np.int64) for c in ("ids", "n", "copies"))
    low = 0 if cut == len(ids) else cut
    shape = (cut, len(ids) - low)
    total = np.zeros(shape, np.int32)
    for x in group["counts"].to_pylist():
        raw = zlib.decompress(x)
        total += np.frombuffer(raw, np.uint8 if len(raw) == total.size else np.int32).reshape(shape)
    i, j = np.nonzero(total)
    good = links(total[i, j].astype(np.int64), n[i], n[j + low], percent)
    i, j = i[good], j[good] + low
    degree = np.bincount(i, weights=copies[j], minlength=len(ids)) + np.bincount(j, weights=copies[i], minlength=len(ids))
    label = labels(i, j, len(ids))
    edge, linked = np.flatnonzero(label != np.arange(len(ids))), np.flatnonzero(degree)
    a, b = np.concatenate([ids[label[edge]], ids[linked]]), np.concatenate([ids[edge], ids[linked]])
    return pa.table({"a": pa.array(a), "b": pa.array(b), "n": pa.array(np.concatenate([np.zeros(len(edge)), degree[linked]]).astype(np.int64), mask=np.arange(len(a)) < len(edge))})


def families(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with edges: id, rep and its text's hash, h, h2, n, copies, and their block: (g, parts, own) is part ``own`` of ``parts`` of family g,
    or, with ``parts`` 0, one of the blocks that hold many families whole."""
    known = written(connected_components(edges).withColumnRenamed("vertex", "id").join(nodes.select("id", "rep", "rep_text", "h", "h2", "n", "copies"), "id"), "families")
    weights = known.groupBy("component").agg(F.sum(F.greatest("n", F.lit(LEAST_WEIGHT))).alias("w"))
    total = weights.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    heavy = small(weights.where(2 * F.col("w") > BLOCK_NGRAMS).select("component", F.ceil(F.col("w") / BLOCK_NGRAMS).cast("int").alias("parts")))
    placed = known.join(heavy, "component", "left")
    whole = F.col("parts").isNull()
    g = F.when(whole, F.pmod(F.xxhash64("component"), F.lit(max(1, round(total / BLOCK_NGRAMS))))).otherwise(F.col("component"))
    own = F.when(whole, 0).otherwise(F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
    return placed.select("id", "rep", "rep_text", "h", "h2", "n", "copies", g.alias("g"), F.coalesce("parts", F.lit(0)).alias("parts"), own.alias("own"))


def fragments_of(docs: DataFrame, placed: DataFrame, words: int) -> DataFrame:
    """The n-grams of each placed set, a row for each fragment of the order and each block pair that compares the set:
    g, p, q, side, fragment, id, n, copies, grams. Texts are found by their document's key and their own hash; where rows
    repeat these, a task sends one of them."""
    columns = ["id", "n", "copies", "g", "parts", "own"]
    wanted = small(placed)
    chosen = docs.withColumn("_own", F.xxhash64("_text")).join(wanted, F.col("_key").eqNullSafe(F.col("rep")) & (F.col("_own") == F.col("rep_text"))).select("_text", "h", "h2", *columns)
    cuts = (np.arange(1, FRAGMENTS, dtype=np.float64) * (2.0**64 / FRAGMENTS)).astype(np.uint64)

    def make():
        shingle, sent = Shingler(words), set()

        def step(batch):
            rows, grams = [], []
            for i, (t, *same) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                s = shingle(t) if tuple(same) not in sent else None
                if s is None or identity(s) != tuple(same):
                    continue
                sent.add(tuple(same))
                at = [0, *np.searchsorted(s, cuts).tolist(), len(s)]
                rows.append(i)
                grams += [s[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)]
            rows = np.repeat(np.array(rows, np.int64), FRAGMENTS)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(rows)) for c in range(3, 9)], pa.array(np.arange(len(rows)) % FRAGMENTS, pa.int32()), pa.array(grams, pa.binary())], [*columns, "fragment", "grams"])

        return step

    cut = map_batches(chosen, "id long, n long, copies long, g long, parts int, own int, fragment int, grams binary", make)
    others = F.when(F.col("parts") == 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    sent = cut.withColumn("other", F.explode(others)).withColumn("own", F.when(F.col("other") < 0, -1).otherwise(F.col("own")))
    return sent.select("g", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "fragment", "id", "n", "copies", "grams")


def join(df: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's n_shingles, component_id (the least ``key`` that links reach from it, its own included) and n_links
    (how many other documents it links with directly, copies counted).

    Two documents link if their sets' Jaccard similarity is ``percent`` / 100 or more. With fewer words than ``words``, the
    whole sequence is the one n-gram; null, empty and blank texts have none and link with nothing. Rows are documents of
    their own: repeated rows are copies, and several texts may have one key. Keys must be integers; a null one is larger
    than all others. Other columns are left out; an empty table gives an empty result.
    """
    docs = df.select(F.col(f"`{key}`").cast("long").alias("_key"), F.col(f"`{text}`").alias("_text"))
    signed = written(signatures(docs, words, "_key", "_text"), "signatures")
    rep = F.min(F.struct(F.col("doc").isNull().alias("late"), "doc", "own")).alias("rep")
    nodes = signed.where("n_shingles > 0").groupBy("h", "h2").agg(rep, F.count("*").alias("copies"), *[F.first(c).alias(k) for c, k in (("n_shingles", "n"), ("sketch", "sketch"), ("bits", "bits"))])
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("id"), "h", "h2", F.col("rep.doc").alias("rep"), F.col("rep.own").alias("rep_text"), "copies", "n", "sketch", "bits"), "nodes")
    met = written(meetings(fragment_rows(docs, words, percent, "_text"), percent, FEW), "meetings")
    edges = written(agreeing(met, nodes, percent).unionByName(crowded(met, nodes, percent)), "candidates")
    discard(met)
    placed = written(families(edges, nodes), "blocks")
    discard(edges)
    counted = fragments_of(docs, placed, words).groupBy("g", "p", "q", "fragment").applyInArrow(lambda t: partial(t, percent), f"{PAIR}, cut int, ids binary, n binary, copies binary, counts binary")
    found = written(counted.groupBy("g", "p", "q").applyInArrow(lambda t: summed(t, percent), "a long, b long, n long"), "links")
    members = written(connected_components(found.where("n IS NULL").select("a", "b")).withColumnRenamed("vertex", "id").join(nodes.select("id", "rep"), "id"), "components")
    least = written(members.groupBy("component").agg(F.min("rep").alias("least")), "least")
    degrees = found.where("n IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("linked"))
    known = nodes.select("id", "h", "h2", "rep", "copies").join(members.select("id", "component").join(least, "component").select("id", "least"), "id", "left").join(degrees, "id", "left")
    known = known.select("h", "h2", F.coalesce("least", "rep").alias("_component"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("_links"))
    known = written(known, "known")
    discard(placed, found, members, least, nodes)
    own = signed.select("doc", "n_shingles", *[F.when(F.col("n_shingles") > 0, F.col(c)).alias(c) for c in ("h", "h2")])
    return own.join(known, ["h", "h2"], "left").select(F.col("doc").alias(key), "n_shingles", F.coalesce("_component", "doc").alias("component_id"), F.coalesce("_links", F.lit(0)).alias("n_links"))
