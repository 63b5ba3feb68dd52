"""Byte-level BPE encoding and decoding over whole texts."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretoken
from .common import map_batches

#: Pieces that one Python worker remembers.
CACHE_PIECES = 600_000
#: Code points that are split at once.
CHUNK = 1 << 20
#: Bytes from which on a piece's pairs are kept in a heap.
LONG = 48


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_short(parts: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    """Merge the pair of least rank, the first of equals, until none has a rank."""
    none = len(ranks) + 1
    pair = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pair:
        least = min(pair)
        if least == none:
            break
        i = pair.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], none)
    return parts


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same in n log n steps: parts are a linked list of begins, pairs a heap, and a pair counts only while both of its
    parts are as they were."""
    n = len(piece)
    ahead, behind = list(range(1, n + 1)), list(range(-1, n - 1))  # of a part's begin: the next one's, and the last one's
    heap = [(ranks[p], i, i + 2) for i in range(n - 1) if (p := piece[i : i + 2]) in ranks]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        middle = ahead[i]
        if middle < 0 or middle >= n or ahead[middle] != end:
            continue
        ahead[i], ahead[middle] = end, -1
        if end < n:
            behind[end] = i
            if (p := piece[i : ahead[end]]) in ranks:
                heappush(heap, (ranks[p], i, ahead[end]))
        if behind[i] >= 0 and (p := piece[behind[i] : end]) in ranks:
            heappush(heap, (ranks[p], behind[i], end))
    out, at = [], 0
    while at < n:
        out.append(piece[at : ahead[at]])
        at = ahead[at]
    return out


class Encoder:
    """Encodes texts by a rank table; each distinct piece is merged once while it stays in the cache. ``merge`` may be
    another function from a piece to its ids, of the same results."""

    def __init__(self, ranks: dict[bytes, int], merge: Callable[[str], list[int]] | None = None):
        self.ranks = ranks
        self.merge = merge or self.merged
        self.cache: dict[str, bytes] = {}
        self.text_of = {i: str(i) for i in ranks.values()}
        # All tokens' bytes end to end: where each one's begin, and how many they are.
        most = max(ranks.values()) + 1
        self.begin, self.length = np.zeros(most, np.int64), np.zeros(most, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)
        tokens = sorted(ranks, key=ranks.__getitem__)
        self.begin[[ranks[t] for t in tokens]] = np.cumsum([0, *map(len, tokens[:-1])])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def merged(self, piece: str) -> list[int]:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        parts = merge_short([raw[i : i + 1] for i in range(len(raw))], self.ranks) if len(raw) < LONG else merge_long(raw, self.ranks)
        return [self.ranks[p] for p in parts]

    def __missing(self, piece: str) -> bytes:
        return array("I", self.merge(piece)).tobytes()

    def pieces(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
        """Of each text, where its pieces begin, and the pieces."""
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (size == 0 or size + len(texts[stop]) <= CHUNK):
                size += len(texts[stop])
                stop += 1
            some = texts[at:stop]
            whole = "".join(some)
            ends = np.cumsum([len(t) for t in some])
            cp = np.frombuffer(whole.encode("utf-32-le"), "<u4")
            starts = pretoken.boundaries(cp, np.unique(ends[ends > 0]))
            cuts = np.searchsorted(starts, np.concatenate([[0], ends]))
            at_all = starts.tolist()
            for k, e in enumerate(ends.tolist()):
                own = at_all[cuts[k] : cuts[k + 1]]
                yield starts[cuts[k] : cuts[k + 1]] - (e - len(some[k])), [whole[a:b] for a, b in zip(own, [*own[1:], e])]
            at = stop

    def encode_packed(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        known = self.cache
        for _, pieces in self.pieces(texts):
            try:
                yield b"".join(map(known.__getitem__, pieces))
            except KeyError:
                if len(known) > CACHE_PIECES:
                    known.clear()
                for p in pieces:
                    if p not in known:
                        known[p] = self.__missing(p)
                yield b"".join(map(known.__getitem__, pieces))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token's bytes begin in its text."""
        n = self.length[ids]
        return np.cumsum(n) - n

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Each token's bytes, laid down at its offset; offsets that leave gaps or overlap raise ValueError."""
        if not len(ids):
            return b""
        n = self.length[ids]
        if offsets[0] or (np.diff(offsets, append=offsets[-1] + n[-1]) != n).any():
            raise ValueError("the offsets don't fit the tokens")
        return self.bytes[np.repeat(self.begin[ids] - offsets, n) + np.arange(int(offsets[-1] + n[-1]))].tobytes()


@cache
def encoder(path: str) -> Encoder:
    """One for each file and Python worker, so that tasks share its cache."""
    return Encoder(load_ranks(path))


def _listed(lists: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    n = np.cumsum([0, *(0 if x is None else len(x) for x in lists)]).astype(np.int32)
    flat = np.concatenate([x for x in lists if x is not None] or [np.zeros(0)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(n), pa.array(flat, kind))


def encode(df: DataFrame, vocabulary: str, text: str = "text", out: str = "ids", places: str = "offsets") -> DataFrame:
    """Add ``out``, the ids of ``text`` as array<int>, and ``places``, the byte of the text at which each begins. Null and
    empty texts have no ids; other columns stay as they are, and columns that are already called so are replaced."""
    kept = [c for c in df.columns if c not in (out, places)]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    place = kept.index(text)

    def make():
        enc = encoder(vocabulary)

        def step(batch):
            lists = [np.frombuffer(p, "<i4") for p in enc.encode_packed([t or "" for t in batch.column(place).to_pylist()])]
            offsets = [enc.offsets(x) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, _listed(lists, pa.int32()), _listed(offsets, pa.int32())], [*kept, out, places])

        return step

    return map_batches(df.select(*[F.col(f"`{c}`") for c in kept]), f"{fields}, `{out}` array<int>, `{places}` array<int>", make)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", places: str = "offsets", out: str = "decoded") -> DataFrame:
    """Add ``out``, the bytes of ``ids`` laid down at ``places`` (null ids: null). A column that is already called ``out`` is
    replaced."""
    kept = [c for c in df.columns if c != out]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    at = [kept.index(c) for c in (ids, places)]

    def make():
        enc = encoder(vocabulary)

        def step(batch):
            got = [None if x is None else enc.decode(np.array(x, np.int64), np.array(o, np.int64)) for x, o in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], [*kept, out])

        return step

    return map_batches(df.select(*[F.col(f"`{c}`") for c in kept]), f"{fields}, `{out}` binary", make)


def digests(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, then decode the ids, and return ``key``, n_tokens, ids_sha256 (decimal ids joined by commas) and
    decoded_sha256. Null and empty texts: no tokens, the digests of nothing. Repeated keys give repeated rows."""

    def make():
        enc = encoder(vocabulary)
        sha = hashlib.sha256

        def step(batch):
            n, of_ids, of_bytes = [], [], []
            for packed in enc.encode_packed([t or "" for t in batch.column(1).to_pylist()]):
                ids = np.frombuffer(packed, "<i4")
                n.append(len(ids))
                of_ids.append(sha(",".join(map(enc.text_of.__getitem__, ids.tolist())).encode()).hexdigest())
                of_bytes.append(sha(enc.decode(ids, enc.offsets(ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(key, text), f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
