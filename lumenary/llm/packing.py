"""Best-fit packing of documents into token sequences, planned over the histogram of lengths."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import map_batches, written

#: Rows of one length that one task ranks, about.
RANKED_ROWS = 5_000


class WithAdded:
    """An encoder and added tokens, whose strings are matched first, the longest at each place, and cut the text."""

    def __init__(self, encoder: Encoder, added: dict[str, int]):
        self.encoder, self.added = encoder, {k: v.to_bytes(4, "little") for k, v in added.items()}
        self.pattern = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None

    def encode_packed(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        parts = [self.pattern.split(t) if self.pattern and any(a in t for a in self.added) else [t] for t in texts]
        ids = self.encoder.encode_packed([x for p in parts for x in p[::2]])
        for p in parts:  # every other part is an added token
            yield b"".join(self.added[x] if i % 2 else next(ids) for i, x in enumerate(p))


@cache
def json_encoder(path: str) -> WithAdded:
    """The encoder of a byte-level BPE file of the tokenizers library, whose ids must follow the order of its merges. Added
    tokens count wherever their strings stand, as they do there."""
    with open(path) as f:
        whole = json.load(f)
    model = whole["model"]
    if any(t[k] for t in whole["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on their surroundings aren't supported")
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    vocab = model["vocab"]
    for i, m in enumerate(model["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        if vocab[a + b] != 256 + i:
            raise ValueError("the ids don't follow the order of the merges")
    ranks = {bytes(byte_of[c] for c in k): i for k, i in vocab.items() if i < 256 + len(model["merges"])}
    pieces = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})  # merges one piece at a time
    return WithAdded(Encoder(ranks, pieces.encode_ordinary), {t["content"]: t["id"] for t in whole["added_tokens"]})


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, decreasing, over counts: rows (length, rank_from, rank_to, sequence, offset).

    The rank_from-th document of that length goes to ``sequence`` at ``offset``, the next one to the sequence after, and
    so on. Sequences that are filled alike are kept as ranges, so time and rows depend on the number of different lengths
    and fillings, not on the number of documents.
    """
    slots, ranges, rooms, opened = [], {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in ranges:
                ranges[room] = []
                insort(rooms, room)
            ranges[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
            else:
                room, first, n = capacity, opened, left  # as many new ones as it takes
            # A sequence that took a document is the best fit for the next one, as long as it has room.
            each = room // length
            bins, deep = (min(n, left // each), each) if left >= each else (1, left)
            for k in range(deep):
                slots.append((length, rank, rank + bins, first, capacity - room + k * length))
                rank += bins
            put(room - deep * length, first, bins)
            if room < capacity:
                put(room, first + bins, n - bins)
            else:
                opened += bins
            left -= bins * deep
    return slots


def pieces(df: DataFrame, tokenizer: str, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids, then id 0, cut into pieces of at most ``capacity``; only a first piece may be shorter."""

    def make():
        enc = json_encoder(tokenizer)

        def step(batch):
            cols = [[], [], [], [], []]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for k, packed in zip(batch.column(0).to_pylist(), enc.encode_packed(texts), strict=True):
                ids = packed + b"\0\0\0\0"
                n = len(ids) // 4
                stop, start, i = n % capacity or min(n, capacity), 0, 0
                while start < n:
                    for c, v in zip(cols, (k, i, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])), strict=True):
                        c.append(v)
                    start, stop, i = stop, stop + capacity, i + 1
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [key, "piece", "start", "length", "ids_crc32"])

        return step

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(key, text), f"{key} {kind}, piece int, start long, length long, ids_crc32 long", make)


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` from 1 to ``capacity``.

    The driver plans over the histogram, which has ``capacity`` rows at most whatever the input. Rows of one length are dealt
    over buckets of about RANKED_ROWS; a row's rank within its length is the number of rows in the buckets before its own
    plus its rank in the bucket, so that a length that a third of all rows have is ranked by many tasks. Rows that are equal
    in all columns take slots of their own. An empty table gives an empty result.
    """
    spark = cut.sparkSession
    columns = cut.columns
    kept = written(cut, "pieces")
    counts = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(n is None or not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    row = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    buckets = spark.createDataFrame([(n, -(-k // RANKED_ROWS)) for n, k in counts.items()], "length long, _buckets long")
    dealt = kept.join(F.broadcast(buckets), "length").withColumn("_bucket", F.pmod(row, F.col("_buckets")).cast("int")).select(*[F.col(f"`{c}`") for c in columns], "_bucket")
    sizes = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    slots = spark.createDataFrame(plan(counts, capacity), "length long, _from long, _to long, _sequence long, _offset long")
    within = Window.partitionBy("length", "_bucket").orderBy(row, *[F.col(f"`{c}`") for c in columns])
    ranked = dealt.withColumn("_in", F.row_number().over(within) - 1).join(offsets, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_in"))
    # The plan's rows are bounded by the capacity alone.
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (ranked["_rank"] >= slots["_from"]) & (ranked["_rank"] < slots["_to"]))
    return placed.select(*[ranked[f"`{c}`"] for c in columns], (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("_offset").alias("offset"))


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``pieces`` and ``pack``: one row per piece. Null and empty texts have one token, id 0; other columns are left out."""
    return pack(pieces(df, tokenizer, capacity, key, text), capacity)
