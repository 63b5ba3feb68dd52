"""Phrase collocation mining by hierarchical pair naming.

Texts are cut into blocks of one language, each a sequence of word codes with a mark where a piece ends. A level replaces
adjacent codes by names: a block tells its distinct pairs, their counts and their places (the block and its code of the pair);
all blocks' places of a pair meet, and if the pair is frequent its first place becomes its id, which goes back to each of the
places. Frequent words are level 1; a pair of adjacent (k-1)-grams, which share all but their outer words, is a k-gram. A name
is thus its two parents, by which the counts of a phrase's first and last parts, its words, and the phrases that hold it are
found by joins on ids. A phrase can't be more frequent than a part of it, so dropping infrequent ones at each level loses
nothing.

A block's distinct pairs are shuffled, once a level, and not its occurrences. The most frequent pair has a row a block, which is
little beside what a task gets of rare ones. Distinct words and pairs are rows of their own wherever they are kept: Spark reads
thousands of rows at once, however long they are, so that rows of whole blocks would take memory by the blocks of a file.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, small, written

#: Bytes of text of a block, the least frequency of a phrase, its most words, and phrases reported of each language.
BLOCK_BYTES, LEAST, LONGEST, TOP = 8 << 20, 30, 4, 2000
#: How blocks are written: row groups of which a task can hold several, ids by dictionary, and codes, which count up, by difference.
ROWS = {"parquet.block.size": 8 << 20, "parquet.dictionary.page.size": 8 << 20, "parquet.writer.version": "PARQUET_2_0"}
#: In how many passes a level's pairs meet, by their hash: the shuffle files of one are gone before the next one's are written.
PASSES = 2
#: Bits of a code within its block, and of a block's number within its task; 20 are left for the task's.
CODE_BITS, BLOCK_BITS = 31, 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: 0: byte of a word; 1: between words; 2: between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def coded(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The texts' words as codes, -1 where a piece ends; the distinct words in the order of their codes; their counts."""
    a = np.frombuffer(b"\n".join(texts).lower(), np.uint8)  # only A-Z change, being bytes
    kind = KIND[a]
    inside = np.concatenate([[False], kind == 0, [False]])
    start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    piece = np.searchsorted(np.flatnonzero(kind == 2), start)
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(a[kind == 0].tobytes())).dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    ends = np.flatnonzero(piece[1:] != piece[:-1]) + 1
    return np.insert(codes, ends, -1), words.dictionary, np.bincount(codes, minlength=len(words.dictionary))


def squeezed(codes: np.ndarray) -> pa.Array:
    return pa.array([zstandard.compress(codes.astype(np.int32).tobytes(), 1)], pa.binary())


def expanded(codes: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(codes), np.int32)


def sheet(schema: pa.Schema, rows: int, **columns: int | str | pa.Array | np.ndarray) -> pa.RecordBatch:
    """Rows of ``schema``: an int or str stands in all of them, a column that isn't given is null."""
    of = lambda x, kind: pa.nulls(rows, kind) if x is None else pa.repeat(pa.scalar(x, kind), rows) if isinstance(x, int | str) else pa.array(x, kind)
    return pa.RecordBatch.from_arrays([of(columns.get(f.name), f.type) for f in schema], schema=schema)


WORDS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("codes", pa.binary()), ("code", pa.int32()), ("word", pa.string()), ("n", pa.int64())])
PAIRS = pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("code", pa.int32()), ("left", pa.int64()), ("right", pa.int64()), ("n", pa.int64())])


def blocks(df: DataFrame, lang: str, text: str) -> DataFrame:
    """A block is some BLOCK_BYTES of a task's texts of a language, or a longer text. Rows: one of block, lang and codes for each
    block, and of block, lang, code, word and n for each of its distinct words."""

    def run(batches):
        task, made, held, size = TaskContext.get().partitionId(), 0, {}, {}

        def flush(of):
            if made >> BLOCK_BITS or task >> (63 - CODE_BITS - BLOCK_BITS):
                raise OverflowError("blocks beyond their numbers: read the texts in more and smaller partitions")
            codes, words, counts = coded(held.pop(of))
            size.pop(of)
            own = {"block": task << BLOCK_BITS | made, "lang": of}
            yield sheet(WORDS, 1, **own, codes=squeezed(codes))
            yield sheet(WORDS, len(words), **own, code=np.arange(len(words)), word=words, n=counts)

        for batch in batches:
            for of, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = t.as_py().encode()
                held.setdefault(of, []).append(b)
                size[of] = size.get(of, 0) + len(b) + 1
                if size[of] >= BLOCK_BYTES:
                    yield from flush(of)
                    made += 1
        for of in sorted(held):
            yield from flush(of)
            made += 1

    rows = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("text <> ''")
    return written(rows.mapInArrow(run, "block long, lang string, codes binary, code int, word string, n long"), "blocks", ROWS)


def pairs_of(codes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's next level: its sequence of pair codes, each pair's parents by their place in ``code``, and its count. ``code``
    are the codes of this level that have a name."""
    most = int(max(codes.max(initial=-1), code.max(initial=-1))) + 1
    at = np.full(most + 1, -1, np.int64)  # the last entry is for -1
    at[code] = np.arange(len(code))
    own = at[codes]
    ok = (own[:-1] >= 0) & (own[1:] >= 0)
    keys, inverse, counts = np.unique(own[:-1][ok] * max(1, len(code)) + own[1:][ok], return_inverse=True, return_counts=True)
    out = np.full(len(codes), -1, np.int32)
    out[:-1][ok] = inverse
    stay = np.concatenate([[True], (out[1:] >= 0) | (out[:-1] >= 0)]) if len(out) else np.empty(0, bool)  # one mark is as good as many
    return out[stay], keys // max(1, len(code)), keys % max(1, len(code)), counts


def paired(sequences: DataFrame, named: DataFrame) -> DataFrame:
    """The next level's blocks, from the blocks of this one and the ids of their named codes. Rows: one of block and codes for
    each block, and of block, code, left, right and n for each of its distinct pairs; left and right are ids."""

    def run(own: pa.Table, names: pa.Table) -> pa.Table:
        if not own.num_rows or not names.num_rows:
            return PAIRS.empty_table()
        block, ids = own.column("block")[0].as_py(), names.column("id").to_numpy()
        out, left, right, counts = pairs_of(expanded(own.column("codes")[0].as_py()), names.column("code").to_numpy())
        return pa.Table.from_batches([sheet(PAIRS, 1, block=block, codes=squeezed(out)), sheet(PAIRS, len(counts), block=block, code=np.arange(len(counts)), left=ids[left], right=ids[right], n=counts)])

    both = sequences.where("codes IS NOT NULL").select("block", "codes").groupBy("block").cogroup(named.withColumnRenamed("block", "of").groupBy("of"))
    return written(both.applyInArrow(run, "block long, codes binary, code int, left long, right long, n long"), "pairs", ROWS)


def named(grams: DataFrame, by: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """The names, ``by``, n and id, of grams (``by``, block, code, n) that ``least`` occurrences or more have, and the ids of
    each block's codes."""
    place = F.shiftleft("block", CODE_BITS).bitwiseOR(F.col("code").cast("long"))
    all_places, first = Window.partitionBy(*by), F.col("place") == F.col("id")
    places = None
    for k in range(PASSES):
        some = grams.where(F.pmod(F.xxhash64(*by), F.lit(PASSES)) == k).select(*by, place.alias("place"), "n")
        found = some.withColumn("_total", F.sum("n").over(all_places)).withColumn("id", F.min("place").over(all_places)).where(F.col("_total") >= least)
        part = written(found.select("place", "id", *[F.when(first, F.col(c)).alias(c) for c in by], F.when(first, F.col("_total")).alias("n")), "names")
        places = part if places is None else places.unionByName(part)
        del some, found
        tidy(grams.sparkSession)
    code = F.col("place").bitwiseAND((1 << CODE_BITS) - 1).cast("int")
    return places.where("place = id").select(*by, "n", "id"), places.select(F.shiftright("place", CODE_BITS).alias("block"), code.alias("code"), "id")


def hierarchy(df: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, list[DataFrame]]:
    """lang and n, its word occurrences; and the names of each level: frequent words (lang, word, n, id), then frequent
    phrases of two words and more (left, right, n, id), whose parents are ids of the level before."""
    now = blocks(df, lang, text)
    totals = written(now.where("word IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    names, places = named(now.where("word IS NOT NULL").select("block", "lang", "code", "word", "n"), ["lang", "word"], least)
    levels = [names]
    for _ in range(1, longest):
        after = paired(now, places)
        discard(now)
        now = after
        tidy(df.sparkSession)
        names, places = named(now.where("code IS NOT NULL").select("block", "code", "left", "right", "n"), ["left", "right"], least)
        levels.append(names)
    discard(now)
    tidy(df.sparkSession)
    return totals, levels


def tidy(spark) -> None:
    """Let Spark remove the shuffle files of what is done. It does so once the driver's garbage is collected, which may take long
    to happen by itself: Python's references go first, then the plans that they held, then what the plans held."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def cut_counts(levels: list[DataFrame]) -> list[DataFrame]:
    """Each level's id, n and lang, with the counts of its phrases' first parts (shortest first) and of the rests after them, by
    way of the parents. Each level is written, as the next one reads it twice."""
    none = F.array().cast("array<bigint>")
    out = [levels[0].select("id", "n", "lang", none.alias("firsts"), none.alias("rests"))]
    for names in levels[1:]:
        left = out[-1].select(F.col("id").alias("left"), "lang", F.concat("firsts", F.array("n")).alias("firsts"))
        right = out[-1].select(F.col("id").alias("right"), F.concat(F.array("n"), "rests").alias("rests"))
        out.append(written(names.join(left, "left").join(right, "right").select("id", "n", "lang", "firsts", "rests"), "cuts"))
    return out


def scored(levels: list[DataFrame]) -> DataFrame:
    """lang, k, id, a, l, r and score of the phrases that no longer one subsumes, at their lowest cut.

    A phrase of k words lies in one of k + 2 only by way of one of k + 1, which is as frequent at least, so that the parents of
    the next level tell all. Decimals, as the products may pass 64 bits.
    """
    cut = F.expr("array_min(transform(arrays_zip(firsts, rests), (x, i) -> struct(cast(2000000 * cast(n AS decimal(20, 0)) div (x.firsts + x.rests) AS bigint) AS score, i AS cut, x.firsts AS l, x.rests AS r)))")
    found = None
    for k, (counts, longer) in enumerate(zip(cut_counts(levels)[1:], [*levels[2:], None], strict=True), 2):
        own = counts.select("lang", F.lit(k).alias("k"), "id", F.col("n").alias("a"), cut.alias("_cut"))
        if longer is not None:
            inside = longer.select(F.explode(F.array("left", "right")).alias("id"), "n").groupBy("id").agg(F.max("n").alias("_longer"))
            own = own.join(inside, "id", "left").where("_longer IS NULL OR 100 * cast(_longer AS decimal(20, 0)) < 80 * cast(a AS decimal(20, 0))")
        own = own.select("lang", "k", "id", "a", "_cut.l", "_cut.r", "_cut.score")
        found = own if found is None else found.unionByName(own)
    return found


def spelled(chosen: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``chosen`` with phrase. Each word goes down its own line of parents: to the left one until the phrase is as long as the
    word's place, then to the right ones."""
    at = chosen.select("k", "id", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("place"), F.col("id").alias("node")).withColumns({"size": F.col("k"), "origin": F.col("place")})
    for k in range(len(levels), 1, -1):
        here, deeper = at.where(F.col("size") == k), at.where(F.col("size") < k)
        parents = levels[k - 1].select(F.col("id").alias("node"), "left", "right")
        left = F.col("place") < k
        down = parents.join(small(here), "node").select("k", "id", F.when(left, F.col("place")).otherwise(F.col("place") - 1).alias("place"), F.when(left, F.col("left")).otherwise(F.col("right")).alias("node"), F.lit(k - 1).alias("size"), "origin")
        at = deeper.unionByName(down)
    words = levels[0].select(F.col("id").alias("node"), "word").join(small(at), "node").select("k", "id", "origin", "word")
    phrase = words.groupBy("k", "id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("origin", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return chosen.join(phrase, ["k", "id"])


def mine(df: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases of two to ``longest`` words.

    a, l and r count the phrase, its first part and the rest at the cut of lowest score floor(2000000 * a / (l + r)), the
    first one of equals; n counts the language's words. Phrases that lie in a longer one with 80 in 100 of their occurrences
    or more, reported or not, are left out. Order: score and a falling, phrase rising by its bytes. Only phrases whose score and
    a can be among the first are spelled out, all of equals.

    A null language is ``und``; null and empty texts, and words that never occur ``least`` times, yield nothing but their
    count in n; repeated rows count as often as they occur; other columns are ignored, whatever their names. An empty table
    gives an empty result.
    """
    totals, levels = hierarchy(df, lang, text, longest, least)
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    chosen = written(scored(levels).withColumn("_rank", F.rank().over(by)).where(F.col("_rank") <= top).drop("_rank"), "chosen")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = spelled(chosen, levels).withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(small(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
