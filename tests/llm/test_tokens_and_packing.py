import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from lumenary.llm import bpe, packing
from pyspark.sql import functions as F
from tokenizers import Tokenizer

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(MULTI), special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("ab1 '\n\t!strvelmd中　\xa0'é😀٣")), st.characters(codec="utf-8")), max_size=60), min_size=1, max_size=5))
def test_encoding_is_tiktokens(reference, texts):
    got = [np.frombuffer(p, "<u4").tolist() for p in bpe.encoder(MULTI).encode_packed(texts)]
    assert got == [reference.encode_ordinary(t) for t in texts]
    enc = bpe.encoder(MULTI)
    assert [enc.decode(np.array(i, np.int64), enc.offsets(np.array(i, np.int64))) for i in got] == [t.encode() for t in texts]


def test_long_runs_and_offsets(reference):
    r = random.Random(1)
    enc = bpe.encoder(MULTI)
    for t in ("a" * 30_000, " " * 30_000 + "x", "中" * 10_000, "'s" * 5_000, "!" * 10_000, "".join(r.choices("aeinrst", k=5_000)), "".join(r.choices("éж中a", k=200))):
        [packed] = enc.encode_packed([t])
        ids = np.frombuffer(packed, "<i4")
        assert ids.tolist() == reference.encode_ordinary(t)
        offsets = enc.offsets(ids)
        cut = len(ids) // 2
        raw = t.encode()
        assert enc.decode(ids, offsets) == raw and enc.decode(ids[cut:], offsets[cut:] - offsets[cut]) == raw[offsets[cut] :]
        with pytest.raises(ValueError):
            enc.decode(ids, offsets + 1)


def test_both_ways_of_merging_agree():
    r = random.Random(2)
    ranks = bpe.load_ranks(MULTI)
    for _ in range(300):
        raw = "".join(r.choices("abcdeinrst 中é", k=r.randint(2, 90))).encode()
        assert bpe.merge_long(raw, ranks) == bpe.merge_short([raw[i : i + 1] for i in range(len(raw))], ranks)


def test_columns(spark, reference):
    rows = [(1, "Hello, it's we'll 42.", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(df, MULTI), MULTI).orderBy("doc_id").collect()
    assert [bytes(r.decoded) for r in got] == [b"Hello, it's we'll 42.", b"", b"", b""]
    assert got[0].ids == reference.encode_ordinary(rows[0][1])
    d = bpe.digests(df, MULTI).orderBy("doc_id").collect()
    assert [r.n_tokens for r in d] == [len(got[0].ids), 0, 0, 0] and d[1].ids_sha256 == d[1].decoded_sha256
    assert bpe.encode(df.limit(0), MULTI).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plan_fills_without_gaps(counts):
    slots, at, ranks = packing.plan(counts, 64), {}, Counter()
    for length, a, b, s, o in slots:
        ranks[length] += b - a
        for k in range(b - a):
            at.setdefault(s + k, []).append((o, length))
    assert dict(ranks) == counts
    for v in at.values():
        end = 0
        for o, n in sorted(v):
            assert o == end
            end += n
        assert end <= 64
    rooms: list[int] = []  # best fit, decreasing, document by document
    for n in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(64 - n)
        else:
            rooms[rooms.index(fit)] -= n
    assert len(at) == len(rooms)


def test_packing_against_the_tokenizer(spark):
    r = random.Random(4)
    texts = [" ".join(r.choices(["alpha", "beta's", "12", "gamma!", "é"], k=r.choice([0, 1, 5, 200, 3000]))) for _ in range(60)] + [None, "", "<|endoftext|>", "end <|endoftext|> of", "a<|endoftext|><|endoftext|>\n<|endoftext|b"]
    tok = Tokenizer.from_file(JSON)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, offset int").repartition(4)
    got = packing.pack_documents(df, JSON).collect()
    want = {}
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, p] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in filled.values():
        end = 0
        for o, n in sorted(v):
            assert o == end
            end += n
        assert end <= 2048
    assert packing.pack_documents(df.limit(0), JSON).count() == 0


def test_hot_length_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_ROWS", 50)
    df = spark.range(600).select((F.col("id") % 200).alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 3 == 0, 700).otherwise(1348).cast("long").alias("length"))
    got = packing.pack(df).collect()
    assert len(got) == 600 and len({(r.sequence_id, r.offset) for r in got}) == 600 and len({r.sequence_id for r in got}) == 400
