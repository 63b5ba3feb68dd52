import random
import re
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from lumenary.llm import collocations


def brute(rows, longest, least, top):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in candidates.items():
            if any(100 * b >= 80 * a for h, b in candidates.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))):
                continue
            score, _, left, right = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("size, top", [(1 << 20, 2000), (200, 7)])
def test_against_brute_force(spark, monkeypatch, size, top):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", size)
    r = random.Random(size)
    words = ["a", "B", "c", "D", "é", "É", "　x", "a b", "😀", "ab"]
    phrases = ["new york city hall", "a a a a", "of the", "x y z"]
    rows = []
    for _ in range(120):
        parts = [r.choice(r.choice([words, phrases])) + r.choice([" ", "\t", "  ", ". ", "\n", ",", ""]) for _ in range(r.randint(0, 40))]
        rows.append((r.choice(["en", "und", None, ""]), "".join(parts)))
    rows += [("en", None), (None, ""), ("only", "..,, \n"), ("long", "u v w " * 5000), ("long", "u v w"), ("long", "u v w")]
    df = spark.createDataFrame([(i, t, la, "x", 7) for i, (la, t) in enumerate(rows)], "doc_id long, text string, lang string, word string, n int").repartition(4)
    got = [tuple(x[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for x in collocations.mine(df, least=5, top=top).collect()]
    want = brute(rows, 4, 5, top)
    assert sorted(got) == want and len(want) > 15


def test_ties_are_kept_whole_and_empty_tables_are_empty(spark):
    df = spark.createDataFrame([(1, "p q. r s. t u. " * 3, "en")], "doc_id long, text string, lang string")
    assert [(x.rank, x.phrase) for x in collocations.mine(df, least=3, top=2).orderBy("rank").collect()] == [(1, "p q"), (2, "r s")]
    assert collocations.mine(df.limit(0)).count() == 0 and collocations.mine(df, least=100).count() == 0


def test_what_is_read_at_once_does_not_grow_with_the_blocks_of_a_file(spark, monkeypatch):
    """A block's words and pairs lay in one row; with all rows of a file read at once, a dozen blocks took an executor's memory."""
    kept, written = {}, collocations.written

    def spy(df, name, *options):
        kept.setdefault(name, []).append(out := written(df, name, *options))
        return out

    for name, value in (("written", spy), ("discard", lambda *_: None), ("BLOCK_BYTES", 4000), ("ROWS", getattr(collocations, "ROWS", {}) | {"parquet.block.size": 1 << 16})):
        monkeypatch.setattr(collocations, name, value, raising=False)
    r = random.Random(3)
    rows = [(" ".join(f"w{r.randrange(200)}" for _ in range(1000)), la) for la in ["en"] * 70 + [None] * 10]
    collocations.hierarchy(spark.createDataFrame(rows, "text string, lang string").coalesce(1), least=2, longest=3)
    assert len(kept["blocks"]) == 1 and len(kept["pairs"]) == 2
    for table in kept["blocks"] + kept["pairs"]:
        assert not [f.name for f in table.schema if f.dataType.typeName() == "array"]
        assert table.where("codes IS NOT NULL").count() == table.select("block").distinct().count() >= 80
    assert kept["blocks"][0].where("word IS NOT NULL").groupBy("block", "code").count().where("count > 1").count() == 0
    of_pairs = [pq.ParquetFile(f).metadata for f in Path(kept["pairs"][0]._written_at.removeprefix("file://")).glob("*.parquet")]
    groups = [m.row_group(k).total_byte_size for m in of_pairs for k in range(m.num_row_groups)]
    assert max(m.num_row_groups for m in of_pairs) > 1 and max(groups) < 3 << 16
