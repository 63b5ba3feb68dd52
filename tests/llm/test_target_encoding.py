import random
import zlib
from datetime import datetime, timedelta

import pytest
from lumenary.llm import target_encoding as TE


def brute(lines, sales, items, vendors, clients, gap):
    """Every line against every other one."""
    kind, nation, segment = ({k: min((str(b) for a, b in rows if a == k and b is not None), default=None) for k, _ in rows} for rows in (items, vendors, clients))
    joined = []
    for sale, item, vendor, flag in lines:
        for s, client, sold in sales:
            if s == sale and sale is not None and sold is not None:
                i, c = (-1 if x is None else x for x in (item, client))
                joined.append((sale, i, vendor, flag == "returned", c, sold, zlib.crc32(str(sale).encode()) % 5, kind.get(i), nation.get(vendor), segment.get(c)))

    def rate(n, s, p):
        return p if n < 1 else (1000000 * s + 50 * p) // (n + 50)

    out = {}
    for x in joined:
        key = (x[0], x[1], x[2], x[4], x[5])
        if key in out:
            continue
        past = [y for y in joined if y[6] != x[6] and (x[5] - y[5]).total_seconds() > gap]
        count = lambda at: (sum(y[at] == x[at] for y in past), sum(y[3] for y in past if y[at] == x[at]))  # noqa: E731, B023
        base = rate(len(past), sum(y[3] for y in past), 500000)
        own = [y for y in joined if (y[0], y[1], y[2], y[4], y[5]) == key]
        row = [len(own), sum(y[3] for y in own)]
        for at, of in ((1, 7), (2, 8), (4, 9)):
            n, s = count(at)
            row += [n, rate(n, s, rate(*count(of), base))]
        out[key] = tuple(row)
    return sorted(((k[:3], v) for k, v in out.items()), key=repr)


def tables(r, n, hot):
    start = datetime(2024, 1, 1)
    times = [start + timedelta(seconds=r.choice([0, 1, 2, 3600, 86400]) * r.randint(0, 9), microseconds=r.choice([0, 1, 500000])) for _ in range(12)]
    sales = [(i, r.choice([None, 0, 1, 2, 7]), r.choice([None, *times])) for i in range(25)] + [(None, 1, start)]
    lines = [(r.choice([*range(28), None, *[3] * hot]), r.choice([None, *range(6), *[2] * hot]), r.choice([None, 0, 1, 2]), r.choice(["returned", "kept", None])) for _ in range(n)]
    items = [(0, "x"), (1, "y"), (2, "x"), (3, None), (4, "z"), (4, "a")]
    return lines, sales, items, [(0, 5), (1, None), (9, 1)], [(0, "s"), (1, None), (2, "t")]


def encoded(spark, data, **options):
    kinds = ("sale_id long, item_id long, vendor_id long, flag string", "sale_id long, client_id long, sold_at timestamp_ntz", "item_id long, kind string", "vendor_id long, nation_id int", "client_id long, segment string")
    frames = [spark.createDataFrame(rows, kind).repartition(3) for rows, kind in zip(data, kinds, strict=True)]
    frames[0] = frames[0].selectExpr("*", "1 AS slice", "2 AS t", "3 AS fold", "4 AS n")
    got = TE.encode(*frames, **options).collect()
    return sorted((((x.sale_id, x.item_id, x.vendor_id), tuple(x[c] for c in TE.RESULT[3:])) for x in got), key=repr)


@pytest.mark.parametrize("seed, gap, rows, span, hot", [(1, 0, 100_000, 1024, 0), (2, 0, 5, 2, 6), (3, 3600, 6, 1, 3), (4, 1, 20, 3, 0)])
def test_against_every_pair_of_lines(spark, monkeypatch, seed, gap, rows, span, hot):
    monkeypatch.setattr(TE, "SPAN", span)
    data = tables(random.Random(seed), 220, hot)
    assert encoded(spark, data, gap=gap, rows=rows) == brute(*data, gap)


def test_repeated_sales_pair_as_a_join_does(spark):
    t = datetime(2024, 1, 1)
    data = ([(1, 1, 1, "returned")] * 2, [(1, 1, t), (1, 2, t), (1, 1, t)], [], [], [])
    assert encoded(spark, data) == [((1, 1, 1), (2, 2, 0, 500000, 0, 500000, 0, 500000)), ((1, 1, 1), (2, 2, 0, 500000, 0, 500000, 0, 500000)), ((1, 1, 1), (2, 2, 0, 500000, 0, 500000, 0, 500000))]


def test_empty_tables(spark):
    assert encoded(spark, ([], [], [], [], [])) == [] and encoded(spark, ([(1, 1, 1, "kept")], [], [], [], [])) == []


def test_slices_hold_whole_times_and_bounded_rows(spark):
    r = random.Random(5)
    counts = {r.randint(0, 10**13): r.choice([1, 2, 3, 500]) for _ in range(400)}
    found = sorted((x.t, x.slice, x.chunks) for x in TE.slices(spark.createDataFrame(sorted(counts.items()), "t long, c long").repartition(4), 100).collect())
    assert [t for t, _, _ in found] == sorted(counts) and [s for _, s, _ in found] == sorted(s for _, s, _ in found)
    sizes = {}
    for t, s, chunks in found:
        sizes[s] = sizes.get(s, 0) + counts[t]
        assert chunks == (5 if counts[t] == 500 else 1)
    assert all(n < 200 or n == 500 for n in sizes.values())
