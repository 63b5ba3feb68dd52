"""Time-ordered target encoding: rates of returned lines among a line's history, out of fold, by time-major snapshots.

Time is cut into slices of about as many rows each. For every key that occurs in a slice, the cumulative state at the slice's
start, a count and a sum of each fold, is written; then all slices replay in parallel, each from its own snapshot, with hash
maps of the states and two pointers over the rows in time order: one at the row that asks, one at the rows whose delay has
passed and which are released to the state. A slice holds a bounded number of rows, so replaying takes bounded memory.

Nothing that grows with the input passes through one task, the driver or a broadcast. How many rows precede a time comes
from sums over the digits of the time, so that no window has more siblings than a digit has values; a time that has more rows
than a slice is a slice of its own, in chunks, which all start from the same state; a key's running state goes by spans of
slices, and only the spans' sums run over all of time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: Rows of a slice, slices of a span, folds, and the weight of a prior.
SLICE_ROWS, SPAN, FOLDS, WEIGHT, MILLION = 100_000, 1024, 5, 50, 1_000_000
IDS = ("item_id", "vendor_id", "client_id")
COUNTERS = [f"{c}{f}" for c in "ns" for f in range(FOLDS)]
ALL = 2 * len(IDS)


def micros(time: Column, kind: str) -> Column:
    """Microseconds since 1970; of a time without a zone, as its clock shows them, whatever the session's zone."""
    if kind == "timestamp_ntz":
        since = (time - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")).cast("interval second")
        return (since.cast("decimal(20,6)") * MILLION).cast("long")
    return F.unix_micros(time)


def outcomes(lines: DataFrame, sales: DataFrame) -> DataFrame:
    """A row of each sale, item and vendor: own counts n and s, the client, fold and time. Lines are summed up before the
    join, whose sides come straight from a shuffle, so that Spark can split a hot sale."""
    item, client = F.coalesce("item_id", F.lit(-1)), F.coalesce("client_id", F.lit(-1))
    own = lines.where("sale_id IS NOT NULL").groupBy("sale_id", item.cast("long").alias("item_id"), F.col("vendor_id").cast("long").alias("vendor_id")).agg(F.count("*").alias("n"), F.sum((F.coalesce("flag", F.lit("")) == "returned").cast("long")).alias("s"))
    sold = sales.where("sale_id IS NOT NULL AND sold_at IS NOT NULL").select("sale_id", client.cast("long").alias("client_id"), micros(F.col("sold_at"), sales.schema["sold_at"].dataType.typeName()).alias("t"))
    fold = F.crc32(F.col("sale_id").cast("string").cast("binary")) % FOLDS
    return own.join(sold, "sale_id").withColumn("fold", fold.cast("int"))


def running(by: list[str] | list[Column], order: str) -> Column:
    """The sum of c over earlier rows."""
    return F.coalesce(F.sum("c").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def slices(ticks: DataFrame, rows: int = SLICE_ROWS) -> DataFrame:
    """slice and chunks of each t of ``ticks`` (t distinct, and c, its rows). Slices are numbered in the order of time and
    hold whole times: a time of more than ``rows`` rows is one by itself, of several chunks, any other has less than twice
    ``rows``.

    The rows before a time are counted by three digits of the time since the first one: those of its siblings with a smaller
    last digit, then with a smaller middle digit, then with a smaller first one. A digit has a cube root of the covered
    microseconds as values, which bounds each window, and the first digits' table, which is broadcast.
    """
    low, high = ticks.agg(F.min("t"), F.max("t")).first()
    bits = max(1, -(-((high or 0) - (low or 0)).bit_length() // 3))
    last = ticks.withColumn("_off", F.col("t") - F.lit(low or 0)).withColumn("_b", F.shiftright("_off", bits))
    middle = last.groupBy("_b").agg(F.sum("c").alias("c")).withColumn("_a", F.shiftright("_b", bits))
    first = middle.groupBy("_a").agg(F.sum("c").alias("c"))
    firsts = F.broadcast(first.select("_a", running([F.lit(0)], "_a").alias("_before_a")))
    middles = middle.select("_a", "_b", running(["_a"], "_b").alias("_before_b")).join(firsts, "_a").select("_b", (F.col("_before_a") + F.col("_before_b")).alias("_before"))
    placed = last.select("t", "_b", "c", running(["_b"], "_off").alias("_before_t")).join(middles, "_b")
    number = F.floor((F.col("_before") + F.col("_before_t")) / rows).cast("long")
    return placed.select("t", (2 * number + (F.col("c") > rows).cast("long")).alias("slice"), F.when(F.col("c") > rows, F.ceil(F.col("c") / rows)).otherwise(1).cast("int").alias("chunks"))


def events(rows: DataFrame, gap: int) -> DataFrame:
    """Rows as they ask and as they tell: at once without a gap, else once as they ask and once as they are released."""
    if not gap:
        return rows.withColumns({"asks": F.lit(True), "tells": F.lit(True)})
    asking = rows.withColumns({"asks": F.lit(True), "tells": F.lit(False)})
    return asking.unionByName(rows.withColumns({"t": F.col("t") + gap * MILLION, "asks": F.lit(False), "tells": F.lit(True)}))


def deltas(tape: DataFrame, attributes: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The ids' part, which is written, and all of what each slice (and chunk) adds to the state of each of seven columns: the ids with their attribute in name, the
    attributes, and all rows. ``attributes`` have id and name, each id once."""
    told = lambda c, f: F.sum(F.when(F.col("tells") & (F.col("fold") == f), F.col(c)).otherwise(0)).alias(f"{c}{f}")
    sums = [told(c, f) for c in "ns" for f in range(FOLDS)]
    place = ["slice", "chunk"]
    ids = None
    for k, (key, names) in enumerate(zip(IDS, attributes, strict=True)):
        own = tape.groupBy(F.col(key).alias("key"), *place).agg(*sums)
        own = own.join(names.select(F.col("id").alias("key"), "name"), "key", "left").select(F.lit(k).alias("col"), "key", "name", *place, *COUNTERS)
        ids = own if ids is None else ids.unionByName(own)
    ids = written(ids, "deltas")
    again = [F.sum(c).alias(c) for c in COUNTERS]
    named = ids.groupBy((F.col("col") + len(IDS)).alias("col"), "name", *place).agg(*again).withColumn("key", F.lit(None).cast("long"))
    every = named.where(F.col("col") == len(IDS)).groupBy(*place).agg(*again).withColumns({"col": F.lit(ALL), "key": F.lit(None).cast("long"), "name": F.lit(None).cast("string")})
    return ids, ids.unionByName(named).unionByName(every)


def snapshots(delta: DataFrame) -> DataFrame:
    """The state of each key of a slice at the slice's start: the sums of what earlier slices add.

    They run within spans of slices; what earlier spans add comes in as one more row, ahead of the span.
    """
    key = ["col", "key", "name"]
    spanned = delta.withColumns({"span": F.floor(F.col("slice") / SPAN).cast("long"), "real": F.lit(True)})
    before = Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sums = spanned.groupBy(*key, "span").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    carried = sums.select(*key, "span", *[F.sum(c).over(before).alias(c) for c in COUNTERS]).where("n0 IS NOT NULL")
    carried = carried.withColumns({"slice": F.col("span") * SPAN - 1, "chunk": F.lit(0), "real": F.lit(False)})
    earlier = Window.partitionBy(*key, "span").orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    state = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in COUNTERS]
    return spanned.unionByName(carried.select(spanned.columns)).select(*key, "slice", "chunk", "real", *state).where("real").drop("real")


def rate(n: np.ndarray, s: np.ndarray, prior: np.ndarray | int) -> np.ndarray:
    return np.where(n < 1, prior, (MILLION * s + WEIGHT * prior) // (n + WEIGHT))


RESULT = ["sale_id", "item_id", "vendor_id", "n_lines", "n_returned", "item_n", "item_rate", "vendor_n", "vendor_rate", "client_n", "client_rate"]


def replay(rows: pa.Table, state: pa.Table) -> pa.Table:
    """A slice's rows in the order of time, from the states at its start.

    Every key of any column has a slot, found by a hash map; a row has seven: its ids, their attributes, and that of all
    rows. Rows that tell are released once their time lies before that of the row that asks.
    """
    col, keys, names = (state.column(c).to_pylist() for c in ("col", "key", "name"))
    slot = {(c, k if c < len(IDS) else m): i for i, (c, k, m) in enumerate(zip(col, keys, names, strict=True))}
    folds = np.column_stack([state.column(c).to_numpy() for c in COUNTERS]).astype(np.int64).reshape(-1, 2, FOLDS)
    count, total = folds[:, 0].sum(axis=1).tolist(), folds[:, 1].sum(axis=1).tolist()
    count_of, total_of = folds[:, 0].ravel().tolist(), folds[:, 1].ravel().tolist()
    every = slot.get((ALL, None), 0)
    columns = []
    for c, key in enumerate(IDS):
        own = [slot[c, k] for k in rows.column(key).to_pylist()]
        columns += [own, [slot[c + len(IDS), names[i]] for i in own]]
    slots = list(zip(*columns, [every] * rows.num_rows, strict=True))
    time, fold, n, s = (rows.column(c).to_pylist() for c in ("t", "fold", "n", "s"))
    order = np.argsort(rows.column("t").to_numpy(), kind="stable")
    asks, tells = (order[rows.column(c).to_numpy()[order]].tolist() for c in ("asks", "tells"))
    seen, at = [], 0
    for i in asks:
        while at < len(tells) and time[tells[at]] < time[i]:
            k = tells[at]
            at += 1
            f, a, b = fold[k], n[k], s[k]
            for g in slots[k]:
                count[g] += a
                total[g] += b
                count_of[FOLDS * g + f] += a
                total_of[FOLDS * g + f] += b
        f = fold[i]
        for g in slots[i]:
            seen.append(count[g] - count_of[FOLDS * g + f])
            seen.append(total[g] - total_of[FOLDS * g + f])
    found = np.array(seen, np.int64).reshape(-1, ALL + 1, 2)
    own = rows.take(pa.array(asks, pa.int64()))
    base = rate(found[:, ALL, 0], found[:, ALL, 1], MILLION // 2)
    out = [own.column(c) for c in ("sale_id", "item_id", "vendor_id", "n", "s")]
    for c in range(len(IDS)):
        (n_id, s_id), (n_at, s_at) = found[:, 2 * c].T, found[:, 2 * c + 1].T
        out += [pa.array(n_id), pa.array(rate(n_id, s_id, rate(n_at, s_at, base)))]
    return pa.Table.from_arrays(out, RESULT)


def attribute(df: DataFrame, key: str, name: str) -> DataFrame:
    """id and name; of several rows of an id, the least name counts."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(F.col(name).cast("string")).alias("name"))


def encode(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, gap: int = 0, rows: int = SLICE_ROWS) -> DataFrame:
    """Counts and rates, in millionths, of returned lines in the history of each sale's lines of an item and a vendor.

    The history of a line are the lines of sales of other folds (crc32 of the sale's id, modulo 5) that were sold more than
    ``gap`` seconds earlier. Of those with the line's item, vendor or client, n is the count; the rate smooths their share
    of returned ones towards that of the item's kind, the vendor's nation or the client's segment, which in turn is smoothed
    towards that of all history, and this towards a half.

    Lines of no sale, or of one without a time, are left out; a null item or client is -1, an ordinary id; a null vendor is an
    id too. Ids without an attribute share one unknown value. Repeated lines count as often as they occur; a sale that
    occurs several times pairs its lines with each of its rows, as a join does. Lines of one time don't see each other. Other
    columns are ignored. Empty tables give an empty result.
    """
    base = written(outcomes(lines, sales), "outcomes")
    timed = events(base, gap)
    planned = slices(timed.groupBy("t").agg(F.count("*").alias("c")), rows)
    chunk = F.pmod(F.xxhash64("sale_id", "item_id", "vendor_id"), F.col("chunks")).cast("int")
    tape = written(timed.join(planned, "t").withColumn("chunk", chunk).drop("chunks"), "tape")
    discard(base)
    ids, delta = deltas(tape, [attribute(items, "item_id", "kind"), attribute(vendors, "vendor_id", "nation_id"), attribute(clients, "client_id", "segment")])
    state = written(snapshots(delta), "snapshots").withColumnsRenamed({"slice": "_slice", "chunk": "_chunk"})
    discard(ids)
    both = tape.groupBy("slice", "chunk").cogroup(state.groupBy("_slice", "_chunk"))
    return both.applyInArrow(replay, ", ".join(f"{c} long" for c in RESULT))
