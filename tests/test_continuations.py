import random

from lumenary.operators import continuations as C

SCHEMA = "document_id long, table_id string, continuation_of string, pages array<int>, headers array<string>, rows array<array<string>>, spans array<string>, footnotes array<string>"


def plain(fragments):
    """Problems of one document's fragments, and its merged tables, by following the pointers one by one."""
    ids = [f[1] for f in fragments]
    if len(set(ids)) < len(ids):
        return {(i, "duplicate_id") for i in ids if ids.count(i) > 1}, {}
    by, wrong = {f[1]: f for f in fragments}, set()
    parent = {f[1]: f[2].strip() for f in fragments if f[2] and f[2].strip()}
    wrong |= {(i, "unknown_parent") for i, p in parent.items() if p not in by}
    parent = {i: p for i, p in parent.items() if p in by}
    wrong |= {(p, "branch") for p in by if list(parent.values()).count(p) > 1}
    page = {i: next(iter(set(f[3]))) if len(set(f[3])) == 1 else None for i, f in by.items()}
    chains = {}
    for i in by:
        path = [i]
        while path[-1] in parent and parent[path[-1]] not in path:
            path.append(parent[path[-1]])
        if path[-1] in parent:
            wrong.add((i, "cycle"))
        else:
            chains.setdefault(path[-1], []).append((len(path), i))
            if by[i][4] != by[path[-1]][4]:
                wrong.add((i, "header_mismatch"))
    wrong |= {(i, "source_page") for i in {*parent, *parent.values()} if page[i] is None}
    wrong |= {(i, "page_gap") for i, p in parent.items() if page[i] is not None and page[p] is not None and page[i] != page[p] + 1}
    if wrong:
        return wrong, {}
    out = {}
    for root, chain in chains.items():
        rows, origins, skipped, spans, notes = [], [], 0, [], []
        for depth, i in sorted(chain):
            f = by[i]
            skip = int(depth > 1 and bool(f[5]) and f[5][0] == f[4])
            skipped += skip
            rows += f[5][skip:]
            origins += [(i, page[i], k + 1) for k in range(skip, len(f[5]))]
            spans += [x for x in dict.fromkeys(f[6]) if x not in spans]
            notes += [x for x in dict.fromkeys(map(str.strip, f[7])) if x and x not in notes]
        out[root] = ([i for _, i in sorted(chain)], rows, origins, skipped, spans, notes, "cross_page_merged" if len(chain) > 1 else "single")
    return set(), out


def test_random_graphs(spark):
    r, fragments = random.Random(8), []
    for d in range(90):
        n, clean = r.randint(1, 12), d % 3
        ids = [f"t{i}" for i in range(n)]
        for i, t in enumerate(ids):
            to = (ids[i - 1] if i and r.random() < 0.7 else None) if clean else r.choice([None, " ", r.choice(ids), "absent" if r.random() < 0.2 else ids[i - 1] if i else None])
            headers = ["a", "b"] if clean or r.random() < 0.9 else ["c"]
            pages = [i, i] if clean or r.random() < 0.9 else r.choice([[i, i + 1], [i + 1], []])
            rows = ([headers] if r.random() < 0.4 else []) + [[str(r.randint(0, 9)), t] for _ in range(r.randint(0, 3))]
            fragments.append((d, t if clean or r.random() < 0.99 else "t0", to, pages, headers, rows, r.choices(["s", "u", t], k=2), r.choices(["", " n", "n", t], k=2)))
    df = spark.createDataFrame(fragments, SCHEMA).repartition(3)
    wrong, tables = {}, {}
    for x in C.problems(df).collect():
        wrong.setdefault(x.document_id, []).append((x.table_id, x.code))
    for x in C.merged(df).collect():
        tables.setdefault(x.document_id, {})[x.table_id] = (x.table_ids, x.rows, [tuple(o) for o in x.origins], x.n_repeated_headers, x.spans, x.footnotes, x.status)
    seen = set()
    for d in range(90):
        want, out = plain([f for f in fragments if f[0] == d])
        assert sorted(wrong.get(d, [])) == sorted(want), d
        assert tables.get(d, {}) == out, d
        seen |= {c for _, c in want}
    assert seen == set(C.CODES)


def test_a_long_chain_and_an_empty_table(spark):
    n = 300
    df = spark.createDataFrame([(1, f"t{i}", f"t{i - 1}" if i else None, [i], ["h"], [["x"]], [], []) for i in range(n)], SCHEMA)
    (row,) = C.ordered(C.merged(df)).collect()
    assert row.table_ids == [f"t{i}" for i in range(n)] and len(row.rows) == n and row.position == 1
    assert C.problems(df.limit(0)).count() == 0 and C.merged(df.limit(0)).count() == 0
