import random

from lumenary.operators import packs as P
from lumenary.plans import packs as plans

QUESTIONS = {0: "what is it", 1: "Table 2: tion", 2: "Summarize tion", 3: "formula of tion", 4: "accuracy of tion"}


def plain_pack(rows, question):
    """The stages one piece at a time: sort, reserve, skip repeats and full pages, then fill the places."""
    table_query = question.startswith(("Table", "accuracy"))
    canonical = table_query and any(r["kind"] == "table" and r["parse_version"] not in (None, "legacy") for r in rows)
    limit = 24 if canonical else 8
    key = lambda t: "".join(c for c in t.lower() if c.isalnum())

    def relevance(r):
        return (100 if question.startswith("Table") and "table2" in key(r["text"]) else 0) + (3 if "tion" in key(r["text"]) else 0) if table_query else 0

    def rank(r):
        structure = 0
        if table_query and r["kind"] == "table":
            structure = 3 if question.startswith("Table") and "table 2" in r["text"].lower() else 2
        elif not table_query and r["kind"] == "formula" and question.startswith("formula"):
            structure = 4
        return (-structure, -relevance(r), -(table_query and r["kind"] == "table"), -r["score"], r["chunk_id"])

    rows = sorted(rows, key=rank)
    if table_query:
        groups = {}
        for r in rows:
            if r["block_type"] == "table" and r["table_id"]:
                groups.setdefault((r["document_id"], r["parse_version"], r["table_id"]), []).append(r)
        matched = [g for g in groups.values() if max(map(relevance, g)) > 0]
        if len(matched) > 1:
            best = [(max(map(relevance, g)), min(g, key=lambda r: (-relevance(r), -r["score"], r["chunk_id"]))) for g in matched]
            front = [r for _, r in sorted(best, key=lambda x: (-x[0], -x[1]["score"], x[1]["chunk_id"]))][: min(P.RESERVED, limit)]
            rows = front + [r for r in rows if r not in front]
    kept, seen, pages = [], set(), {}
    for r in rows:
        text = " ".join(r["text"].split())[:180]
        k = (r["page"] or str(r["document_id"]), r["label"], r["kind"] == "table", r["chunk_id"] if r["kind"] == "table" else text)
        if k in seen:
            continue
        if r["page"]:
            if r["kind"] != "profile-term" and pages.get(r["page"], 0) >= (limit if table_query else P.PER_PAGE):
                continue
            pages[r["page"]] = pages.get(r["page"], 0) + 1
        kept.append(r)
        seen.add(k)
    if len(kept) <= limit:
        return kept
    required = [m for kind in P.SLOTS if not (canonical and kind == "profile-term") and (m := next((r for r in kept if r["kind"] == kind), None))]
    final = []
    if not canonical:
        covered = set()
        for r in sorted((r for r in kept if r["kind"] == "profile-term"), key=lambda r: -r["score"]):
            if len(final) < limit and set(r["anchors"]) - covered:
                final.append(r)
                covered |= set(r["anchors"])
    lead = list(final)
    for r in kept:
        missing = [x for x in required if x not in final]
        if r not in final and len(final) < limit and (r in required or len(missing) <= limit - len(final) - 1):
            final.append(r)
    assert all(x in final for x in required) or len(lead) + len(required) > limit
    return final


def test_packs_against_one_piece_at_a_time(spark):
    r = random.Random(3)
    rows = []
    for q in range(200):
        for i in range(r.choice([0, 3, 9, 40])):
            kind = r.choices(["table", "figure", "formula", "profile-term", "text"], [r.choice([0, 2]), 1, 1, r.choice([0, 2]), 5])[0]
            version = r.choice([None, "legacy", "v1", "v1"])
            text = " ".join(r.choices(["tion", "Table 2", "ver", "a", "  b"], k=r.randint(1, 4)))
            anchors = r.sample(["x", "y", "z"], r.randint(0, 2)) if kind == "profile-term" else []
            document = r.randint(0, 3)
            rows.append((q, f"c{i:02}", document, version, r.choice([f"t{r.randint(0, 1)}", None]) if kind == "table" else None, "table" if kind == "table" else "narrative", kind, r.choice([None, "p", "q"]), r.choice([None, "1"]), text, float(r.randint(0, 30)) + i / 100, anchors))
    columns = "query_id long, chunk_id string, document_id long, parse_version string, table_id string, block_type string, kind string, page string, label string, text string, score double, anchors array<string>"
    contexts = spark.createDataFrame(rows, columns).repartition(5)
    asked = spark.createDataFrame([(q, QUESTIONS[q % 5]) for q in range(200)], "query_id long, question string")
    got = {}
    for x in P.finalised(contexts, asked).orderBy("query_id", "position").collect():
        got.setdefault(x.query_id, []).append(x.chunk_id)
    names = [c.split()[0] for c in columns.split(", ")]
    for q in range(200):
        own = [dict(zip(names, x, strict=True)) for x in rows if x[0] == q]
        assert got.get(q, []) == [x["chunk_id"] for x in plain_pack(own, QUESTIONS[q % 5])], q


def piece(i, prompt, excerpt="", parent=None, table=False, score=1.0):
    return {"chunk_id": f"c{i}", "prompt": prompt, "excerpt": excerpt or prompt, "parent_chunk_id": parent, "is_table": table, "score": score}


def test_a_budget_skips_and_goes_on():
    size = lambda t: len(t.split())
    big, small = piece(0, "w " * 30, "short excerpt here", "p0"), piece(1, "x y z", parent="p1")
    got = P.fit([big, piece(2, "v " * 40, "u " * 40), small], "", False, 12, size)
    assert [(p["chunk_id"], form) for p, form, _ in got] == [("c0", "excerpt"), ("c1", "full")]
    # Seven parents: the last one is shown as its excerpt only; a second child of a known parent isn't one more.
    many = [piece(i, f"long text number {i}", f"excerpt {i}", f"p{i}") for i in range(7)] + [piece(9, "again first", "x", "p0")]
    assert [form for _, form, _ in P.fit(many, "", False)] == ["full"] * 6 + ["excerpt", "full"]


def test_tables_come_first_and_are_not_rescued():
    rows = [piece(0, "prose about gain", score=9.0), piece(1, "row gain 3", table=True), piece(2, "row loss 4", table=True, score=5.0)]
    assert [p["chunk_id"] for p, _, _ in P.fit(rows, "what gain", True)] == ["c1", "c2", "c0"]
    size = lambda t: len(t)
    long = "a " * 300 + "the side-chain holds 12.5 % of it " + "b " * 300
    assert P.fit([piece(0, long, table=True)], "side", False, 450, size) == []
    (_, form, text), = P.fit([piece(0, long)], "side", False, 450, size)
    assert form == "rescued" and len(text) == P.RESCUED and "side-chain" in text and "12.5 %" in text
    assert P.rescued("nothing to hold on to", "q") == "" and P.fit([piece(0, "z" * 900)], "", False, 450, size) == []


def test_overlap_is_left_out_once():
    assert P.without_overlap("one two three four", ["zero one two three"]) == "four"
    assert P.without_overlap("one two three", ["one two three"]) == "one two three"
    assert P.without_overlap("abcdefghij", ["xxabcdefgh"]) == "ij" and P.without_overlap("abcdefg", ["abcdefg"]) == "abcdefg"


def test_packing_against_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    packs, asked = plans.staged(spark, sf)
    packs = packs.cache()
    texts = {r.query_id: r.question for r in asked.collect()}
    rows = {}
    for r in sorted(packs.collect(), key=lambda r: r.position):
        rows.setdefault(r.query_id, []).append(r)
    got = {}
    for r in P.packed(packs, asked, 300).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.form))
    for q, own in rows.items():
        if texts[q].startswith(("Table", "accuracy")):
            words = set(texts[q].lower().replace(":", "").split())
            own = sorted(own, key=lambda r: (r.kind != "table", -len(words & set(r.excerpt.lower().replace(".", "").replace("|", " ").split())) if r.kind == "table" else 0, -r.score if r.kind == "table" else 0))
        said, parents, want = [], [], []
        for r in own:
            options = []
            if r.kind == "table" or r.parent_chunk_id in [None, *parents] or len(parents) < 6:
                options.append(("full", r.prompt if r.kind == "table" else P.without_overlap(r.prompt, said)))
            options.append(("excerpt", r.excerpt.strip()))
            if r.kind != "table" and r.excerpt.strip():
                options.append(("rescued", P.rescued(r.prompt, texts[q])))
            for form, text in options:
                whole = "\n\n".join(f"[{i}] {x}" for i, x in enumerate([*said, text]))
                if text.strip() and max(1, len(whole) // 4) <= 300:
                    said.append(text)
                    want.append((r.chunk_id, form))
                    if form == "full" and r.parent_chunk_id and r.kind != "table" and r.parent_chunk_id not in parents:
                        parents.append(r.parent_chunk_id)
                    break
        assert got.get(q, []) == want, q


def test_versions_and_neighbours(spark):
    chunk = "chunk_id string, document_id long, parse_version string, chunk_role string, block_type string, parent_chunk_id string, previous_chunk_id string, next_chunk_id string, text string, table_id string"
    chunks = spark.createDataFrame(
        [
            ("p", 1, "v1", "parent", "narrative", None, None, None, "whole parent", None), ("a", 1, "v1", "child", "narrative", "p", None, "b", "whole", None),
            ("b", 1, "v1", "child", "narrative", "p", "a", None, "other", None), ("old", 1, "v0", "child", "narrative", "p", None, None, "x", None),
            ("ref", 1, "v1", "child", "reference", "p", None, None, "x", None), ("leg", 2, None, None, None, "p", None, None, "kept", None), ("s", 3, "v9", "child", "table", None, None, None, "row", "t"),
        ], chunk)
    documents = spark.createDataFrame([(1, "v1"), (2, "v1"), (3, "v1")], "document_id long, active_parse_version string")
    contexts = spark.createDataFrame([(q, c, 1.0, "text") for q in (1, 2) for c in ("a", "b", "old", "ref", "leg", "s", "unknown")], "query_id long, chunk_id string, score double, kind string")
    asked = spark.createDataFrame([(1, "Summarize this paper"), (2, "what is it")], "query_id long, question string")
    found = P.checked(contexts, chunks, documents)
    assert {r.chunk_id for r in found.collect()} == {"a", "b", "leg", "unknown"}
    shadow = spark.createDataFrame([(3, "v9")], "document_id long, version string")
    assert {r.chunk_id for r in P.checked(contexts, chunks, documents, shadow).collect()} == {"a", "b", "leg", "s", "unknown"}
    prompts = {(r.query_id, r.chunk_id): r.prompt for r in P.expanded(found, chunks, asked).collect()}
    assert prompts[1, "a"] == "whole parent\n\nNeighbor context:\nother" and prompts[2, "a"] == "whole parent"
    assert prompts[2, "b"] == "whole parent\n\nMatched child:\nother" and prompts[1, "leg"] == "kept"
