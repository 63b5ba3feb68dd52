import re

from lumenary.llm import pii

KEY = b"k"


def test_detection_keeps_clean_text():
    for t in (None, "", "Licensed under the Apache License, Version 2.0.", "In 2024 we saw 3.14 and 1,000 of 12-13.", "a@b", "x 1.2.3 y 999.1.1.1"):
        assert pii.detect(t) == []


def test_detection():
    t = 'Mail JO.e+x@Mail.example.com. Call +1 (743) 555-3824 152.143.123.131 or (212) 555-0100; 4785380592391139 2123465659789240, token = "24be64439e3e49cf46b2" Mrs. Anna Berg. GB82 WEST 1234 5698 7654 32'
    got = [(k, t[b:e]) for b, e, k, _ in pii.detect(t)]
    assert got == [("email", "JO.e+x@Mail.example.com"), ("phone", "+1 (743) 555-3824"), ("ipv4", "152.143.123.131"), ("phone", "(212) 555-0100"), ("card", "4785380592391139"), ("card", "2123465659789240"), ("secret", "24be64439e3e49cf46b2"), ("given_f", "Anna"), ("family", "Berg"), ("iban", "GB82 WEST 1234 5698 7654 32")]


def test_surrogates_keep_type_format_script_and_gender():
    assert pii.luhn(pii.surrogate(KEY, "card", "4111111111111111")) and not pii.luhn(pii.surrogate(KEY, "card", "4111111111111112"))
    assert re.fullmatch(r"\d{3}\.\d{2}\.\d\.\d{3}", pii.surrogate(KEY, "ipv4", "152.14.1.131"))
    phone = pii.render("+1 (743) 555-3824", "phone", pii.surrogate(KEY, "phone", "+17435553824"))
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone) and phone != "+1 (743) 555-3824"
    assert re.fullmatch(r"[0-9a-f]{20}", pii.surrogate(KEY, "secret", "24be64439e3e49cf46b2"))
    a, b = pii.surrogate(KEY, "email", "jo.e@mail.example.com"), pii.surrogate(KEY, "email", "x@mail.example.com")
    assert a.split("@")[1] == b.split("@")[1] and a.endswith(".example.com") and a[2] == "."
    assert pii.surrogate(KEY, "given_f", "anna").endswith("a") and pii.surrogate(KEY, "given_m", "hans").endswith("n")
    assert pii.script(pii.surrogate(KEY, "family", "иванов")) == "cyrillic"
    iban = pii.surrogate(KEY, "iban", "GB82WEST12345698765432")
    assert int("".join(str(int(c, 36)) for c in (iban[4:] + iban[:4]).upper())) % 97 == 1
    assert pii.surrogate(b"other", "ipv4", "152.14.1.131") != pii.surrogate(KEY, "ipv4", "152.14.1.131")


def test_replacement_is_distinct_and_coreferent(spark):
    many = [f"10.0.{i}.{j}" for i in range(10) for j in range(10)] + [f"{i}.{j}.1.1" for i in range(1, 10) for j in range(1, 10)]
    texts = [f"at {ip} now" for ip in many] + ["Call +1 (743) 555-3824", "call +1 743 555 3824 NOW", None, "", "nothing here", "at 10.0.0.1 now"]
    rows = [(i, t, "kept", 5) for i, t in enumerate(texts)]
    for bound in (None, 0):
        got = {r.doc_id: r for r in _replace(spark, rows, bound)}
        addresses = [got[i].text.split()[1] for i in range(len(many))]
        assert len(set(addresses)) == len(set(many)) and not set(addresses) & set(many)
        assert all([len(o) for o in a.split(".")] == [len(o) for o in b.split(".")] for a, b in zip(many, addresses, strict=True))
        n = len(many)
        digits = lambda t: re.sub(r"\D", "", t)
        assert digits(got[n].text) == digits(got[n + 1].text) and got[n + 1].text.endswith(" NOW")
        assert (got[n + 2].text, got[n + 3].text, got[n + 4].text) == (None, "", "nothing here")
        assert got[n + 5].text == got[many.index("10.0.0.1")].text and got[0].canon == "kept" and got[0].n_replaced == 1


def _replace(spark, rows, bound):
    from unittest import mock

    df = spark.createDataFrame(rows, "doc_id long, text string, canon string, n_replaced int").repartition(3)
    with mock.patch.object(pii, "BROADCAST_ROWS", pii.BROADCAST_ROWS if bound is None else bound):
        return pii.replace(df, KEY).collect()


def test_empty_table(spark):
    assert pii.replace(spark.createDataFrame([], "doc_id long, text string"), KEY).count() == 0


def test_secrets_are_whole():
    long, jwt = "aB3/" * 200, "eyJhbGciOi.eyJzdWIiOiIx.SflKxwRJ-_~="
    cases = [(f"token = {long}", long), (f"token: {jwt} and", jwt), ("password=Hun!ter2secret9 ok", "Hun!ter2secret9"), ("passwd = correcthorse", "correcthorse")]
    cases += [('"secret": "two words, {x}; it\'s 1", "n": 2', "two words, {x}; it's 1"), ("api_key='ab\\'cdefghij' x", "ab\\'cdefghij"), ('password = "open without end', None), ('"password": "", "user": "someone"', None), ("token: ---------- x", None)]
    for text, want in cases:
        got = [(k, text[b:e]) for b, e, k, _ in pii.detect(text)]
        assert got == ([("secret", want)] if want else []), text


def test_long_addresses_and_plain_words():
    long = "a" * 300 + ".b"
    cases = [(f"x {long}@{'c' * 80}.example.com y", [("email", f"{long}@{'c' * 80}.example.com")]), ("token: everything-matters, secret = nothing", []), ("password:     correcthorse", [("secret", "correcthorse")]), ("token: abc-1efgh", [("secret", "abc-1efgh")]), ("Password: ____________", [])]
    for text, want in cases:
        assert [(k, text[b:e]) for b, e, k, _ in pii.detect(text)] == want, text


def test_a_name_has_one_stem():
    m, f, n, family = (pii.surrogate(KEY, k, "kim") for k in ("given_m", "given_f", "given_n", "family"))
    assert m[:-1] == f[:-1] == n[:-1] == family and len({m, f, n, family}) == 4


def plain_replace(text, key):
    """Without exceptions: each entity's first draw in its place."""
    for b, e, kind, canon in reversed(pii.detect(text)):
        text = text[:b] + pii.render(text[b:e], kind, pii.surrogate(key, kind, canon)) + text[e:]
    return text


def test_replacement_against_a_plain_version(spark):
    texts = ["Mail jo.e@mail.example.com, Mr. Kim Lee, Lee: 152.143.123.131", "token = 24be64439e3e49cf46b2 " * 3, None, "", "clean", "x " * 200_000 + "(212) 555-0100", "Call +1 (743) 555-3824"]
    for bound in (None, 0):
        got = [(r.doc_id, r.text, r.hash, r.late) for r in _rows(spark, texts, bound)]
        assert sorted(got, key=repr) == sorted(((i if i % 2 else None, None if t is None else plain_replace(t, KEY), "h", 1) for i, t in enumerate(texts)), key=repr)


def _rows(spark, texts, bound):
    from unittest import mock

    df = spark.createDataFrame([(i if i % 2 else None, t, "h", 1) for i, t in enumerate(texts)], "doc_id long, text string, hash string, late int").repartition(2)
    with mock.patch.object(pii, "BROADCAST_ROWS", pii.BROADCAST_ROWS if bound is None else bound):
        return pii.replace(df, KEY).collect()


def test_secrets_find_free_surrogates_at_last():
    assert len(pii.surrogate(KEY, "secret", "a-------", pii.STRICT_ATTEMPTS)) > 8


def test_names_are_whole_and_mentioned_again():
    cases = [
        ("Mr. Kennedy said. Kennedy left, KENNEDY's car; kennedyesque Kennedys", ["Kennedy", "Kennedy", "KENNEDY"]),
        ("Kennedy spoke. Mr. John Fitzgerald Kennedy left. However John stayed", ["Kennedy", "John", "Fitzgerald", "Kennedy", "John"]),
        ("Dr. Anne-Marie Smith and Marie", ["Anne", "Marie", "Smith", "Marie"]),
        ("Mr. O'Brien's and Mr. Kennedy's", ["O'Brien", "Kennedy"]),
        ("Frau Dr. Anna Berg, Herr Prof. Dr Ludwig van Beethoven", ["Anna", "Berg", "Ludwig", "Beethoven"]),
        ("Mr. John F. Kennedy The end", ["John", "F", "Kennedy"]),
        ("κα Μαρία Παπαδοπούλου είπε. Παπαδοπούλου", ["Μαρία", "Παπαδοπούλου", "Παπαδοπούλου"]),
        ("他说王小明先生来了,小明走了", ["王", "小明", "小明"]),
        ("Mr. said Kennedy", []),
    ]
    for text, want in cases:
        assert [text[b:e] for b, e, _, _ in pii.detect(text)] == want, text
    got = {text_canon for *_, kind, text_canon in pii.detect("Frau Dr. Anna Berg. Frau Anna") if kind == "given_f"}
    assert got == {"anna"}


def test_mentions_share_the_surrogate(spark):
    [r] = pii.replace(spark.createDataFrame([(1, "Mr. John Kennedy said. Kennedy left. KENNEDY, John")], "doc_id long, text string"), KEY).collect()
    m = re.fullmatch(r"Mr. (\w+) (\w+) said. (\w+) left. (\w+), (\w+)", r.text)
    assert m[2] == m[3] == m[4].capitalize() and m[1] == m[5] and "Kennedy" not in r.text and r.n_replaced == 5
