import hashlib
import random
import zlib

import numpy as np
import pytest
from lumenary.llm import media, warc


def test_round_trip(spark):
    big = "<p>" + "é" * 100
    rows = [(3, "http://a/1", big), (1, "http://a/2\r\nX: y", big), (2, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n" + "\n\r\n" * 40), (9, "u", "x" * 200_000), (1, "http://a/2\r\nX: y", big), (None, "u", "y" * 150), (10, "u", big + "\r\n\r\n")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=str)
    first = {}
    for k, _, h in rows:
        if k is not None:
            first[h or ""] = min(first.get(h or "", k), k)
    want = []
    for k, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 100 and first.get(h or "", k) != k
        want.append((k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archive_is_a_warc(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    token = warc.write_archive(spark.createDataFrame([(1, "u", "z" * 120), (2, "u", "z" * 120)], "page_id long, url string, html string").coalesce(1), path)
    raw = b"".join(p.read_bytes() for p in (tmp_path / "a").glob("part-*"))
    kinds = []
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n")
        n = int(fields[b"Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        kinds.append(fields[b"WARC-Type"])
        raw = rest[n + 4 :]
    assert sorted(kinds) == [b"response", b"revisit"]
    got = warc.read_archive(spark, path, token).where("record_type = 'response'").first()
    assert bytes(got.payload) == b"z" * 120


def test_record_ids_are_unique(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "z" * 120), (1, "u", "z" * 120), (None, "u", "a"), (None, None, None)], "page_id long, url string, html string")
    warc.write_archive(df, f"file://{tmp_path}/a")
    got = warc.read_any(spark, f"file://{tmp_path}/a").collect()
    assert len({r.record_id for r in got}) == 4 and len({r.date for r in got}) == 1


@pytest.mark.parametrize("compressed", [False, True])
def test_foreign_archives(spark, tmp_path, compressed):
    import gzip

    def record(kind, number, url, digest, block, extra=""):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nwarc-record-id: <urn:uuid:{number}>\r\nWARC-Date: 2020-01-0{number}T00:00:00Z\r\nWARC-Target-URI: {url}\r\nWARC-Payload-Digest: {digest}\r\n{extra}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
        raw = head.encode() + block + b"\r\n\r\n"
        return gzip.compress(raw) if compressed else raw

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    parts = [record("warcinfo", 9, "", "", b"software: x"), record("response", 1, "http://a", "sha1:AAA", http + b"body\r\n\r\nWARC/1.0 more"), record("revisit", 2, "http://b", "sha1:AAA", http), record("revisit", 3, "http://c", "sha1:ZZZ", http), record("response", 4, "http://d", "sha1:AAA", http + b"later")]
    (tmp_path / "x.warc").write_bytes(b"".join(parts))
    archive = warc.read_any(spark, f"file://{tmp_path}/x.warc")
    got = {r.url: r.payload and bytes(r.payload) for r in warc.resolve_any(archive).collect()}
    assert got == {"http://a": b"body\r\n\r\nWARC/1.0 more", "http://b": b"body\r\n\r\nWARC/1.0 more", "http://c": None, "http://d": b"later"}
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc"))


def dct_jpeg(coefficients, dc_step, interval=0, factors=((1, 1),), width=0, height=0):
    """A plain encoder: blocks of quantised coefficients (in zigzag order) by MCU, bit by bit."""
    ac_lengths = bytes([0, 2, 1, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0])
    dc, ac = media.codes(media.DC_LENGTHS, media.DC_SYMBOLS), media.codes(ac_lengths, media.AC_SYMBOLS)
    seg = lambda m, b: bytes([255, m]) + (len(b) + 2).to_bytes(2, "big") + b
    n = len(factors)
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + seg(0xDB, bytes([0, dc_step] + [1] * 63))
    out += seg(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors)))
    out += seg(0xC4, b"\0" + media.DC_LENGTHS + media.DC_SYMBOLS) + seg(0xC4, b"\x10" + ac_lengths + media.AC_SYMBOLS)
    if interval:
        out += seg(0xDD, interval.to_bytes(2, "big"))
    out += seg(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + bytes([0, 63, 0]))
    bits, pred, scan = "", [0] * n, b""

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return b"".join(b"\xff\0" if x == 255 else bytes([x]) for x in (int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)))

    def put(v):
        s = abs(v).bit_length()
        return s, format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else ""

    for m, mcu in enumerate(coefficients):
        if interval and m and m % interval == 0:
            scan += flush(bits) + bytes([255, 0xD0 + (m // interval - 1) % 8])
            bits, pred = "", [0] * n
        for c, block in mcu:
            s, x = put(block[0] - pred[c])
            pred[c] = block[0]
            bits += format(dc[s][0], f"0{dc[s][1]}b") + x
            last = max([k for k in range(64) if block[k]] + [0])
            run = 0
            for k in range(1, last + 1):
                if block[k] == 0:
                    run += 1
                    continue
                while run > 15:
                    bits += format(ac[0xF0][0], f"0{ac[0xF0][1]}b")
                    run -= 16
                assert run == 0
                s, x = put(block[k])
                bits += format(ac[s][0], f"0{ac[s][1]}b") + x
                run = 0
            if last < 63:
                bits += format(ac[0][0], f"0{ac[0][1]}b")
    return out + scan + flush(bits) + b"\xff\xd9"


@pytest.mark.parametrize("interval", [0, 1, 5])
def test_colour_with_coefficients(interval):
    r = random.Random(interval)
    wide, high, mcus, grid = 3, 4, [], np.zeros((8, 6), int)
    for m in range(wide * high):
        mcu = []
        for y in range(2):
            for x in range(2):
                b = [r.randint(-100, 100)] + [r.choice([0] if k > 3 and m % 2 else [1, -3, 9]) if k < 6 or m % 3 == 0 else 0 for k in range(1, 64)]
                b = [b[0]] + [v for v in b[1:]]
                first_zero = next((k for k in range(1, 64) if b[k] == 0), 64)
                b[first_zero:] = [0] * (64 - first_zero)
                grid[m // wide * 2 + y, m % wide * 2 + x] = b[0]
                mcu.append((0, b))
        mcu += [(1, [r.randint(-50, 50)] + [0] * 63), (2, [r.randint(-50, 50)] + [0] * 63)]
        mcus.append(mcu)
    j = dct_jpeg(mcus, 8, interval, ((2, 2), (1, 1), (1, 1)), 16 * wide - 3, 16 * high - 9)
    im = media.parse(j)[0]
    assert (im.width, im.height) == (45, 55)
    assert (media.decode_luminance([j])[0][0] == np.clip(grid + 128, 0, 255)[:7, :6]).all()


def test_store_and_read_back(spark):
    texts = ["", None, "a", "a" * 575, "b" * 576, "c" * 577, "é中😀" * 400, "x" * 250_000, "a", "\0\xff" * 300]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string").repartition(3)
    got = {r.doc_id: r for r in media.digests(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert got[2].asDict() | {"doc_id": 8} == got[8].asDict()
    stored = media.store(df)
    f = {r.doc_id: r for r in media.features(stored, "doc_id").collect()}
    assert sorted(media.read_back(stored).collect()) == sorted(media.digests(df).collect())
    assert all(f[i].error is None and f[i].feature == got[i].feature for i in f) and f[7].n_images == 2
    assert media.digests(df.limit(0)).count() == 0


def test_broken_media_have_errors(spark):
    good = media.encode_payloads([media.pad(b"hello")])[0]
    rows = [(1, good), (2, good[:-40]), (3, b""), (4, None), (5, b"GIF89a"), (6, good.replace(b"\xff\xc0", b"\xff\xc2")), (7, good[:30])]
    got = {r.id: r for r in media.features(spark.createDataFrame(rows, "id long, media binary"), "id").collect()}
    assert got[1].width == 192 and all(got[i].error for i in range(2, 8))


def test_scans_of_one_component_each_and_bad_headers(spark):
    r = random.Random(8)
    blocks = [[(0, [r.randint(-60, 60)] + [0] * 63)] for _ in range(6)]
    one = dct_jpeg(blocks, 8, width=24, height=16)
    frame, scan = one.index(b"\xff\xc0"), one.index(b"\xff\xda")
    head = one[: frame + 2] + (14).to_bytes(2, "big") + one[frame + 4 : frame + 9] + bytes([2, 1, 0x11, 0, 2, 0x11, 0])
    two = head + one[frame + 13 : scan] + one[scan:-2] + one[scan : scan + 5] + b"\x02" + one[scan + 6 : -2] + b"\xff\xd9"
    first, second = (media.decode_luminance([x])[0][0] for x in (one, two))
    assert (first == second).all() and len(media.parse(two)) == 1
    no_factor, huge = bytearray(one), bytearray(one)
    no_factor[frame + 11] = 0
    huge[frame + 5 : frame + 9] = b"\xff\xff\xff\xff"
    got = media.features(spark.createDataFrame([(1, two), (2, bytes(no_factor)), (3, bytes(huge)), (4, one + media.encode_payloads([media.pad(b"x")])[0])], "id long, media binary"), "id").orderBy("id").collect()
    assert [x.error is None for x in got] == [True, False, False, True] and got[3].feature.count("+") == 2
