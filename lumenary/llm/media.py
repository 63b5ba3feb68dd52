"""Baseline JPEG as a column of media: encoding, marker parsing, Huffman decoding and DC-only luminance thumbnails."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

#: The usual luminance tables (fixed values): how many codes there are of each length, and their symbols.
DC_LENGTHS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
#: Our images have no AC coefficients: a table of end-of-block, a run of 16 zeros, and the sizes with no run.
AC_LENGTHS = bytes([0, 2, 1, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0])
AC_SYMBOLS = bytes([0x00, 0x01, 0x02, 0x03, 0x04, 0xF0])

SIDE = 24
#: Bytes of a payload are a multiple of this.
UNIT = SIDE * SIDE
#: Rows of blocks of one image; longer payloads are stored as several images, one after another.
MOST_ROWS = 8184
PAD = 255
#: Payload bytes that are coded at once.
CHUNK = 1 << 21


def codes(lengths: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length), canonical."""
    out, code, at = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for s in symbols[at : at + count]:
            out[s] = (code, n)
            code += 1
        at += count
        code <<= 1
    return out


@cache
def look_up(lengths: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits ahead: length << 8 | symbol; 0 where no code fits."""
    t = np.zeros(1 << 16, np.uint16)
    for s, (code, n) in codes(lengths, symbols).items():
        t[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
    return t


@cache
def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Of each DC difference from -255 on: its bits, with those of end-of-block behind them, and their number."""
    dc, (eob, eob_n) = codes(DC_LENGTHS, DC_SYMBOLS), codes(AC_LENGTHS, AC_SYMBOLS)[0]
    value, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code, n = dc[s]
        bits = d if d >= 0 else d + (1 << s) - 1
        value[d + 255], size[d + 255] = ((code << s | bits) << eob_n) | eob, n + s + eob_n
    return value, size


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


@cache
def _head(rows: int) -> bytes:
    """From SOI to SOS, for a grey image of ``rows`` by SIDE blocks whose DC step is 8: a block's mean is its DC value."""
    quant = bytes([0, 8] + [1] * 63)
    frame = bytes([8]) + (8 * rows).to_bytes(2, "big") + (8 * SIDE).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    tables = _segment(0xC4, b"\x00" + DC_LENGTHS + DC_SYMBOLS) + _segment(0xC4, b"\x10" + AC_LENGTHS + AC_SYMBOLS)
    return b"\xff\xd8" + _segment(0xDB, quant) + _segment(0xC0, frame) + tables + _segment(0xDD, SIDE.to_bytes(2, "big")) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def pad(data: bytes) -> bytes:
    return data + bytes([PAD]) * ((-len(data)) % UNIT or (UNIT if not data else 0))


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Each payload, whose length is a positive multiple of UNIT, as JPEG images of which each block holds one byte."""
    value, size = _difference_codes()
    frames = [min(MOST_ROWS, len(p) // SIDE - at) for p in payloads for at in range(0, len(p) // SIDE, MOST_ROWS)]
    v = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, SIDE).astype(np.int16) - 128
    d = np.diff(v, axis=1, prepend=np.int16(0)) + np.int16(255)
    bits, n = value[d], size[d]
    in_row = np.cumsum(n, axis=1)
    row_bits = in_row[:, -1]
    row_bytes = (row_bits + 7) >> 3
    row_end = np.cumsum(row_bytes)
    row_start = row_end - row_bytes
    place = (in_row - n + (row_start << 3)[:, None]).ravel()
    word = bits.ravel() << (32 - (place & 7) - n.ravel())
    at, total = place >> 3, int(row_end[-1])
    raw = sum(np.bincount(at + k, weights=(word >> (24 - 8 * k)) & 255, minlength=total + 4)[:total] for k in range(4)).astype(np.uint8)
    raw[row_end - 1] |= ((1 << ((row_bytes << 3) - row_bits)) - 1).astype(np.uint8)  # rows are filled up with ones
    last = np.cumsum(frames) - 1
    number = np.arange(len(v)) - np.repeat(last - np.array(frames) + 1, frames)
    marked = np.ones(len(v), bool)
    marked[last] = False
    stuffed = raw == 255
    shift = np.cumsum(stuffed) - stuffed
    markers = np.cumsum(marked) - marked
    to = np.arange(total) + shift + 2 * np.repeat(markers, row_bytes)
    out = np.zeros(int(to[-1]) + 1 + int(stuffed[-1]), np.uint8)
    out[to] = raw
    ends = to[row_end - 1] + 1 + stuffed[row_end - 1]
    out[ends[marked]] = 0xFF
    out[ends[marked] + 1] = 0xD0 + (number[marked] & 7)
    whole, begin, media, k = out.tobytes(), 0, [], 0
    for p in payloads:
        parts, rows = [], len(p) // SIDE
        while rows > 0:
            end = int(ends[last[k]])
            parts += [_head(frames[k]), whole[begin:end], b"\xff\xd9"]
            rows, begin, k = rows - frames[k], end, k + 1
        media.append(b"".join(parts))
    return media


@dataclass
class Image:
    """What the markers of one baseline image say. ``scan``: where its entropy-coded bytes lie in the media."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal, vertical, quantiser
    quantisers: dict[int, int] = field(default_factory=dict)  # the DC steps
    tables: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    interval: int = 0
    order: list[tuple[int, int, int]] = field(default_factory=list)  # component, DC table, AC table
    scan: tuple[int, int] = (0, 0)

    @property
    def alone(self) -> bool:
        """Whether luminance has a scan of its own: then its blocks come in rows, whatever its sampling factors."""
        return len(self.order) == 1

    @property
    def grid(self) -> tuple[int, int]:
        """Width and height of what the scan holds, in samples."""
        if not self.alone:
            return self.width, self.height
        (_, h, v, _), across, down = self.components[0], max(c[1] for c in self.components), max(c[2] for c in self.components)
        return -(-self.width * h // across), -(-self.height * v // down)

    @property
    def sampling(self) -> tuple[tuple[int, int], ...]:
        return ((1, 1),) if self.alone else tuple(c[1:3] for c in self.components)

    def units(self) -> tuple[int, int]:
        """Columns and rows of the scan's units (MCUs)."""
        (w, h), s = self.grid, self.sampling
        return -(-w // (8 * max(x for x, _ in s))), -(-h // (8 * max(y for _, y in s)))


def parse(media: bytes) -> list[Image]:
    """The images of a byte string. Other than baseline images, and images that break off, raise ValueError. Components may
    share a scan or have one each."""
    images, at, im = [], 0, None
    try:
        while at < len(media):
            if media[at] != 0xFF:
                raise ValueError("no marker where one is due")
            marker = media[at + 1]
            at += 2
            if marker == 0xD8:
                im = Image()
                continue
            if marker == 0xD9:
                continue
            if marker == 0xFF:
                at -= 1
                continue
            size = int.from_bytes(media[at : at + 2], "big")
            body, at = media[at + 2 : at + size], at + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    im.quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC0:
                if body[0] != 8:
                    raise ValueError("samples must have 8 bits")
                im.height, im.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                im.components = [(c[0], c[1] >> 4, c[1] & 15, c[2]) for c in (body[6 + 3 * i : 9 + 3 * i] for i in range(body[5]))]
                if not im.width or not im.height or not im.components or not all(1 <= x <= 4 for c in im.components for x in c[1:3]):
                    raise ValueError("the frame has no size or wrong sampling factors")
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline image")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    im.tables[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                im.interval = int.from_bytes(body, "big")
            elif marker == 0xDA:
                order = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                end = at
                while True:  # the next marker that is neither a stuffed byte nor a restart
                    end = media.index(b"\xff", end)
                    if media[end + 1] == 0 or 0xD0 <= media[end + 1] <= 0xD7:
                        end += 2
                        continue
                    break
                begin, at = at, end
                if len(order) not in (1, len(im.components)):
                    raise ValueError("a scan must have one component or all of them")
                if order[0][0] == im.components[0][0]:  # scans of the other components alone say nothing of luminance
                    im.order, im.scan = order, (begin, end)
                    im.tables = dict(im.tables)
                    if im.units()[0] * im.units()[1] * sum(h * v for h, v in im.sampling) > 4 * (end - begin):  # two bits a block at least
                        raise ValueError("the scan breaks off")
                    images.append(im)
    except (IndexError, AttributeError) as e:
        raise ValueError("the image breaks off") from e
    return images


def _intervals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entropy-coded bytes without stuffing and restart markers, and each interval's beginning and end in them."""
    ff = np.flatnonzero(data[:-1] == 255)
    after = data[ff + 1]
    restart = ff[(after >= 0xD0) & (after <= 0xD7)]
    drop = np.zeros(len(data), bool)
    drop[ff[after == 0] + 1] = True
    drop[restart] = drop[restart + 1] = True
    kept = np.cumsum(~drop)
    cut = kept[restart]
    total = int(kept[-1]) if len(kept) else 0
    return data[~drop], np.concatenate([[0], cut]), np.concatenate([cut, [total]])


def decode_luminance(medias: list[bytes]) -> list[list[np.ndarray]]:
    """DC-only luminance thumbnails (uint8, a sample a block) of the images in each byte string.

    The restart intervals of all images whose tables and sampling agree are decoded side by side, block by block.
    """
    parsed = [(k, im) for k, m in enumerate(medias) for im in parse(m)]
    groups: dict[tuple, list[int]] = {}
    for j, (_, im) in enumerate(parsed):
        key = (im.sampling, tuple((im.tables[d], im.tables[16 + a]) for _, d, a in im.order))
        groups.setdefault((*key, im.interval == 0 and math.prod(im.units())), []).append(j)
    out: list[list[np.ndarray]] = [[] for _ in medias]
    found: dict[int, np.ndarray] = {}
    for (sampling, tables, _), members in groups.items():
        found |= _decode_group(medias, [parsed[j] for j in members], members, sampling, tables)
    for j, (k, _) in enumerate(parsed):
        out[k].append(found[j])
    return out


def _decode_group(medias, parsed, members, sampling, tables) -> dict[int, np.ndarray]:
    across, down = max(h for h, _ in sampling), max(v for _, v in sampling)
    blocks = [c for c, (h, v) in enumerate(sampling) for _ in range(h * v)]
    datas, begins, stops, counts, base = [], [], [], [], 0
    for k, im in parsed:
        data, b, e = _intervals(np.frombuffer(medias[k], np.uint8, im.scan[1] - im.scan[0], im.scan[0]))
        total = math.prod(im.units())
        step = im.interval or total
        n = np.minimum(step, total - step * np.arange(len(b)))
        if len(b) != -(-total // step):
            raise ValueError("restart intervals are missing")
        datas.append(data)
        begins.append(b + base)
        stops.append(e + base)
        counts.append(n)
        base += len(data)
    data = np.concatenate([*datas, np.full(4, 255, np.uint8)]).astype(np.uint32)
    ahead = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    pos = np.concatenate(begins).astype(np.int64) << 3
    stop = np.concatenate(stops).astype(np.int64) << 3
    left = np.concatenate(counts)
    lanes, most = len(pos), int(left.max())
    order = np.argsort(-left, kind="stable")
    pos, stop = pos[order], stop[order]
    live_at = np.searchsorted(-left[order], -np.arange(most), side="left")  # lanes that still have a block at each step
    dc_tables, ac_tables = [look_up(*d) for d, _ in tables], [look_up(*a) for _, a in tables]
    per_mcu = blocks.count(0)
    values = np.zeros((most * per_mcu, lanes), np.int32)
    pred = np.zeros((len(sampling), lanes), np.int32)

    def peek(p: np.ndarray) -> np.ndarray:
        return ahead[np.minimum(p >> 3, len(ahead) - 1)] << (p & 7).astype(np.uint32)

    for m in range(most):
        n = int(live_at[m])
        luma = 0
        p = pos[:n]
        for c in blocks:
            e = dc_tables[c][peek(p) >> 16]
            p += e >> 8
            s = (e & 255).astype(np.int64)
            if (e == 0).any() or int(s.max(initial=0)) > 11:
                raise ValueError("a code is not in the table")
            x = (peek(p) >> (31 - s).astype(np.uint32) >> 1).astype(np.int32)
            x -= np.where(x < (1 << s >> 1), (1 << s) - 1, 0).astype(np.int32)
            p += s
            pred[c, :n] += x
            if c == 0:
                values[m * per_mcu + luma, :n] = pred[0, :n]
                luma += 1
            at, k = None, None  # lanes inside AC coefficients; None: all
            while True:
                q = p if at is None else p[at]
                e = ac_tables[c][peek(q) >> 16]
                if (e == 0).any():
                    raise ValueError("a code is not in the table")
                step = (e >> 8).astype(np.int64) + (e & 15)
                if at is None:
                    p += step
                else:
                    p[at] += step
                y = e & 255
                go = y != 0
                if not go.any():
                    break
                k = (np.ones(len(y), np.int64) if k is None else k) + (y >> 4) + 1
                if int(k[go].max()) > 64:
                    raise ValueError("a block has too many coefficients")
                go &= k < 64
                at = np.flatnonzero(go) if at is None else at[go]
                k = k[go]
                if not len(at):
                    break
    if (pos > stop).any():
        raise ValueError("the scan breaks off")
    back = np.empty_like(order)
    back[order] = np.arange(lanes)
    lane, result = 0, {}
    h, v = sampling[0]
    for j, (_, im), n in zip(members, parsed, counts, strict=True):
        wide, high = im.units()
        cols = back[lane : lane + len(n)]
        lane += len(n)
        if (n == n[0]).all():
            dc = values[: int(n[0]) * per_mcu, cols].T.reshape(-1)
        else:
            dc = np.concatenate([values[: int(x) * per_mcu, c] for x, c in zip(n, cols, strict=True)])
        grid = dc.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
        full_w, full_h = -(-im.grid[0] * h // (8 * across)), -(-im.grid[1] * v // (8 * down))
        step = im.quantisers[im.components[0][3]]
        result[j] = np.clip((grid[:full_h, :full_w] * step + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    return result


def thumbnail_hash(t: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 neighbouring means rises to the right."""
    rows = np.arange(8) * t.shape[0] // 8
    cols = np.arange(9) * t.shape[1] // 9
    if t.shape[0] < 8 or t.shape[1] < 9:
        t = t[np.arange(max(8, t.shape[0])) * t.shape[0] // max(8, t.shape[0])][:, np.arange(max(9, t.shape[1])) * t.shape[1] // max(9, t.shape[1])]
        rows, cols = np.arange(8) * t.shape[0] // 8, np.arange(9) * t.shape[1] // 9
    sums = np.add.reduceat(np.add.reduceat(t.astype(np.int64), rows, axis=0), cols, axis=1)
    size = np.diff(cols, append=t.shape[1])
    rises = sums[:, 1:] * size[:-1] > sums[:, :-1] * size[1:]
    return np.packbits(rises).tobytes().hex()


def feature(images: list[Image], thumbs: list[np.ndarray]) -> str:
    """Dimensions of the images, joined by +, and the hash of their thumbnails laid below each other, or, where these have
    different widths, of each."""
    dims = "+".join(f"{im.width}x{im.height}" for im in images)
    same = len({t.shape[1] for t in thumbs}) == 1
    return f"{dims}:{'+'.join(map(thumbnail_hash, [np.concatenate(thumbs)] if same else thumbs))}"


def _chunks(payloads: list[bytes]):
    at = 0
    while at < len(payloads):
        stop, size = at, 0
        while stop < len(payloads) and (size == 0 or size + len(payloads[stop]) <= CHUNK):
            size += len(payloads[stop])
            stop += 1
        yield slice(at, stop)
        at = stop


def features(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """key, width and height of the first image, n_images, feature and error of a column of JPEG bytes. Null, empty and
    broken media, and such as aren't baseline images, have an error and nulls; each row is judged by itself."""

    def make():
        def one(m):
            try:
                images = parse(m or b"")
                if not images:
                    raise ValueError("no image")
                return images[0].width, images[0].height, len(images), feature(images, decode_luminance([m])[0]), None
            except Exception as e:  # whatever foreign bytes bring about is that row's own
                return None, None, None, None, f"{type(e).__name__}: {e}"

        def step(batch):
            rows = [one(m) for m in batch.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], [key, "width", "height", "n_images", "feature", "error"])

        return step

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(key, media), f"{key} {kind}, width int, height int, n_images int, feature string, error string", make)


READ = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def _stored(batch: pa.RecordBatch, key: str) -> Iterator[pa.RecordBatch]:
    """Batches (key, n_bytes, media) of a batch of texts, each of some payload bytes."""
    raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
    payloads = [pad(r) for r in raw]
    for c in _chunks(payloads):
        media = encode_payloads(payloads[c])
        yield pa.RecordBatch.from_arrays([batch.column(0)[c], pa.array(map(len, raw[c]), pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])


def _read(stored: pa.RecordBatch, key: str) -> Iterator[pa.RecordBatch]:
    """What a batch's column of media holds."""
    media, rows = stored.column(2).to_pylist(), []
    for c in _chunks(media):
        for m, thumbs in zip(media[c], decode_luminance(media[c]), strict=True):
            back = b"".join(t.tobytes() for t in thumbs)
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(parse(m), thumbs)))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    yield pa.RecordBatch.from_arrays([*stored.columns[:2], *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], [key, "n_bytes", *READ])


def _schema(df: DataFrame, key: str, rest: str) -> str:
    return f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, {rest}"


READ_SCHEMA = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and media: each text's UTF-8 bytes (null: none), padded, as JPEG images."""
    return map_batches(df.select(key, text), _schema(df, key, "media binary"), lambda: lambda batch: _stored(batch, key))


def read_back(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``store`` with what their media hold: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and
    feature in place of the media."""
    return map_batches(stored.select(key, "n_bytes", "media"), _schema(stored, key, READ_SCHEMA), lambda: lambda batch: _read(batch, key))


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``read_back`` finds in what ``store`` makes: the column of media goes from one to the other within the task.

    Null and empty texts are one unit of padding. Equal texts give equal values, repeated rows repeated rows; other columns
    are left out.
    """

    def step(batch):
        for stored in _stored(batch, key):
            yield from _read(stored, key)

    return map_batches(df.select(key, text), _schema(df, key, READ_SCHEMA), lambda: step)
