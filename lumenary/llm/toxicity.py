"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, and lengths of compressed windows.

Two dictionaries are trained on a bounded sample of labelled documents. Every text is cut into overlapping windows of bytes,
and each window is compressed with either dictionary and with none. What the toxic dictionary saves beyond the others,
window by window, is summed up in a few figures of a document, from which a logistic curve, calibrated on folds that the
dictionaries weren't trained on, gives the score.

The dictionaries are trained on passages, not on whole texts. Prose is alike in both classes, and a dictionary of either
would be full of it; so a toxic passage is a run of byte 6-grams that toxic documents hold ``ODDS`` times as often as
ordinary ones. Compression is set so that a window's length tells long matches only: matches of ``MATCH`` bytes or more,
literals as they are (their Huffman coding would hide what a match saves), and a lead-in that each dictionary holds, so that
every window pays a block's overhead and a first match shows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Labels of each class, and characters of a document, that may enter the fit.
TRAIN_ROWS, FIT_CHARS = 3000, 20_000
#: Bytes of a window, the step to the next one, least match, n-gram of the passages, and how much oftener toxic ones are.
WINDOW, STEP, MATCH, GRAM, ODDS, LEAST_DOCUMENTS = 128, 96, 6, 6, 4.0, 5
#: Bytes of the dictionaries, of a segment of theirs, windows of ordinary text for training, and a window's telling saving.
DICTIONARY, TOXIC_DICTIONARY, SEGMENT, ORDINARY_WINDOWS, HIT = 16_384, 8192, 24, 30_000, 2
RIDGE, NEWTON, SEED = 0.1, 60, 17
LEAD = b"~".join(b"%02d" % i for i in range(12))
GAP = b"\0" * (SEGMENT - 4)


def held_out(key: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def body(text: str | None) -> bytes:
    """UTF-8 with A-Z in small letters, between spaces, so that a first and last word look like others."""
    return b" " + (text or "").encode().lower() + b" "


def starts(n: int) -> range:
    """Where the windows of n bytes begin: they cover all of them and overlap."""
    return range(0, max(1, n - (WINDOW - STEP)), STEP)


def grams(b: bytes) -> np.ndarray:
    """The byte n-grams at each place, as integers."""
    a = np.frombuffer(b, np.uint8).astype(np.int64)
    n = len(a) - GRAM + 1
    return sum(a[k : n + k] << (8 * k) for k in range(GRAM)) if n > 0 else np.empty(0, np.int64)


def frequencies(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the texts and how many texts hold each."""
    return np.unique(np.concatenate([np.empty(0, np.int64), *(np.unique(grams(b)) for b in texts)]), return_counts=True)


def telling(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """Sorted n-grams whose share of toxic texts, two deviations taken off, is over ODDS times that of ordinary ones."""
    own, n = frequencies(toxic)
    other, m = frequencies(ordinary)
    found = np.zeros(len(own))
    if len(other):
        at = np.minimum(np.searchsorted(other, own), len(other) - 1)
        found = np.where(other[at] == own, m[at], 0)
    share = (n - 2 * np.sqrt(n)) / max(1, len(toxic))
    return own[(n >= LEAST_DOCUMENTS) & (share > ODDS * (found + 1) / max(1, len(ordinary)))]


def passages(b: bytes, marked: np.ndarray) -> list[bytes]:
    """The longest runs of a text all of whose n-grams are marked."""
    inside = np.concatenate([[False], np.isin(grams(b), marked), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return [b[i : j + GRAM - 1] for i, j in edges.reshape(-1, 2).tolist()]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary as zstandard trains it; the samples themselves where they are too few for that."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=GRAM).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


@dataclass
class Model:
    """Dictionaries, and the logistic curve over ``figures``, which are centred by mean and scale."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def compressor(content: bytes):
    """What compresses a window with a dictionary of that content."""
    kind = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, min_match=MATCH, window_log=17, hash_log=14, chain_log=6, search_log=1, target_length=1, strategy=zstandard.STRATEGY_FAST
    )
    held = zstandard.ZstdCompressionDict(content + LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=kind)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=kind).compress


class Lengths:
    """Compressed lengths of a text's windows with the toxic, the ordinary and no dictionary."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.by = [compressor(x) for x in (toxic, ordinary, b"")]

    def __call__(self, b: bytes) -> np.ndarray:
        at = starts(len(b))
        out = np.empty((3, len(at)), np.int32)
        for k, i in enumerate(at):
            w = LEAD + b[i : i + WINDOW]
            out[0, k], out[1, k], out[2, k] = [len(f(w)) for f in self.by]
        return out

    def figures(self, text: str | None) -> np.ndarray:
        """What windows save by the toxic dictionary: the largest savings, their sum and mean, the windows with a telling one,
        and how they stand against those by the ordinary dictionary."""
        toxic, ordinary, plain = self(body(text))
        saved = np.maximum(plain - toxic, 0)
        top = -np.partition(-saved, min(3, len(saved) - 1))[:4]
        top = np.sort(top)[::-1]
        n, total, hits = len(saved), saved.sum(), (saved >= HIT).sum()
        against = ordinary - toxic
        roots = np.sqrt([top[0], top[:2].sum(), top.sum(), total, hits])
        return np.concatenate([roots, [total / n, hits / n, np.log(n), against.max() / 10, against.mean() / 10, top.sum() / n, total / np.sqrt(n)]])


def dictionaries(texts: list[bytes], toxic: np.ndarray) -> tuple[bytes, bytes]:
    own, other = [b for b, y in zip(texts, toxic, strict=True) if y], [b for b, y in zip(texts, toxic, strict=True) if not y]
    marked = telling(own, other)
    samples = [GAP.join([b"", *runs, b""]) for b in own if (runs := passages(b, marked))]
    windows = [b[i : i + WINDOW] for b in other for i in starts(len(b))]
    chosen = np.random.default_rng(SEED).permutation(len(windows))[:ORDINARY_WINDOWS]
    size = max(1024, min(TOXIC_DICTIONARY, sum(map(len, samples)) // 8))
    return dictionary(samples, size), dictionary([windows[i] for i in chosen], DICTIONARY)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's steps."""
    a, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(NEWTON):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + RIDGE * np.eye(len(w)), a.T @ (p - y) + RIDGE * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def train(texts: list[str], toxic: np.ndarray) -> Model:
    """Dictionaries of all the texts; the curve from figures of each half by dictionaries of the other half. Without texts of
    both classes every score is the smoothed share of toxic ones."""
    bodies = [body(t) for t in texts]
    share = (toxic.sum() + 1) / (len(toxic) + 2)
    width = len(Lengths(b"", b"").figures(""))
    if toxic.sum() < 4 or (1 - toxic).sum() < 4:
        return Model(b"", b"", np.zeros(width), np.ones(width), np.zeros(width), float(np.log(share / (1 - share))))
    half, x = np.empty(len(texts), int), np.empty((len(texts), width))
    for y in (0, 1):  # each half gets half of each class
        of = np.flatnonzero(toxic == y)
        half[of] = np.arange(len(of)) % 2
    for k in (0, 1):
        fit, rest = np.flatnonzero(half == k), np.flatnonzero(half != k)
        lengths = Lengths(*dictionaries([bodies[i] for i in fit], toxic[fit]))
        for i in rest:
            x[i] = lengths.figures(texts[i])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    weights, bias = logistic((x - mean) / scale, toxic)
    return Model(*dictionaries(bodies, toxic), mean, scale, weights, bias)


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = TRAIN_ROWS) -> Model:
    """The model of labelled documents that aren't held out: of each class those of the ``most`` labels of least hash, of
    these the documents of FIT_CHARS characters at most. Labels other than 0 and 1, and labels without a document, count
    for nothing. Twice ``most`` rows at most go to the driver."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(key)).select(F.col(key).alias("key"), F.col("toxic").cast("int").alias("label")).distinct()
    order = [F.xxhash64("key"), "key", "label"]
    chosen = known.where("label = 1").orderBy(*order).limit(most).unionAll(known.where("label = 0").orderBy(*order).limit(most))
    found = documents.where(F.length(text) <= FIT_CHARS).select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    got = sorted((str(r["key"]), r["label"], r["text"]) for r in found.distinct().collect())  # bounded by ``most`` and FIT_CHARS
    return train([t for _, _, t in got], np.array([y for _, y, _ in got], np.float64))


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``key``, score and predicted of every document; whole texts, window by window."""

    def make():
        lengths = Lengths(model.toxic, model.ordinary)

        def step(batch):
            s = np.array([model.score(lengths.figures(t.as_py())) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [key, "score", "predicted"])

        return step

    rows = documents.select(key, F.col(text).cast("string"))
    return map_batches(rows, f"{key} {documents.schema[key].dataType.simpleString()}, score double, predicted int", make)


def classify(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, held_out, score (higher: toxic likelier) and predicted of every document.

    Null texts count as empty ones, which have one window; repeated rows get equal rows; other columns are left out. Labels
    train only where crc32 of the key mod 3 isn't 1, and neither they nor the key enter a score otherwise. A null key isn't
    held out. An empty table gives an empty result; without labels of both classes all scores are equal.
    """
    scored = score(documents, fit(documents, labels, key, text), key, text)
    return scored.select(key, held_out(key).alias("held_out"), "score", "predicted")
