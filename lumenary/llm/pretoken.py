"""Vectorised pre-tokenisation without regular expressions.

The split of the byte-level BPE family (contractions, runs of letters, digits or other signs with at most one leading
space, white space) is a small finite automaton. Each code point, together with its neighbours, is one of
eight symbols; each symbol is a function from states to states, and composition of such functions is associative. The
functions that can arise (the transition monoid) are enumerated once, so that a scan needs one table look-up per code
point: blocks are scanned side by side, the blocks' totals are scanned in turn, and each position's state follows.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

# Symbols
LETTER, DIGIT, OTHER, QUOTE, TAIL_LETTER, SPACE_MID, SPACE_LAST, WHITE_LAST = range(8)
# States: what the code points so far end in. OPEN: whatever comes begins a piece.
OPEN, IN_LETTERS, IN_DIGITS, IN_OTHER, IN_WHITE, ONE_SPACE, IN_TAIL = range(7)
N_STATES = 7
BLOCK = 256

#: Code points with the Unicode property White_Space (fixed values).
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece begins at this symbol."""
    run = {LETTER: IN_LETTERS, TAIL_LETTER: IN_LETTERS, DIGIT: IN_DIGITS, OTHER: IN_OTHER}
    if state == IN_TAIL:  # inside a contraction; its letters are assured by the look-ahead
        return (IN_TAIL if symbol == TAIL_LETTER else OPEN), False
    if symbol in run:
        return run[symbol], state not in (run[symbol], ONE_SPACE)
    if symbol == QUOTE:  # an apostrophe that a contraction's letters follow
        return (IN_OTHER, False) if state in (IN_OTHER, ONE_SPACE) else (IN_TAIL, True)
    if symbol == SPACE_MID:
        return IN_WHITE, state != IN_WHITE
    return (ONE_SPACE if symbol == SPACE_LAST else OPEN), True


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols' elements of the monoid, composition (flat, 256 a row), application, and beginnings (state x symbol).

    A symbol's second row is for a text's first code point: there it is a constant function, which forgets all before.
    """
    elements: list[tuple[int, ...]] = [tuple(range(N_STATES))]
    place = {elements[0]: 0}
    by_symbol = [tuple(_step(s, y)[0] for s in range(N_STATES)) for y in range(8)]
    by_symbol += [(f[OPEN],) * N_STATES for f in by_symbol]
    at = 0
    while at < len(elements):
        for f in by_symbol:
            g = tuple(f[x] for x in elements[at])
            if g not in place:
                place[g] = len(elements)
                elements.append(g)
        at += 1
    n = len(elements)
    assert n <= 256
    arr = np.array(elements, np.uint8)
    compose = np.zeros((256, 256), np.uint8)
    for i in range(n):
        for j in range(n):
            compose[i, j] = place[tuple(arr[j][arr[i]].tolist())]  # first i, then j
    symbols = np.array([place[f] for f in by_symbol], np.uint8).reshape(2, 8)
    begins = np.array([[_step(s, y)[1] for y in range(8)] for s in range(N_STATES)], bool)
    return symbols, compose.ravel(), arr, begins


@cache
def class_table() -> np.ndarray:
    """LETTER, DIGIT, OTHER or SPACE_MID of each code point."""
    t = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            t[c] = LETTER
        elif k == "N":
            t[c] = DIGIT
    t[WHITE_SPACE] = SPACE_MID
    return t


def _symbols(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of texts laid end to end; ``ends`` holds the place after each text."""
    kind = class_table()[cp]
    sym = kind.copy()
    white = kind == SPACE_MID
    last = np.zeros(len(cp), bool)
    last[:-1] = white[:-1] & ~white[1:]
    last[ends - 1] = False  # at a text's end the whole run is one piece
    sym[last] = WHITE_LAST
    sym[last & (cp == 32)] = SPACE_LAST
    quote = np.flatnonzero(cp == 39)
    if len(quote):
        stop = ends[np.searchsorted(ends, quote, side="right")]
        padded = np.concatenate([cp, np.zeros(2, cp.dtype)])
        a, b = padded[quote + 1], padded[quote + 2]
        short = (quote + 1 < stop) & np.isin(a, [ord(c) for c in "stmd"])
        pair = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        long = (quote + 2 < stop) & pair
        sym[quote[short | long]] = QUOTE
        sym[quote[long] + 1] = TAIL_LETTER
    return sym


def _scan(f: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of elements, blocks side by side."""
    compose = _tables()[1]
    n = len(f)
    if n <= 64:
        out, acc = np.empty_like(f), 0
        for i, x in enumerate(f.tolist()):
            acc = out[i] = compose[acc * 256 + x]
            acc = int(acc)
        return out
    width = min(BLOCK, max(8, int(n**0.5)))
    rows = -(-n // width)
    lanes = np.zeros(rows * width, np.uint8)  # element 0 is the identity
    lanes[:n] = f
    lanes = np.ascontiguousarray(lanes.reshape(rows, width).T)
    for i in range(1, width):
        lanes[i] = compose[lanes[i - 1].astype(np.uint16) << 8 | lanes[i]]
    before = np.zeros(rows, np.uint8)
    before[1:] = _scan(lanes[-1])[:-1]
    lanes = compose[(before.astype(np.uint16) << 8)[None, :] | lanes]
    return np.ascontiguousarray(lanes.T).reshape(-1)[:n]


def boundaries(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts laid end to end. ``ends``: the place after each text, ascending, no text empty."""
    if not len(cp):
        return np.zeros(0, np.int64)
    of_symbol, _, states, begins = _tables()
    sym = _symbols(cp, ends)
    f = of_symbol[0][sym]
    first = np.concatenate([[0], ends[:-1]])
    f[first] = of_symbol[1][sym[first]]
    prefix = _scan(f)
    after = states[prefix, OPEN]
    before = np.empty_like(after)
    before[1:] = after[:-1]
    before[first] = OPEN
    return np.flatnonzero(begins[before, sym])
