"""Pre-tokenisation without regular expressions.

Every code point gets a class; a small automaton over the classes decides
where a piece starts.  Because each class acts on the automaton's states as a
function, and functions compose associatively, the states of a whole batch
come from a blocked prefix scan of composed functions: the scan runs down all
blocks at once, the block totals are scanned, and each block's prefix is then
applied to the state that enters it.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

# The white space of Unicode (property White_Space).
WHITE_SPACE = (
    9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005,
    0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)

# classes of code points
OTHER, LETTER, NUMBER, SPACE, BLANK = range(5)  # BLANK: U+0020

# symbols that the automaton reads: classes with their look-ahead resolved
S_L, S_N, S_O, S_A1, S_A2, S_WIN, S_WSP, S_WEND = range(8)
# states: what the piece is that the last code point belongs to
CLOSED, IN_L, IN_N, IN_O, IN_W, LEAD, ONE_LEFT, TWO_LEFT = range(8)


@functools.cache
def class_table() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    for cp in WHITE_SPACE:
        table[cp] = SPACE
    table[32] = BLANK
    return table


def _step(symbol: int, state: int) -> tuple[int, bool]:
    """The next state, and whether a piece starts at this code point."""
    if symbol == S_L:
        if state == ONE_LEFT:
            return CLOSED, False
        if state == TWO_LEFT:
            return ONE_LEFT, False
        return IN_L, state not in (IN_L, LEAD)
    if symbol == S_N:
        return IN_N, state not in (IN_N, LEAD)
    if symbol == S_O:
        return IN_O, state not in (IN_O, LEAD)
    if symbol in (S_A1, S_A2):  # an apostrophe before s t m d, or before re ve ll
        if state in (IN_O, LEAD):
            return IN_O, False
        return (ONE_LEFT if symbol == S_A1 else TWO_LEFT), True
    if symbol == S_WIN:  # white space before white space or the end
        return IN_W, state != IN_W
    if symbol == S_WSP:  # a blank before something else: it leads the next piece
        return LEAD, True
    return CLOSED, True  # other white space before something else stands alone


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Functions [element, state], products [element, symbol element], starts [symbol, state].

    Elements 0 to 15 are the symbols, from 8 on with a document's start before them.
    """
    plain = [tuple(_step(s, q)[0] for q in range(8)) for s in range(8)]
    gens = plain + [(f[CLOSED],) * 8 for f in plain]
    elements = list(gens)
    index: dict[tuple[int, ...], int] = {}
    for i, f in enumerate(elements):
        index.setdefault(f, i)
    products: list[list[int]] = []
    at = 0
    while at < len(elements):
        row = []
        for g in gens:
            h = tuple(g[q] for q in elements[at])
            if h not in index:
                index[h] = len(elements)
                elements.append(h)
            row.append(index[h])
        products.append(row)
        at += 1
    starts = np.array([[_step(s, q)[1] for q in range(8)] for s in range(8)] + [[True] * 8] * 8)
    return np.array(elements, np.uint8), np.array(products, np.uint8), starts


def scan_states(symbols: np.ndarray, width: int = 512) -> np.ndarray:
    """The state before each symbol (0 to 15), by a prefix scan of composed functions."""
    funcs, products, _ = _monoid()
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.uint8)
    rows = -(-n // width)
    grid = np.full(rows * width, S_WEND, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    flat = products.ravel()
    prefix = np.empty((width, rows), np.uint8)
    prefix[0] = grid[0]
    for i in range(1, width):
        np.take(flat, prefix[i - 1].astype(np.int32) * 16 + grid[i], out=prefix[i])
    enter = np.empty(rows, np.uint8)
    state = CLOSED
    for r, total in enumerate(prefix[-1].tolist()):
        enter[r] = state
        state = int(funcs[total, state])
    after = funcs.ravel()[prefix.astype(np.int32) * 8 + enter[None, :]]
    before = np.empty_like(after)
    before[1:] = after[:-1]
    before[0] = enter
    return np.ascontiguousarray(before.T).reshape(-1)[:n]


def symbols_of(cps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Automaton symbols of code points; ``first`` marks each document's first one."""
    kind = class_table()[cps]
    last = np.ones(len(cps), bool)
    last[:-1] = first[1:]
    white = kind >= SPACE
    follows = np.zeros(len(cps), bool)  # a code point of the same document that isn't white space
    follows[:-1] = ~white[1:]
    follows &= ~last
    out = np.array([S_O, S_L, S_N, S_WIN, S_WIN], np.uint8)[kind]
    out[white & follows] = S_WEND
    out[(kind == BLANK) & follows] = S_WSP
    quotes = np.flatnonzero((cps == 0x27) & ~last)
    if len(quotes):
        a = cps[quotes + 1]
        b = cps[np.minimum(quotes + 2, len(cps) - 1)]
        more = ~last[quotes + 1]
        one = (a == 0x73) | (a == 0x74) | (a == 0x6D) | (a == 0x64)
        two = (((a == 0x72) | (a == 0x76)) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))
        out[quotes[one]] = S_A1
        out[quotes[two & more]] = S_A2
    out[first] += 8
    return out


def piece_bounds(data: np.ndarray, row_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the pieces of UTF-8 rows (one more than pieces), and pieces before each row."""
    if len(data) == 0:
        return np.zeros(1, np.int64), np.zeros(len(row_offsets), np.int64)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)  # the byte offset of each code point
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.zeros(len(cps), bool)
    begins = row_offsets[:-1][np.diff(row_offsets) > 0]
    first[np.searchsorted(at, begins)] = True
    symbols = symbols_of(cps, first)
    starts = _monoid()[2].ravel()[symbols.astype(np.int32) * 8 + scan_states(symbols)]
    bounds = np.append(at[starts], len(data)).astype(np.int64)
    return bounds, np.searchsorted(bounds, row_offsets)
