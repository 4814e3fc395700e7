"""Vectorised pre-tokenisation: where the pieces of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` begin.

Every code point has a class; look-ahead (does a visible character follow this space, is this apostrophe a
contraction) is settled by shifted comparisons.  What is left is a small automaton over the kind of the open piece.
A class is a function from state to state, and functions compose associatively: their finite set is closed once into a
multiplication table, and an inclusive scan with that table gives the state before every character, in blocks.
"""

from __future__ import annotations

from functools import cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE, WHITE, APOSTROPHE = range(6)
# Kinds of the open piece: closed, letters, numbers, others, white space, a leading space, 1 and 2 contraction letters.
CLOSED, IN_L, IN_N, IN_O, IN_W, LED, SHORT, LONG = range(8)
# Classes after look-ahead.
C_L, C_N, C_O, C_SHORT, C_LONG, C_LED, C_LONE, C_W = range(8)
BLOCK = 128


@cache
def class_table() -> np.ndarray:
    """The class of each code point, from Unicode properties."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    every = "".join(map(chr, points))
    where = np.asarray(points)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", WHITE)):
        for m in regex.finditer(pattern, every):
            table[where[m.start() : m.end()]] = kind
    table[0x20], table[0x27] = SPACE, APOSTROPHE
    return table


def _step(kind: int, state: int) -> tuple[int, bool]:
    """The state after a character of this kind, and whether it begins a piece."""
    if state == LONG:
        return SHORT, False
    if state == SHORT:
        return CLOSED, False
    run = {C_L: IN_L, C_N: IN_N, C_O: IN_O, C_SHORT: IN_O, C_LONG: IN_O, C_W: IN_W}.get(kind)
    if state == LED and run not in (None, IN_W):
        return run, False
    if run is not None and state == run:
        return run, False
    if kind == C_SHORT:
        return SHORT, True
    if kind == C_LONG:
        return LONG, True
    if kind == C_LED:
        return LED, True
    if kind == C_LONE:
        return CLOSED, True
    return run, True


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of each class (then of each class at a text's start), products, next states, piece starts, images."""
    plain = [tuple(_step(k, s)[0] for s in range(8)) for k in range(8)]
    first = [(_step(k, CLOSED)[0],) * 8 for k in range(8)]
    elements = [tuple(range(8))]
    index = {elements[0]: 0}
    for f in plain + first:
        if f not in index:
            index[f] = len(elements)
            elements.append(f)
    done = 0
    while done < len(elements):
        for g in plain + first:
            h = tuple(g[s] for s in elements[done])
            if h not in index:
                index[h] = len(elements)
                elements.append(h)
        done += 1
    image = np.asarray(elements, np.uint8)
    product = np.zeros((len(elements), len(elements)), np.uint16)
    for a in range(len(elements)):
        after = image[:, image[a]]  # every element applied after a
        product[a] = [index[tuple(row)] for row in after.tolist()]
    of_class = np.asarray([index[f] for f in plain + first], np.uint16)
    nxt = np.asarray([[_step(k, s)[0] for s in range(8)] for k in range(8)], np.uint8)
    begins = np.asarray([[_step(k, s)[1] for s in range(8)] for k in range(8)], bool)
    return of_class, product, nxt, begins, image


def piece_starts(points: np.ndarray, doc_ends: np.ndarray) -> np.ndarray:
    """Positions at which a piece begins, in concatenated texts given as code points with the end of each text."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    base = class_table()[points]
    lengths = np.diff(doc_ends, prepend=0)
    first = (doc_ends - lengths)[lengths > 0]
    last = (doc_ends - 1)[lengths > 0]
    following = np.empty(n, np.uint8)
    following[:-1] = base[1:]
    following[last] = WHITE  # the end of a text: trailing white space stays one piece
    kind = np.array([C_O, C_L, C_N, C_W, C_W, C_O], np.uint8)[base]
    visible = (following != SPACE) & (following != WHITE)
    kind[(base == SPACE) & visible] = C_LED
    kind[(base == WHITE) & visible] = C_LONE
    mark = np.flatnonzero(base == APOSTROPHE)
    if len(mark):
        end_of = np.repeat(doc_ends, lengths)[mark] if len(mark) * 20 > n else doc_ends[np.searchsorted(doc_ends, mark, "right")]
        one = np.where(mark + 1 < end_of, points[np.minimum(mark + 1, n - 1)], 0)
        two = np.where(mark + 2 < end_of, points[np.minimum(mark + 2, n - 1)], 0)
        kind[mark[np.isin(one, [ord(c) for c in "stmd"])]] = C_SHORT
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        kind[mark[long]] = C_LONG
    of_class, product, nxt, begins, image = automaton()
    rows = -(-n // BLOCK)
    kinds = np.full(rows * BLOCK, C_W, np.uint8)
    kinds[:n] = kind
    restart = np.zeros(rows * BLOCK, np.uint8)
    restart[first] = 8
    columns = np.ascontiguousarray((kinds + restart).reshape(rows, BLOCK).T)
    size, flat = len(product), product.ravel()
    total = of_class[columns[0]].astype(np.int64)
    for j in range(1, BLOCK):
        total = flat[total * size + of_class[columns[j]]].astype(np.int64)
    shift = 1
    while shift < rows:  # inclusive scan of the rows' functions
        total = np.concatenate((total[:shift], flat[total[:-shift] * size + total[shift:]].astype(np.int64)))
        shift *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = image[total[:-1], CLOSED]
    is_start = np.empty((BLOCK, rows), bool)
    for j in range(BLOCK):
        column = columns[j]
        state[column >= 8] = CLOSED
        at = (column & 7).astype(np.intp) * 8 + state
        is_start[j] = begins.ravel()[at]
        state = nxt.ravel()[at]
    return np.flatnonzero(is_start.T.reshape(-1)[:n])
