"""Boolean trigram queries from regular expressions, and a small inverted index to answer them.

A query is true for every text that the expression can match.  Literals of a concatenation are joined into alternative
strings (case folded); each string gives the conjunction of its trigrams, alternatives give a disjunction, and parts
without a literal of three characters give TRUE.  A rule whose whole query is TRUE has no mandatory trigram.
"""

from __future__ import annotations

import re
from itertools import product

import numpy as np

try:
    from re import _constants as C
    from re import _parser as parser
except ImportError:  # before 3.11
    import sre_constants as C
    import sre_parse as parser

TRUE = ("true",)
#: More alternatives than these are not spelt out; the part then gives no trigrams, which is still right.
MOST_STRINGS = 32


def _and(parts: list[tuple]) -> tuple:
    parts = list(dict.fromkeys(p for p in parts if p != TRUE))
    return TRUE if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(parts: list[tuple]) -> tuple:
    parts = list(dict.fromkeys(parts))
    return TRUE if TRUE in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _strings_query(strings: set[str]) -> tuple:
    """Alternatives as a query; trigrams are of UTF-8 bytes."""
    each = []
    for s in sorted(strings):
        raw = s.encode()
        each.append(_and([("has", raw[i : i + 3]) for i in range(len(raw) - 2)]))
    return _or(each)


def _fold(char: int) -> str:
    return chr(char).lower() if char < 128 else chr(char)


def _members(items) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(_fold(value))
        elif op is C.RANGE and value[1] - value[0] < MOST_STRINGS:
            out |= {_fold(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _analyse(nodes) -> tuple[set[str] | None, tuple]:
    """The finite set of strings that the nodes match (None: not finite or too many), and a query they imply."""
    done, known, finite = [], {""}, True
    for op, value in nodes:
        exact, implied = _node(op, value)
        if exact is not None and len(known) * len(exact) <= MOST_STRINGS:
            known = {a + b for a, b in product(known, exact)}
            continue
        finite = False
        done += [_strings_query(known), implied if exact is None else _strings_query(exact)]
        known = {""} if exact is None else set(exact)
    if finite:
        return known, _strings_query(known)
    return None, _and([*done, _strings_query(known)])


def _node(op, value) -> tuple[set[str] | None, tuple]:
    if op is C.LITERAL:
        return {_fold(value)}, TRUE
    if op is C.IN:
        return _members(value), TRUE
    if op is C.AT:
        return {""}, TRUE
    if op is C.SUBPATTERN:
        return _analyse(value[3])
    if op is C.BRANCH:
        each = [_analyse(nodes) for nodes in value[1]]
        if all(exact is not None for exact, _ in each):
            union = set().union(*(exact for exact, _ in each))
            if len(union) <= MOST_STRINGS:
                return union, TRUE
        return None, _or([query if exact is None else _strings_query(exact) for exact, query in each])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, nodes = value
        exact, query = _analyse(nodes)
        if exact is not None and high == 1:
            return exact | {""} if low == 0 else exact, TRUE
        if exact is not None and low == high and len(exact) ** low <= MOST_STRINGS:
            return {"".join(p) for p in product(exact, repeat=low)}, TRUE
        return None, TRUE if low == 0 else query if exact is None else _strings_query(exact)
    return None, TRUE


def trigram_query(pattern: str, flags: int = 0) -> tuple:
    """The Boolean query of an expression over ASCII-lower-cased text."""
    exact, query = _analyse(parser.parse(pattern, flags))
    return query if exact is None else _strings_query(exact)


def trigrams(query: tuple) -> set[bytes]:
    return {query[1]} if query[0] == "has" else set().union(*(trigrams(q) for q in query[1:]), set())


_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


class TrigramIndex:
    """Postings of the trigrams that some rule asks for, over a segment of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: "WantedTrigrams"):
        self.n = len(offsets) - 1
        low = _LOWER[data]
        codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:] if len(low) > 2 else np.zeros(0, np.uint32)
        at = np.flatnonzero(wanted.is_wanted[codes])
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[doc + 1]
        pairs = np.unique(np.searchsorted(wanted.codes, codes[at[inside]]) * max(self.n, 1) + doc[inside])
        term, self.docs = np.divmod(pairs, max(self.n, 1))
        self.bounds = np.searchsorted(term, np.arange(len(wanted.codes) + 1))
        self.place = wanted.place

    def postings(self, trigram: bytes) -> np.ndarray:
        i = self.place[trigram]
        return self.docs[self.bounds[i] : self.bounds[i + 1]]

    def candidates(self, query: tuple) -> np.ndarray:
        """Ascending positions of the texts that satisfy the query."""
        if query == TRUE:
            return np.arange(self.n)
        if query[0] == "has":
            return self.postings(query[1])
        lists = [self.candidates(q) for q in query[1:]]
        if query[0] == "or":
            return np.unique(np.concatenate(lists))
        lists.sort(key=len)
        out = lists[0]
        for other in lists[1:]:
            out = np.intersect1d(out, other, assume_unique=True)
        return out


class WantedTrigrams:
    """The trigrams of all rules, as a table over three-byte codes."""

    def __init__(self, queries: list[tuple]):
        every = sorted(set().union(*(trigrams(q) for q in queries), set()))
        self.place = {t: i for i, t in enumerate(every)}
        self.codes = np.asarray([int.from_bytes(t, "big") for t in every], np.uint32)
        self.is_wanted = np.zeros(1 << 24, bool)
        self.is_wanted[self.codes] = True
