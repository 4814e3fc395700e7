"""Union-free regular expressions over the structure of web pages: folding a page, and aligning two of them.

An expression is a nested list of elements, text slots and groups of siblings; each has an occurrence, which may be
optional or repeated.  There are no alternatives.  A page folds into an expression without options; two expressions are
aligned, and each mismatch becomes a repetition of its neighbour where it is like it, otherwise an option.
"""

from __future__ import annotations

from acrework.llm.html_tokens import Node

OPTIONAL, REPEATED = 1, 2
#: Siblings of a repeated group; longer groups stay unfolded.
PERIOD = 6
#: So many siblings of one name in a row are a list, even if each is different inside.
SERIES = 8
#: Steps of an alignment.
_A, _B, _BOTH, _MORE_B, _MORE_A = range(1, 6)


def dump(nodes: list[Node]) -> list:
    """The expression as nested lists of key, occurrence and content; the order of texts numbers the slots."""
    return [[n.key, n.occ, dump(n.kids)] for n in nodes]


def load(nested: list, slots: list[Node] | None = None) -> tuple[list[Node], list[Node]]:
    """The nodes of a dumped expression, and its slots in order."""
    slots = [] if slots is None else slots
    out = []
    for key, occ, kids in nested:
        node = Node(key, load(kids, slots)[0], occ)
        if key == "#":
            node.slot = len(slots)
            slots.append(node)
        out.append(node)
    return out, slots


def leaves(nodes: list[Node]) -> list[Node]:
    """The texts of an expression, in order."""
    out = []
    for n in nodes:
        out += [n] if n.key == "#" else leaves(n.kids)
    return out


def unite(a: Node, b: Node, repeated: bool) -> Node:
    """One node for two of the same key; ``repeated`` if they are neighbours rather than counterparts."""
    if a.shape == b.shape:
        for x, y in zip(a.kids, b.kids):
            unite(x, y, False)
    else:
        a.kids = align(a.kids, b.kids)
        a.reshape()
    a.occ |= b.occ
    if repeated:
        a.occ |= REPEATED
    a.blocks += b.blocks
    a.slot = b.slot if a.slot is None else a.slot
    return a


def fold(nodes: list[Node]) -> list[Node]:
    """Siblings that repeat become one node or group, from the innermost out."""
    for n in nodes:
        if n.kids:
            n.kids = fold(n.kids)
            n.reshape()
    out: list[Node] = []
    for n in nodes:
        if out and out[-1].shape == n.shape:
            unite(out[-1], n, True)
        else:
            out.append(n)
    out = _series(out)
    for period in range(2, PERIOD + 1):
        out = _groups(out, period)
    return out


def _series(nodes: list[Node]) -> list[Node]:
    out, at = [], 0
    while at < len(nodes):
        end = at + 1
        while end < len(nodes) and nodes[end].key == nodes[at].key:
            end += 1
        if end - at >= SERIES:
            for other in nodes[at + 1 : end]:
                unite(nodes[at], other, True)
            out.append(nodes[at])
        else:
            out += nodes[at:end]
        at = end
    return out


def _groups(nodes: list[Node], period: int) -> list[Node]:
    shapes = [n.shape for n in nodes]
    out, at = [], 0
    while at < len(nodes):
        end = at + period
        while end + period <= len(nodes) and shapes[end : end + period] == shapes[at : at + period]:
            end += period
        if end > at + period and end <= len(nodes):
            for other in range(at + period, end, period):
                for k in range(period):
                    unite(nodes[at + k], nodes[other + k], False)
            out.append(_group(nodes[at : at + period], REPEATED))
            at = end
        else:
            out.append(nodes[at])
            at += 1
    return out


def _group(nodes: list[Node], occ: int) -> Node:
    return Node(f"({' '.join(n.key for n in nodes)})", nodes, occ)


def _grouped_like(nodes: list[Node], other: list[Node]) -> list[Node]:
    """Nodes that stand once where the other side has a repeated group form one too."""
    for group in {n.key: n for n in other if n.key.startswith("(")}.values():
        keys, out, at = [k.key for k in group.kids], [], 0
        while at < len(nodes):
            if [n.key for n in nodes[at : at + len(keys)]] == keys:
                out.append(_group(nodes[at : at + len(keys)], 0))
                at += len(keys)
            else:
                out.append(nodes[at])
                at += 1
        nodes = out
    return nodes


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """One list of siblings that covers both."""
    a, b = _grouped_like(a, b), _grouped_like(b, a)
    out: list[Node] = []
    for left, right in _partners(a, b):
        if left and right:
            node = left[0]
            for other in left[1:]:
                unite(node, other, True)
            for k, other in enumerate(right):
                unite(node, other, k > 0)
            _put(out, node)
        else:
            for node in left or right:
                node.occ |= OPTIONAL
                _put(out, node)
    return out


def _put(out: list[Node], node: Node) -> None:
    """Append, unless the node is one more of the last: that is repeated then."""
    last = out[-1] if out else None
    one_more = last is not None and last.key == node.key and (last.shape == node.shape or (last.occ | node.occ) & REPEATED)
    if one_more and (last.occ | node.occ) & (OPTIONAL | REPEATED):
        optional = last.occ & node.occ & OPTIONAL
        unite(last, node, True)
        last.occ = last.occ & ~OPTIONAL | optional
    else:
        out.append(node)


def _likeness(x: Node, y: Node) -> int:
    return 0 if x.key != y.key else 3 if x.shape == y.shape else 2


def _partners(a: list[Node], b: list[Node]) -> list[tuple[list[Node], list[Node]]]:
    """Both lists cut into counterparts, in order; a repeated node may have several, a node without has none."""
    before, moves = [0] * (len(b) + 1), [bytearray([0] + [_B] * len(b))]  # one row of sums is kept, and a byte for each cell
    for x in a:
        row, move, last = [before[0]], bytearray(len(b) + 1), moves[-1]
        move[0], many = _A, x.occ & REPEATED
        for j, y in enumerate(b, 1):
            most, step = before[j], _A
            if row[j - 1] > most:
                most, step = row[j - 1], _B
            if like := _likeness(x, y):
                if before[j - 1] + like > most:
                    most, step = before[j - 1] + like, _BOTH
                if many and move[j - 1] in (_BOTH, _MORE_B) and row[j - 1] + like > most:
                    most, step = row[j - 1] + like, _MORE_B
                if y.occ & REPEATED and last[j] in (_BOTH, _MORE_A) and before[j] + like > most:
                    most, step = before[j] + like, _MORE_A
            row.append(most)
            move[j] = step
        before = row
        moves.append(move)
    out: list[tuple[list[Node], list[Node]]] = []
    i, j = len(a), len(b)
    left, right = [], []
    while i or j:
        step = moves[i][j]
        if step == _A:
            out.append(([a[i - 1]], []))
        elif step == _B:
            out.append(([], [b[j - 1]]))
        elif step == _MORE_B:
            right.append(b[j - 1])
        elif step == _MORE_A:
            left.append(a[i - 1])
        else:
            out.append(([a[i - 1], *left[::-1]], [b[j - 1], *right[::-1]]))
            left, right = [], []
        i -= step in (_A, _BOTH, _MORE_A)
        j -= step in (_B, _BOTH, _MORE_B)
    return out[::-1]
