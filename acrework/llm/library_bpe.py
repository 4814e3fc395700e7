"""Token ids of whole texts by the ``tokenizers`` library, each different piece of text encoded once.

A byte-level BPE pre-tokeniser cuts a text where a word meets a mark, before white space, and after a single line end,
whatever stands around; what lies between two such cuts always has the same ids.  The cuts are found in whole arrays
of bytes, a piece is looked up by its hash and confirmed byte by byte, and only pieces not yet known go to the library.
Where it is not certain that there is a cut (beside letters outside the Latin blocks, quotes, runs of white space)
there is none, and the piece is longer.  A text that holds the content of an added token is encoded whole, since the
library finds these before it cuts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from acrework.llm.common import same_bytes, utf8
from acrework.llm.rolling import Prefix

#: Bytes of the table of known pieces that a worker keeps; further new pieces are encoded again each time.
CACHE_BYTES = 64_000_000
#: A longer piece (base64, a script without spaces) is not kept.
LONGEST_KEPT = 64
OTHER, WORD, MARK, SPACE, LINE, QUOTE = range(6)
_WORKER: dict[tuple[str, int], "PieceEncoder"] = {}


def _byte_classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    for b in range(128):
        c = chr(b)
        table[b] = WORD if c.isalnum() else SPACE if c == " " else LINE if c == "\n" else QUOTE if c == "'" else MARK if c.isprintable() else OTHER
    table[0xC3:0xCA] = WORD  # U+00C0 to U+024F: letters in every version of Unicode, but for two signs
    return table


_CLASS = _byte_classes()
_VISIBLE = np.isin(np.arange(6), (WORD, MARK, QUOTE))
#: By class before and after: a cut whatever else stands around.
_CUT = np.zeros((6, 6), bool)
_CUT[WORD, MARK] = _CUT[MARK, WORD] = True
_CUT[_VISIBLE, LINE] = True


def classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    out = _CLASS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    if len(lead):
        first, second = data[lead], data[lead + 1]
        sign = (first == 0xC3) & ((second == 0x97) | (second == 0xB7))
        out[lead[sign | ((first == 0xC9) & (second > 0x8F))]] = OTHER
        out[lead + 1] = out[lead]
    return out


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending places where a piece begins: certain cuts and the starts of texts that are not empty."""
    n = len(data)
    kind = classes(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    visible = _VISIBLE[kind]
    begin = np.zeros(n, bool)
    begin[1:] = _CUT.ravel()[kind[:-1] * 6 + kind[1:]]
    # a space or a line end alone between two visible characters of one text
    alone = np.zeros(n, bool)
    alone[1:-1] = visible[:-2] & visible[2:] & ~edge[1:-2] & ~edge[2:-1]
    begin |= alone & (kind == SPACE)
    begin[1:] |= (alone & (kind == LINE))[:-1]
    begin |= edge[:n]
    return np.flatnonzero(begin)


class PieceTable:
    """Open addressing from the hash of a piece to its bytes and ids; a hit is confirmed on the bytes."""

    def __init__(self, limit: int):
        self.bits = max(10, int(np.log2(max(1, limit // 32))))
        self.hash, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.room, self.most = limit - 12 * (1 << self.bits), 1 << (self.bits - 1)
        self.n = 0
        self.bytes, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        self.bounds, self.id_bounds = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _slots(self, hashes: np.ndarray, step: int) -> np.ndarray:
        return ((hashes >> np.uint64(64 - self.bits)) + np.uint64(step) & np.uint64((1 << self.bits) - 1)).astype(np.intp)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        out, left, step = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), 0
        while len(left):
            slot = self._slots(hashes[left], step)
            found = self.hash[slot]
            hit = (found == hashes[left]) & (found != 0)
            out[left[hit]] = self.entry[slot[hit]]
            left, step = left[~hit & (found != 0)], step + 1
        return out

    def add(self, hashes: np.ndarray, data: np.ndarray, size: np.ndarray, ids: np.ndarray, n_ids: np.ndarray) -> None:
        """Keep new, different hashes while there is room; 0 marks an empty slot and is never kept."""
        cost = np.cumsum(size + 4 * n_ids + 16)
        n = min(int(np.searchsorted(cost, self.room, "right")), self.most - self.n)
        kept = np.flatnonzero((np.arange(len(hashes)) < n) & (size <= LONGEST_KEPT) & (hashes != 0))
        if not len(kept):
            return
        self.room -= int(cost[n - 1])
        flag = np.zeros(len(hashes), bool)
        flag[kept] = True
        self.bytes = np.concatenate((self.bytes, data[np.repeat(flag, size)]))
        self.ids = np.concatenate((self.ids, ids[np.repeat(flag, n_ids)]))
        self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(size[kept]))
        self.id_bounds = np.append(self.id_bounds, self.id_bounds[-1] + np.cumsum(n_ids[kept]))
        left, step = np.arange(len(kept)), 0
        while len(left):
            slot = self._slots(hashes[kept[left]], step)
            free = np.flatnonzero(self.hash[slot] == 0)
            _, chosen = np.unique(slot[free], return_index=True)
            placed = free[chosen]
            self.hash[slot[placed]] = hashes[kept[left[placed]]]
            self.entry[slot[placed]] = self.n + left[placed]
            left, step = np.delete(left, placed), step + 1
        self.n += len(kept)


def _concatenated(arrays: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


class PieceEncoder:
    """Encodes texts to unsigned 32-bit ids, as ``tokenizers`` would with add_special_tokens=False."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.table = PieceTable(cache_bytes)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.byte_len = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.byte_len[i] = len(token)  # a byte-level vocabulary has one character for each byte

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _together(self, pieces: list[bytes], before: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces in one call, each behind ``before``: ids are dealt back by their bytes, ``before`` left out."""
        joined = (before + before.join(pieces)).decode()
        ids = np.asarray(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum([len(p) + len(before) for p in pieces])
        after = np.searchsorted(np.cumsum(self.byte_len[ids]), ends, "left") + 1
        n_ids = np.diff(after, prepend=0)
        if before:  # a line end is an id of its own
            keep = np.ones(len(ids), bool)
            keep[after - n_ids] = False
            ids, n_ids = ids[keep], n_ids - 1
        return ids, n_ids

    def _encode_pieces(self, pieces: list[bytes], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces, one after the other, and their numbers; ``kind``: 1 led by a space, 2 by a word or
        mark, both up to a visible character; 0 any other."""
        counts, parts, where = np.zeros(len(pieces), np.int64), [], []
        for k, before in ((1, b""), (2, b"\n")):
            own = np.flatnonzero(kind == k)
            for at in range(0, len(own), 4096):
                some = own[at : at + 4096]
                chosen = [pieces[i] for i in some.tolist()]
                if any(content.encode() in before + before.join(chosen) for content in self.added):
                    kind[some] = 0  # only by pieces of different texts side by side
                    continue
                ids, counts[some] = self._together(chosen, before)
                parts.append(ids)
                where.append(some)
        for i in np.flatnonzero(kind == 0).tolist():
            ids = self.whole(pieces[i].decode())
            counts[i] = len(ids)
            parts.append(ids)
            where.append(np.asarray([i]))
        order = _concatenated(where, np.int64)
        flat = _concatenated(parts, np.uint32)
        first = np.zeros(len(pieces), np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        return _gather(flat, first, counts), counts

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, one after the other, and the n + 1 offsets of the texts."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column, "")
        whole = np.zeros(len(column), bool)
        for content in self.added:
            whole |= pc.match_substring(column, content).to_numpy(zero_copy_only=False)
        apart = {i: self.whole(column[i].as_py()) for i in np.flatnonzero(whole).tolist()}
        ids, offsets = self._encode_plain(pc.if_else(pa.array(whole), "", column) if apart else column)
        if not apart:
            return ids, offsets
        parts = [apart.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist()))]
        return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))

    def _encode_plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = utf8(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        table = self.table
        start = cuts(data, offsets)
        size = np.diff(start, append=len(data))
        hashes = Prefix(data).ranges(start, start + size)
        entry = table.find(hashes)
        known = np.flatnonzero(entry >= 0)
        right = size[known] == np.diff(table.bounds)[entry[known]]
        known = known[right]
        known = known[same_bytes(data, start[known], table.bytes, table.bounds[entry[known]], size[known])]
        new = np.ones(len(start), bool)
        new[known] = False
        new = np.flatnonzero(new)
        first, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        first[known], count[known] = table.id_bounds[entry[known]], np.diff(table.id_bounds)[entry[known]]
        ids = table.ids
        if len(new):
            _, one, of = np.unique(hashes[new], return_index=True, return_inverse=True)
            one = new[one]
            like = same_bytes(data, start[new], data, start[one][of], np.minimum(size[new], size[one][of])) & (size[new] == size[one][of])
            odd = new[~like]  # another piece with the same hash: encoded by itself
            one = np.append(one, odd)
            raw = data.tobytes()
            kind = classes(data)
            last, head = _VISIBLE[kind[start[one] + size[one] - 1]], kind[start[one]]
            second = _VISIBLE[kind[np.minimum(start[one] + 1, len(data) - 1)]] & (size[one] > 1)
            led = np.where(last & (head == SPACE) & second, 1, np.where(last & ((head == WORD) | (head == MARK)), 2, 0))
            fresh, n_ids = self._encode_pieces([raw[a:b] for a, b in zip(start[one].tolist(), (start[one] + size[one]).tolist())], led)
            at = len(ids) + np.cumsum(n_ids) - n_ids
            usual = len(one) - len(odd)
            first[new[like]], count[new[like]] = at[of[like]], n_ids[of[like]]
            first[odd], count[odd] = at[usual:], n_ids[usual:]
            ids = np.concatenate((ids, fresh))
            unknown = entry[one[:usual]] < 0
            keep, keep_ids = np.flatnonzero(unknown), np.repeat(np.append(unknown, np.zeros(len(odd), bool)), n_ids)
            table.add(hashes[one[keep]], _gather(data, start[one[keep]], size[one[keep]]), size[one[keep]], fresh[keep_ids], n_ids[keep])
        total = np.append(0, np.cumsum(count))
        return _gather(ids, first, count), total[np.searchsorted(start, offsets, "left")]


def _gather(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """values[first : first + count] of each range, one after the other."""
    ends = np.cumsum(count)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id behind each text, and the number of ids of each text, its end id included."""
    return np.insert(ids, offsets[1:], np.uint32(end_id)), np.diff(offsets) + 1


def worker_encoder(path: str, cache_bytes: int = CACHE_BYTES) -> PieceEncoder:
    """The encoder of this Python worker; Spark reuses workers, so its table serves many tasks."""
    key = (path, cache_bytes)
    if key not in _WORKER:
        _WORKER[key] = PieceEncoder(path, cache_bytes)
    return _WORKER[key]
