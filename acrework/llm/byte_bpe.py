"""Byte-level BPE encoding and decoding by a rank file, as the tiktoken library would, without special tokens.

Pieces found by ``pretokenise`` are looked up in a worker's cache; those not there are merged together, many at once
in numpy: all pieces of one length form a matrix, and each step merges in every row the leftmost pair of least rank.
Offsets (bytes before each token) stay beside the ids, so any range of tokens can be decoded and placed in the text.

Defined results: null text is an empty text with no ids; repeated rows give repeated results; other columns of the
input are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrework.llm.common import documents, text_slices
from acrework.llm.pretokenise import piece_starts

#: Bytes that a worker's cache of pieces takes, what the interpreter adds to each piece included; it starts anew when full.
CACHE_BYTES, ENTRY_BYTES = 180_000_000, 230
#: A longer piece (base64, a script without spaces) is not kept.
LONGEST_KEPT = 64
#: Longer pieces are merged one by one with a heap, in n log n steps.
MATRIX_BYTES = 48
NONE = np.int64(1) << 40
_WORKER: dict[str, "Merger"] = {}


class PairTable:
    """Vectorised open addressing from a pair of ids to the id of their concatenation."""

    def __init__(self, pairs: np.ndarray, ids: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        left, depth = np.arange(len(pairs)), 0
        while len(left):
            slot = self._slot(pairs[left], depth)
            free = self.keys[slot] < 0
            _, chosen = np.unique(slot[free], return_index=True)
            placed = left[free][chosen]
            at = slot[free][chosen]
            self.keys[at], self.values[at] = pairs[placed], ids[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            depth += 1
        self.depth = depth

    def _slot(self, keys: np.ndarray, depth: int) -> np.ndarray:
        h = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return ((h + np.uint64(depth)) & np.uint64((1 << self.bits) - 1)).astype(np.intp)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), NONE, np.int64)
        left = np.arange(len(keys))
        for depth in range(self.depth):
            slot = self._slot(keys[left], depth)
            found = self.keys[slot]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            left = left[~hit & (found >= 0)]
            if not len(left):
                break
        return out


class Merger:
    """Ranks, their pair table, and the cache of encoded pieces."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.byte_ids = np.asarray([self.ranks[bytes([b])] for b in range(256)], np.int64)
        keys, ids = [], []
        for token, i in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    ids.append(i)
        self.pairs = PairTable(np.asarray(keys, np.int64), np.asarray(ids, np.int64))
        self.pair_ids = dict(zip(keys, ids))
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.limit = self.room = cache_bytes

    def merge_one(self, piece: bytes) -> list[int]:
        """Merge a long piece over a linked list, least rank first, leftmost among equals."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                rank = self.pair_ids.get(ids[i] * self.size + ids[j])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n):
            push(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [i for i in ids if i >= 0]

    def merge_rows(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all rows of a matrix of bytes; returns ids, padded, and their number in each row."""
        n, width = grid.shape
        ids = self.byte_ids[grid]
        count = np.full(n, width)
        if width == 1:
            return ids, count
        rank = self.pairs.get((ids[:, :-1] * self.size + ids[:, 1:]).ravel()).reshape(n, width - 1)
        rows, out = np.arange(n), ids.copy()  # rows that still merge are all of one width
        while len(rows):
            best = rank.argmin(1)
            value = rank[np.arange(len(rows)), best]
            live = value < NONE
            if not live.all():
                done = rows[~live]
                out[done, : ids.shape[1]] = ids[~live]
                rows, ids, rank, best, value = rows[live], ids[live], rank[live], best[live], value[live]
                if not len(rows):
                    break
            at = np.arange(len(rows))
            count[rows] -= 1
            ids[at, best] = value
            w = ids.shape[1]
            if w == 2:
                out[rows, 0] = ids[:, 0]
                break
            take = np.arange(w - 1)[None, :] + (np.arange(w - 1)[None, :] > best[:, None])
            ids = np.take_along_axis(ids, take, 1)
            kept = np.arange(w - 2)[None, :] + (np.arange(w - 2)[None, :] >= best[:, None])
            rank = np.take_along_axis(rank, kept, 1)
            has_left = best > 0
            l = best[has_left] - 1
            rank[at[has_left], l] = self.pairs.get(ids[at[has_left], l] * self.size + ids[at[has_left], l + 1])
            has_right = best < w - 2
            r = best[has_right]
            rank[at[has_right], r] = self.pairs.get(ids[at[has_right], r] * self.size + ids[at[has_right], r + 1])
        return out, count

    def encode_new(self, pieces: list[str]) -> dict[str, tuple[bytes, str]]:
        out: dict[str, tuple[bytes, str]] = {}
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                out[piece] = (np.asarray([whole], "<u4").tobytes(), str(whole))
            elif len(raw) > MATRIX_BYTES:
                ids = self.merge_one(raw)
                out[piece] = (np.asarray(ids, "<u4").tobytes(), ",".join(map(str, ids)))
            else:
                by_length.setdefault(len(raw), []).append((piece, raw))
        for length, some in by_length.items():
            grid = np.frombuffer(b"".join(raw for _, raw in some), np.uint8).reshape(-1, length)
            ids, count = self.merge_rows(grid)
            for (piece, _), row, k in zip(some, ids.tolist(), count.tolist()):
                row = row[:k]
                out[piece] = (np.asarray(row, "<u4").tobytes(), ",".join(map(str, row)))
        return out

    def encode_batch(self, texts: list[str]) -> list[list[tuple[bytes, str]]]:
        """For each text its pieces, each as id bytes and as decimal text."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        starts = piece_starts(points, ends)
        bounds = starts.tolist() + [len(joined)]
        pieces = [joined[a:b] for a, b in zip(bounds, bounds[1:])]
        cache = self.cache
        fresh = self.encode_new(list({p for p in pieces if p not in cache}))
        found = [fresh[p] if p in fresh else cache[p] for p in pieces] if fresh else [cache[p] for p in pieces]
        self._keep(fresh)
        cuts = np.searchsorted(starts, ends, "left").tolist()
        return [found[a:b] for a, b in zip([0, *cuts], cuts)]

    def _keep(self, fresh: dict[str, tuple[bytes, str]]) -> None:
        kept = {p: found for p, found in fresh.items() if len(p) <= LONGEST_KEPT}
        cost = sum(len(p) + len(ids) + len(text) + ENTRY_BYTES for p, (ids, text) in kept.items())
        if cost > self.room:
            self.cache.clear()
            self.room = self.limit
        if cost <= self.room:
            self.cache.update(kept)
            self.room -= cost

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def worker_merger(path: str) -> Merger:
    if path not in _WORKER:
        _WORKER[path] = Merger(path)
    return _WORKER[path]


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    merger = worker_merger(path)
    lengths = np.asarray([len(t) for t in merger.tokens], np.int64)
    for batch in text_slices(batches, "text"):
        texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
        ids = [np.frombuffer(b"".join([p[0] for p in found]), "<u4") for found in merger.encode_batch(texts)]
        offsets = [np.cumsum(lengths[i]) - lengths[i] for i in ids]
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64())), pa.array(offsets, pa.list_(pa.int64()))], ["doc_id", "ids", "offsets"]
        )


def encode_documents(docs: DataFrame, ranks: str) -> DataFrame:
    """Each document's ids and, beside each id, the number of the text's bytes before it."""
    return _texts(docs).mapInArrow(lambda it: _encode(it, ranks), "doc_id bigint, ids array<bigint>, offsets array<bigint>")


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """The bytes of each row's ids."""

    def run(batches):
        merger = worker_merger(ranks)
        for batch in batches:
            raw = [merger.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    merger = worker_merger(path)
    for batch in text_slices(batches, "text"):
        texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
        n, of_ids, of_bytes = [], [], []
        for found in merger.encode_batch(texts):
            ids = np.frombuffer(b"".join([p[0] for p in found]), "<u4")
            n.append(len(ids))
            of_ids.append(hashlib.sha256(",".join([p[1] for p in found]).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(merger.decode(ids.tolist())).hexdigest())
        yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip_digests(docs: DataFrame, ranks: str) -> DataFrame:
    """Encode and decode in one pass, keeping the digests of ids and of decoded bytes."""
    return _texts(docs).mapInArrow(lambda it: _digests(it, ranks), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text of ``documents`` and decode its ids again."""
    import public_tokenizers

    return round_trip_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
