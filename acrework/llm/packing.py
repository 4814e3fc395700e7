"""Packing of documents into training sequences along a space-filling curve.

A document's tokens are its hashed features: each token id has a fixed random direction, and the mean over the tokens
projects the document's vector to ``DIMS`` coordinates.  Their place on a Hilbert curve is the sort key; documents are
range-partitioned by it (ties, such as copies, are split by a hash of the id), and each partition is packed along the
curve: a sequence is filled to its last place and the document cut there.  What is left at a partition's end becomes
sequences of powers of two, so that nothing is padded at all.

Texts are tokenised once, without a shuffle; the ids travel compressed.

Defined results: null text is an empty text (only the end id); rows that share a doc_id are packed as rows of their
own; a null doc_id is packed too; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrework.llm.common import documents, materialise, text_slices
from acrework.llm.library_bpe import with_end, worker_encoder

LENGTH = 2048
DIMS, BITS = 4, 15
#: Means of token directions lie well within this; the few beyond share the outermost cell.
REACH = 1.0
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer cells (rows of coordinates below 2**bits)."""
    x = [c.astype(np.int64) for c in cells.T]
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess rotations and reflections, from the coarsest level down
        low = q - 1
        for i in range(dims):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(x[i] & q, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | ((x[i] ^ flip) >> bit & 1)
    return key


def _directions(n: int) -> np.ndarray:
    return np.random.default_rng(31337).normal(0, 1, (n, DIMS)).astype(np.float32)


def _tokenised(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    import zstandard

    encoder, pack = worker_encoder(tokenizer), zstandard.ZstdCompressor(level=1)
    directions = _directions(len(encoder.byte_len))
    kind = "<u2" if len(directions) <= 65536 else "<u4"
    for batch in text_slices(batches, "text"):
        ids, count = with_end(*encoder.encode(batch.column("text")), end_id)
        first = np.cumsum(count) - count
        mean = np.stack([np.add.reduceat(directions[:, k][ids], first) for k in range(DIMS)], 1) / count[:, None]
        cells = np.clip((mean / REACH + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        small = ids.astype(kind)
        payload = [pack.compress(small[a : a + n].tobytes()) for a, n in zip(first.tolist(), count.tolist())]
        yield pa.record_batch([batch.column("doc_id"), pa.array(hilbert_key(cells)), pa.array(count), pa.array(payload, pa.binary())], ["doc_id", "place", "n", "ids"])


def _fill(batches: Iterator[pa.RecordBatch], length: int, wide: bool) -> Iterator[pa.RecordBatch]:
    """Cut the documents of a partition, in order, into full sequences, and the rest into powers of two."""
    import zstandard

    unpack, kind = zstandard.ZstdDecompressor(), "<u4" if wide else "<u2"
    sequence, used, rows = np.int64(TaskContext.get().partitionId()) << 40, 0, []
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    open_pieces: list[tuple] = []  # of the sequence that is not full yet: doc_id, start, ids, doc_tokens

    def close(pieces: list[tuple]) -> None:
        nonlocal sequence
        at = 0
        for doc_id, start, ids, total in pieces:
            rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, int(sequence), at))
            at += len(ids)
        sequence += 1

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], names)

    for batch in batches:
        for doc_id, payload in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
            ids = np.frombuffer(unpack.decompress(payload.as_py()), kind).astype("<u4")
            start = 0
            while start < len(ids):
                take = min(length - used, len(ids) - start)
                open_pieces.append((doc_id, start, ids[start : start + take], len(ids)))
                start, used = start + take, used + take
                if used == length:
                    close(open_pieces)
                    open_pieces, used = [], 0
        if len(rows) > 20_000:
            yield batch_of(rows)
            rows.clear()
    while used:
        size, now, later = 1 << (used.bit_length() - 1), [], []
        room = size
        for doc_id, start, ids, total in open_pieces:
            take = min(room, len(ids))
            if take:
                now.append((doc_id, start, ids[:take], total))
            if take < len(ids):
                later.append((doc_id, start + take, ids[take:], total))
            room -= take
        close(now)
        open_pieces, used = later, used - size
    yield batch_of(rows)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """One row for each piece of a document: where it lies in its document and in its sequence."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = materialise(texts.mapInArrow(lambda it: _tokenised(it, tokenizer, end_id), "doc_id bigint, place bigint, n bigint, ids binary"), "tokenised", codec="none")
    along = tokens.withColumn("tie", F.xxhash64("doc_id")).repartitionByRange("place", "tie").sortWithinPartitions("place", "tie", "n").select("doc_id", "ids")
    wide = _vocabulary_size(tokenizer) > 65536
    return along.mapInArrow(lambda it: _fill(it, length, wide), PIECES)


def _vocabulary_size(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values(), default=0) + 1


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 2048."""
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
