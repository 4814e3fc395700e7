"""Patched frame-of-reference coding of token ids.

Ids are cut into blocks.  Each block stores its minimum, the differences packed at the width that holds the chosen
percentile of them, and the few larger differences as exceptions (position and value).  A block index with byte
offsets makes every block readable alone.  Layout, little-endian::

    b"PFR1" | u32 block size | u64 ids | u32 blocks | u32 minimum[] | u8 width[] | u16 exceptions[] | u64 start[] | body
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"PFR1"
HEAD = struct.Struct("<4sIQI")


def _widths(values: np.ndarray) -> np.ndarray:
    return np.where(values > 0, np.floor(np.log2(np.maximum(values, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as bytes, least bits first: every 8 values fill ``width`` bytes."""
    rows, block = values.shape
    eights = -(-block // 8)
    if block % 8:
        values = np.pad(values, ((0, 0), (0, 8 * eights - block)))
    columns = np.ascontiguousarray(values.reshape(-1, 8).T)
    out = np.zeros((width, rows * eights), np.uint8)
    for i in range(8):
        for byte in range(i * width // 8, (i * width + width - 1) // 8 + 1):
            shift = 8 * byte - i * width
            out[byte] |= (columns[i] >> shift if shift >= 0 else columns[i] << -shift).astype(np.uint8)
    packed = np.ascontiguousarray(out.T).reshape(rows, -1)
    return packed[:, : (block * width + 7) // 8]


def _unpack(packed: np.ndarray, width: int, block: int) -> np.ndarray:
    """The values of ``_pack``."""
    rows, eights = len(packed), -(-block // 8)
    if packed.shape[1] < eights * width:
        packed = np.pad(packed, ((0, 0), (0, eights * width - packed.shape[1])))
    columns = np.ascontiguousarray(packed.reshape(-1, width).T).astype(np.uint32)
    out = np.zeros((8, rows * eights), np.uint32)
    for i in range(8):
        for byte in range(i * width // 8, (i * width + width - 1) // 8 + 1):
            shift = 8 * byte - i * width
            out[i] |= columns[byte] << shift if shift >= 0 else columns[byte] >> -shift
    out &= np.uint32((1 << width) - 1)
    return np.ascontiguousarray(out.T).reshape(rows, -1)[:, :block]


def encode(ids: np.ndarray, block: int = 256, percentile: float = 95.0) -> bytes:
    """Encode unsigned 32-bit ids; no ids give a header alone."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n = len(ids)
    blocks = -(-n // block)
    if blocks == 0:
        return HEAD.pack(MAGIC, block, 0, 0)
    grid = np.full(blocks * block, ids[-1], np.uint32)
    grid[:n] = ids
    grid = grid.reshape(blocks, block)
    low = grid.min(1)
    rest = grid - low[:, None]
    rank = min(block - 1, int(np.ceil(block * percentile / 100)) - 1)
    width = _widths(np.partition(rest, rank, axis=1)[:, rank])
    big = rest > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    n_exc = big.sum(1)
    packed_bytes = (block * width + 7) // 8
    start = np.zeros(blocks + 1, np.int64)
    np.cumsum(packed_bytes + 6 * n_exc, out=start[1:])
    body = np.zeros(int(start[-1]), np.uint8)
    for w in np.unique(width).tolist():
        if w == 0:
            continue
        rows = np.flatnonzero(width == w)
        packed = _pack(np.where(big[rows], 0, rest[rows]), w)
        body[start[rows][:, None] + np.arange(packed.shape[1])] = packed
    at_block, at = np.nonzero(big)
    if len(at):
        order = np.arange(len(at)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
        base = (start[:-1] + packed_bytes)[at_block]
        place = base + 2 * order
        body[place[:, None] + np.arange(2)] = at.astype("<u2").view(np.uint8).reshape(-1, 2)
        place = base + 2 * n_exc[at_block] + 4 * order
        body[place[:, None] + np.arange(4)] = rest[at_block, at].astype("<u4").view(np.uint8).reshape(-1, 4)
    return b"".join(
        (
            HEAD.pack(MAGIC, block, n, blocks),
            low.astype("<u4").tobytes(),
            width.astype(np.uint8).tobytes(),
            n_exc.astype("<u2").tobytes(),
            start[:-1].astype("<u8").tobytes(),
            body.tobytes(),
        )
    )


def decode(data: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The ids of blocks first_block (inclusive) to last_block (exclusive; None: all), without touching other blocks."""
    magic, block, n, blocks = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a patched frame-of-reference file")
    last = blocks if last_block is None else min(last_block, blocks)
    if first_block >= last:
        return np.zeros(0, np.uint32)
    at = HEAD.size
    low = np.frombuffer(data, "<u4", blocks, at)[first_block:last]
    at += 4 * blocks
    width = np.frombuffer(data, np.uint8, blocks, at)[first_block:last].astype(np.int64)
    at += blocks
    n_exc = np.frombuffer(data, "<u2", blocks, at)[first_block:last].astype(np.int64)
    at += 2 * blocks
    start = np.frombuffer(data, "<u8", blocks, at)[first_block:last].astype(np.int64)
    body = np.frombuffer(data, np.uint8, offset=at + 8 * blocks)
    packed_bytes = (block * width + 7) // 8
    rest = np.zeros((last - first_block, block), np.uint32)
    for w in np.unique(width).tolist():
        if w == 0:
            continue
        rows = np.flatnonzero(width == w)
        rest[rows] = _unpack(body[start[rows][:, None] + np.arange(int(packed_bytes[rows[0]]))], w, block)
    if n_exc.any():
        owner = np.repeat(np.arange(len(n_exc)), n_exc)
        order = np.arange(len(owner)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
        base = (start + packed_bytes)[owner]
        where = body[(base + 2 * order)[:, None] + np.arange(2)].reshape(-1, 2).copy().view("<u2")[:, 0]
        value = body[(base + 2 * n_exc[owner] + 4 * order)[:, None] + np.arange(4)].reshape(-1, 4).copy().view("<u4")[:, 0]
        rest[owner, where] = value
    ids = (rest + low[:, None]).reshape(-1)
    return ids[: n - first_block * block] if last == blocks else ids


def read_range(data: bytes, start: int, length: int) -> np.ndarray:
    """Ids start to start + length, decoding only the blocks that hold them."""
    block = HEAD.unpack_from(data)[1]
    first = start // block
    return decode(data, first, -(-(start + length) // block))[start - first * block :][:length]
