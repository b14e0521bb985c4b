"""Word-aligned integer coding: each 64-bit word holds a 4-bit selector and as many equally wide values as fit.

A stream is cut into blocks of ``BLOCK`` values and no word crosses a block, so that
``offsets[i]`` is the first word of block ``i`` and blocks can be decoded alone, in any
order, or all at once. Selector 0 is the escape: its payload is the place of a value of
more than 60 bits in the stream's list of escaped values.

Packing is greedy as usual, but all blocks of a stream move forward together: at every
step each block takes the selector that holds most values from its present place.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 256
#: Values per word and bits per value by selector (fixed values of the format).
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
ESCAPE = 0
_PAD = int(COUNTS.max())


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(words, offsets, escaped)`` of unsigned values; empty input gives no block."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n, blocks = len(values), -(-len(values) // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32), np.zeros(0, np.uint64)
    grid = np.zeros((blocks, BLOCK + _PAD), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = values
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    classes = np.zeros((blocks, BLOCK + _PAD), np.uint8)  # how many of the widths a value does not fit in
    narrow = flat.astype(np.uint32) if values.max() < 1 << 32 else flat
    for bits in BITS[1:]:
        if values.max() >= 1 << int(bits):
            classes[:, :BLOCK] += (narrow >= narrow.dtype.type(1 << int(bits))).reshape(blocks, BLOCK)
    widest = {1: classes}  # most of the class over the next 1, 2, 4, .. values
    while 2 * max(widest) <= _PAD:
        half = max(widest)
        widest[2 * half] = np.maximum(widest[half][:, :-half], widest[half][:, half:])
    choice = np.zeros((blocks, BLOCK), np.int8)
    for selector in range(len(COUNTS) - 1, 0, -1):  # fuller words come last and win
        count = int(COUNTS[selector])
        half = 1 << (count.bit_length() - 1)
        most = np.maximum(widest[half][:, :BLOCK], widest[half][:, count - half : count - half + BLOCK])
        choice[most < selector] = selector
    ends = np.full(blocks, BLOCK, np.int64)
    ends[-1] = n - (blocks - 1) * BLOCK
    starts = np.zeros((blocks, BLOCK), bool)
    at, rows = np.zeros(blocks, np.int64), np.arange(blocks)
    while len(rows):
        starts[rows, at] = True
        at = at + COUNTS[choice[rows, at]]
        open_ = at < ends[rows]
        rows, at = rows[open_], at[open_]
    row, col = np.nonzero(starts)
    selectors = choice[row, col]
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(selectors):
        if selector == ESCAPE:
            continue
        here = np.nonzero(selectors == selector)[0]
        for j in range(int(COUNTS[selector])):
            words[here] |= grid[row[here], col[here] + j] << np.uint64(j * int(BITS[selector]))
    gone = np.nonzero(selectors == ESCAPE)[0]
    words[gone] |= np.arange(len(gone), dtype=np.uint64)
    offsets = np.zeros(blocks + 1, np.uint32)
    offsets[1:] = np.cumsum(np.bincount(row, minlength=blocks))
    return words, offsets, grid[row[gone], col[gone]]


def unpack(words: np.ndarray, offsets: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of a stream, all blocks at once."""
    blocks = len(offsets) - 1
    if blocks <= 0:
        return np.zeros(0, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    row = np.repeat(np.arange(blocks), np.diff(offsets.astype(np.int64)))
    before = np.cumsum(counts) - counts
    col = before - before[offsets[:-1].astype(np.int64)][row]
    grid = np.zeros((blocks, BLOCK + _PAD), np.uint64)
    for selector in np.unique(selectors):
        here = np.nonzero(selectors == selector)[0]
        mask = np.uint64((1 << int(BITS[selector])) - 1)
        for j in range(int(COUNTS[selector])):
            part = (words[here] >> np.uint64(j * int(BITS[selector]))) & mask
            grid[row[here], col[here] + j] = escaped[part.astype(np.int64)] if selector == ESCAPE else part
    return grid[:, :BLOCK].reshape(-1)[:n]


def unpack_block(words: np.ndarray, offsets: np.ndarray, escaped: np.ndarray, n: int, block: int) -> np.ndarray:
    """One block only, found through its offset."""
    part = words[int(offsets[block]) : int(offsets[block + 1])]
    size = min(BLOCK, n - block * BLOCK)
    return unpack(part, np.array([0, len(part)], np.uint32), escaped, size)


_HEAD = struct.Struct("<4sQQQQ")


def stream_bytes(values: np.ndarray) -> bytes:
    """A stream as bytes: head, block offsets, words, escaped values, all little-endian."""
    words, offsets, escaped = pack(values)
    head = _HEAD.pack(b"S8B1", len(values), len(words), len(offsets), len(escaped))
    return head + offsets.astype("<u4").tobytes() + words.astype("<u8").tobytes() + escaped.astype("<u8").tobytes()


def read_stream(content: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """``(values, end)`` of the stream that starts at byte ``at``."""
    magic, n, n_words, n_offsets, n_escaped = _HEAD.unpack_from(content, at)
    if magic != b"S8B1":
        raise ValueError("not a packed stream")
    at += _HEAD.size
    offsets = np.frombuffer(content, "<u4", n_offsets, at)
    at += 4 * n_offsets
    words = np.frombuffer(content, "<u8", n_words, at)
    at += 8 * n_words
    escaped = np.frombuffer(content, "<u8", n_escaped, at)
    return unpack(words, offsets, escaped, n), at + 8 * n_escaped
