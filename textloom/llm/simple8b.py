"""Simple-8b: whole numbers packed into 64-bit words.

The top four bits of a word hold its selector, which says how many numbers of how many bits follow. Selector 0 is an
escape: the next word is one number of up to 64 bits. Numbers are coded in blocks that end at a word's end; a segment
keeps the word at which each block starts, so that all blocks are decoded side by side."""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the format: numbers in a word and bits of each, by selector.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
ESCAPE = 0
BLOCK = 128
MAGIC = b"S8B1"
HEAD = "<4sIQQQ"  # magic, block length, numbers, words, escapes
HEAD_BYTES = struct.calcsize(HEAD)


def _choices(ids: np.ndarray, block: int) -> np.ndarray:
    """For each position, the selector that packs the most numbers from there on within the block."""
    n = len(ids)
    at = np.arange(n, dtype=np.int64)
    room = np.minimum((at // block + 1) * block, n) - at
    best = np.where(ids >> np.uint64(60) == 0, 15, ESCAPE).astype(np.uint8)
    for s in range(14, 0, -1):
        c = int(COUNTS[s])
        if c > min(block, n):
            continue
        wide = np.zeros(n + 1, np.int32)
        np.cumsum(ids >> np.uint64(BITS[s]) != 0, out=wide[1:])
        fits = np.zeros(n, bool)
        fits[: n - c + 1] = wide[c:] == wide[: n - c + 1]
        best[fits & (room >= c)] = s
    return best


def encode(ids, block: int = BLOCK) -> bytes:
    """A segment for ``ids`` (any whole numbers below 2**64; none gives a segment of no blocks)."""
    ids = np.asarray(ids).astype(np.uint64)
    n = len(ids)
    blocks = -(-n // block)
    chosen = _choices(ids, block)
    cursor = np.arange(blocks, dtype=np.int64) * block
    end = np.minimum(cursor + block, n)
    active, starts = np.arange(blocks), []
    while active.size:  # all blocks take a step at once
        at = cursor[active]
        starts.append(at)
        cursor[active] = at + COUNTS[chosen[at]]
        active = active[cursor[active] < end[active]]
    start = np.sort(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
    sel = chosen[start].astype(np.int64)
    escaped = sel == ESCAPE
    place = np.arange(len(start)) + np.concatenate([[0], np.cumsum(escaped)])[: len(start)]
    words = np.zeros(len(start) + int(escaped.sum()), np.uint64)
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        if s == ESCAPE:
            words[place[rows] + 1] = ids[start[rows]]
            continue
        word = np.full(len(rows), np.uint64(int(s) << 60))
        for j in range(int(COUNTS[s]) if BITS[s] else 0):
            word |= ids[start[rows] + j] << np.uint64(j * int(BITS[s]))
        words[place[rows]] = word
    first = place[np.searchsorted(start, np.arange(blocks, dtype=np.int64) * block)].astype("<u4") if blocks else np.zeros(0, "<u4")
    return struct.pack(HEAD, MAGIC, block, n, len(words), int(escaped.sum())) + first.tobytes() + words.astype("<u8").tobytes()


def _heads(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that hold a selector, where escapes occur: those after an escape don't."""
    heads = np.zeros(len(words), bool)
    at = first.copy()
    while at.size:
        heads[at] = True
        at = at + 1 + (words[at] >> np.uint64(60) == ESCAPE)
        keep = at < end
        at, end = at[keep], end[keep]
    return np.flatnonzero(heads)


def decode(segment: bytes) -> np.ndarray:
    """The numbers of a segment, as uint64. ValueError if it is cut short or no segment."""
    if len(segment) < HEAD_BYTES:
        raise ValueError("segment is cut short")
    magic, block, n, n_words, escapes = struct.unpack_from(HEAD, segment)
    blocks = -(-n // block) if block else 0
    if magic != MAGIC or len(segment) != HEAD_BYTES + 4 * blocks + 8 * n_words:
        raise ValueError("not a segment, or its length is wrong")
    first = np.frombuffer(segment, "<u4", blocks, HEAD_BYTES).astype(np.int64)
    words = np.frombuffer(segment, "<u8", n_words, HEAD_BYTES + 4 * blocks)
    heads = _heads(words, first, np.append(first[1:], n_words)) if escapes else np.arange(n_words)
    sel = (words[heads] >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[sel]
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        if s == ESCAPE:
            out[at[rows]] = words[heads[rows] + 1]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(int(COUNTS[s]) if BITS[s] else 0):
            out[at[rows] + j] = words[heads[rows]] >> np.uint64(j * int(BITS[s])) & mask
    if len(out) != n:
        raise ValueError("segment holds another count of numbers than it says")
    return out
