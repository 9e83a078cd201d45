"""Vectorised words and word shingles of Arrow string columns.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r, so offsets count bytes here.
Texts are taken in slices of whole texts of about SLICE bytes: temporary arrays stay small whatever the batch
size is, and a text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, byte offsets from 0, bytes) of runs of whole texts; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        yield row, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text number of each word, in order."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] |= inside[inner]
    last[inner - 1] |= inside[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word: differences of one running polynomial, brought to a common power."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        end = max(at + 1, int(np.searchsorted(ends, base + 2 * SLICE, "right")))
        span = data[base : ends[end - 1]]
        if len(_powers[0]) <= len(span):
            size = max(len(span) + 1, SLICE + 4096)
            for i, b in enumerate((_BASE, _INVERSE)):
                _powers[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))])
        term = (_LOWER[span] if lower else span).astype(np.uint64)
        term += np.uint64(1)
        term *= _powers[0][: len(span)]
        total = np.zeros(len(span) + 1, np.uint64)
        np.cumsum(term, out=total[1:])
        s, e = starts[at:end] - base, ends[at:end] - base
        out[at:end] = mix((total[e] - total[s]) * _powers[1][s] + (e - s).astype(np.uint64) * _STEP)
        at = end
    return out


def shingles(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and text numbers of all k-word shingles, in order; a text of fewer words has its whole sequence as one."""
    if not len(h):
        return h, doc
    n = len(h) - k + 1
    if n > 0:
        acc = h[:n].copy()
        for j in range(1, k):
            acc *= _STEP
            acc += h[j : n + j]
        whole = doc[:n] == doc[k - 1 :]
        hashes, owner, first = mix(acc[whole]), doc[:n][whole], np.flatnonzero(whole)
    else:
        hashes, owner, first = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    length = np.diff(np.r_[begin, len(doc)])
    short = []
    for c in range(1, k):
        at = begin[length == c]
        if len(at):
            acc = h[at].copy()
            for j in range(1, c):
                acc = acc * _STEP + h[at + j]
            short.append((mix(acc + np.uint64(c)), doc[at], at))
    if short:
        hashes = np.concatenate([hashes, *(x[0] for x in short)])
        owner = np.concatenate([owner, *(x[1] for x in short)])
        order = np.argsort(np.concatenate([first, *(x[2] for x in short)]), kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner
