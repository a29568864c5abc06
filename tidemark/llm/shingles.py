"""Word shingles of whole texts as 64-bit hashes, for whole slices of a batch at once."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240501)
_OF_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACES = _rng.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
_SHORT = np.uint64(0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on all."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row begins (nulls are empty)."""
    column = pc.fill_null(column.cast(pa.string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


#: Words of up to this many bytes are hashed together, 8 bytes at a time; longer ones each by a cryptographic hash.
_LONG = 64
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def word_hashes(raw: np.ndarray, at: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, with A-Z lowered, and the row that it is in.

    Every 8 bytes of a word go through mix64 before the next ones are added, so no
    two words of one length and at most 8 bytes share a hash, and longer ones do by
    chance only.  Another seed gives another, independent hash.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.concatenate([[True], space[:-1]]) | edge[:-1]
    after = np.concatenate([space[1:], [True]]) | edge[1:]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    lower = np.concatenate([_LOWER[raw], np.zeros(8, np.uint8)])
    eight = np.ndarray((n,), "<u8", lower, strides=(1,))
    size = ends - starts
    salt = np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1B873593) % (1 << 64))
    hashes = mix64(size.astype(np.uint64) + salt)
    live = np.flatnonzero(size <= _LONG)
    for step in range(0, _LONG, 8):
        live = live[size[live] > step]
        if not len(live):
            break
        piece = eight[starts[live] + step] & _KEEP[np.minimum(size[live] - step, 8)]
        hashes[live] = mix64(hashes[live] ^ piece)
    for i in np.flatnonzero(size > _LONG).tolist():
        digest = hashlib.blake2b(lower[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest()
        hashes[i] = int.from_bytes(digest, "little")
    return hashes, np.searchsorted(at, starts, "right") - 1


def shingles(column: pa.Array, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of `width` words of each row, sorted in each row, end to end; and each row's count.

    A row of fewer words has its whole sequence as one shingle, a row without
    words none.
    """
    raw, at = text_bytes(column)
    words, row = word_hashes(raw, at, seed)
    rows = len(at) - 1
    count = np.bincount(row, minlength=rows)
    n = len(words)
    made = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        made += words[j : j + len(made)] * _PLACES[j]
    whole = row[: len(made)] == row[width - 1 :] if len(made) else np.zeros(0, bool)
    long_rows, long_hashes = row[: len(made)][whole], mix64(made[whole])
    short = np.flatnonzero((count > 0) & (count < width))
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    less = np.zeros(len(short), np.uint64)
    for j in range(width - 1):
        has = count[short] > j
        less[has] += words[first[short[has]] + j] * _PLACES[j]
    short_hashes = mix64(less + _SHORT * count[short].astype(np.uint64))
    of = np.concatenate([long_rows, short])
    hashes = np.concatenate([long_hashes, short_hashes])
    if len(short):
        order = np.argsort(of, kind="stable")
        of, hashes = of[order], hashes[order]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))]).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a > 1:
            hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], np.bincount(of[new], minlength=rows)
