"""A run-length index of repetitive texts, and the matching statistics that it streams (for operator 10).

The Burrows-Wheeler transform of the texts, laid end to end, is compressed to
runs.  Only the suffixes at the ends of runs are sampled: there the match with
the neighbour in suffix order is measured.  Elsewhere the neighbours' left
characters are equal, so the match is one less than that of the position before;
one pass over the text streams all statistics from the samples.
"""

from __future__ import annotations

import numpy as np

#: A byte that UTF-8 never has; it ends every text of bytes.
END = 0xFF
#: Ends every text of 64-bit symbols, which are less.
LAST = (1 << 64) - 1


def _words(text: np.ndarray) -> np.ndarray:
    """For each position its 8 bytes as one big-endian number (the text has 8 bytes to spare)."""
    n = len(text) - 8
    out = np.zeros(n, np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | text[i : i + n]
    return out


def _keys(text: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each position that orders its next symbols, and how many these are."""
    if text.dtype != np.uint8:
        return text, 1
    return _words(np.concatenate([text, np.full(16, END, np.uint8)]))[: len(text)], 8


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the next `depth` symbols or more.

    Prefix doubling; each round sorts only the suffixes that aren't told apart yet.
    Keys share an integer with the place that they are sorted from wherever both fit,
    as sorting numbers is far quicker than sorting places by them.
    """
    n = len(text)
    bits = n.bit_length()
    at = np.arange(n, dtype=np.int64)
    if text.dtype == np.uint8:
        known = min(8, (64 - bits) // 8)
        first = _keys(text)[0] >> np.uint64(64 - 8 * known)
    else:
        known, first = 1, np.unique(text, return_inverse=True)[1].astype(np.uint64)
    order, first = _sorted(first, max(1, 8 * known if text.dtype == np.uint8 else bits))
    fresh = np.ones(n, bool)
    fresh[1:] = first[1:] != first[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, at, 0))
    while known < depth:
        tied = ~fresh
        tied[:-1] |= tied[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        i = order[where]
        after = i + known
        follow = np.where(after < n, rank[np.minimum(after, n - 1)], n)  # past the end all symbols count as the last one
        group = np.cumsum(fresh[where]) - 1
        perm, key = _sorted((group << bits | follow).astype(np.uint64), bits + int(group[-1]).bit_length())
        i = i[perm]
        order[where] = i
        new = np.ones(len(where), bool)
        new[1:] = key[1:] != key[:-1]
        fresh[where] = new
        rank[i] = np.maximum.accumulate(np.where(new, where, 0))
        known *= 2
    return order


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of `key` (numbers of `bits` bits) in its order, and it in order."""
    low = len(key).bit_length()
    if bits + low > 64:
        order = np.argsort(key)
        return order, key[order]
    packed = np.sort(key << np.uint64(low) | np.arange(len(key), dtype=np.uint64))
    return (packed & np.uint64((1 << low) - 1)).astype(np.int64), packed >> np.uint64(low)


def _match(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix at a and b, at most `most`; bytes are compared 8 at a time first."""
    words, width = _keys(text)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    last = len(words) - 1
    for step in range(0, most, width):
        x, y = a[live] + step, b[live] + step
        same = (words[np.minimum(x, last)] == words[np.minimum(y, last)]) & (x <= last) & (y <= last)
        out[live[same]] = step + width
        live = live[same]
        if not len(live):
            break
    rest = np.flatnonzero(out < most)
    for _ in range(width if width > 1 else 0):
        x, y = a[rest] + out[rest], b[rest] + out[rest]
        same = (x < len(text)) & (y < len(text))
        same[same] = text[x[same]] == text[y[same]]
        rest = rest[same]
        out[rest] += 1
        if not len(rest):
            break
    return np.minimum(out, most)


class RunIndex:
    """The runs of the transform of texts that lie end to end, and matches sampled at the runs' ends.

    Texts are bytes, or with wide=True 64-bit symbols of 8 bytes each.
    """

    def __init__(self, texts: list[bytes], length: int, wide: bool = False):
        self.length = length
        lens = np.fromiter(map(len, texts), np.int64, len(texts)) // (8 if wide else 1)
        self.begin = np.concatenate([[0], np.cumsum(lens + 1)])
        end = LAST.to_bytes(8, "little") if wide else bytes([END])
        # matches are told apart and followed to the end of the longest text, as later positions take over what is left
        most = max(length, int(lens.max(initial=0))) + 1
        self.text = np.frombuffer(end.join(texts) + end * (most + 8), "<u8" if wide else np.uint8)
        order = suffix_order(self.text, most)
        symbols = np.unique(self.text, return_inverse=True)[1] if wide else self.text.astype(np.int32)
        before = symbols[np.arange(len(self.text)) - 1]
        before[self.begin[:-1]] = -1 - np.arange(len(texts))  # a text's first suffix is sampled, as matches aren't followed across texts
        left = before[order]
        change = left[1:] != left[:-1]
        self.runs = int(change.sum()) + 1
        head = np.flatnonzero(change) + 1  # rank that begins a run; the one before ends one
        got = _match(self.text, order[head], order[head - 1], most)
        self.sample = np.full(len(self.text), -1, np.int64)
        np.maximum.at(self.sample, order[head], got)
        np.maximum.at(self.sample, order[head - 1], got)

    def statistics(self) -> np.ndarray:
        """For each position the longest match that begins elsewhere too; exact where it matters, that is, whether `length` is reached."""
        at = np.arange(len(self.text))
        reach = np.maximum.accumulate(np.where(self.sample >= 0, self.sample + at, 0))
        return reach - at

    def repeated(self) -> list[np.ndarray]:
        """For each text the positions whose next `length` symbols stand elsewhere too."""
        hit = self.statistics() >= self.length
        return [np.flatnonzero(hit[a : max(a, b - self.length)]) for a, b in zip(self.begin, self.begin[1:], strict=False)]
