"""BPE encoding and decoding with a pair occurrence index (operator 8).

Every task splits its texts into pre-tokens and gives each distinct pre-token
one entry.  The entries that are new in a batch are laid end to end; an index
maps the rank of each adjacent pair to all positions where that pair stands.
The active ranks are applied in ascending order, each at all of its positions
at once, and the lists of the pairs that this makes are updated.  A merge only
makes pairs of higher ranks (checked on load), so one ascending sweep gives what
merging word by word gives.

Nulls encode as the empty list; a text of any length is encoded whole.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, sha256_text, table

#: Distinct pre-tokens that a task remembers; beyond, it forgets all and begins anew.
REMEMBERED = 1_000_000
#: The same for the characters in them.
REMEMBERED_CHARS = 16 << 20
#: Bytes of text that are encoded and ids that are decoded at once; a batch of new pre-tokens takes some forty times its bytes.
TEXT_BYTES, IDS = 1 << 20, 250_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(spare)) for b in range(256)}


@dataclass
class Vocabulary:
    """What a byte-level BPE file says, as arrays."""

    size: int
    of_byte: np.ndarray  # id of each byte
    keys: np.ndarray  # sorted left * size + right of each merge
    rank_of_key: np.ndarray
    left: np.ndarray
    right: np.ndarray
    made: np.ndarray  # id that each rank makes
    flat: np.ndarray  # bytes of all tokens and of an empty one, end to end
    starts: np.ndarray
    special: dict[str, int]


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizer file of the byte-level kind."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    if told["pre_tokenizer"]["type"] != "ByteLevel" or told["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("only byte-level files without a prefix space are supported")
    vocab = told["model"]["vocab"]
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    size = max([*vocab.values(), *special.values()]) + 1
    alphabet = byte_alphabet()
    byte_of = {c: b for b, c in alphabet.items()}
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in told["model"]["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], np.int64)
    right = np.array([vocab[b] for _, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int64)
    rank_made = np.full(size, -1, np.int64)
    rank_made[made] = np.arange(len(made))
    if len(pairs) and (np.maximum(rank_made[left], rank_made[right]) >= np.arange(len(pairs))).any():
        raise ValueError("a merge uses a token of a later merge")
    keys = left * size + right
    order = np.argsort(keys)
    tokens = [b""] * size
    for t, i in vocab.items():
        tokens[i] = bytes(byte_of[c] for c in t)
    for t, i in special.items():
        tokens[i] = t.encode()
    tokens.append(b"")  # what an id outside the vocabulary decodes to
    lens = np.array([len(t) for t in tokens], np.int64)
    of_byte = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
    return Vocabulary(size, of_byte, keys[order], order, left, right, made, np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum(lens)]), special)


def _gather(flat: np.ndarray, starts: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces flat[starts[p]:starts[p + 1]] of picks end to end, and their lengths."""
    lens = starts[picks + 1] - starts[picks]
    total = int(lens.sum())
    ends = np.cumsum(lens)
    at = np.arange(total) + np.repeat(starts[picks] - (ends - lens), lens)
    return flat[at], lens


class PairIndex:
    """Occurrences of adjacent pairs in many words at once."""

    def __init__(self, v: Vocabulary, words: list[bytes]):
        self.v = v
        raw = np.frombuffer(b"".join(words), np.uint8)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        self.begin = np.concatenate([[0], np.cumsum(lens + 1)])
        n = int(self.begin[-1]) + 1
        self.sym = np.full(n, -1, np.int64)  # -1: no symbol; a gap follows every word
        gap = np.zeros(n, bool)
        gap[self.begin[1:] - 1] = True
        gap[-1] = True
        self.sym[~gap] = v.of_byte[raw]
        self.next = np.arange(1, n + 1)
        self.next[-1] = n - 1
        self.prev = np.arange(-1, n - 1)
        self.where: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []
        self._note(np.arange(n - 1))

    def _note(self, at: np.ndarray) -> None:
        """Add the pairs that begin at these positions to the index."""
        a, b = self.sym[at], self.sym[self.next[at]]
        ok = (a >= 0) & (b >= 0)
        at, key = at[ok], a[ok] * self.v.size + b[ok]
        i = np.minimum(np.searchsorted(self.v.keys, key), len(self.v.keys) - 1)
        ok = self.v.keys[i] == key if len(key) else np.zeros(0, bool)
        at, rank = at[ok], self.v.rank_of_key[i[ok]]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = np.flatnonzero(np.diff(rank)) + 1
        for r, where in zip(rank[np.concatenate([[0], cut])].tolist(), np.split(at, cut), strict=True):
            if r in self.where:
                self.where[r].append(where)
            else:
                self.where[r] = [where]
                heapq.heappush(self.heap, r)

    def apply(self) -> tuple[np.ndarray, np.ndarray]:
        """Apply all active ranks in ascending order; ids of all words end to end, and each word's start."""
        v, sym, nxt, prv = self.v, self.sym, self.next, self.prev
        while self.heap:
            r = heapq.heappop(self.heap)
            lists = self.where.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            a, b = v.left[r], v.right[r]
            at = at[(sym[at] == a) & (sym[nxt[at]] == b)]
            if a == b and len(at) > 1:  # in a run of equal symbols every other pair merges, from the left
                first = np.concatenate([[True], nxt[at[:-1]] != at[1:]])
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            sym[at] = v.made[r]
            sym[gone] = -2
            after = nxt[gone]
            nxt[at] = after
            prv[after] = at
            before = prv[at]
            self._note(np.unique(np.concatenate([before[before >= 0], at])))
        live = sym >= 0
        count = np.concatenate([[0], np.cumsum(live)])
        return sym[live].astype(np.int32), count[self.begin]


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(r""" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


class Encoder:
    """Encodes lists of texts; remembers the ids of the pre-tokens that it has seen."""

    def __init__(self, v: Vocabulary):
        self.v, self.find = v, _splitter().findall
        self._forget()

    def _forget(self) -> None:
        self.entry: dict[str, int] = {}
        self.held = 0
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)
        for token, i in self.v.special.items():
            self.entry[token] = len(self.entry)
            self.flat = np.append(self.flat, np.int32(i))
            self.starts = np.append(self.starts, len(self.flat))

    def _pieces(self, text: str) -> list[str]:
        parts = [text]
        for token in self.v.special:
            if token in text:
                parts = [y for x in parts for y in ([x] if x in self.v.special else self._between(x, token))]
        if len(parts) == 1 and parts[0] == text and text not in self.v.special:
            return self.find(text)
        return [p for x in parts for p in ([x] if x in self.v.special else self.find(x))]

    @staticmethod
    def _between(text: str, token: str) -> list[str]:
        out = []
        for i, x in enumerate(text.split(token)):
            out += ([token] if i else []) + ([x] if x else [])
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts end to end, and how many each has."""
        if len(self.entry) > REMEMBERED or self.held > REMEMBERED_CHARS:
            self._forget()
        entry, fresh, picks = self.entry, [], []
        for t in texts:
            found = self._pieces(t) if t else []
            try:
                got = [entry[p] for p in found]
            except KeyError:
                for p in found:
                    if p not in entry:
                        entry[p] = len(entry)
                        fresh.append(p.encode())
                got = [entry[p] for p in found]
            picks.append(np.array(got, np.int64))
        if fresh:
            flat, starts = PairIndex(self.v, fresh).apply()
            self.held += sum(map(len, fresh))
            self.starts = np.concatenate([self.starts, starts[1:] + len(self.flat)])
            self.flat = np.concatenate([self.flat, flat])
        joined = np.concatenate(picks) if picks else np.zeros(0, np.int64)
        ids, lens = _gather(self.flat, self.starts, joined)
        ends = np.concatenate([[0], np.cumsum(lens)])[np.cumsum([len(p) for p in picks])]
        return ids, np.diff(np.concatenate([[0], ends]))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the column ids: array<int>, the token ids of each whole text (null: none).

    A special token's own string in a text is that token, as the tokenizers
    library reads it by default.  Columns of docs are kept; one named like ids
    is replaced.
    """

    def make():
        encoder = Encoder(load_vocabulary(path))

        def work(batch: pa.RecordBatch) -> list:
            flat, counts = encoder.encode(batch.column(text).to_pylist())
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))]

        return work

    return append_columns(docs, text, [T.StructField(ids, T.ArrayType(T.IntegerType()))], make, most=TEXT_BYTES)


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the column out: the text of the ids, special tokens included (null: empty).

    Bytes that are no UTF-8 become U+FFFD; ids outside the vocabulary add nothing.
    """
    kept = [c for c in rows.columns if c != out]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(out, T.StringType())])

    def run(batches):
        v = load_vocabulary(path)
        for whole in batches:
            begin = 0
            sizes = pc.fill_null(pc.list_value_length(whole.column(ids)), 0).to_numpy(zero_copy_only=False).tolist()
            while begin < len(sizes):
                end, held = begin, 0
                while end < len(sizes) and (end == begin or held + sizes[end] <= IDS):
                    held += sizes[end]
                    end += 1
                part = whole.slice(begin, end - begin)
                flat = part.column(ids).flatten().to_numpy(zero_copy_only=False)
                flat = np.where((flat >= 0) & (flat < v.size), flat, v.size).astype(np.int64)
                raw, lens = _gather(v.flat, v.starts, flat)
                ends = np.concatenate([[0], np.cumsum(lens)])
                cuts = ends[np.concatenate([[0], np.cumsum(sizes[begin:end])]).astype(np.int64)].tolist()
                view = raw.tobytes()
                texts = [view[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(texts, pa.string())], names=[*kept, out])
                begin = end

    return rows.mapInArrow(run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    path = path or default_path()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256_text(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        "ids",
    )
    return decode(coded, path).select("doc_id", "n_tokens", "ids_sha256", sha256_text(F.col("decoded")).alias("decoded_sha256"))
