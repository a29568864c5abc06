"""Second-order degrees: what edges add to a person's degree, and when, in arrays of a stretch of time.

A task holds some neighbours (or some people) and a stretch of a few windows; what lies up to a window before it is there too.
Between tasks rows go packed: compressed columns, sorted by whom they are of.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import ROWS_A_TASK

#: Windows of a stretch; a row is needed again in the next one if it is of the last of them.
WINDOWS = 4
#: Rows that are packed at a time, pairs of edges and cells that are handled at a time.
PACKED, PAIRS, CELLS = 1_000_000, 1_000_000, 4_000_000

Arrays = dict[str, np.ndarray]


def _block(of: np.ndarray, blocks: int) -> np.ndarray:
    """A number under `blocks` for each key."""
    return (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks


def _pack(columns: Arrays, bins: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """(bin, kind, data): the rows of each bin as one compressed batch."""
    order = np.argsort(bins, kind="stable")
    cuts = np.flatnonzero(np.diff(bins[order], prepend=bins[order][:1] - 1))
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        own = order[a:b]
        batch = pa.RecordBatch.from_arrays([pa.array(c[own]) for c in columns.values()], names=list(columns))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([bins[own[0]]], pa.int64()), pa.array([kind], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["bin", "kind", "data"])


def _unpack(table: pa.Table, kind: int) -> Arrays:
    parts = [pa.ipc.open_stream(d).read_all() for k, d in zip(table["kind"].to_pylist(), table["data"].to_pylist(), strict=True) if k == kind]
    if not parts:
        return {}
    whole = pa.concat_tables(parts)
    return {c: whole[c].to_numpy() for c in whole.column_names}


def _packed(rows: DataFrame, kind: int, bins: Callable[[Arrays], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Rows without nulls, packed; bins() tells the places of the rows that go on, some perhaps twice, and their bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            columns = {c: whole[c].to_numpy() for c in whole.column_names}
            held.clear()
            at, of = bins(columns)
            yield from _pack({c: v[at] for c, v in columns.items()}, of, kind)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PACKED:
                yield from flushed()
        if held:
            yield from flushed()

    return rows.mapInArrow(run, "bin long, kind int, data binary")


def _spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place): all places from first up to last of each of the spans."""
    n = last - first
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]


def _pieces(n: np.ndarray, most: int) -> Iterator[slice]:
    """Slices whose n add up to `most` or to a little more than that."""
    ends = np.cumsum(n)
    cuts = np.unique(np.searchsorted(ends, np.arange(most, int(ends[-1]) + most, most), side="left") + 1) if len(n) else []
    begin = 0
    for cut in cuts:
        if begin < (cut := min(int(cut), len(n))):
            yield slice(begin, cut)
            begin = cut


class _Times:
    """Counts by key, time and label, as sums up to each time of a key."""

    def __init__(self, key: np.ndarray, ts: np.ndarray, label: np.ndarray, n: np.ndarray, labels: int, span: int):
        self.at, run = np.unique(key * span + ts, return_inverse=True)
        self.n = np.bincount(run * labels + label, n, len(self.at) * labels).reshape(-1, labels)
        self.ts, self.sums, self.span = self.at % span, np.vstack([np.zeros(labels), self.n.cumsum(0)]), span

    def place(self, key: np.ndarray, ts: np.ndarray, side: str) -> np.ndarray:
        return np.searchsorted(self.at, key * self.span + ts, side=side)


def _added(key: np.ndarray, w: np.ndarray, tables: list[tuple[_Times, np.ndarray, np.ndarray, int]], times: np.ndarray, labels: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, time, sums by label): w times the counts of the places of each pair, added up by key and time. Pairs come in order of key."""
    spread = sum(b - a for _, a, b, _ in tables)
    for some in _pieces(spread, CELLS):
        own, mine = np.unique(key[some], return_inverse=True)
        cells, weights = [], [[] for _ in range(labels)]
        for table, a, b, sign in tables:
            which, place = _spans(a[some], b[some])
            cells.append(mine[which] * len(times) + np.searchsorted(times, table.ts)[place])
            for e in range(labels):
                weights[e].append(sign * w[some][which] * table.n[place, e] if table.n[:, e].any() else None)
        size, places = len(own) * len(times), None
        if size > 4 * CELLS:  # times are many, so cells are few of all
            places, flat = np.unique(np.concatenate(cells), return_inverse=True)
            cells, size = np.split(flat, np.cumsum([len(c) for c in cells])[:-1]), len(places)
        total = np.zeros((size, labels))
        for e in range(labels):
            for cell, weight in zip(cells, weights[e], strict=True):
                if weight is not None:
                    total[:, e] += np.bincount(cell, weight, size)
        there = np.flatnonzero(total.any(1))
        cell = there if places is None else places[there]
        yield own[cell // len(times)], times[cell % len(times)], total[there].astype(np.int64)


#: Kinds of events: of the newer edge's project; of the older one's, if that is another; the same two left over from the stretch before.
_MAIN, _OTHER, _LEFT = 0, 1, 2


def _events(x: Arrays, begin: int, length: int, window: int, intra: bool, labels: int) -> Iterator[Arrays]:
    """(u, p, label, kind, ts, seq, ends, v0, v1, ...): what edges n -> u add to the degree of u, from when on, and what ends when."""
    base = int(x["ts"].min()) - window - 1
    ts = x["ts"] - base
    span = int(ts.max()) + window + 2
    _, n = np.unique(x["n"], return_inverse=True)
    people, u = np.unique(x["u"], return_inverse=True)
    projects, p = np.unique(x["p"], return_inverse=True)
    label, into, own, every = (x[c].astype(np.int64) for c in ("label", "into", "own", "every"))
    _, pair = np.unique(n * len(people) + u, return_inverse=True)
    pick = lambda some, key, of: _Times(key[some], ts[some], label[some], of[some], labels, span)
    anyone, with_u = pick(every > 0, n, every), pick(own > 0, pair, own)
    group = (pair * labels + label) * (len(projects) if intra else 1) + (p if intra else 0)
    order = np.flatnonzero(into > 0)
    order = order[np.lexsort((p[order], x["seq"][order], ts[order], group[order]))]
    n, u, p, pair, label, ts, seq, m = n[order], u[order], p[order], pair[order], label[order], ts[order], x["seq"][order], into[order]
    _, group = np.unique(group[order], return_inverse=True)
    first = np.searchsorted(group * span + ts, group * span + ts - window, side="right")
    since = [(t, t.place(k, ts - window, "right"), t.place(k, ts, "left"), sign) for t, k, sign in ((anyone, n, 1), (with_u, pair, -1))]
    times = np.union1d(anyone.ts, with_u.ts)
    newer = np.flatnonzero(ts + base >= begin)
    key = (u * labels + label) * len(projects)
    for some in _pieces(newer - first[newer] + 1, PAIRS):
        which, j = _spans(first[newer[some]], newer[some] + 1)
        i = newer[some][which]
        w = np.where(i == j, m[i] * (m[i] + 1) // 2, m[i] * m[j])
        counts = sum(sign * (t.sums[np.maximum(b[j], a[i])] - t.sums[a[i]]) for t, a, b, sign in since)
        counts = np.rint(counts).astype(np.int64)
        some_left = counts.any(1)
        i, j, w, counts = i[some_left], j[some_left], w[some_left], counts[some_left] * w[some_left, None]
        if not len(i):
            continue
        cuts = np.flatnonzero(np.diff(i, prepend=-1))
        kinds = [(_MAIN, i[cuts], p[i[cuts]], np.add.reduceat(counts, cuts), np.arange(len(i)), p[i])]
        if not intra:
            far = np.flatnonzero(p[i] != p[j])
            kinds.append((_OTHER, i[far], p[j[far]], counts[far], far, p[j[far]]))
        for kind, at, where, values, pairs, pair_p in kinds:
            told = lambda u, p, label, ts, seq, ends, values, kind=kind: {"u": people[u], "p": projects[p], "label": label.astype(np.int8), "kind": np.full(len(u), kind, np.int8) if np.isscalar(kind) else kind, "ts": ts, "seq": seq, "ends": np.full(len(u), ends), **{f"v{e}": values[:, e] for e in range(labels)}}
            if len(at):
                yield told(u[at], where, label[at], ts[at] + base, seq[at], False, values)
            of = key[i[pairs]] + pair_p
            pairs = pairs[np.argsort(of, kind="stable")]
            of, a_i, b_j = np.sort(of), i[pairs], j[pairs]
            tables = [(t, a[a_i], np.maximum(b[b_j], a[a_i]), sign) for t, a, b, sign in since]
            for own_key, x_ts, values in _added(of, w[pairs], tables, times, labels):
                ends = x_ts + base + window
                late = np.where(ends >= begin + length, _LEFT, 0) + kind
                yield told(own_key // len(projects) // labels, own_key % len(projects), own_key // len(projects) % labels, ends, np.zeros(len(ends), np.int64), True, -values, late.astype(np.int8))


def _found(known: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in known, whether it is there)."""
    at = np.minimum(np.searchsorted(known, of), len(known) - 1)
    return at, known[at] == of


def _earlier(q: Arrays, x: Arrays, by_project: bool, labels: int) -> np.ndarray:
    """Per query, label and label the sums of the events before it of its person, and of its project if so."""
    times, seqs, people, projects = (np.unique(q[c]) for c in ("ts", "seq", "u", "p"))
    a_time, a_group = len(seqs) + 1, len(times) * (len(seqs) + 1)
    who, project = np.searchsorted(people, q["u"]), np.searchsorted(projects, q["p"])
    group = who * len(projects) + project if by_project else who
    asked = group * a_group + np.searchsorted(times, q["ts"]) * a_time + np.searchsorted(seqs, q["seq"])
    order = np.argsort(asked, kind="stable")
    asked, out = asked[order], np.zeros((len(asked), labels, labels), np.int64)
    starts = np.searchsorted(asked, group[order] * a_group)
    if not x:
        return out
    who, there = _found(people, x["u"])
    own = who
    if by_project:
        project, near = _found(projects, x["p"])
        own, there = who * len(projects) + project, there & near
    at = np.searchsorted(times, x["ts"])
    same = (at < len(times)) & (times[np.minimum(at, len(times) - 1)] == x["ts"]) & ~x["ends"]
    since = own * a_group + at * a_time + np.where(same, np.searchsorted(seqs, x["seq"], side="right"), 0)
    since = np.where(at < len(times), since, (own + 1) * a_group)
    begin, end = np.searchsorted(asked, own * a_group), np.searchsorted(asked, (own + 1) * a_group)
    place = np.searchsorted(asked, since)
    there &= begin < end
    in_time, left = there & (place < end), there & (x["kind"] >= _LEFT)
    for c in range(labels):
        mine = x["label"] == c
        for e in range(labels):
            v = x[f"v{e}"]
            if not v.any():
                continue
            now, before = mine & in_time, mine & left
            change = np.bincount(place[now], v[now], len(asked)) - np.bincount(begin[before], v[before], len(asked))
            sums = np.concatenate([[0.0], change.cumsum()])
            out[order, c, e] = np.rint(sums[1:] - sums[starts]).astype(np.int64)
    return out


def degrees(queries: DataFrame, facts: DataFrame, window: int, scope: str, labels: tuple[str, ...], rows: int) -> DataFrame:
    """(id, c, e, degree) of second_order_degree(), from (n, u, p, ts, seq, label, into, own, every).

    into: edges n -> u of a label (its place in `labels`) that count; every: edges of n, entering or leaving, with anyone, and own:
    those among them with u; all others of n are with nobody who is asked about.  `rows`: about how many facts there are.
    """
    intra, k, length = scope == "intra", len(labels), WINDOWS * window
    asked = queries.where("u is not null and project is not null and ts is not null and seq is not null")
    asked = asked.select("id", F.col("u").cast("long").alias("u"), F.col("project").cast("long").alias("p"), F.col("ts").cast("long").alias("ts"), F.col("seq").cast("long").alias("seq"))
    least, most = asked.agg(F.min("ts"), F.max("ts")).first()
    stretches = 1 if least is None else most // length - least // length + 1
    blocks = -(-rows // (stretches * ROWS_A_TASK)) or 1
    answers = 2 * blocks
    parts = stretches * blocks

    def twice(x: Arrays) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((x["ts"], x["n"]))
        stretch, block = x["ts"][order] // length, _block(x["n"][order], blocks)
        again = np.flatnonzero(x["ts"][order] >= (stretch + 1) * length - window)
        return np.concatenate([order, order[again]]), np.concatenate([stretch * blocks + block, (stretch[again] + 1) * blocks + block[again]])

    def once(x: Arrays) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(x["u"])), x["ts"] // length * answers + _block(x["u"], answers)

    def made(table: pa.Table) -> pa.Table:
        x, stretch = _unpack(table, 0), table["bin"][0].as_py() // blocks
        out = [pa.RecordBatch.from_pydict({"bin": [], "kind": [], "data": []}, told)]
        if (x["into"] > 0).any() and (x["every"] > 0).any():
            for some in _events(x, stretch * length, length, window, intra, k):
                out += list(_pack(some, (stretch + (some["kind"] >= _LEFT)) * answers + _block(some["u"], answers), 1))
        return pa.Table.from_batches(out, told)

    def answered(table: pa.Table) -> pa.Table:
        q, x = _unpack(table, 0), _unpack(table, 1)
        if not q or not x:
            return pa.table({"id": pa.array([], kept), "degrees": pa.array([], pa.list_(pa.int64()))})
        main = {c: v[x["kind"] % 2 == _MAIN] for c, v in x.items()}
        got = _earlier(q, x, True, k) if intra else _earlier(q, main, False, k) - _earlier(q, x, True, k)
        some = np.flatnonzero(got.any((1, 2)))
        flat = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * k * k, pa.array(got[some].ravel()))
        return pa.table({"id": pa.array(q["id"][some], kept), "degrees": flat})

    told = pa.schema([("bin", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
    of_id = queries.schema["id"].dataType
    kept = to_arrow_type(of_id)
    pack = "bin long, kind int, data binary"
    numbers = facts.where("ts is not null and seq is not null").select(*[F.col(c).cast("long").alias(c) for c in ("n", "u", "p", "ts", "seq")], F.col("label").cast("byte").alias("label"), *[F.col(c).cast("long").alias(c) for c in ("into", "own", "every")])
    events = _packed(numbers, 0, twice).repartition(4 * parts, "bin").groupBy("bin").applyInArrow(made, pack)
    both = events.unionByName(_packed(asked, 0, once)).repartition(4 * parts, "bin")
    got = both.groupBy("bin").applyInArrow(answered, f"id {of_id.simpleString()}, degrees array<long>")
    name = lambda i: F.get(F.array(*[F.lit(x) for x in labels]), i.cast("int"))
    each = got.select("id", F.posexplode("degrees").alias("_at", "degree")).where("degree > 0")
    return each.select("id", name(F.col("_at") / k).alias("c"), name(F.col("_at") % k).alias("e"), "degree")
