"""Copies among images by local descriptors (operator 4).

An image is looked at in sizes that shrink by STEP.  In each, the strongest corner (Harris response, local maximum)
of every cell of GRID pixels is kept, so corners grow with the area.  The patch about a corner is turned by the direction
of its centre of brightness, to 5 degrees, and described by 120 comparisons of pixels, so brightness, contrast and turning
matter little.  Three tables hold 40 bits of each descriptor; corners that agree in a table and differ in
MOST_APART of all bits at most are matched.  A match gives a shift, turn and scale, and votes for the cells of
these about it, neighbours included; the matches of a cell with enough votes are fitted by one similarity, and fitted
again without those that lie off it.  A similarity of VOTES places is then held against all corners: images are
linked if SHARE of the corners that it carries into the other image find a like corner there, and linked images form groups.

Images of equal pixels are one class from the start, and so are images of equal
corners.  All other pairs of a bucket are matched: images are dealt into blocks, an
image goes to each pair of blocks that share one of its buckets, and the votes of
such a pair are counted in one task.  A task's images are bounded by the block;
a bucket with a third of all images is spread over all pairs of blocks.
Nulls and images that can't be decoded have no corners and stay alone; rows of one
key and one image count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, stored, table
from .components import components

#: The factor between one size of an image and the next, and how many sizes are looked at.
STEP, LEVELS = 2**0.25, 8
#: Side of the cells that keep one corner each.
GRID = 10
RADIUS = 8
TESTS, TABLES = 120, 3
TURNS = 72
VOTES = 5
#: Bits of the 120 in which matched corners differ at most.
MOST_APART = 28
#: Cells of turn (in turns) and of shift (pixels at least, and as a part of an image's longer side).
TURN_CELL, CELL, PART = 3, 8, 6
#: Pixels that a fitted place may lie off, and in which places count as one.
OFF, SAME = 3.0, 4
#: Of the corners that a similarity carries into the other image, how many must find a like one there.
SHARE = 0.25
#: Images of a block, and matches that a task holds at once (one image may exceed them).
BLOCK = 16384
MATCHES = 1 << 18


@lru_cache(maxsize=1)
def _tests() -> np.ndarray:
    """For each turn the offsets [tests, 4] (y, x, y, x) of the compared pixels.

    Pixels are compared across the direction that a patch is turned by: along it, one side is brighter by definition.
    """
    rng = np.random.default_rng(7)
    along, across = rng.uniform(1 - RADIUS, RADIUS - 1, TESTS), rng.normal(0, RADIUS / 2, (2, TESTS))
    base = np.clip(np.stack([across[0], along, across[1], along + rng.normal(0, 1, TESTS)], 1), 1 - RADIUS, RADIUS - 1)
    out = np.empty((TURNS, TESTS, 4), np.int64)
    for k in range(TURNS):
        c, s = np.cos(2 * np.pi * k / TURNS), np.sin(2 * np.pi * k / TURNS)
        for j in (0, 2):
            y, x = base[:, j], base[:, j + 1]
            out[k, :, j], out[k, :, j + 1] = np.rint(s * x + c * y), np.rint(c * x - s * y)
    return np.clip(out, -RADIUS, RADIUS)


def decode_pgm(data: bytes | None) -> np.ndarray | None:
    """Pixels of a binary PGM image of 8 bits; None if it isn't one."""
    if not data or data[:2] != b"P5":
        return None
    parts, at = [], 2
    try:
        while len(parts) < 3:
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at)
                continue
            end = at
            while data[end : end + 1].isdigit():
                end += 1
            parts.append(int(data[at:end]))
            at = end
        width, height, top = parts
        pixels = np.frombuffer(data, np.uint8, width * height, at + 1)
    except (ValueError, IndexError):
        return None
    return pixels.reshape(height, width) if 0 < top < 256 else None


def encode_pgm(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2r + 1, edges repeated; a is [images, height, width]."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        s = np.cumsum(np.pad(a, pad, mode="edge"), axis=axis)
        n = a.shape[axis]
        s = np.moveaxis(s, axis, 0)
        a = np.moveaxis(s[2 * r + 1 : 2 * r + 1 + n] - s[:n], 0, axis)
    return a


def _corners(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, y, x) of the strongest corner in each cell of images of one size [n, h, w]."""
    n, h, w = images.shape
    if min(h, w) < 2 * RADIUS + 3:
        return tuple(np.zeros((3, 0), np.int64))
    f = images.astype(np.float32)
    dy, dx = np.gradient(f, axis=1), np.gradient(f, axis=2)
    xx, yy, xy = _box(dx * dx, 1), _box(dy * dy, 1), _box(dx * dy, 1)
    r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    inner = r[:, RADIUS : h - RADIUS, RADIUS : w - RADIUS]
    peak = inner > 1.0
    for sy in (-1, 0, 1):
        for sx in (-1, 0, 1):
            if sy or sx:
                other = r[:, RADIUS + sy : h - RADIUS + sy, RADIUS + sx : w - RADIUS + sx]
                peak &= (inner > other) if (sy, sx) > (0, 0) else (inner >= other)
    image, y, x = np.nonzero(peak)
    cells = -(-inner.shape[2] // GRID)
    cell = (image * (-(-inner.shape[1] // GRID)) + y // GRID) * cells + x // GRID
    order = np.lexsort((x, y, -inner[image, y, x], cell))
    best = order[np.r_[True, cell[order][1:] != cell[order][:-1]]] if len(order) else order
    return image[best], y[best] + RADIUS, x[best] + RADIUS


def _shrunk(images: np.ndarray) -> np.ndarray:
    """Images [n, h, w] in the next smaller size, between neighbouring pixels."""
    out = images
    for axis in (1, 2):
        n = images.shape[axis]
        at = np.clip((np.arange(int(n / STEP)) + 0.5) * STEP - 0.5, 0, n - 1)
        low = at.astype(np.int64)
        share = (at - low).reshape((-1, 1) if axis == 1 else (-1,))
        out = np.take(out, low, axis) * (1 - share) + np.take(out, np.minimum(low + 1, n - 1), axis) * share
    return out


def _describe(images: np.ndarray, image: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The turn of each corner, and its tests packed to [corners, tables] integers."""
    smooth = _box(images.astype(np.int32), 1)
    span = np.arange(-RADIUS, RADIUS + 1)
    oy, ox = (a.ravel() for a in np.meshgrid(span, span, indexing="ij"))
    disc = oy * oy + ox * ox <= RADIUS * RADIUS
    oy, ox = oy[disc], ox[disc]
    patch = images[image[:, None], y[:, None] + oy, x[:, None] + ox].astype(np.float64)
    turn = np.rint(np.arctan2((patch * oy).sum(1), (patch * ox).sum(1)) / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
    t = _tests()[turn]
    a = smooth[image[:, None], y[:, None] + t[:, :, 0], x[:, None] + t[:, :, 1]]
    b = smooth[image[:, None], y[:, None] + t[:, :, 2], x[:, None] + t[:, :, 3]]
    bits = (a < b).reshape(len(image), TABLES, TESTS // TABLES)
    return turn, (bits << np.arange(TESTS // TABLES)).sum(axis=2).astype(np.int64)


#: Beside its keys a corner has its place (twice the distance from the centre, in pixels of the whole image), size, turn and the image's sides.
PLACE = ("y", "x", "level", "turn", "height", "width")


def described(pixels: list[np.ndarray | None]) -> list[np.ndarray]:
    """The corners of each image as rows: what PLACE names, then the keys of the tables."""
    out = [np.zeros((0, len(PLACE) + TABLES), np.int64)] * len(pixels)
    by_size: dict[tuple, list[int]] = {}
    for i, p in enumerate(pixels):
        if p is not None:
            by_size.setdefault(p.shape, []).append(i)
    for (h, w), ids in by_size.items():
        step = max(1, (1 << 20) // (h * w))
        for lo in range(0, len(ids), step):
            some = ids[lo : lo + step]
            size = np.stack([pixels[i] for i in some]).astype(np.float32)
            owners, found = [], []
            for level in range(LEVELS):
                if level:
                    size = _shrunk(size)
                image, y, x = _corners(size)
                if not len(image):
                    break
                turn, keys = _describe(np.rint(size).astype(np.int32), image, y, x)
                yy, xx = (np.rint(2 * ((v + 0.5) * STEP**level) - side).astype(np.int64) for v, side in ((y, h), (x, w)))
                same = [np.full(len(image), v) for v in (level, h, w)]
                owners.append(image)
                found.append(np.column_stack([yy, xx, same[0], turn, same[1], same[2], keys]))
            if found:
                image = np.concatenate(owners)
                rows = np.concatenate(found)[np.argsort(image, kind="stable")]
                ends = np.cumsum(np.bincount(image, minlength=len(some)))
                for i, own in zip(some, np.split(rows, ends[:-1]), strict=True):
                    out[i] = own
    return out


def describe(pixels: list[np.ndarray | None]) -> list[list[dict]]:
    """The corners of each image by name: what PLACE names, and `keys`."""
    n = len(PLACE)
    return [[dict(zip(PLACE, r[:n], strict=True)) | {"keys": r[n:]} for r in rows.tolist()] for rows in described(pixels)]


def corners(images: DataFrame, image: str = "image") -> DataFrame:
    """images with the corners of a column of binary PGM data: n_corners, n_places (different ones), keys and place.

    keys has TABLES entries for each corner; place holds, as 32-bit integers, first all values of the first name of
    PLACE, then those of the next, so that the image's sides, the same for all corners, take no room once compressed.
    """
    n = len(PLACE)
    fields = [("n_corners", T.LongType()), ("n_places", T.LongType()), ("keys", T.ArrayType(T.LongType())), ("place", T.BinaryType())]

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = described([decode_pgm(b) for b in batch.column(image).to_pylist()])
        keys = np.concatenate([r[:, n:].ravel() for r in rows])
        ends = np.cumsum([0] + [TABLES * len(r) for r in rows]).astype(np.int32)
        places = [len(np.unique(r[:, :2], axis=0)) for r in rows]
        packed = [np.ascontiguousarray(r[:, :n].T, np.int32).tobytes() for r in rows]
        return [pa.array([len(r) for r in rows], pa.int64()), pa.array(places, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys)), pa.array(packed, pa.binary())]

    return append_columns(images, image, [T.StructField(*f) for f in fields], lambda: work)


def _matches(ours: np.ndarray, theirs: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows of ours, and for each match its place in ours and in theirs), some images of ours at a time.

    Rows are (image, keys of the tables); ours is in the order of images.  A match of
    two corners comes once, from the first table in which they agree.
    """
    order = [np.argsort(theirs[:, 1 + t], kind="stable") for t in range(TABLES)]
    ends = []
    for t in range(TABLES):
        ranked = theirs[order[t], 1 + t]
        ends.append((np.searchsorted(ranked, ours[:, 1 + t], "left"), np.searchsorted(ranked, ours[:, 1 + t], "right")))
    begins = np.flatnonzero(np.r_[True, ours[1:, 0] != ours[:-1, 0]])
    bounds = np.r_[begins, len(ours)]
    upto = np.r_[0, np.cumsum(sum(hi - lo for lo, hi in ends))][bounds]
    at = 0
    while at < len(begins):
        # The pairs of images counted at once are bounded as the matches are.
        to = max(at + 1, min(int(np.searchsorted(upto, upto[at] + MATCHES, "right")) - 1, at + 256))
        rows = slice(int(bounds[at]), int(bounds[to]))
        left, right = [], []
        for t, (lo, hi) in enumerate(ends):
            n = hi[rows] - lo[rows]
            i = np.repeat(np.arange(rows.start, rows.stop), n)
            j = order[t][np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[rows], n)]
            new = ours[i, 0] != theirs[j, 0]
            for earlier in range(t):
                new &= ours[i, 1 + earlier] != theirs[j, 1 + earlier]
            new[new] = sum(np.bitwise_count(ours[i[new], 1 + u] ^ theirs[j[new], 1 + u]).astype(np.int64) for u in range(TABLES)) <= MOST_APART
            left.append(i[new])
            right.append(j[new])
        yield rows, np.concatenate(left), np.concatenate(right)
        at = to


def _distinct(group: np.ndarray, place: np.ndarray, groups: int) -> np.ndarray:
    """How many different places (complex) each group has."""
    told = np.unique(np.stack([group, np.rint(place.real / SAME).astype(np.int64), np.rint(place.imag / SAME).astype(np.int64)]), axis=1)
    return np.bincount(told[0], minlength=groups)


def _votes(a: np.ndarray, b: np.ndarray, pair: np.ndarray, votes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, factor, shift): the similarities z * factor + shift that carry enough places of a pair's first image to its second; a and b are the PLACE of their matched corners."""
    here, there = ((p[:, 1] + 1j * p[:, 0]) / 2 for p in (a, b))
    turn, level = (b[:, 3] - a[:, 3]) % TURNS, b[:, 2] - a[:, 2]
    shift = there - STEP**level * np.exp(2j * np.pi * turn / TURNS) * here
    cell = np.maximum(CELL, b[:, 4:6].max(1) / PART)
    bins = TURNS // TURN_CELL
    near = [np.floor(v)[None] + np.array([[0], [1]]) for v in (turn / TURN_CELL, level / 2, shift.real / cell, shift.imag / cell)]
    near[0] %= bins
    cast = np.array([[pair, *(near[k][(i >> k) & 1] for k in range(4))] for i in range(16)]).transpose(1, 0, 2).reshape(5, -1).astype(np.int64)
    match = np.tile(np.arange(len(pair)), 16)
    order = np.lexsort(cast[::-1])
    cast, match = cast[:, order], match[order]
    group = np.cumsum(np.r_[True, (cast[:, 1:] != cast[:, :-1]).any(axis=0)]) - 1
    # the fullest cells of a pair first: a pair that is found needs no others
    kept = np.bincount(group)[group] >= votes
    group, match = np.unique(group[kept], return_inverse=True)[1], match[kept]
    if not len(match):
        return np.zeros(0, np.int64), np.zeros(0, complex), np.zeros(0, complex)
    groups = int(group.max()) + 1
    inside = np.ones(len(match), bool)
    p, q = here[match], there[match]
    total = lambda v: np.bincount(group[inside], v[inside].real, groups) + 1j * np.bincount(group[inside], v[inside].imag, groups)
    for limit in (None, 2.0, 1.0):
        n = np.maximum(np.bincount(group[inside], minlength=groups), 1)
        mp, mq = total(p) / n, total(q) / n
        dp, dq = p - mp[group], q - mq[group]
        spread = np.bincount(group[inside], (abs(dp) ** 2)[inside], groups)
        scale = total(np.conj(dp) * dq) / np.maximum(spread, 1e-9)
        off = abs(dq - scale[group] * dp)
        wide = np.maximum(OFF, OFF * abs(scale))[group]
        if limit is None:
            # half of a cell's matches at least are taken to agree: the nearer half stays
            order = np.lexsort((off, group))
            rank = np.empty(len(off), np.int64)
            rank[order] = np.arange(len(off)) - np.searchsorted(group[order], group[order])
            inside = (rank < np.maximum(votes, (np.bincount(group, minlength=groups)[group] + 1) // 2)) | (off <= wide)
        else:
            inside = off <= limit * wide
    size = abs(scale)
    good = (_distinct(group[inside], p[inside], groups) >= votes) & (_distinct(group[inside], q[inside], groups) >= votes) & (size > 0.15) & (size < 7)
    first = np.zeros(groups, np.int64)
    first[group] = pair[match]
    move = mq - scale * mp
    # neighbouring cells find the same similarity
    told = np.stack([first, np.rint(np.log(np.maximum(size, 1e-9)) * 30), np.rint(np.angle(scale) * 30), np.rint(move.real / SAME), np.rint(move.imag / SAME)])[:, good]
    one = np.flatnonzero(good)[np.unique(told, axis=1, return_index=True)[1]]
    return first[one], scale[one], move[one]


def _supported(a: np.ndarray, b: np.ndarray, factor: complex, shift: complex) -> bool:
    """Whether a similarity carries enough of the corners of a image that lie in the other to like ones there.

    Rows are (image, keys of the tables, PLACE).  All corners are asked, not only those that met in a table, so
    images that merely share a few alike corners in like places are told from copies.
    """
    p, q = ((r[:, 2 + TABLES] + 1j * r[:, 1 + TABLES]) / 2 for r in (a, b))
    at = p * factor + shift
    height, width = b[0, -2:] / 2 - RADIUS
    steps = np.log(abs(factor)) / np.log(STEP)
    size = a[:, 2 + TABLES + 1] + steps
    inside = (abs(at.imag) <= height) & (abs(at.real) <= width) & (size > -0.5) & (size < LEVELS - 0.5)
    if inside.sum() < VOTES:
        return False
    at, a, p = at[inside], a[inside], p[inside]
    level = b[:, 2 + TABLES + 1] - a[:, 2 + TABLES + 1, None] - steps
    near = (abs(at[:, None] - q) <= OFF * np.maximum(1, STEP ** b[:, 2 + TABLES + 1])) & (abs(level) <= 1)
    i, j = np.nonzero(near)
    apart = sum(np.bitwise_count(a[i, 1 + t] ^ b[j, 1 + t]).astype(np.int64) for t in range(TABLES))
    held = np.zeros(len(a), bool)
    held[i[apart <= MOST_APART]] = True
    one = np.zeros(len(a), np.int64)
    return bool(_distinct(one[held], p[held], 1)[0] >= VOTES and held.sum() >= SHARE * len(a)) if held.any() else False


def linked(ours: np.ndarray, theirs: np.ndarray, votes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The linked images (a, b), a < b, between two sets of corners, or within one if both are the same array.

    Rows are (image, keys of the tables, PLACE), both in the order of images; images are numbers.
    """
    same = ours is theirs
    names, other = np.unique(theirs[:, 0], return_inverse=True)
    own, mine = np.unique(ours[:, 0], return_inverse=True)
    starts, others = (np.r_[np.flatnonzero(np.r_[True, r[1:, 0] != r[:-1, 0]]), len(r)] for r in (ours, theirs))
    for rows, i, j in _matches(ours[:, : 1 + TABLES], theirs[:, : 1 + TABLES]):
        if same:
            once = ours[i, 0] < theirs[j, 0]
            i, j = i[once], j[once]
        first = int(mine[rows.start])
        pair = (mine[i] - first) * len(names) + other[j]
        enough = np.bincount(pair)[pair] >= votes if len(pair) else np.zeros(0, bool)
        i, j, pair = i[enough], j[enough], pair[enough]
        if len(pair):
            low = (ours[i, 0] < theirs[j, 0])[:, None]
            p, q = ours[i, 1 + TABLES :], theirs[j, 1 + TABLES :]
            found, factor, shift = _votes(np.where(low, p, q), np.where(low, q, p), pair, votes)
            good: set[tuple[int, int]] = set()
            for n, f, m in zip(found.tolist(), factor.tolist(), shift.tolist(), strict=True):
                x, y = first + n // len(names), n % len(names)
                ends = (int(own[x]), int(names[y]))
                pieces = (ours[starts[x] : starts[x + 1]], theirs[others[y] : others[y + 1]])
                if ends[0] > ends[1]:
                    ends, pieces = ends[::-1], pieces[::-1]
                if ends not in good and _supported(*pieces, f, m):
                    good.add(ends)
            told = np.array(sorted(good), np.int64).reshape(-1, 2)
            yield told[:, 0], told[:, 1]


def _links(own: DataFrame, votes: int, block: int) -> DataFrame:
    """(a, b): the images of own (id, keys, place) with enough votes for one transform, a < b."""
    blocks = max(1, -(-own.count() // block))
    placed = own.select("id", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "keys", "place")
    point = placed.select("id", "block", F.posexplode("keys").alias("at", "key")).select("id", "block", (F.col("key") * TABLES + F.col("at") % TABLES).alias("bucket"))
    held = point.groupBy("bucket").agg(F.collect_set("block").alias("others"), F.min("id").alias("_first"), F.max("id").alias("_last"))
    shared = stored(held.where("_first <> _last").select("bucket", "others"), "buckets")
    met = point.join(shared, "bucket").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    sent = placed.join(met, "id").select("id", "block", "keys", "place", F.explode("others").alias("other"))
    dealt = sent.select("id", "block", "keys", "place", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    of = own.schema["id"].dataType
    numbers = isinstance(of, T.LongType)

    def run(part: pa.Table) -> pa.Table:
        image = part.column("id").combine_chunks()
        if not numbers:  # any other key that can be ordered is numbered for the task
            labels = image.unique().sort()
            image = pc.index_in(image, labels)
        ids, side = image.to_numpy(zero_copy_only=False).astype(np.int64), part.column("block").to_numpy()
        lists, places = part.column("keys").combine_chunks(), part.column("place")
        keys, many = lists.flatten().to_numpy().reshape(-1, TABLES), lists.value_lengths().to_numpy().astype(np.int64) // TABLES
        begins = np.cumsum(many) - many

        def rows(block: int) -> np.ndarray:
            """The corners of a block's images, in the order of these."""
            which = np.flatnonzero(side == block)
            which = which[np.argsort(ids[which], kind="stable")]
            ends = np.cumsum(many[which])
            made = np.empty((int(many[which].sum()), 1 + TABLES + len(PLACE)), np.int64)
            for i, end in zip(which.tolist(), ends.tolist(), strict=True):
                own = slice(end - int(many[i]), end)
                made[own, 0] = ids[i]
                made[own, 1 : 1 + TABLES] = keys[begins[i] : begins[i] + many[i]]
                made[own, 1 + TABLES :] = np.frombuffer(places[i].as_buffer(), np.int32).reshape(len(PLACE), -1).T
            return made

        lo, hi = part.column("lo")[0].as_py(), part.column("hi")[0].as_py()
        ours = rows(lo)
        theirs = ours if lo == hi else rows(hi)
        out = [(a, b) for a, b in linked(ours, theirs, votes) if len(a)] if len(ours) and len(theirs) else []
        ends = [np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1)]
        made = [pa.array(e) if numbers else labels.take(pa.array(e)) for e in ends]
        return pa.Table.from_arrays(made, names=["a", "b"])

    return dealt.groupBy("lo", "hi").applyInArrow(run, T.StructType([T.StructField("a", of), T.StructField("b", of)]))


def find_copies(images: DataFrame, key: str = "image_id", image: str = "image", votes: int = VOTES, block: int = BLOCK) -> DataFrame:
    """(key, n_corners, n_links, group_id): group_id is the least key of the images linked to it, n_links its own links.

    Links are counted between classes of equal pixels.  Of images with equal corners
    the one of the least key is compared with others and stands for all of them.
    """
    pixels = images.select(F.col(key).alias("id"), F.col(image).alias("image"), F.sha2(image, 256).alias("_sha"))
    hashed = stored(corners(pixels, "image").drop("image").withColumn("_row", F.monotonically_increasing_id()), "pixels")  # each image is read and decoded once
    heads = stored(hashed.groupBy("_sha").agg(F.min("id").alias("id"), F.min_by("_row", "id").alias("_head")), "heads")
    classes = heads.select("_sha", "id")
    first = heads.groupBy("id").agg(F.min("_head").alias("_head"))
    own = stored(hashed.join(first.select("_head"), hashed["_row"] == F.col("_head"), "left_semi").select("id", "n_corners", "n_places", "keys", "place"), "corners")
    # Equal corners are links to each other if they are enough for the votes.
    whole = F.sha2(F.concat(F.hex("place"), F.to_json("keys")), 256)
    alike = own.select("id", F.when(F.col("n_places") >= votes, whole).otherwise(F.concat(F.lit("id "), F.col("id").cast("string"))).alias("_alike"))
    kinds = alike.groupBy("_alike").agg(F.min("id").alias("head"), F.count("*").alias("members"))
    member = stored(alike.select("id", "_alike").join(kinds, "_alike").select("id", "head", "members"), "members")
    links = stored(_links(own.join(member.where("id = head").select("id"), "id", "left_semi"), votes, block), "links")
    both = links.select(F.col("a").alias("head"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("head"), F.col("a").alias("other")))
    degree = both.join(member.where("id = head").select(F.col("head").alias("other"), F.col("members").alias("_n")), "other").groupBy("head").agg(F.sum("_n").alias("_links"))
    group = components(links).withColumnRenamed("node", "head")
    told = member.join(degree, "head", "left").join(group, "head", "left").select("id", (F.coalesce("_links", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "head").alias("component"))
    named = classes.join(own.select("id", "n_corners"), "id").join(told, "id", "left")
    every = hashed.select("_sha", F.col("id").alias(key)).join(named.withColumnRenamed("_sha", "_s"), F.col("_sha").eqNullSafe(F.col("_s")), "left")
    return every.select(key, "n_corners", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id", key).alias("group_id"))


def drawn(ids: DataFrame, key: str, side: int = 64) -> DataFrame:
    """(key, image): a picture for each id, as no test table holds media.

    Of four ids in a row the first is a picture of its own, the second a crop of
    it, the third an edit (contrast, brightness and a painted patch), and the
    fourth another picture.
    """

    def picture(seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        p = np.full((side, side), 128.0)
        for _ in range(40):
            y, x = rng.integers(0, side, 2)
            h, w = rng.integers(4, side // 3, 2)
            p[y : y + h, x : x + w] = rng.integers(0, 256)
        return p

    def of(i: int) -> bytes:
        base, kind = divmod(i, 4)
        p = picture(2 * base + (kind == 3))
        if kind == 1:
            p = p[4 : side - 6, 6 : side - 2]
        elif kind == 2:
            p = p * 0.8 + 20
            p[: side // 5, : side // 5] = 60
        return encode_pgm(p)

    def make():
        return lambda batch: [pa.array([None if i is None else of(i) for i in batch.column(key).to_pylist()], pa.binary())]

    def run(batches):
        work = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(key), *work(batch)], names=[key, "image"])

    return ids.select(key).mapInArrow(run, T.StructType([ids.schema[key], T.StructField("image", T.BinaryType())]))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of copies among the pictures drawn for the rows of embeddings."""
    made = find_copies(drawn(table(spark, sf_dir, "embeddings"), "vec_id"), "vec_id")
    return made.select("vec_id", "n_corners", "n_links", "group_id")
