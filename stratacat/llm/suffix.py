"""Operator 2: removal of long repeated byte strings, by hash-compared suffix sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacat.llm.common import table

LENGTH = 200
GRAM = 32
PIECE = 1 << 20  # window starts that are searched at once; positions take 20 bits beside a hash
NO_ID = -(1 << 63)
BASE = 0x9E3779B97F4A7C15
U = np.uint64
#: The bits of a hash that count. Fewer bits make hashes lie more often, and no result change: for tests.
MASK = (1 << 64) - 1


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n."""
    out, m, step = np.ones(n, dtype=U), 1, U(base)
    with np.errstate(over="ignore"):
        while m < n:
            k = min(m, n - m)
            out[m : m + k] = out[:k] * step
            step, m = step * step, m + k
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers after which all bits depend on all."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


class Hashes:
    """Polynomial prefix hashes modulo 2 ** 64 of byte strings shorter than size: the hash of a part needs two of them and a power."""

    def __init__(self, size: int) -> None:
        self.up, self.down = powers(BASE, size), powers(pow(BASE, -1, 1 << 64), size)

    def prefixes(self, x: np.ndarray) -> np.ndarray:
        """Along the last axis of x, bytes; one more than bytes."""
        out = np.zeros((*x.shape[:-1], x.shape[-1] + 1), dtype=U)
        np.cumsum((x.astype(U) + U(1)) * self.up[: x.shape[-1]], axis=-1, out=out[..., 1:])
        return out


class Hot:
    """A list of gram hashes, asked for many at once: a table of bits first, and the sorted list for what that lets through."""

    def __init__(self, grams: np.ndarray) -> None:
        self.grams, self.table = np.sort(grams.astype(U)), np.zeros(1 << 20, dtype=bool)
        self.table[(self.grams >> U(44)).astype(np.int64)] = True

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=bool)
        if len(self.grams):
            at = np.flatnonzero(self.table[(x >> U(44)).astype(np.int64)])
            i = np.minimum(np.searchsorted(self.grams, x[at]), len(self.grams) - 1)
            out[at] = self.grams[i] == x[at]
        return out


def anchors(x: np.ndarray, h: Hashes, hot: Hot | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of LENGTH-byte windows of x that choose the same anchor: the anchor's hash, the first and last window, the anchor, and whether it is hot.

    A window's anchor is its GRAM bytes with the least hash, the first of equals, and hot grams only where it has no other: it depends on the window's bytes alone, so equal windows have equal
    anchors at the same place in them.
    """
    p, n, reach = h.prefixes(x), len(x), LENGTH - GRAM + 1
    gram = mixed((p[GRAM:] - p[:-GRAM]) * h.down[: n - GRAM + 1])
    is_hot = hot(gram) if hot is not None else np.zeros(len(gram), dtype=bool)
    value = (((gram >> U(1)) | (is_hot.astype(U) << U(63))) & ~U(PIECE * 2 - 1)) | np.arange(len(gram), dtype=U)
    rows = np.concatenate([value, np.full(-len(value) % reach, ~U(0))]).reshape(-1, reach)
    ahead, behind = np.minimum.accumulate(rows, axis=1).ravel(), np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - LENGTH + 1
    at = (np.minimum(behind[:m], ahead[reach - 1 : reach - 1 + m]) & U(PIECE * 2 - 1)).astype(np.int64)
    cut = np.flatnonzero(np.diff(at)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [m - 1]])
    a = at[first]
    return gram[a] & U(MASK), first, last, a, is_hot[a]


def digests(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """BLAKE2b of all the bytes of each run of windows, 128 bits as two numbers. Nobody knows two strings with the same: runs of one digest are the same bytes."""
    data = x.tobytes()
    each = b"".join([hashlib.blake2b(data[i:j], digest_size=16).digest() for i, j in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)])
    return np.frombuffer(each, dtype=np.int64).reshape(-1, 2)


def common_extension(p: np.ndarray, down: np.ndarray, i: tuple, j: tuple, most: np.ndarray) -> np.ndarray:
    """How many bytes, up to most, agree from place i and from place j on, places being (row, offset): a binary search over prefix hashes."""
    lo, hi = np.zeros(len(most), dtype=np.int64), most.astype(np.int64)
    (ri, oi), (rj, oj) = i, j
    pi, pj, di, dj = p[ri, oi], p[rj, oj], down[oi], down[oj]
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = mixed((p[ri, oi + mid] - pi) * di) & U(MASK) == mixed((p[rj, oj + mid] - pj) * dj) & U(MASK)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def suffix_sort(x: np.ndarray, p: np.ndarray, down: np.ndarray, row: np.ndarray, off: np.ndarray, size: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """The order of the suffixes (row, off) of the rows of x, each within its segment; segment is ascending, size has the rows' lengths.

    A mergesort from the bottom, all merges of a level at once: each suffix finds its place in the sister run by binary search, and two suffixes compare by the byte after their common
    extension, which their hashes find in a logarithm of its length.
    """
    n = len(row)
    order = np.arange(n)
    start = np.searchsorted(segment, segment, "left")
    stop = np.searchsorted(segment, segment, "right")
    place = np.arange(n) - start  # within the segment
    longest = int((stop - start).max(initial=0))
    width = 1

    def before(a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        left = np.minimum(size[row[a]] - off[a], size[row[b]] - off[b])
        same = common_extension(p, down, (row[a], off[a]), (row[b], off[b]), left)
        ended = same == left
        ca = x[row[a], np.minimum(off[a] + same, x.shape[1] - 1)].astype(np.int64)
        cb = x[row[b], np.minimum(off[b] + same, x.shape[1] - 1)].astype(np.int64)
        la, lb = size[row[a]] - off[a], size[row[b]] - off[b]
        return np.where(ended, (la < lb) | ((la == lb) & ties), ca < cb)

    while width < longest:
        block = place // (2 * width) * (2 * width)
        right = place - block >= width
        lo = start + block + np.where(right, 0, width)
        hi = np.minimum(start + block + np.where(right, width, 2 * width), stop)
        lo, hi = np.minimum(lo, stop), np.maximum(np.minimum(lo, stop), hi)
        base = lo.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            goes = before(order[mid], order[live], right[live])  # of equals, those of the left run come first
            lo[live] = np.where(goes, mid + 1, lo[live])
            hi[live] = np.where(goes, hi[live], mid)
            live = live[lo[live] < hi[live]]
        new = start + block + (place - block - np.where(right, width, 0)) + (lo - base)
        moved = np.empty_like(order)
        moved[new] = order
        order = moved
        width *= 2
    return order


def repeated_windows(group: np.ndarray, data: list[bytes], anchor: np.ndarray, h: Hashes) -> np.ndarray:
    """For each row of data, whether its window at each start also stands in another row of its group with the anchor at the same place. anchor: its offset in the row.

    Windows whose hash occurs once are out. Of each run of others, the suffix at its start is sorted with those of its group at the same distance from the anchor; the longer of the
    common extensions with its two neighbours settles so many windows, and the run goes on after them. All neighbours are confirmed byte by byte, their extension and their order;
    where a hash has lied, the windows are compared as they are instead.
    """
    size = np.array([len(d) for d in data])
    wide = int(size.max())
    x = np.zeros((len(data), wide), dtype=np.uint8)
    for i, d in enumerate(data):
        x[i, : len(d)] = np.frombuffer(d, dtype=np.uint8)
    p = h.prefixes(x)
    m = wide - LENGTH + 1
    there = np.arange(m)[None, :] <= (size - LENGTH)[:, None]
    key = (mixed((p[:, LENGTH:] - p[:, :-LENGTH]) * h.down[:m]) & U(MASK)) ^ mixed((group[:, None] * 512 + anchor[:, None] - np.arange(m)[None, :]).astype(U))
    _, back, counts = np.unique(key[there], return_inverse=True, return_counts=True)
    twice = np.zeros_like(there)
    twice[there] = counts[back] > 1
    found, open_ = np.zeros_like(there), twice.copy()
    place = group[:, None] * 512 + anchor[:, None] - np.arange(m)[None, :]  # of equal strings of a group, the same
    span = np.arange(wide)[None, :]
    while open_.any():
        begins = open_.copy()
        begins[:, 1:] &= ~open_[:, :-1]
        row, off = np.nonzero(twice & np.isin(place, np.unique(place[begins])))
        by = np.argsort(place[row, off], kind="stable")
        row, off = row[by], off[by]
        segment = place[row, off]
        order = suffix_sort(x, p, h.down, row, off, size, segment)
        r, o = row[order], off[order]
        most = np.minimum(size[r[1:]] - o[1:], size[r[:-1]] - o[:-1])
        within = segment[1:] == segment[:-1]
        ext = np.where(within, common_extension(p, h.down, (r[1:], o[1:]), (r[:-1], o[:-1]), most), 0)
        for lo in range(0, len(ext), 1 << 14):  # the hashes may lie, the bytes don't
            k = np.flatnonzero(within[lo : lo + (1 << 14)]) + lo
            e = ext[k][:, None]
            before, after = (x[r[i][:, None], np.minimum(o[i][:, None] + span, wide - 1)] for i in (k, k + 1))
            ended = (e[:, 0] == most[k]) & (size[r[k]] - o[k] <= size[r[k + 1]] - o[k + 1])
            at = np.minimum(e, wide - 1)
            if ((before != after) & (span < e)).any() or not (ended | (np.take_along_axis(before, at, 1) < np.take_along_axis(after, at, 1))[:, 0]).all():
                return plain_windows(group, data, anchor, m)
        best = np.maximum(np.concatenate([[0], ext]), np.concatenate([ext, [0]]))
        settled = np.zeros((len(data), m + 1), dtype=np.int64)
        np.add.at(settled, (r, o), 1)
        np.add.at(settled, (r, np.minimum(o + np.maximum(best - LENGTH + 1, 0), m)), -1)
        found |= (np.cumsum(settled[:, :m], axis=1) > 0) & there
        open_ &= ~found
        open_[row, off] = False  # settled, or alone after all
    return found


def plain_windows(group: np.ndarray, data: list[bytes], anchor: np.ndarray, m: int) -> np.ndarray:
    """What repeated_windows returns, by the windows' bytes alone. m: the most windows that a row has."""
    places: dict[tuple, list[tuple[int, int]]] = {}
    for i, d in enumerate(data):
        for k in range(len(d) - LENGTH + 1):
            places.setdefault((int(group[i]), int(anchor[i]) - k, d[k : k + LENGTH]), []).append((i, k))
    found = np.zeros((len(data), m), dtype=bool)
    for at in places.values():
        if len(at) > 1:
            found[tuple(zip(*at, strict=True))] = True
    return found


def intervals(flags: np.ndarray, first: int) -> list[tuple[int, int]]:
    """Byte ranges that windows starting at first + the places of true flags cover, those that touch joined."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > LENGTH)
    begin, end = np.concatenate([at[:1], at[cut + 1]]), np.concatenate([at[cut], at[-1:]]) + LENGTH
    return [(int(b) + first, int(e) + first) for b, e in zip(begin, end, strict=True)]


_ANCHORS = "kind int, key long, seg long, seg2 long, k1 long, k2 long, first long, packed int"
_FOUND = "kind int, key long, k1 long, k2 long, first long, packed int"
_PLACES = "kind int, key long, seg long, k1 long, k2 long, first long, packed int, data binary"
_SPANS = "k1 long, k2 long, begin long, end long"


def _batch(schema: list[tuple[str, pa.DataType]], *columns) -> pa.RecordBatch:  # noqa: ANN002
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def _fields(ddl: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return [(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))]


def _scan(hot: np.ndarray, held: int = 1 << 15):  # noqa: ANN202
    """Texts -> the anchors of their windows (kind 1), in pieces of PIECE windows, so that a long text takes no more memory.

    Of runs with a hot anchor a task sends the first and knows it again: another one with the same bytes is a repeat, and so is the first (kind 0). The task remembers `held` such runs at most; what it has forgotten it sends again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, is_hot = Hashes(PIECE + LENGTH), Hot(hot)
        seen: dict[bytes, list] = {}
        for b in batches:
            for k1, k2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                x = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
                for lo in range(0, len(x) - LENGTH + 1, PIECE):
                    y = x[lo : lo + PIECE + LENGTH - 1]
                    key, first, last, a, many = anchors(y, h, is_hot)
                    seg, n = digests(y, first, last), len(key)
                    kind, packed = np.ones(n, dtype=np.int32), ((last - first) << 8 | (a - first)).astype(np.int32)
                    told: list[tuple] = []
                    for i in np.flatnonzero(many).tolist():
                        part = y[first[i] : last[i] + LENGTH].tobytes()
                        if (e := seen.get(part)) is None:
                            if len(seen) >= held:
                                seen.clear()
                            seen[part] = [(k1, k2, int(first[i]) + lo, int(packed[i])), False]
                            continue
                        kind[i] = 0
                        if not e[1]:
                            told.append(e[0])
                            e[1] = True
                    yield _batch(_fields(_ANCHORS), kind, key.view(np.int64), seg[:, 0], seg[:, 1], np.full(n, k1), np.full(n, k2), first + lo, packed)
                    if told:
                        zero = [0] * len(told)
                        yield _batch(_fields(_ANCHORS), zero, zero, zero, zero, *map(list, zip(*told, strict=True)))

    return run


def _grams_around(hot: np.ndarray):  # noqa: ANN202
    """Texts -> the hashes of all grams of the runs that have a hot anchor, once a text and piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, is_hot = Hashes(PIECE + LENGTH), Hot(hot)
        for b in batches:
            for text in b.column(2):
                x = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
                for lo in range(0, len(x) - LENGTH + 1, PIECE):
                    y = x[lo : lo + PIECE + LENGTH - 1]
                    key, first, last, _, _ = anchors(y, h)
                    many = is_hot(key)
                    if many.any():
                        near = np.zeros(len(y) + 1, dtype=np.int64)
                        np.add.at(near, first[many], 1)
                        np.add.at(near, last[many] + LENGTH - GRAM + 1, -1)
                        p = h.prefixes(y)
                        at = np.flatnonzero(np.cumsum(near)[: len(y) - GRAM + 1] > 0)
                        yield pa.RecordBatch.from_arrays([pa.array(np.unique(mixed((p[at + GRAM] - p[at]) * h.down[at]).view(np.int64)))], names=["key"])

    return run


def hot_grams(texts: DataFrame, one_in: int = 16, often: int = 16, most: int = 1 << 17) -> np.ndarray:
    """Hashes of grams around anchors that `often` runs or more have in one of `one_in` rows: those in `often` texts of these or more, the most frequent `most` at most. They decide who meets whom, and no result: any list is right."""
    some = texts.where(F.pmod(F.xxhash64("k1", "k2"), F.lit(one_in)) == 0)
    top = lambda keys: keys.groupBy("key").count().where(F.col("count") >= often).orderBy(F.desc("count"), "key").limit(most).select("key").toArrow()["key"].to_numpy().view(U)
    found = top(some.mapInArrow(_scan(np.zeros(0, dtype=U)), _ANCHORS))
    return top(some.mapInArrow(_grams_around(found), "key long")) if len(found) else found


def _sift(most: int):  # noqa: ANN202
    """Anchors sorted by kind, key and digest -> kind 0: a repeat, as it came or because another run has its digest; 1: to be looked at with the other runs of its key, of equal runs only one; 2: as 1, of more than most.

    A key with one run is out. Of a key no more than most rows are held, however many copies a run has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros((5, 0), dtype=np.int64)  # key, k1, k2, first, packed
        held, last, crowded = none, None, None

        def out(kind: int, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            if c.shape[1]:
                yield _batch(_fields(_FOUND), np.full(c.shape[1], kind), *c)

        for b in chain(batches, [None]):
            new = none
            if b is not None:
                cols = np.array([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
                rows = cols[[1, 4, 5, 6, 7]]
                yield from out(0, rows[:, cols[0] == 0])
                cols, rows = cols[1:4, cols[0] == 1], rows[:, cols[0] == 1]
                if rows.shape[1]:
                    same = (cols[:, 1:] == cols[:, :-1]).all(axis=0)
                    before = np.r_[last is not None and bool((last[0] == cols[:, 0]).all()), same]
                    if before[0] and not last[2]:
                        yield from out(0, last[1])
                    twice = before | np.r_[same, False]
                    yield from out(0, rows[:, twice])
                    last = (cols[:, -1], rows[:, -1:], bool(twice[-1]))  # the run may go on: whether it has been told
                    new = rows[:, ~before]
            if crowded is not None:
                yield from out(2, new[:, new[0] == crowded])
                new = new[:, new[0] != crowded]
            held = np.concatenate([held, new], axis=1)
            starts = np.flatnonzero(np.r_[True, held[0, 1:] != held[0, :-1]]) if held.shape[1] else np.zeros(0, dtype=np.int64)
            end = held.shape[1] if b is None or not len(starts) else starts[-1]  # the last key may go on
            sizes = np.diff(np.r_[starts, held.shape[1]])
            of = np.repeat(sizes, sizes)[:end]
            yield from out(1, held[:, :end][:, (of > 1) & (of <= most)])
            yield from out(2, held[:, :end][:, of > most])
            held = held[:, end:]
            if held.shape[1] > most:
                crowded = int(held[0, 0])
                yield from out(2, held)
                held = none

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their places of kind 1 and 2 -> the bytes of each place, or for kind 2 a row for each window: two hashes, where it starts and its bytes."""
    h = Hashes(LENGTH + 512)
    other = Hashes(LENGTH + 512)
    other.up, other.down = powers(0xC2B2AE3D27D4EB4F, LENGTH + 512), powers(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64), LENGTH + 512)
    for b in batches:
        out: list[tuple] = []
        for k1, k2, text, places in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            for q in places:
                first, more = q["first"], q["packed"] >> 8
                part = data[first : first + more + LENGTH]
                if q["kind"] == 1:
                    out.append((1, q["key"], 0, k1, k2, first, q["packed"], part))
                    continue
                x = np.frombuffer(part, dtype=np.uint8)
                one, two = (mixed((p[LENGTH:] - p[:-LENGTH]) * g.down[: more + 1]).view(np.int64).tolist() for g in (h, other) for p in (g.prefixes(x),))
                out += [(2, a, c, k1, k2, first + i, 0, part[i : i + LENGTH]) for i, (a, c) in enumerate(zip(one, two, strict=True))]
            if len(out) > 2000:
                yield _batch(_fields(_PLACES), *map(list, zip(*out, strict=True)))
                out = []
        if out:
            yield _batch(_fields(_PLACES), *map(list, zip(*out, strict=True)))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places sorted by kind, key and seg -> the spans of text whose windows occur elsewhere. Whole groups of kind 1 are taken some thousand places at a time; of kind 2, windows of equal hashes and bytes count."""
    h = Hashes(LENGTH + 512)
    held: list[tuple] = []
    spans: list[tuple] = []
    last: tuple | None = None
    same: dict[bytes, tuple | None] = {}  # of one pair of hashes: bytes -> the first row, None once it has been told

    def settle(rows: list[tuple]) -> None:
        if len(rows) < 2:
            return
        group = np.cumsum(np.concatenate([[0], np.diff(np.array([r[1] for r in rows])) != 0])).astype(np.int64)
        anchor = np.array([r[6] & 255 for r in rows], dtype=np.int64)
        for r, flags in zip(rows, repeated_windows(group, [r[7] for r in rows], anchor, h), strict=True):
            spans.extend((r[3], r[4], begin, end) for begin, end in intervals(flags, r[5]))

    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
            if row[0] == 1:
                if len(held) >= 2000 and row[1] != held[-1][1]:
                    settle(held)
                    held = []
                held.append(row)
                continue
            if last is None or last[1:3] != row[1:3]:
                same.clear()
            last = row
            if row[7] not in same:
                same[row[7]] = row
                continue
            first, same[row[7]] = same[row[7]], None
            spans += [(x[3], x[4], x[5], x[5] + LENGTH) for x in (first, row) if x]
        if spans:
            yield _batch(_fields(_SPANS), *map(list, zip(*spans, strict=True)))
            spans = []
    settle(held)
    if spans:
        yield _batch(_fields(_SPANS), *map(list, zip(*spans, strict=True)))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that spans cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, most: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, removed (an array of begin, end in bytes) and kept (the remaining bytes) of every row of docs: without each byte that a LENGTH-byte string covers which starts anywhere else too.

    Each window of LENGTH bytes belongs to an anchor in it (one in 70 bytes or so); only anchors' hashes are shuffled. Windows around anchors that occur once are unique. Where all the windows of
    two runs have one 128-bit digest, both are repeats. One run of each digest goes
    with its bytes to the group of its anchor, where suffix sorting settles each window, every neighbour confirmed byte by byte. The grams of common passages are found in a sample
    and chosen only by windows that have no other, so a common passage's edges meet nobody by it; and its inside is compared where it is read, so that a task sends it once.
    Groups that still have more than `most` places go window by window, hashes and bytes, to as many tasks as there are windows. Texts are shuffled once, by row.
    A null text has no bytes. Rows are told apart by doc_id and text hash; those that repeat both are equal anyway, and repeat each other.
    """
    k1, k2 = F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), F.xxhash64(docs["text"])
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), docs["text"].alias("text"))
    scanned = texts.mapInArrow(_scan(hot_grams(texts)), _ANCHORS).repartition(F.when(F.col("kind") == 0, F.xxhash64("k1", "k2", "first")).otherwise(F.col("key")))
    found = scanned.sortWithinPartitions("kind", "key", "seg", "seg2").mapInArrow(_sift(most), _FOUND)
    look = found.where("kind > 0").groupBy("k1", "k2").agg(F.collect_set(F.struct("kind", "key", "first", "packed")).alias("places"))
    places = texts.join(look.hint("shuffle_merge"), ["k1", "k2"]).select("k1", "k2", "text", "places").mapInArrow(_cut_out, _PLACES)
    edges = places.repartition("key").sortWithinPartitions("kind", "key", "seg").mapInArrow(_settle, _SPANS)
    whole = found.where("kind = 0").select("k1", "k2", F.col("first").alias("begin"), (F.col("first") + F.shiftright("packed", 8) + LENGTH).alias("end"))
    spans = whole.unionByName(edges).groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                ids, sizes, removed, kept = [], [], [], []
                for a, text, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    gone = merged([(x["begin"], x["end"]) for x in s or []])
                    ids.append(None if a == NO_ID else a)
                    sizes.append(len(data))
                    removed.append([{"begin": x, "end": y} for x, y in gone])
                    kept.append(b"".join(data[x:y] for x, y in zip([0, *(y for _, y in gone)], [*(x for x, _ in gone), len(data)], strict=True)))
                span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return texts.join(spans.hint("shuffle_merge"), ["k1", "k2"], "left").select("k1", "text", "spans").mapInArrow(apply, "doc_id long, n_bytes long, removed array<struct<begin: long, end: long>>, kept binary")


def op2(spark, sf_dir: str) -> DataFrame:
    """A row for each row of documents. Null and empty texts have no bytes: nothing is removed, and the digest is that of nothing. Repeated rows repeat each other, with or without an id. Texts are taken whole, in pieces; no rows give none."""
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute(texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    """What op2 returns besides ids, from a count of every window: for tests."""
    from collections import Counter

    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    counts = Counter(d[i : i + LENGTH] for d in data for i in range(len(d) - LENGTH + 1))
    out = []
    for d in data:
        gone = merged([(i, i + LENGTH) for i in range(len(d) - LENGTH + 1) if counts[d[i : i + LENGTH]] > 1])
        kept = b"".join(d[x:y] for x, y in zip([0, *(y for _, y in gone)], [*(x for x, _ in gone), len(d)], strict=True))
        out.append((len(d), sum(y - x for x, y in gone), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
