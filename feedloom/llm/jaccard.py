"""N-gram Jaccard join by token-combination prefixes: exact components of near-duplicate documents.

A document is the set of its ``shingle``-word shingles. Two documents link when their Jaccard similarity is at
least ``percent`` / 100. Shingles are put in one global order, rare before frequent; how frequent comes first from
a sketch of ``CLASSES`` hash classes counted over all documents, whose size is fixed. A shingle that the sketch calls rare
but that so many different sets hold in their prefixes that one bucket can't compare them (``ALL_OF``) is found there,
exactly; all of these are frequent in the next drawing of the index, whose prefixes pass them by. Two sets that link share
at least e shingles among their first n - ceil(t n) + e in that order (the prefix, extended by e - 1). Either one of
those is rare, and rare shingles are indexed singly; or all are frequent, and pairs of frequent shingles are
indexed. Documents of up to PAIRS_UP_TO shingles extend by one and index every pair. For larger ones e grows with the size, by classes of
sizes, and shingles fall into e - 1 groups by hash: of e that are shared two are in one group, so only pairs within groups are
indexed, a few for each shingle. A document is indexed for every class that it could link with, so no link is lost.

Index entries meet in buckets, under the hash of their set and with its size: equal sets count once, and an entry that
no other set of a fitting size has goes no further. What a set shares in one bucket travels as one row. Among documents that share an entry, those may link whose sizes and bitmaps allow it: a bitmap has
a bit for each hash place, flipped by every shingle there, so two of them differ in no more bits than the sets in
shingles. Each bucket returns what is connected, as stars. The buckets go in rounds, one in eight of them first: what a round connects has one colour
in the next, which returns stars of colours only, so that near copies that share many entries are not said to be
connected once for each of them. Components of these are candidate groups, and only
their members' sets are built again. A group that fits a cell of bounded
size is verified there, where documents already connected are not compared again; a larger one in cells of prefixes,
whose proposed pairs are then verified. Copies with equal sets
within a slice of rows are settled before any shuffle; of those left, one goes on to the buckets' pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import connected_components, default_parallelism, written
from .textcore import U64, mix

CLASS_BITS = 20
CLASSES = 1 << CLASS_BITS
_RANGES = 64
#: Groups in which tasks' counts are added before the groups' are.
_SALTS = 512
#: A class is frequent when it holds so many times the mean number of shingles.
FREQUENT = 4
#: Times the index is drawn at most. Each drawing but the last leaves the rare shingles that too many sets hold to the next,
#: where they are frequent: TOLD of them at most (8 bytes each, sent to every task), those of the most sets first.
DRAWN, TOLD = 4, 1 << 21
#: Documents of at most so many shingles index all pairs of frequent shingles; each class of sizes above is twice as large,
#: and extends the prefix by one shingle for so many of it.
PAIRS_UP_TO, EXTENDED = 400, 8
#: Shingles in a verification cell; larger candidate groups are split.
CELL = 4_000_000
#: Documents of a cell, the last ones gone through, with which the next is compared at once.
RECENT = 3
#: Bits of a bitmap at most; documents of many more shingles are told apart by their verification alone.
BITS = 1 << 14
#: Bits for each shingle in which two linked sets of one size may differ, half of them in either.
BITS_PER = 7
#: A round takes the buckets whose number these divide, the last one all that are left.
ROUNDS = (8, 1)
#: Steps of a size's logarithm in the index, and bytes of an entry's hash; entries that fall together are told apart later.
SIZE_STEPS, ENTRY_BYTES = 2000, 5
#: Entries of pairs have this bit, single ones don't.
_OF_TWO = U64(1 << 63)
_PAIR, _SINGLE = U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25)


def shingles(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles (the whole sequence where it is shorter), and each row's first."""
    start, end, bounds = tc.words(tc.LOWER[buf], off)
    h = tc.word_hashes(tc.LOWER[buf], start, end)
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = tc.ranges(bounds[:-1], count)
    size = np.repeat(np.minimum(n, k), count)
    return tc.span(tc.prefix(h), at, at + size) + size.astype(U64), np.concatenate([[0], np.cumsum(count)])


def _count(k: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for _, buf, off, _ in tc.slices(batch.column(0), batch.column(1)):
                h, _ = shingles(buf, off, k)
                total += np.bincount((h >> U64(64 - CLASS_BITS)).astype(np.int64), minlength=CLASSES)
        if total.any():
            rows, salt = total.reshape(_RANGES, -1), TaskContext.get().partitionId() % _SALTS
            yield pa.RecordBatch.from_arrays([pa.array(range(_RANGES), pa.int32()), pa.array([salt] * _RANGES, pa.int32()), pa.array([zlib.compress(r.tobytes(), 1) for r in rows], pa.binary())], names=["range", "salt", "counts"])

    return count


def _total(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.int64) for x in table.column("counts"))
    return pa.table({"range": pa.array([table.column("range")[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def frequency_classes(source: DataFrame, k: int) -> np.ndarray:
    """For each hash class 0 if it is rare, else 1 and more with its count: CLASSES bytes, whatever the input."""
    counted, summed = source.mapInArrow(_count(k), "range int, salt int, counts binary"), "range int, counts binary"
    rows = counted.groupBy("range", "salt").applyInArrow(_total, summed).groupBy("range").applyInArrow(_total, summed).collect()
    counts = np.zeros((_RANGES, CLASSES // _RANGES))
    for r in rows:
        counts[r["range"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    counts = counts.reshape(-1)
    over = counts / max(counts.mean(), 1e-9) / FREQUENT
    often = (over > 1) & (counts >= 16)
    return np.where(often, 1 + np.minimum(np.log2(np.maximum(over, 1)) * 4, 60), 0).astype(np.uint8)


def _single(token: np.ndarray) -> np.ndarray:
    return mix(token) & ~_OF_TWO


def ordered_sets(h: np.ndarray, first: np.ndarray, classes: np.ndarray, told: np.ndarray | None = None) -> list[np.ndarray]:
    """Each row's distinct shingles in the global order: class in the high byte, then the hash.

    ``told`` are the entries (their last ENTRY_BYTES bytes), in order, of shingles that are frequent whatever their class."""
    low = h >> U64(8)
    token = low | (classes[(h >> U64(64 - CLASS_BITS)).astype(np.int64)].astype(U64) << U64(56))
    if told is not None and len(told):
        e = _single(low) >> U64(64 - 8 * ENTRY_BYTES)
        hit = told[np.minimum(np.searchsorted(told, e), len(told) - 1)] == e
        token = np.where(hit, low | U64(255 << 56), token)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        t = np.sort(token[a:b])
        out.append(t[np.append(True, t[1:] != t[:-1])] if b > a + 1 else t)
    return out


def size_class(n: int) -> int:
    """0 for sets whose pairs are all indexed, then one for each doubling of the size."""
    return 0 if n <= PAIRS_UP_TO else 1 + ((n - 1) // PAIRS_UP_TO).bit_length() - 1


def extended(k: int, percent: int) -> int:
    """Shingles that two sets of class k share in their prefixes, when those are as much longer, less one."""
    return 2 if not k else max(2, (PAIRS_UP_TO << (k - 1)) * (100 - percent) // (100 * EXTENDED))


def _pairs(often: np.ndarray, groups: int, k: int) -> np.ndarray:
    """Entries of all pairs within the groups of class k."""
    if groups > 1:
        group = mix(often ^ _SINGLE) % U64(groups)
        order = np.argsort(group, kind="stable")
        often, group = often[order], group[order]
        size = np.bincount(np.unique(group, return_inverse=True)[1])
        later = np.repeat(np.cumsum(size), size) - np.arange(len(often)) - 1
        i, j = np.repeat(np.arange(len(often)), later), tc.ranges(np.arange(len(often)) + 1, later)
    else:
        i, j = np.triu_indices(len(often), 1)
    return mix(often[i] * _PAIR ^ mix(often[j]) ^ U64(k)) | _OF_TWO


def entries(t: np.ndarray, percent: int) -> np.ndarray:
    """Index entries of one ordered set of at least two shingles."""
    n, rare, out = len(t), 0, []
    for k in range(size_class(-(-n * percent // 100)), size_class(n * 100 // percent) + 1):
        e = extended(k, percent)
        lead = t[: n + (-n * percent // 100) + e]
        first = int(np.searchsorted(lead, U64(1) << U64(56)))
        rare = max(rare, first)
        if len(lead) - first > 1:
            out.append(_pairs(lead[first:], e - 1, k))
    return np.concatenate([_single(t[:rare]), *out])


def _labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a-b and the smallest node that each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def bitmap(t: np.ndarray, percent: int) -> bytes:
    """One bit for each hash place, flipped by every shingle there; two bitmaps differ in no more bits than the sets do."""
    want = BITS_PER * len(t) * (100 - percent) / (100 + percent)
    bits = min(max(64, 1 << max(0, int(np.ceil(np.log2(max(want, 1)))))), BITS)
    at = (mix(t ^ _SINGLE) & U64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _pack(token: np.ndarray, of: np.ndarray, key: np.ndarray, code: np.ndarray) -> bytes:
    """Entries of one bucket, those of a set together: how many sets, their names, size codes and counts, then the entries."""
    new = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    count = np.diff(np.append(new, len(of))).astype(np.uint32)
    sets = of[new]
    low = token.view(np.uint8).reshape(-1, 8)[:, 8 - ENTRY_BYTES :]
    return b"".join([np.int64(len(sets)).tobytes(), key[sets].tobytes(), code[sets].tobytes(), count.tobytes(), low.tobytes()])


def _unpack(b: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each packed entry with its set's name and size code."""
    m = int(np.frombuffer(b, np.int64, 1)[0])
    key, code, count = np.frombuffer(b, U64, m, 8), np.frombuffer(b, np.uint16, m, 8 + 8 * m), np.frombuffer(b, np.uint32, m, 8 + 10 * m)
    low = np.frombuffer(b, np.uint8, -1, 8 + 14 * m).reshape(-1, ENTRY_BYTES)
    token = np.zeros((len(low), 8), np.uint8)
    token[:, :ENTRY_BYTES] = low
    return token.view(U64).reshape(-1), np.repeat(key, count), np.repeat(code, count)


def _index(k: int, percent: int, buckets: int, classes: np.ndarray, told: np.ndarray):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, buf, off, _ in tc.slices(batch.column(0), batch.column(1)):
                h, first = shingles(buf, off, k)
                sets = ordered_sets(h, first, classes, told)
                n = np.array([len(t) for t in sets])
                f1 = np.array([mix(t).sum() if len(t) else 0 for t in sets], U64)
                f2 = np.array([np.bitwise_xor.reduce(mix(t ^ _PAIR)) if len(t) else 0 for t in sets], U64)
                lead: dict[tuple[int, int, int], int] = {}
                for i in np.argsort(ids, kind="stable").tolist():
                    lead.setdefault((int(n[i]), int(f1[i]), int(f2[i])), i)
                own = np.array([i for i in lead.values() if n[i] > 1], np.int64)
                found = [entries(sets[i], percent) for i in own.tolist()]
                token = np.concatenate(found) if found else np.zeros(0, U64)
                of = np.repeat(np.arange(len(own)), [len(x) for x in found])
                key, code = f1[own], np.floor(np.log(n[own]) * SIZE_STEPS).astype(np.uint16)
                bucket = (token % U64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                cut = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
                to_bucket = [bucket[order[x]] for x in cut[:-1]]
                blobs = [_pack(token[order[x:y]], of[order[x:y]], key, code) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                rows, m = len(ids), len(blobs)
                first_of = np.array([ids[lead[int(n[i]), int(f1[i]), int(f2[i])]] for i in range(rows)], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*to_bucket, *[None] * rows], pa.int32()),
                        pa.array([*blobs, *[bitmap(t, percent) for t in sets]], pa.binary()),
                        *(pa.array([*[None] * m, *x.astype(np.int64).tolist()], pa.int64()) for x in (ids, n, f1.view(np.int64), f2.view(np.int64), first_of)),
                    ],
                    names=["bucket", "entries", "id", "n", "f1", "f2", "lead"],
                )

    return index


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _link_table(a: np.ndarray, b: np.ndarray) -> pa.Table:
    on = a != b
    return pa.Table.from_arrays([pa.array(a[on], pa.int64()), pa.array(b[on], pa.int64())], schema=LINK)


def _meet(percent: int):
    apart = int(SIZE_STEPS * np.log(100 / percent)) + 2

    def meet(table: pa.Table) -> pa.Table:
        """One bucket of the index: for each set its entries that another set of a fitting size has, packed."""
        t, f, c = (np.concatenate(x) for x in zip(*(_unpack(x.as_buffer()) for chunk in table.column("entries").chunks for x in chunk), strict=True))
        order = np.lexsort((f, c, t))
        t, f, c = t[order], f[order], c[order].astype(np.int64)
        own = np.append(True, (t[1:] != t[:-1]) | (f[1:] != f[:-1]))
        t, f, c = t[own], f[own], c[own]
        # within an entry sizes ascend, so the nearest size stands beside
        near = (t[1:] == t[:-1]) & (c[1:] - c[:-1] <= apart)
        on = np.append(False, near) | np.append(near, False)
        t, f = t[on], f[on]
        order = np.argsort(f, kind="stable")
        t, f = t[order], f[order]
        new = np.flatnonzero(np.append(True, f[1:] != f[:-1])) if len(f) else np.zeros(0, np.int64)
        packed = pa.Array.from_buffers(pa.large_binary(), len(new), [None, pa.py_buffer(np.append(new, len(t)) * 8), pa.py_buffer(t)])
        bucket = np.full(len(new), table.column("bucket")[0].as_py(), np.int32)
        return pa.Table.from_arrays([pa.array(bucket), pa.array(f[new].view(np.int64)), packed.cast(pa.binary())], names=["bucket", "f", "shared"])

    return meet


#: Documents with one entry up to which pairs are tested at once, and, of different colours, one against all. A single shingle
#: of more is left to the next drawing; pairs of more, and all of them in the last drawing, are chained by size.
PAIRS_OF, ALL_OF = 64, 5_000
#: Distances in the order of sizes at which documents with one entry are compared before it is counted how many colours they have.
_BESIDE = (1, 2, 3, 5, 8, 13)
STARS = pa.schema([*LINK, ("sets", pa.int64())])


class _Bitmaps:
    """Bitmaps of the documents of one bucket, by width; a wider one is folded to a narrower one's width."""

    def __init__(self, raw: list[bytes], n: np.ndarray, percent: int) -> None:
        self.n, self.percent = n, percent
        self.width = np.array([len(b) for b in raw], np.int64)
        self.row = {}
        self.rows = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero((self.width == w) | (self.width == 2 * w))
            m = np.stack([np.frombuffer(raw[i], np.uint64) if len(raw[i]) == w else np.bitwise_xor(*np.frombuffer(raw[i], np.uint64).reshape(2, -1)) for i in at.tolist()])
            place = np.full(len(raw), -1, np.int64)
            place[at] = np.arange(len(at))
            self.row[w], self.rows[w] = place, m

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs may link, by sizes and bitmaps."""
        a, b = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        good = 100 * a >= self.percent * b
        w, wide = np.minimum(self.width[i], self.width[j]), np.maximum(self.width[i], self.width[j])
        for v in np.unique(w[good]).tolist():
            at = np.flatnonzero(good & (w == v) & (wide <= 2 * v))
            for lo in range(0, len(at), 100_000):
                k = at[lo : lo + 100_000]
                differ = np.bitwise_count(self.rows[v][self.row[v][i[k]]] ^ self.rows[v][self.row[v][j[k]]]).sum(axis=1, dtype=np.int64)
                good[k] = differ * (100 + self.percent) <= (100 - self.percent) * (a[k] + b[k])
        return good


def _prune(percent: int, last: bool = True):
    def prune(table: pa.Table) -> pa.Table:
        """One bucket of shared entries: colours whose documents may link, as stars of connected ones; and, where this isn't
        the last drawing, single entries of too many different sets (as a) with the number of those (sets)."""
        docs, n, colour = (table.column(c).to_numpy() for c in ("id", "n", "colour"))
        maps = _Bitmaps(table.column("bits").to_pylist(), n, percent)
        shared = [np.frombuffer(x.as_buffer(), U64) for chunk in table.column("shared").chunks for x in chunk]
        who, entry = np.repeat(np.arange(len(docs)), [len(x) for x in shared]), np.concatenate(shared)
        order = np.lexsort((who, n[who], entry))
        e, who = entry[order], who[order]
        new = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
        size = np.diff(np.append(new, len(e)))
        small = size <= PAIRS_OF
        ends = np.repeat(new + size, size)
        at = np.flatnonzero(np.repeat(small, size))
        later = ends[at] - at - 1
        pairs = []
        _, first, own = np.unique(colour, return_index=True, return_inverse=True)
        label = first[own]
        for lo in range(0, len(at), 200_000):
            i = np.repeat(at[lo : lo + 200_000], later[lo : lo + 200_000])
            j = tc.ranges(at[lo : lo + 200_000] + 1, later[lo : lo + 200_000])
            x, y = who[i], who[j]
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            key = np.unique(np.minimum(x, y) * len(docs) + np.maximum(x, y))
            x, y = key // len(docs), key % len(docs)
            good = maps.near(x, y)
            pairs.append((x[good], y[good]))
        met: dict[tuple[bytes, bool], int] = {}
        heavy: list[tuple[int, int]] = []
        if pairs:
            x, to = _labels(*(label[np.concatenate(c)] for c in zip(*pairs, strict=True)))
            joined = np.arange(len(docs))
            joined[x] = to
            label = joined[label]
        for a, m in zip(new[~small].tolist(), size[~small].tolist(), strict=True):
            g = who[a : a + m]
            single = not e[a] >> U64(8 * ENTRY_BYTES - 1)
            if (name := (g.tobytes(), single)) in met:
                if single and met[name]:
                    heavy.append((int(e[a]), met[name]))
                continue
            met[name] = 0
            if m > ALL_OF:
                for k in _BESIDE:
                    x, y = g[:-k], g[k:]
                    x, y = (c[label[x] != label[y]] for c in (x, y))
                    near = maps.near(x, y)
                    if near.any():
                        pairs.append((x[near], y[near]))
                        joined = np.arange(len(docs))
                        joined.put(*_labels(label[x[near]], label[y[near]]))
                        label = joined[label]
            colours = len(np.unique(label[g]))
            if m > ALL_OF and colours > ALL_OF and not last and single:
                met[name] = colours
                heavy.append((int(e[a]), colours))
                continue
            if m > ALL_OF and colours > ALL_OF:
                on = 100 * maps.n[g[:-1]] >= percent * maps.n[g[1:]]
                pairs.append((g[:-1][on], g[1:][on]))
                continue
            low = np.searchsorted(maps.n[g], maps.n[g] * percent / 100)
            own, apart = label[g], colours
            for k in range(1, m):
                if apart == 1:
                    break
                y = np.flatnonzero(own[low[k] : k] != own[k]) + low[k]
                if len(y):
                    y = y[maps.near(np.full(len(y), g[k]), g[y])]
                    _, one = np.unique(own[y], return_index=True)
                    for z in y[one].tolist():
                        pairs.append((g[k : k + 1], g[z : z + 1]))
                        label[label == own[z]] = own[k]
                        apart -= 1
                    if len(one):
                        own = label[g]
        a, b = (np.concatenate(c) if pairs else np.zeros(0, np.int64) for c in (zip(*pairs, strict=True) if pairs else ((), ())))
        a, b = colour[a], colour[b]
        stars = _link_table(*_labels(a, b)) if (a != b).any() else LINK.empty_table()
        entry, sets = zip(*heavy, strict=True) if heavy else ((), ())
        return pa.concat_tables([stars.append_column("sets", pa.nulls(len(stars), pa.int64())), pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (entry, [None] * len(entry), sets)], schema=STARS)])

    return prune


def _build(k: int, classes: np.ndarray):
    """Rows (cell, colour, id, text) to rows with the ordered set in place of the text."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, off, at in tc.slices(batch.column("id"), batch.column("text")):
                sets = ordered_sets(*shingles(buf, off, k), classes)
                part = batch.slice(at, len(sets))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("component", "blocks", "block", "id")), pa.array([t.tobytes() for t in sets], pa.binary())], names=["component", "blocks", "block", "id", "tokens"])

    return build


def linked(ids: np.ndarray, colour: np.ndarray, sets: list[np.ndarray], percent: int, sizes: np.ndarray | None = None, forest: bool = True) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Labels of the documents of one cell: equal within a connected component, given colours already connected.

    With ``sizes``, sets are only the prefixes of sets of these sizes. Pairs whose prefixes share as much as a link needs are
    then returned unverified: those that would connect something new (a forest), or all between different labels.
    """
    label = np.unique(colour, return_inverse=True)[1].astype(np.int64)
    n = np.array([len(t) for t in sets], np.int64) if sizes is None else sizes
    pairs: list[tuple[int, int]] = []
    order = np.lexsort((ids, n))
    lead = n + (-n * percent // 100) + 1
    size = np.where(n > 0, lead, 0)[order]
    token = np.concatenate([sets[i][:m] for i, m in zip(order.tolist(), size.tolist(), strict=True)]) if len(order) else np.zeros(0, U64)
    who = np.repeat(np.arange(len(order)), size)
    by = np.argsort(token, kind="stable")
    st, sw = token[by], who[by]
    new = np.flatnonzero(np.append(True, st[1:] != st[:-1])) if len(st) else np.zeros(0, np.int64)
    group = np.zeros(len(st), np.int64)
    group[new] = 1
    group = np.cumsum(group) - 1
    of = np.empty(len(st), np.int64)
    of[by] = group
    start, first = np.append(new, len(st)), np.concatenate([[0], np.cumsum(size)])
    rank = np.empty(len(st), np.int64)
    rank[by] = np.arange(len(st))
    members: dict[int, list[int]] = {}
    for i, own in enumerate(label.tolist()):
        members.setdefault(own, []).append(i)
    seen: dict[int, int] = {}  # labels of the documents gone through, with their numbers

    def join(i: int, j: int) -> None:
        """The smaller label's documents take the larger one's."""
        few, many = sorted((int(label[i]), int(label[j])), key=lambda k: len(members[k]))
        label[members[few]] = many
        members[many] += members.pop(few)
        if few in seen:
            seen[many] = seen.get(many, 0) + seen.pop(few)

    def links(i: int, j: int) -> bool:
        a, b = sets[i], sets[j]
        at = np.searchsorted(b, a)
        both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
        return 100 * both >= percent * (len(a) + len(b) - both)

    for x in range(len(order)):
        i = int(order[x])
        if not size[x]:
            continue
        if sizes is None:
            # among near copies one of the last few is enough; if that joins all so far, nothing is left to look for
            for j in order[max(0, x - RECENT) : x].tolist():
                if label[i] != label[j] and 100 * n[j] >= percent * n[i] > 0 and links(i, j):
                    join(i, j)
        seen[int(label[i])] = seen.get(int(label[i]), 0) + 1
        if len(seen) == 1:
            continue
        g, up = of[first[x] : first[x + 1]], rank[first[x] : first[x + 1]]
        count = up - start[g]
        busy = count > 0
        if not busy.any():
            continue
        near = sw[tc.ranges(start[g[busy]], count[busy])]
        near = near[label[order[near]] != label[i]]
        c = np.bincount(near, minlength=x)
        y = np.flatnonzero(c)
        j = order[y]
        need = -(-percent * (n[i] + n[j]) // (100 + percent))
        y = y[(100 * n[j] >= percent * n[i]) & (c[y] >= need - np.maximum(n[i] - lead[i], n[j] - lead[j]))]
        for j in order[y[np.argsort(-c[y], kind="stable")]].tolist():
            if label[i] == label[j]:
                continue
            if sizes is not None:
                pairs.append((i, j))
                if forest:
                    join(i, j)
            elif links(i, j):
                join(i, j)
    return label, pairs


def _verify(k: int, percent: int, classes: np.ndarray):
    """One candidate group that fits a cell: its texts to links."""

    def verify(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        sets = []
        for batch in table.select(["id", "text"]).to_batches():
            for _, buf, off, _ in tc.slices(batch.column(0), batch.column(1)):
                sets += ordered_sets(*shingles(buf, off, k), classes)
        label, _ = linked(ids, ids, sets, percent)
        low = np.full(int(label.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, label, ids)
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(low[label], pa.int64())], schema=LINK)

    return verify


def _propose(percent: int, forest: bool):
    """Pairs of one cell of prefixes that a link may join."""

    def propose(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        lead = [np.frombuffer(x.as_buffer(), U64) for chunk in table.column("lead").chunks for x in chunk]
        _, pairs = linked(ids, table.column("colour").to_numpy(), lead, percent, table.column("n").to_numpy(), forest)
        at = np.array(pairs, np.int64).reshape(-1, 2)
        return _link_table(ids[at[:, 0]], ids[at[:, 1]])

    return propose


def _compare(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return compare


def _wide_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links within groups too large for one cell: (component, blocks, block, id, tokens).

    Cells hold prefixes only, about a seventh of the sets. First a forest of proposed pairs is verified; then, between
    what is still apart, every proposed pair. A pair that links shares enough of its prefixes to be proposed, so no link
    between different components is missed.
    """
    n = (F.octet_length("tokens") / 8).cast("long")
    cut = F.least(n, n + F.floor(-n * percent / 100) + 1)
    parts = F.ceil(F.col("blocks") * ((100 - percent + 2) / 100)).cast("int")
    lead = sets.select("component", "id", n.alias("n"), F.substring("tokens", F.lit(1), (8 * cut).cast("int")).alias("lead"), parts.alias("parts"), (F.col("block") % parts).alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    cells = lead.select("*", other).select("component", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "n", "lead")
    tokens = sets.select(F.col("id").alias("__id"), "tokens")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        both = pairs.join(tokens, pairs["a"] == tokens["__id"]).select("a", "b", F.col("tokens").alias("s")).join(tokens, F.col("b") == F.col("__id")).select("a", "b", "s", "tokens")
        return written(both.mapInArrow(_compare(percent), "a long, b long"))

    key = ("component", "x", "y")
    first = verified(cells.withColumn("colour", F.col("id")).groupBy(*key).applyInArrow(_propose(percent, True), "a long, b long"))
    colours = connected_components(first).select(F.col("node").alias("__c"), F.col("component").alias("colour"))
    known = cells.join(colours, F.col("id") == F.col("__c"), "left").drop("__c").withColumn("colour", F.coalesce("colour", "id"))
    rest = verified(known.groupBy(*key).applyInArrow(_propose(percent, False), "a long, b long"))
    return first.unionByName(rest)


def _drawn(index: DataFrame, percent: int, last: bool, stars: DataFrame | None) -> tuple[DataFrame, list[int]]:
    """Stars of candidates by one drawing of the index, those known already included, and the single entries left to the next."""
    # entries are filed under a set's hash; the smallest id of equal sets stands for all of them
    bits = index.where("id is not null and n > 1").groupBy("n", "f1", "f2").agg(F.min(F.struct("id", F.col("entries").alias("bits"))).alias("d")).select("f1", "d.id", "n", "d.bits")
    left, heavy = F.col("bucket").isNotNull(), []
    for divisor in ROUNDS:
        met = index.where(left & (F.col("bucket") % divisor == 0)).select("bucket", "entries").groupBy("bucket").applyInArrow(_meet(percent), "bucket int, f long, shared binary")
        left = left & (F.col("bucket") % divisor != 0)
        coloured = bits.withColumn("colour", F.col("id")) if stars is None else bits.join(stars.select(F.col("a").alias("id"), F.col("b").alias("colour")), "id", "left").withColumn("colour", F.coalesce("colour", "id"))
        met = met.join(coloured, met["f"] == coloured["f1"]).select("bucket", "id", "n", "bits", "shared", "colour")
        near = written(met.groupBy("bucket").applyInArrow(_prune(percent, last), "a long, b long, sets long"))
        heavy += [(r["sets"], r["a"]) for r in near.where("sets is not null").orderBy(F.desc("sets"), "a").limit(TOLD).collect()]
        links = near.where("sets is null").select("a", "b")
        links = links if stars is None else links.unionByName(stars)
        stars = written(connected_components(links).select(F.col("node").alias("a"), F.col("component").alias("b")))
    return stars, [a for _, a in sorted(heavy, reverse=True)[:TOLD]]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, buckets: int | None = None) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row of docs with a non-null id.

    component_id is the smallest id reachable over links, a row's own id at least. Words are lower-cased (A-Z) runs
    of bytes outside white space; a text of fewer words than a shingle is one shingle. Null, empty and blank texts
    have no shingles and link with nothing. Rows with a null id are left out. Repeated ids: each row is returned,
    with the component of the id. Empty input: no rows. Other columns of docs are not read. Only percentages over 50
    are taken: two sets that link then share two shingles, which the index rests on.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100: below, sets that link need not share two shingles")
    spark = docs.sparkSession
    buckets = buckets or 2 * default_parallelism(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    classes = frequency_classes(source, shingle)
    told, stars = np.zeros(0, U64), None
    for drawing in range(1, DRAWN + 1):
        index = written(source.mapInArrow(_index(shingle, percent, buckets, classes, told), "bucket int, entries binary, id long, n long, f1 long, f2 long, lead long"))
        stars, heavy = _drawn(index, percent, drawing == DRAWN, stars)
        if not heavy:
            break
        told = np.union1d(told, np.array(heavy, U64))
    rows = index.where("id is not null").select("id", "n", "f1", "f2", "lead")
    groups = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    sizes = rows.groupBy("id").agg(F.max("n").alias("n"))
    total = groups.join(sizes, groups["node"] == sizes["id"]).groupBy("component").agg(F.ceil(F.sum("n") / CELL).cast("int").alias("blocks"))
    members = written(groups.join(total, "component").select(F.col("node").alias("id"), "component", "blocks", (F.xxhash64("node") % F.col("blocks") + F.col("blocks")).cast("int").alias("block")).withColumn("block", F.col("block") % F.col("blocks")))
    fit = members.where("blocks = 1").join(source, "id").select("component", "id", "text")
    links = [written(fit.groupBy("component").applyInArrow(_verify(shingle, percent, classes), "a long, b long"))]
    wide = members.where("blocks > 1")
    if wide.limit(1).count():
        sets = wide.join(source, "id").select("component", "blocks", "block", "id", "text").mapInArrow(_build(shingle, classes), "component long, blocks int, block int, id long, tokens binary")
        links.append(_wide_links(written(sets), percent))
    # equal sets: within a slice to the slice's first, only those to the first of all
    leads = rows.where("n > 0 and id = lead").select("id", "n", "f1", "f2")
    low = leads.groupBy("n", "f1", "f2").agg(F.min("id").alias("b"), F.count("*").alias("copies")).where("copies > 1")
    copies = leads.join(low, ["n", "f1", "f2"]).select(F.col("id").alias("a"), "b")
    every = copies.unionByName(rows.where("n > 0 and id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")))
    for x in links:
        every = every.unionByName(x)
    parts = connected_components(every)
    return rows.join(parts, rows["id"] == parts["node"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
