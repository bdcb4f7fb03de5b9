"""Language-model scoring by prediction by partial matching over bytes.

Training counts every symbol after every context of ``ORDER`` bytes; shorter contexts are its sums. The trie is scored
by PPM: a symbol seen in the longest context has probability (2 count - 1) / 2n; an escape, distinct / 2n (count / n and
no escape where all symbols were seen), leads to the next shorter context, where symbols seen in the longer one are excluded; what no context has
seen is uniform over the symbols left. Byte 0xFF, which UTF-8 doesn't use, stands before and after every text.

The trie lies in the shared folder, in parts by the last two bytes of a context, so that a part holds a context's own
shorter contexts down to two bytes; the counts after one byte, a table of fixed size, go to every task. A part works
out the probability of whatever is asked of it. The grams (context and symbol) that are used most are asked once, and
their answers go to every task: a cache of bounded size. What a document holds beyond it is sent to the parts,
which send the document its sum. The unigram baseline works alike: words are counted in parts by hash, the most
frequent ones' counts are cached, and the others of a document meet the counts in their part. So every gram and every
word counts, whatever its frequency; the cache only decides where, and keeps frequent ones out of the exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import default_parallelism, written
from .textcore import U64, mix

ORDER = 5
#: Grams and words whose answers every task holds, at most; all others are met in their parts.
CACHED = 1 << 19
#: Bytes of text that a task works on at once, or one longer text.
SLICE = 1_000_000
#: Different grams or words that a task holds before it passes its counts on.
HELD = 4_000_000
EDGE = 255
_END = mix(np.array([0x5EED0FE0D], U64))[0]
GRAMS, WORDS = 0, 1
#: Steps in which counts are told apart when the cache's least count is sought: a quarter of a doubling.
_STEPS = 4


def _grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol of every predicted symbol (a text's bytes and the edge that ends it) as one number, and its row."""
    n = len(off) - 1
    s = np.full(len(buf) + ORDER * (n + 1), EDGE, np.uint8)
    s[np.arange(len(buf)) + np.repeat(ORDER * np.arange(1, n + 1), np.diff(off))] = buf
    row = np.repeat(np.arange(n), np.diff(off) + 1)
    at = tc.ranges(off[:-1] + ORDER * np.arange(1, n + 1), np.diff(off) + 1)
    w = s.astype(U64)
    whole = w[: len(s) - ORDER].copy()
    for k in range(1, ORDER + 1):
        whole = (whole << U64(8)) | w[k : len(s) - ORDER + k]
    return whole[at - ORDER], row


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every lower-cased word and every text's end."""
    low = tc.LOWER[buf]
    start, end, bounds = tc.words(low, off)
    n = len(off) - 1
    return np.append(tc.word_hashes(low, start, end), np.full(n, _END)), np.append(np.repeat(np.arange(n), np.diff(bounds)), np.arange(n))


def _tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[new], (np.add.reduceat(counts[order], new) if len(k) else counts)


def _different(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    new = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[new], np.diff(np.append(new, len(x)))


def _part(kind: int, keys: np.ndarray, parts: int) -> np.ndarray:
    """Grams by the last two bytes of their context, words by hash."""
    return (mix((keys >> U64(8)) & U64(0xFFFF) if kind == GRAMS else keys ^ U64(0x5BF03635)) % U64(parts)).astype(np.int32)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes: all first bytes of the values, then all second ones, and so on, compressed."""
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() for x in arrays]
    raw = b"".join(planes)
    return np.array([len(arrays[0]), len(raw)], np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, *types: type) -> list[np.ndarray]:
    n, size = np.frombuffer(blob, np.int64, 2).tolist()
    raw, at, out = pa.decompress(blob[16:], decompressed_size=size, codec="zstd", asbytes=True), 0, []
    for t in types:
        width = np.dtype(t).itemsize
        out.append(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T.copy().view(t).reshape(n))
        at += n * width
    return out


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    edge = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order))
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield int(part[order[a]]), order[a:b]


COUNTED = "kind int, part int, counts binary"


def _count(parts: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: (np.zeros(0, U64), np.zeros(0, np.int64)) for k in (GRAMS, WORDS)}
        fresh: dict[int, list] = {GRAMS: [], WORDS: []}

        def merged(kind: int) -> None:
            held[kind] = _tally(*(np.concatenate(x) for x in zip(held[kind], *fresh[kind], strict=True)))
            fresh[kind] = []

        def passed(kind: int) -> pa.RecordBatch:
            merged(kind)
            keys, counts = held[kind]
            held[kind] = np.zeros(0, U64), np.zeros(0, np.int64)
            rows = [(p, _packed(keys[i], counts[i])) for p, i in _by_part(_part(kind, keys, parts))]
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["kind", "part", "counts"])

        for batch in batches:
            for _, buf, off, _ in tc.slices(batch.column(0), batch.column(1), SLICE):
                for kind, found in ((GRAMS, _grams(buf, off)[0]), (WORDS, _words(buf, off)[0])):
                    fresh[kind].append(_different(found))
                    if sum(len(k) for k, _ in fresh[kind]) > max(500_000, len(held[kind][0])):
                        merged(kind)
                    if len(held[kind][0]) > HELD:
                        yield passed(kind)
        for kind in held:
            yield passed(kind)

    return count


MODEL = "kind int, part int, counts binary, shortest binary, sizes binary, tokens long, kinds long"


def _merge(table: pa.Table) -> pa.Table:
    """One part: its counts, their sums after one byte, and how many of them are of each size."""
    keys, counts = (np.concatenate(x) for x in zip(*(_unpacked(b, U64, np.int64) for b in table.column("counts").to_pylist()), strict=True))
    keys, counts = _tally(keys, counts)
    kind = table.column("kind")[0].as_py()
    short = np.zeros(0, np.int64)
    if kind == GRAMS:
        short = np.bincount((keys & U64(0xFFFF)).astype(np.int64), weights=counts, minlength=65_536).astype(np.int64)
    sizes = np.bincount((np.log2(counts) * _STEPS).astype(np.int64), minlength=1)
    values = [kind, table.column("part")[0].as_py(), _packed(keys, counts), _packed(short), _packed(sizes), int(counts.sum()), len(keys)]
    return pa.table([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in MODEL.split(", ")])


def trained(texts: DataFrame, parts: int) -> DataFrame:
    """The parts of the trie and of the word counts of (id, text), in the shared folder."""
    return written(texts.mapInArrow(_count(parts), COUNTED).groupBy("kind", "part").applyInArrow(_merge, MODEL))


def summary(model: DataFrame) -> tuple[np.ndarray, dict[int, int], int, int]:
    """Counts after each context of one byte, the cache's least count step of grams and of words, all tokens, different words."""
    shortest, sizes, tokens, kinds = np.zeros(65_536, np.int64), {GRAMS: np.zeros(64 * _STEPS, np.int64), WORDS: np.zeros(64 * _STEPS, np.int64)}, 0, 0
    for r in model.select("kind", "shortest", "sizes", "tokens", "kinds").toLocalIterator():
        (size,) = _unpacked(r["sizes"], np.int64)
        sizes[r["kind"]][: len(size)] += size
        if r["kind"] == GRAMS:
            shortest += _unpacked(r["shortest"], np.int64)[0]
        else:
            tokens, kinds = tokens + r["tokens"], kinds + r["kinds"]
    least = {k: int(np.searchsorted(np.cumsum(v[::-1]), CACHED, side="right")) for k, v in sizes.items()}
    return shortest.reshape(256, 256), {k: 64 * _STEPS - v for k, v in least.items()}, tokens, kinds


def _blend(levels: list[np.ndarray]) -> np.ndarray:
    """log10 probabilities of rows of counts: those of the longest context, then of each shorter one."""
    shape = levels[0].shape
    out, escape, left = np.zeros(shape), np.zeros((shape[0], 1)), np.ones(shape, bool)
    for c in levels:
        c = np.where(left, c, 0)
        n, d = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
        total = np.maximum(2 * n, 1)
        left &= c <= 0
        rest = left.any(axis=1, keepdims=True)
        # a context that has seen every symbol never escapes, an unseen one always does
        out = np.where(c > 0, escape + np.log10(np.maximum(2 * c - rest, 1) / total), out)
        escape = escape + np.where((n > 0) & rest, np.log10(np.maximum(d, 1) / total), 0)
    return np.where(left, escape - np.log10(np.maximum(left.sum(axis=1, keepdims=True), 1)), out)


class Part:
    """The contexts of a part: counts by context and symbol for each length down to two bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, shortest: np.ndarray) -> None:
        self.levels = [(keys, counts)]
        for k in range(ORDER - 1, 1, -1):
            keys, counts = _tally(keys & U64((1 << (8 * k + 8)) - 1), counts)
            self.levels.append((keys, counts))
        self.shortest = shortest.astype(np.float64)

    def rows(self, context: np.ndarray) -> np.ndarray:
        """log10 probabilities of all symbols after each context."""
        counts = []
        for k, (keys, n) in zip(range(ORDER, 1, -1), self.levels, strict=True):
            c = context & U64((1 << (8 * k)) - 1)
            a, b = np.searchsorted(keys, c << U64(8)), np.searchsorted(keys, (c << U64(8)) | U64(255), side="right")
            at, m = tc.ranges(a, b - a), np.zeros((len(context), 256))
            m[np.repeat(np.arange(len(context)), b - a), (keys[at] & U64(255)).astype(np.int64)] = n[at]
            counts.append(m)
        one = self.shortest[(context & U64(255)).astype(np.int64)]
        return _blend([*counts, one, np.broadcast_to(self.shortest.sum(axis=0), one.shape)])

    def log(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's symbol after its context; grams are in order."""
        out, context = np.empty(len(grams)), grams >> U64(8)
        some = np.unique(context)
        for lo in range(0, len(some), 1024):
            c = some[lo : lo + 1024]
            a, b = np.searchsorted(context, c[0]), np.searchsorted(context, c[-1], side="right")
            out[a:b] = self.rows(c)[np.searchsorted(c, context[a:b]), (grams[a:b] & U64(255)).astype(np.int64)]
        return out


def _frequent(shortest: np.ndarray, least: dict[int, int]):
    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = _unpacked(blob, U64, np.int64)
                on = (np.log2(counts) * _STEPS).astype(np.int64) >= least[kind]
                value = Part(keys, counts, shortest).log(keys[on]) if kind == GRAMS else counts[on].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([_packed(keys[on], value)], pa.binary())], names=["kind", "answers"])

    return frequent


class Cache:
    """Values by 64-bit key in two tables of one entry a place; keys that find neither free are left out."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.shift = U64(64 - max(4, int(2 * max(len(keys), 1)).bit_length()))
        self.tables = []
        for salt in (U64(0x8CB92BA72F3D8DD7), U64(0xE7037ED1A0B428DB)):
            size = 1 << (64 - int(self.shift))
            at = self._place(keys, salt)
            own, held, value = np.full(size, -1, np.int64), np.zeros(size, U64), np.zeros(size)
            own[at] = np.arange(len(keys))
            used = own >= 0
            held[used], value[used] = keys[own[used]], values[own[used]]
            self.tables.append((salt, used, held, value))
            lost = own[at] != np.arange(len(keys))
            keys, values = keys[lost], values[lost]

    def _place(self, keys: np.ndarray, salt: np.uint64) -> np.ndarray:
        return ((keys ^ (keys >> U64(29))) * salt >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys are held; 0 for the others."""
        (salt, used, held, value), second = self.tables
        at = self._place(keys, salt)
        hit = used[at] & (held[at] == keys)
        out = np.where(hit, value[at], 0)
        rest = np.flatnonzero(~hit)
        salt, used, held, value = second
        at = self._place(keys[rest], salt)
        on = used[at] & (held[at] == keys[rest])
        out[rest[on]] = value[at[on]]
        hit[rest[on]] = True
        return out, hit


_caches: dict[tuple[int, ...], list[Cache]] = {}
SCORED = "uid long, id long, held_out boolean, n_tokens long, n_known long, base double, score double, kind int, part int, asked binary"
_TYPES = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.binary())


def _score(answers: list[tuple[np.ndarray, np.ndarray]], mark: tuple[int, ...], parts: int):
    names = [x.split()[0] for x in SCORED.split(", ")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with what the cache answers, and rows of what is asked of the parts."""
        uid = TaskContext.get().partitionId() << 40
        if mark not in _caches:
            _caches.clear()
            _caches[mark] = [Cache(*a) for a in answers]
        for batch in batches:
            for ids, buf, off, at in tc.slices(batch.column(0), batch.column(1), SLICE):
                n = len(ids)
                asked = []
                sums = []
                for kind, (keys, row) in ((GRAMS, _grams(buf, off)), (WORDS, _words(buf, off))):
                    value, hit = _caches[mark][kind].get(keys)
                    if kind == WORDS:
                        known = np.bincount(row, weights=value > 0, minlength=n).astype(np.int64)
                        tokens = np.bincount(row, minlength=n).astype(np.int64)
                        value = np.log10(value + 1)
                    sums.append(np.bincount(row, weights=value, minlength=n))
                    rest = np.flatnonzero(~hit)
                    k, r = keys[rest], row[rest]
                    order = np.lexsort((r, k))
                    k, r = k[order], r[order]
                    new = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (r[1:] != r[:-1]))) if len(k) else np.zeros(0, np.int64)
                    count = np.diff(np.append(new, len(k)))
                    k, r = k[new], r[new]
                    asked += [(kind, p, _packed(k[i], uid + r[i], count[i].astype(np.int32))) for p, i in _by_part(_part(kind, k, parts))]
                part = batch.slice(at, n)
                m = len(asked)
                none = [None] * m
                columns = [[*range(uid, uid + n), *none], [*ids.tolist(), *none], [*part.column(2).to_pylist(), *none], [*tokens.tolist(), *none], [*known.tolist(), *none], [*sums[1].tolist(), *none], [*sums[0].tolist(), *none]]
                columns += [[*[None] * n, *(x[k] for x in asked)] for k in range(3)]
                uid += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=names)

    return score


SUMS = "part int, sums binary"


def _answer(shortest: np.ndarray, parts: int):
    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        """What documents asked of one part: their sums, to parts by document."""
        rows: list[tuple[int, bytes]] = []
        if asked.num_rows:
            kind = asked.column("kind")[0].as_py()
            key, uid, count = (np.concatenate(x) for x in zip(*(_unpacked(b, U64, np.int64, np.int32) for b in asked.column("asked").to_pylist()), strict=True))
            keys, counts = _unpacked(held.column("counts")[0].as_py(), U64, np.int64) if held.num_rows else (np.zeros(0, U64), np.zeros(0, np.int64))
            some, at = np.unique(key, return_inverse=True)
            if kind == GRAMS:
                value, known = Part(keys, counts, shortest).log(some), np.zeros(len(some))
            else:
                place = np.minimum(np.searchsorted(keys, some), max(len(keys) - 1, 0))
                c = np.where(keys[place] == some, counts[place], 0) if len(keys) else np.zeros(len(some))
                value, known = np.log10(c + 1.0), c > 0
            who, of = np.unique(uid, return_inverse=True)
            total, seen = (np.bincount(of, weights=count * v[at], minlength=len(who)) for v in (value, known))
            to = (mix(who.astype(U64)) % U64(parts)).astype(np.int32)
            kinds = np.full(len(who), kind, np.int8)
            rows = [(p, _packed(who[i], kinds[i], total[i], seen[i].astype(np.int64))) for p, i in _by_part(to)]
        return pa.table([pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["part", "sums"])

    return answer


def _gather(table: pa.Table) -> pa.Table:
    uid, kind, total, seen = (np.concatenate(x) for x in zip(*(_unpacked(b, np.int64, np.int8, np.float64, np.int64) for b in table.column("sums").to_pylist()), strict=True))
    order = np.lexsort((total, kind, uid))
    uid, kind, total, seen = uid[order], kind[order], total[order], seen[order]
    who, at = np.unique(uid, return_inverse=True)
    sums = [np.bincount(at, weights=np.where(kind == k, total, 0), minlength=len(who)) for k in (GRAMS, WORDS)]
    return pa.table({"uid": who, "more_score": sums[0], "more_base": sums[1], "more_known": np.bincount(at, weights=seen, minlength=len(who)).astype(np.int64)})


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row with a non-null id.

    Learns from rows where held_out is not true. Null text: empty, its end still a token. Words are lower-cased (A-Z) for
    the baseline; the byte model scores texts as they are. Every row is scored for itself, also where ids repeat.
    Bytes 0xFF of invalid UTF-8 count as the edge. Nothing to learn from: uniform bytes and add-one counts. Empty input: no
    rows. Other columns of docs are not read.
    """
    parts = buckets or default_parallelism(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out")).where("id is not null")
    model = trained(source.where("not held_out").select("id", "text"), parts)
    shortest, least, tokens, kinds = summary(model)
    answers = [[(np.zeros(0, U64), np.zeros(0))], [(np.zeros(0, U64), np.zeros(0))]]
    for r in model.select("kind", "counts").mapInArrow(_frequent(shortest, least), "kind int, answers binary").collect():
        answers[r["kind"]].append(tuple(_unpacked(r["answers"], U64, np.float64)))
    cached = [tuple(np.concatenate(x) for x in zip(*a, strict=True)) for a in answers]
    mark = tuple(hash(x.tobytes()) for a in cached for x in a)
    scored = written(source.mapInArrow(_score(cached, mark, parts), SCORED))
    asked = scored.where("asked is not null").select("kind", "part", "asked")
    met = asked.groupBy("kind", "part").cogroup(model.select("kind", "part", "counts").groupBy("kind", "part")).applyInArrow(_answer(shortest, parts), SUMS)
    more = met.groupBy("part").applyInArrow(_gather, "uid long, more_score double, more_base double, more_known long")
    out = scored.where("uid is not null").drop("kind", "part", "asked").join(more, "uid", "left")
    plus = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(tokens + kinds + 1)))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", plus("n_known", "more_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), plus("score", "more_score"))
