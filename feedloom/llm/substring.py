"""Substring dedup by recompression: repeated passages of at least ``window`` words keep one copy.

Method. Every text is a sequence of word hashes. Rounds of recompression name runs of equal symbols and pairs of
neighbouring symbols; a name is a 64-bit hash of what it stands for, so all tasks give the same name to the same thing,
and an exchange by name is where equal things meet. A round only joins symbols of at most ``limit`` words, and the
limits grow: whether a boundary survives is settled by so many words on either side as the limits add up to, so equal
passages show the same symbols in their interior, whatever surrounds them.

High symbols. After all rounds a symbol holds up to ``2 * HIGH[-1]`` words. Spans of SPAN neighbouring symbols (whole texts of
fewer) meet by their names in a first exchange; those that a smaller document holds too, verified by a second, independent
hash of all their words, are repeated as a whole, and with them every window inside. So long repeats cost a few
records for each hundred words.

Low symbols. The ends of long repeats, shorter ones, and text that occurs once are told apart by the symbols
of the first rounds. After them a boundary is settled by ``EDGE`` words. Each window elects the interior symbol of the smallest
name; consecutive windows with the same elected symbol form one record, keyed by that symbol and the words
within ``EDGE`` of it. Records meet by key in the same exchange, with a hash of all their words: a record that a smaller
document holds whole is repeated; one whose key no other document has is not. For those left, of several documents and different words, a second
exchange takes the windows' own hashes, without windows that are settled, and finds the smallest document of each. Equality rests on
128 bits, the key and a hash of the words. A window's smallest holder is never settled before, so nothing is lost.

Hot keys. A phrase that very many documents hold, each in other surroundings, gives one key to very many records. A slice that has
HOT of them sends one mark to the key's bucket and passes its records by; with a mark, all records of the key are compared, and
their windows are dealt by their own hashes. So neither exchange gathers what a hot key has.

Scale. One record stands for about 17 words. Copies within a slice of rows are settled before the first exchange, so a passage that stands
in a third of all documents is sent once per slice. A bucket's size follows from the data and spark.sql.shuffle.partitions. Texts
travel once, by id; only documents' own spans return to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as tc
from .common import column, default_parallelism, written
from .textcore import U64, mix

#: (kind, most words of a symbol that may be joined), in order.
ROUNDS = (("run", 2), ("pair", 1), ("pair", 1), ("pair", 2), ("pair", 2))
EDGE = sum(n for _, n in ROUNDS)
LONGEST = 2 * max(n for _, n in ROUNDS)
#: Limits of the later rounds: twice pairs and once runs of each.
HIGH = (4, 8, 16, 32)
HIGH_ROUNDS = (*ROUNDS, *((kind, n) for n in HIGH for kind in ("pair", "run", "pair")))
#: Bytes of text that a task works on at once, or one longer text.
SLICE = 1_000_000
#: Different records of one key in a slice from which the key counts as hot.
HOT = 16
#: Neighbouring high symbols that meet as one.
SPAN = 6
_SALT = tc._rng.integers(1, 2**63, (len(HIGH_ROUNDS), 3), dtype=np.int64).astype(U64) * U64(2) + U64(1)


def recompress(h: np.ndarray, bounds: np.ndarray, rounds: tuple[tuple[str, int], ...] = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Names and start positions of the symbols left after all rounds; no symbol crosses one of bounds."""
    name, start = h.copy(), np.arange(len(h))
    head = np.zeros(len(h) + 1, bool)
    head[bounds] = True
    head = head[:-1]
    for k, (kind, limit) in enumerate(rounds):
        if len(name) < 2:
            break
        length = np.diff(np.append(start, len(h)))
        keep = np.ones(len(name), bool)
        if kind == "pair":
            low = (name >> U64((7 * k + 3) % 61)) & U64(1) == 0
            fits = length <= limit
            at = np.flatnonzero(low[:-1] & fits[:-1] & ~low[1:] & fits[1:] & ~head[1:])
            name[at] = mix(name[at] * _SALT[k, 0] + name[at + 1] * _SALT[k, 1] + _SALT[k, 2])
            keep[at + 1] = False
        else:
            same = np.flatnonzero((name[1:] == name[:-1]) & ~head[1:]) + 1
            if len(same):
                new = np.flatnonzero(np.diff(same, prepend=-9) != 1)
                many = np.diff(np.append(new, len(same))) + 1
                first = same[new] - 1
                fits = many * length[first] <= limit
                first, many = first[fits], many[fits]
                name[first] = mix(name[first] * _SALT[k, 0] + many.astype(U64) * _SALT[k, 1] + _SALT[k, 2])
                keep[tc.ranges(first + 1, many - 1)] = False
        name, start, head = name[keep], start[keep], head[keep]
    return name, start


def spans(h: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Name, words' hash, first window and windows of each row's spans of SPAN high symbols, at least a window long."""
    name, start = recompress(h, bounds, HIGH_ROUNDS)
    first = np.searchsorted(start, bounds[:-1])
    end = np.searchsorted(start, bounds[1:])
    at = tc.ranges(first, np.where(end > first, np.maximum(end - first - SPAN + 1, 1), 0))
    to = np.minimum(at + SPAN, np.repeat(end, np.where(end > first, np.maximum(end - first - SPAN + 1, 1), 0)))
    begin, stop = start[at], np.append(start, len(h))[to]
    long = stop - begin >= window
    at, to, begin, stop = at[long], to[long], begin[long], stop[long]
    return tc.span(tc.prefix(name), at, to) ^ (to - at).astype(U64), tc.span(tc.prefix(h), begin, stop), begin, stop - begin - window + 1


def covered(doc: np.ndarray, at: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that overlap or touch, made one."""
    if not len(doc):
        return doc, at, windows
    order = np.lexsort((at, doc))
    doc, at, end = doc[order], at[order], (at + windows)[order]
    which = np.cumsum(np.append(0, doc[1:] != doc[:-1]))
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(which * wide + end) - which * wide
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (at[1:] > reach[:-1])))
    last = np.append(new[1:], len(doc)) - 1
    return doc[new], at[new], reach[last] - at[new]


def records(h: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Windows of each row in runs that share an elected symbol: key, hash of all words, first window and windows of each run."""
    n, none = len(h), np.zeros(0, np.int64)
    rows = np.diff(bounds)
    at = tc.ranges(bounds[:-1], np.maximum(rows - window + 1, 0))
    if not len(at):
        return none.astype(U64), none.astype(U64), none, none
    name, start = recompress(h, bounds)
    pre = tc.prefix(h)
    edge = np.zeros(n + 1, np.int64)
    edge[start] = 1
    edge[n] = 1
    seen = np.cumsum(edge)
    lo, hi = seen[at + EDGE - 1], seen[at + window - EDGE] - 2
    shift = U64(max(1, int(len(name)).bit_length()))
    table = [((name >> shift) << shift) | np.arange(len(name), dtype=U64)]
    width = 1
    while 2 * width <= int((hi - lo).max()) + 1:
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
        width *= 2
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    best = np.empty(len(at), U64)
    for k, t in enumerate(table):
        on = np.flatnonzero(level == k)
        best[on] = np.minimum(t[lo[on]], t[hi[on] - (1 << k) + 1])
    symbol = (best & ((U64(1) << shift) - U64(1))).astype(np.int64)
    new = np.flatnonzero((np.diff(symbol, prepend=-1) != 0) | (np.diff(at, prepend=-9) != 1))
    count = np.diff(np.append(new, len(at)))
    symbol = symbol[new]
    begin = start[symbol]
    end = np.append(start, n)[symbol + 1]
    key = mix(name[symbol] * BASE_A ^ tc.span(pre, begin - EDGE, end + EDGE))
    first = at[new]
    return key, tc.span(pre, first, first + count + window - 1) ^ count.astype(U64), first, count


BASE_A = U64(0xD6E8FEB86659FD93)


def repeated(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries have an equal hash under a smaller document."""
    out = np.zeros(len(h), bool)
    if len(h) > 1:
        order = np.argsort(h)
        s = h[order]
        new = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        count = np.diff(np.append(new, len(s)))
        d = doc[order]
        out[order] = d > np.repeat(np.minimum.reduceat(d, new), count)
    return out


def _joined(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of one document: document, first window, windows."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.flatnonzero((np.diff(doc, prepend=doc[:1] - 1) != 0) | (np.diff(at, prepend=-9) > 1)) if len(doc) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(doc)) - 1
    return doc[new], at[new], (at[last] - at[new] + 1 if len(doc) else at)


def _bytes(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(arrays[0])], np.int64).tobytes(), *(x.tobytes() for x in arrays)])


FOUND = pa.schema([("id", pa.int64()), ("at", pa.int32()), ("windows", pa.int32())])
SENT = pa.schema([("bucket", pa.int32()), ("spans", pa.binary()), ("records", pa.binary()), ("found", pa.binary()), ("passed", pa.binary())])
WINDOWS = pa.schema([("bucket", pa.int32()), ("records", pa.binary())])


def _by_bucket(key: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    bucket = (key % U64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    edge = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _elect(window: int, buckets: int):
    def elect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans of high symbols and records of low ones to buckets by name and key; of equal ones of a slice only the smallest document's."""
        for batch in batches:
            for ids, buf, off, _ in tc.slices(batch.column(0), batch.column(1), SLICE):
                start, end, bounds = tc.words(buf, off)
                h = tc.word_hashes(buf, start, end)
                rows: dict[int, list[bytes]] = {}
                found = []
                for kind, (name, words, first, size) in enumerate((spans(h, bounds, window), records(h, bounds, window))):
                    row = np.searchsorted(bounds, first, side="right") - 1
                    doc, local = ids[row], first - bounds[row]
                    gone = repeated(mix(name ^ mix(words)), doc)
                    found.append((doc[gone], local[gone], size[gone]))
                    name, words, doc, local, size = (x[~gone] for x in (name, words, doc, local, size))
                    if kind:
                        _, at, many = np.unique(name, return_inverse=True, return_counts=True)
                        hot = many[at] >= HOT
                        passed = _bytes(name[hot], doc[hot], local[hot].astype(np.int32), size[hot].astype(np.int32)) if hot.any() else b""
                        marks = np.unique(name[hot])
                        none = np.zeros(len(marks), np.int64)
                        name, words, doc, local, size = (np.append(x[~hot], y) for x, y in ((name, marks), (words, none.view(U64)), (doc, none), (local, none), (size, none)))
                    for k, i in _by_bucket(name, buckets):
                        rows.setdefault(k, [b"", b""])[kind] = _bytes(name[i], words[i], doc[i], local[i].astype(np.int32), size[i].astype(np.int32))
                known = covered(*map(np.concatenate, zip(*found, strict=True)))
                out = [(k, *r, b"", b"") for k, r in rows.items()]
                if len(known[0]) or passed:
                    out.append((int(mix(ids[:1].view(U64))[0] % U64(buckets)), b"", b"", _bytes(*known) if len(known[0]) else b"", passed))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), SENT.types, strict=True)], schema=SENT)

    return elect


JUDGED = pa.schema([("id", pa.int64()), ("at", pa.int32()), ("windows", pa.int32()), ("key", pa.int64()), ("spread", pa.bool_())])


def _opened(blobs: list[bytes]) -> list[np.ndarray]:
    cols: list[list[np.ndarray]] = [[], [], [], [], []]
    for x in blobs:
        if x:
            n = int(np.frombuffer(x, np.int64, 1)[0])
            for c, t, at in zip(cols, (U64, U64, np.int64, np.int32, np.int32), (8, 8 + 8 * n, 8 + 16 * n, 8 + 24 * n, 8 + 28 * n), strict=True):
                c.append(np.frombuffer(x, t, n, at))
    return [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(cols, (U64, U64, np.int64, np.int32, np.int32), strict=True)]


def _meet(table: pa.Table) -> pa.Table:
    """One bucket: runs of windows that are repeated (no key), and records whose windows are to be compared (with their key; a hot
    key's are spread)."""
    found, compared = [], []
    for x in table.column("passed").to_pylist():
        if x:
            n = int(np.frombuffer(x, np.int64, 1)[0])
            key, doc, local, size = (np.frombuffer(x, t, n, at) for t, at in ((np.int64, 8), (np.int64, 8 + 8 * n), (np.int32, 8 + 16 * n), (np.int32, 8 + 20 * n)))
            compared.append((doc, local, size, key, np.ones(n, bool)))
    for x in table.column("found").to_pylist():
        if x:
            n = int(np.frombuffer(x, np.int64, 1)[0])
            found.append(tuple(np.frombuffer(x, np.int64, n, 8 + 8 * n * k) for k in range(3)))
    for kind in ("spans", "records"):
        name, words, doc, local, size = _opened(table.column(kind).to_pylist())
        if not len(name):
            continue
        order = np.lexsort((doc, words, name))
        name, words, doc, local, size = (x[order] for x in (name, words, doc, local, size))
        head = np.append(True, name[1:] != name[:-1])
        equal = head | np.append(True, words[1:] != words[:-1])
        new = np.flatnonzero(equal)
        mark = size == 0
        gone = (doc > np.repeat(doc[new], np.diff(np.append(new, len(doc))))) & ~mark
        found.append((doc[gone], local[gone].astype(np.int64), size[gone].astype(np.int64)))
        if kind == "records":
            first = np.flatnonzero(head)
            many = np.diff(np.append(first, len(doc)))
            least, most = np.minimum.reduceat(doc, first), np.maximum.reduceat(np.where(gone, np.iinfo(np.int64).min, doc), first)
            hot = np.logical_or.reduceat(mark, first)
            on = np.repeat((np.add.reduceat(equal.astype(np.int64), first) > 1) & (least != most) | hot, many) & ~gone & ~mark
            compared.append((doc[on], local[on], size[on], name[on].view(np.int64), np.repeat(hot, many)[on]))
    runs = covered(*map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 3
    rest = [np.concatenate(c) for c in zip(*compared, strict=True)] if compared else [np.zeros(0, np.int64)] * 5
    columns = [pa.array(np.concatenate([a, b]).astype(t)) for a, b, t in zip(runs, rest, (np.int64, np.int32, np.int32), strict=False)]
    key, spread = pa.concat_arrays([pa.nulls(len(runs[0]), pa.int64()), pa.array(rest[3], pa.int64())]), np.append(np.zeros(len(runs[0]), bool), rest[4].astype(bool))
    return pa.Table.from_arrays([*columns, key, pa.array(spread)], schema=JUDGED)


def _settled(held: pa.ListArray, bounds: np.ndarray) -> np.ndarray:
    """Whether the window at each word of a slice is settled, by the rows' lists of (at, windows) in one number."""
    out = np.zeros(int(bounds[-1]) + 1, np.int32)
    row = np.repeat(np.arange(len(held)), pc.list_value_length(held).fill_null(0).to_numpy())
    run = held.flatten().to_numpy()
    at, end = bounds[row] + (run >> 32), bounds[row + 1]
    np.add.at(out, np.minimum(at, end), 1)
    np.add.at(out, np.minimum(at + (run & 0xFFFFFFFF), end), -1)
    return np.cumsum(out)[:-1] > 0


def _send(window: int, buckets: int, at_id: int, at_text: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows, their runs and their records to compare, to the hashes of those records' windows that aren't settled, by key."""
        for batch in batches:
            for ids, buf, off, at_row in tc.slices(batch.column(at_id).cast(pa.int64()), batch.column(at_text), SLICE):
                start, end, bounds = tc.words(buf, off)
                settled = _settled(batch.column(batch.num_columns - 2).slice(at_row, len(ids)), bounds)
                held = batch.column(batch.num_columns - 1).slice(at_row, len(ids))
                row = np.repeat(np.arange(len(ids)), pc.list_value_length(held).fill_null(0).to_numpy())
                local, count, key = (held.flatten().field(c).to_numpy() for c in ("at", "windows", "key"))
                spread = held.flatten().field("spread").to_numpy(zero_copy_only=False)
                inside = local.astype(np.int64) + count + window - 1 <= np.diff(bounds)[row]
                row, local, count, key = row[inside], local[inside].astype(np.int64), count[inside].astype(np.int64), key[inside].view(U64)
                spread = spread[inside]
                at, owner = tc.ranges(bounds[row] + local, count), np.repeat(np.arange(len(row)), count)
                at, owner = at[~settled[at]], owner[~settled[at]]
                if not len(at):
                    continue
                # a hot key's windows are records of their own
                new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(at, prepend=-9) != 1) | spread[owner])
                size, first, o = np.diff(np.append(new, len(at))), at[new], owner[new]
                whole = np.zeros(len(start), U64)
                whole[at] = tc.span(tc.prefix(tc.word_hashes(buf, start, end)), at, at + window)
                to = np.where(spread[o], whole[first], key[o])
                rows = [(k, _bytes(key[o[i]], ids[row[o[i]]], (first[i] - bounds[row[o[i]]]).astype(np.int32), size[i].astype(np.int32), whole[tc.ranges(first[i], size[i])])) for k, i in _by_bucket(to, buckets)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), WINDOWS.types, strict=True)], schema=WINDOWS)

    return send


def _settle(table: pa.Table) -> pa.Table:
    """One bucket: windows compared under equal keys, runs of repeated windows returned."""
    keys, docs, locs, counts, wholes = [], [], [], [], []
    for x in table.column("records").to_pylist():
        n = int(np.frombuffer(x, np.int64, 1)[0])
        keys.append(np.frombuffer(x, U64, n, 8))
        docs.append(np.frombuffer(x, np.int64, n, 8 + 8 * n))
        locs.append(np.frombuffer(x, np.int32, n, 8 + 16 * n))
        counts.append(np.frombuffer(x, np.int32, n, 8 + 20 * n))
        wholes.append(np.frombuffer(x, U64, -1, 8 + 24 * n))
    key, doc, loc, count, whole = map(np.concatenate, (keys, docs, locs, counts, wholes))
    owner = np.repeat(np.arange(len(key)), count)
    place = loc[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    order = np.lexsort((doc[owner], whole, key[owner]))
    k, w, d = key[owner][order], whole[order], doc[owner][order]
    new = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (w[1:] != w[:-1])))
    gone = order[d > np.repeat(d[new], np.diff(np.append(new, len(d))))]
    return pa.Table.from_arrays([pa.array(x.astype(t)) for x, t in zip(_joined(doc[owner[gone]], place[gone].astype(np.int64)), (np.int64, np.int32, np.int32), strict=True)], schema=FOUND)


def _cut(window: int, at_text: int, at_found: int, keep: list[int], schema: pa.Schema):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(at_found)
            n_words, n_removed, kept, spans = [], [], [], []
            texts = batch.column(at_text).cast(pa.binary())
            for i in range(batch.num_rows):
                w = (texts[i].as_py() or b"").split()
                n_words.append(len(w))
                f = found[i]
                runs: list[dict] = []
                if f.is_valid and len(w):
                    gone = np.zeros(len(w) + 1, np.int32)
                    run = f.values.to_numpy()
                    np.add.at(gone, np.minimum(run >> 32, len(w)), 1)
                    np.add.at(gone, np.minimum((run >> 32) + (run & 0xFFFFFFFF) + window - 1, len(w)), -1)
                    flag = np.cumsum(gone[:-1]) > 0
                    edge = np.flatnonzero(np.diff(flag.astype(np.int8), prepend=0, append=0))
                    parts, to = [], 0
                    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        parts += w[to:a]
                        to = b
                        runs.append({"at": a, "words": b - a})
                    w = parts + w[to:]
                n_removed.append(n_words[-1] - len(w))
                kept.append(b" ".join(w))
                spans.append(runs)
            new = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, schema.field("removed_spans").type), pa.array(kept, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *new], names=schema.names)

    return cut


OUTPUT = (T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_spans", T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("words", T.IntegerType())]))), T.StructField("kept_text", T.StringType()))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, buckets: int | None = None) -> DataFrame:
    """All rows of docs with n_words, n_removed, removed_spans (word positions) and kept_text.

    A word goes if a window of ``window`` consecutive words that covers it also starts in a document with a
    smaller id; windows are judged on the input. kept_text joins the other words by one space.

    Null text: no words, kept_text empty. Null id: the row takes no part and loses nothing. Repeated ids count
    as one document; should their texts differ, what goes from one goes from the same places of the others. Repeats inside one document stay. Texts shorter than the window stay (white space is still
    made single). Bytes that are no UTF-8 are words like others. Empty input: no rows. Input columns of the four output names, in any case, are replaced; others pass through.
    """
    if window < 2 * EDGE + 2 * LONGEST - 1:
        raise ValueError(f"window must be at least {2 * EDGE + 2 * LONGEST - 1} words")
    parts = default_parallelism(docs.sparkSession)
    buckets = buckets or 2 * parts
    ours = {f.name for f in OUTPUT}
    held = [c for c in docs.columns if c.lower() not in ours or c in (id_col, text_col)]
    inside = [f"__{k}" for k in range(len(held))]
    at_id, at_text, extra = held.index(id_col), held.index(text_col), len(held)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    met = source.mapInArrow(_elect(window, buckets), "bucket int, spans binary, records binary, found binary, passed binary").groupBy("bucket").applyInArrow(_meet, "id long, at int, windows int, key long, spread boolean")
    judged = written(met)
    # both joins take the rows by id from one and the same exchange: its key is never null, so that neither join filters before it, and both take all columns
    key = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("__key")
    base = docs.select(*[column(c).alias(i) for c, i in zip(held, inside, strict=True)], key).withColumn(inside[at_text], F.col(inside[at_text]).cast("string")).repartition(parts, "__key")
    run, record = F.when(F.col("key").isNull(), F.expr("shiftleft(cast(at as bigint), 32) + windows")), F.when(F.col("key").isNotNull(), F.struct("at", "windows", "key", "spread"))
    own = judged.groupBy("id").agg(F.collect_list(run).alias("__runs"), F.collect_list(record).alias("__records")).where(F.size("__records") > 0)
    compared = base.join(own.select(F.col("id").cast("string").alias("__key"), "__runs", "__records"), "__key")
    low = compared.select(*inside, "__runs", "__records").mapInArrow(_send(window, buckets, at_id, at_text), "bucket int, records binary").groupBy("bucket").applyInArrow(_settle, "id long, at int, windows int")
    found = judged.where("key is null").select("id", "at", "windows").unionByName(low)
    found = found.groupBy("id").agg(F.collect_list(F.expr("shiftleft(cast(at as bigint), 32) + windows")).alias("__found")).select(F.col("id").cast("string").alias("__key"), "__found")
    joined = base.join(found, "__key", "left").select(*[F.col(i) for i in inside], "__found")
    keep = [k for k, c in enumerate(held) if c.lower() not in ours]
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([*(T.StructField(held[k], docs.schema[held[k]].dataType) for k in keep), *OUTPUT])
    return joined.mapInArrow(_cut(window, at_text, extra, keep, to_arrow_schema(out)), out)
