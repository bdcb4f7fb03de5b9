"""Suffix dedup by merging shard Burrows-Wheeler transforms: repeated strings of ``length`` bytes keep one copy.

A document's suffixes are dealt out so that those that are equal in their first ``length`` bytes meet: each elects the ``GRAM``-byte
string in it with the smallest hash, and goes to that string's bucket; neighbours that elect one string at one place
travel as one piece of text. Hashes of elected strings and pieces go first. Pieces that a smaller document holds whole are
found by them, and text follows only for strings that different pieces of several documents elect.

Each slice of rows is a shard. It sorts the suffixes of its pieces once and sends their transform: the byte before each
suffix, in suffix order; the text itself is not sent. A bucket merges the shards' transforms as Holt and McMillan do: the entries of
all shards start interleaved in any order, each shard's in its own; a round goes through the interleave and puts every entry's
predecessor behind those of its byte. After k rounds the interleave is sorted by the first k bytes, the entries of a shard still
stand in its own order, and a border between neighbours has appeared in the round of their common prefix. No suffixes are compared or sorted
anew. An interval of one document is done and leaves the interleave. The rounds stop at ``length`` bytes, where the intervals left
are the repeated strings; walking each transform back from the ends of its pieces says which suffix an entry is.

Scale. Texts travel once by id, some bytes for each piece, and the transforms, compressed. Equal pieces of one slice are
settled before the shuffle, so a passage in a third of all documents is sent once per slice. Buckets follow
spark.sql.shuffle.partitions.
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
from .substring import FOUND, _bytes, _joined, repeated
from .textcore import U64, mix

GRAM = 20
_SLICE = 1_000_000
_TABLE = tc._BYTE


def _prefix(buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(_TABLE[buf] * tc.powers(tc.BASE, len(buf)), out=out[1:])
    return out


def pieces(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Elected string's hash, its start, first suffix and suffixes of each piece, and the text's prefix hashes."""
    none = np.zeros(0, np.int64)
    at = tc.ranges(off[:-1], np.maximum(np.diff(off) - length + 1, 0))
    if not len(at):
        return none.astype(U64), none, none, none, none.astype(U64)
    pre = _prefix(buf)
    n = len(buf) - GRAM + 1
    gram = mix((pre[GRAM:] - pre[:-GRAM]) * tc.powers(tc.INVERSE, len(pre))[:n])
    shift = U64(max(1, n.bit_length()))
    low = ((gram >> shift) << shift) | np.arange(n, dtype=U64)
    span, width = length - GRAM + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    place = (low[at] & ((U64(1) << shift) - U64(1))).astype(np.int64)
    new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(at, prepend=-9) != 1))
    return gram[place[new]], place[new], at[new], np.diff(np.append(new, len(at))), pre


KEYS = pa.schema([("bucket", pa.int32()), ("size", pa.int64()), ("keys", pa.binary()), ("found", pa.binary())])
SENT = pa.schema([("bucket", pa.int32()), ("size", pa.int64()), ("pieces", pa.binary())])
FLAG = pa.schema([("id", pa.int64()), ("at", pa.int32()), ("windows", pa.int16()), ("lead", pa.int16())])
#: Bytes of an elected string's hash that its bucket sees; equal ones of different strings only send text in vain.
_KEY_BYTES = 5


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on; small values leave planes of zeros."""
    return x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def _unplane(b: bytes, dtype: type, n: int, at: int) -> tuple[np.ndarray, int]:
    width = np.dtype(dtype).itemsize
    return np.frombuffer(b, np.uint8, n * width, at).reshape(width, n).T.copy().view(dtype).reshape(n), at + n * width


def _packed(key: np.ndarray, whole: np.ndarray, doc: np.ndarray, local: np.ndarray, count: np.ndarray, lead: np.ndarray) -> bytes:
    new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    runs = np.diff(np.append(new, len(doc))).astype(np.int32)
    tops = np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)[:, 8 - _KEY_BYTES :].tobytes()
    return np.array([len(doc), len(new)], np.int64).tobytes() + b"".join((_planes(doc[new]), _planes(runs), _planes(local.astype(np.int32)), _planes(count.astype(np.int16)), _planes(lead.astype(np.int16)), whole.tobytes(), tops))


def _unpacked(b: bytes) -> tuple[np.ndarray, ...]:
    n, m = np.frombuffer(b, np.int64, 2).tolist()
    doc, at = _unplane(b, np.int64, m, 16)
    runs, at = _unplane(b, np.int32, m, at)
    local, at = _unplane(b, np.int32, n, at)
    count, at = _unplane(b, np.int16, n, at)
    lead, at = _unplane(b, np.int16, n, at)
    whole = np.frombuffer(b, U64, n, at)
    at += 8 * n
    key = np.zeros((n, 8), np.uint8)
    key[:, 8 - _KEY_BYTES :] = np.frombuffer(b, np.uint8, n * _KEY_BYTES, at).reshape(n, _KEY_BYTES)
    return key.view(U64).reshape(n), whole, np.repeat(doc, runs), local, count, lead


def _by_bucket(key: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    bucket = (key % U64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    edge = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _row(bucket: int, raw: bytes) -> tuple[int, int, bytes, bytes]:
    return bucket, len(raw), pa.compress(raw, codec="zstd", asbytes=True), b""


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _elect(length: int, buckets: int):
    """Texts to their pieces' keys and places; pieces that an earlier document of the slice holds whole are found."""

    def elect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, buf, off, _ in tc.slices(batch.column(0), batch.column(1), _SLICE):
                key, place, first, count, pre = pieces(buf, off, length)
                if not len(key):
                    continue
                row = np.searchsorted(off, first, side="right") - 1
                doc, local, lead = ids[row], first - off[row], place - first
                whole = mix(tc.span(pre, first, first + count + length - 1) ^ (count.astype(U64) << U64(32)) ^ lead.astype(U64))
                gone = repeated(whole, doc)
                found = _bytes(doc[gone], local[gone], count[gone]) if gone.any() else b""
                key, whole, doc, local, count, lead = (x[~gone] for x in (key, whole, doc, local, count, lead))
                rows = [_row(k, _packed(key[i], whole[i], doc[i], local[i], count[i], lead[i])) for k, i in _by_bucket(key, buckets)]
                if found:
                    rows.append((int(ids[0]) % buckets, 0, b"", found))
                yield _batch(rows, KEYS)

    return elect


def _flag(table: pa.Table) -> pa.Table:
    """One bucket of keys: pieces that a smaller document holds whole or that were found before (lead -1), and those to be merged:
    of strings that several documents elect in different pieces."""
    out = [(d, a, c, np.full(len(d), -1)) for d, a, c in _known(table)]
    blobs = [pa.decompress(x, decompressed_size=n, codec="zstd", asbytes=True) for n, x in zip(table.column("size").to_pylist(), table.column("keys").to_pylist(), strict=True) if n]
    if blobs:
        key, whole, doc, *rest = (np.concatenate(c) for c in zip(*map(_unpacked, blobs), strict=True))
        order = np.lexsort((doc, whole, key))
        k, w, d = key[order], whole[order], doc[order]
        head = np.append(True, k[1:] != k[:-1])
        first_of = head | np.append(True, w[1:] != w[:-1])
        piece = np.flatnonzero(first_of)
        gone = d != np.repeat(d[piece], np.diff(np.append(piece, len(d))))
        new = np.flatnonzero(head)
        size = np.diff(np.append(new, len(d)))
        kinds = np.add.reduceat(first_of.astype(np.int64), new)
        low = np.minimum.reduceat(d, new), np.maximum.reduceat(np.where(gone, np.iinfo(np.int64).min, d), new)
        several = np.repeat((kinds > 1) & (low[0] != low[1]), size) & ~gone
        for on, known in ((order[gone], True), (order[several], False)):
            place, count, lead = (c[on] for c in rest)
            out.append((doc[on], place, count, np.full(len(on), -1) if known else lead))
    if not out:
        return FLAG.empty_table()
    return pa.Table.from_arrays([pa.array(np.concatenate(c), t, safe=False) for c, t in zip(zip(*out, strict=True), FLAG.types, strict=True)], schema=FLAG)


def transforms(text: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transforms of the pieces of each group, one after another, and where each piece's group begins.

    text holds the pieces, of ``size`` bytes each, one after another, groups in order. Each piece ends with a mark of its own, smaller than
    all bytes and in the pieces' order. A transform holds the byte before each suffix in suffix order, plus one; 0 where a piece begins.
    """
    m, n = len(size), len(text) + len(size)
    end = np.cumsum(size + 1) - 1
    inside = np.ones(n, bool)
    inside[end] = False
    symbol = np.zeros(n, np.int64)
    symbol[inside] = text.astype(np.int64) + 1
    owner = np.repeat(group, size + 1)
    rank = np.where(inside, symbol + m, 0)
    rank[end] = np.arange(m)
    rank += owner * (m + 258)
    width, longest = 1, int(size.max()) + 1
    while True:
        order = np.argsort(rank)
        r = rank[order]
        dense = np.cumsum(np.append(True, r[1:] != r[:-1])) - 1
        rank = np.empty(n, np.int64)
        rank[order] = dense
        if width >= longest or dense[-1] == n - 1:
            break
        # beyond a piece's mark nothing counts: what holds the mark is already apart from all others
        rank = rank * n + rank[np.minimum(np.arange(n) + width, n - 1)]
        width *= 2
    before = np.zeros(n, np.uint16)
    before[1:] = symbol[:-1]
    out = np.empty(n, np.uint16)
    out[rank] = before
    first = np.concatenate([[0], np.cumsum(np.bincount(group, weights=size + 1, minlength=int(group[-1]) + 1))]).astype(np.int64)
    return out, first


def merged(shards: list[tuple[np.ndarray, np.ndarray]], owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes whose first ``length`` bytes several owners' pieces hold, in the merged order, and the interval of each.

    shards: transform and sizes of its pieces; owner: whose each piece is. Suffixes are numbered shard by shard, piece by piece,
    from the first to the mark at the end. Only the transforms are read. An interval of one owner has no repeat, whatever
    comes later; it drops out of the interleave, as do the entries before it, so a round goes through what is still open.
    """
    bwt = np.concatenate([x for x, _ in shards])
    n, sizes = len(bwt), np.concatenate([x for _, x in shards]).astype(np.int64)
    pieces, many = np.array([len(x) for _, x in shards]), np.array([len(x) for x, _ in shards])
    base = np.cumsum(many) - many
    shard = np.repeat(np.arange(len(shards)), many)
    # where each entry's predecessor stands in its own shard: bytes in order, equal ones as they come, after the marks
    by = np.argsort(bwt, kind="stable")
    by = by[np.argsort(shard[by].astype(np.uint16) if len(shards) < 65_536 else shard[by], kind="stable")]
    by = by[bwt[by] > 0]
    back = np.full(n, -1, np.int32 if n < 2**31 else np.int64)
    back[by] = tc.ranges(base + pieces, many - pieces)
    # which suffix an entry is, and whose: back from every piece's mark
    suffix, whose, enters = np.empty(n, back.dtype), np.empty(n, np.int32), np.zeros(n, bool)
    at, left, place, who = tc.ranges(base, pieces), sizes.copy(), np.cumsum(sizes + 1) - 1, np.unique(owner, return_inverse=True)[1].astype(np.int32)
    while len(at):
        suffix[at], whose[at], enters[at] = place, who, left >= length
        on = left > 0
        at, place, left, who = back[at[on]], place[on] - 1, left[on] - 1, who[on]
    # only entries with ``length`` bytes before them are still there after as many rounds
    order = np.flatnonzero(enters).astype(back.dtype)
    interval = np.zeros(len(order), np.int32)
    for _ in range(length):
        c = bwt[order]
        some = np.flatnonzero(c)
        some = some[np.argsort(c[some], kind="stable")]
        if not len(some):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        c, order, interval = c[some], back[order[some]], interval[some]
        border = np.ones(len(some), bool)
        border[1:] = (c[1:] != c[:-1]) | (interval[1:] != interval[:-1])
        other = whose[order]
        several = np.zeros(len(some), bool)
        several[1:] = ~border[1:] & (other[1:] != other[:-1])
        first = np.flatnonzero(border)
        interval = np.cumsum(border, dtype=np.int32)
        live = np.repeat(np.logical_or.reduceat(several, first), np.diff(np.append(first, len(some))))
        order, interval = order[live], interval[live]
    return suffix[order].astype(np.int64), interval.astype(np.int64)


def _send(length: int, buckets: int, at_id: int, at_text: int):
    """Rows with flags to the transforms of their flagged pieces, one for each bucket and slice."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, buf, off, at in tc.slices(batch.column(at_id).cast(pa.int64()), batch.column(at_text), _SLICE):
                flags = batch.column(batch.num_columns - 1).slice(at, len(ids))
                row = np.repeat(np.arange(len(ids)), pc.list_value_length(flags).fill_null(0).to_numpy())
                flag = flags.flatten().to_numpy()
                order = np.lexsort((flag, row))
                row, flag = row[order], flag[order]
                local, count, lead = flag >> 32, flag >> 16 & 0xFFFF, flag & 0xFFFF
                inside = local + count + length - 1 <= np.diff(off)[row]
                row, local, count, lead = row[inside], local[inside], count[inside], lead[inside]
                if not len(row):
                    continue
                first = off[row] + local
                gram = np.zeros(len(first), U64)
                for k, power in enumerate(tc.powers(tc.BASE, GRAM)):
                    gram += _TABLE[buf[first + lead + k]] * power
                bucket = (mix(gram) % U64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket, row, local, count, first = bucket[order], row[order], local[order], count[order], first[order]
                head = np.append(True, bucket[1:] != bucket[:-1])
                size = count + length - 1
                out, begin = transforms(buf[tc.ranges(first, size)], size, np.cumsum(head) - 1)
                edge = np.append(np.flatnonzero(head), len(bucket))
                rows = []
                for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                    bwt = out[begin[k] : begin[k + 1]]
                    # a byte each, and the places where a piece begins: 0 there
                    raw = _bytes(ids[row[a:b]], local[a:b].astype(np.int32), count[a:b].astype(np.int16), np.flatnonzero(bwt == 0).astype(np.int32)) + (np.maximum(bwt, np.uint16(1)) - np.uint16(1)).astype(np.uint8).tobytes()
                    rows.append(_row(int(bucket[a]), raw)[:3])
                yield _batch(rows, SENT)

    return send


def _known(table: pa.Table) -> list[tuple[np.ndarray, ...]]:
    out: list[tuple[np.ndarray, ...]] = []
    for x in table.column("found").to_pylist():
        if x:
            n = int(np.frombuffer(x, np.int64, 1)[0])
            out.append(tuple(np.frombuffer(x, np.int64, n, 8 + 8 * n * k) for k in range(3)))
    return out


def _settle(length: int):
    def settle(table: pa.Table) -> pa.Table:
        """One bucket: its shards' transforms merged; the suffixes whose first bytes a smaller document holds."""
        docs, locs, counts, shards = [], [], [], []
        for size, x in zip(table.column("size").to_pylist(), table.column("pieces").to_pylist(), strict=True):
            b = pa.decompress(x, decompressed_size=size, codec="zstd", asbytes=True)
            n = int(np.frombuffer(b, np.int64, 1)[0])
            docs.append(np.frombuffer(b, np.int64, n, 8))
            locs.append(np.frombuffer(b, np.int32, n, 8 + 8 * n))
            counts.append(np.frombuffer(b, np.int16, n, 8 + 12 * n))
            starts = np.frombuffer(b, np.int32, n, 8 + 14 * n)
            bwt = np.frombuffer(b, np.uint8, -1, 8 + 18 * n).astype(np.uint16) + np.uint16(1)
            bwt[starts] = 0
            shards.append((bwt, counts[-1].astype(np.int64) + length - 1))
        doc, loc, count = np.concatenate(docs), np.concatenate(locs).astype(np.int64), np.concatenate(counts).astype(np.int64)
        place, interval = merged(shards, doc, length)
        begin = np.cumsum(count + length) - (count + length)
        owner = np.searchsorted(begin, place, side="right") - 1
        twin = repeated(interval.astype(U64), doc[owner])
        if not twin.any():
            return FOUND.empty_table()
        o = owner[twin]
        return pa.Table.from_arrays([pa.array(x.astype(t)) for x, t in zip(_joined(doc[o], loc[o] + place[twin] - begin[o]), (np.int64, np.int32, np.int32), strict=True)], schema=FOUND)

    return settle


def _cut(length: int, at_text: int, at_found: int, names: list[str], keep: list[int]):
    span_type = pa.list_(pa.struct([("at", pa.int32()), ("bytes", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(at_found)
            n_bytes, n_removed, spans, kept = [], [], [], []
            texts = batch.column(at_text).cast(pa.binary())
            for i in range(batch.num_rows):
                b = texts[i].as_py() or b""
                n_bytes.append(len(b))
                f = found[i]
                runs: list[dict] = []
                if f.is_valid and b:
                    gone = np.zeros(len(b) + 1, np.int32)
                    run = f.values.to_numpy()
                    at = run >> 32
                    np.add.at(gone, np.minimum(at, len(b)), 1)
                    np.add.at(gone, np.minimum(at + (run & 0xFFFFFFFF) + length - 1, len(b)), -1)
                    edge = np.flatnonzero(np.diff((np.cumsum(gone[:-1]) > 0).astype(np.int8), prepend=0, append=0)).tolist()
                    parts, to = [], 0
                    for a, e in zip(edge[::2], edge[1::2], strict=True):
                        parts.append(b[to:a])
                        to = e
                        runs.append({"at": a, "bytes": e - a})
                    b = b"".join(parts) + b[to:]
                n_removed.append(n_bytes[-1] - len(b))
                spans.append(runs)
                kept.append(b)
            new = [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span_type), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *new], names=names)

    return cut


OUTPUT = (T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_spans", T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("bytes", T.IntegerType())]))), T.StructField("kept_bytes", T.BinaryType()))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, buckets: int | None = None) -> DataFrame:
    """All rows of docs with n_bytes, n_removed, removed_spans (maximal runs of bytes) and kept_bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id; strings are judged on
    the input, never cross documents, and may overlap. A cut may fall inside a UTF-8 character, so what is left is bytes.

    Null text: no bytes. Null id: the row takes no part and loses nothing. Repeated ids count as one document; should their
    texts differ, what goes from one goes from the same places of the others. Repeats inside one document stay. Empty input: no rows. Input columns of the four output names, in any case, are replaced; others pass through.
    """
    if not GRAM < length <= 30_000:
        raise ValueError(f"length must be over {GRAM} and at most 30,000")
    buckets = buckets or 4 * default_parallelism(docs.sparkSession)
    ours = {f.name for f in OUTPUT}
    held = [c for c in docs.columns if c.lower() not in ours or c in (id_col, text_col)]
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    keys = source.mapInArrow(_elect(length, buckets), "bucket int, size long, keys binary, found binary")
    judged = written(keys.groupBy("bucket").applyInArrow(_flag, "id long, at int, windows short, lead short"))
    flags = judged.where("lead >= 0").groupBy("id").agg(F.collect_list(F.expr("shiftleft(cast(at as bigint), 32) + windows * 65536L + lead")).alias("__flags")).select(F.col("id").cast("string").alias("__key"), "__flags")
    # both joins take the rows by id from one and the same exchange: its key is never null, so that neither join filters before it, and both take all columns
    inside = [f"__{k}" for k in range(len(held))]
    key = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("__key")
    base = docs.select(*[column(c).alias(i) for c, i in zip(held, inside, strict=True)], key).withColumn(inside[held.index(text_col)], F.col(inside[held.index(text_col)]).cast("string"))
    base = base.repartition(default_parallelism(docs.sparkSession), "__key")
    own = [F.col(i) for i in inside]
    flagged = base.join(flags, "__key").select(*own, "__flags")
    sent = flagged.mapInArrow(_send(length, 2 * buckets, held.index(id_col), held.index(text_col)), "bucket int, size long, pieces binary")
    found = sent.groupBy("bucket").applyInArrow(_settle(length), "id long, at int, windows int")
    found = found.unionByName(judged.where("lead < 0").select("id", "at", F.col("windows").cast("int").alias("windows")))
    found = found.groupBy("id").agg(F.collect_list(F.expr("shiftleft(cast(at as bigint), 32) + windows")).alias("__found")).select(F.col("id").cast("string").alias("__key"), "__found")
    joined = base.join(found, "__key", "left").select(*own, "__found")
    keep = [k for k, c in enumerate(held) if c.lower() not in ours]
    schema = T.StructType([*(T.StructField(held[k], docs.schema[held[k]].dataType) for k in keep), *OUTPUT])
    return joined.mapInArrow(_cut(length, held.index(text_col), len(held), schema.names, keep), schema)
