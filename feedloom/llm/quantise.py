"""Vector codes: product quantisation on integers by Lloyd's rounds with Hamerly's bounds.

A vector's components become integers and fall into parts; each part position has a codebook of its own. Every part keeps
two numbers from round to round, in a written table: an upper bound of the distance to its own entry and a lower
bound of that to the second nearest. When entries have moved, the bounds move by as much, and a part whose upper bound stays
strictly under the lower one (or under half the way from its entry to the next) keeps its entry unseen; the others first
renew their upper bound and only then, if it still fails, compare themselves with the whole codebook, exactly and on integers.
Tasks send sums for each entry, not vectors; the codebooks (dimensions x entries integers) are what the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are looked at together.
ROWS = 2048
#: Relative slack of a bound, far over a float's rounding.
SLACK = 1e-6


def _limit(width: int) -> int:
    """Integers of a part of so many components must lie under this for its squared distances to fit a long."""
    return int(2**30 / max(1, width) ** 0.5)


def integers(values: np.ndarray, width: int) -> np.ndarray:
    out = np.floor(SCALE * values.astype(np.float64))
    if out.size and np.abs(out).max() >= _limit(width):
        raise ValueError(f"components of {_limit(width) // SCALE} and more are not supported for parts of {width} components")
    return out.astype(np.int64)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((np.sqrt(x.astype(np.float64)) * (1 + SLACK)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter((np.sqrt(x.astype(np.float64)) * (1 - SLACK)).astype(np.float32), np.float32(-np.inf))


def scan(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (ties: lower index), its squared distance and that of the second, -1 with one entry."""
    d = ((points[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    best = d.argmin(axis=1)
    rows = np.arange(len(points))
    first = d[rows, best]
    d[rows, best] = np.iinfo(np.int64).max
    return best, first, d.min(axis=1) if book.shape[0] > 1 else np.full(len(points), -1)


def moves(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each part and entry how far it went, how far the others went at most, and half its way to the nearest other."""
    own = np.sqrt(((old - new) ** 2).sum(axis=2).astype(np.float64)) * (1 + SLACK)
    others, half = np.zeros_like(own), np.full_like(own, np.inf)
    for p in range(own.shape[0]):
        for e in range(own.shape[1]):
            rest = np.delete(np.arange(own.shape[1]), e)
            if len(rest):
                others[p, e] = own[p, rest].max()
                half[p, e] = np.sqrt(float(((new[p, rest] - new[p, e]) ** 2).sum(axis=1).min())) / 2 * (1 - SLACK)
    return own, others, half


def assign(ints: np.ndarray, book: np.ndarray, state=None, moved=None):
    """(code, upper, lower, error, parts that were scanned) of vectors as integers, from the bounds of the round before or anew."""
    n, parts = len(ints), book.shape[0]
    points = ints.reshape(n, parts, -1)
    code, upper, lower = (np.zeros((n, parts), t) for t in (np.uint8, np.float32, np.float32)) if state is None else (x.copy() for x in state)
    scanned = 0
    for p in range(parts):
        if state is None:
            todo = np.arange(n)
        else:
            own, others, half = (m[p][code[:, p]] for m in moved)
            upper[:, p] = np.nextafter((upper[:, p].astype(np.float64) + own).astype(np.float32), np.float32(np.inf))
            lower[:, p] = np.nextafter((lower[:, p].astype(np.float64) - others).astype(np.float32), np.float32(-np.inf))
            safe = np.maximum(lower[:, p], half)
            todo = np.flatnonzero(~(upper[:, p] < safe))
            upper[todo, p] = _up(((points[todo, p] - book[p][code[todo, p]]) ** 2).sum(axis=1))
            todo = todo[~(upper[todo, p] < safe[todo])]
        scanned += len(todo)
        if len(todo):
            best, first, second = scan(points[todo, p], book[p])
            code[todo, p], upper[todo, p] = best, _up(first)
            lower[todo, p] = np.where(second < 0, np.inf, _down(np.maximum(second, 0)))
    chosen = np.stack([book[p][code[:, p]] for p in range(parts)], axis=1)
    return code, upper, lower, ((points - chosen) ** 2).sum(axis=(1, 2)), scanned


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as bytes."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def _unpacked(c: pa.Array, kind, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(c.to_pylist()), kind).reshape(n, -1)


def _small(ints: np.ndarray) -> np.ndarray:
    return ints.astype(np.int16) if not ints.size or np.abs(ints).max() < 2**15 else ints.astype(np.int32)


def _first(at: int, dims: int, book: np.ndarray, names: list[str]):
    """First assignment. Vectors of another length have null codes."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                vectors = batch.column(at)
                fits = [len(v) == dims for v in vectors]
                n = sum(fits)
                put = lambda x, fits=fits: pa.array([next(x) if f else None for f in fits])
                if n:
                    ints = integers(np.array([v.as_py() for v, f in zip(vectors, fits, strict=True) if f], np.float64), dims // book.shape[0])
                    code, upper, lower, error, _ = assign(ints, book)
                    own = [iter(_packed(x).to_pylist()) for x in (_small(ints), code, upper, lower)] + [iter(error.tolist())]
                else:
                    own = [iter(())] * 5
                cols = [put(x).cast(t) for x, t in zip(own, (*[pa.binary()] * 4, pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(at)), *cols], names=names)

    return first


def _matrix(c: pa.Array, n: int, dims: int) -> np.ndarray:
    return np.array([np.frombuffer(x, np.int16 if len(x) == 2 * dims else np.int32) for x in c.to_pylist()]).reshape(n, dims).astype(np.int64)


def _next(at: int, dims: int, book: np.ndarray, moved: tuple, names: list[str]):
    """A later assignment, from the bounds."""

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = pa.Table.from_batches([whole.slice(a, ROWS)])
                fits = batch.column("ints").is_valid()
                good, rest = batch.filter(fits), batch.filter(pc.invert(fits))
                n = good.num_rows
                if n:
                    code, upper, lower = (_unpacked(good.column(c), t, n) for c, t in (("code", np.uint8), ("upper", np.float32), ("lower", np.float32)))
                    code, upper, lower, error, _ = assign(_matrix(good.column("ints"), n, dims), book, (code, upper, lower), moved)
                    good = pa.Table.from_arrays([*(good.column(k) for k in range(at + 1)), _packed(code), _packed(upper), _packed(lower), pa.array(error)], names=names)
                    yield from good.combine_chunks().to_batches()
                if rest.num_rows:
                    yield from rest.combine_chunks().to_batches()

    return later


def _sums(dims: int, parts: int, entries: int):
    """For each part, entry and place what a task's vectors add up to; place -1 counts them."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = dims // parts
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                some = batch.slice(a, ROWS)
                n = some.num_rows
                points, code = _matrix(some.column(0), n, dims).reshape(n, parts, width), _unpacked(some.column(1), np.uint8, n)
                for p in range(parts):
                    np.add.at(total[p], code[:, p], points[:, p])
                    count[p] += np.bincount(code[:, p], minlength=entries)
        p, e = np.nonzero(count)
        place = np.tile(np.arange(-1, width), len(p))
        value = np.concatenate([count[p, e][:, None], total[p, e]], axis=1).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, width + 1).astype(np.int32)) for x in (p, e)] + [pa.array(place.astype(np.int32)), pa.array(value)], names=["part", "entry", "place", "value"])

    return sums


def _renewed(state: DataFrame, dims: int, book: np.ndarray) -> np.ndarray:
    """Each entry as the floor of its parts' mean; unused entries stay."""
    parts, entries, width = book.shape
    rows = state.where("ints IS NOT NULL").select("ints", "code").mapInArrow(_sums(dims, parts, entries), "part int, entry int, place int, value long")
    rows = rows.groupBy("part", "entry", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("value")).collect()
    found = {(r["part"], r["entry"], r["place"]): int(r["value"]) for r in rows}
    out = book.copy()
    for p, e, place in found:
        if place >= 0:
            out[p, e, place] = found[p, e, place] // found[p, e, -1]
    return out


def vector_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Rows (id, label, code, error, label_error) with their column names kept, and the final codebooks as parts x entries x width.

    Components become floor(256 x), and vectors ``parts`` consecutive stretches. Each part position starts from its stretch of the vectors of
    the ``entries`` smallest ids (at most 256; ties of ids by the vector; null ids last); then ``rounds`` rounds and a last assignment by the
    least squared distance, ties to the lower index. code is one byte a part, error the sum of the squared distances, label_error the sum of
    errors over equal labels, nulls together.

    Vectors that are null or hold a null, NaN or infinite component have no row. Those whose length differs from that of the smallest
    id's, or is no multiple of ``parts``, keep their row with null code and error (a label of only such rows has a null sum). Repeated rows each count.
    An empty table gives no rows and codebooks without entries. Components of 2^22 / sqrt(width) and more are refused.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256")
    vector = column(vector_col)
    finite = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    plain = rows.where(finite).select(column(id_col).alias("id"), column(label_col).alias("label"), vector.alias("vector"))
    start = plain.orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).collect()
    dims = len(start[0]["vector"]) if start else 0
    fits = bool(dims) and dims % parts == 0
    seeds = plain.where(F.size("vector") == dims).orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect() if fits else []
    width = dims // parts if fits else 0
    book = integers(np.array([r["vector"] for r in seeds]).reshape(len(seeds), dims if fits else 0), width)
    book = book.reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()
    fields = plain.schema["id"].dataType.simpleString(), plain.schema["label"].dataType.simpleString()
    schema = f"id {fields[0]}, label {fields[1]}, ints binary, code binary, upper binary, lower binary, error long"
    names = ["id", "label", "ints", "code", "upper", "lower", "error"]
    state = plain.mapInArrow(_first(2, dims if fits else -1, book, names), schema)
    for _ in range(rounds):
        state = written(state)
        new = _renewed(state, dims, book) if len(seeds) else book
        state = state.mapInArrow(_next(2, dims, new, moves(book, new), names), schema)
        book = new
    found = written(state.select("id", "label", "code", "error"))
    labels = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    out = found.join(labels, F.col("label").eqNullSafe(F.col("__label")))
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"), book


def codebooks_digest(book: np.ndarray) -> str:
    """SHA-256, as lowercase hex, of all entries' decimal components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()
