"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table hashes a unit vector to floor((a.x + b) / w) for a few Gaussian directions a. A query visits perturbed
buckets in the order of their estimated success: the sum of squared distances from its projections to the slots'
borders, smallest first. Candidates of all tables are merged and ranked by the exact cosine of the original vectors.
Every row is indexed; nothing is learned from the data.

Buckets are dealt to parts. A row goes to the part of its bucket in each table, a query once to each part that it visits, with
the list of buckets there, so its vector is not sent for every probe; 32-bit vectors travel as such. A bucket is cut into blocks of bounded size, dealt to
parts one by one, which all its queries visit, so a hot bucket is spread and stays whole; a part returns at most k rows a query. Queries that found
fewer than k rows are compared with all rows of their length, in blocks too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import default_parallelism, written
from .textcore import U64, mix, ranges

#: Rows in a block of a bucket.
BLOCK = 20_000


def _directions(dims: int, tables: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1000 + dims)
    return rng.standard_normal((tables, hashes, dims)), rng.uniform(0, width, (tables, hashes))


def _matrix(vectors: list[bytes]) -> np.ndarray:
    """Vectors of one length; the first byte of each says whether its numbers have 32 bits."""
    small = vectors[0][:1] == b"f"
    return np.frombuffer(b"".join(v[1:] for v in vectors), np.float32 if small else np.float64).reshape(len(vectors), -1).astype(np.float64)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes with their length; those that are null, empty, zero or not finite are left out."""
    for batch in batches:
        column = batch.column(1)
        size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        values = column.flatten()
        flat = values.to_numpy(zero_copy_only=False).astype(values.type.to_pandas_dtype())  # nulls are NaN
        first = np.cumsum(size) - size
        some = size > 0
        good = np.zeros(len(size), bool)
        if some.any():
            good[some] = np.logical_and.reduceat(np.isfinite(flat), first[some]) & np.logical_or.reduceat(flat != 0, first[some])
        mark = b"f" if flat.dtype == np.float32 else b"d"
        at = np.flatnonzero(good)
        raw = [mark + flat[first[i] : first[i] + size[i]].tobytes() for i in at.tolist()]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)).cast(pa.int64()), pa.array(size[at], pa.int32()), pa.array(raw, pa.binary())], names=["id", "dims", "vector"])


def _codes(x: np.ndarray, dims: int, table: int, tables: int, hashes: int, width: float, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit vectors and their buckets in a table: the own one for probes = 0, else so many by estimated success."""
    a, b = _directions(dims, tables, hashes, width)
    at = (x @ a[table].T + b[table]) / width
    slot = np.floor(at).astype(np.int64)
    owner = np.arange(len(x))
    if probes:
        steps = np.array(list(product(range(-2, 3), repeat=hashes)))
        f = at - slot
        cost = np.stack([(f + 1) ** 2, f**2, 0 * f, (1 - f) ** 2, (2 - f) ** 2])
        total = sum(cost[steps[:, m] + 2, :, m] for m in range(hashes)).T
        few = min(probes, len(steps))
        best = np.argpartition(total, few - 1, axis=1)[:, :few]
        owner = np.repeat(owner, few)
        slot = slot[owner] + steps[best.ravel()]
    code = np.full(len(slot), dims * 1_009 + table, np.int64)
    for m in range(hashes):
        code = code * 1_000_003 + slot[:, m]
    return owner, mix(code.view(U64)).view(np.int64)


def _hash(tables: int, hashes: int, width: float):
    """Rows (dims, bucket, id, vector): each row once in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                x = unit(_matrix(part.column("vector").to_pylist()))
                for t in range(tables):
                    _, code = _codes(x, d, t, tables, hashes, width, 0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), t), pa.int32()), part.column("dims"), pa.array(code), part.column("id"), part.column("vector")], names=["table", "dims", "bucket", "id", "vector"])

    return run


def _probe(tables: int, hashes: int, width: float, probes: int, parts: int, wide: dict[int, int]):
    """A row for each query and part that it visits, with the buckets and blocks there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                mine = batch.filter(pa.array(dims == d))
                for lo in range(0, len(mine), 1000):
                    few = mine.slice(lo, 1000)
                    x = unit(_matrix(few.column("vector").to_pylist()))
                    owner, code = (np.concatenate(c) for c in zip(*(_codes(x, d, t, tables, hashes, width, probes) for t in range(tables)), strict=True))
                    blocks = np.array([wide.get(c, 1) for c in code.tolist()]) if wide else np.ones(len(code), np.int64)
                    cell = np.repeat(code, blocks) + ranges(np.zeros(len(code), np.int64), blocks)
                    owner = np.repeat(owner, blocks)
                    part = part_of(cell, parts)
                    order = np.lexsort((cell, owner, part))
                    owner, part, cell = owner[order], part[order], cell[order]
                    new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])))
                    cells = pa.ListArray.from_arrays(pa.array(np.append(new, len(cell)), pa.int32()), pa.array(cell))
                    take = few.take(pa.array(owner[new]))
                    yield pa.RecordBatch.from_arrays([pa.array(part[new], pa.int32()), cells, take.column("id"), take.column("vector")], names=["part", "cells", "id", "vector"])

    return run


def part_of(cell: np.ndarray, parts: int) -> np.ndarray:
    return (mix(cell.view(U64) ^ U64(0x6A09E667)) % U64(parts)).astype(np.int32)


def _deal(parts: int, wide: dict[int, int]):
    """Rows to the part of their bucket's block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, ids = batch.column("bucket").to_numpy(), batch.column("id").to_numpy()
            blocks = np.array([wide.get(c, 1) for c in code.tolist()], U64) if wide else np.ones(len(code), U64)
            cell = code + (mix(ids.view(U64) ^ U64(0x3C6EF372)) % blocks).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part_of(cell, parts), pa.int32()), pa.array(cell), batch.column("id"), batch.column("vector")], names=["part", "cell", "id", "vector"])

    return run


NEAR = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two to about 1, which changes no cosine and keeps squares in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, each summed in the same order wherever it is computed."""
    q, x = _scaled(q), _scaled(x)
    return (q * x).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


def _best(k: int, qs: np.ndarray, qv: np.ndarray, ids: np.ndarray, x: np.ndarray, unit_x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Query, row and exact score of the k rows of largest cosine for each query, and of all that tie with the last."""
    near = unit(qv) @ unit_x.T
    near[qs[:, None] == ids[None, :]] = -2
    # rows of a repeated id may stand before others, but only one of them counts
    few = min(k + len(ids) - len(np.unique(ids)), len(ids))
    floor = np.partition(near, len(ids) - few, axis=1)[:, len(ids) - few] - 1e-12
    q, r = np.nonzero((near >= floor[:, None]) & (near > -2))
    return qs[q], ids[r], cosines(qv[q], x[r])


def _near_table(out: list[tuple[np.ndarray, ...]], k: int) -> pa.Table:
    """For each query the k best of what a part's cells found, ties to the smaller id, each id once."""
    if not out:
        return NEAR.empty_table()
    q, v, score = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.lexsort((-score, v, q))
    q, v, score = q[order], v[order], score[order]
    if len(q):
        once = np.append(True, (q[1:] != q[:-1]) | (v[1:] != v[:-1]))
        q, v, score = q[once], v[once], score[once]
    order = np.lexsort((v, -score, q))
    q, v, score = q[order], v[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return pa.Table.from_arrays([pa.array(q[keep]), pa.array(v[keep]), pa.array(score[keep])], schema=NEAR)


def _different(at: np.ndarray, ids: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Of the rows ``at``, one of each id and vector."""
    if len(np.unique(ids[at])) == len(at):
        return at
    return np.array(list({(ids[i], raw[i]): i for i in at[::-1].tolist()}.values()), np.int64)


def _rank(k: int):
    def rank(rows: pa.Table, queries: pa.Table) -> pa.Table:
        """One part: every bucket's rows against the queries that visit it."""
        if not rows.num_rows or not queries.num_rows:
            return NEAR.empty_table()
        cell, ids, raw = rows.column("cell").to_numpy(), rows.column("id").to_numpy(), rows.column("vector").to_pylist()
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        new = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        end = np.append(new[1:], len(cell))
        visits = queries.column("cells").combine_chunks()
        visits = visits if isinstance(visits, pa.Array) else visits.chunk(0)
        who, to = np.repeat(np.arange(len(visits)), visits.value_lengths().to_numpy()), visits.flatten().to_numpy()
        at = np.minimum(np.searchsorted(cell[new], to), len(new) - 1)
        met = cell[new][at] == to
        who, at = who[met], at[met]
        by = np.argsort(at, kind="stable")
        who, at = who[by], at[by]
        qs, qraw, out = queries.column("id").to_numpy(), queries.column("vector").to_pylist(), []
        edge = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own = _different(order[new[at[a]] : end[at[a]]], ids, raw)
            x = _matrix([raw[i] for i in own.tolist()])
            unit_x = unit(x)
            for lo in range(a, b, 256):
                q = who[lo : min(b, lo + 256)]
                out.append(_best(k, qs[q], _matrix([qraw[i] for i in q.tolist()]), ids[own], x, unit_x))
        return _near_table(out, k)

    return rank


def _scan(k: int):
    def scan(rows: pa.Table, queries: pa.Table) -> pa.Table:
        """One block of all rows of a length against the queries of that length."""
        if not rows.num_rows or not queries.num_rows:
            return NEAR.empty_table()
        ids, raw = rows.column("id").to_numpy(), rows.column("vector").to_pylist()
        own = _different(np.arange(len(ids)), ids, raw)
        ids, x = ids[own], _matrix([raw[i] for i in own.tolist()])
        qs, qv, out = queries.column("id").to_numpy(), _matrix(queries.column("vector").to_pylist()), []
        unit_x = unit(x)
        for lo in range(0, len(qs), 256):
            out.append(_best(k, qs[lo : lo + 256], qv[lo : lo + 256], ids, x, unit_x))
        return _near_table(out, k)

    return scan


def nearest(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, tables: int = 6, hashes: int = 4, width: float = 1.2, probes: int = 80) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of largest cosine that were found (all, if fewer), ties to the smaller id.

    A row isn't its own neighbour. Vectors that are null, empty, zero, or hold null or non-finite components take no part,
    nor do null ids; vectors of different lengths are never compared. Of a repeated id, the row of largest cosine counts. Empty
    input: no rows. Other columns aren't read. Components of any size are taken; numbers of 32 bits are widened for the cosine.
    """
    parts = default_parallelism(rows.sparkSession)
    kind = "array<float>" if all("float" in df.schema[vector_col].dataType.simpleString() for df in (rows, queries)) else "array<double>"

    def clean(df: DataFrame) -> DataFrame:
        picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).where("id is not null and v is not null")
        return picked.mapInArrow(_clean, "id long, dims int, vector binary")

    whole = written(clean(rows).mapInArrow(_hash(tables, hashes, width), "table int, dims int, bucket long, id long, vector binary"))
    asked = written(clean(queries))
    blocks = whole.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    # at most tables * rows / BLOCK buckets
    wide = {r["bucket"]: r["blocks"] for r in blocks.toLocalIterator()}
    near = "query_id long, vec_id long, score double"
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def ranked(met: DataFrame) -> DataFrame:
        met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    index = whole.select("bucket", "id", "vector").mapInArrow(_deal(parts, wide), "part int, cell long, id long, vector binary")
    probed = asked.mapInArrow(_probe(tables, hashes, width, probes, parts, wide), "part int, cells array<long>, id long, vector binary")
    found = written(ranked(index.groupBy("part").cogroup(probed.groupBy("part")).applyInArrow(_rank(k), near)))
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = written(asked.join(full, "id", "left_anti").distinct())
    if short.isEmpty():
        return found
    all_rows = whole.where(F.col("table") == 0).select("dims", "id", "vector")
    size = written(all_rows.groupBy("dims").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    all_rows = all_rows.join(F.broadcast(size), "dims").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).drop("blocks")
    few = short.join(F.broadcast(size), "dims").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    scanned = all_rows.groupBy("dims", "block").cogroup(few.groupBy("dims", "block")).applyInArrow(_scan(k), near)
    kept = found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti")
    return kept.unionByName(ranked(scanned))
