"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of up to 64 bits is cut into ``segments``. In round r every open query looks up, in each segment, the values at
distance r from its own. A code that differs in all segments by more than r is at least segments * (r + 1) away, so once
the k-th verified distance is below that, the query is settled; otherwise its radius grows. Equal codes are held once,
with their k + 1 smallest ids, so a code that a third of the rows share costs one comparison.

The codes are dealt into shards of bounded size, each of which indexes its own segments; every open query meets every
shard, and a shard returns at most k rows a query, so neither probes nor candidates are shuffled or broadcast.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import default_parallelism, written
from .textcore import ranges

#: Codes of a shard, about; small inputs are spread over the session's partitions, this many codes at least in each.
SHARD, SHARD_LEAST = 1 << 17, 1 << 10
#: Probes of one segment looked up at once.
PROBES = 1_000_000
FOUND = pa.schema([("query_id", pa.int64()), ("distance", pa.int32()), ("id", pa.int64())])


def sign_code(vector: Column, bits: int = 64) -> Column:
    """Bit i is set where component i is above 0; null for a null vector or one with a null or non-finite component.

    A vector of more components than there are bits fails the query: a code of its first ones would be another measure.
    """
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    terms = F.transform(F.slice(vector, 1, bits), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long")))
    long = F.raise_error(F.concat(F.lit(f"a code of {bits} bits can't hold a vector of length "), F.size(vector).cast("string"))).cast("long")
    return F.when(F.size(vector) > bits, long).when(vector.isNull() | bad | (F.size(vector) == 0), F.lit(None).cast("long")).otherwise(F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))


def _masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)


def _look_up(k: int, segments: int, width: int, radius: int):
    """For each query of a shard, the k nearest (ties to the smaller id) of the codes first met at this radius."""
    masks, low = _masks(width, radius), np.uint64((1 << width) - 1)

    def look_up(codes: pa.Table, queries: pa.Table) -> pa.Table:
        if not codes.num_rows or not queries.num_rows:
            return FOUND.empty_table()
        code = codes.column("code").to_numpy().astype(np.int64).view(np.uint64)
        held = codes.column("ids").combine_chunks()
        held = held if isinstance(held, pa.Array) else held.chunk(0)
        ids, first = held.flatten().to_numpy(), np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy())])
        index = []
        for j in range(segments):
            v = ((code >> np.uint64(j * width)) & low).astype(np.int64)
            by = np.argsort(v, kind="stable")
            values, start, count = np.unique(v[by], return_index=True, return_counts=True)
            index.append((by, values, start, count))
        qid, own = queries.column("query_id").to_numpy(), queries.column("code").to_numpy().astype(np.int64).view(np.uint64)
        far = queries.column("far").to_numpy()
        out = []
        step = max(1, PROBES // len(masks))
        for lo in range(0, len(qid), step):
            mine = own[lo : lo + step]
            met = []
            for j, (by, values, start, count) in enumerate(index):
                probe = (((mine >> np.uint64(j * width)) & low).astype(np.int64)[:, None] ^ masks).ravel()
                at = np.minimum(np.searchsorted(values, probe), len(values) - 1)
                hit = np.flatnonzero(values[at] == probe)
                who, at = hit // len(masks), at[hit]
                c, q = by[ranges(start[at], count[at])], np.repeat(who, count[at])
                near = np.bitwise_count(code[c] ^ mine[q]) <= far[lo + q]
                met.append(q[near] * len(code) + c[near])
            q, c = np.divmod(np.unique(np.concatenate(met)), len(code))
            many = first[c + 1] - first[c]
            i, d, q = ids[ranges(first[c], many)], np.repeat(np.bitwise_count(code[c] ^ mine[q]), many), np.repeat(q, many)
            other = i != qid[lo + q]
            i, d, q = i[other], d[other].astype(np.int32), q[other]
            by = np.lexsort((i, d, q))
            i, d, q = i[by], d[by], q[by]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            out.append((qid[lo + q[keep]], d[keep], i[keep]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=FOUND)

    return look_up


def top_k_codes(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", code_col: str = "code", bits: int = 64, segments: int = 4) -> DataFrame:
    """(query_id, rank, id, distance): the k rows nearest to each query, ties to the smaller id.

    A row is not its own neighbour: rows with the query's id are left out. Null ids and null codes take no part. Fewer
    rows than k: all of them. Repeated ids with one code count once. Empty rows or queries: no rows.
    """
    width = bits // segments
    if width * segments != bits or width > 30:
        raise ValueError("segments must divide the bits into parts of at most 30")
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(code_col).cast("long").alias("code")).where("id is not null and code is not null").distinct()
    first = base.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k + 1)
    codes = written(first.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    wanted = written(queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(code_col).cast("long").alias("code")).where("query_id is not null and code is not null").distinct())
    everything = codes.agg(F.count("*")).first()[0]
    shards = max(-(-everything // SHARD), min(default_parallelism(rows.sparkSession), -(-everything // SHARD_LEAST)), 1)
    sharded = codes.select(F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int").alias("shard"), "code", "ids")
    open_, best, done = wanted.withColumn("far", F.lit(bits).cast("long")), None, []
    for r in range(width + 1):
        asked = open_.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        met = sharded.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_look_up(k, segments, width, r), "query_id long, distance int, id long")
        met = met if best is None else met.unionByName(best.join(open_.select("query_id"), "query_id", "left_semi").select("query_id", "distance", "id"))
        by = Window.partitionBy("query_id").orderBy("distance", "id")
        best = written(met.distinct().withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k))
        covered = segments * (r + 1) - 1
        state = best.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("most"))
        full = F.coalesce(F.col("n") >= k, F.lit(False))
        state = open_.select("query_id", "code").join(state, "query_id", "left").withColumn("settled", full & (F.col("most") <= covered))
        state = written(state.select("query_id", "code", F.coalesce("settled", F.lit(False)).alias("settled"), F.when(full, F.col("most")).otherwise(bits).cast("long").alias("far")))
        last = r == width or not everything
        ready = state if last else state.where("settled")
        done.append(best.join(ready.select("query_id"), "query_id", "left_semi"))
        open_ = state.where("not settled").select("query_id", "code", "far")
        if last or not open_.limit(1).count():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("query_id", "rank", "id", "distance")
