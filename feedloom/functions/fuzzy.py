"""Fuzzy search of a table of terms in a table of names, without comparing all with all.

A term that lies in a name with at most k edits leaves one of any k + 1 pieces of it untouched there. So terms are cut into that many pieces,
pieces meet the names' short stretches by value, a pair counts at the first of its pieces that the name holds, and what is
left is verified by bit-parallel edit distances, a batch of pairs at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a piece that are looked up; pairs that are verified together; letters of a term that fit a machine word.
GRAM, PAIRS, WORD = 4, 4096, 64


def _codes(texts: list[str], fill: int) -> np.ndarray:
    """Code points, a row a text, filled to the longest."""
    width = max(map(len, texts), default=0)
    flat = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), width).astype(np.int64)
    size = np.array([len(t) for t in texts])
    return np.where(np.arange(width) < size[:, None], flat, fill)


def _short(terms: list[str], names: list[str]) -> np.ndarray:
    """Fewest edits between each term of up to 64 letters and any stretch of its name."""
    n, one = len(terms), np.uint64(1)
    t, a = _codes(terms, -1), _codes(names, -2)
    # which places of the term hold the name's letter, by (pair, letter)
    row, place = np.nonzero(t >= 0)
    key = row << 22 | t[row, place]
    order = np.argsort(key, kind="stable")
    key, bits = key[order], one << place[order].astype(np.uint64)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    known, masks = key[first], np.append(np.bitwise_or.reduceat(bits, first), np.uint64(0))
    asked = np.where(a >= 0, np.arange(n)[:, None] << 22 | a, -1)
    at = np.searchsorted(known, asked)
    equal = masks[np.where(known[np.minimum(at, len(known) - 1)] == asked, at, len(known))]
    top = one << np.array([len(x) - 1 for x in terms], np.uint64)
    score = np.array([len(x) for x in terms])
    best, up, down = score.copy(), np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    for k in range(a.shape[1]):
        e = equal[:, k]
        v, h = e | down, (((e & up) + up) ^ up) | e
        more, less = down | ~(h | up), up & h
        score = score + ((more & top) != 0) - ((less & top) != 0)
        np.minimum(best, score, out=best)
        more, less = more << one, less << one
        up, down = less | ~(v | more), more & v
    return best


def _long(term: str, name: str) -> int:
    """The same for a term of any length, on Python's integers."""
    m, full = len(term), (1 << len(term)) - 1
    masks: dict[str, int] = {}
    for k, c in enumerate(term):
        masks[c] = masks.get(c, 0) | 1 << k
    up, down, score, best = full, 0, m, m
    for c in name:
        e = masks.get(c, 0)
        v, h = e | down, (((e & up) + up) ^ up) | e
        more, less = (down | ~(h | up)) & full, up & h
        score += (more >> (m - 1) & 1) - (less >> (m - 1) & 1)
        best = min(best, score)
        more, less = more << 1 & full, less << 1 & full
        up, down = (less | ~(v | more)) & full, more & v
    return best


def edits(terms: list[str], names: list[str]) -> np.ndarray:
    """Fewest edits that make each term a stretch of its name; an empty term needs none."""
    out = np.zeros(len(terms), np.int64)
    # pairs of like lengths together, so that a long name doesn't widen a batch of short ones
    order = sorted((k for k, t in enumerate(terms) if 0 < len(t) <= WORD), key=lambda k: len(names[k]))
    for a in range(0, len(order), PAIRS):
        some = order[a : a + PAIRS]
        out[some] = _short([terms[k] for k in some], [names[k] for k in some])
    for k, t in enumerate(terms):
        if len(t) > WORD:
            out[k] = _long(t, names[k])
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = edits(b.column(0).to_pylist(), b.column(1).to_pylist())
        near = pa.array(found <= b.column(2).to_numpy())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found.astype(np.int32))], names=["term", "name", "edits"]).filter(near)


def _allowed(term: Column, threshold: float) -> Column:
    return F.floor(F.length(term) * threshold).cast("int")


def fuzzy_matches(terms: DataFrame, names: DataFrame, term_col: str, name_col: str, threshold: float = 0.3) -> DataFrame:
    """(term, name, edits): every different term with every different name of which some stretch is within that share of the term's length
    by edit distance, in lower case, and how many edits that takes at least.

    Null and empty terms and names match nothing; an empty table on either side gives no rows.
    """
    if not 0 <= threshold < 1:
        raise ValueError("threshold must be at least 0 and under 1")
    t, n = (df.select(F.lower(c).alias(to)).where(F.length(to) > 0).distinct() for df, c, to in ((terms, term_col, "term"), (names, name_col, "name")))
    m, k = F.length("term"), F.col("allowed")
    start = lambda i: F.floor(i * m / (k + 1)).cast("int")
    piece = lambda i: F.substr("term", start(i) + 1, F.least(start(i + 1) - start(i), F.lit(GRAM)))
    t = t.withColumn("allowed", _allowed(F.col("term"), threshold)).withColumn("pieces", F.array_distinct(F.transform(F.sequence(F.lit(0), k), piece)))
    cut = t.select("term", "allowed", "pieces", F.posexplode("pieces").alias("place", "piece"))
    # only stretches as long as some piece are looked up, and none of them is over GRAM letters
    sizes = sorted(r[0] for r in cut.select(F.length("piece")).distinct().collect())
    stretch = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - s + 1, F.lit(1))), lambda i: F.substr("name", i, F.lit(s)))
    held = F.array_distinct(F.flatten(F.array(*[stretch(s) for s in sizes]))) if sizes else F.array().cast("array<string>")
    grams = n.select("name", F.explode(held).alias("gram"))
    pairs = cut.join(grams, F.col("piece") == F.col("gram")).where(F.length("name") >= F.length("term") - F.col("allowed"))
    pairs = pairs.where(~F.exists(F.slice("pieces", F.lit(1), F.col("place")), lambda p: F.contains("name", p)))
    return pairs.select("term", "name", "allowed").mapInArrow(_verified, "term string, name string, edits int")
