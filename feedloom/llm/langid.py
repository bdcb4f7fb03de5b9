"""Language identification by hyperdimensional profiles.

Every letter has a random +1/-1 vector. An n-gram's vector binds (multiplies) its letters' vectors, each rotated by
its place; a document bundles (sums) the vectors of its n-grams, damped by the square root of their counts. A
language's prototype is the sum of the unit vectors of its training documents; a document takes the language of
the prototype at the largest cosine. Training gathers one vector per language and task, combined before they meet, in two steps.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column

DIMENSIONS = 512
GRAM = 3
#: Letters share a vector when their code points agree modulo this.
LETTERS = 4096
#: More labels than this are refused: the prototypes go to the driver and to every task.
MOST_LANGUAGES = 10_000
#: Texts and characters that are bundled at once.
ROWS, CHARS = 256, 1_000_000
UNKNOWN = "und"
#: Groups for each language in which tasks' sums are added before the groups' are.
_SALTS = 512


@cache
def _letter() -> np.ndarray:
    """For every code point its letter class, 0 where it is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.int64)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            out[c] = c % (LETTERS - 1) + 1
    return out


@cache
def _items() -> list[np.ndarray]:
    """The letters' vectors, rotated for each place in an n-gram, last place first."""
    plain = np.random.default_rng(7).choice(np.array([-1, 1], np.int8), (LETTERS, DIMENSIONS))
    return [np.roll(plain, k, axis=1) for k in range(GRAM)]


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    out = _items()[0][grams % LETTERS]
    for k in range(1, GRAM):
        grams = grams // LETTERS
        out = out * _items()[k][grams % LETTERS]
    return out.astype(np.float32)


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of all texts with one 0 for each gap and at each end, and the text each belongs to."""
    parts = [np.frombuffer((t or "").lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
    size = np.array([len(p) + 2 for p in parts])
    code = np.zeros(int(size.sum()), np.int64)
    first = np.cumsum(size) - size
    letter = _letter()
    for p, a in zip(parts, first.tolist(), strict=True):
        code[a + 1 : a + 1 + len(p)] = letter[p]
    owner = np.repeat(np.arange(len(texts)), size)
    keep = code > 0
    keep[1:] |= (code[:-1] > 0) | (owner[1:] != owner[:-1])
    keep[:1] = True
    return code[keep], owner[keep]


def vectors(texts: list[str | None]) -> np.ndarray:
    """Unit vectors of texts, a row each; zeros for a text without a letter."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    code, owner = _codes(texts)
    if len(code) < GRAM:
        return out
    gram = code[: len(code) - GRAM + 1]
    inside = owner[: len(gram)] == owner[GRAM - 1 :]
    for k in range(1, GRAM):
        gram = gram * LETTERS + code[k : len(code) - GRAM + 1 + k]
    gram, who = gram[inside], owner[: len(inside)][inside]
    real = gram > 0
    gram, who = gram[real], who[real]
    letters, small = np.unique(code), None
    if len(letters) ** GRAM <= 4_000_000:
        # few letters: number the n-grams that occur through a table instead of sorting
        place = np.zeros(LETTERS, np.int64)
        place[letters] = np.arange(len(letters))
        small = np.zeros(len(gram), np.int64)
        rest = gram
        for k in range(GRAM):
            small += place[rest % LETTERS] * len(letters) ** k
            rest = rest // LETTERS
        there = np.zeros(len(letters) ** GRAM, bool)
        there[small] = True
        number = np.cumsum(there) - 1
        at = number[small]
        grams = np.zeros(int(there.sum()), np.int64)
        grams[at] = gram
    else:
        grams, at = np.unique(gram, return_inverse=True)
    for a in range(0, len(grams), 8192):
        b = min(a + 8192, len(grams))
        some = (at >= a) & (at < b) if b - a < len(grams) else slice(None)
        count = np.bincount(who[some] * (b - a) + at[some] - a, minlength=len(texts) * (b - a))
        out += np.sqrt(count.astype(np.float32)).reshape(len(texts), b - a) @ gram_vectors(grams[a:b])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ROWS texts and CHARS characters, or one longer text."""
    a = 0
    while a < len(texts):
        b, n = a, 0
        while b < len(texts) and b - a < ROWS and (b == a or n + len(texts[b] or "") <= CHARS):
            n += len(texts[b] or "")
            b += 1
        yield a, b
        a = b


def _texts(column: pa.Array) -> list[str | None]:
    """Strings of a column of bytes; what is no UTF-8 is replaced."""
    return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = _texts(batch.column(0)), _texts(batch.column(1))
        for a, b in _groups(texts):
            v = vectors(texts[a:b])
            names, at = np.unique(langs[a:b], return_inverse=True)
            total = np.zeros((len(names), DIMENSIONS))
            np.add.at(total, at, v)
            for name, t in zip(names.tolist(), total, strict=True):
                sums[name] = sums[name] + t if name in sums else t
    sums = {k: v for k, v in sums.items() if v.any()}
    salt = TaskContext.get().partitionId() % _SALTS
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([salt] * len(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "salt", "vector"])


def _sum(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float64) for x in sorted(table.column("vector").to_pylist()))
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()], pa.string()), "vector": pa.array([total.tobytes()], pa.binary())})


def prototypes(labelled: DataFrame, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes, from the rows whose text and language aren't null."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    taught, summed = rows.mapInArrow(_train, "lang string, salt int, vector binary"), "lang string, vector binary"
    found = taught.groupBy("lang", "salt").applyInArrow(_sum, summed).groupBy("lang").applyInArrow(_sum, summed).limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    found.sort(key=lambda r: r["lang"])
    matrix = np.array([np.frombuffer(r["vector"], np.float64) for r in found]).reshape(-1, DIMENSIONS)
    return [r["lang"] for r in found], (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _predict(at: int, names: list[str], langs: list[str], matrix: np.ndarray):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = [], []
            texts = _texts(batch.column(at))
            for a, b in _groups(texts):
                v = vectors(texts[a:b])
                cosine = v @ matrix.T if langs else np.zeros((b - a, 1))
                top = cosine.argmax(axis=1)
                known = v.any(axis=1) & bool(langs)
                best += [langs[k] if ok else UNKNOWN for k, ok in zip(top.tolist(), known.tolist(), strict=True)]
                score += np.where(known, np.clip(cosine.max(axis=1), 0, 1), 0).astype(float).tolist()
            kept = [batch.column(k) for k in range(at)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(best, pa.string()), pa.array(score, pa.float64())], names=names)

    return predict


def language_id(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", train: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of docs (all by default) with lang_pred and score.

    Learns from the rows where ``train`` holds (all by default) and text and lang are not null. lang_pred is a learned
    language, or ``und`` where the text is null or has no letter, or nothing could be learned; score is the cosine,
    cut to 0 to 1 (0 for und). Equal cosines: the first language in order. Input columns named lang_pred or score
    (in any case) are replaced. Bytes that are no UTF-8 are no letters. Repeated ids: each row for itself. Empty input: no rows.
    """
    langs, matrix = prototypes(docs.where(train) if train is not None else docs, text_col, lang_col)
    keep = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in ("lang_pred", "score")]
    fields = [docs.schema[c] for c in keep]
    source = docs.select(*[column(c).alias(f"__{k}") for k, c in enumerate(keep)], F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(_predict(len(keep), [*keep, "lang_pred", "score"], langs, matrix), schema)
