"""Audit of how sources of a language differ in their words, by sorted runs.

Tasks count the terms of their documents by language and source (a record holds the documents of one slice, so that a
term that stands in all documents sends one record a slice). Records are dealt by language and term and sorted by
language, term, source and document; a run-length scan adds up equal neighbours and yields each kept term's counts
by source. With the sources' totals known, a second scan of the kept runs, sorted by source, yields partial sums for
every two sources that share a term; what a term adds where one or both sources lack it depends on the counts alone
and comes from a histogram of them. All arithmetic is on integers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, written

#: Terms of one document count to this many bytes at a time.
PIECE = 1 << 20
#: (language, source, term) entries of a slice.
ENTRIES = 1_000_000
#: Pairs of sources that are looked at together, and sums that are held in a task.
PAIRS, SUMS = 1 << 20, 200_000

#: Bytes that end a term: all of ASCII but its letters.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")

_RECORD = "lang binary, term binary, source binary, document long, df long, n long"
_RECORD_ARROW = pa.schema([("lang", pa.binary()), ("term", pa.binary()), ("source", pa.binary()), ("document", pa.int64()), ("df", pa.int64()), ("n", pa.int64())])


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end between terms."""
    at = 0
    while len(text) - at > PIECE:
        gap = GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


class _Slice:
    """Counts of a slice's documents: for each language and source the uses of a term and the documents that hold it."""

    def __init__(self) -> None:
        self.groups: dict[tuple[bytes, bytes], tuple[Counter, Counter, list]] = {}
        self.entries = 0

    def add(self, text: bytes, group: tuple[bytes, bytes], doc: int | None) -> None:
        uses, held, least = self.groups.setdefault(group, (Counter(), Counter(), []))
        own: set[bytes] = set()
        for piece in _pieces(text):
            words = TERM.findall(piece.lower())
            uses.update(words)
            own.update(words)
        before = len(held)
        held.update(own)
        self.entries += len(held) - before
        if doc is not None:
            least[:] = [min([doc, *least])]

    def records(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), (uses, held, least) in self.groups.items():
            terms = list(held)
            for a in range(0, len(terms), 50_000):
                some = terms[a : a + 50_000]
                same = lambda x, t: pa.repeat(pa.scalar(x, t), len(some))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(lang, pa.binary()), pa.array(some, pa.binary()), same(source, pa.binary()), same(least[0] if least else None, pa.int64()), pa.array([held[t] for t in some], pa.int64()), pa.array([uses[t] for t in some], pa.int64())], schema=_RECORD_ARROW)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Slice()
    for batch in batches:
        texts, langs, sources, ids = (batch.column(k) for k in range(4))
        for k in range(batch.num_rows):
            text = texts[k].as_py()
            if text:
                held.add(text, (langs[k].as_py(), sources[k].as_py()), ids[k].as_py())
            if held.entries >= ENTRIES:
                yield from held.records()
                held = _Slice()
    yield from held.records()


def _differs(table: pa.Table, names: list[str]) -> np.ndarray:
    """Where a row begins a run of equal values in the named columns."""
    out = np.zeros(table.num_rows, bool)
    out[:1] = True
    for n in names:
        c = table.column(n).combine_chunks()
        out[1:] |= pc.not_equal(c.slice(1), c.slice(0, max(len(c) - 1, 0))).to_numpy(zero_copy_only=False)
    return out


def _collapsed(table: pa.Table) -> pa.Table:
    """Neighbours of one language, term and source as one row."""
    at = np.flatnonzero(_differs(table, ["lang", "term", "source"]))
    sums = [pa.array(np.add.reduceat(table.column(c).to_numpy(), at)) for c in ("df", "n")]
    return pa.Table.from_arrays([*(table.column(c).take(pa.array(at)) for c in ("lang", "term", "source")), *sums], names=["lang", "term", "source", "df", "n"])


def _runs(least: int):
    """The run-length scan: rows of kept terms with the term's total and a number that the rows of a run share."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, place = 0, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40

        def kept(t: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal done
            at = np.flatnonzero(_differs(t, ["lang", "term"]))
            size = np.diff(np.append(at, t.num_rows))
            df, n = (np.add.reduceat(t.column(c).to_numpy(), at) for c in ("df", "n"))
            run = place + done + np.arange(len(at))
            done += len(at)
            rows = np.repeat(df >= least, size)
            out = pa.Table.from_arrays([t.column("lang"), t.column("term"), t.column("source"), pa.array(np.repeat(run, size)), pa.array(np.isin(np.arange(t.num_rows), at).astype(np.int64)), t.column("n"), pa.array(np.repeat(n, size))], names=["lang", "term", "source", "run", "begins", "n", "total"])
            yield from out.filter(pa.array(rows)).combine_chunks().to_batches(max_chunksize=50_000)

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch]).select(["lang", "term", "source", "df", "n"])
            held = _collapsed(pa.concat_tables([held, now]) if held else now)
            last = int(np.flatnonzero(_differs(held, ["lang", "term"]))[-1])
            if last:
                yield from kept(held.slice(0, last))
                held = held.slice(last)
        if held:
            yield from kept(held)

    return scan


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of what two sources' values differ by where they share a term, beyond what the histograms say."""
    sums: dict[tuple[int, int], int] = {}
    codes: dict[tuple[bytes, bytes], int] = {}
    names: list[tuple[bytes, bytes]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        keys = list(sums)
        if keys:
            a, b = ([names[k[j]] for k in keys] for j in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in a], pa.binary()), pa.array([x[1] for x in a], pa.binary()), pa.array([x[1] for x in b], pa.binary()), pa.array(list(sums.values()), pa.int64())], names=["lang", "source", "other", "v"])
        sums.clear()

    def add(code: np.ndarray, start: np.ndarray, size: np.ndarray, p: np.ndarray, zero: np.ndarray) -> None:
        a = 0
        ends = np.cumsum(size)
        while a < len(code):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
            count = size[a:b]
            one = np.repeat(np.arange(a, b), count)
            two = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[a:b], count)
            real = one != two
            one, two = one[real], two[real]
            x, y, x0, y0 = p[one], p[two], zero[one], zero[two]
            v = (x - y) ** 2 // y - (x - y0) ** 2 // y0 - (x0 - y) ** 2 // y + (x0 - y0) ** 2 // y0
            key, at = np.unique(code[one] << 32 | code[two], return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, v)
            for k, t in zip(key.tolist(), total.tolist(), strict=True):
                k = (k >> 32, k & 0xFFFFFFFF)
                sums[k] = sums.get(k, 0) + t
            a = b

    def take(whole: pa.Table) -> None:
        """Numbers the sources of whole runs and adds up their rows."""
        both = np.flatnonzero(_differs(whole, ["lang", "source"]))
        found = np.empty(len(both), np.int64)
        for k, g in enumerate(zip(*(whole.column(c).take(pa.array(both)).to_pylist() for c in ("lang", "source")), strict=True)):
            if g not in codes:
                codes[g] = len(names)
                names.append(g)
            found[k] = codes[g]
        code = np.repeat(found, np.diff(np.append(both, whole.num_rows)))
        at = np.flatnonzero(_differs(whole, ["run"]))
        size = np.diff(np.append(at, whole.num_rows))
        add(code, np.repeat(at, size), np.repeat(size, size), whole.column("p").to_numpy(), whole.column("zero").to_numpy())

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, now]) if held else now
        first = np.flatnonzero(_differs(held, ["run"]))
        whole, held = (held.slice(0, int(first[-1])), held.slice(int(first[-1]))) if len(first) > 1 else (None, held)
        if whole:
            take(whole)
        if len(sums) >= SUMS:
            yield from flush()
    if held:
        take(held)
    yield from flush()


#: 10^9 times a count can pass 64 bits; below that, machine words do.
_WIDE = "1 + CASE WHEN {n} < 9000000000 THEN ({n} + 1) * 1000000000L div ({all} + v) ELSE CAST(CAST({n} + 1 AS DECIMAL(20, 0)) * CAST(1000000000 AS DECIMAL(10, 0)) AS DECIMAL(38, 0)) div CAST({all} + v AS DECIMAL(20, 0)) END"


def share(n: str, all_: str) -> F.Column:
    """1 + floor(10^9 (n + 1) / (N + V)), the column v holding V."""
    return F.expr(_WIDE.format(n=n, all=all_))


def _gap(p: str, q: str) -> F.Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def source_divergence(docs: DataFrame, least: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from its others, and the terms by which it leaves the language.

    Terms are runs of letters (bytes over 127 are letters), A-Z lower-cased. A language keeps its terms that stand in at least
    ``least`` of its documents. A term has p = 1 + floor(10^9 (n + 1) / (N + V)) in a source and likewise q in what it is held against,
    n its uses there, N the uses of kept terms, V their number; it adds floor((p - q)^2 / q). Part ``pair``: every other source of
    the language with the sum over all kept terms; part ``term``: the ``top`` kept terms that the source uses and of which it has
    more than the language. Largest values first, ties by the item's bytes.

    Nulls in text, language and source count as empty strings; a group without a term has its rows all the same, with V = 0
    all values are 0. Every row is a document, also where ids repeat or are null. An empty table gives none. Other columns are not read.
    """
    text, lang, source = (F.coalesce(column(c).cast("string"), F.lit("")).cast("binary") for c in (text_col, lang_col, source_col))
    plain = docs.select(text.alias("text"), lang.alias("lang"), source.alias("source"), column(id_col).cast("long").alias("document"))
    # sorted first by a hash of language and term, one machine word, so that most comparisons never look at the strings
    records = plain.mapInArrow(_count, _RECORD).repartition("lang", "term").withColumn("__key", F.xxhash64("lang", "term"))
    records = records.sortWithinPartitions("__key", "lang", "term", "source", "document").drop("__key", "document")
    rows = written(records.mapInArrow(_runs(least), "lang binary, term binary, source binary, run long, begins long, n long, total long"))

    groups = docs.select(lang.alias("lang"), source.alias("source")).distinct()
    terms = rows.groupBy("lang").agg(F.sum("begins").alias("v"), F.sum("n").alias("all_of_lang"))
    used = rows.groupBy("lang", "source").agg(F.sum("n").alias("all_of_source"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    totals = groups.join(used, ["lang", "source"], "left").join(terms, "lang", "left").select("lang", "source", zero("all_of_source"), zero("v"), zero("all_of_lang"))
    totals = written(totals.withColumn("zero", F.when(F.col("v") > 0, F.expr(_WIDE.format(n="0L", all="all_of_source"))).otherwise(F.lit(1).cast("long"))))

    valued = rows.join(totals, ["lang", "source"]).withColumn("p", share("n", "all_of_source")).withColumn("q", share("total", "all_of_lang"))
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = valued.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap("p", "q").alias("value")).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)

    shared = valued.select("lang", "run", "source", "p", "zero").repartition("run").sortWithinPartitions("run", "source").mapInArrow(_shared, "lang binary, source binary, other binary, v long")
    big = lambda c: F.sum(c.cast("decimal(38,0)"))
    shared = shared.groupBy("lang", "source", "other").agg(big(F.col("v")).alias("shared"))
    # what a term adds where only one of two sources uses it follows from its p there and the other's value at no use
    histogram = valued.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    zeros = totals.select("lang", F.col("zero").alias("z")).distinct()
    alone = histogram.join(zeros, "lang").groupBy("lang", "source", "z")
    alone = written(alone.agg(big(F.col("terms").cast("decimal(20,0)") * _gap("p", "z").cast("decimal(19,0)")).alias("out"), big(F.col("terms").cast("decimal(20,0)") * _gap("z", "p").cast("decimal(19,0)")).alias("in"), F.sum("terms").alias("terms")))
    names = totals.select("lang", "source", "zero", "v")
    pairs = names.join(names.select("lang", F.col("source").alias("other"), F.col("zero").alias("z")), "lang").where("source <> other")
    pairs = pairs.join(alone.select("lang", "source", "z", "out", F.col("terms").alias("own_terms")), ["lang", "source", "z"], "left")
    pairs = pairs.join(alone.select("lang", F.col("source").alias("other"), F.col("z").alias("zero"), "in", F.col("terms").alias("other_terms")), ["lang", "other", "zero"], "left")
    pairs = pairs.join(shared, ["lang", "source", "other"], "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,0)")
    neither = (F.col("v") - F.coalesce("own_terms", F.lit(0)) - F.coalesce("other_terms", F.lit(0))).cast("decimal(20,0)")
    value = some("out") + some("in") + some("shared") + (neither * _gap("zero", "z").cast("decimal(18,0)")).cast("decimal(38,0)")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), value.cast("long").alias("value")).withColumn("rank", F.row_number().over(own))
    return pairs.unionByName(ranked).select(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "part", F.col("item").cast("string").alias("item"), "value", F.col("rank").cast("int").alias("rank"))
