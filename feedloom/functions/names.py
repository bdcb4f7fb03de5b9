"""Names inside texts: an automaton over a table of names, which every text passes once whatever the number of names.

Up to a checked size the names go to every task with the code. Larger tables are cut into shards by a hash of the name, texts into buckets,
and each shard meets each bucket in one group: neither side passes the driver, and a group holds a bounded part of both.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names, and their characters, that are held by one task at a time; bytes of text that meet a shard in one group.
NAMES_AT_ONCE, NAME_CHARS, TEXT_BYTES = 200_000, 8_000_000, 32 << 20

Find = Callable[["pa.Table"], Callable[[pa.Table], pa.Table]]


def automaton(names: list[str]) -> ahocorasick.Automaton | None:
    """Yields, run over a text, the number of every name that ends at each place; None without names."""
    found = ahocorasick.Automaton()
    for k, n in enumerate(names):
        if n:
            found.add_word(n, k)
    if not len(found):
        return None
    found.make_automaton()
    return found


def search(texts: DataFrame, names: DataFrame, find: Find, schema: str, text_col: str, name_col: str, at_once: int = NAMES_AT_ONCE) -> tuple[DataFrame, int]:
    """What find(names)(texts) gives for all texts and all names, and in how many shards a text has met the names.

    find must be able to work on any part of either table; its rows come once for each shard.
    """
    size = names.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(name_col)), F.lit(0)).alias("c")).first()
    if size["n"] <= at_once and size["c"] <= NAME_CHARS:
        held = names.toArrow()

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = find(held)
            for b in batches:
                yield from ready(pa.Table.from_batches([b])).to_batches()

        return texts.mapInArrow(whole, schema), 1
    shards = max(-(-size["n"] // at_once), -(-size["c"] // NAME_CHARS))
    buckets = 1 + texts.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0] // TEXT_BYTES
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = texts.withColumn("__bucket", F.pmod(F.xxhash64(*texts.columns), F.lit(buckets)).cast("int")).withColumn("__shard", every(shards))
    right = names.withColumn("__shard", F.pmod(F.xxhash64(name_col), F.lit(shards)).cast("int")).withColumn("__bucket", every(buckets))

    def part(a: pa.Table, b: pa.Table) -> pa.Table:
        return find(b.drop_columns(["__shard", "__bucket"]))(a.drop_columns(["__shard", "__bucket"]))

    return left.groupBy("__shard", "__bucket").cogroup(right.groupBy("__shard", "__bucket")).applyInArrow(part, schema), shards


def contained(texts: DataFrame, names: DataFrame, text_col: str, name_col: str, at_once: int = NAMES_AT_ONCE) -> DataFrame:
    """(text, name) for every different text and every different name that stands in it, exactly as written.

    Null and empty names stand in nothing, a null text holds none; an empty table on either side gives no rows.
    """

    def find(table: pa.Table):
        known = table.column("name").to_pylist()
        machine = automaton(known)

        def rows(some: pa.Table) -> pa.Table:
            texts_, hits = [], []
            for t in some.column("text").to_pylist():
                for k in sorted({k for _, k in machine.iter(t)}) if machine else ():
                    texts_.append(t)
                    hits.append(known[k])
            return pa.table({"text": pa.array(texts_, pa.string()), "name": pa.array(hits, pa.string())})

        return rows

    left = texts.select(F.col(text_col).alias("text")).where("text IS NOT NULL").distinct()
    right = names.select(F.col(name_col).alias("name")).where("name <> ''").distinct()
    return search(left, right, find, "text string, name string", "text", "name", at_once)[0]


#: What parts words, letters a single word has at least, letters from which a name counts inside other words.
PARTS, SHORTEST, INSIDE = re.compile(r"""[\s,.!?;:(){}'"\[\]-]+"""), 3, 5

_CITY = "id string, digest long, rows int, kind int, words int, place int, at long, name string, city string, state string"


class _Cities:
    """The rules of a text's city for one table of (name, city, state, variant, first, at)."""

    def __init__(self, table: pa.Table) -> None:
        rows = sorted(table.to_pylist(), key=lambda r: (r["at"], r["name"]))
        self.exact: dict[str, dict] = {}
        inside: dict[str, tuple[int, dict]] = {}
        for r in rows:
            self.exact.setdefault(r["name"], r)
            kind = -1 if r["first"] else 1 if r["variant"] else 2
            if (kind < 2 or len(r["name"]) >= INSIDE) and (r["name"] not in inside or kind < inside[r["name"]][0]):
                inside[r["name"]] = kind, r
        self.inside = list(inside.values())
        self.machine = automaton([r["name"] for _, r in self.inside])
        self.heads = {n: {x.split(" ")[0] for x in self.exact if x.count(" ") == n - 1} for n in (2, 3)}

    def whole(self, words: list[str]) -> tuple | None:
        hits = {w for w in self.exact.keys() & set(words) if len(w) >= SHORTEST}
        if hits:
            place = next(k for k, w in enumerate(words) if w in hits)
            return 0, 1, place, self.exact[words[place]]
        for n in (2, 3):
            if self.heads[n]:
                for k in range(len(words) - n + 1):
                    if words[k] in self.heads[n] and (r := self.exact.get(" ".join(words[k : k + n]))):
                        return 0, n, k, r
        return None

    def best(self, text: str) -> tuple | None:
        found = {k for _, k in self.machine.iter(text)} if self.machine else ()
        part = min(((kind, 0, 0, r) for kind, r in (self.inside[k] for k in found)), key=lambda x: (x[0], x[3]["at"], x[3]["name"]), default=None)
        if part and part[0] < 0:
            return part
        return self.whole([w for w in PARTS.split(text) if w]) or part


def _cities(table: pa.Table):
    rules = _Cities(table)

    def rows(some: pa.Table) -> pa.Table:
        found = [rules.best(t) or (None, None, None, None) for t in some.column("text").to_pylist()]
        own = [[f[k] for f in found] for k in range(3)] + [[f[3][c] if f[3] else None for f in found] for c in ("at", "name", "city", "state")]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string())
        columns = [some.column("id"), some.column("digest"), pa.array([1] * len(found), pa.int32()), *(pa.array(x, t) for x, t in zip(own, kinds, strict=True))]
        return pa.table(columns, names=["id", "digest", "rows", "kind", "words", "place", "at", "name", "city", "state"])

    return rows


def detect_city(docs: DataFrame, names: DataFrame, id_col: str, text_col: str, at_once: int = NAMES_AT_ONCE) -> DataFrame:
    """(id, city, state) of each row: names marked ``first`` anywhere in the text, then whole one- to three-word names (fewer words
    first, then the earliest), then names of cities that have several spellings, then all names of five letters and more, inside words.

    names is a table of name (in lower case), city, state, variant (of a city with several spellings) and perhaps first and at, the
    order among names that are inside; without it they go by their letters. Null text: no city.
    """
    if "first" not in names.columns:
        names = names.withColumn("first", F.lit(False))
    if "at" not in names.columns:
        names = names.withColumn("at", F.lit(0))
    known = names.where("name <> ''").select("name", "city", "state", F.coalesce("variant", F.lit(False)).alias("variant"), F.coalesce("first", F.lit(False)).alias("first"), F.coalesce(F.col("at").cast("long"), F.lit(0)).alias("at"))
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    kind = docs.schema[id_col].dataType
    found, shards = search(docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text).alias("digest"), text.alias("text")), known, _cities, _CITY, "text", "name", at_once)
    if shards > 1:
        # a row has come once from each shard: the best of its finds counts, and rows that are alike stay as many as they were
        rank = F.when(F.col("kind").isNotNull(), F.struct("kind", "words", "place", "at", "name"))
        found = found.groupBy("id", "digest").agg(F.min_by("city", rank).alias("city"), F.min_by("state", rank).alias("state"), F.sum("rows").alias("rows"))
        found = found.withColumn("__copy", F.explode(F.sequence(F.lit(1), (F.col("rows") / shards).cast("int"))))
    return found.select(F.col("id").cast(kind).alias(id_col), "city", "state")
