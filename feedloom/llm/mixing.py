"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A tree of columns (domain, language, source) has a token budget at its root. Every node shares its budget among
its children by weight; a child that cannot use its share (its supply times ``max_epochs``) leaves the rest to its
siblings, and only what all siblings together cannot use goes back to the level above. Since a node's limit is the
sum of its leaves' limits, this is one pass from the root down, each level a water-filling over sorted ratios. A leaf's
budget is spent on whole epochs of its rows, then on the prefix, by tokens, of one more epoch in a seeded order. The
prefix is found over 4096 parts of the order, and row by row only in the part where it ends, so that a leaf that holds
a third of all rows is never sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, written

NULL_KEY = "(null)"
#: Leaves up to which their plan is broadcast; beyond, Spark joins and splits what is skewed.
BROADCAST_LEAVES = 100_000


def _weight(keys: list[Column], weights: dict[tuple[str, ...], float], default: float) -> Column:
    table = [x for path, w in weights.items() for x in (F.lit("\x1f".join(path)), F.lit(float(w)))]
    return F.coalesce(F.try_element_at(F.create_map(*table), F.concat_ws("\x1f", *keys)) if table else F.lit(None).cast("double"), F.lit(float(default)))


def fill(df: DataFrame, parent: list[str], order: str) -> DataFrame:
    """budget of each child from its parent's, ``given``, its ``limit`` and ``weight``: sum(min(limit, level * weight)) = given."""
    ratio = F.when(F.col("weight") > 0, F.col("limit") / F.col("weight")).otherwise(F.lit(float("inf")))
    by = Window.partitionBy(*parent).orderBy("ratio", order)
    df = df.withColumn("ratio", ratio)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("given") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.nullif(F.sum("weight").over(rest), F.lit(0.0))
    df = df.withColumn("level", level)
    whole = Window.partitionBy(*parent)
    top = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole)
    df = df.withColumn("budget", F.when(top.isNull() | (F.col("ratio") <= top), F.when(F.col("weight") > 0, F.col("limit")).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), top * F.col("weight"))))
    return df.drop("ratio", "level")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[tuple[str, ...], float], total: float | None, share: float, max_epochs: int, default_weight: float) -> DataFrame:
    """Budgets of the leaves; leaves has the levels and ``supply``, the tokens there are."""
    df = leaves.withColumn("leaf_limit", F.col("supply") * F.lit(float(max_epochs)))
    everything = Window.partitionBy(F.lit(0))
    given = F.lit(float(total)) if total is not None else F.sum("supply").over(everything) * F.lit(float(share))
    df = df.withColumn("given", F.least(given.cast("double"), F.sum("leaf_limit").over(everything)))
    for k in range(len(levels)):
        parent, own = levels[:k], levels[: k + 1]
        node = df.groupBy(*own).agg(F.sum("leaf_limit").alias("limit"), F.first("given").alias("given"))
        node = node.withColumn("weight", _weight([F.col(c) for c in own], weights, default_weight))
        node = fill(node, parent or [F.lit(0)], levels[k]).select(*[F.col(c).alias(f"n{i}") for i, c in enumerate(own)], "budget")
        match = [F.col(c) == F.col(f"n{i}") for i, c in enumerate(own)]
        df = df.drop("given").join(node, match).drop(*[f"n{i}" for i in range(len(own))]).withColumnRenamed("budget", "given")
    return df.withColumnRenamed("given", "budget").drop("leaf_limit")


def mix_sources(docs: DataFrame, levels: dict[str, Column], weights: dict[tuple[str, ...], float], id_col: str = "doc_id", tokens: Column | None = None, total: float | None = None, share: float = 1.0, max_epochs: int = 4, default_weight: float = 1.0, seed: int = 17) -> DataFrame:
    """All rows of docs with mix_tokens, mix_epochs, mix_copies and leaf_budget.

    ``levels`` names the tree's levels, outermost first, and their expressions; ``weights`` maps paths of keys to
    weights among siblings, others have ``default_weight``; a weight of 0 gets nothing. ``total`` is the token budget, or
    ``share`` of all tokens. mix_epochs counts whole epochs, mix_copies adds one where the row is in the last epoch's
    prefix: rows go in while the tokens before them are fewer than what is left. Order: md5 of seed, epoch and id, then
    id; rows of equal id and tokens are taken together if their order allows. Tokens default to a quarter of the text's
    bytes, rounded up; null text: 0 tokens, never in a prefix of 0. Null keys form a child "(null)"; rows with a null id
    order last by an empty id. Repeated ids: each row for itself. Empty input: no rows.
    Input columns with the names above, in any case, are replaced.
    """
    tokens = tokens if tokens is not None else F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4)
    names = list(levels)
    hidden = [f"__l{i}" for i in range(len(names))]
    keys = [F.coalesce(e.cast("string"), F.lit(NULL_KEY)).alias(h) for h, e in zip(hidden, levels.values(), strict=True)]
    held = [c for c in docs.columns if c.lower() not in ("mix_tokens", "mix_epochs", "mix_copies", "leaf_budget")]
    names_in = [f"__c{k}" for k in range(len(held))]
    own_id = names_in[held.index(id_col)]
    base = docs.select(*[column(c).alias(i) for c, i in zip(held, names_in, strict=True)], tokens.cast("long").alias("mix_tokens"), *keys)
    rough = written(base.groupBy(*hidden).agg(F.sum("mix_tokens").cast("double").alias("supply")).where("supply > 0"))
    plan = leaf_budgets(rough, hidden, weights, total, share, max_epochs, default_weight)
    whole = F.floor(F.round(F.col("budget"), 6) / F.col("supply")).cast("int")
    small = written(plan.select(*hidden, "budget", whole.alias("mix_epochs"), F.floor(F.round(F.col("budget") - whole * F.col("supply"), 6)).cast("long").alias("left")))
    plan = F.broadcast(small) if small.count() <= BROADCAST_LEAVES else small

    def keyed(df: DataFrame) -> DataFrame:
        text = F.concat_ws(":", F.lit(str(seed)), F.col("mix_epochs").cast("string"), F.coalesce(F.col(own_id).cast("string"), F.lit("")))
        return df.withColumn("__order", F.md5(text.cast("binary"))).withColumn("__part", F.substring("__order", 1, 3))

    on = hidden
    ready = keyed(base.join(plan, on, "left"))
    parts = ready.where("mix_tokens > 0").groupBy(*hidden, "__part").agg(F.sum("mix_tokens").alias("n"), F.first("left").alias("left"))
    until = Window.partitionBy(*hidden).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(until), F.lit(0)))
    ends = parts.where("before < left").groupBy(*hidden).agg(F.max("__part").alias("__end"), F.max(F.struct("__part", "before"))["before"].alias("__before"))
    ends = written(ends)
    ready = ready.join(F.broadcast(ends) if ends.count() <= BROADCAST_LEAVES else ends, hidden, "left")
    inside = Window.partitionBy(*hidden, "__part").orderBy("__order", own_id, "mix_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = ready.where("__part = __end").withColumn("__in", F.col("__before") + F.coalesce(F.sum("mix_tokens").over(inside), F.lit(0)) < F.col("left"))
    clear = ready.where("__part <> __end or __end is null").withColumn("__in", F.coalesce(F.col("__part") < F.col("__end"), F.lit(False)))
    out = edge.unionByName(clear)
    return out.select(*[F.col(i).alias(c) for c, i in zip(held, names_in, strict=True)], "mix_tokens", F.coalesce("mix_epochs", F.lit(0)).alias("mix_epochs"), (F.coalesce("mix_epochs", F.lit(0)) + F.col("__in").cast("int")).alias("mix_copies"), F.round(F.coalesce("budget", F.lit(0.0)), 3).alias("leaf_budget"))
