"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of 32 words. A passage is described by the classes of its bytes and of neighbouring bytes and
by how its words look and repeat, encoded by one hidden layer, and weighted by a gated attention (a tanh times a sigmoid); the
document's score is logistic in the weighted mean of its passages' encodings. Only documents have labels: which passages
decide is learned with the rest. Fitting takes a bounded sample of the labelled rows; scoring streams over all
passages of every text with two running sums, so that a text of any length takes the same memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, written

#: Words of a passage, and bytes after which the next one begins at the latest (at a gap if there is one).
WORDS, BLOCK = 32, 1 << 16
#: Bytes that are described at once.
BYTES = 1 << 20
#: The fit's bounds: labelled rows, in seeded hash order, and bytes of their texts together.
SAMPLE, SAMPLE_BYTES = 4096, 16 << 20
HIDDEN, GATES, STEPS, BAGS, SEED = 24, 12, 1500, 64, 5

#: Classes of bytes: 0 gap, 1 line end, then letters, figures and kinds of marks; all else is the last one.
CLASSES = (b" \t\r\v\f", b"\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b".!?", b",;:", b"'\"()[]{}", b"|/\\", b"#$%&*+=<>@^~_`-")
KINDS = len(CLASSES) + 1
SHAPES = 12
FEATURES = KINDS + KINDS * KINDS + SHAPES


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every byte its class and what it adds to its word's hash (marks and gaps nothing, capitals as small letters), and multipliers by place."""
    kind = np.full(256, KINDS - 1, np.uint8)
    for k, members in enumerate(CLASSES):
        kind[np.frombuffer(members, np.uint8)] = k
    value = np.arange(256, dtype=np.uint64)
    value[65:91] += 32
    value[~np.isin(kind, (2, 3, 4, 5))] = 0
    place = np.random.default_rng(SEED).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
    return kind, value, place


def _blocks(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > BLOCK:
        end = max(text.rfind(b" ", at, at + BLOCK), text.rfind(b"\n", at, at + BLOCK))
        end = end if end > at else at + BLOCK
        yield text[at:end]
        at = end
    yield text[at:]


def passages(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of the blocks, a row each, and the block of each; a block without a word is one passage of zeros."""
    kind_of, value_of, place_of = _tables()
    data = np.frombuffer(b"\n".join([*blocks, b""]), np.uint8)
    kind = kind_of[data]
    size = np.array([len(b) + 1 for b in blocks])
    owner = np.repeat(np.arange(len(blocks)), size)
    solid = kind > 1
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    start = np.flatnonzero(begins)
    ends = ~solid
    ends[1:] &= solid[:-1]
    ends[:1] = False
    length = np.flatnonzero(ends) - start
    if not len(start):
        return np.zeros((len(blocks), FEATURES), np.float32), np.arange(len(blocks))
    block = owner[start]
    first = np.searchsorted(block, np.arange(len(blocks)))
    number = (np.arange(len(start)) - first[block]) // WORDS
    head = np.ones(len(start), bool)
    head[1:] = (block[1:] != block[:-1]) | (number[1:] != number[:-1])
    passage = np.cumsum(head) - 1
    n = int(passage[-1]) + 1
    owner_of = block[head]
    words = np.bincount(passage, minlength=n).astype(np.float64)

    # every byte from a passage's first word to the next one's belongs to it
    edge = start[head]
    belongs = np.repeat(np.arange(n), np.diff(np.append(edge, len(data))))
    inside = kind[edge[0] :].astype(np.int64)
    single = np.bincount(belongs * KINDS + inside, minlength=n * KINDS).reshape(n, KINDS)
    pair = np.bincount(belongs[1:] * KINDS**2 + inside[:-1] * KINDS + inside[1:], minlength=n * KINDS**2).reshape(n, KINDS**2)
    total = np.maximum(single.sum(axis=1, keepdims=True), 1)

    # words by a hash of their letters
    every = np.arange(len(data))
    at = every - np.maximum.accumulate(np.where(begins, every, 0))
    name = np.add.reduceat(value_of[data] * place_of[at % 64], start)
    letters = np.add.reduceat((value_of[data] > 0).astype(np.int64), start)
    same = np.zeros(len(start), bool)
    same[1:] = (name[1:] == name[:-1]) & ~head[1:]
    order = np.lexsort((name, passage))
    fresh = np.ones(len(start), bool)
    fresh[1:] = (name[order][1:] != name[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    run = np.flatnonzero(fresh)
    count = np.diff(np.append(run, len(start)))
    most = np.zeros(n)
    np.maximum.at(most, passage[order][run], count)
    mean = lambda x: np.bincount(passage, x, n) / words
    last = kind[start + length - 1]
    long = mean(length)
    shapes = [mean(same), np.bincount(passage[order], fresh, n) / words, most / words, np.log1p(long), np.sqrt(np.maximum(mean(length.astype(np.float64) ** 2) - long**2, 0)) / (1 + long), mean(kind[start] == 3), mean(last == 6), mean(last == 7), mean(last >= 9), mean(letters == 0), mean((letters > 0) & (letters < length)), np.log1p(words)]
    out = np.concatenate([single / total, np.sqrt(pair / total), np.stack(shapes, axis=1)], axis=1).astype(np.float32)
    blank = np.setdiff1d(np.arange(len(blocks)), owner_of)
    return np.concatenate([out, np.zeros((len(blank), FEATURES), np.float32)]), np.concatenate([owner_of, blank])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Parameters by name; the attention's logits are bounded by the sum of its weights, so their exponentials need no shift."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        draw = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        self.p = {"W": draw(len(mean), HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATES), "U": draw(HIDDEN, GATES), "w": draw(GATES, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "d": np.zeros(1)}

    def encode(self, x: np.ndarray):
        p = self.p
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return z, h, t, s, np.exp(np.clip((t * s) @ p["w"], -60, 60))

    def score(self, weighted: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return _sigmoid(weighted / np.maximum(weight, 1e-300)[:, None] @ self.p["c"] + self.p["d"][0])

    def gradient(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, decay: float = 1e-4) -> dict[str, np.ndarray]:
        """Of the mean log loss of bags; bag numbers are sorted and none is missing."""
        p = self.p
        z, h, t, s, e = self.encode(x)
        at = np.flatnonzero(np.diff(bag, prepend=-1))
        weight = np.add.reduceat(e, at)
        a = e / weight[bag]
        mean = np.add.reduceat(a[:, None] * h, at)
        g = (_sigmoid(mean @ p["c"] + p["d"][0]) - y) / len(y)
        back = (g[:, None] * p["c"])[bag]
        # through the attention: each passage's pull against its bag's mean
        logit = a * ((h - mean[bag]) * back).sum(axis=1)
        gate = logit[:, None] * p["w"]
        gt, gs = gate * s * (1 - t**2), gate * t * s * (1 - s)
        gh = (a[:, None] * back + gt @ p["V"].T + gs @ p["U"].T) * (1 - h**2)
        out = {"W": z.T @ gh, "b": gh.sum(axis=0), "V": h.T @ gt, "U": h.T @ gs, "w": (t * s).T @ logit, "c": mean.T @ g, "d": np.array([g.sum()])}
        return {k: v + decay * p[k] for k, v in out.items()}


def fit(bags: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Model:
    """Adam over batches of bags, step sizes falling to zero; the same bags in the same order give the same model."""
    everything = np.concatenate(bags).astype(np.float64)
    model = Model(everything.mean(axis=0), np.maximum(everything.std(axis=0), 1e-3))
    r = np.random.default_rng(seed)
    share = np.clip(labels.mean(), 0.01, 0.99)
    model.p["d"][0] = np.log(share / (1 - share))
    m, v = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))
    order, done = np.zeros(0, int), 0
    while done < steps:
        while len(order) < BAGS:
            order = np.append(order, r.permutation(len(bags)))
        some, order = order[:BAGS], order[BAGS:]
        x, bag = np.concatenate([bags[k] for k in some]).astype(np.float64), np.repeat(np.arange(len(some)), [len(bags[k]) for k in some])
        done += 1
        rate = 0.01 * (1 - (done - 1) / steps)
        for k, g in model.gradient(x, bag, labels[some]).items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            model.p[k] -= rate * (m[k] / (1 - 0.9**done)) / (np.sqrt(v[k] / (1 - 0.999**done)) + 1e-8)
    return model


def _grouped(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Passages of all texts, some BYTES at a time, and the text of each."""
    held, whose, size = [], [], 0
    for k, text in enumerate(texts):
        for block in _blocks(text or b""):
            held.append(block)
            whose.append(k)
            size += len(block)
            if size >= BYTES:
                x, of = passages(held)
                yield x, np.array(whose)[of]
                held, whose, size = [], [], 0
    if held:
        x, of = passages(held)
        yield x, np.array(whose)[of]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            bag = np.concatenate([x for x, _ in _grouped([batch.column(2)[k].as_py()])])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([bag.tobytes()], pa.binary())], names=["place", "label", "bag"])


def learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model | float:
    """The model, or the constant score where no two labels differ (0.5 without any).

    Of the different (id, text, label) it takes the first ``sample`` in seeded hash order whose texts have ``sample_bytes`` together; one
    that does not fit is passed over. What is fitted does not depend on partitions.
    """
    right = labels.select(column(id_col).alias("__id"), column(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    text = F.coalesce(column(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(column(id_col).alias("doc"), F.xxhash64(text).alias("digest"), text.alias("text"))
    # texts stay where they are: hashes and sizes meet the labels, and the sample, at most that many rows, goes to the texts
    marks = rows.select("doc", "digest", F.octet_length("text").alias("size")).join(right, F.col("doc") == F.col("__id")).dropDuplicates(["doc", "digest", "label"])
    order = [F.xxhash64("doc", F.lit(SEED)), F.col("doc"), F.col("digest"), F.col("label")]
    sizes = written(marks.select("doc", "digest", "size", "label").orderBy(*order).limit(sample).withColumn("place", F.monotonically_increasing_id()))
    left, chosen = sample_bytes, {}
    for r in sizes.orderBy("place").collect():
        if r["size"] <= left:
            left -= r["size"]
            chosen[r["place"]] = r["label"]
    if len(set(chosen.values())) < 2:
        return float(next(iter(chosen.values()), 0.5))
    some = sizes.where(F.col("place").isin(list(chosen))).withColumnRenamed("digest", "__digest").withColumnRenamed("doc", "__doc")
    some = rows.join(F.broadcast(some), (F.col("doc") == F.col("__doc")) & (F.col("digest") == F.col("__digest"))).select("place", "label", "text").dropDuplicates(["place"])
    rows = some.mapInArrow(_bags, "place long, label int, bag binary").collect()
    rows.sort(key=lambda r: r["place"])
    return fit([np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows], np.array([r["label"] for r in rows], np.float64))


def _score(at: int, names: list[str], model: Model | float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            out = np.full(n, model if isinstance(model, float) else 0.0)
            if not isinstance(model, float):
                weighted, weight = np.zeros((n, HIDDEN)), np.zeros(n)
                for x, of in _grouped(batch.column(at).to_pylist()):
                    _, h, _, _, e = model.encode(x)
                    np.add.at(weighted, of, e[:, None] * h)
                    np.add.at(weight, of, e)
                out = model.score(weighted, weight)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(at)), pa.array(out, pa.float64())], names=names)

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """docs with ``score``, the estimated chance (0 to 1) that a document's label is 1; the text alone decides it.

    Learns from the rows where ``train`` holds (all by default) that have a label of 0 or 1; several labels of an id each count, a repeated one once.
    A null text counts as empty; empty and blank texts are one passage without words and score as the model says. Without
    labels every score is 0.5, with one kind of label it is that label. Bytes that are no UTF-8 are letters. Repeated rows are each
    scored; an empty table has no rows. An input column named score (in any case) is replaced.
    """
    model = learned(docs.where(train) if train is not None else docs, labels, id_col, text_col, label_col)
    keep = [c for c in docs.columns if c.lower() != "score"]
    source = docs.select(*[column(c).alias(f"__{k}") for k, c in enumerate(keep)], column(text_col).cast("binary").alias("__text"))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(_score(len(keep), [*keep, "score"], model), schema)
