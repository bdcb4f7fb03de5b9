"""Vector codes, source divergence and the quality classifier against plain Python versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from feedloom.llm import divergence, quality, quantise
from feedloom.llm import queries as q

VECTORS = "VEC_ID long, vec_id_ string, embedding array<float>, label int, code string, error string"


def plain_codes(vectors, parts=16, entries=64, rounds=2):
    """(code, error) of vectors in order of their ids, and the codebooks."""
    whole = [[math.floor(256 * x) for x in v] for v in vectors]
    width = len(whole[0]) // parts
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for v in whole[:entries]] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda a, book: min(range(len(book)), key=lambda k: (distance(a, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in whole:
                own[nearest(part(v, p), books[p])].append(part(v, p))
            for k, some in own.items():
                books[p][k] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    out = []
    for v in whole:
        code = [nearest(part(v, p), books[p]) for p in range(parts)]
        out.append(("".join(f"{c:02x}" for c in code), sum(distance(part(v, p), books[p][c]) for p, c in enumerate(code))))
    return out, books


def test_codes_equal_plain(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in (r.normal(0, 0.1, 32) + (i % 5) * 0.3).astype(np.float32)], i % 3 if i % 4 else None) for i in range(150)]
    rows += [(200 + i, rows[7][1], 1) for i in range(90)] + [(7, rows[8][1], 2), (None, rows[9][1], None)]
    odd = [(-5, None, 1), (-4, [None] + [0.0] * 31, 1), (-3, [float("nan")] * 32, 1), (-2, [float("inf")] * 32, 1)]
    spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = q.op11_vector_codes(spark, str(tmp_path)).collect()
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    want, books = plain_codes([x[1] for x in order])
    labels = Counter()
    for x, (_, e) in zip(order, want, strict=True):
        labels[x[2]] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted((tuple(x) for x in got), key=key) == sorted(((x[0], c, e, labels[x[2]], digest) for x, (c, e) in zip(order, want, strict=True)), key=key)


def test_codes_of_odd_vectors(spark):
    rows = [(1, None, [0.5] * 16, None, "x", "y"), (2, "b", [0.5] * 17, 3, "x", "y"), (3, "c", [], 3, "x", "y"), (4, "d", [0.25] * 16, 3, "x", "y")]
    out, books = quantise.vector_codes(spark.createDataFrame(rows, VECTORS), id_col="VEC_ID")
    got = {x["VEC_ID"]: (x["code"], x["error"], x["label_error"]) for x in out.collect()}
    assert got == {1: (bytes(16), 0, 0), 2: (None, None, 0), 3: (None, None, 0), 4: (bytes([1] * 16), 0, 0)}
    assert books.shape == (16, 2, 1)
    none, books = quantise.vector_codes(spark.createDataFrame([], VECTORS), id_col="VEC_ID")
    assert none.count() == 0 and books.size == 0
    uneven, _ = quantise.vector_codes(spark.createDataFrame([(1, None, [0.5] * 15, 1, "", "")], VECTORS), id_col="VEC_ID")
    assert [tuple(x) for x in uneven.collect()] == [(1, 1, None, None, None)]
    with pytest.raises(ValueError, match="not supported"):
        quantise.integers(np.array([1e9]), 4)


def test_bounds_skip_scans_and_change_nothing():
    r = np.random.default_rng(1)
    centres = r.integers(-2000, 2000, (12, 16))
    ints = centres[r.integers(0, 12, 4000)] + r.integers(-40, 40, (4000, 16))
    old = ints[:12].reshape(12, 4, 4).transpose(1, 0, 2).copy()
    new = old + r.integers(-25, 25, old.shape)
    new[:, 5] = new[:, 4]  # ties
    code, upper, lower, _, scanned = quantise.assign(ints, old)
    assert scanned == 4000 * 4
    kept, _, _, error, again = quantise.assign(ints, new, (code, upper, lower), quantise.moves(old, new))
    anew, _, _, same, _ = quantise.assign(ints, new)
    assert (kept == anew).all() and (error == same).all() and again < scanned * 0.8


DOCS = "doc_id long, text string, lang string, source string, LANG_ string, rank int"
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(rows, least=3, top=200):
    docs = [(TERM.findall((t or "").encode().lower()), lang or "", source or "") for _, t, lang, source in rows]
    df, total, own, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for words, lang, source in docs:
        groups[lang].add(source)
        df[lang].update(set(words))
        total[lang].update(words)
        own[lang, source].update(words)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept})(sum(c[t] for t in kept))  # noqa: B023, E731
        p, every = {s: share(own[lang, s]) for s in sources}, share(total[lang])
        for s in sources:
            gap = lambda x, y: (x - y) ** 2 // y
            pairs = sorted((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-gap(p[s][t], every[t]), t) for t in kept if own[lang, s][t] and p[s][t] > every[t])
            for part, found in (("pair", pairs), ("term", terms[:top])):
                out |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


@pytest.fixture(scope="module")
def source_rows():
    r = np.random.default_rng(9)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Éa", "日本", "don't", "A1b"]
    rows = []
    for i in range(240):
        lang, source = [("en", "hot"), ("en", f"s{i % 7}"), ("fr", f"s{i % 3}"), (None, None), ("en", "")][int(r.integers(0, 5))]
        rows.append((i, " ".join(vocab[int(k)] for k in np.minimum(r.geometric(0.02, int(r.integers(0, 90))), 303)), lang, source))
    return [*rows, (1, rows[1][1], "en", "hot"), (None, rows[2][1].upper(), "en", "hot"), (900, None, "en", "silent"), (901, "", "de", "only"), (902, "x y z", "pt", "a"), (903, "x", "pt", "b"), (904, "ab " * 3000, "en", "hot")]


def test_divergence_equals_plain(spark, source_rows):
    rows = [(*x, "clash", 7) for x in source_rows]
    got = divergence.source_divergence(spark.createDataFrame(rows, DOCS).repartition(6), top=20).collect()
    assert len(got) == len({tuple(x) for x in got}) and {tuple(x) for x in got} == plain_divergence(source_rows, top=20)


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(spark.createDataFrame([], DOCS)).count() == 0
    assert divergence.source_divergence(spark.createDataFrame([(1, None, None, None, None, None)], DOCS)).count() == 0
    two = divergence.source_divergence(spark.createDataFrame([(1, None, "en", "a", None, None), (2, "b c", "en", "b", None, None)], DOCS)).collect()
    assert {tuple(x) for x in two} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_terms_of_long_texts_and_many_slices(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 64)
    monkeypatch.setattr(divergence, "ENTRIES", 50)
    texts = [("alpha Beta gamma' " * k + f"own{chr(97 + k)}").encode() for k in range(26)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([b"en"] * 26), pa.array([b"s1", b"s2"] * 13), pa.array(list(range(26)))], names=["text", "lang", "source", "document"])
    records = pa.Table.from_batches(list(divergence._count(iter([batch.slice(0, 9), batch.slice(9)])))).to_pylist()
    df, n = Counter(), Counter()
    for x in records:
        df[x["term"]] += x["df"]
        n[x["term"]] += x["n"]
    assert df[b"beta"] == 25 and n[b"beta"] == sum(range(26)) and df[b"ownc"] == 1 and len(records) > len(df)


def test_runs_across_batches_and_pairs_in_blocks(monkeypatch):
    monkeypatch.setattr(divergence, "PAIRS", 10)
    monkeypatch.setattr(divergence, "SUMS", 5)
    rows = [(b"en", 1, s, p, 3) for s, p in ((b"a", 10), (b"b", 40), (b"c", 7), (b"d", 900))] + [(b"en", 2, b"b", 5, 3), (b"en", 2, b"d", 11, 3), (b"fr", 3, b"a", 8, 2)]
    table = pa.table({n: [x[k] for x in rows] for k, n in enumerate(("lang", "run", "source", "p", "zero"))})
    got = Counter()
    for batch in divergence._shared(iter(table.to_batches(max_chunksize=2))):
        for x in batch.to_pylist():
            got[x["lang"], x["source"], x["other"]] += x["v"]
    want, gap = Counter(), lambda x, y: (x - y) ** 2 // y
    for x in rows:
        for y in rows:
            if x[:2] == y[:2] and x[2] != y[2]:
                want[x[0], x[2], y[2]] += gap(x[3], y[3]) - gap(x[3], y[4]) - gap(x[4], y[3]) + gap(x[4], y[4])
    assert got == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_quality_of_held_out_documents(spark, sf):
    path = f"/root/testdata/{sf}"
    got = {x["doc_id"]: x for x in q.op13_quality_classifier(spark, path).collect()}
    truth = {x["doc_id"]: x["quality"] for x in spark.read.parquet(f"{path}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{path}/documents.parquet").count()
    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.3) for i, x in got.items())
    held = [i for i, x in got.items() if x["held_out"] and i in truth]
    assert sum(got[i]["predicted"] == truth[i] for i in held) >= 0.95 * len(held) and held


LABELS = "doc_id long, quality int, score string"


def test_quality_of_odd_rows(spark):
    good, bad = "a plain sentence of words, and more of them. " * 9, "w### w### x%%% | y*** y*** " * 9
    rows = [(i, good if i % 2 else bad, 1, 2) for i in range(60)] + [(100, None, 1, 2), (101, "", 1, 2), (102, " \n ", 1, 2), (1, good, 1, 2), (None, bad, 1, 2), (103, "é" * 200_000, 1, 2), (104, good * 3000, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, SCORE int, quality int").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, "") for i in range(60)] + [(3, 1, ""), (5, None, ""), (None, 1, ""), (7, 9, "")], LABELS)
    out = quality.quality_scores(docs, labels)
    assert out.columns == ["doc_id", "text", "quality", "score"]
    got = out.collect()
    score = {x["doc_id"]: x["score"] for x in got}
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got)
    assert all((score[i] >= 0.3) == bool(i % 2) for i in range(60)) and score[None] < 0.3 and score[104] >= 0.3
    assert score[100] == score[101] == score[102]
    assert {x["score"] for x in quality.quality_scores(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert {x["score"] for x in quality.quality_scores(docs, labels.where("doc_id < 0")).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_quality_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "word " * (10 * i)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.learned(docs, labels, "doc_id", "text", "quality", sample=30, sample_bytes=4000)
    assert isinstance(model, quality.Model)


def test_quality_gradient():
    r = np.random.default_rng(2)
    bags = [r.normal(0, 1, (int(n), 5)) for n in r.integers(1, 6, 8)]
    x, bag, y = np.concatenate(bags), np.repeat(np.arange(8), [len(b) for b in bags]), r.integers(0, 2, 8).astype(float)
    model = quality.Model(np.zeros(5), np.ones(5))

    def loss():
        _, h, _, _, e = model.encode(x)
        weighted, weight = np.zeros((8, quality.HIDDEN)), np.zeros(8)
        np.add.at(weighted, bag, e[:, None] * h)
        np.add.at(weight, bag, e)
        s = model.score(weighted, weight)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    grads = model.gradient(x, bag, y, decay=0.0)
    for name, p in model.p.items():
        at = tuple(int(r.integers(0, n)) for n in p.shape)
        held = p[at]
        p[at] = held + 1e-5
        up = loss()
        p[at] = held - 1e-5
        assert math.isclose((up - loss()) / 2e-5, grads[name][at], rel_tol=1e-3, abs_tol=1e-7), name
        p[at] = held


def test_passages_by_hand():
    x, of = quality.passages([b"One one two, THREE.", b"", b"a " * 40])
    assert of.tolist() == [0, 2, 2, 1] and not x[3].any()
    shapes = x[:, -quality.SHAPES :]
    assert np.allclose(shapes[0, :3], [1 / 4, 3 / 4, 2 / 4]) and np.allclose(shapes[1, :3], [31 / 32, 1 / 32, 1])
    assert [b"".join(quality._blocks(t)) == t for t in (b"", b"x" * 200_000, b"ab " * 60_000)] == [True] * 3


def test_shares_of_large_counts(spark):
    rows = [(n, n * 3 + 5, 7) for n in (0, 8_999_999_998, 8_999_999_999, 9_000_000_000, 10**15)]
    got = spark.createDataFrame(rows, "n long, whole long, v long").select("n", "whole", divergence.share("n", "whole").alias("p")).collect()
    assert all(x["p"] == 1 + 10**9 * (x["n"] + 1) // (x["whole"] + 7) for x in got) and len(got) == 5
