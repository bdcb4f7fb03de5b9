"""Each operator against a plain Python version on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.llm import queries as q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_documents(n=60, seed=3):
    """Small vocabularies, shared passages, copies, near copies, runs, nulls, blanks, one long text."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)] + ["Éa", "ß.", "日本"]
    base = [[r.choice(vocab) for _ in range(r.randint(40, 200))] for _ in range(5)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.25:
            words = list(r.choice(base))
            for _ in range(r.randint(0, 6)):
                words[r.randrange(len(words))] = r.choice(vocab)
        elif kind < 0.5:
            b = r.choice(base)
            a = r.randrange(len(b))
            words = [r.choice(vocab) for _ in range(r.randint(0, 60))] + b[a : a + r.randint(30, 90)] + [r.choice(vocab) for _ in range(r.randint(0, 9))]
        elif kind < 0.6:
            words = ["ab"] * r.randint(1, 130)
        else:
            words = [r.choice(vocab) for _ in range(r.randint(0, 90))]
        rows.append((i, r.choice([" ", "\n", " \t "]).join(words), r.choice(["en", "fr", None]), r.choice(["src1", "src2", "x", None]), None))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "src1", 0), (n + 2, " \n ", "en", "src1", 3), (n + 3, " ".join(base[0] * 40).upper(), "en", "src1", 9)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("in"))
    spark.createDataFrame(plain_documents(), DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


def texts(docs_dir, spark):
    return {r["doc_id"]: (r["text"] or "") for r in spark.read.parquet(f"{docs_dir}/documents.parquet").collect()}


def plain_cut(t, window, join):
    """What is left of token lists when windows that a smaller id holds go; also the number of runs removed."""
    first = {}
    for i in sorted(t):
        for k in range(len(t[i]) - window + 1):
            first.setdefault(bytes(t[i][k : k + window]) if isinstance(t[i], bytes) else tuple(t[i][k : k + window]), i)
    out = {}
    for i, x in t.items():
        gone = [False] * len(x)
        for k in range(len(x) - window + 1):
            if first[bytes(x[k : k + window]) if isinstance(x, bytes) else tuple(x[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        left = [w for w, g in zip(x, gone) if not g]
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(x), sum(gone), runs, hashlib.sha256(join(left)).hexdigest())
    return out


def test_substring_dedup(spark, docs_dir):
    want = plain_cut({i: t.encode().split() for i, t in texts(docs_dir, spark).items()}, 50, b" ".join)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in q.op1_substring_dedup(spark, docs_dir).collect()}
    assert got == {i: (n, m, s) for i, (n, m, _, s) in want.items()}
    assert sum(m for _, m, _ in got.values()) > 500


def test_suffix_dedup(spark, docs_dir):
    want = plain_cut({i: t.encode() for i, t in texts(docs_dir, spark).items()}, 50, bytes)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in q.op3_suffix_dedup(spark, docs_dir).collect()}
    assert got == want
    assert sum(x[1] for x in got.values()) > 1000


def test_merged_transforms():
    """Three shards' transforms, each made by itself, against all suffixes sorted; only transforms go into the merge."""
    from feedloom.llm.suffix import merged, transforms

    r = random.Random(5)
    for length in (3, 7, 20):
        shards, strings = [], []
        for _ in range(3):
            texts = [bytes(r.choice(b"ab\x00\xff") for _ in range(r.randint(length, 40))) for _ in range(r.randint(1, 9))]
            texts += [b"a" * 40, texts[0]]
            bwt, first = transforms(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), np.zeros(len(texts), np.int64))
            assert first.tolist() == [0, len(bwt)] and (bwt == 0).sum() == len(texts)
            shards.append((bwt, np.array([len(t) for t in texts])))
            strings += [t[i : i + length] if i + length <= len(t) else None for t in texts for i in range(len(t) + 1)]
        owner = np.array([r.randrange(4) for _, size in shards for _ in size])
        place, interval = merged(shards, owner, length)
        whose = [int(o) for o, t in zip(owner, [t for _, size in shards for t in size]) for _ in range(int(t) + 1)]
        held = defaultdict(set)
        for i, x in enumerate(strings):
            held[x].add(whose[i])
        want = {i for i, x in enumerate(strings) if x is not None and len(held[x]) > 1}
        assert set(place.tolist()) == want and len(place) == len(want) and want
        found = [strings[i] for i in place.tolist()]
        assert found == sorted(found)
        assert len(set(zip(found, interval.tolist()))) == len(set(found)) == len(set(interval.tolist()))


def test_transforms_of_groups_stand_alone():
    from feedloom.llm.suffix import transforms

    texts, group = [b"banana", b"ananas", b"nab", b"banana"], np.array([0, 0, 1, 2])
    size = np.array([len(t) for t in texts])
    bwt, first = transforms(np.frombuffer(b"".join(texts), np.uint8), size, group)
    at = 0
    for g in range(3):
        own = [t for t, k in zip(texts, group) if k == g]
        alone, _ = transforms(np.frombuffer(b"".join(own), np.uint8), np.array([len(t) for t in own]), np.zeros(len(own), np.int64))
        assert (bwt[first[g] : first[g + 1]] == alone).all()
        at += len(alone)
    assert at == len(bwt)


def components(nodes, links):
    up = {i: i for i in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in nodes}


def plain_near(t, k, percent):
    sets = {}
    for i, x in t.items():
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in x.encode()).split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in components(sets, links).items()}


def test_ngram_jaccard_join(spark, docs_dir):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in q.op2_ngram_jaccard_join(spark, docs_dir).collect()}
    assert got == plain_near(texts(docs_dir, spark), 4, 85)
    assert len({c for _, c in got.values()}) < len(got)


def test_jaccard_blocks_and_frequent_shingles(spark, docs_dir, monkeypatch):
    from feedloom.llm import jaccard

    monkeypatch.setattr(jaccard, "CELL", 200)
    monkeypatch.setattr(jaccard, "PAIRS_UP_TO", 60)
    docs = spark.read.parquet(f"{docs_dir}/documents.parquet")
    for percent in (60, 85):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs, shingle=2, percent=percent).collect()}
        assert got == plain_near(texts(docs_dir, spark), 2, percent)


@pytest.fixture(scope="module")
def vectors_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors"))
    x = np.random.default_rng(1).standard_normal((600, 16)).astype(np.float32)
    x[100:160] = x[50]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(650, None, 0), (700, [0.0] * 16, 0), (750, [float("nan")] * 16, 0), (800, [None] * 16, 0), (850, [float("inf")] + [1.0] * 15, 0), (None, [1.0] * 16, 0), (900, [], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, x


def test_nearest_neighbours(spark, vectors_dir):
    path, x = vectors_dir
    got = defaultdict(list)
    for r in q.op4_nearest_neighbours(spark, path).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    y = x.astype(float)
    hit = total = 0
    assert sorted(got) == list(range(0, 600, 50))
    for i, found in got.items():
        s = (y @ y[i]) / np.linalg.norm(y, axis=1) / np.linalg.norm(y[i])
        s[i] = -9
        best = np.lexsort((np.arange(600), -np.round(s, 12)))[:5].tolist()
        hit += len(set(best) & {v for v, _ in found})
        total += 5
        assert all(abs(score - s[v]) < 1e-9 for v, score in found)
        assert found == sorted(found, key=lambda z: (-z[1], z[0])) and len(found) == 5
    assert hit / total >= 0.9
    assert [v for v, _ in got[50]] == [100, 101, 102, 103, 104]


def test_nearest_blocks(spark, vectors_dir, monkeypatch):
    from feedloom.llm import ann

    want = q.op4_nearest_neighbours(spark, vectors_dir[0]).collect()
    monkeypatch.setattr(ann, "BLOCK", 7)
    assert sorted(q.op4_nearest_neighbours(spark, vectors_dir[0]).collect()) == sorted(want)


def test_hamming_top_k(spark, vectors_dir):
    path, x = vectors_dir
    bits = x > 0
    got = defaultdict(list)
    for r in q.op7_hamming_top_k(spark, path).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["distance"], r["vec_id"]))
    codes = dict(enumerate(bits)) | {700: np.zeros(16, bool)}
    for i in [*range(0, 600, 50), 700]:
        assert got.pop(i) == sorted((int((codes[i] != b).sum()), j) for j, b in codes.items() if j != i)[:10]
    assert not got


def packed_pieces_are_whole(rows, want):
    """Every id in one piece, the library's ids in each, sequences without gaps and in document order."""
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = want[r["doc_id"]]
        part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert len(part) == 4 * r["length"] > 0 and zlib.crc32(part) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"], r["start"]))
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == {i: len(t) for i, t in want.items()}
    for p in (*pieces.values(), *seqs.values()):
        at = 0
        for x in sorted(p):
            assert x[0] == at
            at += x[1]
    for s in seqs.values():
        assert sum(x[1] for x in s) <= 2048
        order = [(d, b) for _, _, d, b in sorted(s)]
        assert order == sorted(order)


def test_packing(spark, docs_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: tok.encode(t, add_special_tokens=False).ids + [1] for i, t in texts(docs_dir, spark).items()}
    packed_pieces_are_whole(q.op5_packing(spark, docs_dir).collect(), want)


def test_packing_odd_texts(spark, tmp_path, monkeypatch):
    """Added tokens inside texts, null and repeated ids, texts longer than a piece, bytes of every kind, clashing columns."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from feedloom.llm import packing

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(9)
    odd = ["hello <|endoftext|> world", "x<|startoftext|><|endoftext|>y", "<|ENDOFTEXT|> a<|endoftext|>", "<|<|endoftext|>|>", "<|end oftext|>", "it's<|endoftext|>'s", "é<|endoftext|>\u0301 x", "", None, " \n", "\u2028a\u00a0b\u3000c", "İ ΑΣ ß ﬁ"]
    odd += ["".join(chr(r.choice([r.randrange(1, 128), r.randrange(128, 0x500), r.randrange(0x2000, 0x3100), r.randrange(0x1F300, 0x1F600)])) for _ in range(r.randrange(200))) for _ in range(60)]
    odd += [" ".join(r.choice(["word", "other.", "end!", "<|endoftext|>"]) for _ in range(20_000))]
    rows = [(i, t, 5, "x") for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Length int, sequence_id string").repartition(3)
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(odd)}
    monkeypatch.setattr(packing, "PIECE", 5_000)
    path = public_tokenizers.path("word_bpe_49k.json")
    packed_pieces_are_whole(packing.pack_documents(docs, path).collect(), want)
    same = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "c d e"), (3, "c d e"), (3, None)], "doc_id long, text string")
    got = Counter((x["doc_id"], x["start"], x["length"], x["doc_tokens"]) for x in packing.pack_documents(same, path).collect())
    assert got == {(None, 0, 3, 3): 2, (3, 0, 4, 4): 2, (3, 0, 1, 1): 1}


def test_windows_are_optimal():
    from feedloom.llm.packing import boundaries, windows

    r = np.random.default_rng(2)
    for _ in range(40):
        n, length = int(r.integers(1, 120)), int(r.integers(3, 30))
        ends = r.random(n) < 0.2
        docs = np.flatnonzero(r.random(n) < 0.1) + 1
        at, cost = boundaries(ends, docs, length)
        best = [0.0]
        for j in range(1, len(at)):
            best.append(min(best[i] + length - (at[j] - at[i]) + cost[j] for i in range(j) if at[j] - at[i] <= length))
        cuts = windows(at, cost, length)
        place = dict(zip(at.tolist(), cost.tolist(), strict=True))
        assert best[-1] == sum(length - (b - a) + place[b] for a, b in zip([0, *cuts.tolist()], cuts.tolist()))


def test_lm_scoring(spark, docs_dir):
    t = texts(docs_dir, spark)
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in t}
    words = {i: [*bytes(c + 32 if 65 <= c <= 90 else c for c in x.encode()).split(), None] for i, x in t.items()}
    c = Counter(w for i in t if not held[i] for w in words[i])
    n, v = sum(c.values()), len(c)
    for r in q.op6_lm_scoring(spark, docs_dir).collect():
        w = words[r["doc_id"]]
        base = sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert np.isfinite(r["score"]) and r["score"] < 0


def plain_ppm(trained, order):
    """Probabilities by a plain trie of dictionaries."""
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for x in trained:
        s = b"\xff" * order + x + b"\xff"
        for k in range(order, len(s)):
            for o in range(order + 1):
                counts[o][s[k - o : k]][s[k]] += 1

    def probability(context, symbol):
        seen, p = set(), 1.0
        for o in range(order, -1, -1):
            c = {k: n for k, n in counts[o][context[order - o :]].items() if k not in seen}
            total = sum(c.values())
            whole = len(seen | set(c)) == 256
            if symbol in c:
                return p * (c[symbol] / total if whole else (2 * c[symbol] - 1) / (2 * total))
            seen |= set(c)
            p *= len(c) / (2 * total) if c else 1
        return p / (256 - len(seen))

    def score(x):
        s = b"\xff" * order + x + b"\xff"
        return sum(np.log10(probability(s[k - order : k], s[k])) for k in range(order, len(s)))

    return score


def test_ppm_rows_sum_to_one(spark, docs_dir):
    from feedloom.llm import ppm

    model = ppm.trained(spark.read.parquet(f"{docs_dir}/documents.parquet").select("doc_id", "text"), 3)
    shortest, _, tokens, kinds = ppm.summary(model)
    seen = 0
    for r in model.where("kind = 0").collect():
        part = ppm.Part(*ppm._unpacked(r["counts"], np.uint64, np.int64), shortest)
        context = np.unique(np.concatenate([part.levels[0][0][::7] >> np.uint64(8), np.array([0x6162636465, 0xFFFFFFFFFF], np.uint64)]))
        assert np.allclose((10.0 ** part.rows(context)).sum(axis=1), 1)
        seen += len(context)
    assert seen > 100 and tokens > kinds > 50


def test_ppm_cache_and_parts_hold_all_counts():
    from feedloom.llm import ppm

    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 2**63, 5000).astype(np.uint64))
    cache = ppm.Cache(keys, np.arange(len(keys), dtype=float))
    value, hit = cache.get(np.concatenate([keys, keys + np.uint64(2**63)]))
    assert hit[: len(keys)].mean() > 0.8 and not hit[len(keys) :].any()
    assert (value[: len(keys)][hit[: len(keys)]] == np.flatnonzero(hit)).all()
    assert not ppm.Cache(np.zeros(0, np.uint64), np.zeros(0)).get(keys)[1].any()
    some = r.integers(-9, 2**40, 77)
    assert all((a == b).all() for a, b in zip(ppm._unpacked(ppm._packed(some, some.astype(np.int32)), np.int64, np.int32), (some, some.astype(np.int32))))


def test_language_id(spark, sf_dir):
    rows = q.op9_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_cases(spark):
    from feedloom.llm.langid import language_id

    rows = [(1, "the cat and the dog", "en", 1.0), (2, "le chat et le chien", "fr", 1.0), (3, None, "en", 1.0), (4, "123 !?", "fr", 1.0), (5, "et le chat", None, 1.0), (None, "日本語" * 3000, "ja", 1.0)]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")).collect()}
    assert got == {1: "en", 2: "fr", 3: "und", 4: "und", 5: "fr", None: "ja"}


def test_url_filters(spark, tmp_path):
    link = '<html><link href="{}" rel="canonical"></html>'
    pages = [
        (1, "https://a.org/x?u=1#f", link.format("https://m.net/es/1")),
        (2, "https://b.org/y", '<meta http-equiv="refresh" content="0; url=https://a.org/x?u=1">'),
        (3, "https://M.Net/es/1", None),
        (4, "https://c.org/z", link.format("//www.example.com/en/1")),
        (5, "https://d.org/", link.format("https://c.org/z")),
        (6, "https://example.com/en/q", link.format("https://m.net/es/1")),
        (7, "https://www.example.com/en/", ""),
        (8, None, link.format("https://m.net/es/1")),
        (9, "no scheme", "canonical"),
        (10, "https://xnet/es/", ""),
        (11, "https://c.org/z", ""),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in q.op8_url_filters(spark, str(tmp_path)).collect()}
    assert got == {
        1: ("a.org", "/x", None, "block"), 2: ("b.org", "/y", None, "block"), 3: ("m.net", "/es/1", "net/es/", "block"), 4: ("c.org", "/z", None, "allow"),
        5: ("d.org", "/", None, "allow"), 6: ("example.com", "/en/q", "example.com/en/", "block"), 7: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("xnet", "/es/", None, "allow"), 11: ("c.org", "/z", None, "allow"),
    }


def test_mixing_budgets(spark, docs_dir):
    rows = q.op10_source_mixing(spark, docs_dir).collect()
    assert len(rows) == 64
    leaves = defaultdict(lambda: [0.0, 0, 0, 0])
    for r in rows:
        x = leaves[(r["lang"], r["source"])]
        x[0], x[1], x[2], x[3] = r["leaf_budget"], x[1] + r["mix_tokens"], x[2] + r["mix_tokens"] * r["mix_copies"], max(x[3], r["mix_tokens"])
    for budget, supply, spent, longest in leaves.values():
        assert budget <= 2 * supply + 1e-6 and budget - 1 <= spent <= budget + longest
    assert abs(sum(x[0] for x in leaves.values()) - 0.8 * sum(x[1] for x in leaves.values())) < 0.1


def test_components(spark):
    from feedloom.llm.common import connected_components

    r = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(99), r.randrange(99)) for _ in range(60)] + [(200, x) for x in range(201, 240)] + [(5, None), (7, 7)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    assert got == components({x for e in real for x in e}, real)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert q.QUERIES[name](spark, empty_dir).count() == 0


LONG = " ".join(f"word{k % 9973} and{k % 17}" for k in range(330_000))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null and repeated ids, bytes that are no UTF-8, texts over a slice, ties, columns that clash with outputs and helpers in any case."""
    rows = [(i, t, lang, src) for i, (t, lang, src) in enumerate([("a b c d e", "en", "src1"), ("", "en", "src1"), (None, None, None), (" \n\t", "fr", None), ("a b c d e", "en", "src1"), ("%bad%", "en", "src2"), ("été " * 80, "fr", "src2"), (LONG, "en", "src1"), (LONG, "en", "src1")])]
    rows += [(None, "a b c d e", "en", "src1"), (None, None, None, None), (6, "été " * 80, "fr", "src2"), (0, "other words here", "en", "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df = df.withColumn("text", F.when(F.col("text") == "%bad%", F.expr("cast(unhex('66FF20C32820" + "61FE20" * 70 + "') as string)")).otherwise(F.col("text")))
    clash = ["N_Words", "kept_text", "n_bytes", "Removed_Spans", "mix_Tokens", "budget", "left", "weight", "__text", "__id", "__found", "__key", "__0", "a.b", "score", "Lang_Pred", "held_out", "component_id", "length", "start", "n", "id"]
    for k, c in enumerate(clash):
        df = df.withColumn(c, F.lit(k))
    path = str(tmp_path_factory.mktemp("odd"))
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    return spark.read.parquet(f"{path}/documents.parquet"), path


def as_bytes(df):
    return [(r["doc_id"], bytes(r["b"]) if r["b"] is not None else None) for r in df.select("doc_id", F.col("text").cast("binary").alias("b")).collect()]


def test_odd_documents_are_cut(spark, odd):
    from feedloom.llm.substring import substring_dedup
    from feedloom.llm.suffix import suffix_dedup

    docs, _ = odd
    held = as_bytes(docs)
    for out, size, made in ((substring_dedup(docs), lambda b: len(b.split()), 4), (suffix_dedup(docs), len, 4)):
        assert len(out.columns) == len(set(c.lower() for c in out.columns)) and {"a.b", "__key", "budget"} <= set(out.columns)
        got = Counter((r["doc_id"], r[2], r[3]) for r in out.select("doc_id", "lang", out.columns[-4], out.columns[-3]).collect())
        # only the second long text repeats 50 words or bytes of a smaller document; rows of one id are one document
        assert got == Counter((i, size(b or b""), size(b) if i == 8 else 0) for i, b in held)
    kept = {r["doc_id"]: bytes(r["k"]) for r in substring_dedup(docs).select("doc_id", F.col("kept_text").cast("binary").alias("k")).collect()}
    assert kept[5] == dict(held)[5].strip() and kept[8] == b""


def test_odd_documents_are_compared_and_scored(spark, odd):
    from feedloom.llm import jaccard, langid, mixing, packing, ppm

    docs, path = odd
    held = as_bytes(docs)
    near = Counter((r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect())
    assert near == Counter((i, {4: 0, 8: 7}.get(i, i)) for i, _ in held if i is not None)
    lang = langid.language_id(docs)
    assert lang.count() == len(held) and len({c.lower() for c in lang.columns}) == len(lang.columns)
    assert {r["doc_id"]: r["lang_pred"] for r in lang.where("doc_id in (1, 3, 7)").collect()} == {1: "und", 3: "und", 7: "en"}
    scored = ppm.score_documents(docs, F.col("doc_id") == 4).collect()
    assert Counter(r["doc_id"] for r in scored) == Counter(i for i, _ in held if i is not None)
    assert len({round(r["score"], 9) for r in scored if r["doc_id"] == 0}) == 2 and all(np.isfinite(r["score"]) for r in scored)
    assert {r["n_tokens"] for r in scored if r["doc_id"] == 7} == {len(LONG.split()) + 1}
    mixed = mixing.mix_sources(docs, **q.mix_arguments())
    assert mixed.count() == len(held) and {"budget", "left", "weight", "a.b"} <= set(mixed.columns)
    spent = {(r["doc_id"], r["mix_tokens"]): r["mix_copies"] for r in mixed.collect()}
    assert spent[(None, 0)] == 0 and {t for (i, t) in spent if i == 7} == {-(-len(LONG) // 4)}
    import public_tokenizers

    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == Counter(i for i, _ in held)
    assert all(sum(r["length"] for r in pieces if r["doc_id"] == i) == next(r["doc_tokens"] for r in pieces if r["doc_id"] == i) for i in (1, 5, 7, 8))


def test_odd_documents_go_through_the_pipeline(spark, odd):
    import corpus_pipeline as p

    docs, path = odd
    rows = docs
    for name, stage in p.STAGES[:-1]:
        rows = stage(spark, rows, path)
        assert rows.columns == docs.columns, name
        rows = p.written(rows)
    assert p.packed(spark, rows, path).where("doc_id = 7").count() > 0
    assert sorted(r["doc_id"] for r in p.by_language(spark, docs, path).where("doc_id is not null").collect()) == [0, 0, 4, 5, 6, 6, 7, 8]
    none = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, none, path).count() == 0
    untaught = docs.withColumn("lang", F.lit(None).cast("string"))
    assert p.by_language(spark, untaught, path).count() == p.by_language(spark, docs, path).count()


def test_foreign_text_is_dropped(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    foreign = docs.limit(2).withColumns({"doc_id": F.col("doc_id") + 10**9, "text": F.lit("日本語の文章はここにあります。" * 20), "lang": F.lit(None).cast("string")})
    kept = p.by_language(spark, docs.unionByName(foreign), sf_dir)
    assert kept.where("doc_id >= 1000000000").count() == 0 and kept.count() == docs.where("text rlike '\\\\p{L}'").count()


def test_pipeline_equals_plain_stages(spark, docs_dir):
    """run() as a whole: three stages in plain Python, the mixing by its SQL, the packing by the tokenizers' library."""
    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    docs = spark.read.parquet(f"{docs_dir}/documents.parquet").collect()
    t = {r["doc_id"]: r for r in docs if r["text"] is not None and any(c.isalpha() for c in r["text"])}
    t = {i: t[i] for i, (_, c) in plain_near({i: r["text"] for i, r in t.items()}, 5, 80).items() if c == i}
    words = {i: r["text"].encode().split() for i, r in t.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    left = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        left[i] = b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else t[i]["text"]
    import pandas as pd

    documents = pd.DataFrame({"doc_id": list(left), "text": list(left.values()), "lang": [t[i]["lang"] for i in left], "source": [t[i]["source"] for i in left]})
    con = duckdb.connect()
    con.register("documents", documents)
    copies = {r[0]: r[1] for r in con.sql(f"SELECT doc_id, mix_copies FROM ({q.ORACLE_SQL['op10_source_mixing']})").fetchall()}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter({i: n * (len(tok.encode(left[i], add_special_tokens=False).ids) + 1) for i, n in copies.items() if n})
    got = Counter()
    for r in p.run(spark, docs_dir).collect():
        got[r["doc_id"]] += r["length"]
        ids = tok.encode(left[r["doc_id"]], add_special_tokens=False).ids + [1]
        assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
    assert got == want and len(left) < len(docs) and any(n > 1 for n in copies.values())


def test_pipeline_sends_bounded_batches(spark, docs_dir):
    """Rows go to Python by bytes, whatever a session's default lets through; a bound that the session has stays."""
    import pyarrow as pa

    import corpus_pipeline as p

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["bytes", "rows"])

    key, read, docs = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize", spark.read.parquet(f"{docs_dir}/documents.parquet")
    wide = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))
    try:
        for name, stage in p.STAGES:
            for k in (key, read):
                spark.conf.unset(k)
            stage(spark, docs, docs_dir)
            assert int(spark.conf.get(read)) <= 512, name
            got = wide.mapInArrow(sizes, "bytes long, rows long").collect()
            assert sum(r["rows"] for r in got) == 3000 and max(r["bytes"] for r in got) < 8_000_000, name
        spark.conf.set(key, "1m")
        p.by_language(spark, docs, docs_dir)
        assert spark.conf.get(key) == "1m"
    finally:
        for k in (key, read):
            spark.conf.unset(k)


def test_tokenizer_keeps_a_bounded_number_of_words():
    """Also within one text; ids stay the library's."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from feedloom.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    ours, text = packing.WordTokenizer(path), " ".join(f"Word{k}a the" for k in range(250_000))
    got = ours(text.encode()).tolist()
    assert got == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert len(ours.kept) <= 200_000
    assert ours(b"the Word7a").tolist() == ours.library.encode("the Word7a", add_special_tokens=False).ids and len(ours.kept) <= 200_000


def test_repeated_ids_with_different_texts(spark):
    from feedloom.llm.substring import substring_dedup
    from feedloom.llm.suffix import suffix_dedup

    long = " ".join(f"x{k}" for k in range(70))
    rows = spark.createDataFrame([(1, long), (2, "short"), (2, "head " + long), (2, None), (None, long)], "doc_id long, text string")
    none = [(None, 0), (1, 0), (2, 0), (2, 0)]
    for out, gone in ((suffix_dedup(rows), len(long)), (substring_dedup(rows), 70)):
        assert sorted(((r["doc_id"], r["n_removed"]) for r in out.collect()), key=str) == sorted([*none, (2, gone)], key=str)


@pytest.mark.parametrize("up_to, extended", [(400, 4), (40, 4), (8, 1), (8, 40)])
def test_jaccard_entries_meet(monkeypatch, up_to, extended):
    """Any two sets that link have an entry in common: all frequent, all rare or mixed, over the borders of classes."""
    from feedloom.llm import jaccard

    monkeypatch.setattr(jaccard, "PAIRS_UP_TO", up_to)
    monkeypatch.setattr(jaccard, "EXTENDED", extended)
    assert [jaccard.size_class(n) for n in (up_to, up_to + 1, 2 * up_to, 2 * up_to + 1, 4 * up_to, 4 * up_to + 1)] == [0, 1, 1, 2, 2, 3]
    r = random.Random(3)
    for often in (0.0, 0.7, 1.0):
        for _ in range(120):
            percent = r.choice([55, 80, 85, 95])
            union = [r.getrandbits(50) | ((1 << 56) * r.randint(1, 9) if r.random() < often else 0) for _ in range(r.randint(3, 2 * max(up_to, 60)))]
            both = -(-percent * len(union) // 100)
            a = union[:both] + [x for x in union[both:] if r.random() < 0.5]
            b = union[:both] + [x for x in union[both:] if x not in a]
            x, y = (np.array(sorted(set(z)), np.uint64) for z in (a, b))
            if min(len(x), len(y)) < 2 or 100 * both < percent * len(set(a) | set(b)):
                continue
            assert np.isin(jaccard.entries(x, percent), jaccard.entries(y, percent)).any()


def test_jaccard_refuses_low_percentages(spark):
    from feedloom.llm.jaccard import near_duplicates

    docs = spark.createDataFrame([(1, "a"), (2, "a b")], "doc_id long, text string")
    for percent in (50, 0, 101):
        with pytest.raises(ValueError):
            near_duplicates(docs, shingle=1, percent=percent)
    assert {r["component_id"] for r in near_duplicates(docs, shingle=1, percent=51).collect()} == {1, 2}


def test_jaccard_large_group_of_near_copies(spark):
    """Hundreds of near copies that share entries with a second group, equal copies over slices, null and repeated ids."""
    from feedloom.llm.jaccard import near_duplicates

    r = random.Random(12)
    base = [[f"w{r.randrange(10**6)}" for _ in range(60)] for _ in range(2)]
    rows = []
    for i in range(400):
        w = list(base[i % 2])
        for _ in range(r.randint(0, 5)):
            w[r.randrange(60)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(400 + i, rows[0][1]) for i in range(150)] + [(None, rows[0][1]), (600, None), (600, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates(docs, shingle=3, percent=70).collect()}
    want = plain_near({i: t or "" for i, t in rows if i is not None}, 3, 70)
    assert got == {i: c for i, (_, c) in want.items()} and len(set(want.values())) > 2


@pytest.mark.parametrize("told", [1 << 21, 3])
def test_jaccard_shared_phrase_makes_no_group(spark, monkeypatch, told):
    """A phrase of many documents that the sketch calls rare is frequent in the next drawing; whatever is told, links are kept."""
    from feedloom.llm import jaccard

    monkeypatch.setattr(jaccard, "ALL_OF", 64)
    monkeypatch.setattr(jaccard, "FREQUENT", 10**9)
    monkeypatch.setattr(jaccard, "TOLD", told)
    seen, drawn = [], jaccard._drawn

    def spied(index, percent, last, stars):
        stars, heavy = drawn(index, percent, last, stars)
        seen.append((max([r["n"] for r in stars.groupBy("b").agg(F.count("*").alias("n")).collect()] or [0]) + 1, len(heavy), last))
        return stars, heavy

    monkeypatch.setattr(jaccard, "_drawn", spied)
    r = random.Random(31)
    phrase = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(240):
        own = [f"w{r.randrange(10**9)}" for _ in range(r.randint(90, 170))]
        at = r.randrange(len(own))
        rows.append((i, " ".join([*own[:at], *phrase, *own[at:]])))
    for i in range(0, 60, 3):
        w = rows[i][1].split()
        w[r.randrange(len(w))] = "changed"
        rows.append((240 + i, " ".join(w)))
    # near copies of one text, more of them than are compared at once, stay together
    base = [f"b{i}" for i in range(120)]
    rows += [(400 + i, " ".join(["x%d" % i if j == i % 120 else w for j, w in enumerate(base)])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.near_duplicates(docs, shingle=4, percent=85).collect()}
    assert got == plain_near(dict(rows), 4, 85)
    assert seen[0][1] and len(seen) > 1
    if told > 3:
        assert not seen[-1][2] and max(n for n, _, _ in seen) <= 152


def test_jaccard_and_language_sums_in_two_steps(spark, docs_dir, monkeypatch):
    from feedloom.llm import jaccard, langid

    docs = spark.read.parquet(f"{docs_dir}/documents.parquet").repartition(5)
    source = docs.select(F.col("doc_id").alias("id"), "text")
    found = []
    for salts in (1, 3):
        monkeypatch.setattr(jaccard, "_SALTS", salts)
        monkeypatch.setattr(langid, "_SALTS", salts)
        found.append((jaccard.frequency_classes(source, 4), langid.prototypes(docs, "text", "lang")))
    assert (found[0][0] == found[1][0]).all() and found[0][1][0] == found[1][1][0]
    assert np.allclose(found[0][1][1], found[1][1][1], atol=1e-6)


def test_jaccard_index_entries_survive_packing():
    from feedloom.llm import jaccard

    r = np.random.default_rng(5)
    key, code = r.integers(0, 2**63, 4).astype(np.uint64), np.array([7, 0, 65535, 9], np.uint16)
    of, token = np.array([0, 0, 2, 3, 3, 3]), r.integers(0, 2**63, 6).astype(np.uint64)
    t, f, c = jaccard._unpack(pa.py_buffer(jaccard._pack(token, of, key, code)))
    assert (f == key[of]).all() and (c == code[of]).all()
    assert (t == token >> np.uint64(64 - 8 * jaccard.ENTRY_BYTES)).all()


@pytest.mark.parametrize("pairs_of, all_of", [(64, 5_000), (1, 5_000), (1, 2)])
def test_jaccard_bucket_keeps_every_link(monkeypatch, pairs_of, all_of):
    from feedloom.llm import jaccard

    monkeypatch.setattr(jaccard, "PAIRS_OF", pairs_of)
    monkeypatch.setattr(jaccard, "ALL_OF", all_of)
    r, percent = random.Random(7), 80
    base = [r.sample(range(10**6), r.randint(20, 90)) for _ in range(6)]
    plain = [set(r.choice(base)) | set(r.sample(range(10**6), r.randint(0, 12))) for _ in range(60)]
    plain += [set(plain[0]), set(r.sample(range(10**6), 30))]
    sets = [np.sort(jaccard.mix(np.array(sorted(x), np.uint64)) >> np.uint64(8)) for x in plain]
    found = [jaccard.entries(t, percent) for t in sets]
    n = np.array([len(t) for t in sets])
    key, code = np.array([jaccard.mix(t).sum() for t in sets], np.uint64), np.floor(np.log(n) * jaccard.SIZE_STEPS).astype(np.uint16)
    of = np.repeat(np.arange(len(sets)), [len(x) for x in found])
    met = jaccard._meet(percent)(pa.table({"bucket": pa.array([3], pa.int32()), "entries": pa.array([jaccard._pack(np.concatenate(found), of, key, code)], pa.binary())}))
    at = {int(k): i for i, k in reversed(list(enumerate(key.view(np.int64))))}
    on = [at[f] for f in met.column("f").to_pylist()]
    table = pa.table({"id": pa.array(on, pa.int64()), "n": pa.array(n[on]), "bits": pa.array([jaccard.bitmap(sets[i], percent) for i in on], pa.binary()), "shared": met.column("shared"), "colour": pa.array(on, pa.int64())})
    stars = jaccard._prune(percent)(table)
    got = components(range(len(plain)), list(zip(stars.column("a").to_pylist(), stars.column("b").to_pylist(), strict=True)))
    # with the colours of what is connected nothing is said again; with those of half of it, the rest
    for known in (got, {i: got[i] if i % 2 else i for i in got}):
        again = jaccard._prune(percent)(table.set_column(table.schema.get_field_index("colour"), "colour", pa.array([known[i] for i in on], pa.int64())))
        links = list(zip(again.column("a").to_pylist(), again.column("b").to_pylist(), strict=True))
        assert components(range(len(plain)), [*links, *known.items()]) == got and (known is not got or not links)
    links = [(i, j) for i in set(on) for j in set(on) if i < j and 100 * len(plain[i] & plain[j]) >= percent * len(plain[i] | plain[j])]
    assert len(links) > 20 and all(got[i] == got[j] for i, j in links)
    apart = {at[int(k)] for k in key.view(np.int64)} - set(on)
    assert all(100 * len(plain[i] & plain[j]) < percent * len(plain[i] | plain[j]) for i in apart for j in at.values() if i != j)


@pytest.mark.parametrize("cached, held", [(1 << 19, 4_000_000), (64, 4_000_000), (0, 10)])
def test_ppm_matches_a_plain_trie_whatever_is_cached(spark, monkeypatch, cached, held):
    """Also far more contexts than the cache takes, counts passed on early, repeated and null ids, texts met in training or not."""
    from feedloom.llm import ppm

    monkeypatch.setattr(ppm, "CACHED", cached)
    monkeypatch.setattr(ppm, "HELD", held)
    r = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows = [(i, " ".join(r.choice(letters) + r.choice(letters) + "a" + r.choice("xyz") for _ in range(100))) for i in range(20)]
    rows += [(3, rows[5][1]), (4, rows[4][1]), (50, "日本 " + rows[7][1][:90]), (51, None), (52, "Zq " * 30 + "€"), (None, "not taken"), (53, "")]
    taken = [(i, (x or "").encode()) for i, x in rows if i is not None]
    score = plain_ppm([x for i, x in taken if i < 50], ppm.ORDER)
    words = lambda x: [*bytes(c + 32 if 65 <= c <= 90 else c for c in x).split(), None]
    c = Counter(w for i, x in taken if i < 50 for w in words(x))
    n, v = sum(c.values()), len(c)
    want = sorted((i, i >= 50, len(words(x)), sum(c[w] > 0 for w in words(x)), n, sum(np.log10((c[w] + 1) / (n + v + 1)) for w in words(x)), score(x)) for i, x in taken)
    docs = spark.createDataFrame([(i, x, 1.0, True) for i, x in rows], "doc_id long, text string, Score double, held_out boolean").repartition(3)
    got = sorted(tuple(x) for x in ppm.score_documents(docs, F.col("doc_id") >= 50).collect())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)
    untaught = ppm.score_documents(docs, F.lit(True)).where("doc_id = 53").first()
    assert np.isclose(untaught["score"], -np.log10(256)) and untaught["train_tokens"] == 0 and untaught["base_score"] == 0


def test_ppm_beats_the_unigram_base_on_held_out_text(spark):
    """Bits over whole texts; the base pays nothing for the white space between words and for case, the model does."""
    out = q.op6_lm_scoring(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert out["s"] > out["b"]


def test_high_symbols_reveal_long_repeats(spark, monkeypatch):
    """A repeat of 5,000 words is found by high symbols: what the low ones still look for is its ends."""
    from feedloom.llm import substring, textcore as tc

    r = random.Random(6)
    word = lambda: f"w{r.randrange(3000)}"
    passage = [word() for _ in range(5000)]
    t = [[word() for _ in range(700)] + passage + [word() for _ in range(90)], [word() for _ in range(33)] + passage + [word() for _ in range(400)], passage[100:700], ["x"] * 3000, ["y"] + ["x"] * 2500]
    rows = [(i, " ".join(x)) for i, x in enumerate(t)]
    want = plain_cut({i: x.encode().split() for i, x in rows}, 50, b" ".join)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], hashlib.sha256(x["kept_text"].encode()).hexdigest()) for x in substring.substring_dedup(docs).collect()}
    assert got == {i: (n, m, s) for i, (n, m, _, s) in want.items()}
    buf = np.frombuffer("\n".join(x for _, x in rows).encode(), np.uint8)
    off = np.append(0, np.cumsum([len(x) + 1 for _, x in rows]) - (np.arange(len(rows)) == len(rows) - 1))
    start, end, bounds = tc.words(buf, off)
    name, words, first, size = substring.spans(tc.word_hashes(buf, start, end), bounds, 50)
    row = np.searchsorted(bounds, first, side="right") - 1
    both = np.isin(name, name[row == 0]) & np.isin(words, words[row == 0]) & (row == 1)
    _, at, windows = substring.covered(row[both], first[both], size[both])
    assert len(at) <= 8 and windows.sum() > 4000 and both.sum() < 400


@pytest.mark.parametrize("hot", [16, 2])
def test_hot_phrases_are_spread(spark, monkeypatch, hot):
    """A phrase of 30 words in hundreds of documents, each in other surroundings, some of them shared; slices with many and with one."""
    from feedloom.llm import substring

    monkeypatch.setattr(substring, "HOT", hot)
    r = random.Random(8)
    word = lambda: f"w{r.randrange(10**6)}"
    phrase, before, after = [word() for _ in range(30)], [[word() for _ in range(30)] for _ in range(4)], [[word() for _ in range(30)] for _ in range(4)]
    t = {}
    for i in range(300):
        a = r.choice(before) if r.random() < 0.3 else [word() for _ in range(30)]
        b = r.choice(after) if r.random() < 0.3 else [word() for _ in range(30)]
        t[i * 11 % 301] = a + phrase + b
    want = {i: (n, m, s) for i, (n, m, _, s) in plain_cut({i: " ".join(x).encode().split() for i, x in t.items()}, 50, b" ".join).items()}
    rows = spark.createDataFrame([(i, " ".join(x)) for i, x in t.items()], "doc_id long, text string")
    docs = rows.where("doc_id < 3").repartition(3).union(rows.where("doc_id >= 3").coalesce(1))
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], hashlib.sha256(x["kept_text"].encode()).hexdigest()) for x in substring.substring_dedup(docs).collect()}
    assert got == want and sum(m for _, m, _ in got.values()) > 1000


def test_covered_runs():
    from feedloom.llm.substring import covered

    r = random.Random(2)
    runs = [(r.randrange(3), r.randrange(200), r.randint(1, 9)) for _ in range(60)]
    doc, at, n = covered(*(np.array(c) for c in zip(*runs)))
    want = {(d, a + k) for d, a, m in runs for k in range(m)}
    got = [(d, a + k) for d, a, m in zip(doc.tolist(), at.tolist(), n.tolist()) for k in range(m)]
    assert len(got) == len(set(got)) and set(got) == want
    assert all(d != e or a + m < b for (d, a, m), (e, b, _) in zip(zip(doc, at, n), list(zip(doc, at, n))[1:]))


@pytest.mark.parametrize("pair", [(721, 223654), (85080, 105278)])
def test_windows_with_half_a_hash_in_common_are_not_repeats(spark, pair):
    """Windows under one key whose hashes agree in their upper 32 bits only."""
    from feedloom.llm.substring import substring_dedup

    rows = [(i, f"n{k} " + " ".join(f"t{j}" for j in range(49))) for i, k in enumerate(pair)]
    docs = spark.createDataFrame([*rows, (2, rows[0][1])], "doc_id long, text string").repartition(3)
    assert sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup(docs, window=50).collect()) == [(0, 0), (1, 0), (2, 50)]


def test_nearest_rows_are_filled(spark, monkeypatch):
    """Opposite vectors, and an outlier before copies in few buckets: all candidates, or k."""
    from feedloom.llm import ann

    monkeypatch.setattr(ann, "BLOCK", 50)
    x = np.random.default_rng(8).standard_normal((40, 64))
    rows = [(2 * i + s, ((1 - 2 * s) * v).tolist()) for i, v in enumerate(x[:2]) for s in (0, 1)]
    few = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(r["query_id"] for r in ann.nearest(few, few, k=5).collect())
    assert got == {0: 3, 1: 3, 2: 3, 3: 3}
    copies = np.array([x[2]] * 120 + [x[3]] * 120)
    far = np.array([-x[2] - x[3], *-copies[::60], *x[4:]])
    y = np.concatenate([copies, far])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(copies)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(240 + i, v.tolist()) for i, v in enumerate(far)] + [(999, [1.0, 2.0])], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in ann.nearest(table, asked, k=5).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"]))
        s = y[r["query_id"]] @ y[r["vec_id"]] / np.linalg.norm(y[r["query_id"]]) / np.linalg.norm(y[r["vec_id"]])
        assert abs(s - r["score"]) < 1e-9
    assert sorted(found) == list(range(240, 240 + len(far)))
    for i in found:
        assert [r for r, _ in found[i]] == [1, 2, 3, 4, 5] and len({v for _, v in found[i]}) == 5
    many = few.unionByName(few.where("vec_id < 2").crossJoin(spark.range(9)).drop("id"))
    assert Counter(r["query_id"] for r in ann.nearest(many, few, k=5).collect()) == got


def test_nearest_on_the_table_and_odd_vectors(spark, tmp_path):
    """Recall on a whole table of the driver's; huge, tiny, repeated and differing rows of one id, clashing columns."""
    from feedloom.llm import ann

    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = defaultdict(set)
    for r in ann.nearest(rows, rows.where("vec_id % 50 = 0"), k=5).collect():
        got[r["query_id"]].add(r["vec_id"])
    held = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect() if r["embedding"]}
    ids, y = np.array(list(held)), np.stack(list(held.values()))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hit = total = 0
    for i, found in got.items():
        s = y @ y[np.flatnonzero(ids == i)[0]]
        s[ids == i] = -9
        hit, total = hit + len(found & set(ids[np.lexsort((ids, -s))[:5]].tolist())), total + 5
    assert total == 5 * sum(i % 50 == 0 for i in held) and hit / total >= 0.9
    odd = [(0, [1e300, 1e300], 1.0), (1, [1e-300, 1e-300], 2.0), (2, [1.0, 0.0], 3.0), (2, [0.0, 1.0], 3.0), (2, [1.0, 1.0], 3.0), (3, [-1e308, -1e308], 1.0), (4, [0.0, -0.0], 1.0), (5, [1.0], 1.0)]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<double>, score double")
    near = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 12)) for r in ann.nearest(df, df.where("vec_id in (0, 5)"), k=2).collect()}
    assert near == {(0, 1): (1, 1.0), (0, 2): (2, 1.0)}


def test_url_rules_as_a_table(spark):
    from feedloom.llm import urls

    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "x.com", "/a"), ("allow", "com", "/abc"), ("block", "com", "/abc")]
    names = ["example.com", "www.example.com", "a.www.example.com", "m.net", "net", "xnet", "x.com", "y.x.com", "com", ""]
    pages = [(i, f"http://{h}{p}" if h else None) for i, (h, p) in enumerate((h, p) for h in names for p in ("", "/", "/en/q", "/es/", "/abc", "/a?b"))]
    df = spark.createDataFrame([*pages, (None, "http://m.net/es/"), (0, pages[0][1])], "page_id long, url string")
    table = spark.createDataFrame(rules, "action string, host string, path string")
    a, b = (sorted(map(tuple, urls.filter_urls(df, r, html_col=None).collect()), key=str) for r in (rules, table))
    assert a == b and len(a) == len(pages) + 2 and sum(r[4] == "block" for r in a) > 5


def test_url_links_of_any_number_and_entities(spark):
    from feedloom.llm import urls

    pages = [(1, "https://a.org/1", '<link rel="canonical" href="https://b.org/?x=1&amp;y=2"><LINK REL=canonical HREF=https://c.org/z ><meta http-equiv=refresh content="0;url=/there">'), (2, "https://b.org/?x=1&y=2", None), (3, "https://m.net/es/1", '<link rel="canonical" href="https://c.org/z">')]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    edges = {(r["a"], r["b"]) for r in urls.alias_edges(df, "url", "html").collect()}
    assert edges == {("a.org/1", "b.org/?x=1&y=2"), ("a.org/1", "c.org/z"), ("a.org/1", "a.org/there"), ("m.net/es/1", "c.org/z")}
    assert [r["verdict"] for r in urls.filter_urls(df, [("block", "net", "/es/")]).orderBy("page_id").collect()] == ["block"] * 3


def test_sign_codes_refuse_longer_vectors(spark):
    from feedloom.llm.hamming import sign_code

    df = spark.createDataFrame([([1.0, -1.0, 0.0],), (None,), ([float("nan")],), ([],)], "v array<double>")
    assert [r["c"] for r in df.select(sign_code(F.col("v"), 3).alias("c")).collect()] == [1, None, None, None]
    with pytest.raises(Exception, match="length 3"):
        df.select(sign_code(F.col("v"), 2)).collect()


def plain_profiles(rows, texts):
    """Letter-trigram profiles by dictionaries and single vectors: language prototypes and each text's best cosine."""
    from feedloom.llm import langid as li

    def vector(t):
        line = "".join(chr(0) if unicodedata.category(c)[0] != "L" else c for c in (t or "").lower())
        classes = [0 if c == chr(0) else ord(c) % (li.LETTERS - 1) + 1 for c in chr(0) + line + chr(0)]
        classes = [c for k, c in enumerate(classes) if c or not k or classes[k - 1]]
        grams = Counter(tuple(classes[k : k + 3]) for k in range(len(classes) - 2))
        v = np.zeros(li.DIMENSIONS)
        for g, n in grams.items():
            bound = np.ones(li.DIMENSIONS)
            for k, c in enumerate(reversed(g)):
                bound *= li._items()[k][c]
            v += np.sqrt(n) * bound
        return v / (np.linalg.norm(v) or 1) if any(classes) else v * 0

    made = defaultdict(lambda: np.zeros(li.DIMENSIONS))
    for t, lang in rows:
        if t is not None and lang is not None:
            made[lang] += vector(t)
    names = sorted(k for k, v in made.items() if v.any())
    unit = np.stack([made[k] / np.linalg.norm(made[k]) for k in names])
    out = []
    for t in texts:
        v = vector(t)
        s = unit @ v
        out.append((names[int(s.argmax())], float(np.clip(s.max(), 0, 1))) if v.any() else ("und", 0.0))
    return out


def test_language_profiles_equal_plain_ones(spark):
    from feedloom.llm.langid import language_id

    r = random.Random(4)
    syllables = {"aa": ["ka", "to", "ri", "Éa"], "bb": ["sch", "ung", "ö", "ein"], "cc": ["日本", "語", "ß", "x"]}
    rows = [(i % 25, " ".join("".join(r.choice(syllables[k]) for _ in range(r.randint(1, 4))) + r.choice(["", ".", " 12"]) for _ in range(r.randint(1, 30))), k, "s", 0.5) for i in range(60) for k in [r.choice(list(syllables))]]
    rows += [(60, None, "aa", "s", 0.1), (61, "", None, "s", 0.1), (62, "12 !?", "bb", None, 0.1), (None, "katori", None, None, 0.1), (63, "sch " * 40_000, "bb", None, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, Lang_Pred string, Score double").repartition(3)
    got = sorted(((x["doc_id"], x["text"], x["lang_pred"], round(x["score"], 3)) for x in language_id(docs).select("doc_id", "text", "lang_pred", "score").collect()), key=str)
    want = plain_profiles([(x[1], x[2]) for x in rows], [x[1] for x in rows])
    assert got == sorted(((x[0], x[1], w[0], round(w[1], 3)) for x, w in zip(rows, want)), key=str)
    assert {x.lang_pred for x in language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_url_aliases_in_any_case_and_relative(spark):
    from feedloom.llm import urls

    pages = [
        (1, "https://a.org/d/e/f?q#z", '<LINK REL="CANONICAL" HREF="https://m.net/es/1">'),
        (2, "https://b.org/", '<link rel="Canonical" href="https://m.net/es/1">'),
        (3, "https://c.org/d/e/f", '<link rel="canonical" href="page.html">'),
        (4, "https://c.org/d/e/f2", '<link rel="canonical" href="../x/./y">'),
        (5, "https://c.org/d/e/f3?a", '<META HTTP-EQUIV="Refresh" CONTENT="0; URL=?id=1">'),
        (6, "https://c.org", '<link rel="canonical" href="top/">'),
        (7, "https://c.org/d/up", '<link rel="canonical" href="../..">'),
        (8, "https://c.org/mail", '<link rel="canonical" href="mailto:x@m.net">'),
        (9, "https://c.org/same", '<link rel="canonical" href="#part">'),
        (10, "https://c.org/go", '<link rel="canonical" href="../go2?to=https://m.net/es/1">'),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    edges = sorted((r["a"], r["b"]) for r in urls.alias_edges(df, "url", "html").collect() if r["a"] != r["b"])
    assert edges == sorted([
        ("a.org/d/e/f?q", "m.net/es/1"), ("b.org/", "m.net/es/1"), ("c.org/d/e/f", "c.org/d/e/page.html"), ("c.org/d/e/f2", "c.org/d/x/y"),
        ("c.org/d/e/f3?a", "c.org/d/e/f3?id=1"), ("c.org/", "c.org/top/"), ("c.org/d/up", "c.org/"), ("c.org/go", "c.org/go2?to=https://m.net/es/1"),
    ])
    verdicts = {r["page_id"]: r["verdict"] for r in urls.filter_urls(df, [("block", "net", "/es/"), ("block", "c.org", "/d/x/")]).collect()}
    assert [i for i, v in sorted(verdicts.items()) if v == "block"] == [1, 2, 4]
