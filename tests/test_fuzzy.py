"""Fuzzy search of terms in names against the plain dynamic programme."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.functions import fuzzy


def plain(term, name):
    """Fewest edits between the term and any stretch of the name."""
    row = list(range(len(term) + 1))
    best = row[-1]
    for c in name:
        new = [0]
        for k, t in enumerate(term, 1):
            new.append(min(new[-1] + 1, row[k] + 1, row[k - 1] + (c != t)))
        row = new
        best = min(best, row[-1])
    return best


text = st.text("abcdé日", max_size=90)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(text, text), min_size=1, max_size=12))
def test_edits_equal_plain(pairs):
    terms, names = zip(*pairs, strict=True)
    assert fuzzy.edits(list(terms), list(names)).tolist() == [plain(t, n) for t, n in pairs]


def test_matches_equal_plain(spark):
    r = random.Random(5)
    word = lambda a, b, alphabet="abcdefghij": "".join(r.choice(alphabet) for _ in range(r.randint(a, b)))
    base = [word(1, 14) for _ in range(120)] + [word(60, 80)]

    def slip(w):
        w = list(w)
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randint(0, 1)] = r.choice(["", "a", "z"])
        return "".join(w)

    names = [word(0, 5, "xyz") + slip(b) + word(0, 5, "xyz") for b in base for _ in range(4)] + [word(1, 20, "ab") for _ in range(80)] + ["", None, "ABCdef", "日本語の名前"]
    terms = [*base, "aaaa", "abcDEF", "日本の名", "a", "", None, base[3], base[3].upper()]
    frame = lambda x, c: spark.createDataFrame([(v, 1) for v in x], f"{c} string, clash int").repartition(3)
    for threshold in (0.3, 0.0, 0.5):
        out = fuzzy.fuzzy_matches(frame(terms, "t"), frame(names, "n"), "t", "n", threshold)
        got = [tuple(x) for x in out.collect()]
        want = {(t, n, plain(t, n)) for t in {x.lower() for x in terms if x} for n in {x.lower() for x in names if x} if plain(t, n) <= int(len(t) * threshold + 1e-9)}
        assert len(got) == len(set(got)) and set(got) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_matches_of_nothing(spark):
    none, some = spark.createDataFrame([], "w string"), spark.createDataFrame([("word",)], "w string")
    assert fuzzy.fuzzy_matches(none, some, "w", "w").count() == fuzzy.fuzzy_matches(some, none, "w", "w").count() == 0
