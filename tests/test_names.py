"""Names inside texts against plain Python, up to 100,000 names, in one shard and in many."""

import random
import re

import pytest
from pyspark.sql import functions as F

from feedloom.functions import names as nm
from feedloom.sources.tables import CITIES, gazetteer


def plain_city(text, cities):
    """The rules as loops over (city, state, spellings), the first city before all others."""
    if not text:
        return None
    low = text.lower()
    first = next((c for c in cities if c[0] == "belagavi"), None)
    if first and any(n in low for n in (first[0], *first[2])):
        return first[:2]
    index = {}
    for c in cities:
        for n in (c[0], *c[2]):
            index.setdefault(n, c)
    words = [w for w in re.split(r"[\s,.!?;:(){}'\"\[\]-]+", low) if w]
    for n in (1, 2, 3):
        for k in range(len(words) - n + 1):
            name = " ".join(words[k : k + n])
            if len(name) >= 3 and name in index:
                return index[name][:2]
    for c in cities:
        if c[2] and any(n in low for n in (c[0], *c[2])):
            return c[:2]
    return next((c[:2] for c in cities if not c[2] and len(c[0]) >= 5 and c[0] in low), None)


def test_city_rules(spark):
    cases = {"A punekar spoke": "pune", "in Mysore, Bombay": "mysuru", "old belgaumites of Pune": "belagavi", "navi mumbai": "mumbai", "to navi-mumbai": "mumbai", "hyderabadi food": "hyderabad", "xnew delhix": "new delhi", "ab": None, "": None, None: None, "NEW  DELHI!": "new delhi"}
    docs = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: r["city"] for r in nm.detect_city(docs, gazetteer(spark), "t", "t").collect()}
    assert got == cases
    assert {t: (plain_city(t, CITIES) or (None,))[0] for t in cases} == cases


@pytest.fixture(scope="module")
def many(spark):
    r = random.Random(11)
    syllables = ["ka", "ri", "mo", "tan", "sel", "u", "ber", "lin", "go", "ath"]
    found = {}
    while len(found) < 60_000:
        name = "".join(r.choice(syllables) for _ in range(r.randint(3, 7))) + (" " + r.choice(syllables) + "pur" if r.random() < 0.2 else "")
        found.setdefault(name, (name, r.choice("NSEW"), tuple(name + r.choice("xyz") for _ in range(r.choice((0, 0, 0, 1, 3))))))
    cities = list(found.values())
    words = [w for c in r.sample(cities, 60) for w in (c[0], "q" + c[0] + "q", *c[2])] + ["q" + r.choice("wvbnm") + str(k) for k in range(3000)]
    texts = [(k, r.choice([" ", ", ", "\n"]).join(r.choice(words[-3000:] if r.random() < 0.97 else words) for _ in range(r.randint(0, 60)))) for k in range(150)]
    return cities, [*texts, (7, texts[7][1]), (None, "a " + cities[5][0]), (900, None)]


@pytest.mark.parametrize("at_once", [nm.NAMES_AT_ONCE, 30_000])
def test_cities_of_many_names(spark, many, at_once):
    cities, texts = many
    table = spark.createDataFrame([(c, s, list(o), k) for k, (c, s, o) in enumerate(cities)], "city string, state string, spellings array<string>, place long")
    known = gazetteer(spark, table=table)
    assert known.count() > 100_000 or at_once < nm.NAMES_AT_ONCE or known.count() > 90_000
    out = nm.detect_city(spark.createDataFrame(texts, "id long, t string").repartition(3), known, "id", "t", at_once)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(((k, *(plain_city(t, cities) or (None, None))) for k, t in texts), key=key)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("at_once", [nm.NAMES_AT_ONCE, 40])
def test_contained_equals_plain(spark, at_once, monkeypatch):
    monkeypatch.setattr(nm, "TEXT_BYTES", 2000)
    r = random.Random(2)
    word = lambda a, b: "".join(r.choice("abc") for _ in range(r.randint(a, b)))
    known, texts = [word(1, 6) for _ in range(150)] + [None, "", "é ü"], [word(0, 30) for _ in range(300)] + [None, "", "xé üx", "ABC"]
    out = nm.contained(spark.createDataFrame([(t,) for t in texts], "body string"), spark.createDataFrame([(n,) for n in known], "n string"), "body", "n", at_once)
    want = {(t, n) for t in set(texts) - {None} for n in set(known) - {None, ""} if n in t}
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_names_of_nothing(spark):
    none, some = spark.createDataFrame([], "n string"), spark.createDataFrame([("x",)], "n string")
    assert nm.contained(none, some, "n", "n").count() == nm.contained(some, none, "n", "n").count() == 0
    empty = gazetteer(spark).limit(0)
    assert [tuple(x) for x in nm.detect_city(some.select(F.lit(1).alias("i"), "n"), empty, "i", "n").collect()] == [(1, None, None)]
    assert nm.detect_city(none.select(F.lit(1).alias("i"), "n"), gazetteer(spark), "i", "n").count() == 0
