"""Which keys candidates meet in, for any configuration; resolution and rules with an unusual one against all pairs."""

import itertools
import random
import warnings

import pytest
from claimlens.operators import engine, graph, resolve, rules
from claimlens.session import materialize
from pyspark.sql import functions as F

ALL = [s for n in range(5) for s in itertools.combinations(resolve.FIELDS, n)]


@pytest.mark.parametrize("floor", [0.05, 0.15, 0.2, 0.3, 0.35, 0.38, 0.45, 0.5, 0.54, 0.7])
@pytest.mark.parametrize("fields", [0, 1, 2, 3, 4])
def test_key_sets_cover_all_that_is_used(floor, fields):
    """Whatever fields a used pair agrees in, it agrees in all fields of a key."""
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        sets = resolve.key_sets(floor=floor, fields=fields)
    for s in ALL:
        most = sum(resolve.FIELDS[f][0] for f in s)
        if most >= resolve.LINK or (round(most, 4) >= floor and len(s) >= fields):
            assert any(set(k) <= set(s) for k in sets), s
    assert all(1 <= len(k) <= 2 for k in sets)
    assert any("one field" in str(w.message) for w in said) == any(len(k) == 1 for k in sets)


def test_keys_of_the_usual_configuration_have_two_fields():
    assert sorted(resolve.key_sets()) == sorted([("guardian", "applicant"), ("guardian", "address"), ("guardian", "phone"), ("applicant", "address"), ("address", "phone")])
    with pytest.raises(ValueError):
        resolve.key_sets(floor=0.0, fields=0)


def people(seed, n=70):
    rng = random.Random(seed)
    first, last = "Arul Bhanu Chitra Dinesh Ezhil".split(), "Palanisamy Palaniswamy Krishnan Kirshnan Subbarayan".split()
    return [
        (f"{i:04d}", "2031", f"{rng.choice(first)} {rng.choice(last)}", f"{rng.choice(['', 'T. '])}{rng.choice(first)} {rng.choice(last)}",
         f"{rng.randint(1, 9)} {rng.choice(['Lake View', 'Lakeview', 'Temple', 'Market'])} {rng.choice(['St', 'Road', 'Nagar'])}",
         rng.choice(["Hosur", "Karur"]), rng.choice([None, *(f"97000111{k:02d}" for k in range(12))]))
        for i in range(n)
    ]


@pytest.mark.parametrize("least", [0.55, 0.65])
def test_near_words_equal_all_pairs(spark, least):
    rng = random.Random(12)
    words = sorted({"".join(rng.choice("abdeik") for _ in range(rng.randint(1, 6))) for _ in range(150)})
    grams = lambda w: {f"  {w} "[i : i + 3] for i in range(len(w) + 1)}
    want = {(t, u) for t in words for u in words if t == u or len(grams(t) & grams(u)) >= least * len(grams(t) | grams(u))}
    df = spark.createDataFrame([(w,) for w in words], "t string")
    got = [tuple(r) for r in resolve._near_words(df, least).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > len(words)
    some, known = df.where("t < 'd'"), df.where("t > 'b'")
    asked = {tuple(r) for r in resolve._near_words(some, least, known).collect()}
    assert asked == {(t, u) for t, u in want if t < "d"}


def test_links_need_no_near_pairs(spark):
    """Candidates for links hold every linked pair, at borders of likeness and with addresses of few letters too, and few of the pairs
    that are only near."""
    assert resolve.alone(resolve.key_sets(floor=resolve.LINK, fields=1)) == {("applicant", "address"): pytest.approx(0.875, abs=1e-5)}
    rng = random.Random(4)
    given = [(*p[:4], rng.choice([p[4], p[4], "7", "7 7", "a", "", "12 Lake View Street"]), rng.choice([p[5], "", ""]), p[6]) for p in people(3, 90)]
    crowd = [(f"c{i:03d}", "2031", "Arul Krishnan", f"Zed Q{'bcdfghjklm'[i % 10]}v", f"{9000 + 37 * i} Temple Street", "Dist Temple Town", None) for i in range(40)]
    apps = materialize(resolve.normalized(spark.createDataFrame(given + crowd, NAMES)), "apps")
    ids = apps.select("scope", F.col("application_id").alias("a"))
    every = materialize(resolve.scored(ids.join(ids.withColumnRenamed("a", "b"), "scope").where("a < b"), apps, "scope"), "every")
    met = {tuple(r) for r in resolve.linkable(apps, "scope").select("a", "b").collect()}
    linked = {tuple(r) for r in every.where("linked").select("a", "b").collect()}
    near = {tuple(r) for r in resolve.used(every).where("a like 'c%' and b like 'c%' and not linked").select("a", "b").collect()}
    assert linked <= met and len(linked) > 50
    assert len(near) > 100 and len(near & met) < len(near) / 4


NAMES = "application_id string, scope string, applicant_name string, guardian_name string, address_line string, district string, guardian_phone string"


@pytest.mark.parametrize("floor, fields", [(0.3, 1), (0.34, 2), (0.45, 3)])
def test_unusual_configuration_equals_all_pairs(spark, floor, fields):
    apps = materialize(resolve.normalized(spark.createDataFrame(people(int(100 * floor)), NAMES)), "apps")
    ids = apps.select("scope", F.col("application_id").alias("a"))
    every = resolve.scored(ids.join(ids.withColumnRenamed("a", "b"), "scope").where("a < b"), apps, "scope")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        sets = resolve.key_sets(floor=floor, fields=fields)
    blocked = resolve.scored(resolve.candidates(apps, "scope", sets), apps, "scope")
    rows = lambda p: {tuple(r) for r in resolve.used(p, floor, fields).select("a", "b", "score").collect()}
    want = rows(every)
    assert rows(blocked) == want and len(want) > 5


def test_configured_floor_reaches_the_rule():
    config = {n: {} for n in rules.RULES} | {"HOUSEHOLD_FRAGMENTATION": {"params": {"floor": 0.3, "fields": 1}, "weight": 9}}
    assert engine.near_misses(5, config) == (0.3, 1) and engine.near_misses() == (0.38, 2)
    assert engine.near_misses(5, {}) == (resolve.LINK, 1) == engine.near_misses(3)


def brute(nodes, links):
    up = {x: x for x in nodes}
    for _ in nodes:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    return up


def test_components_after_edits_equal_recomputation(spark):
    """Links come and go at random; only the components they touch are put together again."""
    rng = random.Random(11)
    nodes = [f"n{i:03d}" for i in range(120)]
    links = {tuple(sorted(rng.sample(nodes[:90], 2))) for _ in range(70)}
    links = {(a, b) for a, b in links}
    labels = brute(nodes, links)
    for _ in range(3):
        gone = set(rng.sample(sorted(links), 6))
        come = {tuple(sorted(rng.sample(nodes, 2))) for _ in range(3)}
        links = (links - gone) | come
        nodes = [*nodes, f"x{rng.randrange(10**6)}"]
        touched = {x for e in gone | come for x in e} | {nodes[-1]}
        got = graph.recomputed(
            spark.createDataFrame(list(labels.items()), "node string, component string"),
            spark.createDataFrame(sorted(links), "a string, b string"),
            spark.createDataFrame([(x,) for x in touched], "node string"),
        ).collect()
        members = {r["node"] for r in got}
        assert members == touched | {x for x, c in labels.items() if c in {labels.get(t) for t in touched}}
        assert len(members) < len(nodes)
        labels |= {r["node"]: r["component"] for r in got}
        assert labels == brute(nodes, links)
