"""Normalizers, similarities, resolution and components on small fixtures."""

import hashlib
import hmac
import random

from claimlens.functions import similarity, text
from claimlens.operators import resolve, rules
from claimlens.operators.graph import connected_components
from claimlens.session import materialize
from pyspark.sql import functions as F


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def check(spark, f, cases):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(cases)], "i int, a string")
    got = {r["i"]: r["x"] for r in df.select("i", f(F.col("a")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_money(spark):
    check(spark, text.parse_income, {"Rs. 1,78,000/-": 178000, "Rs 178000": 178000, "₹ 2,50,000/-": 250000, "Rs. 12/-": None, "Rs. 999999999999/-": None, "": None})
    check(spark, text.normalize_rupees, {"Rs. 4,80,000/-": 480000, "₹4,80,000.00": 480000, "480000": 480000, "none": None})
    words = {"One Lakh Seventy Eight Thousand Rupees Only": 178000, "Ninety One Thousand Five Hundred Rupees Only": 91500, "Rupees Only": None, "Two Crore Rupees": 20000000, "Zero Rupees Only": None}
    check(spark, text.parse_income_words, words)
    check(spark, text.parse_family_size, {"5": 5, " 4 ": 4, "0": None, "99": None, "many": None})
    for n in (7, 15, 40, 91500, 178000, 9_99_999):
        shown = value(spark, text.amount_in_words(F.lit(n)))
        assert value(spark, text.parse_income_words(F.lit(shown))) == n
    assert value(spark, text.format_inr(F.lit(123456789))) == "₹12,34,56,789"
    assert value(spark, text.describe_gap(F.lit(96000), F.lit(178000))) == "₹82,000 (46%)"


def test_identity(spark):
    check(spark, text.normalize_phone, {"+91 70105 66778": "7010566778", "070105-66778": "7010566778", "7010566778": "7010566778", "033-5556677": None})
    name = lambda c: text.normalize_name(c)["canonical"]
    check(spark, name, {"Bhuvaneshwaree": "buvanesvari", "Geethaa Zaheer": "gita jahir", "Dr. Q. Wásim Poorny": "vasim purni", "": ""})
    check(spark, text.normalize_address, {"9 Poongavanam Rd.": "9 pungavanam road", "3rd Main, Flat No. 88": "3 main flat 88"})
    assert value(spark, text.submitter_hash(b"k", F.lit("1.2.3.4"))) == hmac.new(b"k", b"1.2.3.4", hashlib.sha256).hexdigest()
    check(spark, text.csv_cell, {"=1+1": "'=1+1", "-12.5": "-12.5", 'a"b': '"a""b"', "@x,y": '"\'@x,y"'})
    for given, want in (("tn-2025-000123", ("TN", 123)), (" inc/b77", ("INCB", 77)), ("42", ("", 42)), ("a1b22", ("AB", 22)), ("abc", ("", None)), ("", ("", None))):
        assert tuple(value(spark, text.serial_tail(F.lit(given)))) == want, given


def test_names(spark):
    assert sorted(value(spark, similarity.trigrams(F.lit("ab")))) == ["  a", " ab", "ab "]

    def sim(a, b, f=similarity.name_similarity):
        return value(spark, f(text.normalize_name(F.lit(a)), text.normalize_name(F.lit(b))))

    # a shared last name doesn't carry another first name; more words on one side don't matter; an initial needs a word that it begins
    assert sim("Leela Natarajan", "Prakash Natarajan") < 0.3 and sim("Leela Natarajan", "Leela Natarajan Pillai") == 1.0
    assert sim("Leela Natarajan", "P Leela Natarajan") == 1.0 and sim("P Leela Natarajan", "Leela Natarajan") == 0.0 and sim("P. Natarajan", "P. Natarajan") == 0.0
    for a, b, same in (("Poongodi Natarajan", "Pungodi Natarajen", True), ("Leela Natarajan", "Prakash Natarajan", False), ("Shanmugha Vadivel", "Sanmuga Vadivelu", True), ("Usha Pillai", "Gowri Pillai", False)):
        assert sim(a, b, similarity.names_agree) == same, (a, b)


def test_resolution_equals_all_pairs(spark):
    rng = random.Random(8)
    first, last = "Ravi Kumar Meena Suresh Latha".split(), "Natarajan Pillai Vadivel Shanmugham Poongavanam Natrajan".split()
    made = [
        (f"{i:04d}", "2025", f"{rng.choice(first)} {rng.choice(last)}", f"{rng.choice(['', 'S. '])}{rng.choice(first)} {rng.choice(last)}",
         f"{rng.randint(1, 6)} {rng.choice(['Gandhi', 'Bharathi', 'Barathi'])} {rng.choice(['St', 'Street', 'Nagar'])}", rng.choice(["Salem", "Erode"]), rng.choice([None, *(f"98401000{k:02d}" for k in range(40))]))
        for i in range(160)
    ]
    names = "application_id string, cycle string, applicant_name string, guardian_name string, address_line string, district string, guardian_phone string"
    apps = materialize(resolve.normalized(spark.createDataFrame(made, names)), "apps")
    ids = apps.select("cycle", F.col("application_id").alias("a"))
    every = ids.join(ids.withColumnRenamed("a", "b"), "cycle").where("a < b")
    used = lambda p: {tuple(r) for r in p.where("linked or (score >= 0.38 and size(edges) >= 2)").select("a", "b", "score").collect()}
    blocked = materialize(resolve.scored(resolve.candidates(apps), apps), "pairs")
    want = used(resolve.scored(every, apps))
    assert used(blocked) == want and len(want) > 20
    found = {r["application_id"]: r["household"] for r in resolve.households(apps, resolve.surviving(blocked)).collect()}
    up = {m[0]: m[0] for m in made}
    links = [(r["a"], r["b"]) for r in blocked.where("linked").collect()]
    for _ in made:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    assert found == up
    near = rules.fragmentation(blocked, rules.RULES["HOUSEHOLD_FRAGMENTATION"])
    assert near.count() == 2 * blocked.where("not linked and score >= 0.38 and size(edges) >= 2").count()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    up = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(up[a], up[b])
            changed |= up[a] != low or up[b] != low
            up[a] = up[b] = low
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == up


def test_serial_runs(spark):
    rows = [("s", "o", "TN", n) for n in (1, 5, 10, 14, 20)]
    runs = rules.serial_runs(spark.createDataFrame(rows, "scope string, office string, series string, serial long"), 12)
    assert sorted((r["lo"], r["hi"]) for r in runs.collect()) == [(1, 10), (5, 14), (10, 20)]


def test_versions():
    assert [len(rules.rules_of(v)) for v in (1, 2, 3, 4, 5)] == [8, 9, 15, 19, 20]
