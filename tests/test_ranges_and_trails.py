"""Shares of the top tenth, strongest regions, the trail's access paths, and small measures, against plain versions."""

import json
import random
import statistics

import pytest
from claimlens.functions import text
from claimlens.operators import documents, engine, evaluate, queue, resolve
from claimlens.sources.trail import Trail
from pyspark.sql import functions as F


@pytest.mark.parametrize("n, values", [(1000, 3), (997, 400), (40, 1), (7, 2)])
def test_top_tenth_among_ties(spark, n, values):
    rng = random.Random(n)
    rows = [(rng.randrange(values), i, rng.random() < 0.3) for i in rng.sample(range(n), n)]
    got = evaluate.precision_and_lift(spark.createDataFrame(rows, "score int, id int, expected boolean").repartition(7), "score", "id").first()
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    tenth = max(1, int(n / 10 + 0.5))
    share = lambda x: sum(r[2] for r in x) / len(x)
    assert got["precision_at_10"] == round(share(order[:10]), 6) and got["base_rate"] == round(share(rows), 6)
    assert got["lift"] == pytest.approx(share(order[:tenth]) / share(rows), abs=1e-6)


def test_no_limit_grows_with_the_rows(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("score"), "id", (F.col("id") % 7 == 0).alias("expected"))
    plan = evaluate.precision_and_lift(rows, "score", "id")._jdf.queryExecution().optimizedPlan().toString()
    limits = [int(w.split(" ")[1].strip(",")) for w in plan.replace("GlobalLimit", "Limit").replace("LocalLimit", "Limit").split("Limit")[1:] if w.split(" ")[1].strip(",").isdigit()]
    assert all(x <= 10 for x in limits)


def test_strongest_regions(spark):
    rng = random.Random(4)
    rows = []
    for d in range(6):
        for r in range(8):
            rows += [(d, r, c, rng.choice([1.0, 2.0, 3.0, 50.0 + rng.randrange(3), 90.0]) if d else 5.0, rng.choice([5.0, 6.0, 30.0])) for c in range(9)]
    rows += [(9, 0, c, float(c), 9.0) for c in range(10)]
    df = spark.createDataFrame(rows, "doc int, row int, col int, energy double, ink double").repartition(5)
    got = documents.block_regions(df)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()  # tasks keep twelve of a document before the shuffle
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r["doc"], r["rank"])):
        found.setdefault(r["doc"], []).append((r["row"], r["col"], r["left"], r["bottom"], r["z_score"], r["energy"]))
    want = {}
    for d in {r[0] for r in rows}:
        inked = [r for r in rows if r[0] == d and r[4] >= 6]
        mid = statistics.median(r[3] for r in inked)
        dev = 1.4826 * statistics.median(abs(r[3] - mid) for r in inked)
        if len(inked) >= 24 and dev > 1e-6:
            hot = sorted(((r[3] - mid) / dev, -r[1], -r[2], r[3]) for r in inked if (r[3] - mid) / dev >= 3.5)[::-1][:12]
            if hot:
                want[d] = [(-a, -b, -b * 8, (-a + 1) * 8, round(z, 3), e) for z, a, b, e in hot]
    assert found == want and max(map(len, want.values())) == 12
    lists = {r["doc"]: [x["rank"] for x in r["regions"]] for r in documents.region_lists(got).collect()}
    assert lists == {d: list(range(1, len(x) + 1)) for d, x in want.items()}


def test_lookups_open_few_files(spark, tmp_path):
    trail = Trail(spark, f"file://{tmp_path}/trail", {"entity": ["entity", "at"], "actor": ["actor", "at"], "time": ["at"]})
    with pytest.raises(LookupError):
        trail.lookup("actor", "a1")
    rows = [(i, f"e{i % 90:02d}", None if i % 50 == 0 else f"a{i * 7 % 40:02d}", 1000 * i % 7919, {"n": i}) for i in range(2400)]
    df = spark.createDataFrame(rows, "id int, entity string, actor string, at long, detail map<string,int>").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        trail.append(df.where("id % 3 > 0"))
        trail.append(df.where("id % 3 = 0"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    ids = lambda x: sorted(r["id"] for r in x.collect())
    every = len(trail.files("entity", F.lit(True)))
    assert every > 16
    for name, col, value in (("entity", 1, "e17"), ("actor", 2, "a33"), ("entity", 1, "nobody"), ("actor", 2, "a00")):
        found = trail.lookup(name, value)
        assert ids(found) == sorted(r[0] for r in rows if r[col] == value)
        assert len(found.inputFiles()) <= 6
    some = trail.between("time", 500, 900)
    assert ids(some) == sorted(r[0] for r in rows if 500 <= r[3] <= 900) and len(some.inputFiles()) < every / 2
    assert ids(trail.lookup("actor", None)) == []


def test_edges_rejected_by_reviewers(spark):
    """A pair stays linked as long as one of its edges has not been rejected."""
    edge = lambda *f: [{"field": x} for x in f]
    pairs = spark.createDataFrame([("a", "b", edge("phone", "address"), True), ("a", "c", edge("guardian"), True), ("b", "c", edge("guardian"), False)], "a string, b string, edges array<struct<field:string>>, linked boolean")
    rejected = spark.createDataFrame([("a", "b", "phone"), ("a", "c", "guardian"), ("x", "y", "phone")], "a string, b string, field string")
    left = lambda r: {tuple(x) for x in resolve.surviving(pairs, r).collect()}
    assert left(None) == {("a", "b"), ("a", "c")} and left(rejected) == {("a", "b")}
    assert left(rejected.unionByName(spark.createDataFrame([("a", "b", "address")], rejected.schema))) == set()


def test_expected_and_missed(spark):
    expected = spark.createDataFrame([("a", "R1"), ("a", "R2"), ("b", "R1"), ("c", None)], "id string, rule string")
    flags = spark.createDataFrame([("a", "R1"), ("a", "R1"), ("b", "R2"), ("z", "R1")], "id string, rule string")
    assert {tuple(r) for r in evaluate.missed(expected, flags, ["id", "rule"]).collect()} == {("a", "R2"), ("b", "R1"), ("c", None)}
    assert [r["id"] for r in evaluate.expectations(expected, flags, "id").collect()] == ["c"]
    got = evaluate.recall(expected.select("id").distinct(), flags, "id").first()
    assert (got["expected"], got["caught"], got["recall"]) == (3, 2, 0.666667)
    rows = spark.createDataFrame([("x", 0.5), ("x", 0.49), ("x", None), ("y", None)], "variant string, s double")
    got = {r["variant"]: (r["measured"], r["mean_score"], r["flagged"], r["rate"]) for r in evaluate.error_rates(rows, "s", 0.5).collect()}
    assert got == {"x": (2, 0.495, 1, 0.5), "y": (0, None, 0, None)}


def test_skeletons_and_file_types(spark):
    rows = spark.createDataFrame([(["uma", "aarti", "y", ""],)], "t array<string>")
    assert rows.select(text.skeleton(F.col("t")).alias("x")).first()["x"] == ["um", "art", "y", ""]
    kinds = {b"\xff\xd8\xff\xe0rest": "image/jpeg", b"\x89PNG\r\n\x1a\nrest": "image/png", b"RIFF1234WEBPVP8 ": "image/webp", b"%PDF-1.7": "application/pdf", b"\n\n%PDF-1.4": "application/pdf", b"12345%PDF-": None, b"GIF89a": None, b"": None}
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(kinds)], "i int, b binary")
    got = [r["x"] for r in df.orderBy("i").select(text.sniff_type(F.col("b")).alias("x")).collect()]
    assert [(g or "").split("/")[-1].replace("jpg", "jpeg") or None for g in got] == [k.split("/")[-1] if k else None for k in kinds.values()]


def test_no_forbidden_column_reaches_an_applicant(spark):
    pop = spark.createDataFrame([("a", "s", "ready_for_review", 1, 90, "h", "x"), ("b", "s", "trashed", 2, 0, "h", "y")], "application_id string, scope string, status string, submitted_on int, risk_score int, household string, phone_key string")
    view = queue.applicant_view(pop, spark.createDataFrame([("a",), ("a",), ("z",)], "application_id string"))
    assert view.columns == ["application_id", "scope", "stage", "submitted_on", "document_count"] and not set(view.columns) & set(queue.FORBIDDEN)
    assert {tuple(r) for r in view.collect()} == {("a", "s", "under_review", 1, 2), ("b", "s", "decided", 2, 0)}


def test_reasons_of_near_misses(spark):
    found = spark.createDataFrame([("a", "HOUSEHOLD_FRAGMENTATION", "b"), ("b", "HOUSEHOLD_FRAGMENTATION", "a"), ("a", "SIBLING_INCOME_CONTRADICTION", "b")], "application_id string, rule string, evidence string")
    pop = spark.createDataFrame([("a", 100_000), ("b", 250_000)], "application_id string, declared_annual_income long")
    edge = [{"field": "guardian", "similarity": 0.5833, "weight": 0.5, "part": 0.29}, {"field": "phone", "similarity": 1.0, "weight": 0.15, "part": 0.15}]
    pairs = spark.createDataFrame([("a", "b", edge, 0.4417, False)], "a string, b string, edges array<struct<field:string,similarity:double,weight:double,part:double>>, score double, linked boolean")
    got = {(r["application_id"], r["rule"][:4]): (r["reason"], json.loads(r["payload"])) for r in engine.reasons(found, pop, pairs).collect()}
    assert got["a", "HOUS"][0] == "Resembles b closely, but just too little to be linked: 0.44 (guardian 58%, phone 100%)" and got["b", "HOUS"][1]["resolution_score"] == 0.4417
    assert [f["field"] for f in got["a", "HOUS"][1]["near_miss_fields"]] == ["guardian", "phone"] and "resolution_score" not in got["a", "SIBL"][1]
    assert got["a", "SIBL"][0].endswith(": a gap of ₹1,50,000 (60%)") and got["a", "SIBL"][1]["other_income"] == 250_000


def test_changed_applications(spark):
    f = lambda rows: spark.createDataFrame(rows, "application_id string, rule string, evidence string")
    s = lambda rows: spark.createDataFrame(rows, "application_id string, risk_score long")
    old, new = f([("a", "R", "1"), ("a", "R", "1"), ("b", "R", "1"), ("c", "R", "1")]), f([("a", "R", "1"), ("b", "R", "2"), ("c", "R", "1")])
    got = engine.changed_applications(old, new, s([("a", 2), ("b", 1), ("c", 1), ("d", 0), ("e", 0)]), s([("a", 2), ("b", 1), ("c", 3), ("d", 0), ("f", 0)]))
    assert {r[0] for r in got.collect()} == {"a", "b", "c", "e", "f"}
