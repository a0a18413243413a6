"""Steps whose work must grow with the rows, not with their pairs."""

import difflib
import random

from claimlens.functions import similarity, text
from claimlens.operators import documents, reading, rules
from claimlens.plans.population import population
from claimlens.session import materialize
from pyspark.sql import functions as F


def test_rows_meet_few_runs_of_serials(spark):
    rng = random.Random(5)
    taken = sorted({rng.choice([rng.randrange(40_000), 7 * rng.randrange(4_000), 90_000 + rng.randrange(60)]) for _ in range(3000)})
    given = [(str(i), "1995", f"TN-{s}", " Office 1", f"h{rng.randrange(900)}") for i, s in enumerate(taken + taken[::9])]
    pop = spark.createDataFrame(given, "application_id string, scope string, certificate_id string, issuing_office string, household string")
    rule = rules.RULES["CERTIFICATE_SERIAL_ADJACENCY"]
    rows = rules.with_serials(pop)
    assert rules.meeting(rows, rules.serial_runs(rows, 12), 12).count() < 40 * len(given)

    runs = []
    for k, hi in enumerate(taken):
        lo = min(s for s in taken if hi - 12 <= s <= hi)
        if k + 1 == len(taken) or taken[k + 1] - lo > 12:
            runs.append((lo, hi))
    want = []
    for lo, hi in runs:
        inside = [(i, h) for i, _, c, _, h in given if lo <= int(c[3:]) <= hi]
        if len({h for _, h in inside}) >= 3:
            want += [(i, rule.name, f"{lo}-{hi}") for i, _ in inside]
    assert want and sorted(map(tuple, rules.serial_adjacency(pop, rule).collect())) == sorted(want)


def test_few_rows_of_a_key_are_compared_as_many_are(spark, monkeypatch):
    rng = random.Random(6)
    given = [(f"{i:04}", "1995", f"h{k % 40}", f"g{k % 23}", rng.choice([0, -5, 90_000, 104_000, 110_000, rng.randrange(300_000)])) for i, k in enumerate(rng.randrange(90) ** 2 for _ in range(700))]
    pop = spark.createDataFrame(given, "application_id string, scope string, household string, guardian_key string, declared_annual_income long")
    some = {n: rules.RULES[n] for n in rules.CONTRADICTIONS}
    got = []
    for few in (0, 20, 10_000):
        monkeypatch.setattr(rules, "FEW", few)
        got.append(sorted(map(tuple, rules.contradictions(pop, some).collect())))
    assert got[0] and got[0] == got[1] == got[2]


def test_equal_names_need_no_normal_form(spark):
    names = ["Ravi Kumar", "ravi KUMAR", "Ravi Kumal", "Shri", "SHRI", "Mr. so", "S. K.", "s. k.", "", " ", "12", "José Li", "JOSE LI", "josé li", "Dr Li", "a b", "A B", "Shri Shrikant", "x-ray", "O.K. Vu", None]
    pairs = [(a, b, None, None) for a in names for b in names]
    df = spark.createDataFrame(pairs, "applicant_name string, read_applicant_name string, guardian_name string, read_guardian_name string")
    norm = {f"norm_{c}": text.normalize_name(F.col(c)) for c in ("applicant_name", "read_applicant_name")}
    plain = F.when(F.col("applicant_name").isNotNull() & F.col("read_applicant_name").isNotNull(), similarity.names_agree(F.col("norm_applicant_name"), F.col("norm_read_applicant_name")))
    want = df.withColumns(norm).select("applicant_name", "read_applicant_name", plain.alias("x")).collect()
    got = documents.named(df).select("applicant_name", "read_applicant_name", documents.agreement("applicant_name").alias("x"), F.col("norm_applicant_name").isNull().alias("spared")).collect()
    assert [tuple(r)[:3] for r in got] == [tuple(r) for r in want]
    assert {r[0] for r in got if r["spared"] and r[1] is not None and r[0] is not None} == {"Ravi Kumar", "ravi KUMAR", "Ravi Kumal", "Dr Li", "Shri Shrikant", "JOSE LI", "O.K. Vu"}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fields_are_read_from_one_pass_over_the_lines(spark):
    words = spark.createDataFrame([("d", 1, 1, 1, 1, 40, 20, 60, 18, "District", 90.0), ("d", 1, 1, 1, 1, 140, 20, 60, 18, "Salem", 90.0)],
                                  "doc string, page int, block int, par int, line int, left int, top int, width int, height int, text string, conf double")
    read = reading.read_fields(words)
    assert plan(read).count("likenesses(") == 2  # labels and stops
    assert [r["value"] for r in read.where("value is not null").collect()] == ["Salem"]


def test_rules_on_one_row_are_one_scan_that_asks_once(spark):
    rows = plan(rules.row_findings(population(spark, "/root/testdata/sf0.001"), {n: rules.RULES[n] for n in rules.ROW_RULES}))
    assert "Window" not in rows and "Join" not in rows and rows.count("photoshop") == 1


def test_groupings_read_a_narrow_population(spark, monkeypatch):
    wrote = {}

    def recorded(df, name):
        wrote[name] = materialize(df, name)
        return wrote[name]

    monkeypatch.setattr(rules, "materialize", recorded)
    pop = population(spark, "/root/testdata/sf0.001")
    found = rules.findings(pop)
    assert sorted(wrote["population"].columns) == sorted(rules.GROUPED)
    whole = rules.findings(materialize(pop, "whole"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))


def test_households_are_found_on_the_orders_columns(spark):
    carried = plan(population(spark, "/root/testdata/sf0.001")).split("Window")[-1]
    assert "read_district" not in carried and "applicant_name" not in carried


def test_runs_of_too_few_rows_meet_nothing(spark):
    rows = [("1995", "a", "TN", s) for s in (1, 1, 5, 40, 41, 90, 95, 99)]
    runs = rules.serial_runs(spark.createDataFrame(rows, "scope string, office string, series string, serial long"), 12, 3)
    assert sorted((r["lo"], r["hi"]) for r in runs.collect()) == [(1, 5), (90, 99)]


def test_flags_are_dealt_by_application(spark):
    found = spark.createDataFrame([("1", "A", "x"), ("1", "A", "y"), ("2", "B", "z")], "application_id string, rule string, evidence string")
    by = rules.flags(found).groupBy("application_id").agg(F.count(F.lit(1)).alias("n"))
    assert by._jdf.queryExecution().sparkPlan().toString().count("Exchange") == 1
    assert by._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, rules.flags(found).select("application_id", "rule", "evidence").collect())) == [("1", "A", "y"), ("2", "B", "z")]


def test_checklist_collects_nothing(spark):
    pop = spark.createDataFrame([("1", "A")], "application_id string, rule string")
    stages = pop.select("application_id", F.lit("read").alias("stage"), F.lit("dead_lettered").alias("status"))
    listed = documents.checklist(population(spark, "/root/testdata/sf0.001"), pop, stages, 0.5)
    assert "collect_" not in plan(listed)


def test_clusters_and_serial_runs_count_in_one_shuffle(spark):
    """Different values of a key are counted where its rows already lie: no grouping and no join back, and nulls are no value."""
    rows = spark.createDataFrame([("k", "a"), ("k", "a"), ("k", "b"), ("k", None), ("l", None), ("m", "a")], "k string, v string")
    got = rules.counted(rows, ["k"], "v").collect()
    assert sorted((r["k"], r["v"] or "", r["n"]) for r in got) == [("k", "", 2), ("k", "a", 2), ("k", "a", 2), ("k", "b", 2), ("l", "", 0), ("m", "a", 1)]
    pop = materialize(population(spark, "/root/testdata/sf0.001"), "population")
    plan = rules.clustered(pop, {n: rules.RULES[n] for n in rules.CLUSTERS})._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Window" in plan


def test_pairs_of_names_are_compared_once(spark, monkeypatch):
    """The rule on holders asks the names of different pairs only, and gives what the scan of all rows gives, repeated rows too."""
    names = ["Ravi Kumar", "RAVI KUMAR", "Wrong Person", "Shri", "", "Meena", None]
    rows = [(str(i % 90), a, b, g, h, c) for i, (a, b, g, h, c) in enumerate((a, b, g, h, c) for a in names for b in names for g, h in (("Meena", "Xu"), (None, "Xu"), ("Meena", "MEENA")) for c in (0.9, 0.5, None))]
    df = spark.createDataFrame(rows, "application_id string, applicant_name string, read_applicant_name string, guardian_name string, read_guardian_name string, read_confidence double")
    wrote = {}

    def recorded(df, name):
        wrote[name] = materialize(df, name)
        return wrote[name]

    monkeypatch.setattr(rules, "materialize", recorded)
    rule = rules.RULES["CERTIFICATE_HOLDER_MISMATCH"]
    got = rules.FUNCTIONS[rule.name](df, rule)
    want = rules.row_findings(df, {rule.name: rule})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    assert wrote["apart"].count() == wrote["apart"].distinct().count() < 40 < wrote["names"].count()
    assert rules.FUNCTIONS[rule.name](df.limit(0), rule).count() == 0


def test_runs_are_those_of_close_rows(spark, monkeypatch):
    """Rows far from others are left out before runs are sought; no run changes, at the borders of blocks either."""
    monkeypatch.setattr(rules, "STRETCHES", 1)
    rng = random.Random(8)
    rows = [("1995", rng.choice("ab"), "TN", rng.choice([rng.randrange(900), 2**63 - 1 - rng.randrange(40)])) for _ in range(260)]
    df = spark.createDataFrame(rows, "scope string, office string, series string, serial long")
    for span, least in ((12, 3), (3, 2), (0, 2), (12, 1), (30, 9)):
        kept = rules.close(df, span, least)
        few = [tuple(r) for r in kept.collect()]
        near = lambda r, lo: sum(q[1] == r[1] and lo <= q[3] <= lo + span for q in rows)
        assert sorted(few) == sorted(r for r in rows if any(near(r, q[3]) >= least for q in rows if r[3] - span <= q[3] <= r[3]))
        assert sorted(rules.serial_runs(kept, span, least).collect()) == sorted(rules.serial_runs(df, span, least).collect())


def test_few_windows_are_compared_letter_by_letter(spark, monkeypatch):
    """Windows whose lengths and letters tell that they are unlike a label are never compared, and no like one is lost."""
    asked = []
    monkeypatch.setattr(reading, "ratio", lambda a, b, of=reading.ratio: asked.append((a, b)) or of(a, b))
    rng = random.Random(9)
    pool = [reading.plain_text(w) for f in reading.FIELDS for w in f.label.split()] + ["dat", "of1ssue", "", "ravi", "tn2025000123", "12", "suresh", "fssuing"]
    labels = reading.Labels(reading.FIELDS)
    for _ in range(600):
        words = [rng.choice(pool) for _ in range(rng.randint(1, 8))]
        want = {}
        for i, f in enumerate(reading.FIELDS):
            tokens = f.label.split()
            n = len(tokens)
            for size, rank in [(n, reading.EXACT), (n + 1, reading.SPLIT)] + [(n - 1, reading.LOST)] * (n > 2):
                for start in range(len(words) - size + 1) if f.midline else range(min(1, len(words) - size + 1)):
                    seen, label = "".join(words[start : start + size]), reading.plain_text(" ".join(tokens[:size]))
                    alike = difflib.SequenceMatcher(None, seen, label).ratio()
                    if seen and alike >= reading.LABEL:
                        want[i] = max(want.get(i, ()), (rank, alike, -start, size))
        assert {k[0]: k[1:] for k in labels.find(words)} == want
    assert len(asked) < 3 * 600


def test_dealt_words_are_not_shuffled(spark):
    from claimlens.plans import pages
    from claimlens.plans.population import applications

    words = pages.printed(applications(spark, "/root/testdata/sf0.001"), F.lit("None"))
    plan = reading.lines(words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
