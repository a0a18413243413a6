"""A configuration's file to the rules it gives, with parameters, and what a run makes of them."""

import json

import pytest
from claimlens.operators import engine, rules
from claimlens.sources import files
from pyspark.sql import functions as F


def write(folder, version, some, **more):
    (folder / f"rules.{version}.json").write_text(json.dumps({"version": version, "rules": some} | more))
    return str(folder)


RULE = {"enabled": True, "severity": "low", "weight": 7}


def test_parameters_reach_the_rules(spark, tmp_path):
    some = {
        "GUARDIAN_INCOME_CONTRADICTION": RULE | {"incomeTolerancePercent": 50, "incomeToleranceAbsolute": 1000.5, "note": "x"},
        "HOUSEHOLD_FRAGMENTATION": RULE | {"nearMissFloor": 0.3, "minNearMissFields": 1}, "FAMILY_SIZE_CONTRADICTION": RULE | {"enabled": False},
        "DOCUMENT_TAMPER_SIGNAL": RULE | {"minTamperScore": 0.75}, "ADDRESS_CLUSTER_UNRELATED": RULE | {"minDistinctHouseholds": 2}, "DEADLINE_PROXIMITY": RULE | {"windowDays": 3, "requiresCorroboration": False},
    }
    config = files.load_config(spark, write(tmp_path, "v9", some, scholarshipIncomeCeiling=90_000), "v9")
    got = rules.configured(5, config)
    assert set(got) == set(some) - {"FAMILY_SIZE_CONTRADICTION"}
    assert got["HOUSEHOLD_FRAGMENTATION"].params == {"floor": 0.3, "fields": 1} and engine.near_misses(5, config) == (0.3, 1)
    assert got["ADDRESS_CLUSTER_UNRELATED"].params == {"households": 2, "ceiling": 90_000} and not got["DEADLINE_PROXIMITY"].corroborated
    assert all((r.severity, r.weight) == ("low", 7) for r in got.values())

    cols = "application_id string, scope string, household string, guardian_key string, address_key string, declared_annual_income long, ela_applied boolean, software string, tamper_score double"
    pop = spark.createDataFrame([
        ("a", "s", "h1", "g", "x", 100_000, True, None, 0.75), ("b", "s", "h2", "g", "x", 50_001, True, None, 0.74), ("c", "s", "h3", "g", "x", 49_999, False, None, 0.9),
        ("d", "s", "h4", "k", "x", 1000, None, None, None), ("e", "s", "h5", "k", "y", 2001, True, "GIMP", 0.0), ("f", "s", "h6", "q", "y", 1000, True, None, None), ("g", "s", "h7", "q", "y", 2000, True, None, 0.8),
    ], cols)
    fire = lambda n: {(r["application_id"], r["evidence"]) for r in rules.FUNCTIONS[n](pop, got[n]).collect()}
    assert fire("GUARDIAN_INCOME_CONTRADICTION") == {("a", "c"), ("c", "a"), ("d", "e"), ("e", "d")}  # more than half of the larger, and more than 1000.5
    assert fire("ADDRESS_CLUSTER_UNRELATED") == {("b", "3"), ("c", "3"), ("d", "3"), ("e", "3"), ("f", "3"), ("g", "3")}
    assert fire("DOCUMENT_TAMPER_SIGNAL") == {("a", "score 0.75"), ("e", "GIMP"), ("g", "score 0.8")}
    plain = rules.FUNCTIONS["DOCUMENT_TAMPER_SIGNAL"](pop, rules.RULES["DOCUMENT_TAMPER_SIGNAL"])
    assert {r["application_id"] for r in plain.collect()} == {"e"}


@pytest.mark.parametrize("bad", [{"minDistinctHouseholds": 1}, {"minOcrConfidence": 1.5}, {"windowDays": 2.5}, {"incomeTolerancePercent": 100}, {"nearMissFloor": -0.1}])
def test_parameters_out_of_bounds(spark, tmp_path, bad):
    with pytest.raises(ValueError):
        files.load_config(spark, write(tmp_path, "v1", {"DEADLINE_PROXIMITY": RULE | bad}), "v1")


def test_unknown_rule_and_useless_floor(spark):
    with pytest.raises(ValueError):
        rules.configured(5, {"NO_SUCH_RULE": {}})
    with pytest.raises(ValueError):  # every pair would be compared
        engine.run(spark.createDataFrame([], "application_id string"), config={"HOUSEHOLD_FRAGMENTATION": {"params": {"floor": 0.0, "fields": 0}}})


def test_corroboration_as_configured(spark):
    found = spark.createDataFrame([("a", "DEADLINE_PROXIMITY", "3"), ("b", "DEADLINE_PROXIMITY", "3"), ("b", "FAMILY_SIZE_CONTRADICTION", "2")], "application_id string, rule string, evidence string")
    free = rules.configured(5, {"DEADLINE_PROXIMITY": {"corroborated": False}})
    assert rules.corroborated(found).where(F.col("application_id") == "a").count() == 0 and rules.corroborated(found, free).count() == 3
