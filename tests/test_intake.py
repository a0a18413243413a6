"""Files of applications, configurations that differ, confirmed accounts, pages of the queue."""

import pytest
from claimlens.operators import queue, rules
from claimlens.sources import files
from claimlens.streaming import jobs
from pyspark.sql import functions as F

HEADER = "﻿email, applicant_name ,guardian_name,guardian_phone,address_line,district,pincode,declared_annual_income,declared_family_size,certificate_id,issuing_office,certificate_issue_date"
GOOD = "a@b.org,Asha Pillai,Gopal Pillai,9840012345,\"4, Lake Road\",Salem,636001,120000,4,TN-1,Salem East,2025-01-31"


def written(tmp_path, *lines):
    path = tmp_path / "in.csv"
    path.write_text("\n".join([HEADER, *lines, ""]), encoding="utf-8")
    return f"file://{path}"


def test_file_is_admitted_whole(spark, tmp_path):
    rows = files.read_applications(spark, written(tmp_path, GOOD, "", "c@d.org,Bo,Li Wu,,Hill 12,Erode,,0,30,,,")).collect()
    assert [(r["email"], r["address_line"], r["guardian_phone"]) for r in rows] == [("a@b.org", "4, Lake Road", "9840012345"), ("c@d.org", "Hill 12", None)]


def test_file_is_refused_whole(spark, tmp_path):
    bad = ["x,Asha Pillai,Gopal Pillai,12,Lake Road,Salem,6,1e3,31,,,31-01-2025", *["c@d.org,B,Li Wu,,Hill 12,Erode,,-1,3,,,"] * 24]
    with pytest.raises(files.Refused, match="25 of 26") as e:
        files.read_applications(spark, written(tmp_path, GOOD, *bad))
    assert len(e.value.errors) == 20
    line, fields = e.value.errors[0]
    assert line == 3 and set(fields) == {"email", "guardian_phone", "pincode", "declared_annual_income", "declared_family_size", "certificate_issue_date"}
    assert e.value.errors[1] == (4, ["applicant_name", "declared_annual_income"])
    with pytest.raises(files.Refused, match="0 rows"):
        files.read_applications(spark, written(tmp_path))
    with pytest.raises(files.Refused, match="more than 2"):
        files.read_applications(spark, written(tmp_path, GOOD, GOOD, GOOD), most=2)


def test_configurations_differ(spark):
    rows = [("A", True, "high", 30), ("B", True, "low", 5)]
    old, new = (spark.createDataFrame(r, "rule string, enabled boolean, severity string, weight int") for r in (rows, [rows[0], ("B", True, "low", 6), ("C", False, "low", 1)]))
    assert {r["rule"] for r in rules.configs_differ(old, new).collect()} == {"B", "C"}


def test_confirmed_accounts_stream(spark, tmp_path):
    apps = spark.createDataFrame([("p", "2024"), ("p", "2025"), ("q", "2023")], "applicant_id string, scope string")
    spark.createDataFrame([("p",), ("nobody",)], "applicant_id string").write.parquet(f"file://{tmp_path}/in")
    seen = set()
    arrivals = spark.readStream.schema("applicant_id string").parquet(f"file://{tmp_path}/in")
    q = jobs.confirmation_stream(arrivals, apps, lambda scopes, _: seen.update(r[0] for r in scopes.collect()), f"file://{tmp_path}/at")
    q.processAllAvailable()
    q.stop()
    assert seen == {"2024", "2025"}


def test_listing_counts_all_rows(spark):
    made = [(f"{i}", "s", "Salem" if i % 2 else "Erode", "trashed" if i == 9 else "submitted" if i < 3 else "escalated", f"N{i}", "G", None, i) for i in range(10)]
    pop = spark.createDataFrame(made, "application_id string, scope string, district string, status string, applicant_name string, guardian_name string, certificate_id string, submitted_on int")
    flags = spark.createDataFrame([("5", "R", "high", 9), ("5", "S", "low", 3)], "application_id string, rule string, severity string, weight int")
    scores = pop.select("application_id", F.when(F.col("application_id") == "5", 12).otherwise(0).alias("risk_score"))

    def ids(**k):
        return [(r["application_id"], r["total"], r["top_rule"]) for r in queue.listing(pop, flags, scores, **k).collect()]

    assert ids(limit=2) == [("5", 9, "R"), ("0", 9, None)]
    assert ids(group="awaiting", district="SALEM") == [("5", 3, "R"), ("3", 3, None), ("7", 3, None)]
    assert ids(group="trashed") == [("9", 1, None)] and ids(group="decided") == []
    assert ids(text=" n7 ") == [("7", 1, None)] and ids(severity="high") == [("5", 1, "R")]


def test_decisions_after_the_end(spark):
    log = [("a", 1, 1, "escalated", "r", "long enough reason"), ("a", 2, 1, "approved", "r", "short"), ("a", 3, 1, "rejected", "r", "long enough reason"), ("a", 4, 1, "approved", "s", "long enough reason")]
    got = queue.decided(spark.createDataFrame(log, "application_id string, at int, seq int, decision string, decider string, reason string"))
    assert [r["at"] for r in got.orderBy("at").collect()] == [1, 3]
