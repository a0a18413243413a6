"""Documents, edge decisions, files and retired cases on small fixtures."""

import json

import pytest
from claimlens.functions import text
from claimlens.operators import documents, evaluate, logs
from claimlens.sources import files
from pyspark.sql import functions as F


def test_holder_names(spark):
    rows = [
        ("1", "Poongodi Natarajan", "PUNGODI NATARAJEN", 0.9, "pass"), ("2", "Leela Natarajan", "Prakash Natarajan", 0.9, "fail"), ("3", "P. Natarajan", "P. Natarajan", 0.9, "pass"),
        ("4", "Leela", "Gowri", 0.7, "skipped"), ("5", "Leela", None, 0.9, "skipped"), ("6", " ", "Gowri", 0.9, "skipped"), ("7", "Leela", "Gowri", None, "skipped"),
    ]
    df = spark.createDataFrame([(i, a, b, c) for i, a, b, c, _ in rows], "application_id string, applicant_name string, read_applicant_name string, read_confidence double")
    for c in ("guardian_name", "certificate_id", "district", "pincode", "family_size"):
        df = df.withColumn(f"declared_{c}" if c == "family_size" else c, F.lit(None).cast("string")).withColumn(f"read_{c}", F.lit("x"))
    got = {r["application_id"]: r["status"] for r in documents.field_comparison(df).where("check = 'applicant_name'").collect()}
    assert got == {i: s for i, _, _, _, s in rows}


def test_outliers(spark):
    calm = [(1, float(i % 5), 10.0) for i in range(30)] + [(1, 40.0, 10.0), (1, 999.0, 1.0)]
    rows = calm + [(2, 1.0, 10.0)] * 30 + [(3, float(i), 10.0) for i in range(5)]
    got = {r["doc"]: r for r in documents.block_outliers(spark.createDataFrame(rows, "doc int, energy double, ink double")).collect()}
    assert got[1]["regions"] == 1 and got[1]["score"] == 1.0 and got[1]["n_blocks"] == 31
    assert not got[2]["applied"] and not got[3]["applied"] and got[3]["score"] == 0.0


def test_edge_decisions(spark):
    log = [("a", "b", "phone", 1, "reject", "not a relative"), ("a", "b", "phone", 2, "restore", ""), ("a", "c", "phone", 1, "reject", "short"), ("a", "d", "address", 3, "reject", "other building")]
    df = spark.createDataFrame(log, "a string, b string, field string, at int, action string, reason string")
    assert [tuple(r) for r in logs.rejected_edges(df, ["at"]).collect()] == [("a", "d", "address")]
    edges = spark.createDataFrame([("a", "b", False), ("b", "a", True), ("c", "c", True)], "a string, b string, rejected boolean")
    assert [tuple(r) for r in logs.merged_edges(edges, "a", "b", "rejected").collect()] == [("a", "b", True)]


def test_first_and_last(spark):
    rows = spark.createDataFrame([("A@x", 1, "one"), ("a@X", 2, "two")], "email string, at int, name string")
    for overwrite, name in ((True, "two"), (False, "one")):
        assert [tuple(r) for r in logs.account_upsert(rows, F.col("email"), ["at"], ["name"], overwrite).collect()] == [("a@x", name)]


def test_retired(spark):
    cases, caught = spark.createDataFrame([("1",), ("2",)], "case_id string"), spark.createDataFrame([("1",)], "case_id string")
    log = spark.createDataFrame([("1", True), ("2", True), ("9", False)], "case_id string, caught boolean")
    assert {tuple(r) for r in evaluate.retired(cases, caught, log).collect()} == {("2", "differs"), ("9", "unknown")}


def test_rule_config(spark, tmp_path):
    rule = {"enabled": True, "severity": "high", "weight": 40, "note": "x"}
    (tmp_path / "rules.v1.json").write_text(json.dumps({"version": "v1", "rules": {"A": rule, "B": rule | {"enabled": False}}}, indent=1))
    (tmp_path / "rules.v2.json").write_text(json.dumps({"version": "v1", "rules": {"A": rule}}))
    (tmp_path / "rules.v3.json").write_text(json.dumps({"version": "v3", "rules": {"A": rule | {"severity": "odd"}}}))
    assert {tuple(r) for r in files.rule_config(spark, str(tmp_path), "v1").collect()} == {("A", True, "high", 40), ("B", False, "high", 40)}
    for version in ("v2", "v3"):
        with pytest.raises(ValueError):
            files.rule_config(spark, str(tmp_path), version)


def test_manifest_audit_and_csv(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"documents": [{"document": "d", "variant": "blur", "truth": {"district": "Salem"}}]}))
    assert [(r["document"], r["variant"], r["truth"]["district"]) for r in files.manifest(spark, str(tmp_path / "m.json")).collect()] == [("d", "blur", "Salem")]
    act = spark.createDataFrame([("u", "reject", "e1", 5, {"why": "x"})], "actor string, action string, entity string, at long, detail map<string,string>")
    for _ in range(2):
        files.append_audit(act, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2
    rows = spark.createDataFrame([("=1+1", 'a "b", c'), (None, "-5")], "name string, note string").coalesce(1)
    files.write_queue_csv(rows, str(tmp_path / "csv"))
    got = next((tmp_path / "csv").glob("*.csv")).read_bytes().decode()
    assert got == '﻿name,note\r\n\'=1+1,"a ""b"", c"\r\n,-5\r\n'


def test_url(spark):
    df = spark.createDataFrame([("TN/1 2", "Salem & co"), (None, "x")], "c string, d string")
    assert [r[0] for r in df.select(text.verification_url("https://p.example", F.col("c"), F.col("d"))).collect()] == [
        "https://p.example?certificateNo=TN%2F1+2&district=Salem+%26+co", "https://p.example?certificateNo=&district=x"]
