"""Admission, repeats, retention and withdrawal as joins and groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.functions.text import person_key

# Bounds of declared fields.
LENGTHS = {"applicant_name": (2, 120), "address_line": (4, 240), "district": (2, 80)}
RANGES = {"declared_annual_income": (0, 100_000_000), "declared_family_size": (1, 30)}
PHONE = "^[0-9]{10}$"
PATTERNS = {"email": "^[^@\\s]+@[^@\\s]+[.][^@\\s.]{2,}$", "guardian_phone": PHONE, "pincode": "^[0-9]{6}$", "certificate_issue_date": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"}
LONGEST = {"certificate_id": 60, "issuing_office": 120}
OPTIONAL = ("guardian_phone", "pincode", "certificate_id", "issuing_office", "certificate_issue_date")
COLUMNS = (*LENGTHS, "guardian_name", *RANGES, *PATTERNS, *LONGEST)


def invalid_fields(rows: DataFrame) -> DataFrame:
    """application_id and the names of the fields out of bounds, for rows that have any; a blank phone is none."""
    checks = {c: F.length(F.trim(c)).between(*b) for c, b in LENGTHS.items()} | {c: F.col(c).between(*b) for c, b in RANGES.items()}
    checks["guardian_phone"] = F.coalesce(F.trim("guardian_phone"), F.lit("")).rlike(f"{PHONE}|^$")
    bad = F.concat_ws(", ", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(c)) for c, ok in checks.items()])
    return rows.select("application_id", bad.alias("invalid")).where("invalid <> ''")


def one_per_person(apps: DataFrame, order: list[str]) -> DataFrame:
    """Adds admitted: the first application of a person in a scope; people are told apart by account and name."""
    w = Window.partitionBy("applicant_id", "scope", person_key(F.col("applicant_name"))).orderBy(*order)
    return apps.withColumn("admitted", F.row_number().over(w) == 1)


def same_content(docs: DataFrame, key: str, content: str) -> DataFrame:
    """sha256, first key and number of the contents that occur more than once; nulls are left out."""
    digests = docs.where(F.col(content).isNotNull()).select(key, F.sha2(content, 256).alias("sha256"))
    return digests.groupBy("sha256").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


def household_table(pop: DataFrame) -> DataFrame:
    """Households of two members or more."""
    return pop.groupBy("scope", "household").agg(F.count(F.lit(1)).alias("member_count")).where("member_count > 1")


def purgeable(rows: DataFrame, decided: Column, on: str, today: Column, days: int = 180, limit: int = 500) -> DataFrame:
    """The oldest decided rows whose decision is more than so many days back."""
    return rows.where(decided & (F.datediff(today, on) > days)).orderBy(on, "application_id").limit(limit)


def withdraw(flags: DataFrame, gone: DataFrame) -> DataFrame:
    """Flags without those of applications that are gone."""
    return flags.join(gone.select("application_id"), "application_id", "left_anti")


def stage_log(log: DataFrame, key: str, order: list[str], failure: Column, reset: Column, most: int = 4) -> DataFrame:
    """Failures of each key since its last reset, and whether they make it a dead letter.

    The last reset comes from a grouping that is combined before the shuffle.
    """
    at = F.struct(*order)
    last = log.groupBy(key).agg(F.max(F.when(reset, at)).alias("last"))
    since = failure & (F.col("last").isNull() | (at > F.col("last")))
    folded = log.join(last, key).groupBy(key).agg(F.count_if(since).alias("attempts"))
    return folded.withColumn("dead_letter", F.col("attempts") >= most)


def tips(rows: DataFrame, applications: DataFrame) -> DataFrame:
    """Tips with a trimmed body of 10 to 2000 characters; an application that is not known becomes null."""
    known = applications.select("application_id", F.col("application_id").alias("known")).distinct()
    fit = rows.withColumn("body", F.btrim("body")).where(F.length("body").between(10, 2000))
    return fit.join(known, "application_id", "left").withColumn("application_id", F.col("known")).drop("known")


def issues(rows: DataFrame) -> DataFrame:
    """rows of strings with an array (issues) of the names of the fields that can't be admitted; fields named in OPTIONAL may be blank."""
    value = {c: F.trim(F.col(c)) for c in COLUMNS}
    checks = {c: F.length(value[c]).between(*b) for c, b in (LENGTHS | {"guardian_name": (2, 120)}).items()}
    checks |= {c: value[c].try_cast("bigint").between(*b) & value[c].rlike("^[0-9]+$") for c, b in RANGES.items()}
    checks |= {c: value[c].rlike(p) for c, p in PATTERNS.items()} | {c: F.length(value[c]) <= most for c, most in LONGEST.items()}
    blank = {c: F.coalesce(value[c], F.lit("")) == "" if c in OPTIONAL else F.lit(False) for c in COLUMNS}
    return rows.withColumn("issues", F.array_compact(F.array(*[F.when(~(blank[c] | F.coalesce(ok, F.lit(False))), F.lit(c)) for c, ok in checks.items()])))


def tips_shown(tips: DataFrame) -> DataFrame:
    """Tips that belong to an application, newest first in each, with nothing of the sender."""
    return tips.where("application_id is not null").select("application_id", "tip_id", "body", "at", "abusive").orderBy("application_id", F.desc("at"), F.desc("tip_id"))


def reprocessable(docs: DataFrame, apps: DataFrame, scope: str | None = None) -> DataFrame:
    """(document_id, scope, at) of documents that are not purged, oldest first, of one scope or all."""
    if scope is not None:
        apps = apps.where(F.col("scope") == scope)
    out = docs.where("purged_on is null").join(apps.select("application_id", "scope"), "application_id")
    return out.select("document_id", "scope", "at").orderBy("at", "document_id")


def confirmed_scopes(confirmed: DataFrame, apps: DataFrame) -> DataFrame:
    """Scopes to be rescored when accounts (applicant_id) are confirmed: those that their applications are in."""
    return apps.join(confirmed.select("applicant_id"), "applicant_id", "left_semi").select("scope").distinct()
