"""Registered queries over pages printed from the applications: field reading, page reports, grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions import text
from claimlens.operators import evaluate, reading
from claimlens.plans.population import SQL, applications
from claimlens.plans.registry import register
from claimlens.session import dealt

def _id() -> Column:
    return F.col("application_id").cast("long")


def printed(apps: DataFrame, spelt: Column) -> DataFrame:
    """words of a page for each application: labels and values, some labels misread (a lost word, a wrong letter), some lines
    left out, some values printed otherwise. spelt: the income in words."""

    def line(*parts: Column) -> Column:
        return F.concat_ws(" ", *parts)

    cert = F.when(_id() % 19 == 0, F.replace("certificate_id", F.lit("-"), F.lit("/"))).when(_id() % 3 == 0, F.lower("certificate_id")).otherwise(F.col("certificate_id"))
    income = F.concat(F.lit("Rs. "), F.col("declared_annual_income").cast("string"), F.when(_id() % 23 == 0, ".00/-").otherwise("/-"))
    page = F.array(
        F.lit("STATE OF NOWHERE e-DISTRICT - SPECIMEN"),
        line(F.lit("Certificate No."), cert, F.lit("Date of Issue:"), F.date_format("certificate_issue_date", "yyyy-MM-dd")),
        line(F.lit("Name of Applicant"), F.col("applicant_name")),
        line(F.lit("Father / Guardian"), F.col("guardian_name")),
        line(F.lit("Address"), F.col("address_line")),
        F.when(_id() % 41 != 1, line(F.lit("District"), F.col("district"))),
        line(F.lit("PIN Code"), F.col("pincode")),
        line(F.when(_id() % 5 == 0, "Members in").otherwise("Members in Family"), F.col("declared_family_size").cast("string")),
        line(F.lit("Annual Family Income"), income),
        line(F.lit("(in words)"), spelt),
        F.when(_id() % 7 == 0, "fssuing Authority").otherwise("Issuing Authority"),
        F.trim("issuing_office"),
    )
    # Narrow rows are dealt by document, and their many words stay where they are printed.
    lines = dealt(apps, "application_id").select(F.col("application_id").alias("doc"), F.posexplode(page).alias("line", "text")).where("text is not null")
    words = lines.select("doc", "line", F.posexplode(F.split("text", " ")).alias("i", "text"))
    return words.select(
        "doc", F.lit(1).alias("page"), F.lit(1).alias("block"), F.lit(1).alias("par"), "line", (40 + 100 * F.col("i")).alias("left"), (50 + 30 * F.col("line")).alias("top"),
        F.lit(90).alias("width"), F.lit(20).alias("height"), "text", (F.lit(70.0) + F.col("line")).alias("conf"),
    )


_POP = f"with pop as materialized ({SQL}), p as (select *, cast(application_id as bigint) as k from pop)"
_STRIP = "trim({}, ' :.-')"
_PRINTED = {
    "applicant_name": "applicant_name", "guardian_name": "guardian_name", "address": "address_line", "district": "case when k % 41 <> 1 then district end",
    "pincode": "pincode", "family_size": "cast(declared_family_size as varchar)",
    "annual_income": "'Rs. ' || declared_annual_income || case when k % 23 = 0 then '.00/-' else '/-' end", "annual_income_words": "'Rupees ' || declared_annual_income || ' Only'",
    "certificate_id": "case when k % 19 = 0 then replace(certificate_id, '-', '/') when k % 3 = 0 then lower(certificate_id) else certificate_id end",
    "issue_date": "strftime(certificate_issue_date, '%Y-%m-%d')", "issuing_office": "issuing_office",
}


@register(_POP + " union all ".join(f" select application_id as doc, '{f}' as field, {_STRIP.format(v)} as value from p" for f, v in _PRINTED.items()))
def c8_field_reading(spark, sf_dir):
    """Fields read from printed pages, against what was printed on them."""
    spelt = F.concat_ws(" ", F.lit("Rupees"), F.col("declared_annual_income").cast("string"), F.lit("Only"))
    return reading.read_fields(printed(applications(spark, sf_dir), spelt), columns=("value",)).select("doc", "field", "value")


@register(f"""{_POP} select application_id as doc, case when declared_annual_income * case when k % 23 = 0 then 100 else 1 end between 1000 and 100000000 and spelt > 0 then k % 29 = 0 or k % 23 = 0 end as words_mismatch
from (select *, declared_annual_income + case when k % 29 = 0 then 1000 else 0 end as spelt from p)""")
def c9_read_pages(spark, sf_dir):
    """Whether the income in figures and in words differ on printed pages; every 29th page spells another income."""
    income = F.col("declared_annual_income") + F.when(_id() % 29 == 0, 1000).otherwise(0)
    words = printed(applications(spark, sf_dir), text.amount_in_words(income))
    got = reading.page_report(words, reading.read_fields(words, columns=("value",)), text.parse_income(F.col("figures")), text.parse_income_words(F.col("spelt")))
    return got.select("doc", "words_mismatch")


_WRONG = {"annual_income": "k % 23 = 0", "certificate_id": "k % 19 = 0"}
_MISSING = {"district": "k % 41 = 1"}
_TRUE = {
    "applicant_name": "applicant_name", "guardian_name": "guardian_name", "district": "district", "certificate_id": "certificate_id", "issuing_office": "issuing_office",
    "family_size": "declared_family_size", "annual_income": "declared_annual_income",
}


@register(_POP + " union all ".join(
    f" select application_id as doc, '{f}' as field, case when {_MISSING.get(f, 'false')} then 'missing' when {_WRONG.get(f, 'false')} then 'wrong' else 'right' end as status from p where {v} is not null"
    for f, v in _TRUE.items()
))
def e8_graded_fields(spark, sf_dir):
    """Every field read from printed pages against the application: the case of letters doesn't matter, dashes do, and an
    income with paise is read as a larger one."""
    apps = applications(spark, sf_dir)
    truth = apps.select(F.col("application_id").alias("doc"), F.explode(F.create_map(*[x for f, v in _TRUE.items() for x in (F.lit(f), F.col(v).cast("string"))])).alias("field", "value"))
    read = reading.read_fields(printed(apps, F.lit("None")), columns=("value",))
    return evaluate.graded(truth, read, "doc")
