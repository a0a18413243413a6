"""The whole run over a population: normal forms, households, rules, scores, and what changes in the stored tables.

Stored tables are inputs here and change sets are outputs, so a caller writes
them with whatever sink it has; nothing is updated in place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions.text import describe_gap, format_inr
from claimlens.operators import resolve, rules
from claimlens.session import materialize


@dataclass
class Run:
    """What a run gives; all but changes are whole tables."""

    population: DataFrame
    pairs: DataFrame
    findings: DataFrame
    flags: DataFrame
    scores: DataFrame


def run(apps: DataFrame, rejected: DataFrame | None = None, version: int = 5, config: dict | None = None) -> Run:
    """Applications (with scope) through all steps. rejected: edges (a, b, field) that reviewers have rejected;
    config: rules by name in place of the version's own (see rules.configured). Which keys candidates meet in follows
    from the configured floor and number of fields; a configuration that would use every pair is an error."""
    floor, fields = near_misses(version, config)
    sets = resolve.key_sets(floor=floor, fields=fields)
    apps = materialize(resolve.normalized(apps), "normalized")
    pairs = materialize(resolve.used(resolve.scored(resolve.candidates(apps, "scope", sets), apps, "scope"), floor, fields), "scored")
    pop = materialize(with_households(apps, resolve.households(apps, resolve.surviving(pairs, rejected))), "resolved")
    found = rules.findings(pop, version, pairs, config)
    return Run(pop, pairs, found, rules.flags(found, config), rules.scores(pop, found, config=config))


def near_misses(version: int = 5, config: dict | None = None) -> tuple[float, int]:
    """The least score and number of fields of unlinked pairs that the rules read."""
    rule = rules.active(version, config).get("HOUSEHOLD_FRAGMENTATION")
    return (float(rule.params["floor"]), int(rule.params["fields"])) if rule else (resolve.LINK, 1)


def with_households(apps: DataFrame, households: DataFrame) -> DataFrame:
    """The population from normalized applications and (application_id, household): keys are normal forms."""
    keys = F.col("guardian.canonical").alias("guardian_key"), F.col("address").alias("address_key"), F.col("phone").alias("phone_key")
    pop = apps.join(households, "application_id").select("*", *keys)
    return pop.drop("applicant", "guardian", "address", "phone", "address_grams")


def edges(pairs: DataFrame) -> DataFrame:
    """(a, b, field, similarity, weight): a row for each field on which a scored pair agrees."""
    return pairs.select("a", "b", F.explode("edges").alias("e")).select("a", "b", "e.field", "e.similarity", "e.weight")


def edge_changes(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Rows to insert or update in the stored edges (a, b, field, similarity, weight, rejected).

    A rejected edge stays rejected whatever a new run finds: its row is left
    alone. Edges that are no longer found stay too, as evidence of their time.
    """
    old = stored.select("a", "b", "field", F.struct("similarity", "weight").alias("o"), F.coalesce("rejected", F.lit(False)).alias("gone"))
    new = found.select("a", "b", "field", F.struct("similarity", "weight").alias("n"))
    both = new.join(old, ["a", "b", "field"], "left").where(~F.coalesce("gone", F.lit(False)))
    kind = F.when(F.col("o").isNull(), "I").when(~F.col("o").eqNullSafe(F.col("n")), "U")
    return both.withColumn("change", kind).where("change is not null").select("a", "b", "field", "change", "n.similarity", "n.weight")


def stale_flags(stored: DataFrame, flags: DataFrame, version: str) -> DataFrame:
    """Keys (application_id, rule, version) of stored flags that this run, of this version, has not given again."""
    now = flags.select("application_id", "rule", F.lit(version).alias("version"))
    return stored.select("application_id", "rule", "version").join(now, ["application_id", "rule", "version"], "left_anti")


def promoted(pop: DataFrame, requested: DataFrame) -> DataFrame:
    """(application_id, status): requested applications that are still submitted or processing become ready for review."""
    some = pop.join(requested.select("application_id"), "application_id", "left_semi")
    return some.where(F.col("status").isin("submitted", "processing")).select("application_id", F.lit("ready_for_review").alias("status"))


def changed_applications(old: DataFrame, new: DataFrame, old_scores: DataFrame, scores: DataFrame) -> DataFrame:
    """Applications whose bag of findings (rule, evidence) or score is another than before.

    Each side's bag is one digest for an application, so the comparison is a join of narrow rows.
    """

    def digest(found: DataFrame, total: DataFrame, name: str) -> DataFrame:
        each = found.groupBy("application_id").agg(F.sort_array(F.collect_list(F.concat_ws("\t", "rule", F.coalesce("evidence", F.lit(""))))).alias("f"))
        bag = F.sha2(F.concat_ws("\n", "f"), 256)
        return total.join(each, "application_id", "left").select("application_id", F.struct("risk_score", F.coalesce(bag, F.lit("")).alias("bag")).alias(name))

    both = digest(old, old_scores, "o").join(digest(new, scores, "n"), "application_id", "full")
    return both.where(~F.col("o").eqNullSafe(F.col("n"))).select("application_id")


def affected(arrivals: DataFrame, pop: DataFrame) -> DataFrame:
    """(scope, household) of the households that new or changed applications touch, by scope; what lies outside keeps its findings."""
    return pop.join(arrivals.select("application_id"), "application_id", "left_semi").select("scope", "household").distinct()


def household_of(pop: DataFrame, ids: DataFrame) -> DataFrame:
    """(application_id, member) of the households that the applications of ids belong to."""
    wanted = pop.join(ids.select("application_id"), "application_id", "left_semi").select("application_id", "scope", "household")
    return wanted.join(pop.select("scope", "household", F.col("application_id").alias("member")), ["scope", "household"]).select("application_id", "member")


#: Sentences of findings; {n} stands for the evidence, as rules give it.
SENTENCES = {
    "SIBLING_INCOME_CONTRADICTION": "Declares another income than {n} of the same household",
    "GUARDIAN_INCOME_CONTRADICTION": "Names the guardian of {n}, of another household, at another income",
    "ADDRESS_CLUSTER_UNRELATED": "{n} unrelated households below the ceiling give this address",
    "ISSUING_OFFICE_MISMATCH": "The household has certificates of {n} offices",
    "DUPLICATE_CERTIFICATE_ID": "{n} applications give this certificate number",
    "FAMILY_SIZE_CONTRADICTION": "The household declares {n} different family sizes",
    "SHARED_CONTACT_UNRELATED_HOUSEHOLDS": "{n} households give this phone number",
    "DEADLINE_PROXIMITY": "The certificate was issued {n} days before the deadline",
    "DECLARED_INCOME_BELOW_CERTIFICATE": "Declares {n} less than the certificate shows",
    "CERTIFICATE_HOLDER_MISMATCH": "The certificate shows another {n}",
    "CERTIFICATE_NUMBER_MISMATCH": "The certificate shows another {n}",
    "CERTIFICATE_INCOME_WORDS_MISMATCH": "The certificate's income in figures and in words differ",
    "CERTIFICATE_DETAILS_MISMATCH": "The certificate shows another {n}",
    "DOCUMENT_TAMPER_SIGNAL": "The document carries the mark of an editor or of changes: {n}",
    "GOVERNMENT_RECORD_MISMATCH": "The government's record says {n}",
    "DOCUMENT_NOT_A_CERTIFICATE": "Only {n} fields of a certificate were found on a legible page",
    "INCOME_THRESHOLD_BUNCHING": "{n} applications declare incomes just below the ceiling",
    "CERTIFICATE_SERIAL_ADJACENCY": "Certificates of this office with serials {n} went to unrelated households",
    "IDENTICAL_ROUND_INCOME_CLUSTER": "{n} unrelated households of one office declare the same round income",
    "HOUSEHOLD_FRAGMENTATION": "Resembles {n} closely, but just too little to be linked",
}


def reasons(found: DataFrame, pop: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """found with a sentence (reason) and a JSON payload of the values that fired the rule.

    Where the evidence is another application's income, the sentence ends with the gap of
    the two incomes; where it is an application that nearly resembles, with the score and the
    fields that agree, if the scored pairs are given. All lookups are joins on the application.
    """
    income = pop.select("application_id", F.col("declared_annual_income").alias("income"))
    others = pop.select(F.col("application_id").alias("evidence"), F.col("declared_annual_income").alias("other_income"))
    both = found.join(income, "application_id", "left").join(others, "evidence", "left")
    near = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("array<struct<field:string,similarity:double>>")
    if pairs is not None:
        likely = pairs.where(~F.col("linked")).select(
            F.lit("HOUSEHOLD_FRAGMENTATION").alias("rule"), "a", "b", F.col("score").alias("_score"),
            F.transform("edges", lambda e: F.struct(e["field"].alias("field"), e["similarity"].alias("similarity"))).alias("_fields"),
        )
        both = both.withColumns({"a": F.least("application_id", "evidence"), "b": F.greatest("application_id", "evidence")}).join(likely, ["rule", "a", "b"], "left")
        percent = F.transform("_fields", lambda e: F.concat(e["field"], F.lit(" "), F.round(100 * e["similarity"]).cast("int").cast("string"), F.lit("%")))
        near = F.concat(F.lit(": "), F.format_string("%.2f", "_score"), F.lit(" ("), F.array_join(percent, ", "), F.lit(")")), F.col("_score"), F.col("_fields")
    pairs = [F.lit(x) for item in SENTENCES.items() for x in item]
    shown = F.when(F.col("rule") == "DECLARED_INCOME_BELOW_CERTIFICATE", format_inr(F.col("evidence").try_cast("bigint"))).otherwise(F.col("evidence"))
    sentence: Column = F.replace(F.create_map(*pairs)[F.col("rule")], F.lit("{n}"), F.coalesce(shown, F.lit("")))
    named = F.col("rule").isin("SIBLING_INCOME_CONTRADICTION", "GUARDIAN_INCOME_CONTRADICTION")
    gap = F.when(named, F.concat(F.lit(": a gap of "), describe_gap(F.col("income"), F.col("other_income"))))
    payload = F.to_json(F.struct(
        "rule", "evidence", F.col("income").alias("declared_annual_income"), F.when(named, F.col("other_income")).alias("other_income"),
        near[1].alias("resolution_score"), near[2].alias("near_miss_fields"),
    ))
    return both.select(*found.columns, F.concat(sentence, F.coalesce(gap, near[0], F.lit(""))).alias("reason"), payload.alias("payload"))
