"""Contradiction and population rules, findings, flags and scores.

A rule is a function (population, rule) -> findings(application_id, rule, evidence).
The population has scope, household and the declared and read values. All rules
are groupings and equi-joins on keys; none compares all pairs. Rules that look at
one row only are conditions: a run takes all of them in one scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.functions.similarity import exceeds_tolerance, names_agree
from claimlens.functions.text import editing_software, normalize_name, serial_tail
from claimlens.operators import scan
from claimlens.operators.documents import agreement, named, plainly_same
from claimlens.session import is_written, materialize, release


@dataclass(frozen=True)
class Rule:
    name: str
    since: int
    severity: str
    weight: int
    params: dict = field(default_factory=dict)
    corroborated: bool = False
    population: bool = False


#: Rules with the version that brought them, severity, weight and parameters.
RULES = {
    r.name: r
    for r in (
        Rule("SIBLING_INCOME_CONTRADICTION", 1, "high", 40),
        Rule("GUARDIAN_INCOME_CONTRADICTION", 1, "high", 35),
        Rule("ADDRESS_CLUSTER_UNRELATED", 1, "medium", 20, {"households": 3}),
        Rule("ISSUING_OFFICE_MISMATCH", 1, "low", 8),
        Rule("DUPLICATE_CERTIFICATE_ID", 1, "high", 45),
        Rule("FAMILY_SIZE_CONTRADICTION", 1, "medium", 18),
        Rule("SHARED_CONTACT_UNRELATED_HOUSEHOLDS", 1, "medium", 22),
        Rule("DEADLINE_PROXIMITY", 1, "low", 6, {"days": 14}, corroborated=True),
        Rule("DECLARED_INCOME_BELOW_CERTIFICATE", 2, "high", 45, {"confidence": 0.8}),
        Rule("CERTIFICATE_HOLDER_MISMATCH", 3, "high", 40, {"confidence": 0.8, "similarity": 0.25}),
        Rule("CERTIFICATE_NUMBER_MISMATCH", 3, "high", 30, {"confidence": 0.8}),
        Rule("CERTIFICATE_INCOME_WORDS_MISMATCH", 3, "high", 30, {"confidence": 0.8}),
        Rule("CERTIFICATE_DETAILS_MISMATCH", 3, "medium", 15, {"confidence": 0.8}),
        Rule("DOCUMENT_TAMPER_SIGNAL", 3, "medium", 15),
        Rule("GOVERNMENT_RECORD_MISMATCH", 3, "high", 50),
        Rule("INCOME_THRESHOLD_BUNCHING", 4, "low", 10, {"band": 8, "least": 4, "ratio": 2.5}, population=True),
        Rule("CERTIFICATE_SERIAL_ADJACENCY", 4, "medium", 25, {"span": 12, "households": 3}, population=True),
        Rule("IDENTICAL_ROUND_INCOME_CLUSTER", 4, "medium", 22, {"step": 10_000, "households": 3}, population=True),
        Rule("HOUSEHOLD_FRAGMENTATION", 4, "medium", 28, {"floor": 0.38, "fields": 2}, population=True),
        Rule("DOCUMENT_NOT_A_CERTIFICATE", 5, "high", 40, {"confidence": 0.8, "words": 40, "fields": 3}),
    )
}
CEILING = 250_000
#: The score from which resolution links a pair.
LINK = 0.55


def rules_of(version: int) -> dict[str, Rule]:
    """The rules of a version; each version only adds."""
    return {n: r for n, r in RULES.items() if r.since <= version}


def configured(version: int, config: dict[str, dict]) -> dict[str, Rule]:
    """The rules of a version with a configuration's severities, weights and parameters; rules it disables or leaves out are not run.

    config: by rule, a mapping with enabled, severity, weight, corroborated and params, each of which may be missing.
    A rule that isn't known is an error.
    """
    if unknown := set(config) - set(RULES):
        raise ValueError(f"no such rules: {sorted(unknown)}")
    out = {}
    for name, rule in rules_of(version).items():
        c = config.get(name)
        if c is not None and c.get("enabled", True):
            given = {k: c[k] for k in ("severity", "weight", "corroborated") if c.get(k) is not None}
            out[name] = replace(rule, params=rule.params | (c.get("params") or {}), **given)
    return out


def active(version: int, config: dict[str, dict] | None) -> dict[str, Rule]:
    """The rules that a run applies."""
    return rules_of(version) if config is None else configured(version, config)


def _found(df: DataFrame, rule: Rule, evidence: Column) -> DataFrame:
    return df.select("application_id", F.lit(rule.name).alias("rule"), evidence.cast("string").alias("evidence"))


def _tolerance(rule: Rule) -> tuple[float, float]:
    return rule.params.get("percent", 15), rule.params.get("absolute", 12_000)


def _ceiling(rule: Rule) -> int:
    return rule.params.get("ceiling", CEILING)


#: Keys with so many rows at most are answered by pairs of their rows, which is less work than to sort them.
FEW = 32
#: Rules on incomes that contradict each other: the key (beside scope) that brings rows together, and the column in which they must differ.
CONTRADICTIONS = {"SIBLING_INCOME_CONTRADICTION": ("household", "application_id"), "GUARDIAN_INCOME_CONTRADICTION": ("guardian_key", "household")}


def _hits(pop: DataFrame, columns: list[str], hits: list[Column]) -> DataFrame:
    """A row for each of a row's hits, which are structs or null: columns and the struct's fields."""
    return pop.select(*columns, F.explode(F.array(*hits)).alias("r")).where("r is not null").select(*columns, "r.*")


def _name(some: dict[str, Rule]) -> Column:
    """The rule's name from its number (rule) among some; keys with numbers are shorter to shuffle and compare."""
    return F.get(F.array(*map(F.lit, some)), F.col("rule")).alias("rule")


def contradictions(pop: DataFrame, some: dict[str, Rule]) -> DataFrame:
    """Findings of the income rules: evidence is, for every row whose income exceeds the tolerance against other rows of
    its key, the least id of those rows.

    What contradicts an income lies at or below one limit, or at or above another, so the answer is a running minimum
    of ids along the incomes (and one along them downwards), read at the limits. The least id and the least of any other
    value of the column that must differ are kept: whichever differs from the row's own counts. Keys whose extremes don't
    contradict each other take no part, and the rows of keys with FEW at most are compared with each other instead. All
    other rows are dealt by ranges of key and income, so a common key has many tasks.
    A tolerance has percent (below 100, in hundredths) and an absolute gap.
    """
    x, asked, far = F.col("declared_annual_income").cast("long"), [], F.lit(False)
    for i, (name, rule) in enumerate(some.items()):
        percent, absolute = _tolerance(rule)
        if not 0 <= percent < 100:
            raise ValueError(f"{name}: a tolerance of {percent} percent")
        left, gap = 10_000 - round(100 * percent), math.floor(absolute) + 1
        # The largest income below x, and the smallest above, that contradict it.
        y = "cast(declared_annual_income as bigint)"
        below = F.when(x > 0, F.least(F.expr(f"({left} * {y} + 9999) div 10000 - 1"), x - gap))
        above = F.greatest(F.expr(f"(10000 * {y}) div {left} + 1"), x + gap, F.lit(1).cast("long"))
        key, apart = CONTRADICTIONS[name]
        asked.append(F.when(x.isNotNull() & (F.col(key) != ""), F.struct(F.lit(i).alias("rule"), F.col("application_id").alias("id"), x.alias("x"), F.col(key).alias("k"), F.col(apart).alias("h"), below.alias("below"), above.alias("above"))))
        far = far | ((F.col("rule") == i) & exceeds_tolerance(F.col("lo"), F.col("hi"), percent, absolute))
    group = ["k", "rule", "scope"]
    rows = _hits(pop, ["scope"], asked)
    ends = rows.groupBy(*group).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")).where(far)
    ends = materialize(ends.select(*group, (F.col("n") <= FEW).alias("few")), "ends")
    found = _compared(rows.join(ends.where("few").drop("few"), group), group)
    if not (many := ends.where("not few").drop("few")).isEmpty():
        found = found.unionByName(_scanned(rows.join(many, group), group))
    return found.groupBy(F.col("id").alias("application_id"), "rule").agg(F.min("o").alias("evidence")).select("application_id", _name(some), "evidence")


def _compared(rows: DataFrame, group: list[str]) -> DataFrame:
    """Counterparts in keys with FEW rows at most: each row against all of its key, which are laid beside it."""
    beside = F.collect_list(F.struct("id", "x", "h")).over(Window.partitionBy(*group))
    apart = F.filter("beside", lambda q: (q["h"] != F.col("h")) & ((q["x"] <= F.col("below")) | (q["x"] >= F.col("above"))))
    least = F.array_min(F.transform(apart, lambda q: q["id"]))
    return rows.withColumn("beside", beside).select("rule", "id", least.alias("o")).where("o is not null")


def _scanned(rows: DataFrame, group: list[str]) -> DataFrame:
    """Counterparts in keys with any number of rows: running minima along the incomes."""
    marks = [
        F.struct(F.lit(side).alias("side"), F.lit(asks).alias("asks"), v.alias("v"))
        for side, asks, v in (("down", False, F.col("x")), ("down", True, F.col("below")), ("up", False, -F.col("x")), ("up", True, -F.col("above")))
    ]
    each = rows.select(*group, "h", "id", F.explode(F.array(*marks)).alias("m")).select(*group, "h", "id", "m.*").where("v is not null")
    group, order = [*group, "side"], ["v", "asks", "id"]
    laid = scan.laid_out(each, group, order)
    first = materialize(scan.preceding_min(laid, group, order, F.when(~F.col("asks"), F.struct("id", "h")), "first"), "first")
    # Where a row becomes the first of another household, the former first is the best of the rest from then on.
    former = F.col("first.id") < F.col("id")
    push = F.when(~F.col("asks") & (F.col("first.h") != F.col("h")), F.when(former, F.struct("id", "h")).otherwise(F.col("first")))
    both = scan.preceding_min(first, group, order, push, "second").where("asks")
    return both.select("rule", "id", F.when(F.col("first.h") != F.col("h"), F.col("first.id")).otherwise(F.col("second.id")).alias("o")).where("o is not null")


def _office() -> Column:
    return F.lower(F.trim("issuing_office"))


#: Rules on what occurs with several different values: rule -> (how many, key beside scope, value, condition on a row).
CLUSTERS: dict[str, Callable] = {
    "ADDRESS_CLUSTER_UNRELATED": lambda r: (r.params["households"], ["address_key"], "household", (F.col("declared_annual_income") <= _ceiling(r)) & (F.col("address_key") != "")),
    "ISSUING_OFFICE_MISMATCH": lambda r: (2, ["household"], _office(), _office() != ""),
    "DUPLICATE_CERTIFICATE_ID": lambda r: (2, [F.trim("certificate_id")], "application_id", F.trim("certificate_id") != ""),
    "FAMILY_SIZE_CONTRADICTION": lambda r: (2, ["household"], "declared_family_size", F.lit(True)),
    "SHARED_CONTACT_UNRELATED_HOUSEHOLDS": lambda r: (2, ["phone_key"], "household", F.col("phone_key").isNotNull()),
    "IDENTICAL_ROUND_INCOME_CLUSTER": lambda r: (
        r.params["households"], [_office(), "declared_annual_income"], "household",
        (F.col("declared_annual_income") > 0) & (F.col("declared_annual_income") % r.params["step"] == 0) & (_office() != ""),
    ),
}


def counted(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Adds n: the number of different values (null is none) in a row's group. Rows are shuffled and sorted once; the rows
    of a group are sorted in one task, which may spill them, and nothing of a group is held as a list."""
    over = Window.partitionBy(*group)
    rank = F.when(F.col(value).isNotNull(), F.dense_rank().over(over.orderBy(F.col(value).desc_nulls_last())))
    return rows.withColumn("n", F.coalesce(F.max(rank).over(over), F.lit(0)).cast("long"))


def clustered(pop: DataFrame, some: dict[str, Rule]) -> DataFrame:
    """Findings of rows whose key occurs with at least so many different values; evidence: their number. All rules are one
    shuffle, of rows of a rule, a key and a value each."""
    hits, least = [], []
    for i, (name, rule) in enumerate(some.items()):
        n, keys, value, fit = CLUSTERS[name](rule)
        text = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in (*keys, value)]
        hits.append(F.when(fit, F.struct(F.lit(i).alias("rule"), F.concat_ws("\x1f", *text[:-1]).alias("k"), text[-1].alias("v"))))
        least.append(F.lit(n))
    group = ["k", "rule", "scope"]  # a sort compares by the first eight bytes first, and scopes are few
    rows = _hits(pop, ["scope", "application_id"], hits)
    many = counted(rows, group, "v").where(F.col("n") >= F.get(F.array(*least), F.col("rule")))
    return many.select("application_id", _name(some), F.col("n").cast("string").alias("evidence"))


def _read(c: str, rule: Rule) -> Column:
    return F.col(c).isNotNull() & (F.col("read_confidence") >= rule.params["confidence"])


#: Rules on fields that must agree with what was read.
COMPARED = {
    "CERTIFICATE_HOLDER_MISMATCH": ("applicant_name", "guardian_name"), "CERTIFICATE_NUMBER_MISMATCH": ("certificate_id",),
    "CERTIFICATE_DETAILS_MISMATCH": ("district", "pincode", "family_size"),
}


def _bad(rule: Rule) -> Column:
    """Names of the fields that, declared and read well enough, disagree."""
    least = rule.params.get("similarity", 0.25)
    return F.concat_ws(", ", *[F.when(_read(f"read_{f}", rule) & ~agreement(f, least), F.lit(f)) for f in COMPARED[rule.name]])


def disagreeing(rule: Rule) -> tuple[Column, Column]:
    """Fires where a field disagrees; evidence: the fields' names, which row_findings has put in a column so that they are compared once."""
    bad = F.col(f"_{rule.name}")
    return bad != "", bad


def deadline(rule):
    days = F.datediff(F.make_date(F.col("scope").try_cast("int"), F.lit(7), F.lit(31)), "certificate_issue_date")
    return days.between(0, rule.params["days"]), days


def below_certificate(rule):
    d, c = F.col("declared_annual_income"), F.col("read_income")
    return _read("read_income", rule) & (c > d) & exceeds_tolerance(c, d, *_tolerance(rule)), c - d


def income_words(rule):
    return F.col("words_mismatch") & (F.col("read_confidence") >= rule.params["confidence"]), F.lit("words")


def tampered(rule):
    """An editor's name in the document's tags, or a tamper score at the configured threshold (there is none by default)."""
    edited = F.col("ela_applied").isNotNull() & editing_software(F.col("software"))
    least = rule.params.get("tamper_score")
    if least is None:
        return edited, F.col("software")
    high = F.coalesce(F.col("ela_applied") & (F.col("tamper_score") >= least), F.lit(False))
    return edited | high, F.when(edited, F.col("software")).otherwise(F.concat(F.lit("score "), F.round("tamper_score", 3).cast("string")))


def government_record(rule):
    return F.col("verification") == "mismatch", F.col("verification")


def not_a_certificate(rule):
    p = rule.params
    legible = (F.col("word_count") >= p["words"]) & (F.col("read_confidence") >= p["confidence"])
    return legible & (F.col("fields_found") < p["fields"]), F.col("fields_found")


#: Rules on one row: rule -> (condition, evidence).
ROW_RULES: dict[str, Callable] = {
    "DEADLINE_PROXIMITY": deadline, "DECLARED_INCOME_BELOW_CERTIFICATE": below_certificate,
    "CERTIFICATE_HOLDER_MISMATCH": disagreeing, "CERTIFICATE_NUMBER_MISMATCH": disagreeing,
    "CERTIFICATE_INCOME_WORDS_MISMATCH": income_words, "CERTIFICATE_DETAILS_MISMATCH": disagreeing,
    "DOCUMENT_TAMPER_SIGNAL": tampered, "GOVERNMENT_RECORD_MISMATCH": government_record, "DOCUMENT_NOT_A_CERTIFICATE": not_a_certificate,
}
_NAMED = "CERTIFICATE_HOLDER_MISMATCH"


def row_findings(pop: DataFrame, some: dict[str, Rule]) -> DataFrame:
    """Findings of the rules on one row, all in one scan."""
    hits = []
    for name, rule in some.items():
        fires, evidence = ROW_RULES[name](rule)
        hits.append(F.when(fires, F.struct(F.lit(name).alias("rule"), evidence.cast("string").alias("evidence"))))
    rows = named(pop) if _NAMED in some else pop
    rows = rows.withColumns({f"_{n}": _bad(r) for n, r in some.items() if n in COMPARED})
    return _hits(rows, ["application_id"], hits)


def holder_findings(pop: DataFrame, rule: Rule) -> DataFrame:
    """As row_findings gives them for this rule alone. Names that don't agree plainly are few; they are written, each different
    pair of them is compared once, and the rows look their pairs up."""
    fields, least = COMPARED[rule.name], rule.params.get("similarity", 0.25)
    asked = [_read(f"read_{f}", rule) & F.col(f).isNotNull() & ~plainly_same(F.col(f), F.col(f"read_{f}")) for f in fields]
    both = [F.when(q, F.struct(F.col(f).alias("a"), F.col(f"read_{f}").alias("b"))).alias(f"_{f}") for f, q in zip(fields, asked)]
    rows = pop.select("application_id", *both).where(" or ".join(f"_{f} is not null" for f in fields))
    rows = materialize(rows, "names")
    pairs = rows.select(F.explode(F.array(*[f"_{f}" for f in fields])).alias("p")).where("p is not null").distinct()
    norm = pairs.select("p", normalize_name(F.col("p.a")).alias("x"), normalize_name(F.col("p.b")).alias("y"))
    apart = materialize(norm.where(~names_agree(F.col("x"), F.col("y"), least)).select("p"), "apart")
    for f in fields:
        rows = rows.join(apart.select(F.col("p").alias(f"_{f}"), F.lit(f).alias(f"bad_{f}")), f"_{f}", "left")
    bad = F.concat_ws(", ", *[f"bad_{f}" for f in fields])
    return _found(rows.where(bad != ""), rule, bad)


def bunching(pop, rule):
    p, inc = rule.params, F.col("declared_annual_income")
    top = _ceiling(rule)
    width = top * p["band"] / 100
    band, below = (inc > top - width) & (inc <= top), (inc > top - 2 * width) & (inc <= top - width)
    counts = pop.groupBy("scope").agg(F.count_if(band).alias("n"), F.count_if(below).alias("m"))
    dense = counts.where((F.col("n") >= p["least"]) & (F.col("n") >= p["ratio"] * F.greatest("m", F.lit(1))))
    return _found(pop.where(band).join(dense, "scope"), rule, F.col("n"))


def serial_runs(pop: DataFrame, span: int, least: int = 1) -> DataFrame:
    """(scope, office, series, lo, hi): the widest stretches of serials within span that hold so many rows at least; stretches may overlap."""
    w = Window.partitionBy("scope", "office", "series").orderBy("serial")
    one, back = pop.groupBy("scope", "office", "series", "serial").agg(F.count(F.lit(1)).alias("n")), w.rangeBetween(-span, 0)
    one = one.withColumns({"lo": F.min("serial").over(back), "rows": F.sum("n").over(back), "next": F.lead("serial").over(w)})
    return one.where(F.col("rows") >= least).where(F.col("next").isNull() | (F.col("next") - F.col("lo") > span)).select("scope", "office", "series", "lo", F.col("serial").alias("hi"))


def with_serials(pop: DataFrame) -> DataFrame:
    tail = pop.withColumn("t", serial_tail(F.col("certificate_id"))).withColumn("office", F.lower(F.trim("issuing_office")))
    return tail.select("*", F.col("t.series").alias("series"), F.col("t.serial").alias("serial")).where("serial is not null and office <> ''").drop("t")


def meeting(rows: DataFrame, runs: DataFrame, span: int) -> DataFrame:
    """rows with the runs of their own stretch of serials, a superset of those they lie in. A run is no wider than the span,
    so it lies in two stretches at most, and a row meets as few runs however many its office has."""
    stretch = lambda c: F.expr(f"{c} div {int(span) + 1}")
    laid = runs.withColumn("stretch", F.explode(F.array_distinct(F.array(stretch("lo"), stretch("hi")))))
    return rows.withColumn("stretch", stretch("serial")).join(laid, ["scope", "office", "series", "stretch"]).drop("stretch")


#: Widths of a stretch of serials (span + 1) that are searched for close rows in one group.
STRETCHES = 64


def close(rows: DataFrame, span: int, least: int) -> DataFrame:
    """rows without those that lie in no stretch of serials, as wide as span, that holds so many rows; they are in no run
    of so many, and the runs of the others stay as they are. Rows are grouped by blocks of serials, near a block's border
    by the next block too, so no group holds an office."""
    if least < 2:
        return rows
    size = STRETCHES * (span + 1)
    block, rest = F.expr(f"serial div {size}"), F.col("serial") % size
    near = F.array(block, F.when(rest < span, block - 1), F.when(rest >= size - span, block + 1))
    laid = rows.select("*", F.explode(near).alias("block")).where("block is not null")
    w = Window.partitionBy("block", "office", "scope", "series").orderBy("serial")
    at = lambda i: F.lead("serial", i).over(w) if i > 0 else F.lag("serial", -i).over(w) if i else F.col("serial")
    fit = F.lit(False)
    for i in range(least):
        fit = fit | F.coalesce(at(least - 1 - i) - at(-i) <= span, F.lit(False))
    return laid.withColumn("fit", fit).where(F.col("fit") & (F.col("block") == block)).select(*rows.columns)


def serial_adjacency(pop, rule):
    p = rule.params
    rows = with_serials(pop).select("application_id", "household", "scope", "office", "series", "serial")
    rows = materialize(close(rows, p["span"], p["households"]), "serials")
    runs = serial_runs(rows, p["span"], p["households"])  # fewer rows can't be so many households
    members = meeting(rows, runs, p["span"]).where("serial between lo and hi").select("application_id", "household", "scope", "office", "series", "lo", "hi")
    wide = counted(members, ["lo", "hi", "office", "scope", "series"], "household").where(F.col("n") >= p["households"])
    return _found(wide, rule, F.concat_ws("-", "lo", "hi"))


def fragmentation(pairs: DataFrame, rule: Rule) -> DataFrame:
    """From scored pairs: both sides of every unlinked pair near the threshold on several fields; a score that is rounded
    up to the threshold is neither linked nor near."""
    p = rule.params
    near = pairs.where(~F.col("linked") & (F.col("score") >= p["floor"]) & (F.col("score") < LINK) & (F.size("edges") >= p["fields"]))
    sides = near.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("s"))
    return _found(sides.select(F.col("s.x").alias("application_id"), F.col("s.y").alias("y")), rule, F.col("y"))


def _together(name: str, rules_of_a_kind: Callable) -> Callable:
    return lambda pop, rule: rules_of_a_kind(pop, {name: rule})


#: Rules that group the population: (population, rule) -> findings.
GROUP_RULES: dict[str, Callable] = {n: _together(n, contradictions) for n in CONTRADICTIONS} | {n: _together(n, clustered) for n in CLUSTERS}
GROUP_RULES |= {"INCOME_THRESHOLD_BUNCHING": bunching, "CERTIFICATE_SERIAL_ADJACENCY": serial_adjacency}


#: The columns that rules read which group the population.
GROUPED = (
    "application_id", "scope", "household", "guardian_key", "address_key", "phone_key", "declared_annual_income", "declared_family_size", "certificate_id", "issuing_office",
)


def _one(name: str) -> Callable:
    if name == _NAMED:
        return holder_findings
    return GROUP_RULES.get(name) or (lambda pop, rule: row_findings(pop, {name: rule}))


FUNCTIONS: dict[str, Callable] = {n: _one(n) for n in RULES if n in GROUP_RULES or n in ROW_RULES}
sibling_income = FUNCTIONS["SIBLING_INCOME_CONTRADICTION"]


def corroborated(findings: DataFrame, some: dict[str, Rule] | None = None) -> DataFrame:
    """Without the findings that need another one, not of a population rule, on the same application; some: the rules as configured.

    Of written findings those that need another are written once more: they are few, so what could support them is
    looked up among all findings without a shuffle.
    """
    known = RULES | (some or {})
    weak = [n for n, r in known.items() if r.corroborated]
    needs = F.col("rule").isin(weak)
    asking = findings.where(needs)
    if is_written(findings):
        asking = materialize(asking, "asking")
    support = findings.where(~F.col("rule").isin(weak + [n for n, r in known.items() if r.population])).join(asking.select("application_id"), "application_id", "left_semi")
    return findings.where(~needs).unionByName(asking.join(support.select("application_id"), "application_id", "left_semi"))


def findings(pop: DataFrame, version: int = 5, pairs: DataFrame | None = None, config: dict[str, dict] | None = None) -> DataFrame:
    """All findings of a version's rules (or of those that a configuration leaves in), corroboration applied.

    The population is evaluated three times: the columns that the groupings read are written once, the rules on one row are
    one scan, which needs no household, and names that don't agree plainly are one more. One that has been materialized is read as it is. The findings are written too, as
    flags, scores and reports read them. Rules of a kind are evaluated together.
    """
    some = active(version, config)
    written = pop if is_written(pop) else materialize(pop.select(*[c for c in GROUPED if c in pop.columns]), "population")
    kinds = ((ROW_RULES, pop, row_findings), (CLUSTERS, written, clustered), (CONTRADICTIONS, written, contradictions))
    parts = [f(rows, of) for names, rows, f in kinds if (of := {n: r for n, r in some.items() if n in names and n != _NAMED})]
    parts += [holder_findings(pop, some[_NAMED])] if _NAMED in some else []
    parts += [GROUP_RULES[n](written, r) for n, r in some.items() if n in GROUP_RULES and n not in CLUSTERS and n not in CONTRADICTIONS]
    if pairs is not None and "HOUSEHOLD_FRAGMENTATION" in some:
        parts.append(fragmentation(pairs, some["HOUSEHOLD_FRAGMENTATION"]))
    if not parts:
        return written.select("application_id", F.lit("").alias("rule"), F.lit("").alias("evidence")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = materialize(out, "findings")
    if written is not pop:
        release(written)
    return corroborated(out, some)


def stamped(found: DataFrame, version: int) -> DataFrame:
    """Findings with the version that gave them, as they are stored."""
    return found.withColumn("version", F.lit(f"v{version}"))


def _of_rule(what: str, config: dict[str, dict] | None = None) -> Column:
    known = RULES if config is None else RULES | configured(max(r.since for r in RULES.values()), config)
    pairs = [F.lit(x) for n, r in known.items() for x in (n, getattr(r, what))]
    return F.create_map(*pairs)[F.col("rule")]


def flags(found: DataFrame, config: dict[str, dict] | None = None) -> DataFrame:
    """One row for each application and rule: the greatest evidence stands. Rows are dealt by application, so what is grouped
    by it afterwards needs no other shuffle."""
    one = found.repartition("application_id").groupBy("application_id", "rule").agg(F.max("evidence").alias("evidence"))
    return one.withColumns({"severity": _of_rule("severity", config), "weight": _of_rule("weight", config)})


def scores(pop: DataFrame, found: DataFrame, score_from: str = "findings", config: dict[str, dict] | None = None) -> DataFrame:
    """Summed weights of findings (every one counts) or of flags (one for a rule); 0 where there are none."""
    rows = found if score_from == "findings" else found.select("application_id", "rule").distinct()
    total = rows.groupBy("application_id").agg(F.sum(_of_rule("weight", config)).cast("long").alias("s"))
    return pop.select("application_id").join(total, "application_id", "left").select("application_id", F.coalesce("s", F.lit(0)).alias("risk_score"))


def peak_severity(found: DataFrame) -> DataFrame:
    """The highest severity among each application's findings."""
    order = F.array(F.lit("low"), F.lit("medium"), F.lit("high"))
    top = found.groupBy("application_id").agg(F.max(F.array_position(order, _of_rule("severity"))).alias("p"))
    return top.select("application_id", F.get(order, (F.col("p") - 1).cast("int")).alias("severity"))


def change_set(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows to insert, update or delete to turn old into new, with the new values."""
    o = old.select(*keys, F.struct(*values).alias("o"))
    n = new.select(*keys, F.struct(*values).alias("n"))
    both = o.join(n, keys, "full")
    kind = F.when(F.col("o").isNull(), "I").when(F.col("n").isNull(), "D").when(~F.col("o").eqNullSafe(F.col("n")), "U")
    return both.withColumn("change", kind).where("change is not null").select(*keys, "change", *[F.col(f"n.{v}").alias(v) for v in values])


def configs_differ(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (rule, enabled, severity, weight) that the new configuration has and the old one has not."""
    return new.exceptAll(old.select(*new.columns))
