"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimlens.functions import similarity, text
from claimlens.operators import intake, queue, resolve, rules
from claimlens.operators import engine
from claimlens.plans.population import SQL, applications, population
from claimlens.session import dealt, materialize, table

QUERIES, ORACLE = {}, {}


def register(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_POP = f"with pop as materialized ({SQL})"
_APART = "({a} + {b} - abs({a} - {b})) / 2"


def _tolerance(a: str, b: str) -> str:
    return f"(greatest({a}, {b}) > 0 and 100 * abs({a} - {b}) > 15 * greatest({a}, {b}) and abs({a} - {b}) > 12000)"


def _counterpart(on: str) -> str:
    """The least id of the rows that contradict the income of p."""
    a, b = "p.declared_annual_income", "q.declared_annual_income"
    return f"""select p.application_id, min(q.application_id) as o
        from pop p join pop q on p.scope = q.scope and {on} and {_tolerance(a, b)} group by p.application_id"""


def _finding(rule: str, evidence: str, rest: str) -> str:
    return f"{_POP} select p.application_id, '{rule}' as rule, cast({evidence} as varchar) as evidence {rest}"


def _clustered(keys: str, where: str, least: int, n: str = "household") -> str:
    on = " and ".join(f"p.{k} = g.{k}" for k in ("scope", *keys.split(", ")))
    return f"from (select * from pop where {where}) p join (select scope, {keys}, count(distinct {n}) as n from pop where {where} group by scope, {keys} having count(distinct {n}) >= {least}) g on {on}"


def _alnum(c: str) -> str:
    return f"regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g')"


def _grams(c: str) -> str:
    return f"list_distinct([substr('  ' || lower({_alnum(c)}) || ' ', i, 3) for i in range(1, length({_alnum(c)}) + 2)])"


_BOTH = f"len(list_intersect({_grams('district')}, {_grams('read_district')}))"
AGREE = {
    "certificate_id": f"({_alnum('certificate_id')} = {_alnum('read_certificate_id')})",
    "district": f"({_BOTH} >= 0.5 * (len({_grams('district')}) + len({_grams('read_district')}) - {_BOTH}))",
    "pincode": "(left(pincode, 3) = left(read_pincode, 3))",
    "family_size": "(declared_family_size = read_family_size)",
}
RULE_SQL = {
    "SIBLING_INCOME_CONTRADICTION": ("o", f"from ({_counterpart('p.household = q.household')}) p"),
    "GUARDIAN_INCOME_CONTRADICTION": ("o", f"from ({_counterpart('p.guardian_key = q.guardian_key and p.household <> q.household')}) p"),
    "ADDRESS_CLUSTER_UNRELATED": ("g.n", _clustered("address_key", f"declared_annual_income <= {rules.CEILING}", 3)),
    "ISSUING_OFFICE_MISMATCH": ("g.n", _clustered("household", "issuing_office is not null", 2, "lower(trim(issuing_office))")),
    "DUPLICATE_CERTIFICATE_ID": ("g.n", _clustered("certificate_id", "certificate_id is not null", 2, "application_id")),
    "FAMILY_SIZE_CONTRADICTION": ("g.n", _clustered("household", "true", 2, "declared_family_size")),
    "SHARED_CONTACT_UNRELATED_HOUSEHOLDS": ("g.n", _clustered("phone_key", "phone_key is not null", 2)),
    "DEADLINE_PROXIMITY": ("d", "from (select *, date_diff('day', certificate_issue_date, make_date(cast(scope as int), 7, 31)) as d from pop) p where d between 0 and 14"),
    "DECLARED_INCOME_BELOW_CERTIFICATE": ("read_income - declared_annual_income", f"from pop p where read_confidence >= 0.8 and read_income > declared_annual_income and {_tolerance('read_income', 'declared_annual_income')}"),
    "CERTIFICATE_HOLDER_MISMATCH": ("'applicant_name'", "from pop p where read_confidence >= 0.8 and read_applicant_name <> upper(applicant_name)"),
    "CERTIFICATE_NUMBER_MISMATCH": ("'certificate_id'", f"from pop p where read_confidence >= 0.8 and {AGREE['certificate_id']} = false"),
    "CERTIFICATE_INCOME_WORDS_MISMATCH": ("'words'", "from pop p where words_mismatch and read_confidence >= 0.8"),
    "CERTIFICATE_DETAILS_MISMATCH": ("bad", f"from (select *, concat_ws(', ', {', '.join(f"case when not {AGREE[k]} then '{k}' end" for k in ('district', 'pincode', 'family_size'))}) as bad from pop where read_confidence >= 0.8) p where bad <> ''"),
    "DOCUMENT_TAMPER_SIGNAL": ("software", "from pop p where software ilike '%photoshop%' and ela_applied is not null"),
    "GOVERNMENT_RECORD_MISMATCH": ("verification", "from pop p where verification = 'mismatch'"),
    "DOCUMENT_NOT_A_CERTIFICATE": ("fields_found", "from pop p where word_count >= 40 and read_confidence >= 0.8 and fields_found < 3"),
    "INCOME_THRESHOLD_BUNCHING": ("n", """from pop p join (select scope, count(*) filter (declared_annual_income > 230000 and declared_annual_income <= 250000) as n,
        count(*) filter (declared_annual_income > 210000 and declared_annual_income <= 230000) as m from pop group by scope) g on p.scope = g.scope
        where declared_annual_income > 230000 and declared_annual_income <= 250000 and n >= 4 and n >= 2.5 * greatest(m, 1)"""),
    "IDENTICAL_ROUND_INCOME_CLUSTER": ("g.n", _clustered("issuing_office, declared_annual_income", "declared_annual_income > 0 and declared_annual_income % 10000 = 0", 3)),
    "CERTIFICATE_SERIAL_ADJACENCY": ("lo || '-' || hi", """from (select r.*, count(distinct household) over (partition by scope, issuing_office, lo, hi) as n from
        (select s.application_id, s.scope, s.issuing_office, s.household, w.lo, w.hi from
          (select *, cast(substr(certificate_id, 9) as bigint) as serial from pop where certificate_id is not null) s join
          (select scope, issuing_office, lo, serial as hi from (select scope, issuing_office, serial,
              min(serial) over (partition by scope, issuing_office order by serial range between 12 preceding and current row) as lo,
              lead(serial) over (partition by scope, issuing_office order by serial) as nx
            from (select distinct scope, issuing_office, cast(substr(certificate_id, 9) as bigint) as serial from pop where certificate_id is not null))
           where nx is null or nx - lo > 12) w
          on s.scope = w.scope and s.issuing_office = w.issuing_office and s.serial between w.lo and w.hi) r) p where n >= 3"""),
}


def _rule_query(name: str):
    def query(spark, sf_dir):
        return rules.FUNCTIONS[name](population(spark, sf_dir), rules.RULES[name])

    return query


for _n, (_evidence, _rest) in RULE_SQL.items():
    QUERIES[f"rule_{_n.lower()}"] = _rule_query(_n)
    ORACLE[f"rule_{_n.lower()}"] = _finding(_n, _evidence, _rest)

_BODIES = {n: _finding(n, e, r).removeprefix(_POP) for n, (e, r) in RULE_SQL.items()}
_FOUND = " union all ".join(f"({b})" for b in _BODIES.values())
_WEIGHTS = ", ".join(f"('{n}', '{r.severity}', {r.weight}, {str(r.population or r.corroborated).lower()})" for n, r in rules.RULES.items())
_ALL = f"""{_POP}, w(rule, severity, weight, soft) as (values {_WEIGHTS}), f0 as materialized ({_FOUND}),
hard as (select distinct application_id, true as backed from f0 join w using (rule) where not soft),
f as materialized (select application_id, rule, evidence from f0 left join hard using (application_id) where rule <> 'DEADLINE_PROXIMITY' or backed),
fl as materialized (select application_id, rule, max(evidence) as evidence, any_value(severity) as severity, any_value(weight) as weight from f join w using (rule) group by application_id, rule),
sc as materialized (select p.application_id, cast(coalesce(sum(weight), 0) as bigint) as risk_score from pop p left join (select application_id, weight from f join w using (rule)) x using (application_id) group by p.application_id)"""


@register(f"{_ALL} select application_id, rule, evidence from f")
def r22_findings(spark, sf_dir):
    return rules.findings(population(spark, sf_dir))


@register(f"{_ALL} select application_id, rule, evidence, severity, weight from fl")
def r27_flags(spark, sf_dir):
    return rules.flags(rules.findings(population(spark, sf_dir)))


@register(f"{_ALL} select * from sc")
def r23_scores(spark, sf_dir):
    pop = population(spark, sf_dir)
    return rules.scores(pop, rules.findings(pop))


_STORED = """select application_id, rule, evidence, case when cast(application_id as bigint) % 7 = 0 then weight + 1 else weight end as weight from fl
  where rule <> 'DOCUMENT_NOT_A_CERTIFICATE' and cast(application_id as bigint) % 5 <> 0
 union all select application_id, 'RETIRED_RULE', 'x', 5 from fl where rule = 'DOCUMENT_TAMPER_SIGNAL'"""


def _stored(flags):
    """A stored set without the newest rule and a fifth of the applications, with some other weights, and with flags of a rule that is gone."""
    number = F.col("application_id").cast("long")
    old = flags.where((F.col("rule") != "DOCUMENT_NOT_A_CERTIFICATE") & (number % 5 != 0)).withColumn("weight", F.when(number % 7 == 0, F.col("weight") + 1).otherwise(F.col("weight")))
    gone = flags.where("rule = 'DOCUMENT_TAMPER_SIGNAL'").select("application_id", F.lit("RETIRED_RULE").alias("rule"), F.lit("x").alias("evidence"), F.lit(5).alias("weight"))
    return old.select("application_id", "rule", "evidence", "weight").unionByName(gone)


@register(f"""{_ALL}, old as ({_STORED})
select application_id, rule, case when o.rule is null then 'I' when n.rule is null then 'D' else 'U' end as change, coalesce(n.evidence, '') as evidence, coalesce(n.weight, 0) as weight
from fl n full join old o using (application_id, rule) where o.rule is null or n.rule is null or o.weight <> n.weight or o.evidence is distinct from n.evidence""")
def r26_change_set(spark, sf_dir):
    new = materialize(rules.flags(rules.findings(population(spark, sf_dir))), "flags")
    return rules.change_set(_stored(new), new, ["application_id", "rule"], ["evidence", "weight"]).fillna({"evidence": "", "weight": 0})


@register(f"""{_ALL}, old as ({_STORED}) select o.application_id, o.rule, 'v5' as version from old o left join fl n using (application_id, rule) where n.rule is null""")
def r27_stale_flags(spark, sf_dir):
    new = materialize(rules.flags(rules.findings(population(spark, sf_dir))), "flags")
    return engine.stale_flags(_stored(new).withColumn("version", F.lit("v5")), new, "v5")


@register(f"""{_ALL}, t as (select application_id, count(*) as flag_count, count(*) filter (severity = 'high') as high_count,
  arg_max(rule, (weight, rule)) as top_rule from fl group by application_id)
select p.application_id, p.scope, p.district, p.status, sc.risk_score, coalesce(flag_count, 0) as flag_count, coalesce(high_count, 0) as high_count, top_rule
from pop p join sc using (application_id) left join t using (application_id) where p.status = 'submitted'
order by risk_score desc, submitted_on, application_id limit 100""")
def q1_review_queue(spark, sf_dir):
    pop = population(spark, sf_dir)
    found = rules.findings(pop)
    return queue.page(pop, rules.flags(found), rules.scores(pop, found), status="submitted", limit=100)


@register()
def r22_resolved_findings(spark, sf_dir):
    """r22 over resolved households and normal keys, with the rule on scored pairs."""
    return engine.run(dealt(applications(spark, sf_dir), "application_id")).findings


@register()
def r23_resolved_scores(spark, sf_dir):
    return engine.run(dealt(applications(spark, sf_dir), "application_id")).scores


@register()
def q1_resolved_queue(spark, sf_dir):
    run = engine.run(dealt(applications(spark, sf_dir), "application_id"))
    return queue.page(run.population, run.flags, run.scores, status="submitted", limit=100)


_REASONS = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in engine.SENTENCES.items())


def _rupees(v: str) -> str:
    return f"""('₹' || case when {v} < 1000 then cast({v} as varchar) when {v} < 100000 then ({v} // 1000) || ',' || lpad(cast({v} % 1000 as varchar), 3, '0')
 when {v} < 10000000 then ({v} // 100000) || ',' || lpad(cast({v} // 1000 % 100 as varchar), 2, '0') || ',' || lpad(cast({v} % 1000 as varchar), 3, '0') end)"""


@register(f"""{_ALL}, t(rule, sentence) as (values {_REASONS}), g as (select f.*, sentence, abs(p.declared_annual_income - q.declared_annual_income) as gap,
 greatest(p.declared_annual_income, q.declared_annual_income) as top, f.rule in ('SIBLING_INCOME_CONTRADICTION', 'GUARDIAN_INCOME_CONTRADICTION') as named
 from f join t using (rule) join pop p using (application_id) left join pop q on q.application_id = f.evidence)
select application_id, rule, evidence, 'v5' as version, replace(sentence, '{{n}}', case when rule = 'DECLARED_INCOME_BELOW_CERTIFICATE' then {_rupees('cast(evidence as bigint)')} else evidence end)
 || case when named then ': a gap of ' || {_rupees('gap')} || ' (' || cast(round(100 * gap / top) as int) || '%)' else '' end as reason from g""")
def r25_reasons(spark, sf_dir):
    """Sentences of all findings, with amounts, and the version."""
    pop = population(spark, sf_dir)
    found = rules.stamped(rules.findings(pop), 5)
    return engine.reasons(found, pop).select("application_id", "rule", "evidence", "version", "reason")


@register(f"""{_POP} select application_id, 'ready_for_review' as status from pop where status in ('submitted', 'processing') and cast(application_id as bigint) % 2 = 0""")
def r28_promotion(spark, sf_dir):
    """Requests came for every second application."""
    pop = population(spark, sf_dir)
    return engine.promoted(pop, pop.where("cast(application_id as bigint) % 2 = 0"))


@register(f"""{_POP} select distinct p.application_id, q.application_id as member from pop p join pop q using (scope, household) where p.status = 'ready_for_review'""")
def g2_household_lookup(spark, sf_dir):
    pop = population(spark, sf_dir)
    return engine.household_of(pop, pop.where("status = 'ready_for_review'"))


@register(f"""{_POP} select distinct scope, household from pop where application_id in (select application_id from pop where certificate_id is null)""")
def g5_affected_households(spark, sf_dir):
    """Applications without a certificate stand for those that have just come in."""
    pop = population(spark, sf_dir)
    return engine.affected(pop.where("certificate_id is null"), pop)


@register("""with o as (select least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b, l_shipmode as field, max(l_discount) as similarity, bool_or(l_returnflag = 'R') as rejected
 from (select *, case l_linenumber % 4 when 0 then 'guardian' when 1 then 'applicant' when 2 then 'address' else 'phone' end as l_shipmode from lineitem where l_orderkey % 3 <> 0) group by 1, 2, 3),
n as (select least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b, l_shipmode as field, max(l_discount) as similarity
 from (select *, case l_linenumber % 4 when 0 then 'guardian' when 1 then 'applicant' when 2 then 'address' else 'phone' end as l_shipmode from lineitem where l_orderkey % 4 <> 0) group by 1, 2, 3)
select a, b, field, case when o.similarity is null then 'I' else 'U' end as change, n.similarity from n left join o using (a, b, field)
 where not coalesce(rejected, false) and (o.similarity is null or o.similarity <> n.similarity)""")
def s9_edge_changes(spark, sf_dir):
    """Line items stand for edges of two runs; returned ones for edges that a reviewer has rejected."""
    field = F.get(F.array(*map(F.lit, ("guardian", "applicant", "address", "phone"))), (F.col("l_linenumber") % 4).cast("int"))
    e = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"), field.alias("field"), "l_discount"
    )
    edge = ["a", "b", "field"]
    old = e.where("l_orderkey % 3 <> 0").groupBy(*edge).agg(F.max("l_discount").alias("similarity"), F.bool_or(F.col("l_returnflag") == "R").alias("rejected"))
    new = e.where("l_orderkey % 4 <> 0").groupBy(*edge).agg(F.max("l_discount").alias("similarity"))
    one = F.lit(1.0).alias("weight")
    return engine.edge_changes(old.select("*", one), new.select("*", one)).drop("weight")


@register(f"{_ALL} select rule, count(*) as n from fl group by rule")
def q2_fired_rules(spark, sf_dir):
    return rules.flags(rules.findings(population(spark, sf_dir))).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@register(f"{_POP} select distinct district from pop")
def q3_districts(spark, sf_dir):
    return population(spark, sf_dir).select("district").distinct()


@register(f"""{_ALL} select scope, count(*) as total, count(*) filter (status <> 'approved') as awaiting, count(*) filter (status = 'approved') as decided,
 count(*) filter (application_id in (select application_id from fl)) as flagged from pop group by scope""")
def q4_cycle_summary(spark, sf_dir):
    pop = population(spark, sf_dir)
    return queue.cycle_summary(pop, rules.flags(rules.findings(pop)))


@register(f"{_POP} select application_id, applicant_name from pop where applicant_name ilike '%kum%' or certificate_id ilike '%00017%'")
def q5_text_search(spark, sf_dir):
    return queue.search(population(spark, sf_dir), "kum", "00017").select("application_id", "applicant_name")


@register(f"""{_ALL} select application_id, string_agg(distinct rule, '; ' order by rule) as fired from fl group by application_id""")
def q6_export(spark, sf_dir):
    return queue.export(rules.flags(rules.findings(population(spark, sf_dir))))


@register(f"""{_POP}, d as (select l_orderkey as k, count(*) as n from lineitem group by 1)
select application_id, scope, case status when 'submitted' then 'submitted' when 'approved' then 'decided' else 'under_review' end as stage, submitted_on, coalesce(n, 0) as document_count
from pop left join d on k = cast(application_id as bigint)""")
def q9_applicant_view(spark, sf_dir):
    """An order's line items stand for the documents of an application."""
    docs = table(spark, sf_dir, "lineitem").select(F.lpad(F.col("l_orderkey").cast("string"), 8, "0").alias("application_id"))
    return queue.applicant_view(population(spark, sf_dir), docs)


@register(f"""{_POP} select application_id, right(regexp_replace(guardian_phone, '[^0-9]', '', 'g'), 10) as phone from pop where guardian_phone is not null""")
def n4_phone(spark, sf_dir):
    a = applications(spark, sf_dir).where("guardian_phone is not null")
    return a.select("application_id", text.normalize_phone(F.col("guardian_phone")).alias("phone"))


def _spelled(x: str) -> str:
    for a, b in text.SPELLINGS:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        x = f"regexp_replace({x}, '{c}{c}+', '{c}', 'g')"
    return x


_TITLES = ", ".join(f"'{w}'" for w in text.HONORIFICS)
_NAME = f"[t for t in string_split(trim(regexp_replace(lower(n), '[^a-z]+', ' ', 'g')), ' ') if t <> '' and t not in ({_TITLES})]"


@register(f"""{_POP} select n as name, array_to_string([{_spelled('t')} for t in ts if length(t) > 1], ' ') as canonical,
 array_to_string([t for t in ts if length(t) = 1], ' ') as initials from (select n, {_NAME} as ts from (select distinct guardian_name as n from pop union select distinct applicant_name from pop))""")
def n2_name(spark, sf_dir):
    a = applications(spark, sf_dir)
    names = a.select(F.col("guardian_name").alias("name")).union(a.select("applicant_name")).distinct()
    n = text.normalize_name(F.col("name"))
    return names.select("name", n["canonical"].alias("canonical"), F.array_join(n["initials"], " ").alias("initials"))


_KNOWN = "case t " + " ".join(f"when '{a}' then '{b}'" for a, b in text.ADDRESS_WORDS.items()) + " else t end"


@register(f"""{_POP} select line as address, array_to_string([case when regexp_matches(t, '^[0-9]+$') then t else {_spelled('t')} end for t in us], ' ') as canonical from
 (select line, [t for t in [{_KNOWN} for t in ts] if t <> ''] as us from (select line, string_split(trim(regexp_replace(regexp_replace(lower(line), '([0-9]+)(st|nd|rd|th)', '\\1', 'g'), '[^a-z0-9]+', ' ', 'g')), ' ') as ts
 from (select distinct address_line || ' ' || district as line from pop)))""")
def n3_address(spark, sf_dir):
    a = applications(spark, sf_dir).select(F.concat_ws(" ", "address_line", "district").alias("address")).distinct()
    return a.select("address", text.normalize_address(F.col("address")).alias("canonical"))


@register(f"""{_POP}, m as (select distinct declared_annual_income as v from pop)
select v, '₹' || case when v < 1000 then cast(v as varchar) else reverse(regexp_replace(reverse(cast(v // 1000 as varchar)), '([0-9][0-9])(?:)', '\\1,', 'g')) end as x from m where false
union all select v, '₹' || case when v < 1000 then cast(v as varchar) when v < 100000 then (v // 1000) || ',' || lpad(cast(v % 1000 as varchar), 3, '0')
 when v < 10000000 then (v // 100000) || ',' || lpad(cast(v // 1000 % 100 as varchar), 2, '0') || ',' || lpad(cast(v % 1000 as varchar), 3, '0') end as x from m""")
def n9_rupees(spark, sf_dir):
    m = applications(spark, sf_dir).select(F.col("declared_annual_income").alias("v")).distinct()
    return m.select("v", text.format_inr(F.col("v")).alias("x"))


_WORDS = "unnest(string_split(lower(p_name), ' '))"


@register("""with w as (select distinct p_name as a, p_type as b from part),
g as (select a, b, list_distinct(flatten([[substr('  ' || t || ' ', i, 3) for i in range(1, length(t) + 2)] for t in string_split(regexp_replace(lower(a), '[^a-z0-9]+', ' ', 'g'), ' ') if t <> ''])) as x,
 list_distinct(flatten([[substr('  ' || t || ' ', i, 3) for i in range(1, length(t) + 2)] for t in string_split(regexp_replace(lower(b), '[^a-z0-9]+', ' ', 'g'), ' ') if t <> ''])) as y from w)
select a, b, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) as similarity from g""")
def m2_trigram_similarity(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("a"), F.col("p_type").alias("b")).distinct()
    return p.select("a", "b", F.round(similarity.trigram_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@register("""select user_id, hour, n from (select user_id, date_trunc('hour', ts) as hour, count(*) as n from events group by 1, 2) where n > 1""")
def w5_rate_windows(spark, sf_dir):
    from claimlens.streaming.jobs import over_limit

    e = table(spark, sf_dir, "events")
    return over_limit(e, "ts", "user_id", "1 hour", 1).select("user_id", "hour", "n")


@register("""select user_id, last_type, cast(last_ts as timestamp) as last_ts from (select user_id, event_type as last_type, ts as last_ts,
 row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1""")
def j8_latest_per_key(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    return last.select("user_id", F.col("m.event_type").alias("last_type"), F.col("m.ts").alias("last_ts"))


@register("""with d as (select user_id, event_id, event_type, ts, row_number() over (partition by user_id order by ts, event_id) as k,
 min(case when event_type in ('purchase', 'signup') then event_id end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as done from events)
select user_id, event_id, event_type, done is null as accepted from d""")
def q12_decision_fold(spark, sf_dir):
    """The first terminal decision of a key wins; later ones are refused."""
    return queue.decision_fold(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type").isin("purchase", "signup")).select(
        "user_id", "event_id", "event_type", "accepted"
    )


@register("""with s as (select l.doc_id, l.toxic, d.n_chars % 100 as score from labels l join documents d using (doc_id) where l.toxic is not null),
r as (select toxic, (rank() over (order by score) + rank() over (order by score) + count(*) over (partition by score) - 1) / 2.0 as rk from s)
select round((sum(rk) filter (toxic = 1) - count(*) filter (toxic = 1) * (count(*) filter (toxic = 1) + 1) / 2.0) / (count(*) filter (toxic = 1) * count(*) filter (toxic = 0)), 6) as auc from r""")
def e6_auc(spark, sf_dir):
    from claimlens.operators.evaluate import auc

    s = table(spark, sf_dir, "labels").where("toxic is not null").join(table(spark, sf_dir, "documents"), "doc_id")
    return auc(s.select(F.col("toxic").alias("positive"), (F.col("n_chars") % 100).alias("score")))


@register(f"""{_ALL}, r as (select application_id, row_number() over (order by risk_score desc, application_id) as k, words_mismatch as expected from pop join sc using (application_id))
select round(avg(case when k <= 10 then cast(expected as int) end), 6) as precision_at_10, round(avg(cast(expected as int)), 6) as base_rate,
 round(avg(case when k <= greatest(1, round(0.1 * n)) then cast(expected as int) end) / avg(cast(expected as int)), 6) as lift from r, (select count(*) as n from pop)""")
def e4_precision_and_lift(spark, sf_dir):
    from claimlens.operators.evaluate import precision_and_lift

    pop = population(spark, sf_dir)
    s = rules.scores(pop, rules.findings(pop)).join(pop.select("application_id", F.col("words_mismatch").alias("expected")), "application_id")
    return precision_and_lift(s, "risk_score", "application_id")


@register()
def j1_households(spark, sf_dir):
    """Normalization, blocked resolution and components of the whole population."""
    apps = materialize(resolve.normalized(dealt(applications(spark, sf_dir), "application_id")).withColumnRenamed("scope", "cycle"), "normalized")
    pairs = materialize(resolve.scored(resolve.linkable(apps), apps), "scored")
    return resolve.households(apps, resolve.surviving(pairs))


def _out(c: str, test: str) -> str:
    return f"case when not coalesce({test}, false) then '{c}' end"


_CHECKS = [_out(c, f"length(trim({c})) between {a} and {b}") for c, (a, b) in intake.LENGTHS.items()] + [_out(c, f"{c} between {a} and {b}") for c, (a, b) in intake.RANGES.items()]
_CHECKS.append(_out("guardian_phone", "regexp_matches(coalesce(trim(guardian_phone), ''), '^[0-9]{10}$|^$')"))


@register(f"{_POP} select * from (select application_id, concat_ws(', ', {', '.join(_CHECKS)}) as invalid from pop) where invalid <> ''")
def s2_invalid_fields(spark, sf_dir):
    return intake.invalid_fields(applications(spark, sf_dir))


@register(f"""{_POP} select application_id, row_number() over (partition by applicant_id, scope, lower(regexp_replace(trim(applicant_name), '\\s+', ' ', 'g'))
 order by submitted_on, application_id) = 1 as admitted from pop""")
def p2_one_per_person(spark, sf_dir):
    return intake.one_per_person(applications(spark, sf_dir), ["submitted_on", "application_id"]).select("application_id", "admitted")


@register("""select sha256(text) as sha256, min(doc_id) as first, count(*) as copies from documents where text is not null group by 1 having count(*) > 1""")
def p3_same_content(spark, sf_dir):
    return intake.same_content(table(spark, sf_dir, "documents"), "doc_id", "text")


@register(f"{_POP} select scope, household, count(*) as member_count from pop group by scope, household having count(*) > 1")
def g3_household_table(spark, sf_dir):
    return intake.household_table(population(spark, sf_dir))


@register(f"""{_POP} select application_id, submitted_on from pop where status = 'approved' and date_diff('day', submitted_on, (select max(submitted_on) from pop)) > 180
 order by submitted_on, application_id limit 500""")
def q14_purgeable(spark, sf_dir):
    """Today is the last day on which an application came in."""
    a = applications(spark, sf_dir)
    today = a.agg(F.max("submitted_on")).first()[0]
    return intake.purgeable(a, F.col("status") == "approved", "submitted_on", F.lit(today)).select("application_id", "submitted_on")


@register(f"{_ALL} select application_id, rule from fl where application_id not in (select application_id from pop where status = 'approved')")
def w6_withdrawal(spark, sf_dir):
    pop = population(spark, sf_dir)
    return intake.withdraw(rules.flags(rules.findings(pop)), pop.where("status = 'approved'")).select("application_id", "rule")


@register("""with last as (select user_id, max((ts, event_id)) filter (event_type = 'signup') as reset from events group by user_id)
select user_id, n as attempts, n >= 4 as dead_letter from (select e.user_id, count(*) filter (event_type = 'purchase' and (reset is null or (ts, event_id) > reset)) as n
 from events e join last using (user_id) group by e.user_id)""")
def w3_stage_log(spark, sf_dir):
    """Purchases stand for failures and signups for resets."""
    kind = F.col("event_type")
    return intake.stage_log(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], kind == "purchase", kind == "signup")


@register(f"""{_POP}, t as (select doc_id, lpad(cast(doc_id as varchar), 8, '0') as id, trim(text, ' ') as body from documents)
select doc_id, p.application_id, length(body) as n from t left join pop p on p.application_id = t.id where length(body) between 10 and 2000""")
def q20_tips(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("application_id"), F.col("text").alias("body"))
    return intake.tips(d, applications(spark, sf_dir)).select("doc_id", "application_id", F.length("body").cast("long").alias("n"))


@register(f"""{_ALL} select count(*) as expected, count(*) filter (application_id in (select application_id from fl)) as caught,
 round(count(*) filter (application_id in (select application_id from fl)) / count(*), 6) as recall from pop where words_mismatch""")
def e2_recall(spark, sf_dir):
    from claimlens.operators.evaluate import recall

    pop = population(spark, sf_dir)
    return recall(pop.where("words_mismatch"), rules.flags(rules.findings(pop)), "application_id")


@register(f"""{_ALL}, c as (select scope, household, count(*) filter (application_id in (select application_id from fl where severity = 'high')) as high from pop group by scope, household)
select round(avg(cast(high = 0 as int)), 6) as pass_rate from c""")
def e5_equity_pass_rate(spark, sf_dir):
    from claimlens.operators.evaluate import pass_rate

    pop = population(spark, sf_dir)
    return pass_rate(pop, rules.flags(rules.findings(pop)), ["scope", "household"], "application_id")
