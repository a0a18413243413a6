"""More registered queries: documents, logs, views and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.functions import text
from claimlens.operators import documents, evaluate, intake, logs, queue, rules
from claimlens.plans.population import CASE_SQL, DECISIONS, applications, cases, decisions, population
from claimlens.plans.registry import _ALL, _POP, AGREE, register
from claimlens.session import new_path, table
from claimlens.sources import trail

_NO = "read_confidence is null or read_confidence < 0.8"


def _field(name: str, declared: str, agree: str) -> str:
    return f"case when {_NO} or {declared} is null or read_{name} is null then 'skipped' when {agree} then 'pass' else 'fail' end"


_CHECK = {"applicant_name": _field("applicant_name", "applicant_name", "read_applicant_name = upper(applicant_name)"), "guardian_name": "'skipped'"}
_CHECK |= {n: _field(n, "declared_family_size" if n == "family_size" else n, AGREE[n]) for n in ("certificate_id", "district", "pincode", "family_size")}
_FILE = {
    "identity": f"case when read_confidence is not null and fields_found >= 3 then 'pass' when {_NO} or word_count < 40 then 'skipped' else 'fail' end",
    "income_words": f"case when {_NO} then 'skipped' when words_mismatch then 'fail' else 'pass' end",
    "editing_software": "case when ela_applied is null then 'skipped' when software ilike '%photoshop%' then 'fail' else 'pass' end",
    "tamper_score": "case when not coalesce(ela_applied, false) then 'skipped' when tamper_score >= 0.5 then 'fail' else 'pass' end",
}
_NEEDS = {None: "false", "household": "members < 2"}
_REST = {f"stage_{s}": f"case (cast(application_id as bigint) + {i}) % 3 when 0 then 'pass' when 1 then 'fail' else 'pending' end" for i, s in enumerate(documents.STAGES)}
_REST["government_record"] = "case verification when 'mismatch' then 'fail' when 'match' then 'pass' else 'pending' end"
_REST |= {
    r: f"case when exists (select 1 from fl where fl.application_id = p.application_id and fl.rule = '{r}') then 'fail' when {_NEEDS.get(n, f'{n} is null')} then 'skipped' else 'pass' end"
    for r, n in documents.RULE_NEEDS.items()
}


def _rows(checks: dict[str, str], rest: str) -> str:
    return " union all ".join(f"select application_id, '{n}' as \"check\", {c} as status {rest}" for n, c in checks.items())


@register(f"{_POP} {_rows(_CHECK, 'from pop')}")
def c1_field_comparison(spark, sf_dir):
    return documents.field_comparison(population(spark, sf_dir))


@register(f"{_POP} {_rows(_FILE, 'from pop')}")
def c2_document_checks(spark, sf_dir):
    """Identity, figures against words, editing software and tamper score (here with a threshold of 0.5)."""
    return documents.document_checks(population(spark, sf_dir), 0.5)


def _stages(pop):
    status = F.element_at(F.array(*map(F.lit, ("succeeded", "dead_lettered", "running"))), ((F.col("application_id").cast("long") + F.col("i")) % 3 + 1).cast("int"))
    return pop.select("application_id", F.posexplode(F.array(*map(F.lit, documents.STAGES))).alias("i", "stage")).withColumn("status", status)


def _checklist(spark, sf_dir):
    pop = population(spark, sf_dir)
    return documents.checklist(pop, rules.flags(rules.findings(pop)), _stages(pop), 0.5)


_LIST = f"""{_ALL}, ck as ({_rows(_REST | _CHECK | _FILE, "from (select *, count(*) over (partition by scope, household) as members from pop) p")})"""


@register(f"{_LIST} select * from ck")
def c6_checklist(spark, sf_dir):
    return _checklist(spark, sf_dir)


_UNREAD = "case when read_confidence is null then 'document' {} when read_confidence < 0.8 then 'confidence' end"
_UNMET = {n: _UNREAD.format(f"when {'declared_family_size' if n == 'family_size' else n} is null then 'declared' when read_{n} is null then 'read'") for n in documents.FIELDS}
_UNMET |= {"identity": _UNREAD.format("when word_count < 40 then 'words'"), "income_words": _UNREAD.format(""), "editing_software": "'forensics'", "tamper_score": "'forensics'", "government_record": "'verification'"}
_UNMET |= {f"stage_{s}": "'stage'" for s in documents.STAGES} | {r: f"'{n}'" for r, n in documents.RULE_NEEDS.items() if n}


@register(f"""{_ALL}, u as ({_rows({n: f"case when ({c}) in ('skipped', 'pending') then {_UNMET[n]} end" for n, c in (_REST | _CHECK | _FILE).items() if n in _UNMET}, "from (select *, count(*) over (partition by scope, household) as members from pop) p")})
select "check", status as need, count(*) as n from u where status is not null group by 1, 2""")
def c6_unmet_needs(spark, sf_dir):
    """How many applications lack what, for each check that can't be answered."""
    pop = population(spark, sf_dir)
    listed = documents.checklist(pop, rules.flags(rules.findings(pop)), _stages(pop), 0.5, needs=True)
    return listed.where("need is not null").groupBy("check", "need").agg(F.count(F.lit(1)).alias("n"))


@register(f"""{_LIST} select application_id, {', '.join(f"count(*) filter (status = '{s}') as {s}" for s in ('pass', 'fail', 'skipped', 'pending'))} from ck group by application_id""")
def c7_checklist_summary(spark, sf_dir):
    return documents.summary(_checklist(spark, sf_dir))


@register("select l_orderkey as doc, round(avg(l_quantity), 6) as confidence, count(*) as word_count from lineitem group by 1")
def c9_page_report(spark, sf_dir):
    """Line items stand for the words of a page."""
    return documents.page_report(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc"), "doc", "l_quantity")


@register("""with b as (select l_suppkey as doc, l_extendedprice * l_extendedprice / 1000000 as energy from lineitem where l_quantity >= 6), m as (select doc, median(energy) as mid from b group by doc),
 d as (select doc, median(abs(energy - mid)) * 1.4826 as dev, count(*) as n from b join m using (doc) group by doc),
 z as (select doc, case when n >= 24 and dev > 1e-6 then (energy - mid) / dev end as zs from b join m using (doc) join d using (doc))
select doc, count(*) as n_blocks, max(zs) is not null as applied, count(*) filter (zs >= 3.5) as regions, round(case when max(zs) > 3.5 then least(1.0, (max(zs) - 3.5) / 8.5) else 0.0 end, 4) as score from z group by doc""")
def c10_block_outliers(spark, sf_dir):
    """A supplier's line items stand for the blocks of a page."""
    price = F.col("l_extendedprice")
    return documents.block_outliers(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), (price * price / 1000000).alias("energy"), F.col("l_quantity").alias("ink")))


@register("""with b as (select l_suppkey as doc, l_orderkey as row, l_linenumber as col, l_extendedprice * l_extendedprice / 1000000 as energy from lineitem where l_quantity >= 6), m as (select doc, median(energy) as mid from b group by doc),
 d as (select doc, median(abs(energy - mid)) * 1.4826 as dev, count(*) as n from b join m using (doc) group by doc),
 z as (select doc, row, col, energy, (energy - mid) / dev as zs, row_number() over (partition by doc order by (energy - mid) / dev desc, row, col) as rank from b join m using (doc) join d using (doc) where n >= 24 and dev > 1e-6)
select doc, rank, col * 8 as left, row * 8 as top, round(zs, 3) as z_score from z where zs >= 1.5 and rank <= 12""")
def c10_block_regions(spark, sf_dir):
    """The twelve strongest regions of each page, of line items as before; with a lower threshold, which more of them reach."""
    price = F.col("l_extendedprice")
    blocks = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), (price * price / 1000000).alias("energy"), F.col("l_quantity").alias("ink"))
    return documents.block_regions(blocks, z=1.5).select("doc", "rank", "left", "top", "z_score")


@register("""select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events where value > 10 and event_type <> 'error') where k = 1""")
def s3_latest_read_document(spark, sf_dir):
    """Events stand for documents: those above 10 have been read, errors are purged."""
    return logs.latest(table(spark, sf_dir, "events").where("value > 10 and event_type <> 'error'"), "user_id", ["ts", "event_id"], ["event_id", "value"])


@register(f"{_POP} select application_id from pop where scope = '1995' and status <> 'trashed' and applicant_id in (select cast(c_custkey as varchar) from customer where c_acctbal > 0)")
def s5_population(spark, sf_dir):
    confirmed = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("applicant_id"))
    return logs.eligible(applications(spark, sf_dir), "1995", confirmed, "applicant_id").select("application_id")


@register("select event_id, cast(regexp_extract(props, '[0-9]+') as int) as k, true as ela_applied from events")
def s6_evidence(spark, sf_dir):
    """A report that says nothing of error levels counts as applied."""
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int, ela_applied boolean"))
    return e.select("event_id", "p.k", F.coalesce("p.ela_applied", F.lit(True)).alias("ela_applied"))


@register(f"""{_ALL}, r(rule, w, s) as (select rule, weight, severity from w) select application_id, risk_score, count(rule) as n_flags,
 coalesce(string_agg(rule || ':' || weight, '; ' order by rule), '') as flags from pop join sc using (application_id) left join fl using (application_id) group by application_id, risk_score""")
def q7_reviewer_detail(spark, sf_dir):
    pop = population(spark, sf_dir)
    found = rules.findings(pop)
    one = rules.flags(found).groupBy("application_id").agg(F.sort_array(F.collect_list(F.struct("rule", "weight"))).alias("f"))
    out = rules.scores(pop, found).join(one, "application_id", "left")
    shown = F.array_join(F.transform("f", lambda x: F.concat_ws(":", x["rule"], x["weight"])), "; ")
    return out.select("application_id", "risk_score", F.coalesce(F.size("f"), F.lit(0)).alias("n_flags"), F.coalesce(shown, F.lit("")).alias("flags"))


_DOCS = "select lpad(cast(l_orderkey as varchar), 8, '0') as application_id, l_linenumber as document_id, cast(l_shipdate as date) as made, l_returnflag as kind from lineitem"


@register(f"""{_ALL}, r(rule, w, s) as (select rule, weight, severity from w), d as ({_DOCS}), e as (select user_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events)
select application_id, risk_score, coalesce((select string_agg(rule || ':' || weight, '; ' order by weight desc, rule) from fl where fl.application_id = pop.application_id), '') as flags,
 coalesce((select string_agg(document_id || ':' || kind, '; ' order by made, document_id, kind) from d where d.application_id = pop.application_id), '') as documents, event_type as verification,
 household, count(*) over (partition by scope, household) as members from pop join sc using (application_id) left join e on e.user_id = cast(application_id as bigint) and k = 1""")
def q7_application_detail(spark, sf_dir):
    """All that a reviewer sees of an application; line items stand for documents, a user's last event for the verification."""
    pop = population(spark, sf_dir)
    found = rules.findings(pop)
    key = lambda c: F.lpad(F.col(c).cast("string"), 8, "0").alias("application_id")
    docs = table(spark, sf_dir, "lineitem").select(key("l_orderkey"), F.col("l_linenumber").alias("document_id"), F.col("l_shipdate").cast("date").alias("at"), F.col("l_returnflag").alias("kind"), F.lit(None).cast("date").alias("purged_at"))
    checks = table(spark, sf_dir, "events").select(key("user_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.lit("").alias("notes"))
    one = queue.detail(pop, rules.scores(pop, found), rules.flags(found), docs, checks)
    shown = lambda c, *parts: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[p] for p in parts])), "; ")
    return one.select(
        "application_id", "risk_score", shown("flags", "rule", "weight").alias("flags"), shown("documents", "document_id", "kind").alias("documents"), F.col("verification.status").alias("verification"),
        "household.household", "household.members",
    )


@register("select event_id, user_id, c_name, ts from events left join customer on c_custkey = user_id where event_type in ('purchase', 'signup') order by ts desc, event_id")
def q10_decision_history(spark, sf_dir):
    e, c = table(spark, sf_dir, "events").where("event_type in ('purchase', 'signup')"), table(spark, sf_dir, "customer")
    return e.join(c, F.col("c_custkey") == F.col("user_id"), "left").orderBy(F.desc("ts"), "event_id").select("event_id", "user_id", "c_name", "ts")


_NOTES = "case when event_id % 4 = 0 then 'short' else props || event_type end as notes, case event_type when 'error' then 'mismatch' else 'match' end as status"


@register(f"""select user_id, status from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from (select *, {_NOTES} from events)
 where (status <> 'mismatch' or length(trim(notes)) >= 12) and user_id in (select user_id from events where event_type = 'click')) where k = 1""")
def q13_verification_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return logs.verification_fold(e.selectExpr("*", *_NOTES.split(", ")), "user_id", ["ts", "event_id"], "status", "notes", e.where("event_type = 'click'"))


@register("select doc_id, case when doc_id % 3 <> 0 then text end as text, sha256(text) as sha256, doc_id % 3 = 0 as purged from documents")
def q15_purge(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return logs.purged(d, F.col("doc_id") % 3 == 0, ["text"], "text")


@register("""select user_id, count(*) filter (event_type = 'purchase') as done from events group by user_id having count(*) filter (event_type = 'error' and value > 180) = 0
 and count(*) filter (event_type = 'purchase') < 40 and epoch_us((select max(ts) from events)) - epoch_us(max(ts)) > 600000000""")
def q16_stuck(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return logs.stuck(e, "user_id", "ts", (F.col("event_type") == "error") & (F.col("value") > 180), F.col("event_type") == "purchase", now, stages=40)


@register("""select event_id, user_id, finished_at from (select *, case when event_id % 5 <> 0 then ts end as finished_at from events where event_type = 'error') order by finished_at desc nulls last, event_id limit 100""")
def q17_dead_letters(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("finished_at", F.when(F.col("event_id") % 5 != 0, F.col("ts")))
    return e.orderBy(F.desc_nulls_last("finished_at"), "event_id").limit(100).select("event_id", "user_id", "finished_at")


@register("select event_id, user_id, event_type, ts from events order by user_id, ts, event_id")
def q18_audit_trail(spark, sf_dir):
    """The trail of all actors, each in order of time."""
    return table(spark, sf_dir, "events").orderBy("user_id", "ts", "event_id").select("event_id", "user_id", "event_type", "ts")


@register("""select event_id, user_id, event_type, ts from events where user_id = (select user_id from events group by user_id order by count(*) desc, user_id limit 1)""")
def q18_busiest_actor(spark, sf_dir):
    """The trail of the actor with most entries, read from a trail laid out by actor."""
    events = table(spark, sf_dir, "events")
    most = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").select("user_id").first()
    kept = trail.Trail(spark, new_path(spark, "trail"), {"actor": ["user_id"], "time": ["ts"]})
    kept.append(events)
    return kept.lookup("actor", most[0] if most else None).select("event_id", "user_id", "event_type", "ts")


@register("""select d.doc_id, cast(m.event_id as varchar) as mark from documents d left join (select user_id, event_id from (select *, row_number() over (partition by user_id order by ts, event_id) as k
 from events where event_type = 'error') where k = 1) m on m.user_id = d.doc_id""")
def q21_abuse_marks(spark, sf_dir):
    marks = table(spark, sf_dir, "events").where("event_type = 'error'").withColumnRenamed("user_id", "doc_id")
    first = logs.first_mark(marks, "doc_id", ["ts", "event_id"], ["event_id"])
    return table(spark, sf_dir, "documents").join(first, "doc_id", "left").select("doc_id", F.col("event_id").cast("string").alias("mark"))


@register("""select doc_id, case when l.doc_id is null then 'missing' when toxic = 1 then 'purged' else 'available' end as access from documents d left join (select doc_id as id, doc_id as known, toxic from labels) x on d.doc_id = x.id
 left join (select doc_id from labels) l using (doc_id)""")
def q22_document_access(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known"), F.when(F.col("toxic") == 1, 1).alias("purged_at"))
    d = table(spark, sf_dir, "documents").join(known, "doc_id", "left")
    return d.select("doc_id", logs.access(F.col("known"), F.col("purged_at")).alias("access"))


@register("""select least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b, bool_or(l_returnflag = 'R') as rejected from lineitem where l_partkey <> l_suppkey group by 1, 2""")
def j10_merged_edges(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("rejected"))
    return logs.merged_edges(e, "l_partkey", "l_suppkey", "rejected")


_SELL = "select distinct l_partkey as a, l_suppkey as b from lineitem"


@register(f"with e as ({_SELL}), m as (select c_custkey as id from customer where c_nationkey = 7) select a, b from e where a in (select id from m) and b in (select id from m)")
def j11_neighbourhood(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return logs.neighbourhood(e, table(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("id")))


@register(f"{_POP} select account, district from (select lower(applicant_name) as account, district, row_number() over (partition by lower(applicant_name) order by submitted_on desc, application_id desc) as k from pop) where k = 1")
def p1_account_upsert(spark, sf_dir):
    return logs.account_upsert(applications(spark, sf_dir), F.col("applicant_name"), ["submitted_on", "application_id"], ["district"], True)


@register(f"{_ALL}, t as (select application_id, max(case severity when 'high' then 3 when 'medium' then 2 else 1 end) as p from fl group by 1) select application_id, case p when 3 then 'high' when 2 then 'medium' else 'low' end as severity from t")
def r24_peak_severity(spark, sf_dir):
    return rules.peak_severity(rules.findings(population(spark, sf_dir)))


@register(f"{_ALL.replace(_POP, f'with pop as ({CASE_SQL})')} select application_id, rule, evidence from f")
def e1_case_isolated(spark, sf_dir):
    """Every case alone, all in one run: the case takes the scope's place."""
    return rules.findings(cases(spark, sf_dir))


@register(f"""{_POP}, c as ({_rows(_CHECK, 'from pop')}) select "check", count(*) filter (status <> 'skipped') as graded, count(*) filter (status = 'pass') as correct,
 round(count(*) filter (status = 'pass') / nullif(count(*) filter (status <> 'skipped'), 0), 6) as accuracy from c group by 1""")
def e9_field_accuracy(spark, sf_dir):
    from claimlens.operators.evaluate import field_accuracy

    return field_accuracy(documents.field_comparison(population(spark, sf_dir)))


@register(f"{_POP} select scope, count(*) filter (read_confidence >= 0.8) as comparable, count(*) filter (read_confidence >= 0.8 and words_mismatch) as flagged from pop group by scope")
def e10_comparable(spark, sf_dir):
    fine = F.col("read_confidence") >= 0.8
    return population(spark, sf_dir).groupBy("scope").agg(F.count_if(fine).alias("comparable"), F.count_if(fine & F.col("words_mismatch")).alias("flagged"))


@register(f"{_POP} select distinct declared_annual_income as v, case when declared_annual_income between 1000 and 100000000 then declared_annual_income end as form, 'Rs. ' || declared_annual_income || '/-' as shown from pop")
def n6_income(spark, sf_dir):
    shown = F.concat(F.lit("Rs. "), F.col("v"), F.lit("/-"))
    v = applications(spark, sf_dir).select(F.col("declared_annual_income").alias("v")).distinct()
    return v.select("v", text.parse_income(shown).alias("form"), shown.alias("shown"))


_LOG = f"lg as materialized ({DECISIONS})"


@register(f"""{_ALL}, s as (select * from pop where status in ('ready_for_review', 'escalated') and (applicant_name ilike '%ravi%' or guardian_name ilike '%ravi%' or certificate_id ilike '%ravi%')
   and application_id in (select application_id from fl where severity = 'high')),
 t as (select application_id, count(*) as flag_count, count(*) filter (severity = 'high') as high_count, arg_max(rule, (weight, rule)) as top_rule from fl group by application_id)
select s.application_id, scope, district, status, sc.risk_score, flag_count, high_count, top_rule, (select count(*) from s) as total
from s join sc using (application_id) join t using (application_id) order by risk_score desc, submitted_on, application_id limit 50""")
def q1_queue_listing(spark, sf_dir):
    pop = population(spark, sf_dir)
    found = rules.findings(pop)
    return queue.listing(pop, rules.flags(found), rules.scores(pop, found), "awaiting", text=" RAVI ", severity="high")


@register(f"""{_POP} select application_id from pop where applicant_name ilike '%deepa%' or guardian_name ilike '%deepa%' or certificate_id ilike '%deepa%'""")
def q5_find(spark, sf_dir):
    return queue.find(population(spark, sf_dir), "deepa").select("application_id")


@register(f"""{_ALL}, {_LOG}, d as (select application_id, arg_max(decision, (lg.at, lg.seq, decision, decider)) as decision, arg_max(decider, (lg.at, lg.seq, decision, decider)) as decider from lg group by application_id),
 x as (select application_id, string_agg(distinct rule, '; ' order by rule) as fired from fl group by application_id)
select p.application_id, p.status, coalesce(fired, '') as fired, decision, decider from pop p left join x using (application_id) left join d using (application_id)""")
def q6_export_decisions(spark, sf_dir):
    pop = population(spark, sf_dir)
    return queue.export_decisions(pop, rules.flags(rules.findings(pop)), decisions(spark, sf_dir))


@register(f"""with {_LOG}, good as (select * from lg where length(trim(reason)) >= 12)
select g.* from good g where not exists (select 1 from good e where e.application_id = g.application_id and e.decision <> 'escalated' and (e.at, e.seq) < (g.at, g.seq))""")
def q12_decisions(spark, sf_dir):
    return queue.decided(decisions(spark, sf_dir))


@register(f"""{_POP} select p.application_id, doc_id as tip_id, sha256(trim(text, ' ')) as body_sha256, p.submitted_on as at, doc_id % 9 = 0 as abusive
from documents d join pop p on p.application_id = lpad(cast(doc_id as varchar), 8, '0') where length(trim(text, ' ')) between 10 and 2000""")
def q11_tips(spark, sf_dir):
    apps = applications(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("application_id"), F.col("text").alias("body"))
    tips = intake.tips(d, apps).join(apps.select("application_id", F.col("submitted_on").alias("at")), "application_id", "left")
    shown = intake.tips_shown(tips.withColumn("tip_id", F.col("doc_id")).withColumn("abusive", F.col("doc_id") % 9 == 0))
    return shown.select("application_id", "tip_id", F.sha2("body", 256).alias("body_sha256"), "at", "abusive")


@register(f"""{_POP} select 'c-' || application_id as document_id, scope, submitted_on as at from pop where cast(application_id as bigint) % 4 <> 0""")
def q19_manifest(spark, sf_dir):
    """One document for each application, of which a quarter is purged."""
    apps = applications(spark, sf_dir)
    purged = F.when(F.col("application_id").cast("bigint") % 4 == 0, F.col("submitted_on"))
    docs = apps.select("application_id", F.concat(F.lit("c-"), "application_id").alias("document_id"), F.col("submitted_on").alias("at"), purged.alias("purged_on"))
    return intake.reprocessable(docs, apps)


@register(f"""{_POP} select count(*) as controls, round(avg(cast(tamper_score >= 0.5 as int)), 6) as false_positive_rate from pop where status = 'approved'""")
def e7_false_positive_rate(spark, sf_dir):
    return evaluate.false_positive_rate(population(spark, sf_dir), "tamper_score", F.col("status") == "approved")


@register(f"""{_POP} select distinct scope from pop where cast(applicant_id as bigint) in (select user_id from events where event_type = 'signup')""")
def w4_confirmed_scopes(spark, sf_dir):
    """Signups stand for confirmed accounts."""
    confirmed = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("user_id").cast("string").alias("applicant_id"))
    return intake.confirmed_scopes(confirmed, applications(spark, sf_dir))
