"""An applications table derived from the driver's tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimlens.session import table

_WORDS = "".join(w.ljust(6)[:6] for w in "Ravi Kumar Meena Suresh Latha Murthy Reddy Sankar Faruk Gowda Swamy Deepa Mohan Iqbal Thomas Radha".split())


def _word(k: str) -> str:
    return f"trim(substr('{_WORDS}', 1 + 6 * cast(({k}) % 16 as int), 6))"


def _applications(orders: str, more: str = "") -> str:
    house = "(o_custkey - o_custkey % 3)"
    return f"""
select lpad(cast(o_orderkey as string), 8, '0') as application_id, cast(year(o_orderdate) as string) as scope,
  cast(o_custkey as string) as applicant_id,
  {_word('o_orderkey')} || ' ' || {_word('o_custkey')} as applicant_name,
  'Shri S. ' || {_word('o_custkey % 7')} || ' ' || translate(lpad(cast(o_custkey as string), 6, '0'), '0123456789', 'abdeiklmou') as guardian_name,
  case when o_orderkey % 6 = 0 then '12 ' else '' end || cast({house} as string) || 'th, ' || {_word(house)} || ' St.' as address_line, 'Dist ' || {_word(house)} as district,
  case when o_custkey % 11 = 0 then null else '+91 9' || lpad(cast(o_custkey - o_custkey % 2 as string), 9, '0') end as guardian_phone,
  case when o_orderkey % 7 = 0 then 90000 + 10000 * (o_orderkey % 3) when o_orderkey % 5 = 0 then 232000 + 1000 * (o_orderkey % 10)
       else cast(floor(o_totalprice) as bigint) end as declared_annual_income,
  1 + o_orderkey % 9 as declared_family_size,
  case when o_orderkey % 13 = 0 then null when o_orderkey % 17 = 0 then 'TN-2025-' || lpad(cast(o_orderkey - o_orderkey % 34 as string), 6, '0')
       else 'TN-2025-' || lpad(cast(o_orderkey as string), 6, '0') end as certificate_id,
  ' Office ' || cast((o_custkey + case when o_orderkey % 10 = 0 then 1 else 0 end) % 40 as string) as issuing_office, cast(o_orderdate as date) as certificate_issue_date,
  case o_orderstatus when 'O' then 'submitted' when 'F' then 'approved' else 'ready_for_review' end as status,
  cast(o_orderdate as date) as submitted_on,
  case when o_orderkey % 5 = 1 then null else cast(floor(o_totalprice) as bigint) + 30000 * (o_orderkey % 4) end as read_income,
  case when o_orderkey % 53 = 0 then null else cast(70 + 10 * (o_orderkey % 3) as double) / 100 end as read_confidence,
  case when o_orderkey % 19 = 0 then 'TN/2025/999' when o_orderkey % 3 = 0 then null else 'tn 2025 ' || lpad(cast(o_orderkey as string), 6, '0') end as read_certificate_id,
  1 + (o_orderkey + o_orderkey % 23) % 9 as read_family_size, o_orderkey % 29 = 0 as words_mismatch,
  case when o_orderkey % 31 = 0 then 'Adobe Photoshop 2024' when o_orderkey % 31 = 1 then 'Scanner' else null end as software,
  case when o_orderkey % 37 = 0 then 'mismatch' when o_orderkey % 37 = 1 then 'match' else null end as verification,
  o_orderkey % 120 as word_count, o_orderkey % 9 as fields_found,
  case when o_orderkey % 41 = 0 then 'Nowhere' when o_orderkey % 41 = 1 then null else upper('dist. ' || {_word(house)}) end as read_district,
  cast(600000 + o_custkey % 900 as string) as pincode,
  case when o_orderkey % 43 = 0 then '123456' when o_orderkey % 43 = 1 then null else cast(600000 + o_custkey % 90 as string) end as read_pincode,
  case when o_orderkey % 47 = 0 then 'Wrong Person' when o_orderkey % 47 = 1 then null else upper({_word('o_orderkey')} || ' ' || {_word('o_custkey')}) end as read_applicant_name,
  cast(null as string) as read_guardian_name,
  case when o_orderkey % 59 = 0 then null else o_orderkey % 59 <> 1 end as ela_applied, cast(o_orderkey % 100 as double) / 100 as tamper_score{more}
from {orders}"""


def _population(applications: str) -> str:
    return f"""
select *, min(application_id) over (partition by scope, guardian_name, address_line) as household,
  guardian_name as guardian_key, address_line as address_key, guardian_phone as phone_key
from ({applications}) as a"""


SQL = _population(_applications("orders"))
_CASE = "cast(2015 + cast(applicant_id as int) % 10 as string)"
#: The same with ten cases instead of years; each is resolved alone.
CASE_SQL = _population(f"select * replace ({_CASE} as scope) from ({_applications('orders')})")


def applications(spark, sf_dir):
    return spark.sql(_applications("{orders}"), orders=table(spark, sf_dir, "orders"))


def population(spark, sf_dir):
    """SQL's rows. Households are found on the orders' own columns, before the others are derived, so that narrow rows are sorted."""
    orders = table(spark, sf_dir, "orders")
    keyed = spark.sql(_applications("{orders}", "".join(f", `{c}`" for c in orders.columns)), orders=orders)
    household = F.min("application_id").over(Window.partitionBy("address_line", "guardian_name", "scope"))
    apps = spark.sql(_applications("{orders}", ", household"), orders=keyed.select(*orders.columns, household.alias("household")))
    keys = {"guardian_key": "guardian_name", "address_key": "address_line", "phone_key": "guardian_phone"}
    return apps.select("*", *[F.col(c).alias(k) for k, c in keys.items()])


def cases(spark, sf_dir):
    """The population with a case in place of the scope."""
    return spark.sql(_population("{apps}"), apps=applications(spark, sf_dir).withColumn("scope", F.expr(_CASE)))


def _decisions(lineitem: str) -> str:
    """A log of decisions: returned lines reject, accepted ones approve, others pass the case on; reasons differ in length."""
    return f"""
select lpad(cast(l_orderkey as string), 8, '0') as application_id, cast(l_shipdate as date) as at, cast(l_linenumber as bigint) as seq,
  case l_returnflag when 'R' then 'rejected' when 'A' then 'approved' else 'escalated' end as decision, 'reviewer ' || cast(l_suppkey % 20 as string) as decider,
  substr('Income read as shown on the page', 1, cast(4 + l_partkey % 20 as int)) as reason
from {lineitem}"""


DECISIONS = _decisions("lineitem")


def decisions(spark, sf_dir):
    return spark.sql(_decisions("{lines}"), lines=table(spark, sf_dir, "lineitem"))
