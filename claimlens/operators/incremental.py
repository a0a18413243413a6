"""Rescoring of arrivals: what engine.run gives for all rows, by work that follows what a batch touches.

The state is a set of tables by scope (see TABLES), published together batch by
batch. Arrivals (new or changed applications, each with a number seq that grows with
its versions) ask a stored index of pair keys for rows they may resemble; these pairs
alone are scored and take the place of the pairs that changed applications had.
Components are put together again only where a link or a member has changed, rules
are evaluated again only for rows that share a rule's key with a row that has changed
or changed its household, before or after. All else stands as it was stored.

Order and repetition don't matter: of an application's versions the one with the
largest seq counts (equal ones are repeats), a batch that comes again is skipped by
its mark, and whichever way rows are cut into batches, the tables are the same.
Prefixes of addresses follow the trigram frequencies of a scope's first batch, which
are kept: they decide how many pairs are compared, not which are found.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.operators import engine, graph, resolve, rules
from claimlens.session import materialize, scratch
from claimlens.sources.published import Published

PAIRS = "scope string, a string, b string, edges array<struct<field:string,similarity:double,weight:double,part:double>>, score_raw double, score double, linked boolean"
#: The tables of the state but for the applications, whose columns are the arrivals'. changes are those of the last batch
#: that touched a scope; key: the changed row's key, its parts joined by slashes.
TABLES = {
    "index": "scope string, kind int, k1 string, k2 string, id string",
    "words": "scope string, field string, u string, c long",
    "trigrams": "scope string, gram string, df long",
    "pairs": PAIRS,
    "rejected": "scope string, a string, b string, field string",
    "households": "scope string, application_id string, household string",
    "findings": "scope string, application_id string, rule string, evidence string",
    "flags": "scope string, application_id string, rule string, evidence string, severity string, weight int",
    "scores": "scope string, application_id string, risk_score long",
    "changes": "scope string, kind string, key string, change string, stream string, batch long",
}

#: The key, beside scope, that makes rows bear on each other in a rule that groups the population (as SQL expressions).
REACH: dict[str, tuple[str, ...]] = {
    "SIBLING_INCOME_CONTRADICTION": ("household",), "ISSUING_OFFICE_MISMATCH": ("household",), "FAMILY_SIZE_CONTRADICTION": ("household",),
    "GUARDIAN_INCOME_CONTRADICTION": ("guardian_key",), "ADDRESS_CLUSTER_UNRELATED": ("address_key",), "SHARED_CONTACT_UNRELATED_HOUSEHOLDS": ("phone_key",),
    "DUPLICATE_CERTIFICATE_ID": ("trim(certificate_id)",), "INCOME_THRESHOLD_BUNCHING": (),
    "CERTIFICATE_SERIAL_ADJACENCY": ("lower(trim(issuing_office))",), "IDENTICAL_ROUND_INCOME_CLUSTER": ("lower(trim(issuing_office))", "declared_annual_income"),
}


@dataclass
class State:
    """A published state: tables of scopes, and how rules are configured."""

    spark: SparkSession
    base: str
    version: int = 5
    config: dict | None = None
    store: Published = field(init=False)

    def __post_init__(self):
        self.store = Published(self.spark, self.base)
        self.floor, self.fields = engine.near_misses(self.version, self.config)
        self.sets = resolve.key_sets(floor=self.floor, fields=self.fields)

    def table(self, name: str, scopes: list[str] | None = None) -> DataFrame:
        return self.store.read(name, TABLES[name], scopes)

    def applications(self, like: DataFrame, scopes: list[str] | None = None) -> DataFrame:
        """Stored applications with their normal forms; like gives the columns if nothing is stored yet."""
        return self.store.read("applications", like.schema, scopes)

    def findings(self) -> DataFrame:
        """All findings as rules give them, corroboration applied."""
        return rules.corroborated(self.table("findings").drop("scope"), rules.active(self.version, self.config))


def _scopes(*frames: DataFrame) -> list[str]:
    """Distinct scopes of the rows; few, as they are partitions of every table."""
    out = frames[0].select("scope")
    for f in frames[1:]:
        out = out.unionByName(f.select("scope"))
    return sorted(r["scope"] for r in out.distinct().collect())


def newest(arrivals: DataFrame, stored: DataFrame) -> DataFrame:
    """Of each application the arrival with the largest seq, if it is larger than that of the stored row."""
    order = F.struct("seq", *[c for c in sorted(arrivals.columns) if c not in ("seq", "application_id")])
    one = arrivals.groupBy("application_id").agg(F.max_by(F.struct(*arrivals.columns), order).alias("r")).select("r.*")
    known = stored.select("application_id", F.col("seq").alias("_seq"))
    return one.join(known, "application_id", "left").where("_seq is null or seq > _seq").drop("_seq")


def _without(df: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """Rows of df that name none of the ids (id) in those columns."""
    for c in columns:
        df = df.join(ids.withColumnRenamed("id", c), c, "left_anti")
    return df


def _population(apps: DataFrame, households: DataFrame) -> DataFrame:
    return engine.with_households(apps, households.select("application_id", "household"))


def apply(state: State, arrivals: DataFrame, stream: str = "arrivals", batch: int | None = None) -> bool:
    """Takes arrivals (applications with scope and seq) into the state. False if there was nothing to do: the batch is
    done already, or holds no newer version. scope must be a text that isn't empty; a row that moves to another scope
    leaves its old one."""
    if batch is not None and batch <= state.store.mark(stream):
        return False
    with scratch():
        return _apply(state, arrivals, stream, batch)


def _apply(state: State, arrivals: DataFrame, stream: str, batch: int | None) -> bool:
    normal = resolve.normalized(arrivals)
    known = state.applications(normal)
    fresh = materialize(newest(normal, known), "arrivals")
    ids = materialize(fresh.select(F.col("application_id").alias("id")), "ids")
    moved = known.join(ids.withColumnRenamed("id", "application_id"), "application_id", "left_semi")
    scopes = _scopes(fresh, moved)
    if not scopes:
        return False
    old = {n: state.table(n, scopes) for n in TABLES if n != "changes"}
    before = state.applications(normal, scopes)
    apps = materialize(_without(before, ids, "application_id").unionByName(fresh), "applications")

    asked, index, words, trigrams = _keys(state, fresh, ids, before, old)
    pairs = resolve.met(asked, index, "scope")
    pairs = materialize(resolve.used(resolve.scored(pairs, apps, "scope"), state.floor, state.fields), "new-pairs")
    all_pairs = materialize(_without(old["pairs"], ids, "a", "b").unionByName(pairs), "pairs")

    ends = pairs.where("linked").select(F.explode(F.array("a", "b")).alias("node"))
    touched = ids.withColumnRenamed("id", "node").unionByName(ends)
    new = {"applications": apps, "index": index, "words": words, "trigrams": trigrams, "pairs": all_pairs, "rejected": old["rejected"]}
    gone = _without(old["households"], ids, "application_id")
    new["households"] = _components(old["households"], gone, apps, all_pairs, old["rejected"], touched)
    return _rescored(state, new, old, before, ids, pairs, scopes, stream, batch, ("applications", "index", "words", "trigrams", "pairs"))


def decide(state: State, decisions: DataFrame, stream: str = "decisions", batch: int | None = None) -> bool:
    """Rejects or restores edges: decisions (scope, a, b, field, rejected), the last of each edge. Only the components
    of their ends are split or joined again, and only what that touches is rescored. Edges that no row has yet may be
    rejected too."""
    if batch is not None and batch <= state.store.mark(stream):
        return False
    with scratch():
        return _decide(state, decisions, stream, batch)


def _decide(state: State, decisions: DataFrame, stream: str, batch: int | None) -> bool:
    decisions = materialize(decisions.select("scope", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "field", "rejected"), "decisions")
    scopes = _scopes(decisions)
    if not scopes:
        return False
    old = {n: state.table(n, scopes) for n in TABLES if n != "changes"}
    before = materialize(state.store.read("applications", "scope string, application_id string", scopes), "applications")
    edge = ["scope", "a", "b", "field"]
    rejected = materialize(old["rejected"].join(decisions, edge, "left_anti").unionByName(decisions.where("rejected").select(*edge)), "rejected")
    if "guardian" not in before.columns:  # nothing has arrived in these scopes
        return state.store.publish({"rejected": rejected}, scopes, stream, batch)
    touched = decisions.select(F.explode(F.array("a", "b")).alias("node")).join(before.select(F.col("application_id").alias("node")), "node", "left_semi")
    new = {n: old[n] for n in ("index", "words", "trigrams", "pairs")} | {"applications": before, "rejected": rejected}
    new["households"] = _components(old["households"], old["households"], before, old["pairs"], rejected, touched)
    none = before.select(F.col("application_id").alias("id")).limit(0)
    return _rescored(state, new, old, before, none, old["pairs"].limit(0), scopes, stream, batch, ("rejected",))


def _keys(state: State, fresh: DataFrame, ids: DataFrame, before: DataFrame, old: dict[str, DataFrame]) -> tuple[DataFrame, ...]:
    """What arrivals ask for, the index with them in place of their earlier versions, words and trigrams with counts."""
    first = fresh.join(old["trigrams"].select("scope").distinct(), "scope", "left_anti")
    counted = first.select("scope", F.explode("address_grams").alias("gram")).groupBy("scope", "gram").agg(F.count(F.lit(1)).alias("df"))
    trigrams = materialize(old["trigrams"].unionByName(counted), "trigrams")
    names = ("guardian", "applicant")
    vocabulary = {n: old["words"].where(F.col("field") == n).select("scope", "u", "c") for n in names}
    keys = resolve.keys_of(fresh, "scope", vocabulary, trigrams)
    mine = materialize(resolve.keyed(keys, "scope", state.sets, True), "index")
    asked = materialize(resolve.keyed(keys, "scope", state.sets, False), "asked")
    index = materialize(_without(old["index"], ids, "id").unionByName(mine), "index")
    # Words of earlier versions stay counted: counts choose among keys, and a word that is gone is found by nobody.
    counts = [keys.own[n].groupBy("scope", F.col("key").alias("u")).agg(F.count(F.lit(1)).alias("c")).withColumn("field", F.lit(n)) for n in names]
    words = old["words"].unionByName(counts[0]).unionByName(counts[1]).groupBy("scope", "field", "u").agg(F.sum("c").alias("c"))
    return asked, index, materialize(words, "vocabulary"), trigrams


def _components(before: DataFrame, gone: DataFrame, apps: DataFrame, pairs: DataFrame, rejected: DataFrame, touched: DataFrame) -> DataFrame:
    """Households after the links of touched applications have changed; gone: households without changed applications."""
    links = resolve.surviving(pairs, rejected.select("a", "b", "field"))
    labels = before.select(F.col("application_id").alias("node"), F.col("household").alias("component"))
    again = graph.recomputed(labels, links, touched)
    again = apps.select("scope", "application_id").join(again.select(F.col("node").alias("application_id"), F.col("component").alias("household")), "application_id")
    again = materialize(again.select("scope", "application_id", "household"), "regrouped")
    rest = gone.join(again.select("application_id"), "application_id", "left_anti")
    return materialize(rest.select("scope", "application_id", "household").unionByName(again), "households")


def _reached(pop: DataFrame, keys: tuple[str, ...], changed: DataFrame) -> DataFrame:
    """Rows of pop that share the key of a rule with a changed row."""
    named = [F.expr(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    on = ["scope", *[f"_k{i}" for i in range(len(keys))]]
    some = changed.select("scope", *named).distinct()
    return pop.select("*", *named).join(some, on, "left_semi").select(*pop.columns)


def _rescored(
    state: State, new: dict[str, DataFrame], old: dict[str, DataFrame], before: DataFrame, ids: DataFrame, pairs: DataFrame,
    scopes: list[str], stream: str, batch: int | None, also: tuple[str, ...],
) -> bool:
    """Evaluates rules where rows or households have changed, and publishes all that a batch gives."""
    pop = materialize(_population(new["applications"], new["households"]), "population")
    was = materialize(_population(before, old["households"]), "population")
    homes = new["households"].join(old["households"], ["scope", "application_id", "household"], "left_anti").select(F.col("application_id").alias("id"))
    changed = materialize(ids.unionByName(homes).distinct().withColumnRenamed("id", "application_id"), "changed")
    both = was.join(changed, "application_id", "left_semi").unionByName(pop.join(changed, "application_id", "left_semi"))
    both = materialize(both, "changed-rows")
    some = rules.active(state.version, state.config)
    found, lost = [], []
    for name, rule in some.items():
        if name in rules.GROUP_RULES:
            keys = REACH[name]
            found.append(rules.GROUP_RULES[name](_reached(pop, keys, both), rule))
            lost.append(_reached(was, keys, both).select("application_id", F.lit(name).alias("rule")))
    on_rows = {n: r for n, r in some.items() if n in rules.ROW_RULES}
    if on_rows:
        arrived = pop.join(ids.withColumnRenamed("id", "application_id"), "application_id", "left_semi")
        found.append(rules.row_findings(arrived, on_rows))
        lost += [ids.select(F.col("id").alias("application_id"), F.lit(n).alias("rule")) for n in on_rows]
    kept = old["findings"].select("application_id", "rule", "evidence")
    near = F.lit("HOUSEHOLD_FRAGMENTATION")
    if "HOUSEHOLD_FRAGMENTATION" in some:
        found.append(rules.fragmentation(pairs, some["HOUSEHOLD_FRAGMENTATION"]))
        other = kept.where(F.col("rule") == near)
        kept = kept.where(F.col("rule") != near).unionByName(_without(other, ids, "application_id", "evidence"))
    kept = kept.join(_all(lost).distinct(), ["application_id", "rule"], "left_anti") if lost else kept
    again = _all(found) if found else kept.limit(0)
    at = pop.select("scope", "application_id")
    findings = materialize(kept.unionByName(again).join(at, "application_id").select("scope", "application_id", "rule", "evidence"), "findings")

    firm = rules.corroborated(findings.drop("scope"), some)
    flags = rules.flags(firm, state.config).join(at, "application_id").select("scope", "application_id", "rule", "evidence", "severity", "weight")
    scores = rules.scores(pop, firm, config=state.config).join(at, "application_id").select("scope", "application_id", F.col("risk_score").cast("long").alias("risk_score"))
    new |= {"findings": findings, "flags": materialize(flags, "flags"), "scores": materialize(scores, "scores")}
    edges = [x.select("scope", "a", "b", F.explode("edges").alias("e")).select("scope", "a", "b", "e.field", "e.similarity", "e.weight") for x in (old["pairs"], new["pairs"])]
    compared = (
        ("edge", edges, ["scope", "a", "b", "field"], ["similarity", "weight"]),
        ("household", [old["households"], new["households"]], ["scope", "application_id"], ["household"]),
        ("flag", [old["flags"], new["flags"]], ["scope", "application_id", "rule"], ["evidence", "severity", "weight"]),
        ("score", [old["scores"], new["scores"]], ["scope", "application_id"], ["risk_score"]),
    )
    changes = []
    for kind, (a, b), keys, values in compared:
        c = rules.change_set(a, b, keys, values)
        key = F.concat_ws("/", *keys[1:])
        changes.append(c.select("scope", F.lit(kind).alias("kind"), key.alias("key"), "change", F.lit(stream).alias("stream"), F.lit(batch).cast("long").alias("batch")))
    new["changes"] = _all(changes)
    return state.store.publish({n: new[n] for n in (*also, "households", "findings", "flags", "scores", "changes")}, scopes, stream, batch)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
