"""Arrivals batch by batch, repeated and out of order, against one run over all rows; publishing that is cut short."""

import random
import uuid

import pytest
from claimlens.operators import engine, incremental, resolve, rules
from claimlens.plans import population
from claimlens.session import materialize, new_path
from claimlens.sources.published import Published
from claimlens.streaming import jobs
from pyspark.sql import functions as F


@pytest.fixture(scope="module", autouse=True)
def one_partition(spark):
    """Tables are tiny and jobs many here."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def versions(spark):
    """Applications in two scopes, some spelt otherwise, some near, each with one or two versions (seq)."""
    some = population.applications(spark, "/root/testdata/sf0.001").orderBy("application_id").limit(14)
    some = some.withColumns({"scope": F.when(F.col("application_id") % 3 == 0, "1995").otherwise("1996"), "status": F.lit("submitted"), "seq": F.lit(1)})
    again = some.withColumns({
        "application_id": F.concat(F.lit("9"), F.col("application_id")), "guardian_name": F.concat(F.lit("Thiru "), F.upper("guardian_name")),
        "address_line": F.regexp_replace("address_line", "th, (.*) St[.]", ", $1 Street"), "declared_annual_income": 3 * F.col("declared_annual_income"),
    })
    near = some.withColumns({
        "application_id": F.concat(F.lit("8"), F.col("application_id")), "guardian_name": F.lit("Xavier Plomb"), "applicant_name": F.lit("Zenobia Quill"),
        "address_line": F.concat("address_line", F.lit(" Rear")),
    })
    first = some.unionByName(again).unionByName(near)
    later = first.where("application_id % 4 = 1").withColumns({
        "seq": F.lit(2), "scope": F.when(F.col("application_id") % 8 == 1, "1996").otherwise(F.col("scope")),
        "address_line": F.lit("7th, Quarry Road"), "declared_annual_income": F.lit(240_000).cast("long"), "guardian_name": F.lit("Xavier Plomb"),
    })
    return materialize(first.unionByName(later).withColumn("part", F.pmod(F.hash("application_id", "seq"), F.lit(3))), "versions")


def tables(run, floor=resolve.NEAR, fields=resolve.NEAR_FIELDS):
    rows = lambda df, *c: sorted(tuple(map(str, r)) for r in df.select(*c).collect())
    return {
        "households": rows(run["households"], "application_id", "household"), "pairs": rows(run["pairs"], "a", "b", "score", "linked"),
        "findings": rows(run["findings"], "application_id", "rule", "evidence"), "scores": rows(run["scores"], "application_id", "risk_score"),
        "flags": rows(run["flags"], "application_id", "rule", "evidence", "severity", "weight"),
    }


def stored(state):
    return tables({n: state.table(n) for n in ("households", "pairs", "scores", "flags")} | {"findings": state.findings()})


def whole(versions, rejected=None):
    last = versions.groupBy("application_id").agg(F.max_by(F.struct(*versions.columns), "seq").alias("r")).select("r.*").drop("part")
    run = engine.run(last, rejected)
    return tables({"households": run.population, "pairs": run.pairs, "findings": run.findings, "flags": run.flags, "scores": run.scores})


@pytest.fixture(scope="module")
def want(versions):
    return whole(versions)


def batch(versions, k):
    return versions.where(F.col("part") == k).drop("part")


@pytest.fixture(scope="module")
def state(spark, versions, want):
    """Three batches in an order that brings some second versions first, one of them twice."""
    state = incremental.State(spark, new_path(spark, "state"))
    assert incremental.apply(state, batch(versions, 2), "s", 0)
    assert incremental.apply(state, batch(versions, 0), "s", 1)
    assert not incremental.apply(state, batch(versions, 2), "s", 0)  # a batch that comes again
    assert not incremental.apply(state, batch(versions, 0), "other", 7)  # its rows by another stream: nothing newer
    assert incremental.apply(state, batch(versions, 1), "s", 2)
    return state


def test_batches_equal_one_run(state, want):
    assert len(want["findings"]) > 50 and any(r[3] == "True" for r in want["pairs"]) and any(r[1] == "HOUSEHOLD_FRAGMENTATION" for r in want["findings"])
    got = stored(state)
    for name in want:
        assert got[name] == want[name], name


def test_changes_tell_what_the_last_batch_did(state, spark):
    last = state.table("changes")
    assert {r["stream"] for r in last.collect()} == {"s"} and {r["batch"] for r in last.collect()} <= {1, 2}
    assert {r["kind"] for r in last.collect()} >= {"edge", "household", "flag", "score"}


def test_rejected_edges_split_only_their_component(state, spark, versions, want):
    """Rejecting every edge of a linked pair, and restoring them, as a run with those edges rejected gives."""
    pair = state.table("pairs").where("linked").orderBy("a", "b").select("scope", "a", "b", F.explode("edges.field").alias("field"))
    first = pair.orderBy("a", "b").first()
    some = materialize(pair.where((F.col("a") == first["a"])), "some")
    assert incremental.decide(state, some.withColumn("rejected", F.lit(True)), "d", 0)
    split = whole(versions, some.select("a", "b", "field"))
    got = stored(state)
    assert got["households"] != want["households"]
    for name in want:
        assert got[name] == split[name], name
    assert not incremental.decide(state, some.withColumn("rejected", F.lit(False)), "d", 0)
    # a new version of an application of that component doesn't bring a rejected edge back
    again = versions.where(F.col("application_id") == first["a"]).drop("part").orderBy(F.desc("seq")).limit(1).withColumn("seq", F.lit(5))
    assert incremental.apply(state, again, "s", 3)
    assert stored(state)["households"] == split["households"]
    assert incremental.decide(state, some.withColumn("rejected", F.lit(False)), "d", 1)
    assert stored(state) == want


def test_stream_of_files(spark, versions, tmp_path):
    """A file stream into the state, stopped and started again, with a file delivered twice."""
    few = versions.where("scope = '1996' and part < 2")
    src, check = str(tmp_path / "in"), str(tmp_path / "check")
    batch(few, 0).coalesce(1).write.parquet(src)
    state = incremental.State(spark, new_path(spark, "state"))
    rows = lambda: spark.readStream.schema(few.drop("part").schema).parquet(src)
    for k in (1,):
        query = jobs.incremental_stream(rows(), state, check, "files")
        query.processAllAvailable()
        query.stop()
        batch(few, k).coalesce(1).write.mode("append").parquet(src)
        batch(few, 0).coalesce(1).write.mode("append").parquet(src)
    query = jobs.incremental_stream(rows(), state, check, "files")
    query.processAllAvailable()
    query.stop()
    assert stored(state) == whole(few)


def test_killed_write_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = Published(spark, f"file://{tmp_path}/{uuid.uuid4().hex}")
    frame = lambda rows: spark.createDataFrame(rows, "scope string, id long")
    read = lambda *s: sorted(tuple(r) for r in store.read("t", "scope string, id long", *s).select("scope", "id").collect())
    assert read() == [] and store.mark("s") == -1
    assert store.publish({"t": frame([("a", 1), ("a", 2), ("b", 3), ("z/=", 9)])}, ["a", "b", "z/="], "s", 0)
    assert read() == [("a", 1), ("a", 2), ("b", 3), ("z/=", 9)] and read(["z/="]) == [("z/=", 9)]

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # before its commit
        m.setattr(Published, "_write_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            store.publish({"t": frame([("a", 7)])}, ["a"], "s", 1)
    assert read() == [("a", 1), ("a", 2), ("b", 3), ("z/=", 9)] and store.mark("s") == 0
    # within its commit: files without the mark that it is complete
    spark.createDataFrame([("table", "t", "a", "nowhere", "{}", 1)], "kind string, name string, scope string, folder string, schema string, batch long").write.parquet(f"{store.base}/commits/2")
    files, at = store._path(f"{store.base}/commits/2/_SUCCESS")
    files.delete(at, True)
    assert store.last() == 1 and read(["a"]) == [("a", 1), ("a", 2)]
    assert store.publish({"t": frame([("a", 7), ("b", 8)])}, ["a"], "s", 1)  # rows of other scopes aren't taken
    assert read() == [("a", 7), ("b", 3), ("z/=", 9)] and store.mark("s") == 1
    assert not store.publish({"t": frame([("a", 100)])}, ["a"], "s", 1) and read(["a"]) == [("a", 7)]
    assert store.publish({"t": frame([])}, ["b"], "s", 2) and read() == [("a", 7), ("z/=", 9)]
    gone = store.forget()
    assert len(gone) >= 3 and read() == [("a", 7), ("z/=", 9)] and store.forget() == []


def test_every_grouping_rule_has_a_reach():
    assert set(incremental.REACH) == set(rules.GROUP_RULES)
