"""The stage log over a table and over a stream against a plain machine; deliveries repeated; rate windows on a stream."""

import datetime
import random

from claimlens.streaming import jobs, stages
from pyspark.sql import functions as F

T0 = 1_900_000_000


def plain(events, most=4, stale=300.0, wait=0.0):
    """Every run by itself, event after event."""
    out = {}
    for key in {e[:2] for e in events}:
        status, attempts, since, refused, last = "pending", 0, None, 0, None
        for _, _, at, _, kind in sorted(e for e in events if e[:2] == key):
            last = at
            if kind == "claim":
                ok = status == "pending" or (status == "failed" and attempts < most and at >= since + wait * 2 ** (attempts - 1)) or (status == "running" and since < at - stale)
                if ok:
                    status, attempts, since = "running", attempts + 1, at
                else:
                    refused += 1
            elif status == "running" and kind in ("succeed", "fail", "give up"):
                since = at
                status = "succeeded" if kind == "succeed" else "dead_lettered" if kind == "give up" or attempts >= most else "failed"
            elif status == "dead_lettered" and kind == "reset":
                status, attempts, since = "pending", 0, at
        out[key] = (status, attempts, since, refused, last)
    return out


def made(seed, runs=12, n=500):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["claim", "claim", "claim", "fail", "fail", "fail", "succeed", "reset", "odd"] + ["give up"] * (rng.random() < 0.3))
        rows.append((f"d{rng.randrange(runs)}", rng.choice(["read", "score"]), float(T0 + rng.randrange(2000)), i, kind))
    return rows


def states(rows):
    return {(r["document"], r["stage"]): (r["status"], r["attempts"], r["since"], r["refused"], r["at"]) for r in rows}


COLS = "document string, stage string, at double, seq long, kind string"


def test_stage_log_of_a_table(spark):
    for wait in (0.0, 60.0):
        rows = made(3)
        got = stages.folded(spark.createDataFrame([*rows, (None, "read", 1.0, 1, "claim")], COLS).repartition(6), wait=wait)
        assert states(got.collect()) == plain(rows, wait=wait)
    assert {s[0] for s in plain(rows).values()} >= {"running", "failed", "dead_lettered"}
    now = float(T0 + 1900)
    can = {(r["document"], r["stage"]) for r in stages.claimable(got, now, wait=60.0).collect()}
    assert can == {k for k, (s, n, since, x, _) in plain(rows, wait=60.0).items() if stages.eligible(stages.Run(s, n, since, x), now, wait=60.0)}
    assert stages.folded(spark.createDataFrame([], COLS)).count() == 0


def stamp(seconds):
    return datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc)


def test_stage_log_of_a_stream(spark, tmp_path):
    """Late events, within the watermark, in files that come in another order: the same states as the table's fold."""
    rows = made(8, runs=4, n=90)
    parts = sorted(rows, key=lambda r: r[2] // 400)  # blocks of time; within them any order
    rng = random.Random(1)
    src = tmp_path / "in"
    src.mkdir()
    schema = "document string, stage string, at timestamp, seq long, kind string"
    blocks = {}
    for r in parts:
        blocks.setdefault(r[2] // 400, []).append((*r[:2], stamp(r[2]), *r[3:]))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        seen = []
        stream = stages.live(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)), "500 seconds")
        run = lambda: stream.writeStream.foreachBatch(lambda df, i: seen.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).start()
        ends = [(("end", "end", stamp(T0 + 5000 + i), 0, "odd"),) for i in range(2)]  # moves the watermark past all others
        for block in [*(b for _, b in sorted(blocks.items())), *ends]:
            block = list(block)
            rng.shuffle(block)
            spark.createDataFrame(block, schema).coalesce(1).write.mode("append").parquet(str(src))
            query = run()  # started anew for each file: states live in the checkpoint
            query.processAllAvailable()
            query.stop()
        last = {}
        for r in seen:
            k = (r["document"], r["stage"])
            if k not in last or r["at"] >= last[k]["at"]:
                last[k] = r
        assert {k: v for k, v in states(last.values()).items() if k[0] != "end"} == plain(rows)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_deliveries_once_and_rates_on_a_stream(spark, tmp_path):
    schema = "id string, who string, at timestamp"
    rows = [(f"j{i % 30}", f"w{i % 3}", stamp(T0 + 60 * (i % 30))) for i in range(60)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(src)
    read = lambda: spark.readStream.schema(schema).parquet(src)
    try:
        for name, df, mode in (("first_deliveries", jobs.once(read(), "id", "at", "2 hours"), "append"), ("over_limit", jobs.over_limit(jobs.once(read(), "id", "at", "2 hours"), "at", "who", "1 hour", 8), "update")):
            query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
            query.processAllAvailable()
            query.stop()
        assert sorted(r["id"] for r in spark.table("first_deliveries").collect()) == sorted({r[0] for r in rows})
        hour = lambda t: int(t.timestamp()) // 3600
        count = {}
        for r in {r[0]: r for r in rows}.values():
            count[r[1], hour(r[2])] = count.get((r[1], hour(r[2])), 0) + 1
        assert {(r["who"], r["n"]) for r in spark.table("over_limit").collect()} == {(w, n) for (w, _), n in count.items() if n > 8}
        got = []
        query = jobs.rescore_stream(read().select(F.col("who").alias("scope")), lambda scopes, i: got.extend(r[0] for r in scopes.collect()), str(tmp_path / "check"))
        query.processAllAvailable()
        query.stop()
        assert sorted(got) == ["w0", "w1", "w2"]
    finally:
        for name in ("first_deliveries", "over_limit"):
            spark.catalog.dropTempView(name)
