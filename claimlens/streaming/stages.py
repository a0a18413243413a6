"""The stage log as a state machine: attempts, eligibility by time, dead letters; over a table and over a stream.

A run (document, stage) is claimed, and succeeds or fails. A claim is taken where the
run is pending, has failed fewer than MOST times and waited its back-off, or has been
running for longer than STALE, when its worker is taken for dead. The last failure
that is allowed, or one that is permanent, makes it a dead letter, which only a reset
brings back. Both forms fold a run's events in order of (at, seq) by the same step.
Over a table events are sorted within tasks and streamed through, so no run is ever
held whole; over a stream they wait, by key, until the watermark has passed them, so
any order within it gives the same states.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Attempts before a dead letter, and seconds: a claim is stale, the first wait after a failure (doubled each time).
MOST, STALE, WAIT = 4, 300.0, 0.0
KEY = ["document", "stage"]
_EVENT = "at double, seq long, kind string"
_RUN = "status string, attempts int, since double, refused long"
_OUT = f"document string, stage string, {_RUN}, at double"


class Run(NamedTuple):
    """status, attempts since the last reset, when the status began, and claims that were refused."""

    status: str = "pending"
    attempts: int = 0
    since: float | None = None
    refused: int = 0


def eligible(run: Run, at: float, most: int = MOST, stale: float = STALE, wait: float = WAIT) -> bool:
    """Whether a claim at that time (seconds) is taken."""
    if run.status == "failed":
        return run.attempts < most and at >= run.since + wait * 2 ** (run.attempts - 1)
    return run.status == "pending" or (run.status == "running" and run.since < at - stale)


def step(run: Run, at: float, kind: str, most: int = MOST, stale: float = STALE, wait: float = WAIT) -> Run:
    """The run after an event: claim, succeed, fail, give up (a permanent failure), reset; what doesn't apply changes nothing."""
    if kind == "claim":
        if eligible(run, at, most, stale, wait):
            return Run("running", run.attempts + 1, at, run.refused)
        return run._replace(refused=run.refused + 1)
    if kind == "succeed" and run.status == "running":
        return run._replace(status="succeeded", since=at)
    if kind in ("fail", "give up") and run.status == "running":
        return run._replace(status="dead_lettered" if kind == "give up" or run.attempts >= most else "failed", since=at)
    if kind == "reset" and run.status == "dead_lettered":
        return Run("pending", 0, at, run.refused)
    return run


def folded(events: DataFrame, most: int = MOST, stale: float = STALE, wait: float = WAIT) -> DataFrame:
    """(document, stage, status, attempts, since, refused, at) of every run after all its events (document, stage, at in seconds, seq, kind)."""
    rows = events.where("document is not null and stage is not null and at is not null").select(*KEY, F.col("at").cast("double").alias("at"), F.col("seq").cast("long").alias("seq"), "kind")
    rows = rows.repartition(*KEY).sortWithinPartitions(*KEY, "at", "seq", "kind")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, run, last = None, Run(), None
        for b in batches:
            out = []
            for document, stage, at, _, kind in zip(*(c.to_pylist() for c in b.columns)):
                if (document, stage) != key:
                    if key:
                        out.append((*key, *run, last))
                    key, run = (document, stage), Run()
                run, last = step(run, at, kind, most, stale, wait), at
            if out:
                yield _batch(out)
        if key:
            yield _batch([(*key, *run, last)])

    return rows.mapInArrow(fold, _OUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.float64())
    names = [c.strip().split(" ")[0] for c in _OUT.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class StageProcessor(StatefulProcessor):
    """Events of a run wait in its state, with a timer at their time; when the watermark has passed it they are folded."""

    def __init__(self, most: int = MOST, stale: float = STALE, wait: float = WAIT):
        self.limits = most, stale, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run, self.waiting = handle.getValueState("run", _RUN), handle.getListState("waiting", _EVENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r["seconds"], r["seq"], r["kind"]) for r in rows]
        self.waiting.appendList(new)
        for ms in {int(1000 * at) + 1 for at, _, _ in new}:
            self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        all_ = [tuple(e) for e in self.waiting.get()]
        due = sorted((e for e in all_ if int(1000 * e[0]) + 1 <= end), key=lambda e: (e[0], e[1] is not None, e[1] or 0, e[2] or ""))
        if not due:
            return
        run = Run(*self.run.get()) if self.run.exists() else Run()
        for at, _, kind in due:
            run = step(run, at, kind, *self.limits)
        self.run.update(tuple(run))
        rest = [e for e in all_ if int(1000 * e[0]) + 1 > end]
        self.waiting.put(rest) if rest else self.waiting.clear()
        yield Row(document=key[0], stage=key[1], status=run.status, attempts=run.attempts, since=run.since, refused=run.refused, at=due[-1][0])

    def close(self) -> None:
        pass


def live(events: DataFrame, late: str, most: int = MOST, stale: float = STALE, wait: float = WAIT) -> DataFrame:
    """The states of runs as they change, from a stream of events (document, stage, at as a timestamp, seq, kind); late: the
    watermark. The last row of a run by at is its state. Needs the RocksDB state store."""
    good = events.where("document is not null and stage is not null").withWatermark("at", late)
    rows = good.withColumn("seconds", (F.unix_micros("at") / 1e6).cast("double"))
    return rows.groupBy(*KEY).transformWithState(StageProcessor(most, stale, wait), _OUT, "Update", "EventTime")


def claimable(runs: DataFrame, now: float, most: int = MOST, stale: float = STALE, wait: float = WAIT) -> DataFrame:
    """Of folded runs those that a claim at that time would be taken of."""
    failed = (F.col("status") == "failed") & (F.col("attempts") < most) & (F.lit(now) >= F.col("since") + wait * F.pow(F.lit(2.0), F.col("attempts") - 1))
    return runs.where((F.col("status") == "pending") | failed | ((F.col("status") == "running") & (F.col("since") < now - stale)))
