"""Streaming jobs: incremental rescoring, redelivery, rate windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.operators import incremental
from claimlens.operators.intake import confirmed_scopes
from claimlens.session import materialize, scratch


def over_limit(events: DataFrame, ts: str, key: str, width: str, limit: int, late: str | None = None) -> DataFrame:
    """Keys with more than limit events in a window; on a stream, late is the watermark."""
    if late is not None:
        events = events.withWatermark(ts, late)
    counts = events.groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > limit).select(key, F.col("w.start").alias("hour"), "n")


def once(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Each key's first delivery; repeats within the watermark are dropped."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def rescore_stream(arrivals: DataFrame, rescore: Callable[[DataFrame, int], None], checkpoint: str, scope: str = "scope"):
    """Starts a query that hands the distinct scopes of each micro-batch to rescore(scopes, batch_id).

    rescore should write by (key, batch_id), so that a batch run again changes nothing.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        rescore(rows.select(scope).distinct(), batch_id)

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def incremental_stream(arrivals: DataFrame, state: incremental.State, checkpoint: str, name: str = "arrivals"):
    """Starts a query that takes each micro-batch of applications (with scope and seq) into the state.

    A batch that runs again after a failure is skipped if it had been published, and is done anew if not. name is
    that of the stream in the state and goes with its checkpoint: a new checkpoint needs a new name.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        with scratch():
            written = materialize(rows, "batch")  # read once from the source; streams plan without adaptive execution
            incremental.apply(state, state.spark.read.schema(written.schema).parquet(written._written), name, batch_id)

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def decision_stream(decisions: DataFrame, state: incremental.State, checkpoint: str, name: str = "decisions"):
    """Starts a query that takes each micro-batch of edge decisions (scope, a, b, field, at, rejected) into the state; the last of an edge counts."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        with scratch():
            last = rows.groupBy("scope", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "field").agg(F.max_by("rejected", "at").alias("rejected"))
            written = materialize(last, "batch")
            incremental.decide(state, state.spark.read.schema(written.schema).parquet(written._written), name, batch_id)

    return decisions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def confirmation_stream(confirmed: DataFrame, apps: DataFrame, rescore: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands the scopes of each micro-batch of confirmed accounts (applicant_id) to rescore(scopes, batch_id)."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        rescore(confirmed_scopes(rows, apps), batch_id)

    return confirmed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
