"""Queries over logs, documents and edges: latest rows, folds, queues of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Each key's last row by order, as a grouping that is combined before the shuffle."""
    last = rows.groupBy(key).agg(F.max(F.struct(*dict.fromkeys([*order, *values]))).alias("m"))
    return last.select(key, *[F.col(f"m.{v}").alias(v) for v in values])


def eligible(apps: DataFrame, scope: str | None, confirmed: DataFrame, key: str) -> DataFrame:
    """Applications of a scope that are not trashed and whose account is confirmed."""
    if scope is not None:
        apps = apps.where(F.col("scope") == scope)
    return apps.where("status <> 'trashed'").join(confirmed.select(key), key, "left_semi")


def verification_fold(log: DataFrame, key: str, order: list[str], status: str, notes: str, links: DataFrame, least: int = 12) -> DataFrame:
    """Each key's last valid result: a mismatch needs notes, and the key an existing link."""
    fine = (F.col(status) != "mismatch") | (F.length(F.trim(notes)) >= least)
    return latest(log.where(fine).join(links.select(key), key, "left_semi"), key, order, [status])


def first_mark(marks: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Each key's first mark; later ones change nothing."""
    one = marks.groupBy(key).agg(F.min(F.struct(*dict.fromkeys([*order, *values]))).alias("m"))
    return one.select(key, *[F.col(f"m.{v}").alias(v) for v in values])


def purged(docs: DataFrame, gone: Column, content: list[str], keep: str) -> DataFrame:
    """Contents of purged rows become null; their hash stays."""
    docs = docs.withColumns({"sha256": F.sha2(keep, 256), "purged": F.coalesce(gone, F.lit(False))})
    return docs.withColumns({c: F.when(~F.col("purged"), F.col(c)) for c in content})


def access(known: Column, purged_at: Column) -> Column:
    return F.when(~F.coalesce(known, F.lit(False)), "missing").when(purged_at.isNotNull(), "purged").otherwise("available")


def stuck(runs: DataFrame, key: str, at: str, dead: Column, done: Column, now: Column, minutes: int = 10, stages: int = 5) -> DataFrame:
    """Keys without a dead letter, with fewer successes than stages, and quiet for so many minutes."""
    one = runs.groupBy(key).agg(F.count_if(dead).alias("d"), F.count_if(done).alias("done"), F.max(at).alias("last"))
    quiet = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp")) > minutes * 60_000_000
    return one.where((F.col("d") == 0) & (F.col("done") < stages) & quiet).select(key, "done")


def merged_edges(edges: DataFrame, a: str, b: str, rejected: str) -> DataFrame:
    """Edges in either direction as one (a < b); a rejection of either stands."""
    pair = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), rejected).where("a <> b")
    return pair.groupBy("a", "b").agg(F.bool_or(rejected).alias("rejected"))


def neighbourhood(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (a, b) with both ends among members (id)."""
    return edges.join(members.select(F.col("id").alias("a")), "a", "left_semi").join(members.select(F.col("id").alias("b")), "b", "left_semi")


def account_upsert(rows: DataFrame, key: Column, order: list[str], values: list[str], overwrite: bool) -> DataFrame:
    """One row for each account; an import overwrites its values, a submission keeps the first."""
    rows = rows.withColumn("account", F.lower(key))
    return latest(rows, "account", order, values) if overwrite else first_mark(rows, "account", order, values)


def rejected_edges(decisions: DataFrame, order: list[str], least: int = 8) -> DataFrame:
    """(a, b, field) of the edges whose last valid decision is a rejection; a rejection needs a reason."""
    fine = decisions.where((F.col("action") != "reject") | (F.length(F.trim("reason")) >= least))
    last = fine.groupBy("a", "b", "field").agg(F.max(F.struct(*order, "action"))["action"].alias("action"))
    return last.where("action = 'reject'").drop("action")
