"""Tables published by scope: a batch's partitions become visible together, or not at all.

A batch writes the partitions (scopes) it changed of each table to a folder of its
own, and last a commit: a small table that says, for every table and scope, which
folder holds it now, and up to which batch each stream has come. Readers follow the
last complete commit, so a write that was killed half way is never seen, and the
next attempt goes its own way. A batch at or below its stream's mark is done and
changes nothing when it comes again. One writer at a time: two that commit the same
number collide, and the second fails.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMMIT = "kind string, name string, scope string, folder string, schema string, batch long"


class Published:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _path(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        files, at = self._path(folder)
        return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []

    def last(self) -> int:
        """The number of the last complete commit, 0 before the first."""
        done = [int(n) for n in self._names(f"{self.base}/commits") if n.isdigit() and "_SUCCESS" in self._names(f"{self.base}/commits/{n}")]
        return max(done, default=0)

    def _commit(self, number: int) -> list[dict]:
        """Rows of a commit: one for each table and scope, and one for each stream."""
        return [r.asDict() for r in self.spark.read.schema(_COMMIT).parquet(f"{self.base}/commits/{number}").collect()] if number else []

    def mark(self, stream: str) -> int:
        """The last batch of a stream that is done, -1 if none is."""
        return max((r["batch"] for r in self._commit(self.last()) if r["kind"] == "stream" and r["name"] == stream), default=-1)

    def read(self, name: str, schema: str | T.StructType, scopes: list[str] | None = None) -> DataFrame:
        """A table as last committed (or those scopes of it, of which alone files are read); empty if nothing has been."""
        found: dict[tuple[str, str], list[str]] = {}
        for r in self._commit(self.last()):
            if r["kind"] == "table" and r["name"] == name and (scopes is None or r["scope"] in scopes):
                found.setdefault((r["folder"], r["schema"]), []).append(r["scope"])
        parts = [
            self.spark.read.schema(T.StructType.fromJson(json.loads(s))).parquet(f"{self.base}/{folder}").where(F.col("scope").isin(some))
            for (folder, s), some in sorted(found.items())
        ]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else self.spark.createDataFrame([], schema)

    def publish(self, tables: dict[str, DataFrame], scopes: list[str], stream: str = "", batch: int | None = None) -> bool:
        """Replaces those scopes of the tables (each with a column scope, never null or empty) by the rows given, in one
        commit. False, and nothing is written, if the stream has come as far as the batch before."""
        if batch is not None and batch <= self.mark(stream):
            return False
        before = self.last()
        now = {(r["kind"], r["name"], r["scope"]): r for r in self._commit(before)}
        for name, df in tables.items():
            folder = f"{name}/{before + 1}-{uuid.uuid4().hex}"
            df.where(F.col("scope").isin(scopes)).hint("rebalance", "scope").write.partitionBy("scope").parquet(f"{self.base}/{folder}")
            now |= {("table", name, s): {"kind": "table", "name": name, "scope": s, "folder": folder, "schema": df.schema.json(), "batch": batch} for s in scopes}
        if batch is not None:
            now["stream", stream, None] = {"kind": "stream", "name": stream, "scope": None, "folder": None, "schema": None, "batch": batch}
        self._write_commit(before + 1, list(now.values()))
        return True

    def _write_commit(self, number: int, rows: list[dict]) -> None:
        path = f"{self.base}/commits/{number}"
        if "_SUCCESS" not in self._names(path):
            files, at = self._path(path)
            files.delete(at, True)  # what a killed attempt has left
        df = self.spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in _COMMIT.split(", ")) for r in rows], _COMMIT)
        df.coalesce(1).write.mode("error").parquet(path)

    def forget(self) -> list[str]:
        """Deletes folders and commits that the last commit doesn't need; readers that began earlier must have ended."""
        last = self.last()
        used = {r["folder"] for r in self._commit(last) if r["folder"]}
        gone = [f"commits/{n}" for n in self._names(f"{self.base}/commits") if n != str(last)]
        for name in self._names(self.base):
            if name != "commits":
                gone += [f"{name}/{n}" for n in self._names(f"{self.base}/{name}") if f"{name}/{n}" not in used]
        for g in gone:
            files, at = self._path(f"{self.base}/{g}")
            files.delete(at, True)
        return gone

