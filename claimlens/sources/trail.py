"""An append-only trail that is laid out for its lookups: by entity, by actor, by time.

Each append is written once for every access path, in files that hold a range of its
keys, in order within. Beside them stands a small table with the least and greatest
key of every file (a row for each), so a lookup opens the files whose range holds
what it asks for and no others; within a file Parquet's own statistics go on. There
is no way to change or delete rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Trail:
    def __init__(self, spark: SparkSession, base: str, paths: dict[str, list[str]]):
        """paths: by access path its key columns, the first of which lookups name."""
        self.spark, self.base, self.paths = spark, base.rstrip("/"), paths

    def append(self, rows: DataFrame) -> None:
        """Adds rows. A file becomes known by its range, which is written last, so rows of an append that was cut short
        are never found by a path that it hadn't finished."""
        for name, keys in self.paths.items():
            folder = f"{self.base}/{name}/{uuid.uuid4().hex}"
            rest = [c for c in rows.columns if c not in keys and _ordered(rows, c)]
            rows.repartitionByRange(*keys, *rest[:1]).sortWithinPartitions(*keys, *rest).write.parquet(folder)
            written = self.spark.read.schema(rows.schema).parquet(folder)
            one = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(keys[0]).alias("low"), F.max(keys[0]).alias("high"), F.count_if(F.col(keys[0]).isNull()).alias("nulls"), F.count(F.lit(1)).alias("rows"))
            one.coalesce(1).write.mode("append").parquet(f"{self.base}/ranges/{name}")

    def files(self, name: str, hit: Column) -> list[str]:
        """The files of a path whose range (low, high) meets the condition."""
        try:
            ranges = self.spark.read.parquet(f"{self.base}/ranges/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return sorted(r["file"] for r in ranges.where(hit).select("file").collect())

    def lookup(self, name: str, value) -> DataFrame:
        """All rows whose first key of that path is value; null finds nothing."""
        return self.between(name, value, value)

    def between(self, name: str, low, high) -> DataFrame:
        """All rows whose first key of that path is from low to high, both included."""
        key = self.paths[name][0]
        found = self.files(name, (F.col("low") <= F.lit(high)) & (F.col("high") >= F.lit(low)))
        if not found:
            return self._any(name).limit(0)
        return self.spark.read.parquet(*found).where(F.col(key).between(low, high))

    def _any(self, name: str) -> DataFrame:
        some = self.files(name, F.lit(True))[:1]
        if not some:
            raise LookupError(f"nothing has been written to {self.base}")
        return self.spark.read.parquet(*some)


def _ordered(rows: DataFrame, name: str) -> bool:
    return rows.schema[name].dataType.typeName() not in ("map", "variant")
