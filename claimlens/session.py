"""Session helpers: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_HELD = threading.local()
#: Held while a table is written: its shuffle files go afterwards, and Python workers get small batches.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many tasks as a shuffle has, for work that is much more than the rows; a small file would be one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where that is unset and all runs in one process (tests) a folder of our own is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/claimlens/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back. settings: of the session, for this write only.

    Used where a result is read several times or a loop would grow the plan:
    the written copy outlives any executor, and the plan starts anew from it.
    The write's own shuffle files, which nothing reads again, go when it has ended.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    settings = _WRITING | (settings or {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    if scopes := getattr(_HELD, "scopes", None):
        scopes[-1].append(out)
    return out


def is_written(df: DataFrame) -> bool:
    """Whether df is a table as materialize returned it, not released since."""
    return "_written" in df.__dict__


@contextmanager
def scratch() -> Iterator[None]:
    """What this thread materializes within the block is deleted at its end; what is to last must be written elsewhere by then."""
    scopes = _HELD.scopes = getattr(_HELD, "scopes", None) or []
    scopes.append([])
    try:
        yield
    finally:
        release(*scopes.pop())


def release(*tables: DataFrame) -> None:
    """Deletes tables that materialize wrote, when no later job reads them; frames it didn't return are left alone."""
    for t in tables:
        path = t.__dict__.pop("_written", None)
        if path:
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
