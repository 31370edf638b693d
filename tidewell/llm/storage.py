"""Scratch tables in the folder that driver and executors share.

Lineage is cut by writing a table (Parquet, compressed, column-pruned when read
again), never by a local checkpoint: a lost executor then costs a re-read only.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders written in the innermost ``scope`` of this thread.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scope() -> Iterator[list[str]]:
    """The folders written inside, oldest first; threads do not see each other's, and an outer scope gets them too at the end."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        if (outer := _made.get()) is not None:
            outer += made


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where it is unset and the master is local."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-"))
    return shared_folder(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewell/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables whose readers are done, and empty the list."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    paths.clear()


def keyed(docs: DataFrame, doc_id: str, *columns: str) -> tuple[DataFrame, bool]:
    """``(_key, doc_id, columns...)`` with a unique, stable ``_key`` for each row; is the key the id?

    The id itself serves where it is unique and never null (checked by one narrow
    aggregation); otherwise rows are numbered once and written, so that a re-run
    of a lost task sees the same numbers.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c) for c in columns])
    integral = dict(docs.dtypes)[doc_id] in ("bigint", "int", "smallint", "tinyint")
    if integral:
        twice = rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
        if not twice.limit(1).count():
            return rows.select(F.col("doc_id").cast("long").alias("_key"), "doc_id", *columns), True
    return written(rows.select(F.monotonically_increasing_id().alias("_key"), "doc_id", *columns), "keyed"), False


class Shared:
    """A broadcast with a name of its own, so that workers can tell one block from the next."""

    def __init__(self, spark, value):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = self.broadcast._jbroadcast.id()

    @property
    def value(self):
        return self.broadcast.value

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
