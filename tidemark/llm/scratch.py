"""Tables written to the folder that all executors share.

A table that was written and read again cuts lineage: a lost executor costs
the tasks it ran, not the steps before.  The folder is the session's
``spark.checkpoint.dir`` (see :func:`tidemark.storage.shared_dir`).
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tidemark.storage import shared_dir

SMALL_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
}

_made: dict[str, SparkSession] = {}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Keeps batches that pass to Python small while a table is written.

    Some MB of long texts are as fast as many, and an executor holds several at a time.
    """
    before = {k: spark.conf.get(k, None) for k in SMALL_BATCHES}
    try:
        for k, v in SMALL_BATCHES.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """A folder of intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _made[self.root] = spark

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet under ``name`` and return the reread table."""
        schema = df.schema
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            delete(self.spark, self.path(name))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on any Hadoop file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for root, spark in _made.items():
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, root)
        except Exception:  # the session or its JVM has gone already
            return
