"""Tables and indexes derived from the given tables: written once for each state of their files, and read from then on."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.scratch import scratch_dir
from quillon.sources.files import exists


#: Bytes of a table's files that a task of a shuffle takes: about a million lines, which it sorts in memory.
TASK_BYTES = 8 << 20


def _files(spark: SparkSession, base: str, tables: list[str]) -> list[tuple[str, int, int]]:
    """The tables' files: path, length and time of change."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/{t}.parquet")
        fs = path.getFileSystem(conf)
        found += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in (fs.listStatus(path) if fs.exists(path) else [])]
    return found


def stamp(spark: SparkSession, base: str, tables: list[str]) -> str:
    """A digest of the tables' files, by path, length and time of change."""
    return hashlib.sha1(repr(sorted(_files(spark, base, tables))).encode()).hexdigest()[:16]


def dealt(spark: SparkSession, base: str, table: str, rows: DataFrame, key: str) -> DataFrame:
    """Rows by a key, in so many tasks that none has to spill what it sorts of a table; Spark would put small ones together by their compressed bytes. A table that fits one task is left to Spark."""
    tasks = sum(length for _, length, _ in _files(spark, base, [table])) // TASK_BYTES
    return rows.repartition(max(tasks, spark.sparkContext.defaultParallelism), key) if tasks > 1 else rows


def place(spark: SparkSession, base: str, tables: list[str], name: str) -> str:
    """The folder in this application's scratch space for what is derived from the tables as they are."""
    return f"{scratch_dir(spark)}/quillon/{spark.sparkContext.applicationId}/derived/{name}-{stamp(spark, base, tables)}"


def derived(spark: SparkSession, base: str, tables: list[str], name: str, build: Callable[[], DataFrame]) -> DataFrame:
    path = place(spark, base, tables, name)
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
