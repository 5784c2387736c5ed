"""Tables in the folder that all executors share, to cut lineage between the steps of an iteration; rows dealt to tasks."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a local session may go without that setting."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = _local()
    return f"{known.rstrip('/')}/plumbline/{uuid.uuid4().hex}"


@functools.cache
def _local() -> str:
    return tempfile.mkdtemp(prefix="plumbline-")


#: Most rows of a task, and least rows that are worth one while cores are idle.
ROWS, FEW = 500_000, 2_000


def tasks(spark: SparkSession, rows: int, most: int = ROWS, rounds: int = 1) -> int:
    """How many tasks so many rows are dealt to: as many as the cores work off in so many rounds, as long as each has FEW, and
    no more than ``most`` rows in one."""
    return max(1, -(-rows // most), min(rounds * spark.sparkContext.defaultParallelism, rows // FEW))


def dealt(df: DataFrame, *keys: str, most: int = ROWS) -> DataFrame:
    """The rows of a table, dealt by keys.  A scan has as many tasks as its files have row groups, so a small file of many rows
    is the work of one; and the session's number of partitions doesn't grow with a table.  The rows are counted, which for a
    scan reads the files' footers only."""
    return df.repartition(tasks(df.sparkSession, df.count(), most), *keys)


def cutter(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """Writes a table under a name and reads it back."""
    root = shared_folder(spark)

    def cut(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    return cut
