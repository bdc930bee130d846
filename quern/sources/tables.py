"""Parquet tables of a data directory."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.session import workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``; columns are pruned and filters pushed down by the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MOVES = re.compile(r"\b(?:Aggregate|Join|Repartition|RepartitionByExpression|RebalancePartitions|Sort|Window|Deduplicate|Distinct|GlobalLimit)\b")


def spread(df: DataFrame) -> DataFrame:
    """A scan on at least as many partitions as there are cores.

    A table of one small file is one scan task; a CPU-bound stage over it would leave all other cores
    idle. Only then the rows are redistributed: a scan that already has a task per core, as any table of
    more than a few files has, keeps its partitions and isn't shuffled. What has been shuffled before is
    left alone, as counting its partitions would run it.
    """
    if df.isStreaming or _MOVES.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _path(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def files_of(spark: SparkSession, path: str) -> tuple[list[tuple], int]:
    """What tells a table's state: its entries with size and time, and the number of files and bytes below; and those bytes."""
    fs, at = _path(spark, path)
    entries = sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at))
    whole = fs.getContentSummary(at)
    return [*entries, ("", whole.getFileCount(), whole.getLength())], whole.getLength()


def fingerprint(*what: object) -> str:
    return hashlib.sha256(repr(what).encode()).hexdigest()[:24]


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there and finished."""
    fs, at = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def derived(spark: SparkSession, table_path: str, what: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A table made from another one and kept in the shared folder; made anew only if the files it comes from have changed."""
    path = f"{workspace(spark)}/derived-{fingerprint(files_of(spark, table_path)[0], what)}"
    if not written(spark, path):
        make(spark.read.parquet(table_path)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
