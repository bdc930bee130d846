"""Where queries register themselves, with the operators they cover and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    covers: str
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, lists: tuple[str, ...] = ()):
    """Registers a function of (spark, directory) under its own name.

    Columns named in ``lists`` are arrays; they are compared as their items joined by a sign no text holds.
    """

    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            df = f(spark, d)
            return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), "\x1f") for c in lists}) if lists else df

        flat = ", ".join(f"array_to_string({c}, chr(31)) AS {c}" for c in lists)
        QUERIES[f.__name__] = Query(run, covers, f"SELECT * REPLACE ({flat}) FROM ({sql})" if lists and sql else sql)
        return f

    return add
