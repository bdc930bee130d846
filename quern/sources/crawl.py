"""Pages from elsewhere: addresses to visit, polite fetching, artifacts with a second source, static documents, releases.

What fetches is a function the caller passes, called on the executors; the engine itself opens no connection.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.urls import host
from quern.sources.store import Store

Fetch = Callable[[str], tuple[int, str]]
FETCHED = "url string, status int, body string, attempts int, error string"


def discover(found: DataFrame, hosts: dict[str, str], keep: Column | None = None, static: list[str] = ()) -> DataFrame:
    """``url`` of the pages to visit: what sitemaps name, on canonical hosts, filtered, with static addresses; each once, in order."""
    url = F.col("url")
    for old, new in hosts.items():
        url = F.when(host(F.col("url")) == old, F.regexp_replace(url, "^([a-z]+://)[^/]+", f"$1{new}")).otherwise(url)
    rows = found.select(url.alias("url")).where("url is not null")
    if keep is not None:
        rows = rows.where(keep)
    if static:
        rows = rows.unionByName(found.sparkSession.createDataFrame([(u,) for u in static], "url string"))
    return rows.distinct().orderBy("url")


def crawl(urls: DataFrame, fetch: Fetch, workers: int = 3, delay: float = 1.0, attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """``url, status, body, attempts, error`` of every address, by at most ``workers`` tasks.

    A host's addresses lie in one task and are fetched one after the other, ``delay`` seconds apart, so no host
    is asked by two at once. A fetch that raises, or gives a status of 500 or more, is tried again up to
    ``attempts`` times, each time after twice the wait; what fails for good is a row with its error and no body.
    A null address gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                status = body = error = None
                for tried in range(1, attempts + 1):
                    if not first:
                        wait(delay * 2 ** (tried - 1))
                    first = False
                    try:
                        status, body = fetch(url)
                        error = None if status < 400 else f"status {status}"
                    except Exception as e:  # noqa: BLE001, one page must not end the crawl
                        status, body, error = None, None, str(e)[:200]
                    if error is None or (status is not None and status < 500):
                        break
                rows.append((url, status, body if error is None else None, tried, error))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["url", "status", "body", "attempts", "error"])

    once = urls.select("url").where("url is not null").distinct()
    return once.repartition(workers, host(F.col("url"))).mapInArrow(run, FETCHED)


def pooled(items: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, concurrency: int) -> DataFrame:
    """Items worked on by at most ``concurrency`` tasks at once."""
    return items.repartition(concurrency).mapInArrow(work, schema)


def first_source(sources: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Rows of several sources with ``provenance``: each key's rows come from the first source that has it."""
    out = seen = None
    for name, rows in sources:
        fresh = rows if seen is None else rows.join(seen, key, "left_anti")
        named = fresh.withColumn("provenance", F.lit(name))
        out = named if out is None else out.unionByName(named)
        seen = rows.select(key).distinct() if seen is None else seen.unionByName(rows.select(key)).distinct()
    return out


def static_documents(spark: SparkSession, documents: dict[str, str]) -> DataFrame:
    """``uri, content`` of documents that come with the program."""
    return spark.createDataFrame(sorted(documents.items()), "uri string, content string")


def read_static(documents: DataFrame, uri: str) -> str:
    """One of them by its address; an unknown address is an error that names the known ones."""
    row = documents.where(F.col("uri") == uri.split("#")[0]).first()
    if row is None:
        raise KeyError(f"{uri}: known are {', '.join(r[0] for r in documents.select('uri').orderBy('uri').limit(50).collect())}")
    return row["content"]


def install(source: Store, target: Store) -> dict:
    """Copies a release into a store after its version, schemas, sizes and hashes were verified.

    What was there stays current if anything fails, and is kept on disk as the state before. Returns the new manifest.
    """
    wrong = source.verify()
    if wrong or not source.manifest()["tables"]:
        raise ValueError(f"release not installed: {', '.join(wrong) or 'nothing in it'}")
    facts = dict(source.manifest().get("facts", {}))
    return target.publish({t: source.read(t) for t in source.manifest()["tables"]}, **facts, installed=uuid.uuid4().hex)


class VectorCache:
    """Vectors by key as a DataFrame of ``key, embedding``, kept as JSON files; the last put of a key counts."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorCache:
        return cls(spark.read.schema("key string, embedding array<float>").json(path))

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").json(path)

    def put(self, new: DataFrame) -> VectorCache:
        return VectorCache(self.rows.join(new.select("key"), "key", "left_anti").unionByName(new.dropDuplicates(["key"]).select("key", "embedding")))

    def get(self, keys: DataFrame) -> DataFrame:
        return self.rows.join(keys.select("key").distinct(), "key", "left_semi")

    def delete(self, keys: DataFrame) -> VectorCache:
        return VectorCache(self.rows.join(keys.select("key"), "key", "left_anti"))
