"""Exact vector search.

Vectors are compared in batches by numpy; every task keeps its own best ``k`` per query, so what is
shuffled is bounded by tasks times queries times k, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.tables import spread


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for null or different lengths, 0 for a zero vector."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    x, y = F.transform(a, lambda v: v.cast("double")), F.transform(b, lambda v: v.cast("double"))
    dot, na, nb = total(F.zip_with(x, y, lambda p, q: p * q)), total(F.transform(x, lambda v: v * v)), total(F.transform(y, lambda v: v * v))
    return F.when(F.size(a) == F.size(b), F.when((na == 0) | (nb == 0), 0.0).otherwise(dot / (F.sqrt(na) * F.sqrt(nb))))


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """``query_id, id, score, rank`` of the nearest ``k`` vectors of every query, ties by id; a vector isn't its own neighbour.

    ``queries`` has query_id and a vector; it is sent to every task in blocks of ``block`` queries, each a
    pass over the vectors. Null vectors, and those of another length than the query, are left out.
    """
    rows = spread(vectors.select(id_col, vector)).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v")).where("v is not null")
    asked = queries.select(F.col("query_id").cast("bigint"), F.col(vector).alias("v")).where("v is not null")
    found = None
    pending: list[tuple[int, list[float]]] = []

    def scan(block_rows: list[tuple[int, list[float]]]) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast(block_rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = np.array([q for q, _ in shared.value], np.int64)
            matrix = np.array([v for _, v in shared.value], np.float64)
            matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
            best_s, best_i = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
            for batch in batches:
                lists = batch.column(1)
                fit = np.asarray(pa.compute.list_value_length(lists)) == matrix.shape[1]
                if not fit.any():
                    continue
                lists = lists.filter(pa.array(fit))
                own = np.asarray(batch.column(0))[fit]
                flat = np.asarray(lists.flatten(), np.float64).reshape(-1, matrix.shape[1])
                norm = np.linalg.norm(flat, axis=1)
                score = np.where(norm > 0, (matrix @ flat.T) / np.maximum(norm, 1e-300), 0.0)
                score[ids[:, None] == own[None, :]] = -np.inf
                best_s = np.concatenate([best_s, score], axis=1)
                best_i = np.concatenate([best_i, np.broadcast_to(own, score.shape)], axis=1)
                if best_s.shape[1] > 4 * k:
                    order = np.lexsort((best_i, -np.round(best_s, 9)), axis=1)[:, :k]
                    best_s, best_i = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_i, order, 1)
            order = np.lexsort((best_i, -np.round(best_s, 9)), axis=1)[:, :k]
            best_s, best_i = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_i, order, 1)
            seen = np.isfinite(best_s)
            yield pa.record_batch([pa.array(np.repeat(ids, best_s.shape[1]).reshape(best_s.shape)[seen]), pa.array(best_i[seen]), pa.array(best_s[seen])], names=["query_id", "id", "score"])

        return rows.mapInArrow(run, "query_id bigint, id bigint, score double")

    for q in asked.orderBy("query_id").toLocalIterator():
        pending.append((q[0], list(q[1])))
        if len(pending) == block:
            found = scan(pending) if found is None else found.unionByName(scan(pending))
            pending = []
    if pending or found is None:
        part = scan(pending) if pending else rows.where("false").selectExpr("id as query_id", "id", "0d as score")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


SIZE = 64


def hash_vector(words: list[str], size: int = SIZE) -> list[float]:
    """The embedding of a few words, as hashed gives it for rows."""
    out = np.zeros(size)
    for w in words:
        code = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
        out[code % size] += 1.0 if code // size % 2 == 0 else -1.0
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).tolist()


def hashed(rows: DataFrame, words: Column, keep: list[str], size: int = SIZE) -> DataFrame:
    """The columns ``keep`` and ``embedding``: signed counts of hashed words, of length 1; zeros for no words.

    A deterministic stand-in for a model. Words are hashed by the JVM, counts are one numpy histogram per batch.
    """
    code = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"))
    chosen = rows.select(*keep, code.alias("_codes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            codes = np.asarray(lists.flatten(), np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)))
            sign = np.where(codes // size % 2 == 0, 1.0, -1.0)
            counts = np.bincount(row * size + codes % size, weights=sign, minlength=batch.num_rows * size).reshape(-1, size)
            norm = np.linalg.norm(counts, axis=1, keepdims=True)
            flat = (counts / np.where(norm > 0, norm, 1.0)).reshape(-1)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * size, pa.int32()), pa.array(flat))
            yield pa.record_batch([*batch.columns[:-1], vectors], names=[*keep, "embedding"])

    kinds = dict(chosen.dtypes)
    return spread(chosen).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", embedding array<double>")
