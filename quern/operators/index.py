"""Inverted index, query expressions and BM25.

An index is three Parquet tables in the shared folder: postings, terms and corpus figures. Postings lie in
buckets by the first letters of their term, sorted by term inside, so that a query reads the buckets of its
terms alone (partition pruning, then row groups by their least and greatest term), also for a prefix. The
rows of a term carry document, frequency, length and positions; phrases are found by positions. Nothing
reads the corpus again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.session import workspace
from quern.sources.tables import files_of, fingerprint, spread, written

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Letters of a term that choose its bucket.
HEAD = 3


@dataclass(frozen=True)
class Term:
    """A word, or with ``prefix`` any word that begins with it."""

    text: str
    prefix: bool = False


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


Expression = Term | Phrase | And | Or


def terms_of(e: Expression) -> list[Term]:
    """The distinct terms that are scored, in order."""
    if isinstance(e, Term):
        return [e]
    found = [Term(w) for w in e.words] if isinstance(e, Phrase) else [t for p in e.parts for t in terms_of(p)]
    return list(dict.fromkeys(found))


def parse(query: str, stop: frozenset[str] = frozenset(), least: int = 2) -> list[str]:
    """Words of a query: letters and digits in lower case, long enough and no stop words; each once, in order."""
    import re

    return list(dict.fromkeys(w for w in re.findall(r"[^\W_]+", query.lower()) if len(w) >= least and w not in stop))


def siblings(words: list[str], synonyms: dict[str, list[str]]) -> list[str]:
    """Words beside the given ones that a table of synonyms links with them: a key's, and those of a member's key."""
    out: list[str] = []
    for w in words:
        for key, others in synonyms.items():
            if w == key or w in others:
                out.extend([key, *others])
    return [w for w in dict.fromkeys(out) if w not in words]


def plan(words: list[str], expanded: list[str] = ()) -> Expression:
    """What a query asks for: its words as a phrase, or all of its long words (any of them, if there are more than three).

    Long words have three letters or more; a query without any asks for its short ones. Expansions are
    alternatives; one of several words is a phrase.
    """
    long = tuple(Term(w) for w in words if len(w) > 2) or tuple(Term(w) for w in words)
    options: list[Expression] = [Phrase(tuple(words))] if len(words) > 1 else []
    options.append(long[0] if len(long) == 1 else And(long) if len(long) <= 3 and len(long[0].text) > 2 else Or(long))
    for e in expanded:
        parts = tuple(parse(e, least=1))
        if parts:
            options.append(Term(parts[0]) if len(parts) == 1 else Phrase(parts))
    return options[0] if len(options) == 1 else Or(tuple(dict.fromkeys(options)))


def idf(documents: Column, holding: Column) -> Column:
    """Rareness of a term; near nothing once half of all documents hold it."""
    return F.greatest(F.log((documents - holding + 0.5) / (holding + 0.5)), F.lit(IDF_FLOOR))


def saturation(count: Column, length: Column, mean: Column) -> Column:
    return count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean))


def postings(corpus: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``term, id, length, tf, positions`` of every term of every row; nothing is shuffled.

    Texts are cut into words by the JVM. A batch's words are one array of codes, sorted by row and code, and
    the runs of equal pairs are its postings; no word is touched one by one. Ids are meant to be unique.
    """
    words = spread(corpus.select(F.col(id_col).alias("id"), text.alias("_text"))).select("id", tokens(F.col("_text")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(pc.list_value_length(lists), np.int64)
            flat = lists.flatten()
            coded = flat.dictionary_encode()
            codes = np.asarray(coded.indices, np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            key = row * max(len(coded.dictionary), 1) + codes
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            tf = np.diff(np.append(first, len(key)))
            of = row[order][first]
            columns = [
                coded.dictionary.take(pa.array(codes[order][first])), batch.column(0).take(pa.array(of)), pa.array(sizes[of].astype(np.int32)), pa.array(tf.astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(place[order].astype(np.int32))),
            ]
            yield pa.record_batch(columns, names=["term", "id", "length", "tf", "positions"])

    return words.mapInArrow(run, f"term string, id {dict(words.dtypes)['id']}, length int, tf bigint, positions array<int>")


def term_stats(index: DataFrame) -> DataFrame:
    """``term, df, cf``: in how many documents a term occurs, and how often at all."""
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term[:HEAD].encode()) % buckets


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode(F.substring(term, 1, HEAD), "utf-8")), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Index:
    """An index on disk."""

    spark: SparkSession
    path: str
    buckets: int
    kind: str = "bigint"  # type of the ids

    @property
    def postings(self) -> DataFrame:
        """``term, id, length, tf, positions, bucket``."""
        return self.spark.read.schema(f"term string, id {self.kind}, length int, tf bigint, positions array<int>, bucket int").parquet(f"{self.path}/postings")

    @property
    def terms(self) -> DataFrame:
        """``term, df, cf, bucket``: in how many documents a term occurs, and how often at all."""
        return self.spark.read.schema("term string, df bigint, cf bigint, bucket int").parquet(f"{self.path}/terms")

    @property
    def corpus(self) -> DataFrame:
        """One row: ``documents, mean`` length."""
        return self.spark.read.schema("documents bigint, mean double").parquet(f"{self.path}/corpus")

    def of(self, terms: list[Term]) -> DataFrame:
        """The postings of some terms, from their buckets."""
        if not terms:
            return self.postings.where(F.lit(False))
        hit = F.lit(False)
        for t in terms:
            hit = hit | is_term(t)
        if all(not t.prefix or len(t.text) >= HEAD for t in terms):
            hit = F.col("bucket").isin(sorted({bucket_of(t.text, self.buckets) for t in terms})) & hit
        return self.postings.where(hit)


def is_term(t: Term) -> Column:
    return F.startswith("term", F.lit(t.text)) if t.prefix else F.col("term") == t.text


def build(corpus: DataFrame, id_col: str, text: Column, path: str, buckets: int, salts: int = 4) -> Index:
    """Writes an index. A term that a third of all documents hold is written by ``salts`` tasks; null texts have no words."""
    docs = spread(corpus.select(F.col(id_col).alias("id"), text.alias("_text")))
    rows = postings(docs, "id", F.col("_text")).withColumn("bucket", _bucket(F.col("term"), buckets))
    placed = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(salts))).sortWithinPartitions("bucket", "term", "id")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    index = Index(corpus.sparkSession, path, buckets, dict(docs.dtypes)["id"])
    counts = index.postings.groupBy("bucket", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    figures = docs.agg(F.count("*").alias("documents"), F.avg(F.size(tokens(F.col("_text")))).alias("mean"))
    figures.coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")  # last: its presence says that the index is whole
    return index


def declared(spark: SparkSession, table_path: str, id_col: str, text: Column, what: str, bytes_a_bucket: int = 128 << 20) -> Index:
    """The index of a table's text, built if the shared folder has none for the files as they are now.

    ``what`` names the text. There is a bucket for every 128 MB of the table, 8 at least.
    """
    state, size = files_of(spark, table_path)
    buckets = max(8, size // bytes_a_bucket)
    path = f"{workspace(spark)}/index-{fingerprint(state, id_col, what, buckets)}"
    if written(spark, f"{path}/corpus"):
        return Index(spark, path, buckets, dict(spark.read.parquet(table_path).dtypes)[id_col])
    return build(spark.read.parquet(table_path), id_col, text, path, buckets)


def _found(e: Expression, count: dict[Term, Column], places: dict[str, Column]) -> Column:
    """Whether a document satisfies an expression, by its counts and positions."""
    if isinstance(e, Term):
        return count[e] > 0
    if isinstance(e, Phrase):
        first, *rest = (places[w] for w in e.words)

        def at(p: Column) -> Column:
            hit = F.lit(True)
            for k, other in enumerate(rest, 1):
                hit = hit & F.array_contains(other, p + k)
            return hit

        return F.coalesce(F.exists(first, at), F.lit(False))
    parts = [_found(p, count, places) for p in e.parts]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if isinstance(e, And) else out | p
    return out


def phrases_of(e: Expression) -> list[str]:
    """Distinct words of all phrases."""
    if isinstance(e, Phrase):
        return list(dict.fromkeys(e.words))
    return [] if isinstance(e, Term) else list(dict.fromkeys(w for p in e.parts for w in phrases_of(p)))


def search(index: Index, expression: Expression) -> DataFrame:
    """``id, score`` of every document that satisfies an expression, by BM25 over all its terms.

    Reads the buckets of the terms; one aggregation by document gives counts and positions, one row of
    figures gives the rareness of the terms over the whole corpus.
    """
    terms = terms_of(expression)
    words = phrases_of(expression)
    rows = index.of(terms).groupBy("id").agg(
        F.max("length").alias("length"), *(F.coalesce(F.sum(F.when(is_term(t), F.col("tf"))), F.lit(0)).alias(f"_tf{i}") for i, t in enumerate(terms)),
        *(F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True).alias(f"_at{i}") for i, w in enumerate(words)),
    )
    count = {t: F.col(f"_tf{i}") for i, t in enumerate(terms)}
    held = rows.agg(*(F.count_if(c > 0).alias(f"_df{i}") for i, c in enumerate(count.values())))
    # both are one row
    figures = held.crossJoin(F.broadcast(index.corpus))
    hits = rows.where(_found(expression, count, {w: F.col(f"_at{i}") for i, w in enumerate(words)})).crossJoin(F.broadcast(figures))
    score = F.lit(0.0)
    for i, c in enumerate(count.values()):
        score = score + idf(F.col("documents"), F.col(f"_df{i}")) * saturation(c, F.col("length"), F.col("mean"))
    return hits.select("id", score.alias("score"))


def batch(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, id, score, rank``: the best ``k`` documents of every query, any word of which counts; ties by id.

    ``queries`` has query_id and text. Postings of the queries' terms are put together by document once and
    meet the queries' weights there; scores are summed and cut to the best ``k`` in each task before anything
    is exchanged, so what is shuffled for ranking doesn't grow with the documents. Every term counts, however
    common.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).withColumn("bucket", _bucket(F.col("term"), index.buckets))
    # one row of figures
    known = index.terms.join(asked, ["bucket", "term"]).crossJoin(F.broadcast(index.corpus))
    weights = known.select("term", "query_id", "mean", idf(F.col("documents"), F.col("df")).alias("weight"))
    wanted = asked.select("bucket", "term").distinct()
    by_document = index.postings.select("bucket", "term", "id", "length", "tf").join(wanted, ["bucket", "term"], "left_semi").drop("bucket").repartition("id")
    part = F.col("weight") * saturation(F.col("tf"), F.col("length"), F.col("mean"))
    scores = by_document.join(weights, "term").groupBy("id", "query_id").agg(F.sum(part).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
