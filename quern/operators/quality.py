"""Data-quality checks and coverage figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import ZERO_WIDTH


class QualityError(RuntimeError):
    """A gate that did not hold."""


def gate(name: str, bad: int, most: int = 0) -> None:
    """Fails a build when a check counts more than ``most``."""
    if bad > most:
        raise QualityError(f"{name}: {bad} found, {most} allowed")


def audit(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``check, bad``: how many rows break each condition, in one pass."""
    counts = rows.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("bad")) for n in checks))
    return counts.select(F.inline(pairs))


def exit_code(fallback: int, shares: int, lint: int) -> int:
    """What a build ends with: 3 for too many rows of the fallback, 4 for a part with too many, 5 for other findings, 0 for none."""
    return 3 if fallback else 4 if shares else 5 if lint else 0


def correspondence_audit(rows: DataFrame, links: DataFrame, vocabularies: list[str], topics: list[str], kinds: list[str], schemes: list[str]) -> DataFrame:
    """``check, bad`` over entries of entry_key, topic, vocabulary, kind, from_api, to_api, keywords and their links.

    Two passes: one aggregation over the entries, one over the links.
    """
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    listed = lambda c, values: F.col(c).isNull() | ~F.col(c).isin(*values)
    head = F.concat(F.coalesce("topic", F.lit("")), F.lit("/"), F.coalesce("vocabulary", F.lit("")), F.lit("/"))
    checks = {
        "key shape": ~F.startswith("entry_key", head), "vocabulary list": listed("vocabulary", vocabularies), "kind list": listed("kind", kinds), "topic list": listed("topic", topics),
        "target present": (F.col("kind") != "missing") & blank("to_api"), "source present": blank("from_api"), "keywords non-empty": F.col("keywords").isNull() | (F.size("keywords") < 1),
    }
    size = rows.agg((F.count("*") == 0).cast("bigint").alias("non-empty"), (F.count("*") - F.countDistinct("entry_key")).alias("key unique"))
    whole = size.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("bad")) for n in ("non-empty", "key unique")))))
    known = F.col("link").rlike("^[^/]+/[^/]+/[^/]+")
    for s in schemes:
        known = known | F.startswith("link", F.lit(s))
    return whole.unionByName(audit(rows, checks)).unionByName(audit(links, {"link scheme": ~known}))


def cross_errors(rows: DataFrame, links: DataFrame, key: str, scheme: str) -> DataFrame:
    """``error, subject, n``: keys held by several entries, and links to entries (by scheme or bare key) that lead nowhere."""
    twice = duplicates(rows, [key]).select(F.lit("duplicate key").alias("error"), F.col(key).alias("subject"), "n")
    bare = F.when(F.startswith("link", F.lit(scheme)), F.substring("link", len(scheme) + 1, 1_000_000)).when(~F.contains("link", F.lit("://")), F.col("link"))
    targets = links.withColumn("_t", F.split_part(bare, F.lit("#"), F.lit(1))).where("_t is not null")
    lost = targets.join(rows.select(F.col(key).alias("_t")).distinct(), "_t", "left_anti").groupBy(F.col("link").alias("subject")).agg(F.count("*").alias("n"))
    return twice.unionByName(lost.select(F.lit("unresolved link").alias("error"), "subject", "n"))


def zero_width(rows: DataFrame, columns: list[str]) -> DataFrame:
    return audit(rows, {c: F.col(c).rlike(ZERO_WIDTH) for c in columns})


def nulls(rows: DataFrame, columns: list[str]) -> DataFrame:
    return audit(rows, {c: F.col(c).isNull() for c in columns})


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unique(rows: DataFrame, key: str) -> DataFrame:
    """One row: whether all values of a key differ."""
    return rows.agg((F.count("*") == F.countDistinct(key)).alias("is_unique"))


def orphans(children: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Children whose parent is missing; a null key is no reference."""
    return children.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias("_p")).distinct(), F.col(key) == F.col("_p"), "left_anti")


def off_list(rows: DataFrame, column: str, known: DataFrame, name: str) -> DataFrame:
    """Values that aren't on a list, with their counts."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).join(known.select(F.col(name).alias("_k")), F.col("value") == F.col("_k"), "left_anti")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values of one list only, with the list they are in."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def share(rows: DataFrame, by: str, condition: Column, ceiling: float) -> DataFrame:
    """``by, n, part, over``: the share of rows that satisfy a condition, per group and (null) overall."""
    out = rows.rollup(by).agg(F.count("*").alias("n"), (F.count_if(condition) / F.count("*")).alias("part"), F.grouping(by).alias("total"))
    return out.select(F.when(F.col("total") == 1, F.lit("(all)")).otherwise(F.coalesce(F.col(by).cast("string"), F.lit("(null)"))).alias(by), "n", F.round("part", 6).alias("part"), (F.col("part") > ceiling).alias("over"))


def counts_with_zeros(dimension: DataFrame, key: str, rows: DataFrame, column: str, thin: int = 10) -> DataFrame:
    """``key, n, state``: every entry of a dimension with its rows, empty and thin ones named."""
    n = rows.groupBy(F.col(column).alias(key)).agg(F.count("*").alias("n"))
    out = dimension.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    return out.withColumn("state", F.when(F.col("n") == 0, "empty").when(F.col("n") < thin, "thin").otherwise("filled"))


def coverage(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per cell of several keys."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def fold_coverage(cells: DataFrame, dimension: DataFrame, key: str, scope: Column, narrow: Column, version: str, shape: str) -> DataFrame:
    """Per entry of a dimension, zero rows kept: rows in scope, in the filter, without a version, and the versions.

    ``cells`` are what coverage gives. A cell outside the scope counts as out of scope, never twice.
    """
    shaped = F.coalesce(F.col(version).rlike(shape), F.lit(False))
    sums = cells.groupBy(key).agg(
        F.sum(F.when(scope, F.col("n")).otherwise(0)).alias("in_scope"), F.sum(F.when(scope & narrow, F.col("n")).otherwise(0)).alias("in_filter"),
        F.sum(F.when(~scope, F.col("n")).otherwise(0)).alias("out_of_scope"), F.sum(F.when(~shaped, F.col("n")).otherwise(0)).alias("unversioned"),
        F.array_sort(F.collect_set(F.when(shaped, F.col(version)))).alias("versions"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return dimension.select(key).join(sums, key, "left").select(key, *(zero(c) for c in ("in_scope", "in_filter", "out_of_scope", "unversioned")), F.coalesce("versions", F.array().cast("array<string>")).alias("versions"))


def ledger(calls: DataFrame, by: str, price_in: float, price_out: float, planned: int) -> DataFrame:
    """``by, files, tokens_in, tokens_out, cost, projected`` per value and (all): prices are per million tokens.

    Projected is what ``planned`` calls at the mean of the row would cost.
    """
    sums = calls.rollup(by).agg(F.count("*").alias("files"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.grouping(by).alias("g"))
    cost = F.col("tokens_in") / 1e6 * price_in + F.col("tokens_out") / 1e6 * price_out
    return sums.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col(by)).alias(by), "files", "tokens_in", "tokens_out", F.round(cost, 8).alias("cost"), F.round(cost / F.col("files") * planned, 3).alias("projected"))


def row_errors(rows: DataFrame, id_col: str, rules: list[tuple[Column, str]]) -> DataFrame:
    """``id, errors``: messages of the rules a row breaks, for rows that break any."""
    errors = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(m)) for c, m in rules)))
    return rows.select(id_col, errors.alias("errors")).where(F.size("errors") > 0)
