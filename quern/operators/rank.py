"""Ranking: additive scores with reasons, winners of groups, caps, bands, quotas and fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def additive(fields: dict[str, Column], query: str, words: list[str], weights: dict[str, float], phrase: dict[str, float] | None = None, common: frozenset[str] = frozenset(), extra: list[tuple[Column, float, str]] = ()) -> tuple[Column, Column]:
    """Score and reasons: points for the phrase and for each word in each field, a tenth for common words.

    ``fields`` maps names to columns, ``weights`` and ``phrase`` give the points of a word and of the whole
    query by field, ``extra`` are further conditions with their points and reasons.
    """
    score = F.lit(0.0)
    reasons: list[Column] = []

    def add(condition: Column, points: float, reason: str) -> None:
        nonlocal score
        condition = F.coalesce(condition, F.lit(False))
        score = score + F.when(condition, points).otherwise(0.0)
        reasons.append(F.when(condition, F.lit(reason)))

    for name, points in (phrase or {}).items():
        add(F.contains(F.lower(fields[name]), F.lit(query.lower())), points, f"phrase in {name}")
    for word in words:
        for name, points in weights.items():
            add(F.contains(F.lower(fields[name]), F.lit(word)), points * (0.1 if word in common else 1), f"{word} in {name}")
    for condition, points, reason in extra:
        add(condition, points, reason)
    return score, F.array_compact(F.array(*reasons))


def best_of_group(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def max_per_group(rows: DataFrame, by: str, score: str, keep: list[str], order: list[Column]) -> DataFrame:
    """The highest score of each group with the columns of its first row; partial aggregation, no window."""
    first = F.min_by(F.struct(*keep), F.struct(*order)).alias("_first")
    out = rows.groupBy(by).agg(F.max(score).alias(score), F.count("*").alias("hits"), first)
    return out.select(by, score, "hits", *(F.col(f"_first.{k}").alias(k) for k in keep))


def capped(rows: DataFrame, item: str, owner: str, score: str, key: str, cap: int, limit: int, floor: float = 0.0) -> DataFrame:
    """The best ``limit`` rows with at most ``cap`` of an owner, filled up with what the cap left over.

    Rows under ``floor`` and further rows of the same ``key`` are dropped. Rows of the filling are flagged
    ``overflow``; a null owner is never capped. Ties go by ``item``.
    """
    order = [F.col(score).desc(), F.col(item)]
    once = best_of_group(rows.where(F.col(score) >= floor), [key], order)
    # a row without an owner is an owner of its own: such rows don't meet in one task
    whose = F.coalesce(F.col(owner).cast("string"), F.concat(F.lit("\x00"), F.col(item).cast("string")))
    nth = F.row_number().over(Window.partitionBy(whose).orderBy(*order))
    marked = once.withColumn("overflow", F.col(owner).isNotNull() & (nth > cap))
    return marked.orderBy("overflow", *order).limit(limit)


def bands(rows: DataFrame, relevance: str, then: list[Column], limit: int, share: float = 0.02, least: float = 0.05) -> DataFrame:
    """Rows ordered by bands of relevance (lower is better), then by other columns; the best ``limit``."""
    best = rows.agg(F.min(relevance).alias("_best"))
    width = F.greatest(F.abs(F.col("_best")) * share, F.lit(least))
    out = rows.join(F.broadcast(best)).withColumn("band", F.floor((F.col(relevance) - F.col("_best")) / width)).drop("_best")
    return out.orderBy("band", *then).limit(limit)


def quota_merge(first: DataFrame, second: DataFrame, order: list[str], limit: int) -> DataFrame:
    """Two ranked lists merged: two thirds (rounded up) of the first, the rest of the second, unused places passed on."""
    share = -(-limit * 2 // 3)
    a, b = first.orderBy(*order).limit(limit), second.orderBy(*order).limit(limit)
    number = lambda df, k: df.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(k)).orderBy(*order))).withColumn("list", F.lit(k))
    both = number(a, 1).unionByName(number(b, 2))
    counts = both.agg(F.count_if(F.col("list") == 1).alias("_a"), F.count_if(F.col("list") == 2).alias("_b"))
    room_a = F.greatest(F.lit(share), limit - F.least(F.col("_b"), F.lit(limit - share)))
    taken_a = F.least(F.col("_a"), room_a)
    return both.join(F.broadcast(counts)).where(((F.col("list") == 1) & (F.col("_n") <= room_a)) | ((F.col("list") == 2) & (F.col("_n") <= limit - taken_a))).drop("_a", "_b")


def interleave(rows: DataFrame, of: str, order: list[Column], limit: int) -> DataFrame:
    """Ranked lists taken in turns: all first places, then all second ones."""
    out = rows.withColumn("turn", F.row_number().over(Window.partitionBy(of).orderBy(*order)))
    return out.orderBy("turn", of).limit(limit)


def reciprocal(lists: list[DataFrame], item: str, rank: str = "rank", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: one over k plus rank, summed over the lists."""
    out = None
    for one in lists:
        part = one.select(F.col(item), (1.0 / (k + F.col(rank))).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(item).agg(F.sum("part").alias("score"), F.count("*").alias("lists"))


def weighted(first: DataFrame, second: DataFrame, item: str, score: str, share: float = 0.5) -> DataFrame:
    """Two scores brought to 0 to 1 within their lists and added by weight; a missing one counts 0."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        ends = df.agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
        value = F.when(F.col("_high") > F.col("_low"), (F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(1.0)
        return df.join(F.broadcast(ends)).select(item, value.alias(name))

    both = scaled(first, "_a").join(scaled(second, "_b"), item, "full")
    return both.select(item, (share * F.coalesce("_a", F.lit(0.0)) + (1 - share) * F.coalesce("_b", F.lit(0.0))).alias("score"))


def public_score(score: Column, most: float = 200.0) -> Column:
    """A score on the scale of 0 to 100 with one decimal."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score / most * 100)), 1)
