"""Search and resolution of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.identifiers import fuzzy


def search(types: DataFrame, members: DataFrame, query: str, expansions: tuple[str, ...], limit: int, floor: float = 10.0) -> DataFrame:
    """``kind, id, name, score``: types and members by fuzzy score over the floor, ties by kind and id.

    Distinct names are scored, each once; no prior filter can lose a match.
    """
    named = types.select(F.lit("type").alias("kind"), F.col("type_id").alias("id"), F.col("simple_name").alias("name")).unionByName(members.select("kind", F.col("member_id").alias("id"), "name"))
    named = named.where("name is not null").distinct()
    # an exploded filter: a plain one would be pushed below the stages of the score and repeat them
    scored = fuzzy(named.select("name").distinct(), "name", query, expansions).select("name", F.explode(F.filter(F.array("score"), lambda v: v > floor)).alias("score"))
    return named.join(scored, "name").orderBy(F.desc("score"), "kind", "id").limit(limit).select("kind", "id", "name", "score")


def resolve(symbols: DataFrame, types: DataFrame) -> DataFrame:
    """``symbol, fqn, tier, candidates`` of every symbol.

    Tiers: the full name, the simple name in any case, the end of a full name in any case. The best tier
    with candidates decides; fqn is null where it has several, or none, and the tier of none is 0.
    """
    asked = symbols.where("symbol is not null").select("symbol").distinct()
    known = types.where("fqn is not null")
    exact = asked.join(known.select(F.col("fqn").alias("f")), F.col("symbol") == F.col("f")).select("symbol", F.col("f").alias("fqn"), F.lit(1).alias("tier"))
    simple = asked.join(known.select("fqn", F.lower("simple_name").alias("s")), F.lower("symbol") == F.col("s")).select("symbol", "fqn", F.lit(2).alias("tier"))
    # every dotted end of a full name is a key, so that the suffix search is an equality join
    parts = F.split(F.lower("fqn"), r"\.")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    keyed = known.where(F.size(parts) >= 2).select("fqn", F.explode(ends).alias("e"), F.lower("fqn").alias("low")).where(F.col("e") != F.col("low"))
    suffix = asked.where(F.contains("symbol", F.lit("."))).join(keyed, F.lower("symbol") == F.col("e")).select("symbol", "fqn", F.lit(3).alias("tier"))
    tiers = exact.unionByName(simple).unionByName(suffix).groupBy("symbol", "tier").agg(F.count("*").alias("candidates"), F.min("fqn").alias("fqn"))
    best = tiers.groupBy("symbol").agg(F.min_by(F.struct("tier", "candidates", "fqn"), "tier").alias("b"))
    return asked.join(best, "symbol", "left").select(
        "symbol", F.when(F.col("b.candidates") == 1, F.col("b.fqn")).alias("fqn"), F.coalesce(F.col("b.tier").cast("bigint"), F.lit(0).cast("bigint")).alias("tier"), F.coalesce("b.candidates", F.lit(0).cast("bigint")).alias("candidates")
    )


def ranked_types(types: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """Types whose full name holds the query: exact, prefix, inside, elsewhere; then fewer dots, then by name."""
    q = query.lower()
    simple = F.lower("simple_name")
    rank = F.when(simple == q, 0).when(F.startswith(simple, F.lit(q)), 1).when(F.contains(simple, F.lit(q)), 2).otherwise(3)
    rows = types.where(F.contains(F.lower("fqn"), F.lit(q)))
    if kind:
        rows = rows.where(F.col("kind") == kind)
    dots = F.length("fqn") - F.length(F.replace("fqn", F.lit("."), F.lit("")))
    return rows.select("type_id", "fqn", rank.cast("bigint").alias("rank"), dots.cast("bigint").alias("dots")).orderBy("rank", "dots", "fqn", "type_id")


def browse(types: DataFrame, packages: list[str], most: int) -> DataFrame:
    """The first types of each package at or below the given ones."""
    hit = F.lit(False)
    for p in packages:
        hit = hit | (F.col("package_name") == p) | F.startswith("package_name", F.lit(p + "."))
    n = F.row_number().over(Window.partitionBy("package_name").orderBy("fqn"))
    return types.where(hit).select("package_name", "fqn", n.alias("n")).where(F.col("n") <= most).drop("n")


def first_members(members: DataFrame, most: int) -> DataFrame:
    """The first members of each kind of a type, by name and id."""
    n = F.row_number().over(Window.partitionBy("type_id", "kind").orderBy("name", "member_id"))
    return members.withColumn("n", n).where(F.col("n") <= most).drop("n")
