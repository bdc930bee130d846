"""Hierarchies and relations: ancestors, closure, inherited flags, resolution to a fixpoint, ranked relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import checkpoint

DEPTH = 30


def closure(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """``node, ancestor, distance`` along edges of ``node, parent``, the shortest way each; up to ``depth`` if one is given.

    Known pairs of the longest distance are joined with all pairs in every round, so distances double, a
    chain of length n takes log n joins, and a join gives little but new pairs. A pair already known is
    never produced again, which ends cycles. Lineage is cut in every round.
    """
    pairs = checkpoint(edges.where("node is not null and parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct())
    reach = 1
    while depth is None or reach < depth:
        ends = pairs.where(F.col("distance") == reach).select("node", F.col("ancestor").alias("middle"))
        onward = pairs.select(F.col("node").alias("middle"), "ancestor", F.col("distance").alias("d"))
        further = ends.join(onward, "middle").select("node", "ancestor", (F.col("d") + reach).alias("distance"))
        if depth is not None:
            further = further.where(F.col("distance") <= depth)
        new = checkpoint(further.groupBy("node", "ancestor").agg(F.min("distance").alias("distance")).join(pairs.select("node", "ancestor"), ["node", "ancestor"], "left_anti"))
        if new.isEmpty():
            break
        pairs, reach = pairs.unionByName(new), reach * 2
    return pairs


def ancestors_recursive(edges: DataFrame, root: str, depth: int = DEPTH) -> DataFrame:
    """``node, depth``: the chain above one node, by a recursive common table expression."""
    edges.where("node is not null and parent is not null").select(F.col("node").cast("string"), F.col("parent").cast("string")).createOrReplaceTempView("quern_edges")
    return edges.sparkSession.sql(
        f"""WITH RECURSIVE chain(node, depth) AS (SELECT :root, 0 UNION ALL SELECT e.parent, c.depth + 1 FROM chain c JOIN quern_edges e ON e.node = c.node WHERE c.depth < {int(depth)})
        SELECT node, min(depth) AS depth FROM chain GROUP BY node""",
        args={"root": root},
    )


def inherited(edges: DataFrame, flags: DataFrame) -> DataFrame:
    """``node, flag``: whether a node or anything above it carries a flag; flags are ``node, flag``.

    Flags go down the edges from those that carry one: a round joins only nodes just reached with their
    children, and no pairs of nodes and ancestors are made. A node reached is never taken again, which
    ends cycles.
    """
    reached = fresh = checkpoint(flags.where("flag").select("node").distinct())
    down = edges.where("node is not null and parent is not null").select(F.col("parent").alias("at"), "node")
    while not fresh.isEmpty():
        fresh = checkpoint(fresh.select(F.col("node").alias("at")).join(down, "at").select("node").distinct().join(reached, "node", "left_anti"))
        reached = reached.unionByName(fresh)
    return flags.select("node").distinct().join(reached.withColumn("flag", F.lit(True)), "node", "left").select("node", F.coalesce("flag", F.lit(False)).alias("flag"))


def resolve_names(references: DataFrame, scopes: DataFrame, parents: DataFrame) -> DataFrame:
    """``ref_id, target``: names resolved in their own scope, else in the nearest scope above.

    ``references`` has ref_id, scope, name; ``scopes`` has scope, name, target; ``parents`` has node and
    parent. Each round moves what is open one scope up; it ends when nothing is open. A scope that a
    reference has been in is not entered again, which ends cycles.
    """
    open_ = references.select("ref_id", F.col("scope").alias("at"), "name")
    been = open_.select("ref_id", "at")
    done = None
    while True:
        hit = open_.join(scopes, (open_["at"] == scopes["scope"]) & (open_["name"] == scopes["name"])).select("ref_id", "target")
        hit = hit.groupBy("ref_id").agg(F.min("target").alias("target"))
        done = hit if done is None else done.unionByName(hit)
        open_ = checkpoint(open_.join(hit, "ref_id", "left_anti").join(parents, F.col("at") == F.col("node")).select("ref_id", F.col("parent").alias("at"), "name").where("at is not null").distinct().join(been, ["ref_id", "at"], "left_anti"))
        if open_.isEmpty():
            break
        been = been.unionByName(open_.select("ref_id", "at"))
    return references.select("ref_id").join(done, "ref_id", "left")


def resolve_types(references: DataFrame, known: DataFrame) -> DataFrame:
    """``ref_id, target``: written type names resolved to full names as a compiler would; null where that fails.

    ``references`` has ref_id, raw, package, enclosing (full names, innermost first), explicit (a map of
    simple to full names) and wildcards (packages); ``known`` has fqn. A simple name, or the head of a
    qualified one, is looked up in order: an enclosing type itself, then its nested types, outwards; an explicit
    import, which ends the search even if it leads outside; the package; the wildcards. A qualified name that
    is a full name stands for itself. Names with other signs than a name has resolve to nothing.

    Every possible place is a candidate with its priority, and all meet the known names in one equality join.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("raw", "<[^<>]*>", ""), "<[^<>]*>", ""), "<.*$", ""))
    rows = references.withColumn("_name", bare).where(F.col("_name").rlike("^[A-Za-z0-9_.$]+$"))
    rows = rows.withColumns({"_head": F.split_part("_name", F.lit("."), F.lit(1)), "_tail": F.regexp_replace("_name", r"^[^.]*", "")})
    enclosing, wildcards = F.coalesce("enclosing", F.array().cast("array<string>")), F.coalesce("wildcards", F.array().cast("array<string>"))
    imported = F.element_at("explicit", F.col("_head"))
    step = lambda place, name: F.struct(place.cast("int").alias("priority"), name.alias("fqn"))
    own = F.transform(enclosing, lambda e, i: step(i * 2, F.when((e == F.col("_head")) | F.endswith(e, F.concat(F.lit("."), "_head")), e)))
    nested = F.transform(enclosing, lambda e, i: step(i * 2 + 1, F.concat(e, F.lit("."), "_head")))
    far = F.array(step(F.lit(1_000_001), F.concat("package", F.lit("."), "_head")))
    open_ = F.transform(wildcards, lambda w, i: step(F.lit(1_000_002) + i, F.concat(w, F.lit("."), "_head")))
    options = F.concat(own, nested, F.when(imported.isNotNull(), F.array(step(F.lit(1_000_000), imported))).otherwise(F.concat(far, open_)))
    names = known.select("fqn").where("fqn is not null").distinct()
    heads = rows.select("ref_id", "_tail", F.inline(options)).where("fqn is not null").join(names, "fqn").groupBy("ref_id", "_tail").agg(F.min_by("fqn", "priority").alias("head"))
    by_head = heads.select("ref_id", F.concat("head", "_tail").alias("fqn"), F.lit(1).alias("way"))
    whole = rows.where(F.contains("_name", F.lit("."))).select("ref_id", F.col("_name").alias("fqn"), F.lit(0).alias("way"))
    found = whole.unionByName(by_head).join(names, "fqn").groupBy("ref_id").agg(F.min_by("fqn", "way").alias("target"))
    return references.select("ref_id").join(found, "ref_id", "left")


def resolve_supertypes(references: DataFrame, known: DataFrame) -> DataFrame:
    """``ref_id, owner, target``: types named as supertypes, member types inherited by enclosing types included.

    ``references`` are those of resolve_types with ``owner``, the full name of the type that names them. What is
    still open as a simple name is looked up among the member types of all ancestors of the enclosing types, the
    nearest enclosing type and then the nearest ancestor first. A link found makes further ancestors, so rounds
    go on until none finds anything.
    """
    found = checkpoint(references.join(resolve_types(references, known), "ref_id").select("ref_id", "owner", "raw", "enclosing", "target"))
    simple = F.regexp_extract(F.trim("raw"), r"^([A-Za-z0-9_$]+)(?:<.*)?$", 1)
    names = known.select("fqn").where("fqn is not null").distinct()
    while True:
        above = closure(found.where("target is not null").select(F.col("owner").alias("node"), F.col("target").alias("parent")))
        waiting = found.where("target is null").withColumn("name", simple).where("name <> '' and size(enclosing) > 1")
        outer = waiting.select("ref_id", "name", F.posexplode(F.slice("enclosing", 2, 1_000)).alias("level", "node"))
        options = outer.join(above, "node").select("ref_id", "level", "distance", "ancestor", F.concat("ancestor", F.lit("."), "name").alias("fqn")).join(names, "fqn")
        new = checkpoint(options.groupBy("ref_id").agg(F.min_by("fqn", F.struct("level", "distance", "ancestor")).alias("more")))
        if new.isEmpty():
            return found.select("ref_id", "owner", "target")
        found = checkpoint(found.join(new, "ref_id", "left").withColumn("target", F.coalesce("target", "more")).drop("more"))


def relations(items: DataFrame, most: int = 6) -> DataFrame:
    """``source, target, priority, strength``: the best ``most`` related items of each.

    ``items`` has id, owner, place, pattern, quality, line. The disjunction (same owner and place, same
    pattern, same owner) is three equality joins, each within a window of the best ``most`` + 1 of its
    group, which is exact: all members of a group rank the others alike but for line distance, so ties of
    quality are kept whole.
    """
    parts = []
    for priority, strength, keys in ((3, 0.95, ["owner", "place"]), (2, 0.85, ["pattern"]), (1, 0.65, ["owner"])):
        rank = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("quality")))
        usable = items.where(" and ".join(f"{k} is not null" for k in keys))
        targets = usable.withColumn("_r", rank).where(F.col("_r") <= most + 1).select(*keys, F.col("id").alias("target"), F.col("quality").alias("tq"), F.col("line").alias("tl"))
        joined = usable.join(targets, keys).where("id <> target")
        parts.append(joined.select(F.col("id").alias("source"), "target", F.lit(priority).alias("priority"), F.lit(strength).alias("strength"), "tq", F.abs(F.col("line") - F.col("tl")).alias("far")))
    pairs = parts[0].unionByName(parts[1]).unionByName(parts[2])
    best = pairs.groupBy("source", "target").agg(F.max_by(F.struct("priority", "strength", "tq", "far"), "priority").alias("b")).select("source", "target", "b.*")
    n = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("priority"), F.desc("tq"), F.asc("far"), F.asc("target")))
    return best.withColumn("place", n).where(F.col("place") <= most).select("source", "target", "priority", "strength", "place")
