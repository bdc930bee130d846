"""Quality checks and graph queries on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import graph as G
from quern.operators import quality as Q
from quern.plans.registry import query
from quern.sources import table

_VERSION = "^[0-9]+\\.[0-9]+(\\.[0-9]+)*$"


@query("Q-01 Q-02", "SELECT 'content' AS \"check\", count(*) FILTER (WHERE regexp_matches(content, '[\\x{200B}-\\x{200D}\\x{FEFF}]')) AS bad FROM document_pages UNION ALL SELECT 'title', count(*) FILTER (WHERE regexp_matches(title, '[\\x{200B}-\\x{200D}\\x{FEFF}]')) FROM document_pages")
def zero_width_audit(spark: SparkSession, d: str) -> DataFrame:
    return Q.zero_width(table(spark, d, "document_pages"), ["content", "title"])


@query("Q-05 F22", "SELECT 'title' AS \"check\", count(*) FILTER (WHERE title IS NULL) AS bad FROM document_pages UNION ALL SELECT 'minecraft_version', count(*) FILTER (WHERE minecraft_version IS NULL) FROM document_pages UNION ALL SELECT 'raw_html', count(*) FILTER (WHERE raw_html IS NULL) FROM document_pages")
def null_audit(spark: SparkSession, d: str) -> DataFrame:
    return Q.nulls(table(spark, d, "document_pages"), ["title", "minecraft_version", "raw_html"])


@query("Q-05", f"SELECT 'null' AS \"check\", count(*) FILTER (WHERE minecraft_version IS NULL) AS bad FROM document_pages UNION ALL SELECT 'sentinel', count(*) FILTER (WHERE minecraft_version = 'unknown') FROM document_pages UNION ALL SELECT 'shape', count(*) FILTER (WHERE minecraft_version <> 'unknown' AND NOT regexp_matches(minecraft_version, '{_VERSION}')) FROM document_pages")
def version_audit(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("minecraft_version")
    return Q.audit(table(spark, d, "document_pages"), {"null": v.isNull(), "sentinel": v == "unknown", "shape": (v != "unknown") & ~v.rlike(_VERSION)})


@query("Q-03 F28 F29", "SELECT section_id FROM (SELECT DISTINCT * FROM doc_sections) WHERE length(trim(coalesce(content, ''))) < 25 AND coalesce(len(code_blocks), 0) = 0")
def short_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "doc_sections").select("section_id", "document_id", "heading", "level", "content", "code_blocks", "order_num").distinct()
    return rows.where((F.length(F.trim(F.coalesce("content", F.lit("")))) < 25) & (F.coalesce(F.size("code_blocks"), F.lit(0)) <= 0)).select("section_id")


@query("Q-04 A12", "SELECT document_id, content, count(*) AS n FROM doc_sections GROUP BY ALL HAVING count(*) > 1")
def having_dupes(spark: SparkSession, d: str) -> DataFrame:
    return Q.duplicates(table(spark, d, "doc_sections"), ["document_id", "content"])


@query("A14", "SELECT count(*) = count(DISTINCT o_orderkey) AS is_unique FROM orders")
def unique_check(spark: SparkSession, d: str) -> DataFrame:
    return Q.unique(table(spark, d, "orders"), "o_orderkey")


@query("Q-06 J21", "SELECT category AS value, count(*) AS n FROM document_pages WHERE category NOT IN ('Items', 'Blocks', 'Entities') OR category IS NULL GROUP BY category")
def enum_audit(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("Items",), ("Blocks",), ("Entities",)], "c string")
    return Q.off_list(table(spark, d, "document_pages"), "category", known, "c")


@query("Q-07 A13 A23", "SELECT CASE WHEN grouping(loader) = 1 THEN '(all)' ELSE coalesce(loader, '(null)') END AS loader, count(*) AS n, round(count(*) FILTER (WHERE category IS NULL OR category IN ('', 'unknown')) / count(*), 6)::DOUBLE AS part, count(*) FILTER (WHERE category IS NULL OR category IN ('', 'unknown')) / count(*) > 0.05 AS \"over\" FROM document_pages GROUP BY ROLLUP (loader)")
def fallback_share(spark: SparkSession, d: str) -> DataFrame:
    return Q.share(table(spark, d, "document_pages"), "loader", F.col("category").isNull() | F.col("category").isin("", "unknown"), 0.05)


@query("Q-08 J21", "SELECT id FROM doc_chunks WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT document_id FROM document_pages)")
def orphans_anti(spark: SparkSession, d: str) -> DataFrame:
    return Q.orphans(table(spark, d, "doc_chunks"), "document_id", table(spark, d, "document_pages"), "document_id").select("id")


@query("A22 Q-14", "SELECT n_name, count(c_custkey) AS n, CASE WHEN count(c_custkey) = 0 THEN 'empty' WHEN count(c_custkey) < 50 THEN 'thin' ELSE 'filled' END AS state FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 2000 GROUP BY n_name")
def thin_audit(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").select("n_name", "n_nationkey")
    rows = table(spark, d, "customer").where("c_acctbal > 2000").join(names, F.col("c_nationkey") == F.col("n_nationkey"))
    return Q.counts_with_zeros(names, "n_name", rows, "n_name", 50)


@query("Q-11", "SELECT member_id, list_filter([CASE WHEN name IS NULL OR name = '' THEN 'name' END, CASE WHEN signature IS NULL OR signature = '' THEN 'signature' END, CASE WHEN kind IS NULL OR kind NOT IN ('method', 'constructor', 'field', 'enum_constant', 'annotation_element') THEN 'kind' END], lambda x: x IS NOT NULL) AS errors FROM (SELECT DISTINCT member_id, name, signature, kind FROM api_members) WHERE name IS NULL OR name = '' OR signature IS NULL OR signature = '' OR kind IS NULL OR kind NOT IN ('method', 'constructor', 'field', 'enum_constant', 'annotation_element')", lists=('errors',))
def row_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "api_members").select("member_id", "name", "signature", "kind").distinct()
    kinds = ["method", "constructor", "field", "enum_constant", "annotation_element"]
    return Q.row_errors(rows, "member_id", [(F.col("name").isNull() | (F.col("name") == ""), "name"), (F.col("signature").isNull() | (F.col("signature") == ""), "signature"), (F.col("kind").isNull() | ~F.col("kind").isin(*kinds), "kind")])


@query("Q-10", "SELECT repo, count(*) FILTER (WHERE v IS NULL OR NOT regexp_matches(v, '^[0-9]+\\.[0-9]+')) AS bad FROM (SELECT repo, unnest(minecraft_versions) AS v FROM roster_repos) GROUP BY repo")
def array_invariants(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "roster_repos").select("repo", F.explode("minecraft_versions").alias("v"))
    return rows.groupBy("repo").agg(F.count_if(F.col("v").isNull() | ~F.col("v").rlike(r"^[0-9]+\.[0-9]+")).alias("bad"))


_TREE = "(SELECT p_partkey AS node, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1)"


@query("J14 R48", f"WITH RECURSIVE e AS {_TREE}, c(node, depth) AS (SELECT 1500::BIGINT, 0 UNION ALL SELECT e.parent, depth + 1 FROM c JOIN e ON e.node = c.node) SELECT node, depth::BIGINT AS depth FROM c")
def recursive_chain(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "part").where("p_partkey > 1").selectExpr("p_partkey as node", "p_partkey div 2 as parent")
    return G.ancestors_recursive(edges, "1500").selectExpr("cast(node as bigint) as node", "cast(depth as bigint) as depth")


@query("R49", f"WITH RECURSIVE e AS {_TREE}, c(node, ancestor) AS (SELECT node, parent FROM e UNION ALL SELECT c.node, e.parent FROM c JOIN e ON e.node = c.ancestor) SELECT ancestor, count(*) AS below FROM c GROUP BY ancestor")
def closure_count(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "part").where("p_partkey > 1").selectExpr("p_partkey as node", "p_partkey div 2 as parent")
    return G.closure(edges).groupBy("ancestor").agg(F.count("*").alias("below"))


@query("R50", f"WITH RECURSIVE e AS {_TREE}, c(node, ancestor) AS (SELECT p_partkey, p_partkey FROM part UNION ALL SELECT c.node, e.parent FROM c JOIN e ON e.node = c.ancestor) SELECT c.node, bool_or(p_size = 7) AS flag FROM c JOIN part ON p_partkey = ancestor GROUP BY c.node")
def flag_propagation(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    edges = part.where("p_partkey > 1").selectExpr("p_partkey as node", "p_partkey div 2 as parent")
    return G.inherited(edges, part.selectExpr("p_partkey as node", "p_size = 7 as flag"))


@query("R51", f"WITH RECURSIVE e AS {_TREE}, s AS (SELECT p_partkey AS scope, p_brand AS name, p_partkey AS target FROM part WHERE p_size <= 10), c(ref, place, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT ref, parent, depth + 1 FROM c JOIN e ON node = place), h AS (SELECT ref, depth, target FROM c JOIN part p ON p.p_partkey = ref JOIN s ON s.scope = c.place AND s.name = p.p_brand), m AS (SELECT ref, arg_min(target, depth) AS target FROM h GROUP BY ref) SELECT p_partkey AS ref_id, coalesce(target, 0) AS target FROM part LEFT JOIN m ON ref = p_partkey")
def fixpoint_names(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    references = part.selectExpr("p_partkey as ref_id", "p_partkey as scope", "p_brand as name")
    scopes = part.where("p_size <= 10").selectExpr("p_partkey as scope", "p_brand as name", "p_partkey as target")
    edges = part.where("p_partkey > 1").selectExpr("p_partkey as node", "p_partkey div 2 as parent")
    return G.resolve_names(references, scopes, edges).select("ref_id", F.coalesce("target", F.lit(0).cast("bigint")).alias("target"))


# ---- types named in sources ---------------------------------------------------------------------

_REFS = """t AS (SELECT type_id, fqn, simple_name, package_name, outer_fqn FROM api_types WHERE fqn IS NOT NULL AND simple_name IS NOT NULL),
r AS (SELECT a.type_id AS ref_id, CASE a.type_id % 7 WHEN 5 THEN b.fqn WHEN 6 THEN a.simple_name || '<T>' ELSE b.simple_name END AS raw, a.fqn, a.outer_fqn, a.package_name AS package,
 CASE WHEN a.type_id % 7 = 0 THEN b.fqn WHEN a.type_id % 7 = 1 THEN 'elsewhere.' || b.simple_name END AS explicit, CASE WHEN a.type_id % 7 IN (1, 2) THEN b.package_name END AS wildcard FROM t a JOIN t b ON b.type_id = a.type_id + 1)"""


def _references(types: DataFrame) -> DataFrame:
    rows = types.where("fqn is not null and simple_name is not null").select("type_id", "fqn", "simple_name", "package_name", "outer_fqn")
    b = rows.select((F.col("type_id") - 1).alias("type_id"), F.col("fqn").alias("bf"), F.col("simple_name").alias("bs"), F.col("package_name").alias("bp"))
    k = F.col("type_id") % 7
    explicit = F.when(k == 0, F.create_map("bs", "bf")).when(k == 1, F.create_map("bs", F.concat(F.lit("elsewhere."), "bs")))
    return rows.join(b, "type_id").select(
        F.col("type_id").alias("ref_id"), F.when(k == 5, F.col("bf")).when(k == 6, F.concat("simple_name", F.lit("<T>"))).otherwise(F.col("bs")).alias("raw"), F.col("package_name").alias("package"),
        F.array_compact(F.array("fqn", "outer_fqn")).alias("enclosing"), explicit.alias("explicit"), F.when(k.isin(1, 2), F.array("bp")).alias("wildcards"), F.col("fqn").alias("owner"),
    )


@query("J23", f"""WITH {_REFS}, s AS (SELECT *, regexp_replace(raw, '<.*$', '') AS name FROM r), h AS (SELECT ref_id, name, fqn AS f0, outer_fqn AS f1, package, explicit, wildcard, split_part(name, '.', 1) AS head FROM s),
c AS (SELECT ref_id, 0 AS p, name AS cand FROM h WHERE contains(name, '.') UNION ALL SELECT ref_id, 10, f0 FROM h WHERE ends_with(f0, '.' || head) AND NOT contains(name, '.') UNION ALL SELECT ref_id, 11, f0 || '.' || head FROM h WHERE NOT contains(name, '.')
 UNION ALL SELECT ref_id, 12, f1 FROM h WHERE ends_with(f1, '.' || head) AND NOT contains(name, '.') UNION ALL SELECT ref_id, 13, f1 || '.' || head FROM h WHERE NOT contains(name, '.') UNION ALL SELECT ref_id, 14, explicit FROM h WHERE NOT contains(name, '.')
 UNION ALL SELECT ref_id, 15, package || '.' || head FROM h WHERE explicit IS NULL AND NOT contains(name, '.') UNION ALL SELECT ref_id, 16, wildcard || '.' || head FROM h WHERE explicit IS NULL AND NOT contains(name, '.')),
m AS (SELECT ref_id, arg_min(cand, p) AS target FROM c JOIN (SELECT DISTINCT fqn FROM t) ON fqn = cand GROUP BY ref_id) SELECT ref_id, target FROM r LEFT JOIN m USING (ref_id)""")
def type_names(spark: SparkSession, d: str) -> DataFrame:
    """Type names through enclosing types, explicit imports, package and wildcards."""
    types = table(spark, d, "api_types")
    return G.resolve_types(_references(types), types)


# ---- invariants of a table of correspondences ---------------------------------------------------

_PAIRS = """e AS (SELECT document_id AS id, coalesce(category, '') || '/' || coalesce(loader, '') || '/' || coalesce(nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'x') AS entry_key, category AS topic, loader AS vocabulary,
 CASE WHEN title IS NULL THEN 'missing' ELSE 'direct' END AS kind, title AS from_api, url AS to_api, metadata.tags AS keywords FROM document_pages)"""


def _correspondences(spark: SparkSession, d: str) -> DataFrame:
    from quern.functions import text as T

    slug = F.coalesce(F.nullif(T.slug(F.col("title"), 100_000), F.lit("")), F.lit("x"))
    return table(spark, d, "document_pages").select(
        F.col("document_id").alias("id"), F.concat_ws("/", F.coalesce("category", F.lit("")), F.coalesce("loader", F.lit("")), slug).alias("entry_key"), F.col("category").alias("topic"), F.col("loader").alias("vocabulary"),
        F.when(F.col("title").isNull(), "missing").otherwise("direct").alias("kind"), F.col("title").alias("from_api"), F.col("url").alias("to_api"), F.col("metadata.tags").alias("keywords"),
    )


_LINKS = "l AS (SELECT id, entry_key, unnest([CASE id % 4 WHEN 0 THEN entry_key || '#part' WHEN 1 THEN 'guide://setup' WHEN 2 THEN 'a/b/none' ELSE 'bare' END, 'entry://' || entry_key]) AS link FROM e)"


def _links(rows: DataFrame) -> DataFrame:
    k = F.col("id") % 4
    odd = F.when(k == 0, F.concat("entry_key", F.lit("#part"))).when(k == 1, "guide://setup").when(k == 2, "a/b/none").otherwise("bare")
    return rows.select("id", "entry_key", F.explode(F.array(odd, F.concat(F.lit("entry://"), "entry_key"))).alias("link"))


@query("Q-10", f"""WITH {_PAIRS}, {_LINKS}, b AS (SELECT
 (count(*) = 0)::BIGINT AS "non-empty", count(*) - count(DISTINCT entry_key) AS "key unique", count(*) FILTER (WHERE NOT starts_with(entry_key, coalesce(topic, '') || '/' || coalesce(vocabulary, '') || '/')) AS "key shape",
 count(*) FILTER (WHERE vocabulary IS NULL OR vocabulary NOT IN ('forge', 'fabric', 'neoforge', 'shared')) AS "vocabulary list", count(*) FILTER (WHERE kind NOT IN ('direct', 'analog', 'missing')) AS "kind list",
 count(*) FILTER (WHERE topic IS NULL OR topic NOT IN ('rendering', 'general', 'getting-started', 'tile-entities')) AS "topic list", count(*) FILTER (WHERE kind <> 'missing' AND (to_api IS NULL OR trim(to_api) = '')) AS "target present", count(*) FILTER (WHERE from_api IS NULL OR trim(from_api) = '') AS "source present",
 count(*) FILTER (WHERE keywords IS NULL OR len(keywords) < 1) AS "keywords non-empty" FROM e), c AS (SELECT count(*) FILTER (WHERE NOT (starts_with(link, 'entry://') OR starts_with(link, 'guide://') OR regexp_matches(link, '^[^/]+/[^/]+/[^/]+'))) AS "link scheme" FROM l)
SELECT * FROM (SELECT * FROM b, c) UNPIVOT (bad FOR "check" IN (COLUMNS(*)))""")
def correspondence_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Enums, key shape, presence and link schemes of a table of correspondences, each with the rows that break it."""
    rows = _correspondences(spark, d)
    return Q.correspondence_audit(rows, _links(rows), ["forge", "fabric", "neoforge", "shared"], ["rendering", "general", "getting-started", "tile-entities"], ["direct", "analog", "missing"], ["entry://", "guide://"])


@query("Q-12", f"""WITH {_PAIRS}, {_LINKS}, t AS (SELECT entry_key, link, CASE WHEN starts_with(link, 'entry://') THEN split_part(substr(link, 9), '#', 1) WHEN NOT contains(link, '://') THEN split_part(link, '#', 1) END AS target FROM l)
SELECT 'duplicate key' AS error, entry_key AS subject, count(*) AS n FROM e GROUP BY entry_key HAVING count(*) > 1 UNION ALL SELECT 'unresolved link', link, count(*) FROM t WHERE target IS NOT NULL AND target NOT IN (SELECT entry_key FROM e) GROUP BY link""")
def cross_row_errors(spark: SparkSession, d: str) -> DataFrame:
    """Keys that occur more than once, and links of entries that lead to no entry."""
    rows = _correspondences(spark, d)
    return Q.cross_errors(rows, _links(rows), "entry_key", "entry://")


@query("Q-13", "SELECT loader, n, bad, bad > 0.25 * n AS fails FROM (SELECT coalesce(loader, '(null)') AS loader, count(*) AS n, count(*) FILTER (WHERE category IS NULL OR category IN ('', 'unknown')) AS bad FROM document_pages GROUP BY 1)")
def taxonomy_gate(spark: SparkSession, d: str) -> DataFrame:
    """What a build's gate reads: per loader the share without a category, and whether it stops the build."""
    rows = table(spark, d, "document_pages").groupBy(F.coalesce("loader", F.lit("(null)")).alias("loader")).agg(F.count("*").alias("n"), F.count_if(F.col("category").isNull() | F.col("category").isin("", "unknown")).alias("bad"))
    return rows.withColumn("fails", F.col("bad") > 0.25 * F.col("n"))
