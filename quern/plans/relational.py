"""The relational core on the star schema and the test tables: joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import graph as G
from quern.operators import quality as Q
from quern.operators import snippets as S
from quern.plans.registry import query
from quern.sources import table


@query("J03 J04 J06", "SELECT s.section_id, b.language, p.category, count(*) AS n FROM (SELECT section_id, document_id, unnest(code_blocks) AS b FROM doc_sections) s JOIN document_pages p USING (document_id) GROUP BY ALL")
def three_way_join(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "doc_sections").select("section_id", "document_id", F.explode("code_blocks").alias("b"))
    pages = table(spark, d, "document_pages").select("document_id", "category")
    return blocks.join(pages, "document_id").groupBy("section_id", F.col("b.language").alias("language"), "category").agg(F.count("*").alias("n"))


@query("J10 P01", "SELECT o_orderkey AS orderKey, c_name AS customerName, n_name AS nationName, r_name AS regionName FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 400000")
def order_context(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where("o_totalprice > 400000")
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    out = orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return out.select(F.col("o_orderkey").alias("orderKey"), F.col("c_name").alias("customerName"), F.col("n_name").alias("nationName"), F.col("r_name").alias("regionName"))


@query("J09 J07", "SELECT n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY n_name")
def left_count_zero(spark: SparkSession, d: str) -> DataFrame:
    rich = table(spark, d, "supplier").where("s_acctbal > 9000")
    return table(spark, d, "nation").join(rich, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"))


@query("F17 J19 J20", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R')")
def semi_filter(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "lineitem").where("l_quantity >= 49 and l_returnflag = 'R'").select("l_orderkey")
    return table(spark, d, "orders").join(big, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("J20 J21", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("J16 U04", "SELECT coalesce(a.name, b.name) AS name, coalesce(a.label, b.label) AS label, a.name IS NOT NULL AS first FROM (SELECT DISTINCT name, 'm' AS label FROM api_members WHERE kind = 'method' AND name IS NOT NULL) a FULL JOIN (SELECT DISTINCT name, 'f' AS label FROM api_members WHERE kind = 'field' AND name IS NOT NULL) b ON a.name = b.name")
def full_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "api_members").where("name is not null")
    side = lambda kind, label, name: rows.where(F.col("kind") == kind).select(F.col("name").alias(name), F.lit(label).alias(f"{name}_l")).distinct()
    out = side("method", "m", "a").join(side("field", "f", "b"), F.col("a") == F.col("b"), "full")
    return out.select(F.coalesce("a", "b").alias("name"), F.coalesce("a_l", "b_l").alias("label"), F.col("a").isNotNull().alias("first"))


@query("J17", """WITH m AS (SELECT DISTINCT member_id, type_id, name, signature FROM api_members WHERE kind = 'method'), c AS (SELECT type_id, name, count(*) AS n FROM m GROUP BY ALL),
r AS (SELECT m.*, n, row_number() OVER (PARTITION BY m.type_id, m.name ORDER BY length(signature) NULLS LAST, member_id) AS i FROM m JOIN c ON m.type_id = c.type_id AND m.name = c.name) SELECT type_id, name, n, member_id FROM r WHERE i = 1""")
def overload_match(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "api_members").where("kind = 'method' and name is not null and type_id is not null").select("member_id", "type_id", "name", "signature").distinct()
    first = F.min_by("member_id", F.struct(F.coalesce(F.length("signature"), F.lit(2**31 - 1)), F.col("member_id")))
    return rows.groupBy("type_id", "name").agg(F.count("*").alias("n"), first.alias("member_id"))


@query("J18", "SELECT file_id, r.license FROM (SELECT DISTINCT file_id, repo FROM source_files) f LEFT JOIN roster_repos r USING (repo)")
def enrich_missing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("file_id", "repo").distinct().join(table(spark, d, "roster_repos").select("repo", "license"), "repo", "left").select("file_id", "license")


@query("J22", "SELECT repo, v AS version FROM (SELECT repo, unnest(minecraft_versions) AS v FROM roster_repos)")
def lateral_expand(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "roster_repos").select("repo", F.explode("minecraft_versions").alias("version"))


@query("J13 W02 R55 P09", """WITH i AS (SELECT p_partkey AS id, p_brand AS owner, p_size AS place, p_type AS pattern, p_retailprice AS quality, p_partkey % 97 AS line FROM part),
p AS (SELECT a.id AS source, b.id AS target, CASE WHEN a.owner = b.owner AND a.place = b.place THEN 3 WHEN a.pattern = b.pattern THEN 2 ELSE 1 END AS priority, b.quality, abs(a.line - b.line) AS far FROM i a JOIN i b ON a.id <> b.id AND (a.owner = b.owner OR a.pattern = b.pattern)),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY priority DESC, quality DESC, far, target) AS n FROM p) SELECT source, target, priority::BIGINT AS priority, n AS place FROM r WHERE n <= 6""")
def self_join_relations(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "part").selectExpr("p_partkey as id", "p_brand as owner", "p_size as place", "p_type as pattern", "p_retailprice as quality", "p_partkey % 97 as line")
    return G.relations(items).select("source", "target", F.col("priority").cast("bigint"), F.col("place").cast("bigint"))


# ---- aggregates ---------------------------------------------------------------------------------


@query("A01 P03 A09", "SELECT (SELECT count(*) FROM api_types) AS types, (SELECT count(*) FROM api_members) AS members, (SELECT count(DISTINCT package_name) FROM api_types) AS packages, (SELECT round(avg(p_retailprice), 2) FROM part) AS price")
def scalar_stats_row(spark: SparkSession, d: str) -> DataFrame:
    types = table(spark, d, "api_types").agg(F.count("*").alias("types"), F.countDistinct("package_name").alias("packages"))
    return types.crossJoin(table(spark, d, "api_members").agg(F.count("*").alias("members"))).crossJoin(table(spark, d, "part").agg(F.round(F.avg("p_retailprice"), 2).alias("price")))


@query("A02 A05 A08", "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def group_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("A07 W07", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")
def top10_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(10)


@query("A10 F16", "SELECT count(DISTINCT o_custkey) FILTER (WHERE o_totalprice >= 200000) AS kept, count(DISTINCT o_custkey) FILTER (WHERE o_totalprice < 200000) AS suppressed FROM orders WHERE o_orderstatus = 'F'")
def count_distinct_suppressed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return rows.agg(F.countDistinct(F.when(F.col("o_totalprice") >= 200000, F.col("o_custkey"))).alias("kept"), F.countDistinct(F.when(F.col("o_totalprice") < 200000, F.col("o_custkey"))).alias("suppressed"))


@query("A11", "WITH c AS (SELECT name, count(*) AS n FROM api_members GROUP BY name) SELECT count(*) AS patterns, sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END)::BIGINT AS eligible, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)::BIGINT AS singletons FROM c")
def two_level_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "api_members").groupBy("name").agg(F.count("*").alias("n")).agg(F.count("*").alias("patterns"), F.count_if(F.col("n") >= 2).alias("eligible"), F.count_if(F.col("n") == 1).alias("singletons"))


@query("A15 R52", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY indexed_at NULLS FIRST, name NULLS FIRST) AS n FROM api_members) SELECT member_id, name FROM r WHERE n = 1")
def first_delivery(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("member_id").orderBy("indexed_at", "name"))
    return table(spark, d, "api_members").withColumn("n", n).where("n = 1").select("member_id", "name")


@query("A18 A19", "WITH c AS (SELECT url, least(word_count, 100) AS s FROM doc_chunks WHERE url IS NOT NULL) SELECT url, max(s)::BIGINT AS score FROM c GROUP BY url ORDER BY score DESC, url LIMIT 10")
def resource_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_chunks").where("url is not null").groupBy("url").agg(F.max(F.least("word_count", F.lit(100))).cast("bigint").alias("score")).orderBy(F.desc("score"), "url").limit(10)


@query("A20", "SELECT a AS annotation, count(*) AS uses FROM (SELECT unnest(annotations) AS a FROM api_types UNION ALL SELECT unnest(annotations) FROM (SELECT DISTINCT member_id, annotations FROM api_members)) WHERE a IS NOT NULL GROUP BY a")
def annotation_usage(spark: SparkSession, d: str) -> DataFrame:
    uses = table(spark, d, "api_types").select(F.explode("annotations").alias("annotation")).unionByName(table(spark, d, "api_members").select("member_id", "annotations").distinct().select(F.explode("annotations").alias("annotation")))
    return uses.where("annotation is not null").groupBy("annotation").agg(F.count("*").alias("uses"))


_LABEL = "CASE WHEN regexp_matches(name, '^(get|find|resolve)') THEN 'read' WHEN regexp_matches(name, '^(set|update|store|put)') THEN 'write' ELSE 'other' END"


@query("A21 R56", f"SELECT kind, count(*) AS n, count(DISTINCT name) AS aliases, count(DISTINCT {_LABEL}) AS canonical, count(*) FILTER (WHERE {_LABEL} <> 'other') AS labelled FROM api_members WHERE name IS NOT NULL GROUP BY kind")
def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    """What an ingest reports by kind: rows, different names, the canonical labels they fall under, and rows with one of their own."""
    label = S.first_rule(F.col("name"), [("read", "^(get|find|resolve)"), ("write", "^(set|update|store|put)")], "other")
    rows = table(spark, d, "api_members").where("name is not null").select("kind", "name", label.alias("label"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("name").alias("aliases"), F.countDistinct("label").alias("canonical"), F.count_if(F.col("label") != "other").alias("labelled"))


_LEDGER = "SELECT coalesce(repo, '(null)') AS repo, count(*) AS files, sum(ceil(length(content) / 4.0)::BIGINT + 700)::BIGINT AS tokens_in, (count(*) * 350)::BIGINT AS tokens_out FROM (SELECT DISTINCT file_id, repo, content FROM source_files WHERE content IS NOT NULL) GROUP BY 1"


@query("A24 T27", f"WITH l AS ({_LEDGER}), a AS (SELECT * FROM l UNION ALL SELECT '(all)', sum(files)::BIGINT, sum(tokens_in)::BIGINT, sum(tokens_out)::BIGINT FROM l) SELECT *, round(tokens_in / 1e6 * 0.2 + tokens_out / 1e6 * 1.25, 8)::DOUBLE AS cost, round((tokens_in / 1e6 * 0.2 + tokens_out / 1e6 * 1.25) / files * 850, 3)::DOUBLE AS projected FROM a")
def token_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and cost per repository with a row for all, and what 850 calls at each one's mean would cost."""
    # of files delivered again the digest tells; no text is shuffled
    rows = table(spark, d, "source_files").where("content is not null").select("file_id", F.coalesce("repo", F.lit("(null)")).alias("repo"), T.token_estimate(F.col("content")).alias("t"), F.sha2("content", 256).alias("h")).distinct()
    return Q.ledger(rows.select("repo", (F.col("t") + 700).alias("tokens_in"), F.lit(350).cast("bigint").alias("tokens_out")), "repo", 0.2, 1.25, 850)


@query("A03", "SELECT loader, category, minecraft_version, count(*) AS n FROM document_pages GROUP BY ALL")
def coverage_cells(spark: SparkSession, d: str) -> DataFrame:
    return Q.coverage(table(spark, d, "document_pages"), ["loader", "category", "minecraft_version"])


@query("A04 R61", """WITH dim AS (SELECT DISTINCT category FROM document_pages WHERE category IS NOT NULL UNION SELECT 'never used'), c AS (SELECT loader, category, minecraft_version v, count(*) n FROM document_pages GROUP BY ALL),
x AS (SELECT *, coalesce(regexp_matches(v, '^[0-9]+\\.[0-9]+(\\.[0-9]+)*$'), false) AS shaped, coalesce(loader = 'forge', false) AS s, coalesce(v = '1.12.2' OR starts_with(v, '1.12.'), false) AS f FROM c)
SELECT dim.category, coalesce(sum(n) FILTER (WHERE s), 0)::BIGINT AS in_scope, coalesce(sum(n) FILTER (WHERE s AND f), 0)::BIGINT AS in_filter, coalesce(sum(n) FILTER (WHERE NOT s), 0)::BIGINT AS out_of_scope, coalesce(sum(n) FILTER (WHERE NOT shaped), 0)::BIGINT AS unversioned, coalesce(list_sort(list_distinct(list(v) FILTER (WHERE shaped))), []) AS versions
FROM dim LEFT JOIN x ON x.category = dim.category GROUP BY dim.category""", lists=('versions',))
def coverage_fold(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "document_pages")
    dimension = pages.select("category").where("category is not null").distinct().union(spark.sql("select 'never used'"))
    v = F.col("minecraft_version")
    narrow = F.coalesce((v == "1.12.2") | F.startswith(v, F.lit("1.12.")), F.lit(False))
    scope = F.coalesce(F.col("loader") == "forge", F.lit(False))
    return Q.fold_coverage(Q.coverage(pages, ["loader", "category", "minecraft_version"]), dimension, "category", scope, narrow, "minecraft_version", r"^[0-9]+\.[0-9]+(\.[0-9]+)*$")


@query("A03", "SELECT coalesce(loader, '?') AS loader, coalesce(category, '?') AS category, grouping(loader)::BIGINT AS gl, grouping(category)::BIGINT AS gc, count(*) AS n FROM document_pages GROUP BY CUBE (loader, category)")
def coverage_cube(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "document_pages").cube("loader", "category").agg(F.count("*").alias("n"), F.grouping("loader").cast("bigint").alias("gl"), F.grouping("category").cast("bigint").alias("gc"))
    return out.select(F.coalesce("loader", F.lit("?")).alias("loader"), F.coalesce("category", F.lit("?")).alias("category"), "gl", "gc", "n")


# ---- windows, sorts, sets, plain filters --------------------------------------------------------


@query("W09", "SELECT vec_id, label::BIGINT AS label FROM embeddings ORDER BY vec_id LIMIT 100 OFFSET 100")
def paging(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("bigint")).orderBy("vec_id").offset(100).limit(100)


@query("W11 W08", "WITH c AS (SELECT p_partkey, p_name, p_retailprice FROM part WHERE contains(p_name, 'steel') ORDER BY p_partkey LIMIT 60) SELECT p_partkey, p_retailprice FROM c ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def overfetch_rerank(spark: SparkSession, d: str) -> DataFrame:
    cut = table(spark, d, "part").where(F.contains("p_name", F.lit("steel"))).orderBy("p_partkey").limit(60)
    return cut.orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).select("p_partkey", "p_retailprice")


@query("G07", "WITH o AS (SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS spent FROM orders) SELECT o_orderkey FROM o WHERE spent <= 300000")
def budget_gate(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_orderkey", F.sum("o_totalprice").over(w).alias("spent")).where("spent <= 300000").select("o_orderkey")


@query("U01 U02 U03 U05", "(SELECT n_name AS name, 'left' AS side FROM nation WHERE n_nationkey < 15 EXCEPT ALL SELECT n_name, 'left' FROM nation WHERE n_nationkey > 5) UNION ALL (SELECT n_name, 'right' FROM nation WHERE n_nationkey > 5 EXCEPT ALL SELECT n_name, 'right' FROM nation WHERE n_nationkey < 15)")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    return Q.set_difference(nations.where("n_nationkey < 15").select("name"), nations.where("n_nationkey > 5").select("name"))


@query("F05 F06 F07 F12 F13 F21", "SELECT id FROM doc_chunks WHERE has_code AND lower(code_language) = 'java' AND contains(content, 'world.notify') AND document_id = 1")
def code_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "doc_chunks").where(F.col("has_code") & (F.lower("code_language") == "java") & F.contains("content", F.lit("world.notify")) & (F.col("document_id") == 1))
    return rows.select("id")


@query("F14 F22", "SELECT repo FROM roster_repos WHERE list_contains(minecraft_versions, '1.12.2') AND license IS NOT NULL AND license <> ''")
def array_member(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "roster_repos").where(F.array_contains("minecraft_versions", "1.12.2") & F.col("license").isNotNull() & (F.col("license") != "")).select("repo")


@query("F15 R56", """WITH a(label, canonical) AS (VALUES ('n/a', 'none'), ('other', 'none'), ('mit licence', 'mit'), ('mit license', 'mit')) SELECT repo, coalesce(canonical, lower(trim(license))) AS label FROM roster_repos LEFT JOIN a ON a.label = lower(trim(license))""")
def alias_label(spark: SparkSession, d: str) -> DataFrame:
    alias = spark.createDataFrame([("n/a", "none"), ("other", "none"), ("mit licence", "mit"), ("mit license", "mit")], "a string, canonical string")
    rows = table(spark, d, "roster_repos").select("repo", F.lower(F.trim("license")).alias("l"))
    return rows.join(F.broadcast(alias), F.col("l") == F.col("a"), "left").select("repo", F.coalesce("canonical", "l").alias("label"))


@query("P08 P11 P12", "SELECT file_id, coalesce(repo, 'unknown') || '/' || path || '#L1-L' || (1 + length(content) - length(replace(content, chr(10), ''))) AS anchor FROM source_files WHERE content IS NOT NULL AND path IS NOT NULL")
def provenance(spark: SparkSession, d: str) -> DataFrame:
    lines = 1 + F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    rows = table(spark, d, "source_files").where("content is not null and path is not null")
    return rows.select("file_id", F.concat(F.coalesce("repo", F.lit("unknown")), F.lit("/"), F.col("path"), F.lit("#L1-L"), lines.cast("string")).alias("anchor"))


@query("P10", "SELECT document_id, list(section_id ORDER BY order_num NULLS FIRST, section_id) AS sections FROM (SELECT DISTINCT document_id, section_id, order_num FROM doc_sections) GROUP BY document_id", lists=('sections',))
def nested_children(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "doc_sections").select("document_id", "section_id", "order_num").distinct()
    return rows.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("order_num", F.lit(-(2**31))), "section_id"))), lambda s: s["section_id"]).alias("sections"))


# ---- classic reports ----------------------------------------------------------------------------


@query("A02", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order")
    )


@query("J02", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def nation_revenue(spark: SparkSession, d: str) -> DataFrame:
    # lines are summed per supplier before the join, so that one row per supplier is joined
    by = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    out = by.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return out.groupBy("n_name").agg(F.round(F.sum("revenue"), 1).alias("revenue"))
