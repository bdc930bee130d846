"""Queries over names, versions and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import descriptors as D
from quern.functions import identifiers as N
from quern.functions import urls as U
from quern.functions import versions as V
from quern.operators import rank as R
from quern.operators import symbols as S
from quern.plans.registry import query
from quern.sources import table

_CAMEL = "list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[_\\-\\s]+', ' ', 'g')), ' '), lambda x: x <> '')"


@query("R36 T13 R37", f"SELECT DISTINCT name, {_CAMEL.format('name')} AS words FROM api_members WHERE name IS NOT NULL", lists=('words',))
def name_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "api_members").where("name is not null").select("name", N.words_of(F.col("name")).alias("words")).distinct()


@query("R39 F26", "SELECT DISTINCT p_name, levenshtein(p_name, 'small ring')::BIGINT AS distance, round(1 - levenshtein(p_name, 'small ring') / greatest(length(p_name), 10), 4)::DOUBLE AS similarity FROM part ORDER BY distance, p_name LIMIT 40")
def lev_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_name").distinct()
    q = F.lit("small ring")
    out = rows.select("p_name", F.levenshtein("p_name", q).cast("bigint").alias("distance"), F.round(N.similarity(F.col("p_name"), q), 4).alias("similarity"))
    return out.orderBy("distance", "p_name").limit(40)


@query("R42 T24 T25", """SELECT DISTINCT simple_name AS symbol, CASE WHEN regexp_matches(simple_name, '^[A-Z][A-Za-z0-9_]*$') THEN 'type' WHEN regexp_matches(simple_name, '^[a-z_][A-Za-z0-9_]*$') THEN 'name' ELSE 'text' END AS kind FROM api_types WHERE simple_name IS NOT NULL
UNION SELECT fqn, CASE WHEN regexp_matches(fqn, '^[a-z_][A-Za-z0-9_]*(\\.[a-z_][A-Za-z0-9_]*)+\\.[A-Z][A-Za-z0-9_$]*$') THEN 'qualified_type' WHEN regexp_matches(fqn, '^[A-Z][A-Za-z0-9_$]*[#.][a-z_][A-Za-z0-9_]*$') THEN 'member' WHEN regexp_matches(fqn, '^[A-Z][A-Za-z0-9_]*$') THEN 'type' WHEN regexp_matches(fqn, '^[a-z_][A-Za-z0-9_]*$') THEN 'name' ELSE 'text' END FROM api_types WHERE fqn IS NOT NULL""")
def kind_classify(spark: SparkSession, d: str) -> DataFrame:
    types = table(spark, d, "api_types")
    symbols = types.select(F.col("simple_name").alias("symbol")).union(types.select("fqn")).where("symbol is not null").distinct()
    return symbols.select("symbol", N.kind(F.col("symbol")).alias("kind"))


@query("R38 R04", f"""WITH w AS (SELECT type_id, unnest({_CAMEL.format('simple_name')}) AS word FROM api_types), a(short, long) AS (VALUES ('config', 'configuration'), ('gui', 'screen'), ('cmd', 'command'), ('proxy', 'delegate')),
u AS (SELECT type_id, word, true AS base FROM w UNION ALL SELECT type_id, long, false FROM w JOIN a ON word = short) SELECT type_id, word, bool_or(base) AS base FROM u GROUP BY type_id, word""")
def abbrev_expand(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "api_types").select("type_id", F.explode(N.words_of(F.col("simple_name"))).alias("w"))
    short = spark.createDataFrame([("config", "configuration"), ("gui", "screen"), ("cmd", "command"), ("proxy", "delegate")], "short string, long string")
    return N.expand(words, F.broadcast(short), "type_id", "w")


def _close(w: str) -> str:
    n = len(w)
    alike = f"(1 - levenshtein(t, '{w}') / greatest(length(t), {n})::DOUBLE)"
    floor = f"CASE WHEN least(length(t), {n}) >= 6 THEN 0.65 WHEN least(length(t), {n}) >= 4 THEN 0.7 ELSE 0.75 END"
    return f"""coalesce(list_max(list_transform(own, lambda t: CASE WHEN t = '{w}' THEN 1.0::DOUBLE WHEN starts_with(t, '{w}') THEN greatest(0.75::DOUBLE, 0.9::DOUBLE - 0.02::DOUBLE * abs(length(t) - {n})) WHEN length(t) >= 3 AND starts_with('{w}', t) THEN greatest(0.65::DOUBLE, 0.8::DOUBLE - 0.03::DOUBLE * abs(length(t) - {n}))
WHEN {n} >= 3 AND contains(t, '{w}') THEN 0.7::DOUBLE WHEN length(t) >= 3 AND contains('{w}', t) THEN 0.6::DOUBLE WHEN {alike} >= {floor} THEN 0.7::DOUBLE * {alike} ELSE 0.0::DOUBLE END)), 0.0)"""


def _fuzzy_sql(q: str, base: list[str], more: list[str]) -> str:
    """The score of every name by the rules of the survey, in SQL."""
    whole, n = q.replace(" ", ""), len(base) + len(more)
    at = [f"p[{i + 1}]" for i in range(n)]
    count = lambda low, high, op=">=": "(" + " + ".join(f"({p} {op} {low} AND {p} < {high})::INT" for p in at) + ")"
    return f"""WITH n AS (SELECT DISTINCT name FROM (SELECT simple_name AS name FROM api_types UNION ALL SELECT name FROM api_members) WHERE name IS NOT NULL),
a AS (SELECT name, lower(name) AS low, length(name) AS size, {_CAMEL.format('name')} AS own, 1 - levenshtein(lower(name), '{whole}') / greatest(length(name), {len(whole)})::DOUBLE AS alike FROM n),
b AS (SELECT *, [{', '.join(_close(w) for w in [*base, *more])}] AS p FROM a),
c AS (SELECT *, {count(0.95, 2)} AS exact, {count(0.75, 0.95)} AS pre, {count(0.55, 0.75)} AS part, {count(0.3, 0.55, '>')} AS loose, {' + '.join([*at[:len(base)], *(f'{p} * 0.6::DOUBLE' for p in at[len(base):])])} AS total FROM b),
d AS (SELECT *, CASE WHEN exact = {len(base)} OR exact + pre >= 0.8 * {len(base)} THEN 75 + 15 * total / {n} + CASE WHEN contains(low, '{''.join(base)}') THEN 5 ELSE 0 END + CASE WHEN own[1] = '{base[0]}' THEN 10 ELSE 0 END WHEN exact + pre >= 0.7 * {len(base)} THEN 55 + 20 * total / {n}
 WHEN exact + pre + part >= 0.5 * {len(base)} THEN 40 + 20 * total / {n} WHEN loose > 0 OR total > 0.3 THEN 20 + 30 * total / {n} ELSE 0 END AS words FROM c),
e AS (SELECT *, CASE WHEN words <> 0 THEN words + CASE WHEN size < 15 THEN 5 WHEN size > 40 THEN -5 ELSE 0 END ELSE 0 END AS tall FROM d),
f AS (SELECT name, greatest(0, least(100, round(CASE WHEN low = '{whole}' THEN 100 WHEN starts_with(low, '{whole}') THEN least(95, 85 + greatest(0, 10 - (size - {len(q)}))) WHEN alike >= 0.75 THEN least(90, round(50 + 40 * alike)) WHEN contains(low, '{whole}') THEN greatest(tall, 55 + 20 * {len(whole)} / size::DOUBLE) ELSE tall END
 - CASE WHEN starts_with(name, '_') OR starts_with(name, 'lambda$') OR starts_with(name, 'access$') OR contains(substr(name, 2), '$') THEN 25 ELSE 0 END)))::DOUBLE AS score FROM e WHERE size > 0)"""


_NAMED = "SELECT DISTINCT 'type' AS kind, type_id AS id, simple_name AS name FROM api_types UNION SELECT DISTINCT kind, member_id, name FROM api_members"


@query("R35 R40", _fuzzy_sql("registry handler", ["registry", "handler"], ["reg"]) + f" SELECT kind, id, name, score FROM ({_NAMED}) JOIN f USING (name) WHERE score > 10 ORDER BY score DESC, kind, id LIMIT 25")
def fuzzy_search(spark: SparkSession, d: str) -> DataFrame:
    return S.search(table(spark, d, "api_types"), table(spark, d, "api_members"), "registry handler", ("reg",), 25)


@query("R35", _fuzzy_sql("tank fluid", ["tank", "fluid"], ["vessel"]) + " SELECT name, score FROM f")
def fuzzy_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every name there is."""
    names = table(spark, d, "api_types").select(F.col("simple_name").alias("name")).union(table(spark, d, "api_members").select("name")).where("length(name) > 0").distinct()
    return N.fuzzy(names, "name", "tank fluid", ("vessel",)).select("name", "score")


@query("R41 F09", "SELECT DISTINCT member_id, name FROM api_members WHERE starts_with(lower(name), 'parse')")
def prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "api_members").where(F.startswith(F.lower("name"), F.lit("parse")))
    return rows.select("member_id", "name").distinct()


_LOOK = "api_types"


@query("R43 R44 R47 F20", """WITH s(symbol) AS (SELECT simple_name FROM api_types UNION SELECT lower(simple_name) FROM api_types UNION SELECT fqn FROM api_types UNION SELECT 'NoSuchType'),
c AS (SELECT symbol, fqn, 1 AS tier FROM s JOIN api_types ON fqn = symbol UNION ALL SELECT symbol, fqn, 2 FROM s JOIN api_types ON lower(simple_name) = lower(symbol) UNION ALL SELECT symbol, fqn, 3 FROM s JOIN api_types ON ends_with(lower(fqn), '.' || lower(symbol)) AND contains(symbol, '.')),
n AS (SELECT symbol, tier, count(*) AS k, min(fqn) AS fqn FROM c WHERE symbol IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY tier) AS i FROM n)
SELECT s.symbol, CASE WHEN k = 1 THEN r.fqn END AS fqn, coalesce(tier, 0)::BIGINT AS tier, coalesce(k, 0) AS candidates FROM s LEFT JOIN r ON r.symbol = s.symbol AND i = 1 WHERE s.symbol IS NOT NULL""")
def resolve_cascade(spark: SparkSession, d: str) -> DataFrame:
    types = table(spark, d, "api_types")
    symbols = types.selectExpr("simple_name as symbol").union(types.selectExpr("lower(simple_name)")).union(types.select("fqn")).union(spark.sql("select 'NoSuchType'")).distinct()
    return S.resolve(symbols, types)


@query("P04", "SELECT DISTINCT member_id, name, count(*) OVER (PARTITION BY name) AS owners FROM (SELECT DISTINCT member_id, name FROM api_members WHERE kind = 'method')")
def owner_count(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "api_members").where("kind = 'method'").select("member_id", "name").distinct()
    counts = rows.groupBy(F.col("name").alias("n")).agg(F.count("*").alias("owners"))
    return rows.join(counts, F.col("name").eqNullSafe(F.col("n"))).select("member_id", "name", "owners")


@query("P02 R45 R54", "SELECT t.type_id, count(m.member_id) FILTER (WHERE m.kind = 'method') AS methods, count(m.member_id) FILTER (WHERE m.kind = 'field') AS fields FROM api_types t LEFT JOIN (SELECT DISTINCT member_id, type_id, kind FROM api_members) m USING (type_id) GROUP BY t.type_id")
def member_counts(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "api_members").select("member_id", "type_id", "kind").distinct().groupBy("type_id").agg(F.count_if(F.col("kind") == "method").alias("methods"), F.count_if(F.col("kind") == "field").alias("fields"))
    zero = F.lit(0).cast("bigint")
    return table(spark, d, "api_types").select("type_id").join(members, "type_id", "left").select("type_id", F.coalesce("methods", zero).alias("methods"), F.coalesce("fields", zero).alias("fields"))


@query("P05 P07 W12 F18 F21", "SELECT type_id, fqn, CASE WHEN lower(simple_name) = 'turbine' THEN 0 WHEN starts_with(lower(simple_name), 'turbine') THEN 1 WHEN contains(lower(simple_name), 'turbine') THEN 2 ELSE 3 END::BIGINT AS rank, (length(fqn) - length(replace(fqn, '.', '')))::BIGINT AS dots FROM api_types WHERE contains(lower(fqn), 'turbine') AND kind = 'class' ORDER BY rank, dots, fqn, type_id LIMIT 30")
def api_search_ranked(spark: SparkSession, d: str) -> DataFrame:
    return S.ranked_types(table(spark, d, "api_types"), "turbine", "class").limit(30)


@query("F18 F19 W17", "WITH r AS (SELECT package_name, fqn, row_number() OVER (PARTITION BY package_name ORDER BY fqn) AS n FROM api_types WHERE package_name = 'com' OR starts_with(package_name, 'com.') OR starts_with(package_name, 'net.')) SELECT package_name, fqn FROM r WHERE n <= 5")
def browse_package(spark: SparkSession, d: str) -> DataFrame:
    return S.browse(table(spark, d, "api_types"), ["com", "net"], 5)


@query("W01", "WITH m AS (SELECT DISTINCT member_id, type_id, kind, name FROM api_members), r AS (SELECT *, row_number() OVER (PARTITION BY type_id, kind ORDER BY name NULLS FIRST, member_id) AS n FROM m) SELECT type_id, kind, member_id FROM r WHERE n <= 4")
def member_cap_per_kind(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "api_members").select("member_id", "type_id", "kind", "name").distinct()
    return S.first_members(rows, 4).select("type_id", "kind", "member_id")


@query("P06 A06 A07", "SELECT split_part(package_name, '.', 1) || '.' || split_part(package_name, '.', 2) AS package, count(*) AS n FROM api_types WHERE package_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def top_packages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "api_types").where("package_name is not null")
    package = F.concat_ws(".", F.split_part("package_name", F.lit("."), F.lit(1)), F.split_part("package_name", F.lit("."), F.lit(2)))
    return rows.groupBy(package.alias("package")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "package").limit(10)


# ---- versions -----------------------------------------------------------------------------------


@query("W13 W14 F27 F22 A06", """WITH v AS (SELECT DISTINCT minecraft_version AS version FROM document_pages WHERE regexp_matches(minecraft_version, '^[0-9]+\\.[0-9]+(\\.[0-9]+)*$'))
SELECT version, row_number() OVER (ORDER BY split_part(version, '.', 1)::INT, split_part(version, '.', 2)::INT, coalesce(try_cast(split_part(version, '.', 3) AS INT), 0), version) AS place FROM v""")
def version_sort(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, d, "document_pages").select(F.col("minecraft_version").alias("version")).where(V.well_shaped(F.col("version"))).distinct()
    return rows.select("version", F.row_number().over(Window.orderBy(V.sort_key(F.col("version")), "version")).cast("bigint").alias("place"))


@query("F03 F04", "SELECT document_id FROM document_pages WHERE minecraft_version = '1.12' OR starts_with(minecraft_version, '1.12.')")
def version_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_pages").where(V.exact_or_child(F.col("minecraft_version"), "1.12")).select("document_id")


@query("R14", "SELECT document_id, (CASE WHEN minecraft_version = '1.16.5' THEN 50 WHEN regexp_extract(minecraft_version, '^[0-9]+\\.[0-9]+') = '1.16' THEN 30 WHEN split_part(minecraft_version, '.', 1) = '1' THEN 10 ELSE 0 END)::DOUBLE AS boost FROM document_pages")
def version_boost(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_pages").select("document_id", V.boost(F.col("minecraft_version"), "1.16.5").alias("boost"))


@query("R13", "SELECT doc_id, nullif(regexp_extract(text, '\\b([0-9]+\\.[0-9]+(\\.[0-9]+)?)\\b', 1), '') AS version FROM documents")
def version_in_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", V.from_text(F.col("text")).alias("version"))


# ---- URLs ---------------------------------------------------------------------------------------

_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1))"
_SPECIFIC = {"recipes": "recipes", "rendering": "rendering", "networking": "network", "config": "configuration"}
_CONTAINER = {"items": "objects", "blocks": "objects", "entities": "objects", "porting": "porting"}
_PARTS = "list_filter(regexp_split_to_array(lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '[/:_]'), lambda x: x <> '' AND NOT regexp_matches(x, '^v?[0-9]+(\\.[0-9]+)*$') AND x <> 'index')"
_IN = lambda t: f"list_filter(list_transform({_PARTS}, lambda x: CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.items()) + " END), lambda x: x IS NOT NULL)[1]"


@query("R58 R57", f"SELECT document_id, coalesce({_IN(_SPECIFIC)}, {_IN(_CONTAINER)}, 'general') AS category FROM document_pages WHERE url IS NOT NULL")
def url_category(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document_pages").where("url is not null")
    return rows.select("document_id", U.category(F.col("url"), _SPECIFIC, _CONTAINER, ["index"]).alias("category"))


@query("R59", f"SELECT document_id, CASE WHEN {_HOST} = 'mixer-wiki.example' OR ends_with({_HOST}, '.mixer-wiki.example') THEN 'mixer' WHEN {_HOST} = 'hopper-docs.example' OR ends_with({_HOST}, '.hopper-docs.example') THEN 'hopper' WHEN contains(url, '/networking/') THEN 'net' ELSE 'neutral' END AS site FROM document_pages WHERE url IS NOT NULL")
def url_site(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document_pages").where("url is not null")
    return rows.select("document_id", U.site(F.col("url"), [("mixer-wiki.example", "mixer"), ("hopper-docs.example", "hopper")], [("/networking/", "net")]).alias("site"))


@query("R60", "SELECT document_id, coalesce(nullif(regexp_extract(url, '/v?([0-9]+\\.[0-9]+(\\.[0-9]+)?)(/|$)', 1), ''), nullif(regexp_extract(coalesce(content, ''), '(?i)\\bversion ([0-9]+\\.[0-9]+(\\.[0-9]+)?)\\b', 1), ''), 'unknown') AS version FROM document_pages")
def url_version(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_pages").select("document_id", U.version(F.coalesce("url", F.lit("")), F.col("content")).alias("version"))


@query("W03 R15", """WITH k AS (SELECT document_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '-[0-9a-z]+$', '') AS key, minecraft_version AS v, indexed_at FROM document_pages WHERE url IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN v = '1.12.2' THEN 0 ELSE 1 END, CASE WHEN regexp_extract(v, '^[0-9]+\\.[0-9]+') = '1.12' THEN 0 ELSE 1 END, indexed_at DESC NULLS LAST, document_id) AS n FROM k) SELECT key, document_id FROM r WHERE n = 1""")
def dedup_url_winner(spark: SparkSession, d: str) -> DataFrame:
    key = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "-[0-9a-z]+$", "")
    v = F.col("minecraft_version")
    rows = table(spark, d, "document_pages").where("url is not null").select("document_id", key.alias("key"), v, "indexed_at")
    order = [F.when(v == "1.12.2", 0).otherwise(1), F.when(V.minor(v) == "1.12", 0).otherwise(1), F.desc_nulls_last("indexed_at"), F.asc("document_id")]
    return R.best_of_group(rows, ["key"], order).select("key", "document_id")


@query("S08 F24", "SELECT document_id FROM document_pages WHERE url IS NOT NULL AND NOT regexp_matches(url, '/(de|fr)/') AND (regexp_matches(url, '/items/') OR regexp_matches(url, '/blocks/')) AND NOT regexp_matches(url, 'migrating')")
def sitemap_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_pages").where(U.keep_urls(F.col("url"), ["/items/", "/blocks/"], ["migrating"], "/(de|fr)/")).select("document_id")


@query("F24 F25", "SELECT file_id FROM source_files WHERE regexp_matches(path, '^src/main/(.*/)?[^/]*Gui\\.java$') AND bytes <= 4000")
def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").where(F.col("path").rlike(U.glob("src/main/**/*Gui.java")) & (F.col("bytes") <= 4000)).select("file_id")


_CODE = "CASE p.type WHEN 'int' THEN 'I' WHEN 'long' THEN 'J' WHEN 'float' THEN 'F' WHEN 'double' THEN 'D' WHEN 'boolean' THEN 'Z' WHEN 'byte[]' THEN '[B' ELSE 'Lx/' || regexp_replace(p.type, '[^A-Za-z]', '', 'g') || ';' END"


@query("T22 T23", f"""WITH m AS (SELECT DISTINCT member_id, type_id, params, kind FROM api_members WHERE params IS NOT NULL AND member_id IS NOT NULL), c AS (SELECT member_id, m.kind, fqn, list_transform(params, lambda p: {_CODE}) AS params FROM m JOIN api_types USING (type_id)),
w AS (SELECT *, list_transform(params, lambda x: CASE WHEN x IN ('J', 'D') THEN 2 ELSE 1 END) AS width, CASE WHEN kind = 'method' THEN 0 ELSE 1 END AS first FROM c)
SELECT member_id, params, list_transform(params, lambda x, i: (first + coalesce(list_sum(width[1:i - 1]), 0))::BIGINT) AS slots, regexp_replace(fqn, '\\.[^.]*$', '') AS package, regexp_extract(fqn, '[^.]*$') AS simple FROM w""", lists=("params", "slots"))
def descriptor_slots(spark: SparkSession, d: str) -> DataFrame:
    """Descriptors of all members taken apart: parameter types and the local slots they take, methods as static."""
    code = lambda x: (
        F.when(x["type"] == "int", "I").when(x["type"] == "long", "J").when(x["type"] == "float", "F").when(x["type"] == "double", "D").when(x["type"] == "boolean", "Z").when(x["type"] == "byte[]", "[B")
        .otherwise(F.concat(F.lit("Lx/"), F.regexp_replace(x["type"], "[^A-Za-z]", ""), F.lit(";")))
    )
    members = table(spark, d, "api_members").where("params is not null and member_id is not null").select("member_id", "type_id", "params", "kind").distinct()
    rows = members.join(table(spark, d, "api_types").select("type_id", "fqn"), "type_id")
    rows = rows.select("member_id", F.coalesce(F.col("kind") == "method", F.lit(False)).alias("static"), F.concat(F.lit("("), F.array_join(F.transform("params", code), ""), F.lit(")V")).alias("descriptor"), F.replace("fqn", F.lit("."), F.lit("/")).alias("name"))
    package, simple = D.split_internal(F.col("name"))
    slots = F.transform(D.slots(F.col("descriptor"), F.col("static")), lambda x: x.cast("bigint"))
    return rows.select("member_id", D.parameters(F.col("descriptor")).alias("params"), slots.alias("slots"), package.alias("package"), simple.alias("simple"))
