"""Queries over parsers, ids and tables as an ingest makes them."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import concepts as K
from quern.operators import graph as G
from quern.operators import index as I
from quern.operators import quality as Q
from quern.operators.quality import gate
from quern.plans.registry import query
from quern.session import workspace
from quern.sources import crawl, formats, table
from quern.sources.store import SCHEMAS, Store, cached, cascade, children, numbered, tag_tables, vectors
from quern.streaming.incremental import index_stream, pins, postings_delta


# ---- line, archive and JSON formats, written from the tables and read back ------------------------

_MEMBERS = "(SELECT DISTINCT member_id, type_id, kind, name, params FROM api_members WHERE length(name) > 0)"
_INNER = "replace(fqn, '.', '/')"


def _mapping_files(spark: SparkSession, d: str) -> DataFrame:
    """One mapping text per type: its class line, then every member's line with what belongs to it."""
    types = table(spark, d, "api_types").select("type_id", "fqn", "simple_name")
    members = table(spark, d, "api_members").where("length(name) > 0").select("member_id", "type_id", "kind", "name", "params").distinct()
    method = F.col("kind") == "method"
    params = F.coalesce(F.array_join(F.transform("params", lambda x, i: F.concat(F.lit("\n\t\t"), i, F.lit(" o "), x["name"])), ""), F.lit(""))
    line = F.when(method, F.concat(F.lit("\n\t"), "name", F.lit(" (I)V m"), "member_id", F.when(F.col("member_id") % 2 == 0, "\n\t\tstatic").otherwise(""), params)).otherwise(F.concat(F.lit("\n\t"), "name", F.lit(" f"), "member_id"))
    lines = members.groupBy("type_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("member_id", line.alias("l")))), lambda x: x["l"]), "").alias("lines"))
    text = F.concat(F.lit("tsrg2 left right\n"), F.replace("fqn", F.lit("."), F.lit("/")), F.lit(" x/"), "simple_name", F.coalesce("lines", F.lit("")), F.lit("\n"))
    return types.join(lines, "type_id", "left").select(F.col("type_id").cast("string").alias("file"), text.alias("value"))


@query("S17", f"""WITH t AS (SELECT type_id, {_INNER} AS a, 'x/' || simple_name AS b FROM api_types), m AS (SELECT * FROM {_MEMBERS} JOIN t USING (type_id))
SELECT a AS class_from, b AS class_to, 'class' AS what, a AS name_from, b AS name_to, NULL AS descriptor, false AS is_static, NULL::INT AS slot FROM t
UNION ALL SELECT a, b, 'method', name, 'm' || member_id, '(I)V', member_id % 2 = 0, NULL FROM m WHERE kind = 'method' UNION ALL SELECT a, b, 'field', name, 'f' || member_id, NULL, false, NULL FROM m WHERE kind <> 'method' OR kind IS NULL
UNION ALL SELECT a, b, 'parameter', name, p.name, '(I)V', false, (i - 1)::INT FROM (SELECT *, unnest(params) AS p, generate_subscripts(params, 1) AS i FROM m WHERE kind = 'method')""")
def mapping_lines(spark: SparkSession, d: str) -> DataFrame:
    return formats.tsrg(_mapping_files(spark, d)).drop("file")


@query("S18", f"""WITH t AS (SELECT type_id, fqn AS a, 'z' || type_id AS b FROM api_types), m AS (SELECT * FROM {_MEMBERS} JOIN t USING (type_id))
SELECT a AS class_from, b AS class_to, 'class' AS what, NULL AS type, NULL AS name_from, NULL AS arguments, NULL AS name_to FROM t
UNION ALL SELECT a, b, 'method', 'void', name, '(int,float)', 'c' || member_id FROM m WHERE kind = 'method' UNION ALL SELECT a, b, 'field', 'int', name, '', 'c' || member_id FROM m WHERE kind <> 'method' OR kind IS NULL""")
def shrinker_lines(spark: SparkSession, d: str) -> DataFrame:
    types = table(spark, d, "api_types").select("type_id", "fqn")
    members = table(spark, d, "api_members").where("length(name) > 0").select("member_id", "type_id", "kind", "name").distinct()
    line = F.when(F.col("kind") == "method", F.concat(F.lit("    1:2:void "), "name", F.lit("(int,float) -> c"), "member_id", F.lit("\n"))).otherwise(F.concat(F.lit("    int "), "name", F.lit(" -> c"), "member_id", F.lit("\n")))
    lines = members.groupBy("type_id").agg(F.array_join(F.collect_list(line), "").alias("lines"))
    text = F.concat(F.lit("# head\n"), "fqn", F.lit(" -> z"), "type_id", F.lit(":\n"), F.coalesce("lines", F.lit("")))
    return formats.proguard(types.join(lines, "type_id", "left").select(F.col("type_id").cast("string").alias("file"), text.alias("value")))


@query("S16", f"SELECT member_id::VARCHAR AS id, {_INNER} AS owner, '(I)V' AS descriptor FROM {_MEMBERS} JOIN api_types USING (type_id)")
def sidecar_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of three fields, with comments and blank lines between them."""
    members = table(spark, d, "api_members").where("length(name) > 0").select("member_id", "type_id", "kind", "name", "params").distinct()
    rows = members.join(table(spark, d, "api_types").select("type_id", F.replace("fqn", F.lit("."), F.lit("/")).alias("owner")), "type_id")
    lines = rows.select(F.explode(F.array(F.concat("member_id", F.lit("  "), "owner", F.lit("\t(I)V # tail")), F.lit("# alone"), F.lit("  "))).alias("value"))
    return formats.sidecar(lines, ["id", "owner", "descriptor"])


def _written(df: DataFrame, name: str) -> str:
    """A new folder in the shared one, for a writer to fill."""
    return f"{workspace(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"


@query("S14 S15", """WITH r AS (SELECT member_id, name, javadoc_summary, indexed_at, row_number() OVER (PARTITION BY member_id ORDER BY epoch_us(indexed_at) DESC NULLS LAST) AS n FROM (SELECT DISTINCT member_id, name, javadoc_summary, indexed_at FROM api_members) WHERE length(name) > 0)
SELECT 'func_' || member_id AS searge, name, CASE WHEN trim(javadoc_summary) <> '' THEN 'a "b", ' || javadoc_summary END AS javadoc FROM r WHERE n = 1""")
def names_csv(spark: SparkSession, d: str) -> DataFrame:
    """Names, written as quoted CSV and read back; of rows delivered again the last wins."""
    rows = table(spark, d, "api_members").select(
        F.concat(F.lit("func_"), "member_id").alias("searge"), "name", F.lit("0").alias("side"),
        F.when(F.trim("javadoc_summary") != "", F.concat(F.lit('a "b", '), "javadoc_summary")).alias("desc"), F.unix_micros("indexed_at").alias("at"),
    ).distinct()
    path = _written(rows, "names")
    rows.write.csv(path, header=True, quote='"', escape='"')
    return formats.names(formats.csv(spark, path, "searge string, name string, side string, desc string, at bigint"), "at")


@query("S15", """SELECT 'p_' || member_id || '_' || (i - 1) || '_' AS param, p.name AS name FROM (SELECT member_id, unnest(params) AS p, generate_subscripts(params, 1) AS i FROM (SELECT DISTINCT member_id, params FROM api_members)) WHERE length(p.name) > 0""")
def parameters_csv(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "api_members").select("member_id", F.posexplode("params").alias("i", "p")).distinct()
    rows = rows.select(F.concat(F.lit("p_"), "member_id", F.lit("_"), "i", F.lit("_")).alias("param"), F.col("p.name").alias("name"), F.lit("0").alias("side"))
    path = _written(rows, "parameters")
    rows.write.csv(path, header=True, quote='"', escape='"')
    return formats.parameter_names(formats.csv(spark, path, "param string, name string, side string"), "name")


@query("S19", f"""WITH m AS (SELECT * FROM (SELECT DISTINCT member_id, type_id, kind, name, params, javadoc FROM api_members WHERE length(name) > 0) JOIN (SELECT type_id, fqn FROM api_types) USING (type_id))
SELECT DISTINCT 'package' AS what, NULL AS class, package_name AS name, NULL AS descriptor, NULL::INT AS slot, NULL AS parameter, NULL AS javadoc FROM api_types UNION ALL SELECT 'class', fqn, fqn, NULL, NULL, NULL, CASE WHEN length(javadoc) > 0 THEN javadoc END FROM api_types
UNION ALL SELECT 'field', fqn, name, 'I', NULL, NULL, NULL FROM m WHERE kind = 'field' UNION ALL SELECT 'method', fqn, name, '(I)V', NULL, NULL, CASE WHEN length(javadoc) > 0 THEN javadoc || chr(10) || 'more' END FROM m WHERE kind = 'method'
UNION ALL SELECT 'parameter', fqn, name, '(I)V', (i - 1)::INT, p.name, NULL FROM (SELECT *, unnest(params) AS p, generate_subscripts(params, 1) AS i FROM m WHERE kind = 'method')""")
def documented_mappings(spark: SparkSession, d: str) -> DataFrame:
    """Documented names: packages, classes, fields, methods and parameters, written as JSON and read back."""
    types = table(spark, d, "api_types").select("type_id", "fqn", "package_name", "javadoc")
    members = table(spark, d, "api_members").where("length(name) > 0").select("member_id", "type_id", "kind", "name", "params", "javadoc").distinct()
    field = F.when(F.col("kind") == "field", F.struct("name", F.lit("I").alias("descriptor")))
    doc = lambda *more: F.when(F.length("javadoc") > 0, F.array("javadoc", *(F.lit(x) for x in more)))
    method = F.when(F.col("kind") == "method", F.struct("name", F.lit("(I)V").alias("descriptor"), doc("more").alias("javadoc"), F.transform("params", lambda x, i: F.struct(i.alias("index"), x["name"].alias("name"))).alias("parameters")))
    of = members.groupBy("type_id").agg(F.collect_list(field).alias("fields"), F.collect_list(method).alias("methods"))
    classes = types.join(of, "type_id", "left").select(F.to_json(F.struct(F.lit("1").alias("version"), F.array(F.struct(F.col("fqn").alias("name"), doc().alias("javadoc"), "fields", "methods")).alias("classes"))).alias("value"))
    packages = types.select("package_name").distinct().select(F.to_json(F.struct(F.array(F.struct(F.col("package_name").alias("name"))).alias("packages"))).alias("value"))
    return formats.documented_names(classes.unionByName(packages))


@query("S09", "SELECT url AS loc, '2024-01-02T03:04:05Z' AS lastmod FROM document_pages WHERE regexp_matches(url, '^https?://[^ ]+$')")
def sitemap_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document_pages").where(F.col("url").rlike("^https?://[^ ]+$"))
    return formats.sitemap_text(rows.select(F.concat("url", F.lit("2024-01-02T03:04:05Z")).alias("value")))


@query("S07", "SELECT replace(url, '&', '+') AS loc, '2024-01-02' AS lastmod, 'daily' AS changefreq, 0.5::DOUBLE AS priority FROM document_pages WHERE length(url) > 0 UNION ALL SELECT 'https://a.example/part.xml', NULL, 'nested', NULL")
def sitemap_xml(spark: SparkSession, d: str) -> DataFrame:
    """Packed sitemaps and one that names another, written and read back."""
    rows = table(spark, d, "document_pages").where("length(url) > 0").select(F.replace("url", F.lit("&"), F.lit("+")).alias("u"))
    path, index = _written(rows, "sitemap"), _written(rows, "sitemap-index")
    entry = F.concat(F.lit("<url><loc>"), "u", F.lit("</loc><lastmod>2024-01-02</lastmod><changefreq>daily</changefreq><priority>0.5</priority></url>"))
    files = rows.groupBy(F.pmod(F.xxhash64("u"), F.lit(8)).alias("k")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("value"))
    files.select("value").write.options(compression="gzip", maxRecordsPerFile=1).text(path)
    spark.createDataFrame([("<sitemapindex><sitemap><loc>https://a.example/part.xml</loc></sitemap></sitemapindex>",)], "value string").coalesce(1).write.text(index)
    found = formats.sitemap(spark, path)
    gate("sitemap entries missing", int(found.isEmpty()))
    none = F.lit(None).cast("string")
    return found.unionByName(formats.sitemap_parts(spark, index).select("loc", none.alias("lastmod"), F.lit("nested").alias("changefreq"), F.lit(None).cast("double").alias("priority")))


@query("S20", "SELECT DISTINCT minecraft_version AS version FROM document_pages WHERE regexp_matches(minecraft_version, '^[0-9][^\"/<]*$')")
def release_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions named by metadata files and directory listings."""
    rows = table(spark, d, "document_pages").where(F.col("minecraft_version").rlike('^[0-9][^"/<]*$')).select("document_id", "minecraft_version")
    xml = F.concat(F.lit("<version>"), "minecraft_version", F.lit("</version>"))
    link = F.concat(F.lit('<a href="'), "minecraft_version", F.lit('/">x</a>'))
    return formats.release_list(rows.select(F.when(F.col("document_id") % 2 == 0, xml).otherwise(link).alias("value"))).distinct()


@query("S11", r"SELECT file_id, regexp_replace('https://d.example/' || regexp_replace(regexp_replace(regexp_replace(p, '^docs/', ''), '\.md$', ''), '/?index$', ''), '/+$', '') AS route, 'https://d.example/' || replace(regexp_replace(p, '\.md$', ''), '_', '/') AS flat FROM (SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'docs/' || regexp_replace(path, '[^/]*$', '') || 'index.md' ELSE 'docs/' || path || '.md' END AS p FROM source_files WHERE path IS NOT NULL)")
def wiki_routes(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("docs/"), F.regexp_replace("path", "[^/]*$", ""), F.lit("index.md"))).otherwise(F.concat(F.lit("docs/"), "path", F.lit(".md")))
    rows = table(spark, d, "source_files").where("path is not null")
    return rows.select("file_id", formats.wiki_route(path, "https://d.example").alias("route"), formats.key_route(path, "https://d.example").alias("flat"))


@query("S12 S13", "SELECT file_id::VARCHAR AS archive, path, md5(content) AS hash FROM source_files WHERE content IS NOT NULL AND ends_with(path, '.java') AND NOT ends_with(path, 'package-info.java')")
def zipped_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources packed below a top directory and read back from the archives."""

    def pack(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                memory = io.BytesIO()
                with zipfile.ZipFile(memory, "w") as z:
                    z.writestr(f"top-main/{path}", content.encode())
                    z.writestr("top-main/package-info.java", b"")
                    z.writestr("top-main/notes.txt", b"text")
                out.append(memory.getvalue())
            yield batch[["file"]].rename(columns={"file": "path"}).assign(content=out)

    rows = table(spark, d, "source_files").where("content is not null and path is not null").select(F.col("file_id").cast("string").alias("file"), "path", "content")
    entries = formats.unzipped(rows.mapInPandas(pack, "path string, content binary"))
    gate("archives with entries missing", int(entries.limit(1).count() < 1))
    return entries.select("archive", "path", F.md5("content").alias("hash"))


@query("S28 S25 S27", "SELECT document_id, url, row_number() OVER (ORDER BY url NULLS FIRST, document_id) AS id FROM document_pages")
def surrogate_ids(spark: SparkSession, d: str) -> DataFrame:
    return numbered(table(spark, d, "document_pages").select("document_id", "url"), ["url", "document_id"]).select("document_id", "url", F.col("id").cast("bigint"))


@query("S24 J20", "SELECT id FROM doc_chunks WHERE document_id IS NULL OR document_id NOT IN (SELECT document_id FROM document_pages WHERE minecraft_version = '1.12.2')")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "document_pages").where("minecraft_version = '1.12.2'").select("document_id")
    return cascade(table(spark, d, "doc_chunks").select("id", "document_id"), "document_id", gone).select("id")


@query("S25 P10", "SELECT document_id, section_id, block::BIGINT AS block, language, length(code)::BIGINT AS n FROM (SELECT document_id, section_id, generate_subscripts(code_blocks, 1) - 1 AS block, unnest(code_blocks).language AS language, unnest(code_blocks).code AS code FROM (SELECT DISTINCT * FROM doc_sections))")
def block_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "doc_sections").distinct()
    nested = rows.select("document_id", "section_id", F.array(F.struct("heading", "level", "content", "code_blocks")).alias("sections"))
    keyed = nested.withColumn("key", F.struct("document_id", "section_id"))
    _, blocks = children(keyed, "key")
    return blocks.select("key.document_id", "key.section_id", F.col("block").cast("bigint").alias("block"), "language", F.length("code").cast("bigint").alias("n"))


@query("G02", r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'fresh words ' || doc_id ELSE text END AS text FROM documents), w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM d) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w GROUP BY term""")
def index_delta(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = I.postings(docs, "doc_id", F.col("text"))
    updates = docs.where("doc_id % 10 = 0").select("doc_id", F.concat(F.lit("fresh words "), F.col("doc_id")).alias("text"))
    return postings_delta(index, updates, "doc_id", "text").groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("docs"))


@query("J08 R46", """WITH m AS (SELECT DISTINCT member_id, type_id, name FROM api_members WHERE kind = 'method' AND name IS NOT NULL), w AS (SELECT *, list_filter(string_split(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), ' '), lambda x: x <> '') AS words FROM m)
SELECT member_id, fqn, name FROM w JOIN api_types USING (type_id) WHERE len(list_filter(words, lambda x: starts_with(x, 'heat') OR starts_with(x, 'tank'))) > 0 AND len(list_filter(words, lambda x: starts_with(x, 'get') OR starts_with(x, 'set') OR starts_with(x, 'load') OR starts_with(x, 'update'))) > 0""")
def member_types(spark: SparkSession, d: str) -> DataFrame:
    """Index hits joined with their members and types: every word asked for begins a word of the name."""
    index = I.declared(spark, f"{d}/api_members.parquet", "member_id", F.concat_ws(" ", "name", F.array_join(T.camel_words(F.col("name")), " ")), "member names")
    hits = I.search(index, I.And((I.Or((I.Term("heat", True), I.Term("tank", True))), I.Or(tuple(I.Term(t, True) for t in ("get", "set", "load", "update")))))).select(F.col("id").alias("member_id"))
    members = table(spark, d, "api_members").where("kind = 'method'").select("member_id", "type_id", "name").distinct()
    return members.join(hits, "member_id", "left_semi").join(table(spark, d, "api_types").select("type_id", "fqn"), "type_id").select("member_id", "fqn", "name")


_RELATED = """i AS (SELECT p_partkey AS id, p_brand AS owner, p_size AS place, p_type AS pattern, p_retailprice AS quality, p_partkey % 97 AS line FROM part),
p AS (SELECT a.id AS source, b.id AS target, CASE WHEN a.owner = b.owner AND a.place = b.place THEN 3 WHEN a.pattern = b.pattern THEN 2 ELSE 1 END AS priority, b.quality, abs(a.line - b.line) AS far FROM i a JOIN i b ON a.id <> b.id AND (a.owner = b.owner OR a.pattern = b.pattern)),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY priority DESC, quality DESC, far, target) AS n FROM p)"""


@query("J11 R54", f"WITH {_RELATED} SELECT source, target, p_name AS title, CASE priority WHEN 3 THEN 0.95 WHEN 2 THEN 0.85 ELSE 0.65 END::DOUBLE AS strength FROM r JOIN part ON p_partkey = target WHERE n <= 6")
def related_titles(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "part").selectExpr("p_partkey as id", "p_brand as owner", "p_size as place", "p_type as pattern", "p_retailprice as quality", "p_partkey % 97 as line")
    names = table(spark, d, "part").selectExpr("p_partkey as target", "p_name as title")
    return G.relations(items).join(names, "target").select("source", "target", "title", "strength")


_EX = "(SELECT id, category, loader, word_count, content, row_number() OVER (PARTITION BY category ORDER BY word_count DESC NULLS LAST, id) AS n, count(*) OVER (PARTITION BY category) AS of FROM doc_chunks WHERE has_code)"


@query("R54 A11 A07", f"SELECT category, of AS examples, id, word_count, n AS place FROM {_EX} WHERE n <= 3 AND of >= 2")
def featured_examples(spark: SparkSession, d: str) -> DataFrame:
    """The best examples of every category that has two or more, with the category's count."""
    rows = table(spark, d, "doc_chunks").where("has_code").select("id", "category", "word_count")
    return K.featured(rows, "category", F.col("word_count"), 3, 2)


@query("R54 J12 P10", "WITH t AS (SELECT document_id, list_sort(list_distinct(metadata.tags)) AS tags FROM document_pages), c AS (SELECT document_id, count(*) FILTER (WHERE has_code) AS examples, count(*) AS chunks FROM doc_chunks GROUP BY 1) SELECT p.document_id, p.title, coalesce(list_filter(tags, lambda x: trim(x) <> ''), []) AS tags, coalesce(examples, 0) AS examples, coalesce(chunks, 0) AS chunks FROM document_pages p JOIN t USING (document_id) LEFT JOIN c USING (document_id)", lists=("tags",))
def example_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with their tags, through the tag table and its bridge, and the counts of their examples."""
    pages = table(spark, d, "document_pages")
    tags, bridge = tag_tables(pages, "document_id", "metadata.tags")
    named = bridge.join(tags, F.col("tag_id") == F.col("id")).groupBy(F.col("example_id").alias("document_id")).agg(F.array_sort(F.collect_set("name")).alias("tags"))
    counts = table(spark, d, "doc_chunks").groupBy("document_id").agg(F.count_if("has_code").alias("examples"), F.count("*").alias("chunks"))
    zero = F.lit(0).cast("bigint")
    out = pages.select("document_id", "title").join(named, "document_id", "left").join(counts, "document_id", "left")
    return out.select("document_id", "title", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("examples", zero).alias("examples"), F.coalesce("chunks", zero).alias("chunks"))


@query("R30", "SELECT section_id, CASE WHEN length(c) <= 200 THEN c WHEN length(e) > 101 THEN e || chr(10) || '// ...' ELSE regexp_replace(left(c, 200), '[\\t-\\r ]+$', '') || chr(10) || '// ...' END AS code FROM (SELECT section_id, c, regexp_extract(left(c, 200), '(?s)^(.*[;}])', 1) AS e FROM (SELECT section_id, unnest(code_blocks).code AS c FROM doc_sections)) WHERE c IS NOT NULL")
def code_extracts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "doc_sections").select("section_id", F.explode("code_blocks").alias("b")).where("b.code is not null")
    return rows.select("section_id", T.truncate_code(F.col("b.code"), 200).alias("code"))


# ---- an ingest into a store ---------------------------------------------------------------------


@query("J15 S17 S15", f"""WITH m AS (SELECT DISTINCT member_id, type_id, kind, name, params FROM api_members WHERE length(name) > 0 AND kind = 'method')
SELECT replace(fqn, '.', '/') AS owner, m.name AS token, 'read_' || m.name AS readable, coalesce(len(m.params), 0) AS parameters FROM m JOIN api_types t USING (type_id)""")
def ingest_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Mapping rows made readable: names joined by their number, parameters joined to the methods they belong to."""
    mapped = formats.tsrg(_mapping_files(spark, d)).where("what = 'method'")
    number = F.regexp_extract("name_to", "^m([0-9]+)$", 1)
    members = table(spark, d, "api_members").select("member_id", "name", "params").distinct()
    names = members.where("length(name) > 0").select(F.concat(F.lit("func_"), "member_id").alias("searge"), F.concat(F.lit("read_"), "name").alias("readable")).distinct()
    parameters = members.select(F.concat(F.lit("p_"), "member_id", F.lit("_0_")).alias("token"), F.posexplode("params").alias("i", "p")).distinct()
    counts = parameters.groupBy(F.regexp_extract("token", "^p_([0-9]+)_", 1).alias("number")).agg(F.count("*").alias("parameters"))
    rows = mapped.withColumn("number", number).join(names.withColumn("number", F.regexp_extract("searge", "([0-9]+)$", 1)), "number").join(counts, "number", "left")
    return rows.select(F.col("class_from").alias("owner"), F.col("name_from").alias("token"), "readable", F.coalesce("parameters", F.lit(0).cast("bigint")).alias("parameters"))


@query("S01 S02 S03 S04 S05 S28 S29 S33 Q-09 Q-15", """SELECT 'documents' AS "table", count(*) AS rows, true AS intact, true AS known FROM document_pages UNION ALL SELECT 'sections', count(*), true, true FROM (SELECT DISTINCT * FROM doc_sections)
UNION ALL SELECT 'code_blocks', count(*), true, true FROM (SELECT unnest(code_blocks) FROM (SELECT DISTINCT * FROM doc_sections)) UNION ALL SELECT 'chunks', count(*), true, true FROM doc_chunks UNION ALL SELECT 'vectors', 0, true, false""")
def store_build(spark: SparkSession, d: str) -> DataFrame:
    """Four tables published in one step and verified against their manifest; a fifth was never written and reads as empty."""
    store = Store(spark, f"{workspace(spark)}/store-{uuid.uuid4().hex[:12]}")
    pages = table(spark, d, "document_pages").select(F.col("document_id").alias("id"), "url", "title", "content", "raw_html", "category", "loader", F.col("minecraft_version").alias("version"), "hash", "indexed_at")
    sections = numbered(table(spark, d, "doc_sections").distinct(), ["section_id", "document_id"])
    blocks = numbered(sections.select(F.col("id").alias("section"), F.posexplode("code_blocks").alias("pos", "b")), ["section", "pos"]).select("id", F.col("section").alias("section_id"), "b.language", "b.code", "b.caption")
    chunks = table(spark, d, "doc_chunks").select("id", "document_id", "chunk_type", "content", "section_heading", "order_num", F.col("word_count").cast("bigint").alias("word_count"), "has_code")
    tables = {"documents": pages, "sections": sections.select("id", "document_id", "heading", "level", "content", "order_num"), "code_blocks": blocks, "chunks": chunks}
    gate("source rows missing", int(pages.isEmpty()))
    manifest = store.publish(tables, source=d)
    wrong = store.verify()
    rows = [(n, manifest["tables"].get(n, {}).get("rows", 0), not any(w.startswith(f"{n}:") for w in wrong) and "schema version" not in wrong, store.has(n, "id")) for n in (*tables, "vectors")]
    empty = store.read("vectors").count()
    return spark.createDataFrame([(n, k + (empty if n == "vectors" else 0), i, h) for n, k, i, h in rows], "table string, rows bigint, intact boolean, known boolean")


@query("S30 T11", """WITH r AS (SELECT DISTINCT file_id, sha256(content) AS hash FROM source_files WHERE content IS NOT NULL), c AS (SELECT DISTINCT hash FROM r WHERE file_id % 3 = 0) SELECT file_id, hash, hash IN (SELECT hash FROM c) AS hit FROM r""")
def cache_split(spark: SparkSession, d: str) -> DataFrame:
    """Requests a cache of this version answers, and those it must be filled with; entries of another version don't count."""
    rows = table(spark, d, "source_files").where("content is not null").select("file_id", F.sha2("content", 256).alias("hash")).distinct()
    asked = rows.withColumn("version", F.lit(2))
    cache = rows.where("file_id % 3 = 0").select("hash").distinct().withColumn("version", F.lit(2)).withColumn("answer", F.lit("x")).unionByName(rows.select("hash").distinct().withColumn("version", F.lit(1)).withColumn("answer", F.lit("old")))
    hits, misses = cached(asked, cache, ["hash", "version"])
    return hits.select("file_id", "hash", F.lit(True).alias("hit")).unionByName(misses.select("file_id", "hash", F.lit(False).alias("hit")))


@query("S26 S24", "SELECT vec_id::VARCHAR AS chunk_id, len(embedding)::INT AS dimension, CASE WHEN label % 2 = 0 THEN 'second' ELSE 'first' END AS model, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings WHERE embedding IS NOT NULL")
def vector_sink(spark: SparkSession, d: str) -> DataFrame:
    """Vectors upserted by chunk with dimension and model; every second label is written again by another model."""
    rows = table(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "label")
    none = spark.createDataFrame([], SCHEMAS["vectors"])
    at = lambda t: F.lit(t).cast("timestamp").alias("created_at")
    first = vectors(none, rows.select("chunk_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), at("2024-01-01")), "first")
    out = vectors(first, rows.where("label % 2 = 0").select("chunk_id", "embedding", at("2024-02-01")), "second")
    return out.select("chunk_id", "dimension", "model", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("G05", "SELECT repo, coalesce(ref = 'main', false) AS skip FROM roster_repos WHERE repo IS NOT NULL")
def build_pins(spark: SparkSession, d: str) -> DataFrame:
    """Builds to skip, as the known one has the same pin: those that follow another branch have moved."""
    roster = table(spark, d, "roster_repos").where("repo is not null").select("repo", "sha", "ref", F.lit(3).alias("version"))
    known = roster.select("repo", F.when(F.col("ref") == "main", F.col("sha")).otherwise("0").alias("sha"), "version")
    return pins(known, roster, ["repo"], ["sha", "version"]).select("repo", "skip")


@query("G04 G01 G02", r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents WHERE doc_id % 5 = 0) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w GROUP BY term""".replace("FROM documents WHERE doc_id % 5 = 0", "FROM documents"))
def stream_index(spark: SparkSession, d: str) -> DataFrame:
    """Documents indexed as a stream of files, one file a micro-batch; the second file delivers them all again."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("2024-01-01").cast("timestamp").alias("indexed_at"))
    path = f"{workspace(spark)}/stream-{uuid.uuid4().hex[:12]}"
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(f"{path}/in")
    store = Store(spark, f"{path}/store")
    source = spark.readStream.schema("id bigint, text string, indexed_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    run = index_stream(source, store, f"{path}/checkpoint")
    run.awaitTermination()
    return store.read("postings").groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("docs"))


# ---- pages from elsewhere -----------------------------------------------------------------------


def _answer(url: str) -> tuple[int, str]:
    """A stand-in for the network: what an address answers depends on it alone."""
    if "/rendering/" in url:
        raise OSError("refused")
    return (404, "") if "/general/" in url else (200, f"page of {url}")


@query("S06 S10 S08 G03", """WITH u AS (SELECT DISTINCT regexp_replace(url, '^([a-z]+://)cauldron-docs\\.example', '\\1docs.example') AS url FROM document_pages WHERE regexp_matches(url, '^[a-z]+://[^/ ]+/[^ ]*$') UNION SELECT 'https://docs.example/start')
SELECT url, CASE WHEN contains(url, '/rendering/') THEN NULL WHEN contains(url, '/general/') THEN 404 ELSE 200 END::INT AS status, CASE WHEN NOT contains(url, '/rendering/') AND NOT contains(url, '/general/') THEN 'page of ' || url END AS body,
 CASE WHEN contains(url, '/rendering/') THEN 3 ELSE 1 END::INT AS attempts, CASE WHEN contains(url, '/rendering/') THEN 'refused' WHEN contains(url, '/general/') THEN 'status 404' END AS error FROM u""")
def crawled_pages(spark: SparkSession, d: str) -> DataFrame:
    """Addresses on canonical hosts, fetched host by host with repeats; failures are rows."""
    urls = table(spark, d, "document_pages").where(F.col("url").rlike("^[a-z]+://[^/ ]+/[^ ]*$")).select("url")
    return crawl.crawl(crawl.discover(urls, {"cauldron-docs.example": "docs.example"}, static=["https://docs.example/start"]), _answer, delay=0.0)


@query("S21", "WITH a AS (SELECT DISTINCT repo, 'file' AS provenance FROM repo_files WHERE repo IS NOT NULL), b AS (SELECT DISTINCT repo FROM source_files WHERE repo IS NOT NULL) SELECT * FROM a UNION ALL SELECT repo, 'source' FROM b WHERE repo NOT IN (SELECT repo FROM a) UNION ALL SELECT repo, 'roster' FROM roster_repos WHERE repo NOT IN (SELECT repo FROM a) AND repo NOT IN (SELECT repo FROM b)")
def artifact_sources(spark: SparkSession, d: str) -> DataFrame:
    """Every repository from the first place that knows it, with the place."""
    of = lambda t: table(spark, d, t).where("repo is not null").select("repo").distinct()
    return crawl.first_source([("file", of("repo_files")), ("source", of("source_files")), ("roster", of("roster_repos"))], "repo")


@query("S32 S33 S34", """SELECT 'documents' AS "table", count(*) AS rows FROM document_pages UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'guide://setup', 21""")
def release_install(spark: SparkSession, d: str) -> DataFrame:
    """A release verified and installed into a store that held another state; beside it a document that comes with the program."""
    base = f"{workspace(spark)}/release-{uuid.uuid4().hex[:12]}"
    release, live = Store(spark, f"{base}/new"), Store(spark, f"{base}/live")
    live.publish({"documents": table(spark, d, "document_pages").limit(1).select("document_id")}, tag="old")
    release.publish({"documents": table(spark, d, "document_pages").select("document_id", "url"), "vectors": table(spark, d, "embeddings")}, tag="new")
    crawl.install(release, live)
    guide = crawl.read_static(crawl.static_documents(spark, {"guide://setup": "Install, then restart."}), "guide://setup#top")
    rows = [(t, live.read(t).count()) for t in ("documents", "vectors") if live.fact("tag") == "new"]
    return spark.createDataFrame([*rows, ("guide://setup", len(guide) - 1)], "table string, rows bigint")


@query("S31 R26", "SELECT vec_id::VARCHAR AS key, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) * CASE WHEN label = 2 THEN 2 ELSE 1 END, 3)::DOUBLE AS total FROM embeddings WHERE embedding IS NOT NULL AND label <> 3")
def vector_cache(spark: SparkSession, d: str) -> DataFrame:
    """Vectors put, written over, deleted, saved and loaded."""
    rows = table(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").cast("string").alias("key"), "embedding", "label")
    cache = crawl.VectorCache(rows.select("key", "embedding")).put(rows.where("label = 2").select("key", F.transform("embedding", lambda x: x * 2).alias("embedding"))).delete(rows.where("label = 3"))
    path = f"{workspace(spark)}/cache-{uuid.uuid4().hex[:12]}"
    cache.save(path)
    found = crawl.VectorCache.load(spark, path).get(rows)
    return found.select("key", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("S22 R62", "SELECT document_id::VARCHAR AS file, 't' || document_id % 5 AS topic, i::INT AS n, title AS from_api, CASE WHEN document_id % 9 = 0 THEN 'bad' END AS error FROM (SELECT document_id, title, unnest([0, 1]) AS i FROM document_pages WHERE regexp_matches(title, '^[A-Za-z ]+$')) WHERE document_id % 9 <> 0 UNION ALL SELECT document_id::VARCHAR, NULL, NULL, NULL, 'bad' FROM document_pages WHERE regexp_matches(title, '^[A-Za-z ]+$') AND document_id % 9 = 0")
def yaml_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topic files in YAML: entries of good files, one error row of each bad one."""
    rows = table(spark, d, "document_pages").where(F.col("title").rlike("^[A-Za-z ]+$")).select(F.col("document_id").cast("string").alias("file"), "document_id", "title")
    entry = lambda n: F.concat(F.lit(f" - {{n: {n}, from: '"), "title", F.lit("'}\n"))
    text = F.when(F.col("document_id") % 9 == 0, "topic: [unclosed").otherwise(F.concat(F.lit("topic: t"), F.col("document_id") % 5, F.lit("\nentries:\n"), entry(0), entry(1)))
    found = formats.topic_entries(rows.select("file", text.alias("value")))
    part = lambda k: F.get_json_object("entry", f"$.{k}")
    return found.select("file", "topic", part("n").cast("int").alias("n"), part("from").alias("from_api"), F.when(F.col("error").isNotNull(), "bad").alias("error"))


@query("Q-15", "SELECT 'schema' AS \"check\", 0::BIGINT AS bad UNION ALL SELECT 'files', count(*) FILTER (WHERE path IS NULL) FROM source_files UNION ALL SELECT 'roster', (SELECT count(*) FROM (SELECT DISTINCT repo FROM source_files WHERE repo IS NOT NULL) s WHERE repo NOT IN (SELECT repo FROM roster_repos))")
def release_checks(spark: SparkSession, d: str) -> DataFrame:
    files, roster = table(spark, d, "source_files"), table(spark, d, "roster_repos")
    missing = [c for c in ("file_id", "repo", "path", "content", "bytes") if c not in files.columns]
    schema = spark.range(1).select(F.lit("schema").alias("check"), F.lit(len(missing)).cast("bigint").alias("bad"))
    paths = Q.nulls(files, ["path"]).select(F.lit("files").alias("check"), "bad")
    strays = Q.orphans(files.select("repo").distinct(), "repo", roster, "repo").agg(F.count("*").alias("bad")).select(F.lit("roster").alias("check"), "bad")
    return schema.unionByName(paths).unionByName(strays)
