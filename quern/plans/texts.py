"""Queries over texts, mark-up, code and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunks as C
from quern.operators import snippets as S
from quern.plans.registry import query
from quern.sources import java, markup, table


@query("T01 T02 T03", "SELECT document_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '[\\x{200B}-\\x{200D}\\x{FEFF}]', '', 'g'), '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS clean FROM document_pages")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_pages").select("document_id", T.clean_lines(F.col("content")).alias("clean"))


@query("T26 J22", """WITH p AS (SELECT event_id, props, event_id % 4 AS k FROM events) SELECT event_id, CASE WHEN k = 3 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM p""")
def tolerant_json(spark: SparkSession, d: str) -> DataFrame:
    """Objects as models write them: plain, in a sentence, with a comma too many; a list is none."""
    from quern.functions import tolerant

    k = F.col("event_id") % 4
    comma = F.regexp_replace("props", r"\}\s*$", ",}")
    text = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Sure, here: "), "props", F.lit(" - done"))).when(k == 2, comma).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    rows = tolerant.extracted(table(spark, d, "events").select("event_id", text.alias("t")), ["event_id"], "t")
    return rows.select("event_id", F.get_json_object("object", "$.k").alias("k"))


@query("T28 W13", "SELECT DISTINCT minecraft_version AS version, CASE WHEN regexp_matches(minecraft_version, '^v?[0-9]') THEN concat_ws('.', p1, p2, p3 + 1) END AS patch, CASE WHEN regexp_matches(minecraft_version, '^v?[0-9]') THEN concat_ws('.', p1, p2 + 1, 0) END AS minor, CASE WHEN regexp_matches(minecraft_version, '^v?[0-9]') THEN concat_ws('.', p1 + 1, 0, 0) END AS major FROM (SELECT minecraft_version, " + ", ".join(f"coalesce(try_cast(split_part(regexp_extract(minecraft_version, '^v?([0-9]+(\\.[0-9]+){{0,2}})', 1), '.', {i}) AS BIGINT), 0) AS p{i}" for i in (1, 2, 3)) + " FROM document_pages)")
def version_bumps(spark: SparkSession, d: str) -> DataFrame:
    from quern.functions.versions import bumped

    v = F.col("version")
    rows = table(spark, d, "document_pages").select(F.col("minecraft_version").alias("version")).distinct()
    return rows.select("version", *(bumped(v, p).alias(p) for p in ("patch", "minor", "major")))


@query("T04", "SELECT document_id, regexp_replace(content, '(?m)^(Edit this page|Reply|Share this)$', '', 'g') AS kept FROM document_pages")
def noise_removed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_pages").select("document_id", T.without(F.col("content"), ["(?m)^(Edit this page|Reply|Share this)$"]).alias("kept"))


_SPACE = r"[\t-\r\p{Z}\x{FEFF}]"


@query("T08", f"SELECT doc_id, len(regexp_split_to_array(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_SPACE}+'))::BIGINT AS words FROM documents WHERE text IS NOT NULL")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query("T10", "SELECT doc_id, left(sha256(text), 16) AS hash FROM documents WHERE text IS NOT NULL")
def change_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.change_hash(F.col("text")).alias("hash"))


_UNITS = "list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT)"


@query("T09", f"SELECT document_id, lower(to_base(CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END, 36)) AS id FROM (SELECT document_id, list_reduce({_UNITS.format('url')}, lambda a, c: (a * 31 + c) % 4294967296, 0::BIGINT) AS h FROM document_pages WHERE length(url) > 0)")
def rolling_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_pages").where("length(url) > 0").select("document_id", T.rolling_id(F.col("url")).alias("id"))


@query("T11 T10", """SELECT file_id, sha256('{"content":"' || sha256(content) || '","path":"' || path || '","repo":' || coalesce('"' || repo || '"', 'null') || '}') AS key FROM (SELECT DISTINCT file_id, content, path, repo FROM source_files WHERE content IS NOT NULL AND path IS NOT NULL)""")
def canonical_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Cache keys: the hash of a record's canonical JSON, whatever the order its fields are given in."""
    rows = table(spark, d, "source_files").where("content is not null and path is not null").select("file_id", "content", "path", "repo").distinct()
    return rows.select("file_id", T.record_hash(repo=F.col("repo"), path=F.col("path"), content=F.sha2("content", 256)).alias("key"))


_FNV = f"lower(printf('%08x', list_reduce({_UNITS.format('s')}, lambda a, c: (xor(a, c) * 16777619) % 4294967296, 2166136261::BIGINT)))"


@query("T12 R57", f"SELECT document_id, coalesce(category, '') || '/' || loader || '/' || CASE WHEN length(s) > 120 THEN left(s, 111) || '-' || {_FNV} ELSE s END AS key, {_FNV} AS hash FROM (SELECT document_id, category, loader, trim(regexp_replace(lower(title || ' ' || url), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM document_pages WHERE title IS NOT NULL AND loader IS NOT NULL AND length(url) > 0)")
def entry_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document_pages").where("title is not null and loader is not null and length(url) > 0")
    name = F.concat_ws(" ", "title", "url")
    return rows.select("document_id", T.entry_key(F.coalesce("category", F.lit("")), F.col("loader"), name).alias("key"), T.fnv1a(T.slug(name, 100_000)).alias("hash"))


@query("T12", f"SELECT document_id, CASE WHEN length(s) > 20 THEN left(s, 11) || '-' || {_FNV} ELSE s END AS slug FROM (SELECT document_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM document_pages WHERE title IS NOT NULL) WHERE s <> ''")
def title_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_pages").where("title is not null").select("document_id", T.slug(F.col("title"), 20).alias("slug")).where("slug <> ''")


@query("T14", "SELECT DISTINCT member_id, trim(regexp_replace(regexp_replace(regexp_replace(return_type, '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g'), '\\s+', ' ', 'g')) AS raw FROM api_members WHERE return_type IS NOT NULL")
def raw_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "api_members").where("return_type is not null").select("member_id", T.without_type_arguments(F.col("return_type"), 2).alias("raw")).distinct()


@query("T19", "SELECT DISTINCT file_id, list_distinct_ordered AS imports FROM (SELECT file_id, list_filter(regexp_extract_all(content, '(?m)^\\s*import\\s+(static\\s+)?([A-Za-z_][A-Za-z0-9_.]*(\\.\\*)?)', 2), lambda x, i: list_position(regexp_extract_all(content, '(?m)^\\s*import\\s+(static\\s+)?([A-Za-z_][A-Za-z0-9_.]*(\\.\\*)?)', 2), x) = i) AS list_distinct_ordered FROM source_files WHERE content IS NOT NULL)", lists=('imports',))
def import_lists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").where("content is not null").select("file_id", T.imports(F.col("content")).alias("imports")).distinct()


@query("T20 F12", "SELECT DISTINCT file_id, len(list_distinct(regexp_extract_all(content, '\\b[a-z]+\\.put\\b')))::BIGINT AS calls FROM source_files WHERE content IS NOT NULL")
def code_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_files").where("content is not null")
    return rows.select("file_id", F.size(T.symbol_tokens(F.col("content"), r"\b[a-z]+\.put\b")).cast("bigint").alias("calls")).distinct()


@query("T21", "SELECT DISTINCT file_id, list_filter([CASE WHEN contains(content, 'LOG.debug') OR contains(content, 'world.notify') THEN 'effects' END, CASE WHEN contains(content, '@Override') THEN 'override' END], lambda x: x IS NOT NULL) AS markers FROM source_files WHERE content IS NOT NULL", lists=('markers',))
def marker_groups(spark: SparkSession, d: str) -> DataFrame:
    needles = [("effects", "LOG.debug"), ("effects", "world.notify"), ("override", "@Override")]
    return table(spark, d, "source_files").where("content is not null").select("file_id", S.markers(F.col("content"), needles).alias("markers")).distinct()


@query("T29 F10", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%steel%' OR lower(p_name) LIKE '%ring%'")
def like_memory(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(T.like_any(F.col("p_name"), ["steel", "ring"])).select("p_partkey")


@query("R56", "SELECT DISTINCT member_id, CASE WHEN regexp_matches(name, '^(get|find|resolve)') THEN 'read' WHEN regexp_matches(name, '^(set|update|store|put)') THEN 'write' ELSE 'other' END AS label FROM api_members WHERE name IS NOT NULL")
def first_rule_labels(spark: SparkSession, d: str) -> DataFrame:
    rules = [("read", "^(get|find|resolve)"), ("write", "^(set|update|store|put)")]
    return table(spark, d, "api_members").where("name is not null").select("member_id", S.first_rule(F.col("name"), rules, "other").alias("label")).distinct()


@query("T05 F29", "WITH c AS (SELECT DISTINCT section_id, document_id, order_num, trim(regexp_replace(coalesce(heading, ''), '[\\x{200B}-\\x{200D}\\x{FEFF}]', '', 'g')) AS h, trim(regexp_replace(coalesce(content, ''), '[\\x{200B}-\\x{200D}\\x{FEFF}]', '', 'g')) AS c, code_blocks FROM doc_sections), r AS (SELECT *, row_number() OVER (PARTITION BY document_id, h, c, code_blocks ORDER BY order_num NULLS FIRST, section_id) AS n FROM c WHERE length(c) >= 25 OR len(code_blocks) > 0) SELECT section_id FROM r WHERE n = 1")
def sanitize_dupes(spark: SparkSession, d: str) -> DataFrame:
    return C.sanitise(table(spark, d, "doc_sections")).select("section_id")


_ORDERED = "row_number() OVER (PARTITION BY document_id ORDER BY coalesce(order_num, 0), section_id, heading NULLS FIRST, content NULLS FIRST)"


@query("T06", f"""WITH RECURSIVE s AS (SELECT document_id, section_id, {_ORDERED} AS n, coalesce(heading, '') AS h, coalesce(nullif(trim(coalesce(content, ''), ' ' || chr(10) || chr(9) || chr(13)), ''), codes) AS body, codes FROM
 (SELECT *, coalesce(array_to_string(list_transform(code_blocks, lambda b: coalesce(b.code, '')), chr(10)), '') AS codes FROM (SELECT DISTINCT * FROM doc_sections WHERE document_id IS NOT NULL))),
o AS (SELECT document_id, section_id, n, list_transform([body, body || chr(10) || chr(10) || codes, h || chr(10) || chr(10) || body], lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))) AS options FROM s),
r(document_id, n, seen, section_id, body) AS (SELECT DISTINCT document_id, 0::BIGINT, []::VARCHAR[], NULL::BIGINT, NULL::VARCHAR FROM o
 UNION ALL SELECT document_id, n, CASE WHEN pick IS NULL THEN seen ELSE list_append(seen, pick) END, section_id, pick FROM (SELECT o.document_id, o.n, r.seen, o.section_id, list_filter(o.options, lambda x: x <> '' AND NOT list_contains(r.seen, x))[1] AS pick FROM r JOIN o ON o.document_id = r.document_id AND o.n = r.n + 1))
SELECT document_id, section_id, (n - 1)::INT AS place, md5(body) AS body FROM r WHERE body IS NOT NULL""")
def unique_bodies(spark: SparkSession, d: str) -> DataFrame:
    return C.unique_bodies(table(spark, d, "doc_sections")).withColumn("body", F.md5("body"))


@query("T07 S25", """WITH p AS (SELECT document_id, coalesce(title, '') AS title, coalesce(content, '') AS content FROM document_pages), s AS (SELECT DISTINCT document_id, section_id, coalesce(heading, '') AS h, trim(coalesce(content, ''), ' ' || chr(10) || chr(9) || chr(13)) AS body, code_blocks, order_num FROM doc_sections WHERE document_id IN (SELECT document_id FROM p))
SELECT document_id, 'title' AS chunk_type, md5(title || chr(10) || chr(10) || left(content, 1000)) AS hash, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT document_id, 'full', md5(content), count(*) FROM p WHERE document_id NOT IN (SELECT document_id FROM s) GROUP BY ALL
UNION ALL SELECT document_id, 'code', md5(concat_ws(chr(10), nullif(h, ''), nullif(b.caption, ''), b.code)), count(*) FROM (SELECT document_id, h, unnest(code_blocks) AS b FROM s) WHERE length(b.code) > 0 GROUP BY ALL
UNION ALL SELECT document_id, 'section', md5(CASE WHEN h <> '' THEN h || chr(10) || chr(10) || body ELSE body END), count(*) FROM s WHERE length(body) BETWEEN 50 AND 1000 GROUP BY ALL""")
def chunk_docs(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all kinds by digest; those of sections over the size, which windows cut, have tests of their own."""
    found = C.chunk(table(spark, d, "document_pages"), table(spark, d, "doc_sections"))
    body = F.when(F.col("section_heading") != "", F.substring("content", F.length("section_heading") + 3, 1_000_000)).otherwise(F.col("content"))
    sections = table(spark, d, "doc_sections").where("length(trim(content)) > 1000").select("document_id", F.coalesce("heading", F.lit("")).alias("section_heading"), "content")
    whole = sections.select("document_id", "section_heading", F.explode(C.pieces(F.regexp_replace("content", r"^[\t-\r ]+|[\t-\r ]+$", ""))).alias("piece")).distinct()
    cut = F.col("chunk_type") == "section"
    pieces = found.where(cut).withColumn("piece", body).join(whole, ["document_id", "section_heading", "piece"], "left_anti")
    return found.where(~cut).unionByName(pieces.drop("piece")).groupBy("document_id", "chunk_type", F.md5("content").alias("hash")).agg(F.count("*").alias("n"))


@query("R27 F28", f"""WITH RECURSIVE s AS (SELECT document_id, section_id, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(order_num, 0), section_id) AS n, lower(trim(coalesce(heading, ''))) AS h, lower(trim(coalesce(content, ''))) AS b FROM (SELECT DISTINCT document_id, section_id, order_num, heading, content FROM doc_sections)
 WHERE document_id IS NOT NULL AND length(trim(coalesce(content, ''))) >= 20 AND length(trim(coalesce(content, ''))) > length(coalesce(heading, '')) AND NOT regexp_matches(trim(coalesce(content, '')), '^[a-z]')),
r(document_id, n, heads, bodies, section_id, place) AS (SELECT DISTINCT document_id, 0::BIGINT, []::VARCHAR[], []::VARCHAR[], NULL::BIGINT, 0 FROM s
 UNION ALL SELECT r.document_id, s.n, CASE WHEN list_contains(heads, h) OR list_contains(bodies, b) THEN heads ELSE list_append(heads, h) END, CASE WHEN list_contains(heads, h) OR list_contains(bodies, b) THEN bodies ELSE list_append(bodies, b) END,
 CASE WHEN list_contains(heads, h) OR list_contains(bodies, b) THEN NULL ELSE s.section_id END, CASE WHEN list_contains(heads, h) OR list_contains(bodies, b) THEN place ELSE place + 1 END FROM r JOIN s ON s.document_id = r.document_id AND s.n = r.n + 1)
SELECT document_id, section_id, place FROM r WHERE section_id IS NOT NULL""")
def canonical_sections(spark: SparkSession, d: str) -> DataFrame:
    return C.canonical_sections(table(spark, d, "doc_sections")).select("document_id", "section_id", "place")


_SENTENCES = "(SELECT doc_id, s, p FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS p FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '[\\t-\\r ]+', ' ', 'g'), '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)) AS l FROM documents)) WHERE length(s) >= 20 AND NOT regexp_matches(s, '^[a-z]'))"


@query("R28 R29", f"""WITH h AS (SELECT *, contains(lower(s), 'registry')::INT + contains(lower(s), 'event')::INT + contains(lower(s), 'tank')::INT AS hits FROM {_SENTENCES}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, p) AS n FROM h),
j AS (SELECT doc_id, string_agg(s, ' ' ORDER BY n) AS t FROM r WHERE n <= 3 GROUP BY doc_id), x AS (SELECT doc_id, t, left(t, 400) AS head FROM j), e AS (SELECT *, regexp_extract(head, '(?s)^(.*[.!?]["'')\\]]*)([\\t-\\r ]|$)', 1) AS fin, regexp_extract(head, '(?s)^(.+)[ \\n\\t]', 1) AS sp, regexp_extract(t, '^[^\\t-\\r ]+') AS w FROM x)
SELECT doc_id, CASE WHEN length(t) <= 400 THEN t WHEN length(fin) >= 180 THEN regexp_replace(fin, '[\\t-\\r ]+$', '') WHEN sp <> '' THEN regexp_replace(sp, '[\\t-\\r ]+$', '') || '...' WHEN w <> '' THEN w ELSE head END AS summary FROM e""")
def doc_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.summary(table(spark, d, "documents"), "doc_id", F.col("text"), ["registry", "event", "tank"])


@query("R31", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p)::INT AS place, s AS sentence FROM {_SENTENCES} WHERE length(s) <= 200 AND (contains(lower(s), 'recipe handler') OR contains(lower(s), 'loot modifier')) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p) <= 8")
def key_points(spark: SparkSession, d: str) -> DataFrame:
    return C.key_points(table(spark, d, "documents"), "doc_id", F.col("text"), ["recipe handler", "loot modifier"])


_H1 = "list_filter(list_transform(regexp_extract_all(raw_html, '(?is)<h1[^>]*>(.*?)</h1>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> '')"


@query("T16 F23", f"SELECT document_id, list_last({_H1}) AS title, len(regexp_extract_all(raw_html, '(?i)<pre\\b'))::BIGINT AS blocks FROM document_pages WHERE raw_html IS NOT NULL")
def html_titles(spark: SparkSession, d: str) -> DataFrame:
    """Title and number of code blocks of every page, read by the parser; the SQL looks for their elements."""
    pages = markup.pages(table(spark, d, "document_pages").where("raw_html is not null"), "document_id", "raw_html")
    return pages.select("document_id", "title", F.aggregate("sections", F.lit(0).cast("bigint"), lambda n, s: n + F.size(s["code_blocks"])).alias("blocks"))


@query("T16 F23 S25")
def html_sections(spark: SparkSession, d: str) -> DataFrame:
    pages = markup.pages(table(spark, d, "document_pages"), "document_id", "raw_html")
    return pages.select("document_id", "title", F.explode("sections").alias("s")).select("document_id", "title", "s.heading", "s.level", "s.content", "s.order_num", F.size("s.code_blocks").alias("blocks"))


_FENCED = "regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '(?ms)^ {0,3}```.*?(^ {0,3}```[ \\t]*$|\\z)', '', 'g')"


@query("T17", f"SELECT doc_id, (len(regexp_extract_all(text, '(?m)^ {{0,3}}(`{{3,}}|~{{3,}})')) + 1) // 2 AS blocks, len(regexp_extract_all({_FENCED}, '(?m)^ {{0,3}}#{{1,6}}[ \\t]+\\S.*$'))::BIGINT AS headings FROM documents WHERE kind IN ('wiki', 'guide', 'readme', 'changelog') AND text IS NOT NULL")
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    """Code blocks and headings of Markdown, read by the parser; the SQL counts fences, and heading lines outside them."""
    docs = table(spark, d, "documents").where("kind in ('wiki', 'guide', 'readme', 'changelog') and text is not null")
    count = lambda f: F.aggregate("sections", F.lit(0).cast("bigint"), f)
    pages = markup.pages(docs, "doc_id", "text", markdown=True)
    return pages.select("doc_id", count(lambda n, s: n + F.size(s["code_blocks"])).alias("blocks"), count(lambda n, s: n + F.when(F.length(s["heading"]) > 0, 1).otherwise(0)).alias("headings"))


_DECLARED = r"(?m)^[ \t]*(?:(?:public|protected|private|static|final|abstract)[ \t]+)*(class|interface|enum|record)[ \t]+([A-Za-z0-9_$]+)"


@query("S23", f"SELECT file_id, what, simple_name, count(*) AS n FROM (SELECT file_id, unnest(regexp_extract_all(content, '{_DECLARED}', 1)) AS what, unnest(regexp_extract_all(content, '{_DECLARED}', 2)) AS simple_name FROM source_files WHERE content IS NOT NULL AND ends_with(path, '.java')) GROUP BY ALL")
def java_types(spark: SparkSession, d: str) -> DataFrame:
    """Types declared in Java files, read by the parser; the SQL finds them by line."""
    rows = java.symbols(table(spark, d, "source_files")).where("what in ('class', 'interface', 'enum', 'record')")
    return rows.groupBy("file_id", "what", "simple_name").agg(F.count("*").alias("n"))


@query("S23 T15")
def java_symbols(spark: SparkSession, d: str) -> DataFrame:
    return java.symbols(table(spark, d, "source_files"))


_BARE = """regexp_replace(content, '(?s)/\\*.*?(\\*/|\\z)|//[^\\n]*|"([^"\\\\\\n]|\\\\.)*"?|''([^''\\\\\\n]|\\\\.)*''?', '', 'g')"""


@query("T18", f"SELECT file_id, length(content)::BIGINT AS size, (length(bare) - length(replace(bare, '{{', '')))::BIGINT AS opened, (length(bare) - length(replace(bare, '}}', '')))::BIGINT AS closed, len(regexp_extract_all(bare, 'return'))::BIGINT AS returns FROM (SELECT DISTINCT file_id, content, {_BARE} AS bare FROM source_files WHERE content IS NOT NULL)")
def code_masks(spark: SparkSession, d: str) -> DataFrame:
    """Braces and words of the code alone, its offsets unchanged: what lies in comments and literals doesn't count."""
    rows = S.masked_code(table(spark, d, "source_files").where("content is not null"), ["file_id"], "content")
    count = lambda t: (F.length("masked") - F.length(F.replace("masked", F.lit(t), F.lit("")))).cast("bigint")
    return rows.select("file_id", F.length("masked").cast("bigint").alias("size"), count("{").alias("opened"), count("}").alias("closed"), F.regexp_count("masked", F.lit("return")).cast("bigint").alias("returns")).distinct()


@query("T18 F24 F25 P12")
def code_regions(spark: SparkSession, d: str) -> DataFrame:
    return S.extract(table(spark, d, "source_files"), ["**/*.java"], ["**/test/**"])


_CAPPED = "WITH m AS (SELECT DISTINCT member_id, type_id, kind, name FROM api_members WHERE kind IS NOT NULL AND type_id IS NOT NULL), g AS (SELECT kind AS repo, 'd/' || type_id AS path, member_id AS start_line, contains(coalesce(name, ''), 'Tank')::INT + contains(coalesce(name, ''), 'get')::INT AS k FROM m)"


@query("W15 W16 T21", f"{_CAPPED}, t AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY k DESC, start_line) AS turn FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY turn > 3, turn, k DESC, path, start_line) AS place FROM t) SELECT repo, path, start_line, place FROM r WHERE place <= 40")
def snippets_under_cap(spark: SparkSession, d: str) -> DataFrame:
    """Items of every kind under a cap, in turns over their types."""
    rows = table(spark, d, "api_members").where("kind is not null and type_id is not null").select("member_id", "type_id", "kind", "name").distinct()
    marked = S.markers(F.coalesce("name", F.lit("")), [("tank", "Tank"), ("read", "get")])
    items = rows.select(F.col("kind").alias("repo"), F.concat(F.lit("d/"), "type_id").alias("path"), F.col("member_id").alias("start_line"), marked.alias("markers"))
    return S.under_cap(items, 40).select("repo", "path", "start_line", F.col("place").cast("bigint").alias("place"))


@query("W16", """WITH m AS (SELECT DISTINCT member_id, type_id, kind, name FROM api_members WHERE kind IS NOT NULL AND type_id IS NOT NULL), g AS (SELECT kind AS repo, 'p' || type_id % 7 AS dir, 'p' || type_id % 7 || '/F' || type_id AS path, member_id AS start_line, -(contains(coalesce(name, ''), 'Tank')::INT + contains(coalesce(name, ''), 'get')::INT) AS k FROM m),
i AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, start_line) AS idx, count(*) OVER (PARTITION BY repo) AS all_items FROM g), f AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY k, idx) AS turn, first_value(k) OVER (PARTITION BY repo, path ORDER BY k, idx) AS fk, first_value(idx) OVER (PARTITION BY repo, path ORDER BY k, idx) AS fi FROM i),
d AS (SELECT *, row_number() OVER (PARTITION BY repo, dir ORDER BY turn, fk, fi) AS pos, first_value(k) OVER (PARTITION BY repo, dir ORDER BY k, idx) AS dk, first_value(idx) OVER (PARTITION BY repo, dir ORDER BY k, idx) AS di FROM f WHERE turn <= 3 OR all_items <= 12),
r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY pos, dk, di) AS place FROM d) SELECT repo, path, start_line FROM r WHERE place <= 12""")
def snippets_by_directory(spark: SparkSession, d: str) -> DataFrame:
    """Items of every kind in turns over directories and their files, three of a file at most."""
    rows = table(spark, d, "api_members").where("kind is not null and type_id is not null").select("member_id", "type_id", "kind", "name").distinct()
    marked = S.markers(F.coalesce("name", F.lit("")), [("tank", "Tank"), ("read", "get")])
    path = F.concat(F.lit("p"), F.col("type_id") % 7, F.lit("/F"), "type_id")
    items = rows.select(F.col("kind").alias("repo"), path.alias("path"), F.col("member_id").cast("int").alias("start_line"), (F.col("member_id") + 9).cast("int").alias("end_line"), marked.alias("markers"))
    return S.spread_directories(items, 12).select("repo", "path", F.col("start_line").cast("bigint").alias("start_line"))


# ---- time ---------------------------------------------------------------------------------------


@query("G01 S24", "WITH old AS (SELECT doc_id, left(sha256(coalesce(text, '')), 16) AS hash FROM documents WHERE doc_id % 2 = 0), new AS (SELECT doc_id, left(sha256(coalesce(text, '') || CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE '' END), 16) AS hash FROM documents) SELECT new.doc_id, new.hash FROM new LEFT JOIN old USING (doc_id) WHERE old.hash IS DISTINCT FROM new.hash")
def incremental_delta(spark: SparkSession, d: str) -> DataFrame:
    from quern.streaming.incremental import changed

    docs = table(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    old = docs.where("doc_id % 2 = 0").select("doc_id", T.change_hash(text).alias("hash"))
    new = docs.select("doc_id", T.change_hash(F.concat(text, F.when(F.col("doc_id") % 4 == 0, "x").otherwise(""))).alias("hash"))
    return changed(old, new, ["doc_id"], "hash").select("doc_id", "hash")


@query("S24", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY indexed_at DESC NULLS LAST) AS n FROM api_members WHERE member_id % 2 = 0) SELECT member_id, epoch_us(max(indexed_at)) AS at FROM (SELECT member_id, indexed_at FROM r WHERE n = 1 UNION ALL SELECT member_id, TIMESTAMPTZ '2020-01-01 00:00:00+00' FROM (SELECT DISTINCT member_id FROM api_members WHERE member_id % 2 = 1)) GROUP BY member_id")
def merge_latest(spark: SparkSession, d: str) -> DataFrame:
    from quern.sources.store import upsert

    members = table(spark, d, "api_members").select("member_id", "indexed_at")
    old = members.select("member_id").distinct().withColumn("indexed_at", F.lit("2020-01-01").cast("timestamp"))
    out = upsert(old, members.where("member_id % 2 = 0"), ["member_id"], "indexed_at")
    return out.select("member_id", F.unix_micros("indexed_at").alias("at"))


@query("G06", "SELECT document_id, coalesce(nullif(regexp_extract(url, '/v?([0-9]+\\.[0-9]+(\\.[0-9]+)?)(/|$)', 1), ''), 'unknown') AS version FROM document_pages WHERE coalesce(nullif(regexp_extract(url, '/v?([0-9]+\\.[0-9]+(\\.[0-9]+)?)(/|$)', 1), ''), 'unknown') IS DISTINCT FROM minecraft_version")
def stale_columns(spark: SparkSession, d: str) -> DataFrame:
    from quern.functions.urls import version

    fresh = version(F.coalesce("url", F.lit("")))
    return table(spark, d, "document_pages").where(~fresh.eqNullSafe(F.col("minecraft_version"))).select("document_id", fresh.alias("version"))


@query("", "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("event_type", F.col("w.start").alias("start"), "n", "total")


@query("", "SELECT time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def sliding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("start"), F.count("*").alias("n"))
    return out.select("user_id", "start", "n")


@query("W01", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_value, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events")
def lag_lead(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lag("value").over(w).alias("last_value"), F.lead("event_type").over(w).alias("next_type"))


@query("J09", "SELECT e.event_id, coalesce(p.event_id, -1) AS purchase FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof(spark: SparkSession, d: str) -> DataFrame:
    """The last purchase of the same user up to each event: one union and one window, no range join."""
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "purchase").alias("p"))
    bought = rows.where("p").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase")).withColumn("event_id", F.lit(None).cast("bigint"))
    both = bought.unionByName(rows.where("not p").select("user_id", "ts", F.lit(None).cast("bigint").alias("purchase"), "event_id"))
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("purchase", F.last("purchase", ignorenulls=True).over(w)).where("event_id is not null").select("event_id", F.coalesce("purchase", F.lit(-1).cast("bigint")).alias("purchase"))


@query("", "SELECT coalesce(l_returnflag, '(all)') AS flag, coalesce(l_linestatus, '(all)') AS status, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return out.select(F.coalesce("l_returnflag", F.lit("(all)")).alias("flag"), F.coalesce("l_linestatus", F.lit("(all)")).alias("status"), "n")


@query("U05", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def intersect_except(spark: SparkSession, d: str) -> DataFrame:
    of = lambda s: table(spark, d, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return of("F").intersect(of("O")).subtract(of("P"))


@query("A02", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS near FROM lineitem GROUP BY 1")
def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Different parts of each group, and whether the sketch is within a tenth of them."""
    out = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.approx_count_distinct("l_partkey", 0.02).alias("sketch"))
    return out.select("l_returnflag", "parts", (F.abs(F.col("sketch") - F.col("parts")) <= 0.1 * F.col("parts")).alias("near"))


@query("", "SELECT event_type, coalesce(json_extract_string(props, '$.k')::BIGINT % 5, -1) AS bucket, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k").cast("bigint") % 5, F.lit(-1).cast("bigint"))
    return table(spark, d, "events").groupBy("event_type", k.alias("bucket")).agg(F.count("*").alias("n"))
