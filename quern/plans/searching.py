"""Search by several strategies on the test tables, and the SQL of all strategies together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import concepts as K
from quern.operators import index as I
from quern.operators import search as S
from quern.operators import vectors as X
from quern.plans.registry import query
from quern.sources import table
from quern.sources.tables import derived

WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
STOP = frozenset("a an and for how in of on the to with".split())
SYNONYMS = {"tab": ["inventory"], "tank": ["vessel", "fluid handler"], "render": ["renderer", "drawing"]}
PATTERNS = {"creative": ["world.notify"], "vessel": [".put("]}


def documents_index(spark: SparkSession, d: str) -> I.Index:
    return I.declared(spark, f"{d}/documents.parquet", "doc_id", F.col("text"), "text")


def pages_index(spark: SparkSession, d: str) -> I.Index:
    return I.declared(spark, f"{d}/document_pages.parquet", "document_id", F.col("content"), "content")


def chunks_index(spark: SparkSession, d: str) -> I.Index:
    return I.declared(spark, f"{d}/doc_chunks.parquet", "id", F.concat_ws("\n", "section_heading", "content"), "heading and content")


def items_index(spark: SparkSession, d: str) -> I.Index:
    return I.declared(spark, f"{d}/eval_items.parquet", "item_id", F.col("text"), "text")


def types_index(spark: SparkSession, d: str) -> I.Index:
    return I.declared(spark, f"{d}/api_types.parquet", "type_id", S.symbol_text(F.col("fqn"), F.col("simple_name")), "symbols")


def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of all chunks, kept beside the indexes."""
    return derived(spark, f"{d}/doc_chunks.parquet", "hashed heading and content", lambda rows: X.hashed(rows, T.tokens(F.concat_ws("\n", "section_heading", "content")), ["id", "document_id"]))


# ---- SQL ----------------------------------------------------------------------------------------

_TEXT = "concat_ws(chr(10), section_heading, content)"


def bm25_cte(source: str, id_col: str, text: str, terms: list[str], match: str, prefix: tuple[str, ...] = ()) -> str:
    """``id, score`` of all rows that match."""
    count = lambda t: f"len(list_filter(w, lambda x: x LIKE '{t}%'))" if t in prefix else f"len(list_filter(w, lambda x: x = '{t}'))"
    df = ", ".join(f"count(*) FILTER (WHERE {count(t)} > 0) AS df{i}" for i, t in enumerate(terms))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * {count(t)} * 2.2 / ({count(t)} + 1.2 * (0.25 + 0.75 * len(w) / mean))" for i, t in enumerate(terms))
    return f"(WITH d AS (SELECT {id_col} AS id, {WORDS.format(text)} AS w FROM {source}), f AS (SELECT count(*) AS n, avg(len(w)) AS mean, {df} FROM d) SELECT id, {score} AS score FROM d, f WHERE {match})"


def has(t: str) -> str:
    return f"list_contains(w, '{t}')"


def phrase(words: str) -> str:
    return f"contains(' ' || array_to_string(w, ' ') || ' ', ' {words} ')"


def _conditions(q: S.Question, fields: dict[str, str], code: str | None = None) -> list[tuple[str, float, str]]:
    inside = lambda f, t: f"contains(lower({fields[f]}), '{t}')"
    out = [(inside(f, q.whole), p, f"phrase in {f}") for f, p in S.WHOLE.items() if f in fields]
    out += [(inside(f, w), p * (0.1 if w in q.common else 1), f"{w} in {f}") for w in q.words for f, p in S.WORD.items() if f in fields]
    out += [(inside(f, s), 8, f"{s} beside in {f}") for s in q.beside for f in ("title", "heading") if f in fields]
    if code:
        out += [(f"contains({code}, '{p}')", 25, p) for p in q.patterns] + [(f"length({code}) > 50", 10, "code")]
    return out


def points(q: S.Question, fields: dict[str, str], code: str | None = None) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p, _ in _conditions(q, fields, code)) + ")::DOUBLE"


def why(q: S.Question, fields: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for c, _, r in _conditions(q, fields)) + "], lambda x: x IS NOT NULL)"


_ON_CHUNK = {"title": "title", "heading": "section_heading", "url": "url", "category": "category", "content": "content"}
_ON_PAGE = {"title": "title", "url": "url", "category": "category", "content": "content"}
_ON_SECTION = {"heading": "heading", "content": "content"}


def near_cte(q: S.Question, floor: float, most: int = 20) -> str:
    """The nearest chunks, with the hashing of words written in SQL."""
    code = lambda w: f"('0x' || left(md5({w}), 8))::BIGINT"
    part = lambda src, key: f"SELECT {key}c % 64 AS dim, sum(CASE WHEN (c // 64) % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x FROM {src} GROUP BY ALL"
    return f"""(WITH t AS (SELECT id, {code('w')} AS c FROM (SELECT id, unnest({WORDS.format(_TEXT)}) AS w FROM doc_chunks)), v AS ({part('t', 'id, ')}),
a AS ({part(f"(SELECT {code('w')} AS c FROM (SELECT unnest({list(q.words)}) AS w))", '')}), s AS (SELECT id, sum(v.x * coalesce(a.x, 0)) / (sqrt(sum(v.x * v.x)) * (SELECT sqrt(sum(x * x)) FROM a)) AS similarity FROM v LEFT JOIN a USING (dim) GROUP BY id HAVING sum(v.x * v.x) > 0)
SELECT s.id, document_id, similarity FROM s JOIN doc_chunks USING (id) WHERE similarity * 100 > {floor} ORDER BY round(similarity, 6) DESC, s.id LIMIT {most})"""


def _like(columns: tuple[str, ...], q: S.Question) -> str:
    wanted = [q.whole, *(w for w in q.words if len(w) > 2)][:3]
    return "(" + " OR ".join(f"coalesce(contains(lower({c}), '{w}'), false)" for c in columns for w in wanted) + ")"


def chunk_hits(q: S.Question, match: str, terms: list[str]) -> str:
    hits = f"(SELECT id FROM {bm25_cte('doc_chunks', 'id', _TEXT, terms, match)} ORDER BY round(score, 6) DESC, id LIMIT 100)"
    return f"(SELECT * FROM (SELECT document_id, {points(q, _ON_CHUNK)} AS score, {why(q, _ON_CHUNK)} AS reasons FROM doc_chunks JOIN {hits} USING (id)) WHERE score > 0)"


def page_hits(q: S.Question) -> str:
    return f"(SELECT * FROM (SELECT document_id, {points(q, _ON_PAGE)} AS score, {why(q, _ON_PAGE)} AS reasons FROM (SELECT * FROM document_pages WHERE {_like(('title', 'content'), q)} ORDER BY document_id LIMIT 50)) WHERE score > 0)"


def pool_sql(q: S.Question, match: str, terms: list[str], floor: float) -> str:
    order = ".*".join(q.words)
    sections = f"(SELECT * FROM doc_sections WHERE regexp_matches(lower(heading), '(?s){order}') OR regexp_matches(lower(content), '(?s){order}') ORDER BY section_id, document_id LIMIT 50)"
    return f"""SELECT document_id, max(score) AS score, list_sort(list_distinct(flatten(list(reasons)))) AS reasons FROM (SELECT * FROM {chunk_hits(q, match, terms)} UNION ALL SELECT * FROM {page_hits(q)}
UNION ALL SELECT document_id, {points(q, _ON_SECTION)} AS score, {why(q, _ON_SECTION)} AS reasons FROM {sections} UNION ALL SELECT document_id, similarity * 100, ['similar'] FROM {near_cte(q, floor)}) GROUP BY document_id"""


def _part(i: int) -> str:
    return f"coalesce(try_cast(split_part(regexp_extract(minecraft_version, '^[0-9]+(\\.[0-9]+)*'), '.', {i}) AS BIGINT), 0)"


def documents_sql(q: S.Question, match: str, terms: list[str], floor: float, limit: int) -> str:
    v, major = q.version, q.version.split(".")
    return f"""WITH p AS ({pool_sql(q, match, terms, floor)}),
b AS (SELECT document_id, title, minecraft_version, reasons, round(score + CASE WHEN minecraft_version = '{v}' THEN 50 WHEN regexp_extract(minecraft_version, '^[0-9]+\\.[0-9]+') = '{'.'.join(major[:2])}' THEN 30 WHEN split_part(minecraft_version, '.', 1) = '{major[0]}' THEN 10 ELSE 0 END, 4) AS raw,
 regexp_replace(regexp_replace(coalesce(url, '#' || document_id), '[?#].+$', ''), '^(.*?)/[0-9]+\\.[0-9]+(\\.[0-9]+)?(/|$)', '\\1\\3') AS k FROM p JOIN document_pages USING (document_id)),
w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN minecraft_version = '{v}' THEN 0 ELSE 1 END, CASE WHEN regexp_extract(minecraft_version, '^[0-9]+\\.[0-9]+') = '{'.'.join(major[:2])}' THEN 0 ELSE 1 END,
 minecraft_version IS NULL, {_part(1)} DESC, {_part(2)} DESC, {_part(3)} DESC, {_part(4)} DESC, raw DESC, document_id) AS n FROM b),
top AS (SELECT * FROM w WHERE n = 1 ORDER BY raw DESC, document_id LIMIT {limit}),
s AS (SELECT document_id, list(coalesce(section_heading, '') ORDER BY o, id) AS hs FROM (SELECT *, coalesce(order_num, 0) AS o, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(order_num, 0), id) AS i FROM doc_chunks
 WHERE chunk_type = 'section' AND {' AND '.join(f"contains(lower({_TEXT}), '{w}')" for w in q.words)}) WHERE i <= 3 GROUP BY document_id)
SELECT document_id, title, round(greatest(0, least(100, raw / 200 * 100)), 1)::DOUBLE AS score, raw::DOUBLE AS raw, reasons, coalesce(hs, []) AS sections FROM top LEFT JOIN s USING (document_id)"""


# ---- documents ----------------------------------------------------------------------------------

HYBRID = S.understand("Creative tab for 1.12.2", STOP, SYNONYMS, PATTERNS)
_HYBRID = f"{phrase('creative tab')} OR ({has('creative')} AND {has('tab')}) OR {has('inventory')}"
FLOOR = 25.0


@query("R16 R12 R09 R10 R11 R05 R04 R03 R13 R14 R15 W03 R34 U03 R08", documents_sql(HYBRID, _HYBRID, ["creative", "tab", "inventory"], FLOOR, 20), lists=("reasons", "sections"))
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: a question in words is understood, four strategies are pooled, versions decide, hits are assembled."""
    pages, sections, chunks = (table(spark, d, t) for t in ("document_pages", "doc_sections", "doc_chunks"))
    hits = S.documents(HYBRID, pages, sections, chunks, chunks_index(spark, d), chunk_vectors(spark, d), 20, FLOOR)
    return S.assembled(hits, HYBRID, chunks).select("document_id", "title", "score", "raw", "reasons", "sections")


_NOTHING = S.understand("quixotic tab", STOP)


@query("R09 R06 W08", f"SELECT document_id, max(score) AS score FROM (SELECT document_id, {points(_NOTHING, _ON_CHUNK)} AS score FROM (SELECT * FROM doc_chunks WHERE {_like(('content',), _NOTHING)} ORDER BY id LIMIT 100)) WHERE score > 0 GROUP BY document_id")
def search_fallback(spark: SparkSession, d: str) -> DataFrame:
    """No chunk holds all words, so containment takes the place of the index."""
    return S.in_chunks(_NOTHING, table(spark, d, "doc_chunks"), chunks_index(spark, d)).select("document_id", "score")


@query("R12 A16 J05 R20", f"SELECT document_id, round(max(similarity) * 100, 4)::DOUBLE AS score, title FROM {near_cte(HYBRID, 20.0)} JOIN (SELECT document_id, title FROM document_pages) USING (document_id) GROUP BY ALL")
def vector_documents(spark: SparkSession, d: str) -> DataFrame:
    close = S.near(HYBRID, chunk_vectors(spark, d), 20.0).groupBy("document_id").agg(F.round(F.max("similarity") * 100, 4).alias("score"))
    return table(spark, d, "document_pages").select("document_id", "title").join(F.broadcast(close), "document_id").select("document_id", "score", "title")


@query("R61", f"""WITH p AS (SELECT count(*) AS found FROM ({pool_sql(HYBRID, _HYBRID, ['creative', 'tab', 'inventory'], FLOOR)}) JOIN document_pages USING (document_id) WHERE loader = 'forge'), r AS (SELECT count(*) AS reachable FROM document_pages WHERE loader = 'forge')
SELECT found, reachable, CASE WHEN found = 0 THEN 'none' WHEN found >= reachable THEN 'all reachable' WHEN found >= 100 THEN 'limit' ELSE 'part' END AS ceiling FROM p, r""")
def search_coverage(spark: SparkSession, d: str) -> DataFrame:
    pages, sections, chunks = (table(spark, d, t) for t in ("document_pages", "doc_sections", "doc_chunks"))
    pooled = S.pool(HYBRID, pages, sections, chunks, chunks_index(spark, d), chunk_vectors(spark, d), FLOOR)
    of_loader = pages.where("loader = 'forge'").select("document_id")
    return S.coverage(of_loader.join(F.broadcast(pooled.select("document_id")), "document_id"), of_loader, 100)


@query("J02 R63", f"SELECT p.document_id, p.title, round(score, 4)::DOUBLE AS score FROM {bm25_cte('document_pages', 'document_id', 'content', ['registry', 'event'], f'{has("registry")} AND {has("event")}')} JOIN document_pages p ON p.document_id = id WHERE category = 'rendering' ORDER BY round(score, 4) DESC, p.document_id LIMIT 20")
def search_pages(spark: SparkSession, d: str) -> DataFrame:
    """Index hits joined with their pages under a filter."""
    hits = I.search(pages_index(spark, d), I.And((I.Term("registry"), I.Term("event"))))
    pages = table(spark, d, "document_pages").where("category = 'rendering'").select(F.col("document_id").alias("id"), "title")
    out = pages.join(hits, "id").select(F.col("id").alias("document_id"), "title", F.round("score", 4).alias("score"))
    return out.orderBy(F.desc("score"), "document_id").limit(20)


@query("R23", f"""WITH t AS (SELECT id, ('0x' || left(md5(w), 8))::BIGINT AS c FROM (SELECT id, unnest({WORDS.format('content')}) AS w FROM doc_chunks)), v AS (SELECT id, c % 32 AS dim, sum(CASE WHEN (c // 32) % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x FROM t GROUP BY ALL), n AS (SELECT id, sqrt(sum(x * x)) AS norm FROM v GROUP BY id)
SELECT id, dim::BIGINT AS dim, round(x / norm, 6)::DOUBLE AS x FROM v JOIN n USING (id) WHERE x <> 0""")
def hashed_embedding(spark: SparkSession, d: str) -> DataFrame:
    """The parts of every chunk's vector that aren't zero."""
    rows = X.hashed(table(spark, d, "doc_chunks"), T.tokens(F.col("content")), ["id"], 32)
    return rows.select("id", F.posexplode("embedding").alias("dim", "x")).where("x <> 0").select("id", F.col("dim").cast("bigint").alias("dim"), F.round("x", 6).alias("x"))


# ---- snippets and concepts ----------------------------------------------------------------------

_ON_BLOCK = {"title": "title", "heading": "heading", "caption": "caption", "content": "code"}
_BLOCKS = "(SELECT document_id, section_id, heading, block, b.code AS code, b.caption AS caption, title FROM (SELECT document_id, section_id, heading, unnest(code_blocks) AS b, generate_subscripts(code_blocks, 1) - 1 AS block FROM doc_sections) JOIN (SELECT document_id, title FROM document_pages) USING (document_id) WHERE b.code IS NOT NULL AND lower(b.language) = 'java')"


@query("R17 R07 R32 W04 F06", f"""WITH blocks AS {_BLOCKS}, near AS (SELECT document_id, max_by(struct_pack(s := similarity, a := coalesce(section_heading, '')), struct_pack(s := similarity, i := id)) AS c FROM {near_cte(HYBRID, 0.0)} JOIN (SELECT id, section_heading FROM doc_chunks) USING (id) GROUP BY document_id),
known AS (SELECT document_id FROM {chunk_hits(HYBRID, _HYBRID, ['creative', 'tab', 'inventory'])} UNION SELECT document_id FROM {page_hits(HYBRID)}),
f AS (SELECT document_id, section_id, block, code, greatest(0, (c.s - 0.3) * 100 / 0.7) * CASE WHEN coalesce(heading, '') = c.a THEN 1.2 ELSE 1 END AS score FROM blocks JOIN near USING (document_id)
UNION ALL SELECT document_id, section_id, block, code, {points(HYBRID, _ON_BLOCK, 'code')} FROM blocks JOIN known USING (document_id) UNION ALL SELECT document_id, section_id, block, code, {points(HYBRID, _ON_BLOCK, 'code')} + 30 FROM blocks WHERE contains(code, 'world.notify')),
o AS (SELECT document_id, section_id, block, max(score) AS score, any_value(code) AS code FROM f GROUP BY ALL), s AS (SELECT *, section_id || '-' || block AS item, regexp_replace(code, '\\s+', ' ', 'g') AS key FROM o),
u AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, item) AS n FROM s WHERE score >= 20), r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, item) > 1 AS overflow FROM u WHERE n = 1)
SELECT document_id, section_id, block::BIGINT AS block, round(score, 4)::DOUBLE AS score, overflow FROM r ORDER BY overflow, r.score DESC, item LIMIT 15""")
def snippet_search(spark: SparkSession, d: str) -> DataFrame:
    pages, sections, chunks = (table(spark, d, t) for t in ("document_pages", "doc_sections", "doc_chunks"))
    found = S.snippets(HYBRID, pages, sections, chunks, chunks_index(spark, d), chunk_vectors(spark, d), "java", 15)
    return found.select("document_id", "section_id", F.col("block").cast("bigint").alias("block"), F.round("score", 4).alias("score"), "overflow")


_ALIASES = {"fluid tank": ["tank", "fluid handler"], "render layer": ["renderer"], "sound event": ["sounds"]}
_TERMS = ["fluid tank", "tank", "fluid handler"]
_CONCEPT = S.understand("fluid tank")
_MATCH = f"{phrase('fluid tank')} OR {has('tank')} OR {phrase('fluid handler')}"
_OCC = " + ".join(f"least(5.0 * ((length(lower(coalesce(content, ''))) - length(replace(lower(coalesce(content, '')), '{t}', ''))) / {len(t)})::INT, 25.0)" for t in _TERMS)


@query("R18 R19", f"""WITH h AS (SELECT id FROM {bm25_cte('doc_chunks', 'id', _TEXT, ['fluid', 'tank', 'handler'], _MATCH)} ORDER BY round(score, 6) DESC, id LIMIT 50),
c AS (SELECT id AS key, content, section_heading AS heading, has_code AS code, 50.0 AS base, coalesce(n.similarity, 0) * 60 AS near FROM doc_chunks JOIN h USING (id) LEFT JOIN {near_cte(_CONCEPT, 0.0, 30)} n USING (id)),
s AS (SELECT 'section-' || section_id AS key, content, heading, coalesce(len(code_blocks), 0) > 0 AS code, 40.0 AS base, 0.0 AS near FROM (SELECT DISTINCT * FROM doc_sections) WHERE {' OR '.join(f"coalesce(contains(lower({c}), '{t}'), false)" for c in ('content', 'heading') for t in _TERMS)} ORDER BY section_id LIMIT 30),
a AS (SELECT key, base + near + CASE WHEN contains(lower(content), 'fluid tank') THEN 30 ELSE 0 END + CASE WHEN contains(lower(heading), 'fluid tank') THEN 40 ELSE 0 END + {_OCC} + CASE WHEN code THEN 15 ELSE 0 END AS score FROM (SELECT * FROM c UNION ALL SELECT * FROM s))
SELECT key, round(score, 4)::DOUBLE AS score FROM a ORDER BY round(score, 4) DESC, key LIMIT 30""")
def concept_search(spark: SparkSession, d: str) -> DataFrame:
    terms = K.expand_concept("fluid tank", _ALIASES)
    similar = S.near(_CONCEPT, chunk_vectors(spark, d), 0.0, 30).select("id", "similarity")
    return K.concept_search(table(spark, d, "doc_chunks"), table(spark, d, "doc_sections"), "fluid tank", terms, chunks_index(spark, d), similar)


# ---- API symbols --------------------------------------------------------------------------------

_SYMBOL = "concat_ws(' ', fqn, regexp_replace(regexp_replace(fqn, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), simple_name)"


@query("R46 J08 W12 P05 P07 R45", f"""WITH h AS (SELECT type_id, {WORDS.format(_SYMBOL)} AS w FROM api_types), u AS (SELECT name AS simple_name, count(*) AS used FROM (SELECT DISTINCT member_id, name FROM (SELECT member_id, unnest(annotations) AS name FROM api_members)) GROUP BY 1)
SELECT type_id, fqn, CASE WHEN lower(simple_name) = 'turb' THEN 0 WHEN starts_with(lower(simple_name), 'turb') THEN 1 WHEN contains(lower(simple_name), 'turb') THEN 2 ELSE 3 END::BIGINT AS rank, (length(fqn) - length(replace(fqn, '.', '')))::BIGINT AS dots, coalesce(used, 0) AS used
FROM api_types JOIN h USING (type_id) LEFT JOIN u USING (simple_name) WHERE len(list_filter(w, lambda x: starts_with(x, 'turb'))) > 0 AND kind = 'class'""")
def api_types_search(spark: SparkSession, d: str) -> DataFrame:
    """Types by prefixes of their words, with how often members are annotated with them."""
    members = table(spark, d, "api_members").select("member_id", F.explode("annotations").alias("simple_name")).distinct()
    used = members.groupBy("simple_name").agg(F.count("*").alias("used"))
    types = table(spark, d, "api_types").join(used, "simple_name", "left").withColumn("used", F.coalesce("used", F.lit(0).cast("bigint")))
    out = S.api_members(types_index(spark, d), types, "turb", "type_id", "simple_name", F.col("kind") == "class", 100_000)
    return out.select("type_id", "fqn", F.col("rank").cast("bigint").alias("rank"), F.col("dots").cast("bigint").alias("dots"), "used")


@query("R04 R38", "WITH e(key, word) AS (VALUES ('tab', 'inventory'), ('tank', 'vessel'), ('tank', 'reservoir'), ('render', 'renderer')), w AS (SELECT DISTINCT type_id, unnest(list_filter(string_split(lower(regexp_replace(simple_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), ' '), lambda x: x <> '')) AS word FROM api_types), k AS (SELECT w.type_id, w.word, e.key FROM w JOIN e ON w.word = e.key OR w.word = e.word GROUP BY ALL), a AS (SELECT type_id, key AS other FROM k UNION SELECT type_id, e.word FROM k JOIN e USING (key)) SELECT type_id, other AS word FROM a WHERE (type_id, other) NOT IN (SELECT (type_id, word) FROM w)")
def synonym_edges(spark: SparkSession, d: str) -> DataFrame:
    """Words that synonyms add to symbols, in both directions: a key's members, and a member's key and siblings."""
    from quern.functions import identifiers as N

    edges = spark.createDataFrame([("tab", "inventory"), ("tank", "vessel"), ("tank", "reservoir"), ("render", "renderer")], "key string, member string")
    words = table(spark, d, "api_types").select("type_id", F.explode(N.words_of(F.col("simple_name"))).alias("word")).distinct()
    return N.synonyms(words, edges, "type_id", "word")


