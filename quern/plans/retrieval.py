"""Retrieval queries on the test tables: index, BM25, scores, fusion, vectors and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import index as I
from quern.operators import rank as R
from quern.operators import vectors as X
from quern.plans.registry import query
from quern.plans.searching import documents_index, pages_index
from quern.sources import table

WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _bm25_sql(source: str, id_col: str, text: str, terms: list[str], match: str, where: str = "true", limit: int = 20, prefix: tuple[str, ...] = ()) -> str:
    count = lambda t: f"len(list_filter(w, lambda x: x LIKE '{t}%'))" if t in prefix else f"len(list_filter(w, lambda x: x = '{t}'))"
    df = ", ".join(f"count(*) FILTER (WHERE {count(t)} > 0) AS df{i}" for i, t in enumerate(terms))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * {count(t)} * 2.2 / ({count(t)} + 1.2 * (0.25 + 0.75 * len(w) / mean))" for i, t in enumerate(terms))
    return f"""WITH d AS (SELECT *, {WORDS.format(text)} AS w FROM {source}),
f AS (SELECT count(*) AS n, avg(len(w)) AS mean, {df} FROM d)
SELECT {id_col}, round({score}, 4) AS score FROM d, f WHERE ({match}) AND ({where})
ORDER BY round({score}, 4) DESC, {id_col} LIMIT {limit}"""


def _top(rows: DataFrame, id_col: str, limit: int = 20) -> DataFrame:
    return rows.select(F.col("id").alias(id_col), F.round("score", 4).alias("score")).orderBy(F.desc("score"), id_col).limit(limit)


def _has(t: str) -> str:
    return f"list_contains(w, '{t}')"


@query("R01 R02 R05 R63 F11 W07", _bm25_sql("documents", "doc_id", "text", ["particle", "factory", "reload"], " OR ".join(map(_has, ["particle", "factory", "reload"]))))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    e = I.Or((I.Term("particle"), I.Term("factory"), I.Term("reload")))
    return _top(I.search(documents_index(spark, d), e), "doc_id")


@query("R02 F01 F02", _bm25_sql("documents", "doc_id", "text", ["registry", "event"], f"{_has('registry')} OR {_has('event')}", "lang = 'en' AND kind IN ('forum', 'guide')"))
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    e = I.Or((I.Term("registry"), I.Term("event")))
    wanted = table(spark, d, "documents").where((F.col("lang") == "en") & F.col("kind").isin("forum", "guide")).select(F.col("doc_id").alias("id"))
    return _top(wanted.join(I.search(documents_index(spark, d), e), "id"), "doc_id")


@query("R05 F11", _bm25_sql("documents", "doc_id", "text", ["block", "state", "mapper"], "contains(' ' || array_to_string(w, ' ') || ' ', ' block state mapper ')"))
def bm25_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _top(I.search(documents_index(spark, d), I.Phrase(("block", "state", "mapper"))), "doc_id")


@query("R05 F11", _bm25_sql("documents", "doc_id", "text", ["golem", "biome"], f"{_has('golem')} AND {_has('biome')}"))
def bm25_and(spark: SparkSession, d: str) -> DataFrame:
    return _top(I.search(documents_index(spark, d), I.And((I.Term("golem"), I.Term("biome")))), "doc_id")


@query("F11", _bm25_sql("documents", "doc_id", "text", ["deserial"], "len(list_filter(w, lambda x: x LIKE 'deserial%')) > 0", prefix=("deserial",)))
def bm25_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _top(I.search(documents_index(spark, d), I.Term("deserial", prefix=True)), "doc_id")


_POSTINGS = f"WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS term, len(w) AS length FROM d), i AS (SELECT term, doc_id, length, count(*) AS tf FROM p GROUP BY ALL)"


@query("R01", _POSTINGS + " SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM i GROUP BY term")
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return documents_index(spark, d).terms.select("term", "df", "cf")


@query("R01", _POSTINGS + " SELECT term, doc_id, tf, length::BIGINT AS length FROM i")
def postings_df(spark: SparkSession, d: str) -> DataFrame:
    out = I.postings(table(spark, d, "documents"), "doc_id", F.col("text"))
    return out.select("term", F.col("id").alias("doc_id"), "tf", F.col("length").cast("bigint"))


_BATCH = (
    _POSTINGS
    + f""", f AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d), s AS (SELECT term, count(*) AS df FROM i GROUP BY term),
q AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS.format('text')}) AS term FROM eval_items),
x AS (SELECT query_id, doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
      FROM q JOIN s USING (term) JOIN i USING (term), f GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM x)
SELECT query_id, doc_id, round(score, 3) AS score, rank FROM r WHERE rank <= 3"""
)


@query("R02 R09 J01", _BATCH)
def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "eval_items").selectExpr("item_id as query_id", "text")
    out = I.batch(documents_index(spark, d), asked, 3)
    return out.select("query_id", F.col("id").alias("doc_id"), F.round("score", 3).alias("score"), F.col("rank").cast("bigint"))


# ---- LIKE retrieval and additive scores ---------------------------------------------------------

_LIKE3 = "(lower(content) LIKE '%block entity%' OR lower(content) LIKE '%render layer%' OR lower(content) LIKE '%sound event%')"


@query("F08 R06 R10 W08", f"SELECT document_id, title FROM document_pages WHERE {_LIKE3} ORDER BY document_id LIMIT 50")
def like_any3(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "document_pages").where(T.like_any(F.col("content"), ["block entity", "render layer", "sound event", "not reached"], 3))
    return found.select("document_id", "title").orderBy("document_id").limit(50)


def _score_sql(word: str) -> str:
    c = lambda f, t, p: f"CASE WHEN contains(lower({f}), '{t}') THEN {p} ELSE 0 END"
    return " + ".join([c("title", "registry event", 100), *(c(f, t, p * (0.1 if t == "the" else 1)) for t in ("registry", "event", "the") for f, p in (("title", 20), ("url", 12), ("category", 10), ("content", 5)))])


@query("R08 R10 U02", f"SELECT document_id, round({_score_sql('')}, 4) AS score FROM document_pages WHERE {_score_sql('')} > 0 ORDER BY score DESC, document_id LIMIT 30")
def score_additive(spark: SparkSession, d: str) -> DataFrame:
    return _scored_pages(spark, d).select("document_id", "score").orderBy(F.desc("score"), "document_id").limit(30)


def _scored_pages(spark: SparkSession, d: str) -> DataFrame:
    fields = {n: F.col(n) for n in ("title", "url", "category", "content")}
    score, reasons = R.additive(fields, "registry event", ["registry", "event", "the"], {"title": 20, "url": 12, "category": 10, "content": 5}, {"title": 100}, frozenset(["the"]))
    return table(spark, d, "document_pages").select("document_id", "url", F.round(score, 4).alias("score"), reasons.alias("reasons")).where("score > 0")


@query("R08", "SELECT document_id, CASE WHEN contains(lower(title), 'registry event') THEN 1 ELSE 0 END::BIGINT + " + " + ".join(f"CASE WHEN contains(lower({f}), '{t}') THEN 1 ELSE 0 END" for t in ("registry", "event", "the") for f in ("title", "url", "category", "content")) + f" AS reasons FROM document_pages WHERE {_score_sql('')} > 0")
def score_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _scored_pages(spark, d).select("document_id", F.size("reasons").cast("bigint").alias("reasons"))


_CHUNK_SCORE = "CASE WHEN contains(lower(content), 'fluid tank') THEN 50 ELSE 0 END + CASE WHEN contains(lower(section_heading), 'fluid') THEN 18 ELSE 0 END + CASE WHEN has_code THEN 10 ELSE 0 END"


def _scored_chunks(spark: SparkSession, d: str) -> DataFrame:
    fields = {"content": F.col("content"), "heading": F.col("section_heading")}
    score, _ = R.additive(fields, "fluid tank", [], {}, {"content": 50}, extra=[(F.contains(F.lower("section_heading"), F.lit("fluid")), 18, "heading"), (F.col("has_code"), 10, "code")])
    return table(spark, d, "doc_chunks").select("id", "document_id", "order_num", "content", "section_heading", score.alias("score")).where("score > 0")


@query("A16 R09 R12", f"WITH s AS (SELECT *, ({_CHUNK_SCORE})::DOUBLE AS score FROM doc_chunks) SELECT document_id, max(score) AS score, count(*) AS hits, min_by(id, (order_num, id)) AS id FROM s WHERE score > 0 GROUP BY document_id")
def max_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return R.max_per_group(_scored_chunks(spark, d), "document_id", "score", ["id"], ["order_num", "id"])


@query("A17 R11", f"WITH s AS (SELECT *, ({_CHUNK_SCORE})::DOUBLE AS score FROM doc_chunks), r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, order_num NULLS FIRST, id) AS n FROM s WHERE score > 0) SELECT document_id, id, score FROM r WHERE n = 1")
def best_section(spark: SparkSession, d: str) -> DataFrame:
    best = R.best_of_group(_scored_chunks(spark, d), ["document_id"], [F.desc("score"), F.asc("order_num"), F.asc("id")])
    return best.select("document_id", "id", "score")


@query("W04", f"""WITH s AS (SELECT *, ({_CHUNK_SCORE})::DOUBLE AS score, content AS key FROM doc_chunks),
u AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, id) AS n FROM s WHERE score >= 20),
o AS (SELECT *, document_id IS NOT NULL AND row_number() OVER (PARTITION BY document_id ORDER BY score DESC, id) > 2 AS overflow FROM u WHERE n = 1)
SELECT id, document_id, score, overflow FROM o ORDER BY overflow, score DESC, id LIMIT 40""")
def cap_backfill(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored_chunks(spark, d).withColumn("key", F.sha2("content", 256))
    return R.capped(rows, "id", "document_id", "score", "key", 2, 40, 20).select("id", "document_id", "score", "overflow")


@query("W05", """WITH r AS (SELECT p_partkey, -(p_retailprice / 100) AS relevance, p_size FROM part), b AS (SELECT min(relevance) AS best FROM r)
SELECT p_partkey, floor((relevance - best) / greatest(abs(best) * 0.02, 0.05))::BIGINT AS band, p_size FROM r, b ORDER BY band, p_size DESC, p_partkey LIMIT 25""")
def relevance_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", (-(F.col("p_retailprice") / 100)).alias("relevance"), "p_size")
    return R.bands(rows, "relevance", [F.desc("p_size"), F.asc("p_partkey")], 25).select("p_partkey", "band", "p_size")


@query("W06", """WITH a AS (SELECT 1 AS list, type_id AS id, row_number() OVER (ORDER BY length(fqn), type_id) AS n FROM api_types WHERE contains(lower(simple_name), 'quarry')),
b AS (SELECT 2 AS list, member_id AS id, row_number() OVER (ORDER BY l, member_id) AS n FROM (SELECT DISTINCT member_id, length(name) AS l FROM api_members WHERE contains(lower(name), 'quarry'))),
c AS (SELECT least((SELECT count(*) FROM a), 15) AS na, least((SELECT count(*) FROM b), 15) AS nb)
SELECT list, id FROM a, c WHERE n <= greatest(10, 15 - least(nb, 5)) AND n <= 15
UNION ALL SELECT list, id FROM b, c WHERE n <= 15 - least(na, greatest(10, 15 - least(nb, 5)))""")
def quota_merge(spark: SparkSession, d: str) -> DataFrame:
    types = table(spark, d, "api_types").where(F.contains(F.lower("simple_name"), F.lit("quarry"))).select(F.col("type_id").alias("id"), F.length("fqn").alias("l"))
    members = table(spark, d, "api_members").where(F.contains(F.lower("name"), F.lit("quarry"))).select(F.col("member_id").alias("id"), F.length("name").alias("l")).distinct()
    return R.quota_merge(types, members, ["l", "id"], 15).select("list", "id")


@query("W15", "WITH r AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS turn FROM supplier) SELECT s_suppkey, s_nationkey, turn FROM r ORDER BY turn, s_nationkey LIMIT 60")
def interleave_rr(spark: SparkSession, d: str) -> DataFrame:
    out = R.interleave(table(spark, d, "supplier"), "s_nationkey", [F.desc("s_acctbal"), F.asc("s_suppkey")], 60)
    return out.select("s_suppkey", "s_nationkey", F.col("turn").cast("bigint"))


# ---- vectors ------------------------------------------------------------------------------------

_VEC = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL)"
_COS = "list_dot_product(a.v, q.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(q.v, q.v)))"


@query("R20 R21 J05", f"SELECT a.vec_id, round({_COS}, 5) AS score FROM {_VEC} a, (SELECT * FROM {_VEC} WHERE vec_id = 7) q WHERE a.label <= 5 ORDER BY round({_COS}, 6) DESC, vec_id LIMIT 20")
def cosine_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id = 7").select(F.col("embedding").alias("q")).limit(1)
    out = rows.where("label <= 5").join(F.broadcast(asked)).select("vec_id", X.cosine(F.col("embedding"), F.col("q")).alias("score"))
    return out.orderBy(F.round("score", 6).desc(), "vec_id").limit(20).select("vec_id", F.round("score", 5).alias("score"))


@query("R20 R22 W10", f"""WITH v AS (SELECT * FROM {_VEC}), x AS (SELECT q.vec_id AS query_id, a.vec_id AS id, {_COS} AS score FROM v a JOIN v q ON q.vec_id % 50 = 0 AND a.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM x) SELECT query_id, id, round(score, 5) AS score, rank FROM r WHERE rank <= 10""")
def cosine_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return X.top_k(rows, asked, "vec_id", "embedding", 10).select("query_id", "id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint"))


@query("R12 F26 A16", f"SELECT a.label::BIGINT AS label, round(max({_COS}) * 100, 3) AS score, count(*) AS n FROM {_VEC} a, (SELECT * FROM {_VEC} WHERE vec_id = 3) q WHERE {_COS} * 100 > 5 GROUP BY a.label")
def cosine_threshold_maxlabel(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").where("embedding is not null")
    asked = rows.where("vec_id = 3").select(F.col("embedding").alias("q")).limit(1)
    out = rows.join(F.broadcast(asked)).select(F.col("label").cast("bigint"), (X.cosine(F.col("embedding"), F.col("q")) * 100).alias("score")).where("score > 5")
    return out.groupBy("label").agg(F.round(F.max("score"), 3).alias("score"), F.count("*").alias("n"))


# ---- fusion -------------------------------------------------------------------

_LEX = _bm25_sql("document_pages", "document_id", "content", ["creative", "tab"], f"{_has('creative')} OR {_has('tab')}", limit=50)


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    e = I.Or((I.Term("creative"), I.Term("tab")))
    return _top(I.search(pages_index(spark, d), e), "document_id", 50)


def _titles(spark: SparkSession, d: str) -> DataFrame:
    score, _ = R.additive({"title": F.col("title"), "url": F.col("url")}, "creative tab", ["creative", "tab"], {"title": 20, "url": 12}, {"title": 100})
    return table(spark, d, "document_pages").select("document_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "document_id").limit(50)


_TIT = "(SELECT document_id, (CASE WHEN contains(lower(title), 'creative tab') THEN 100 ELSE 0 END + " + " + ".join(f"CASE WHEN contains(lower({f}), '{t}') THEN {p} ELSE 0 END" for t in ("creative", "tab") for f, p in (("title", 20), ("url", 12))) + ")::DOUBLE AS score FROM document_pages)"
_TITLES = f"SELECT document_id, score FROM {_TIT} WHERE score > 0 ORDER BY score DESC, document_id LIMIT 50"


def _ranked(rows: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "document_id")))


@query("R25 U02 U03", f"""WITH a AS (SELECT *, row_number() OVER (ORDER BY score DESC, document_id) AS rank FROM ({_LEX})), b AS (SELECT *, row_number() OVER (ORDER BY score DESC, document_id) AS rank FROM ({_TITLES})),
u AS (SELECT document_id, 1.0 / (60 + rank) AS part FROM a UNION ALL SELECT document_id, 1.0 / (60 + rank) FROM b)
SELECT document_id, round(sum(part)::DOUBLE, 8) AS score, count(*) AS lists FROM u GROUP BY document_id""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    out = R.reciprocal([_ranked(_lexical(spark, d)), _ranked(_titles(spark, d))], "document_id")
    return out.select("document_id", F.round("score", 8).alias("score"), "lists")


@query("R24", f"""WITH a0 AS ({_LEX}), b0 AS ({_TITLES}),
a AS (SELECT document_id, CASE WHEN (SELECT max(score) > min(score) FROM a0) THEN (score - (SELECT min(score) FROM a0)) / (SELECT max(score) - min(score) FROM a0) ELSE 1.0 END AS s FROM a0),
b AS (SELECT document_id, CASE WHEN (SELECT max(score) > min(score) FROM b0) THEN (score - (SELECT min(score) FROM b0)) / (SELECT max(score) - min(score) FROM b0) ELSE 1.0 END AS s FROM b0)
SELECT document_id, round(0.6 * coalesce(a.s, 0) + 0.4 * coalesce(b.s, 0), 4) AS score FROM a FULL JOIN b USING (document_id)""")
def weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    return R.weighted(_lexical(spark, d), _titles(spark, d), "document_id", "score", 0.6).select("document_id", F.round("score", 4).alias("score"))
