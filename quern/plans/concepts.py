"""Queries for concepts, snippets, examples, correspondences and type details."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import javadoc
from quern.operators import concepts as K
from quern.plans.registry import query
from quern.plans.retrieval import WORDS, _bm25_sql
from quern.plans.searching import bm25_cte, chunks_index, items_index
from quern.sources import table

_ALIASES = {"render layer": ["renderer"], "sound event": ["sounds"]}


@query("A19 R33", "WITH v AS (SELECT sum(CASE WHEN contains(lower(content), 'render layer') THEN 3 ELSE 0 END + CASE WHEN contains(lower(content), 'renderer') THEN 1 ELSE 0 END)::BIGINT AS r, sum(CASE WHEN contains(lower(content), 'sound event') THEN 3 ELSE 0 END + CASE WHEN contains(lower(content), 'sounds') THEN 1 ELSE 0 END)::BIGINT AS s FROM doc_chunks) SELECT 'render layer' AS concept, r AS votes FROM v WHERE r > 0 UNION ALL SELECT 'sound event', s FROM v WHERE s > 0")
def related_concepts(spark: SparkSession, d: str) -> DataFrame:
    return K.related(table(spark, d, "doc_chunks"), _ALIASES)


@query("R53 W05 F12", f"""WITH r AS (SELECT id, score, word_count FROM {bm25_cte('doc_chunks', 'id', "concat_ws(chr(10), section_heading, content)", ['debug', 'stale'], "len(list_filter(w, lambda x: x LIKE 'debug%' OR x LIKE 'stale%')) > 0", ('debug', 'stale'))} JOIN (SELECT id, word_count FROM doc_chunks WHERE has_code AND contains(content, 'world.notify')) USING (id)),
c AS (SELECT id, -round(score, 6) AS x, word_count FROM r ORDER BY round(score, 6) DESC, id LIMIT 50), b AS (SELECT min(x) AS best FROM c)
SELECT id, floor((x - best) / greatest(abs(best) * 0.02, 0.05))::BIGINT AS band FROM c, b ORDER BY band, word_count DESC NULLS LAST, x, id LIMIT 10""")
def example_search(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "doc_chunks")
    return K.example_search(rows, chunks_index(spark, d), "world.notify debug stale", "id", F.col("content"), F.col("word_count"), F.col("has_code"), 10)


_E = _bm25_sql("eval_items", "item_id", "text", ["cartographer", "windmill"], "list_contains(w, 'cartographer') OR list_contains(w, 'windmill')", "suite = 'modqa'", 15)


@query("R62", _E)
def correspondence_search(spark: SparkSession, d: str) -> DataFrame:
    rows = K.correspondence_search(table(spark, d, "eval_items"), items_index(spark, d), "item_id", "Cartographer windmill at", F.col("suite") == "modqa")
    return rows.withColumnRenamed("id", "item_id")


@query("R48 R45 W17", "WITH m AS (SELECT DISTINCT member_id, type_id, kind, name FROM api_members), s AS (SELECT type_id, count(*) AS members FROM (SELECT *, row_number() OVER (PARTITION BY type_id, kind ORDER BY name NULLS FIRST, member_id) AS n FROM m) WHERE n <= 5 GROUP BY 1), n AS (SELECT outer_fqn AS fqn, count(*) AS nested FROM api_types WHERE outer_fqn IS NOT NULL GROUP BY 1), b AS (SELECT regexp_replace(extends_raw, '<.*$', '') AS simple_name, count(*) AS subclasses, list(fqn ORDER BY fqn)[1:20] AS names FROM api_types WHERE extends_raw IS NOT NULL GROUP BY 1) SELECT type_id, coalesce(members, 0) AS members, coalesce(nested, 0) AS nested, coalesce(subclasses, 0) AS subclasses, coalesce(names, []) AS subclass_names FROM api_types LEFT JOIN s USING (type_id) LEFT JOIN n USING (fqn) LEFT JOIN b USING (simple_name)", lists=("subclass_names",))
def type_details(spark: SparkSession, d: str) -> DataFrame:
    return K.details(table(spark, d, "api_types"), table(spark, d, "api_members"), 5)


_BARE = r"regexp_replace(regexp_replace(trim(javadoc, ' ' || chr(10) || chr(13) || chr(9)), '^[ \t]*/\*+|\*+/[ \t]*$', '', 'g'), '(?m)^[ \t]*\*+ ?', '', 'g')"
_BODY = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '\{@\w+\s*([^{}#]*)#([^{}#]*)\}', '\1.\2', 'g'), '\{@\w+\s*([^{}#]*)\}', '\1', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("T15", rf"SELECT member_id, {_BODY} AS body, nullif(trim(regexp_extract(t, '(?m)^\s*@since\s+(.*)$', 1)), '') AS since FROM (SELECT member_id, t, regexp_replace(t, '(?s)(^|\n)[ \t]*@\w+.*$', '') AS b FROM (SELECT member_id, {_BARE} AS t FROM (SELECT DISTINCT member_id, javadoc FROM api_members WHERE length(trim(javadoc, ' ' || chr(10) || chr(13) || chr(9))) > 0)))")
def javadoc_bodies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "api_members").where(F.length(F.trim("javadoc")) > 0).select("member_id", "javadoc").distinct()
    return rows.select("member_id", javadoc.parsed(F.col("javadoc")).alias("p")).select("member_id", "p.body", "p.since")


@query("T15")
def javadoc_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "api_members").where("javadoc is not null").select("member_id", "javadoc").distinct()
    return rows.select("member_id", javadoc.parsed(F.col("javadoc")).alias("p")).select("member_id", "p.*")


@query("R03 R05", f"WITH q AS (SELECT item_id, list_filter({WORDS.format('text')}, lambda x: length(x) > 1 AND x NOT IN ('the', 'and', 'of', 'to', 'in', 'by', 'if', 'as', 'for')) AS words FROM eval_items) SELECT item_id, words FROM q", lists=('words',))
def query_tokens(spark: SparkSession, d: str) -> DataFrame:
    from quern.functions.text import tokens

    stop = ["the", "and", "of", "to", "in", "by", "if", "as", "for"]
    return table(spark, d, "eval_items").select("item_id", F.filter(tokens(F.col("text")), lambda x: (F.length(x) > 1) & ~x.isin(*stop)).alias("words"))
