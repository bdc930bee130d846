"""Search as its users see it: documents, code snippets, concepts and API symbols, by several strategies pooled.

A question is understood once, on the driver. Every strategy is a DataFrame of candidates with points: the
index gives at most ``HITS`` chunks, containment in titles and texts at most ``LIKED`` pages or sections,
vectors the nearest ``NEAR`` chunks. What is joined back to whole tables is therefore bounded, whatever the
corpus holds, and only then broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import versions as V
from quern.functions.text import like_any, tokens
from quern.functions.urls import page_key
from quern.operators import index as I
from quern.operators import rank as R
from quern.operators import vectors as X
from quern.session import checkpoint

HITS, LIKED, NEAR = 100, 50, 20
#: Points of a word and of the whole question by field: fixed values.
WORD = {"title": 20, "heading": 18, "caption": 15, "url": 12, "category": 10, "content": 5}
WHOLE = {"title": 100, "heading": 80, "caption": 70}
PATTERN, BESIDE, LONG_CODE, COMMON_SHARE = 25, 8, 10, 0.1


@dataclass(frozen=True)
class Question:
    """A query in parts: its words, what synonyms add, code patterns to look for, and the version it names."""

    words: tuple[str, ...]
    beside: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    version: str | None = None
    common: frozenset[str] = frozenset()

    @property
    def whole(self) -> str:
        return " ".join(self.words)

    @property
    def expression(self) -> I.Expression:
        return I.plan(list(self.words), list(self.beside))


def understand(text: str, stop: frozenset[str] = frozenset(), synonyms: dict[str, list[str]] | None = None, patterns: dict[str, list[str]] | None = None, version: str | None = None, common: frozenset[str] = frozenset()) -> Question:
    """The parts of a query; an explicit version goes before one the text names, which is no word of it.

    Code patterns are those of its words and of words that synonyms link with them.
    """
    named = re.search(r"\b\d+\.\d+(?:\.\d+)?\b", text)
    words = I.parse(re.sub(r"\b\d+\.\d+(?:\.\d+)?\b", " ", text), stop)
    beside = I.siblings(words, synonyms or {})
    codes = [p for w in [*words, *beside] for p in (patterns or {}).get(w, [])]
    return Question(tuple(words), tuple(beside), tuple(dict.fromkeys(codes)), version or (named[0] if named else None), common)


def relevance(fields: dict[str, Column], q: Question, code: Column | None = None) -> tuple[Column, Column]:
    """Additive points of a row with their reasons."""
    extra = [(F.contains(F.lower(fields[f]), F.lit(s)), BESIDE, f"{s} beside in {f}") for s in q.beside for f in ("title", "heading") if f in fields]
    if code is not None:
        extra += [(F.contains(code, F.lit(p)), PATTERN, p) for p in q.patterns] + [(F.length(code) > 50, LONG_CODE, "code")]
    weights, phrase = {f: p for f, p in WORD.items() if f in fields}, {f: p for f, p in WHOLE.items() if f in fields}
    return R.additive(fields, q.whole, list(q.words), weights, phrase, q.common, extra)


def best_hits(index: I.Index, q: Question, most: int = HITS, within: DataFrame | None = None) -> DataFrame:
    """``id, score``: the best rows of an index, ``most`` at most, among those of ``within`` if it is given."""
    found = I.search(index, q.expression)
    if within is not None:
        found = found.join(within.select("id"), "id", "left_semi")
    return found.orderBy(F.round("score", 6).desc(), "id").limit(most)


def with_fallback(hits: DataFrame, others: DataFrame) -> DataFrame:
    """The hits, or the other rows where there is no hit at all."""
    none = hits.agg(F.count("*").alias("_n")).where("_n = 0")
    return hits.unionByName(others.crossJoin(F.broadcast(none)).drop("_n"))


def in_chunks(q: Question, chunks: DataFrame, index: I.Index, filtered: bool = False) -> DataFrame:
    """Strategy 1, ``document_id, score, reasons``: index hits, else containment; the best chunk of each page.

    ``filtered`` says that the chunks are some of those indexed; hits are cut to their limit among them.
    """
    like = like_any(F.col("content"), [q.whole, *(w for w in q.words if len(w) > 2)], 3)
    found = with_fallback(best_hits(index, q, within=chunks if filtered else None).select("id"), chunks.where(like).select("id").orderBy("id").limit(HITS))
    score, reasons = relevance({"title": F.col("title"), "heading": F.col("section_heading"), "url": F.col("url"), "category": F.col("category"), "content": F.col("content")}, q)
    # HITS rows at most
    rows = chunks.join(F.broadcast(found), "id").select("document_id", score.alias("score"), reasons.alias("reasons")).where("score > 0")
    return best_reasons(rows)


def in_pages(q: Question, pages: DataFrame) -> DataFrame:
    """Strategy 2: pages whose title or text holds the words."""
    wanted = [q.whole, *(w for w in q.words if len(w) > 2)]
    like = like_any(F.col("title"), wanted, 3) | like_any(F.col("content"), wanted, 3)
    score, reasons = relevance({"title": F.col("title"), "url": F.col("url"), "category": F.col("category"), "content": F.col("content")}, q)
    rows = pages.where(like).orderBy("document_id").limit(LIKED)
    return rows.select("document_id", score.alias("score"), reasons.alias("reasons")).where("score > 0")


def in_order(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds the words one after the other, anything between them."""
    return F.coalesce(F.lower(text).rlike("(?s)" + ".*".join(re.escape(w) for w in words)), F.lit(False))


def in_sections(q: Question, sections: DataFrame) -> DataFrame:
    """Strategy 3: sections that hold the words in order in heading or text; the best of each page."""
    rows = sections.where(in_order(F.col("heading"), q.words) | in_order(F.col("content"), q.words)).orderBy("section_id", "document_id").limit(LIKED)
    score, reasons = relevance({"heading": F.col("heading"), "content": F.col("content")}, q)
    return best_reasons(rows.select("document_id", score.alias("score"), reasons.alias("reasons")).where("score > 0"))


def near(q: Question, vectors: DataFrame, floor: float, most: int = NEAR) -> DataFrame:
    """``id, document_id, similarity`` of the chunks nearest to a question, over a floor of 0 to 100."""
    asked = F.array(*(F.lit(float(x)) for x in X.hash_vector(list(q.words), X.SIZE)))
    rows = vectors.select("id", "document_id", X.cosine(F.col("embedding"), asked).alias("similarity")).where(F.col("similarity") * 100 > floor)
    return rows.orderBy(F.round("similarity", 6).desc(), "id").limit(most)


def best_reasons(rows: DataFrame) -> DataFrame:
    """The highest score of each page and all reasons of its rows."""
    return rows.groupBy("document_id").agg(F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"))


def pool(q: Question, pages: DataFrame, sections: DataFrame, chunks: DataFrame, index: I.Index, vectors: DataFrame, floor: float = 50.0, filtered: bool = False) -> DataFrame:
    """``document_id, score, reasons``: all strategies together, each page with its highest score and all reasons.

    ``filtered`` says that pages are some of all; sections, chunks and vectors are then cut to theirs before any limit.
    """
    if filtered:
        wanted = pages.select("document_id").distinct()
        sections, chunks, vectors = (t.join(wanted, "document_id", "left_semi") for t in (sections, chunks, vectors))
    close = near(q, vectors, floor).groupBy("document_id").agg((F.max("similarity") * 100).alias("score")).withColumn("reasons", F.array(F.lit("similar")))
    parts = [in_chunks(q, chunks, index, filtered), in_pages(q, pages), in_sections(q, sections), close]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return best_reasons(out)


def documents(q: Question, pages: DataFrame, sections: DataFrame, chunks: DataFrame, index: I.Index, vectors: DataFrame, limit: int = 10, floor: float = 50.0, filtered: bool = False) -> DataFrame:
    """``document_id, title, url, score, raw, reasons``: the best pages, one of each that differ in version only.

    Points are raised by closeness of version. Of pages with one address but for the version the preferred
    version wins, then its minor one, then the newest, then the score. Ties go by id. At most ``limit`` rows.
    """
    pooled = pool(q, pages, sections, chunks, index, vectors, floor, filtered)
    # the pool is bounded by the strategies' limits
    rows = pages.select("document_id", "title", "url", "minecraft_version").join(F.broadcast(pooled), "document_id")
    v = F.col("minecraft_version")
    boost = V.boost(v, q.version) if q.version else F.lit(0.0)
    rows = rows.withColumn("raw", F.round(F.col("score") + boost, 4)).withColumn("key", page_key(F.coalesce("url", F.concat(F.lit("#"), F.col("document_id")))))
    preferred = [F.when(v == q.version, 0).otherwise(1), F.when(V.minor(v) == ".".join(q.version.split(".")[:2]), 0).otherwise(1)] if q.version else []
    winners = R.best_of_group(rows, ["key"], [*preferred, F.desc_nulls_last(V.sort_key(v)), F.desc("raw"), F.asc("document_id")])
    top = winners.orderBy(F.desc("raw"), "document_id").limit(limit)
    return top.select("document_id", "title", "url", R.public_score(F.col("raw")).alias("score"), "raw", "reasons")


def assembled(hits: DataFrame, q: Question, chunks: DataFrame, most: int = 3) -> DataFrame:
    """Hits with ``sections``: headings of their first sections that hold every word, ``most`` at most.

    The hits, few by their limit, are written once, so that the search isn't run for each of their two uses.
    """
    hits = checkpoint(hits)
    low = F.lower(F.concat_ws("\n", "section_heading", "content"))
    hold = F.lit(True)
    for w in q.words:
        hold = hold & F.contains(low, F.lit(w))
    # hits are bounded by their limit
    rows = chunks.where((F.col("chunk_type") == "section") & hold).join(F.broadcast(hits.select("document_id")), "document_id")
    place = F.struct(F.coalesce("order_num", F.lit(0)).alias("o"), F.col("id").alias("i"), F.coalesce("section_heading", F.lit("")).alias("h"))
    first = rows.groupBy("document_id").agg(F.slice(F.array_sort(F.collect_list(place)), 1, most).alias("s"))
    return hits.join(first, "document_id", "left").withColumn("sections", F.coalesce(F.transform("s", lambda x: x["h"]), F.array().cast("array<string>"))).drop("s")


def snippets(q: Question, pages: DataFrame, sections: DataFrame, chunks: DataFrame, index: I.Index, vectors: DataFrame, language: str | None = None, limit: int = 5, per_page: int = 1, floor: float = 20.0) -> DataFrame:
    """``document_id, section_id, block, score, overflow``: code blocks by all strategies, few of a page.

    Blocks of pages near in vectors get ``(similarity - 0.3) * 100 / 0.7``, 1.2 times as much in the very
    section; blocks of pages that the index or containment finds, and blocks that hold a code pattern (30
    points), get the additive points. A block has its highest score. What differs in white space only is
    one block; a page gives ``per_page`` unless places stay empty.
    """
    blocks = sections.select("document_id", "section_id", "heading", F.posexplode("code_blocks").alias("block", "b")).where("b.code is not null").select(
        "document_id", "section_id", "heading", "block", F.col("b.code").alias("code"), F.col("b.caption").alias("caption"), F.col("b.language").alias("language")
    )
    if language:
        blocks = blocks.where(F.lower("language") == language.lower())
    blocks = blocks.join(pages.select("document_id", "title"), "document_id")
    # the chunks near in vectors, and the pages of the other strategies, are bounded by their limits
    close = near(q, vectors, 0.0).join(chunks.select("id", F.col("section_heading").alias("at")), "id")
    close = close.groupBy("document_id").agg(F.max_by(F.struct("similarity", F.coalesce("at", F.lit("")).alias("at")), F.struct("similarity", "id")).alias("c"))
    base = F.greatest(F.lit(0.0), (F.col("c.similarity") - 0.3) * 100 / 0.7)
    similar = blocks.join(F.broadcast(close), "document_id").withColumn("score", base * F.when(F.coalesce("heading", F.lit("")) == F.col("c.at"), 1.2).otherwise(1.0))
    known = in_chunks(q, chunks, index).select("document_id").unionByName(in_pages(q, pages).select("document_id")).distinct()
    points, _ = relevance({"title": F.col("title"), "heading": F.col("heading"), "caption": F.col("caption"), "content": F.col("code")}, q, F.col("code"))
    lexical = blocks.join(F.broadcast(known), "document_id").withColumn("score", points)
    columns = ["document_id", "section_id", "block", "code", "score"]
    found = similar.select(*columns).unionByName(lexical.select(*columns))
    if q.patterns:
        hold = F.lit(False)
        for p in q.patterns:
            hold = hold | F.contains("code", F.lit(p))
        found = found.unionByName(blocks.where(hold).withColumn("score", points + 30.0).select(*columns))
    once = found.groupBy("document_id", "section_id", "block").agg(F.max("score").alias("score"), F.first("code").alias("code"))
    scored = once.withColumn("item", F.concat_ws("-", "section_id", "block")).withColumn("key", F.md5(F.regexp_replace("code", r"\s+", " ")))
    return R.capped(scored, "item", "document_id", "score", "key", per_page, limit, floor).select("document_id", "section_id", "block", "score", "overflow")


def api_members(index: I.Index, rows: DataFrame, query: str, id_col: str, name: str, where: Column | None = None, limit: int = 15) -> DataFrame:
    """Symbols of which every word begins one of the query's: by how the name fits, dots, use, BM25 and id.

    ``rows`` has id, name, fqn and used. Without a hit, containment in the name takes the place of the
    index. A query of signs only gives nothing.
    """
    words = I.parse(query, least=1)
    if not words:
        return rows.where("false").withColumn("rank", F.lit(0)).withColumn("dots", F.lit(0)).withColumn("score", F.lit(0.0))
    terms = tuple(I.Term(w, prefix=True) for w in words)
    hits = I.search(index, terms[0] if len(terms) == 1 else I.And(terms))
    like = rows.where(F.contains(F.lower(name), F.lit(query.lower().strip()))).select(F.col(id_col).alias("id"), F.lit(0.0).alias("score"))
    found = with_fallback(hits, like)
    low, whole = F.lower(name), query.lower().strip()
    rank = F.when(low == whole, 0).when(F.startswith(low, F.lit(whole)), 1).when(F.contains(low, F.lit(whole)), 2).otherwise(3)
    dots = F.length("fqn") - F.length(F.replace("fqn", F.lit("."), F.lit("")))
    out = rows.where(where) if where is not None else rows
    out = out.join(found.withColumnRenamed("id", id_col), id_col).withColumn("rank", rank).withColumn("dots", dots)
    return out.orderBy("rank", "dots", F.desc("used"), F.round("score", 6).desc(), id_col).limit(limit)


def symbol_text(*columns: Column) -> Column:
    """Search text of a symbol: full names, their parts and the words of those."""
    from quern.functions.text import camel_words

    parts = [F.concat(F.array(F.coalesce(c, F.lit(""))), camel_words(F.coalesce(c, F.lit("")))) for c in columns]
    return F.array_join(F.array_distinct(F.flatten(F.array(*parts))), " ")


def coverage(pooled: DataFrame, reachable: DataFrame, limit: int) -> DataFrame:
    """One row, ``found, reachable, ceiling``: whether the result is all a filter can reach, or cut by the limit."""
    counts = pooled.agg(F.count("*").alias("found")).crossJoin(F.broadcast(reachable.agg(F.count("*").alias("reachable"))))
    state = F.when(F.col("found") == 0, "none").when(F.col("found") >= F.col("reachable"), "all reachable").when(F.col("found") >= limit, "limit").otherwise("part")
    return counts.withColumn("ceiling", state)


__all__ = ["Question", "api_members", "assembled", "best_hits", "coverage", "documents", "in_chunks", "in_pages", "in_sections", "near", "pool", "relevance", "snippets", "symbol_text", "tokens", "understand", "with_fallback"]
