"""Search for concepts, snippets, examples and correspondences, and the detail of a type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import identifier_like, like_any
from quern.operators import index as I
from quern.operators import rank as R


def expand_concept(concept: str, aliases: dict[str, list[str]]) -> list[str]:
    """The concept and the aliases of every entry whose key or alias holds it or is held by it, each once."""
    low = concept.lower().strip()
    out = [low]
    for key, others in aliases.items():
        names = [key, *others]
        if any(low in n.lower() or n.lower() in low for n in names):
            out.extend(n.lower() for n in names)
    return list(dict.fromkeys(out))


def occurrences(text: Column, term: str) -> Column:
    """How often a term occurs in a text, signs taken literally."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return ((F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / len(term)).cast("int")


def concept_search(chunks: DataFrame, sections: DataFrame, concept: str, terms: list[str], index: I.Index, similar: DataFrame, limit: int = 30) -> DataFrame:
    """``key, score``: chunks and sections for a concept, by points for strategy, similarity, mentions, counts and code.

    The best 50 chunks of the index have 50 points, 30 sections that hold a term 40. ``similar`` has id and
    similarity of the nearest chunks; they add points to chunks found, but no chunks of their own. A
    section's key is its id behind ``section-``.
    """
    asked = tuple(I.Term(w[0]) if len(w) == 1 else I.Phrase(tuple(w)) for w in (I.parse(t, least=1) for t in terms))
    hits = I.search(index, I.Or(asked)).orderBy(F.round("score", 6).desc(), "id").limit(50).select("id")
    # both sides are bounded by their limits
    near = hits.join(F.broadcast(similar), "id", "left")
    found = chunks.join(F.broadcast(near), "id").select(F.col("id").alias("key"), "content", F.col("section_heading").alias("heading"), F.col("has_code").alias("code"), F.lit(50.0).alias("base"), (60.0 * F.coalesce("similarity", F.lit(0.0))).alias("near"))
    hold = like_any(F.col("content"), terms) | like_any(F.col("heading"), terms)
    of_sections = sections.where(hold).distinct().orderBy("section_id").limit(30).select(
        F.concat(F.lit("section-"), "section_id").alias("key"), "content", "heading", (F.coalesce(F.size("code_blocks"), F.lit(0)) > 0).alias("code"), F.lit(40.0).alias("base"), F.lit(0.0).alias("near")
    )
    score = F.col("base") + F.col("near") + F.when(F.contains(F.lower("content"), F.lit(concept)), 30.0).otherwise(0.0) + F.when(F.contains(F.lower("heading"), F.lit(concept)), 40.0).otherwise(0.0)
    for t in terms:
        if len(t) >= 3:
            score = score + F.least(5.0 * occurrences(F.col("content"), t), F.lit(25.0))
    score = score + F.when(F.coalesce("code", F.lit(False)), 15.0).otherwise(0.0)
    return found.unionByName(of_sections).select("key", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "key").limit(limit)


def related(chunks: DataFrame, concepts: dict[str, list[str]], most: int = 8) -> DataFrame:
    """``concept, votes``: 3 for every chunk that names a concept, 1 for every alias it names."""
    votes = []
    for name, others in concepts.items():
        vote = F.when(F.contains(F.lower("content"), F.lit(name)), 3).otherwise(0)
        for a in others:
            vote = vote + F.when(F.contains(F.lower("content"), F.lit(a)), 1).otherwise(0)
        votes.append(F.coalesce(F.sum(vote), F.lit(0)).alias(name))
    row = chunks.agg(*votes)
    pairs = F.array(*(F.struct(F.lit(n).alias("concept"), F.col(f"`{n}`").alias("votes")) for n in concepts))
    return row.select(F.inline(pairs)).where("votes > 0").orderBy(F.desc("votes"), "concept").limit(most)


def example_search(rows: DataFrame, index: I.Index, query: str, id_col: str, code: Column, quality: Column, where: Column | None = None, limit: int = 5) -> DataFrame:
    """``id, band``: rows by bands of BM25, then by quality; code words of the query must occur as they are.

    The words of the query are prefixes, any of which counts; rareness is that of the whole corpus, whatever
    code words and filters leave. The best ``max(5 * limit, 50)`` are banded.
    """
    terms = query.split()
    hold = where if where is not None else F.lit(True)
    for t in terms:
        if identifier_like(t):
            hold = hold & F.contains(code, F.lit(t))
    prose = tuple(I.Term(w, prefix=True) for t in terms if not identifier_like(t) for w in I.parse(t))
    kept = rows.where(hold).select(F.col(id_col).alias("id"), quality.alias("quality"))
    if not prose:
        return kept.orderBy(F.desc_nulls_last("quality"), "id").limit(limit).select("id", F.lit(0).cast("bigint").alias("band"))
    found = kept.join(I.search(index, prose[0] if len(prose) == 1 else I.Or(prose)), "id")
    candidates = found.orderBy(F.round("score", 6).desc(), "id").limit(max(5 * limit, 50))
    banded = R.bands(candidates.withColumn("relevance", -F.round("score", 6)), "relevance", [F.desc_nulls_last("quality"), F.asc("relevance"), F.asc("id")], limit)
    return banded.select("id", F.col("band").cast("bigint").alias("band"))


def featured(rows: DataFrame, group: str, quality: Column, most: int, least: int = 1) -> DataFrame:
    """The best ``most`` rows of every group that has ``least`` or more, with the group's size and their place."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(F.desc_nulls_last("_q"), "id"))
    best = rows.withColumn("_q", quality).withColumn("place", n).where(F.col("place") <= most).drop("_q")
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("examples")).where(F.col("examples") >= least)
    return best.join(sizes, best[group].eqNullSafe(F.col("_g"))).drop("_g").withColumn("place", F.col("place").cast("bigint"))


def correspondence_search(entries: DataFrame, index: I.Index, id_col: str, query: str, where: Column | None = None, limit: int = 15) -> DataFrame:
    """``id, score`` of entries by BM25 over the words of three letters or more; without any, a plain list by id."""
    words = tuple(I.Term(w) for w in I.parse(query, least=3))
    rows = (entries.where(where) if where is not None else entries).select(F.col(id_col).alias("id"))
    if not words:
        return rows.orderBy("id").limit(limit).withColumn("score", F.lit(0.0))
    found = rows.join(I.search(index, words[0] if len(words) == 1 else I.Or(words)), "id")
    return found.select("id", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def details(types: DataFrame, members: DataFrame, most: int = 40, subclasses: int = 20) -> DataFrame:
    """``type_id, members, nested, subclasses, subclass_names``: what a type's page shows, for all types at once."""
    once = members.select("member_id", "type_id", "kind", "name").distinct()
    n = F.row_number().over(Window.partitionBy("type_id", "kind").orderBy("name", "member_id"))
    shown = once.withColumn("n", n).where(F.col("n") <= most).groupBy("type_id").agg(F.count("*").alias("members"))
    nested = types.where("outer_fqn is not null").groupBy(F.col("outer_fqn").alias("fqn")).agg(F.count("*").alias("nested"))
    below = types.where("extends_raw is not null").select(F.regexp_replace("extends_raw", r"<.*$", "").alias("simple_name"), F.col("fqn").alias("sub"))
    below = below.withColumn("k", F.row_number().over(Window.partitionBy("simple_name").orderBy("sub")))
    below = below.groupBy("simple_name").agg(F.count("*").alias("subclasses"), F.array_sort(F.collect_list(F.when(F.col("k") <= subclasses, F.col("sub")))).alias("subclass_names"))
    zero = F.lit(0).cast("bigint")
    out = types.select("type_id", "fqn", "simple_name").join(shown, "type_id", "left").join(nested, "fqn", "left").join(below, "simple_name", "left")
    return out.select("type_id", F.coalesce("members", zero).alias("members"), F.coalesce("nested", zero).alias("nested"), F.coalesce("subclasses", zero).alias("subclasses"), F.coalesce("subclass_names", F.array().cast("array<string>")).alias("subclass_names"))
