"""The problems' queries on the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import apidoc, leak, licence, mainbody, merkle, pii, split, tokenise, unify
from quern.sources import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apidoc.documented(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "api_members"), full=False)


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs themselves: name, signature and description."""
    return apidoc.documented(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "api_members"))


def _licences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    repos = licence.repo_licences(table(spark, sf_dir, "roster_repos"), table(spark, sf_dir, "repo_files"))
    return repos, licence.file_licences(table(spark, sf_dir, "source_files"), repos)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos, files = _licences(spark, sf_dir)
    of_repos = repos.select(F.lit("repo").alias("record_kind"), F.col("repo").alias("record_id"), "license")
    return of_repos.unionByName(files.select(F.lit("file").alias("record_kind"), F.col("file_id").cast("string").alias("record_id"), "license"))


def p2_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences, conflicts and unknowns of every directory of every repository."""
    return licence.directories(_licences(spark, sf_dir)[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainbody.body_lines(table(spark, sf_dir, "document_pages"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.copies(table(spark, sf_dir, "doc_chunks")).select("first_id", "copy_id")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group once, with the number of its copies."""
    return merkle.copies(table(spark, sf_dir, "doc_chunks")).select("first_id", "copies").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = unify.consistent(table(spark, sf_dir, "document_pages"), "document_id", ["content"], forms=False).withColumn("source_table", F.lit("document_pages"))
    chunks = unify.consistent(table(spark, sf_dir, "doc_chunks"), "id", ["content", "section_heading"], forms=False).withColumn("source_table", F.lit("doc_chunks"))
    counted = F.col("findings").bitwiseAND(unify.COUNTED) != 0
    return pages.unionByName(chunks).where(counted).select("source_table", "record_id", "field_name").distinct()


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every page and chunk field that isn't in form already."""
    pages = unify.consistent(table(spark, sf_dir, "document_pages"), "document_id", ["content"]).withColumn("source_table", F.lit("document_pages"))
    chunks = unify.consistent(table(spark, sf_dir, "doc_chunks"), "id", ["content", "section_heading"]).withColumn("source_table", F.lit("doc_chunks"))
    return pages.unionByName(chunks).select("source_table", "record_id", "field_name", "findings", "form").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split(table(spark, sf_dir, "doc_chunks"), table(spark, sf_dir, "doc_sections"))


def p6_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same items in the fewest even pieces."""
    return split.split(table(spark, sf_dir, "doc_chunks"), table(spark, sf_dir, "doc_sections"), even=True)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise.token_ids(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches to remove from each document."""
    return leak.scrub_spans(leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents")).select("doc_id", "kind", "start_pos").distinct()


def p9_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with placeholders."""
    return pii.masked(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_directories, p3_found, p4_found, p4_counts, p5_found, p5_forms, p6_found, p6_balanced, p7_ids, p8_found, p8_spans, p9_found, p9_masked)}


def oracle_sql() -> dict[str, str]:
    words = lambda t, k: f"(SELECT {k}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {t} WHERE text IS NOT NULL)"
    grams = lambda t, k: f"(SELECT DISTINCT {k}, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT {k}, w, unnest(range(1, len(w) - 10)) AS i FROM {words(t, k)} WHERE len(w) >= 12))"
    return {"p8_found": f"SELECT DISTINCT doc_id, item_id FROM {grams('documents', 'doc_id')} JOIN {grams('eval_items', 'item_id')} USING (g)"}
