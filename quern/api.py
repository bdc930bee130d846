"""The questions users ask, as methods over one data directory: parameters, their defaults, bounds and guards.

Every method gives a DataFrame, never text. Limits are brought into their bounds; a value that isn't on its
list, or an empty question where one is needed, is a ValueError that says what is allowed.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import identifiers as N
from quern.functions import versions as V
from quern.operators import concepts as K
from quern.operators import index as I
from quern.operators import quality as Q
from quern.operators import search as S
from quern.operators import symbols as Y
from quern.plans import searching as P
from quern.sources import table

MEMBERS = ("method", "constructor", "field", "enum_constant", "annotation_element")


def bounded(limit: int, most: int, least: int = 1) -> int:
    return max(least, min(most, int(limit)))


def asked(text: str | None, most: int | None = None) -> str:
    """A question that isn't empty, nor longer than allowed."""
    if not text or not text.strip():
        raise ValueError("an empty question")
    if most and len(text) > most:
        raise ValueError(f"a question of more than {most} characters")
    return text.strip()


def one_of(name: str, value: str | None, allowed: tuple[str, ...]) -> str | None:
    if value is not None and value not in allowed:
        raise ValueError(f"{name} {value!r}: allowed are {', '.join(allowed)}")
    return value


class Engine:
    """All questions over the tables of one directory; indexes and vectors are declared on first use."""

    def __init__(self, spark: SparkSession, path: str, stop: frozenset[str] = P.STOP, synonyms: dict[str, list[str]] | None = None, patterns: dict[str, list[str]] | None = None, aliases: dict[str, list[str]] | None = None, floor: float = 25.0):
        self.spark, self.path, self.stop, self.floor = spark, path, stop, floor
        self.synonyms, self.codes, self.aliases = synonyms or {}, patterns or {}, aliases or {}

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.path, name)

    @cached_property
    def _chunks_index(self) -> I.Index:
        return P.chunks_index(self.spark, self.path)

    @property
    def _vectors(self) -> DataFrame:
        return P.chunk_vectors(self.spark, self.path)

    def _pages(self, loader: str | None, category: str | None, version: str | None) -> tuple[DataFrame, bool]:
        """Pages under the filters, and whether there are any filters."""
        rows, some = self._table("document_pages"), False
        if loader:
            rows, some = rows.where(F.col("loader").isin(*loader.split(","))), True
        if category and category != "all":
            rows, some = rows.where(F.col("category") == category), True
        if version:
            rows, some = rows.where(V.exact_or_child(F.col("minecraft_version"), version)), True
        return rows, some

    # ---- documents ------------------------------------------------------------------------------

    def search_docs(self, query: str, loader: str | None = None, category: str = "all", version: str | None = None, prefer: str | None = None, limit: int = 10) -> DataFrame:
        """The best pages for a question with the sections that answer it; 20 at most. ``prefer`` raises a version, ``version`` asks for it."""
        q = S.understand(asked(query), self.stop, self.synonyms, self.codes, prefer or version)
        pages, some = self._pages(loader, category, version)
        hits = S.documents(q, pages, self._table("doc_sections"), self._table("doc_chunks"), self._chunks_index, self._vectors, bounded(limit, 20), self.floor, some)
        return S.assembled(hits, q, self._table("doc_chunks"))

    def coverage(self, limit: int = 20) -> DataFrame:
        """Rows per loader, with and without a version, and the versions there are."""
        pages = self._table("document_pages").withColumn("loader", F.coalesce("loader", F.lit("(null)")))
        cells = Q.coverage(pages, ["loader", "category", "minecraft_version"])
        return Q.fold_coverage(cells, pages.select("loader").distinct(), "loader", F.lit(True), F.lit(True), "minecraft_version", V.SHAPE)

    def doc_snippets(self, topic: str, language: str = "java", loader: str | None = None, category: str = "all", version: str | None = None, limit: int = 5) -> DataFrame:
        """Code blocks for a topic, one of a page unless places stay empty; 10 at most."""
        q = S.understand(asked(topic), self.stop, self.synonyms, self.codes, version)
        pages, some = self._pages(loader, category, version)
        chunks, vectors = self._table("doc_chunks"), self._vectors
        if some:
            chunks, vectors = (t.join(pages.select("document_id"), "document_id", "left_semi") for t in (chunks, vectors))
        return S.snippets(q, pages, self._table("doc_sections"), chunks, self._chunks_index, vectors, language, bounded(limit, 10))

    def explain_concept(self, concept: str) -> DataFrame:
        """Chunks and sections that explain a concept of at most 100 characters, its aliases included."""
        concept = asked(concept, 100).lower()
        similar = S.near(S.understand(concept, self.stop), self._vectors, 0.0, 30).select("id", "similarity")
        return K.concept_search(self._table("doc_chunks"), self._table("doc_sections"), concept, K.expand_concept(concept, self.aliases), self._chunks_index, similar)

    def find_correspondences(self, query: str, suite: str | None = None, limit: int = 15) -> DataFrame:
        """Entries of a table of questions and answers, by BM25; 50 at most."""
        where = F.col("suite") == suite if suite else None
        return K.correspondence_search(self._table("eval_items"), P.items_index(self.spark, self.path), "item_id", asked(query), where, bounded(limit, 50))

    # ---- symbols --------------------------------------------------------------------------------

    def search_names(self, query: str, kind: str | None = None, package: str | None = None, abbreviations: dict[str, list[str]] | None = None, limit: int = 15) -> DataFrame:
        """Types and members by the fuzzy score of their names, 50 at most; the shape of an internal name looks it up by its beginning."""
        query = asked(query)
        one_of("kind", kind, ("type", *MEMBERS))
        types, members = self._table("api_types"), self._table("api_members")
        if package:
            types = types.where((F.col("package_name") == package) | F.startswith("package_name", F.lit(package + ".")))
            members = members.join(types.select("type_id"), "type_id", "left_semi")
        if kind:
            types, members = (types, members.where("false")) if kind == "type" else (types.where("false"), members.where(F.col("kind") == kind))
        limit = bounded(limit, 50)
        if query.startswith(("func_", "field_", "p_")):
            rows = members.where(F.startswith("name", F.lit(query))).select("kind", F.col("member_id").alias("id"), "name").distinct()
            return rows.withColumn("score", F.lit(100.0)).orderBy("name", "id").limit(limit)
        words = tuple(w for k, v in (abbreviations or {}).items() if k in query.lower().split() for w in v)
        return Y.search(types, members, query, words, limit)

    def resolve_symbol(self, *symbols: str) -> DataFrame:
        """What symbols stand for, by the first tier that has candidates, with the kind their shape says."""
        rows = self.spark.createDataFrame([(asked(s),) for s in symbols], "symbol string")
        return Y.resolve(rows, self._table("api_types")).withColumn("kind", N.kind(F.col("symbol")))

    def class_details(self, name: str, most: int = 30) -> DataFrame:
        """Members of a type, ``most`` of each kind, for a full name, a simple name in any case or the end of a full name."""
        found = self.resolve_symbol(name).where("fqn is not null").select("fqn")
        types = self._table("api_types").join(F.broadcast(found), "fqn").select("type_id", "fqn")  # one row
        members = self._table("api_members").join(F.broadcast(types), "type_id").select("fqn", "type_id", "kind", "member_id", "name", "signature", "return_type", "is_deprecated").distinct()
        return Y.first_members(members, most)

    def method_signatures(self, class_name: str, method: str, most: int = 10) -> DataFrame:
        """Overloads of a method, ``most`` at most."""
        rows = self.class_details(class_name, 1_000_000).where((F.col("kind") == "method") & (F.lower("name") == asked(method).lower()))
        return rows.orderBy(F.length("signature"), "member_id").limit(most)

    def browse_package(self, package: str, most: int = 50) -> DataFrame:
        return Y.browse(self._table("api_types"), [asked(package)], most)

    def search_api(self, query: str, package: str | None = None, kind: str | None = None, limit: int = 15) -> DataFrame:
        """Types whose words begin with those of a query; 50 at most. A query of signs alone finds nothing, or browses the package."""
        members = self._table("api_members").select("member_id", F.explode("annotations").alias("simple_name")).distinct()
        used = members.groupBy("simple_name").agg(F.count("*").alias("used"))
        types = self._table("api_types").join(used, "simple_name", "left").withColumn("used", F.coalesce("used", F.lit(0).cast("bigint")))
        where: Column = F.lit(True)
        if kind:
            where = where & (F.col("kind") == one_of("kind", kind, ("class", "interface", "enum", "annotation", "record")))
        if package:
            where = where & ((F.col("package_name") == package) | F.startswith("package_name", F.lit(package + ".")))
        if package and not I.parse(query, least=1):
            return types.where(where).orderBy("fqn").limit(bounded(limit, 50))
        return S.api_members(P.types_index(self.spark, self.path), types, query, "type_id", "simple_name", where, bounded(limit, 50))

    # ---- examples -------------------------------------------------------------------------------

    def search_examples(self, query: str | None = None, category: str | None = None, loader: str | None = None, least: int = 0, limit: int = 5) -> DataFrame:
        """Chunks with code by bands of BM25, then by size, 20 at most; without a question the largest."""
        where = F.col("has_code") & (F.coalesce("word_count", F.lit(0)) >= least)
        for name, value in (("category", category), ("loader", loader)):
            if value:
                where = where & (F.col(name) == value)
        return K.example_search(self._table("doc_chunks"), self._chunks_index, query or "", "id", F.col("content"), F.col("word_count"), where, bounded(limit, 20))

    def example(self, id_: str) -> DataFrame:
        return self._table("doc_chunks").where(F.col("id") == asked(id_))

    def categories(self, thin: int = 10) -> DataFrame:
        """Categories with the examples they have, thin and empty ones named."""
        names = self._table("document_pages").where("category is not null").select("category").distinct()
        return Q.counts_with_zeros(names, "category", self._table("doc_chunks").where("has_code"), "category", thin)

    def patterns(self, rules: list[tuple[str, str]], limit: int = 40, least: int = 2) -> DataFrame:
        """Canonical labels of member names with their counts, those of ``least`` or more; 200 at most."""
        from quern.operators.snippets import first_rule

        label = first_rule(F.col("name"), rules, "other").alias("pattern")
        counts = self._table("api_members").where("name is not null").select("member_id", label).distinct().groupBy("pattern").agg(F.count("*").alias("n"))
        return counts.where(F.col("n") >= bounded(least, 2**31, 1)).orderBy(F.desc("n"), "pattern").limit(bounded(limit, 200))
