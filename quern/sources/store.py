"""Table sets on disk: schemas, manifests, publishing, upserts and caches."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.session import checkpoint

VERSION = 1
SCHEMAS = {
    "documents": "id bigint, url string, title string, content string, raw_html string, category string, loader string, version string, hash string, indexed_at timestamp",
    "sections": "id bigint, document_id bigint, heading string, level int, content string, order_num int",
    "code_blocks": "id bigint, section_id bigint, language string, code string, caption string",
    "chunks": "id string, document_id bigint, chunk_type string, content string, section_heading string, order_num int, word_count bigint, has_code boolean",
    "vectors": "chunk_id string, embedding array<float>, dimension int, model string, created_at timestamp",
    "correspondences": "entry_key string, topic string, vocabulary string, kind string, era string, from_api string, from_alternatives array<string>, to_loader string, to_api string, notes string, caveats array<string>, related array<string>, keywords array<string>, sources array<struct<url: string, license: string>>",
    "classes": "id bigint, name string, package_name string, obfuscated string, javadoc string, version string, mapping_set string",
    "methods": "id bigint, class_id bigint, name string, token string, obfuscated string, descriptor string, javadoc string",
    "fields": "id bigint, class_id bigint, name string, token string, obfuscated string, descriptor string, javadoc string",
    "parameters": "id bigint, method_id bigint, place int, token string, name string, javadoc string",
    "types": "id bigint, fqn string, simple_name string, package_name string, outer_fqn string, kind string, modifiers string, signature string, extends_fqn string, implements_fqns array<string>, annotations array<string>, javadoc string, summary string, search_text string",
    "members": "id bigint, type_id bigint, kind string, name string, signature string, return_type string, params array<struct<type: string, name: string>>, annotations array<string>, javadoc string, summary string, search_text string",
    "annotation_usage": "fqn string, uses bigint",
    "mods": "id bigint, name string, repo string, license string",
    "examples": "id bigint, mod_id bigint, category string, pattern string, title string, code string, path string, start_line int, end_line int, quality double, featured boolean, keywords array<string>",
    "example_relations": "source_id bigint, target_id bigint, kind string, strength double",
    "tags": "id bigint, name string",
    "example_tags": "example_id bigint, tag_id bigint",
    "analysis_cache": "snippet_hash string, analysis_version string, analysis string, created_at timestamp",
}


class Store:
    """A directory of Parquet tables with one manifest; a table's current files are those the manifest names.

    Writing puts new files beside the old ones and then replaces the manifest, so that a reader sees the
    old state or the new one and an aborted build is never seen. The path may be on any file system Spark
    can reach.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The manifest; an empty one where there is none or it can't be read, whatever the reason."""
        try:
            at = self._path(f"{self.path}/manifest.json")
            if self._fs.exists(at):
                text = "".join(r[0] for r in self.spark.read.text(at.toString(), wholetext=True).collect())
                found = json.loads(text)
                if isinstance(found, dict) and isinstance(found.get("tables"), dict):
                    return found
        except Exception:  # noqa: BLE001, a store that can't be read is one that isn't there
            pass
        return {"schema_version": VERSION, "tables": {}}

    def fact(self, name: str) -> str | None:
        """A fact of the manifest, its schema version included; null on any failure."""
        m = self.manifest()
        return m.get("schema_version") if name == "schema_version" and m["tables"] else m.get("facts", {}).get(name)

    def has(self, table: str, column: str | None = None) -> bool:
        """Whether a table, or a column of it, exists."""
        known = self.manifest()["tables"]
        return table in known and (column is None or column in self.read(table).columns)

    def read(self, table: str) -> DataFrame:
        """A table, or an empty one of its schema where it was never written or the version differs."""
        m = self.manifest()
        if m.get("schema_version") != VERSION or table not in m["tables"]:
            return self.spark.createDataFrame([], SCHEMAS[table])
        entry = m["tables"][table]
        folders = entry.get("parts") or {"": entry["folder"]}
        return self.spark.read.schema(entry["schema"]).parquet(*(f"{self.path}/{f}" for f in sorted(set(folders.values()))))

    def _files(self, folder: str) -> list[tuple[str, int, str]]:
        """Name, size and SHA-256 of every data file of a folder; hashed by the executors, one row a file."""
        rows = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.path}/{folder}")
        return sorted((r[0], r[1], r[2]) for r in rows.select(F.element_at(F.split("path", "/"), -1), "length", F.sha2("content", 256)).collect())

    def _entry(self, folder: str) -> dict:
        back = self.spark.read.parquet(f"{self.path}/{folder}")
        files = self._files(folder)
        digest = hashlib.sha256(repr(files).encode()).hexdigest()
        return {"folder": folder, "schema": back._jdf.schema().toDDL(), "rows": back.count(), "bytes": sum(n for _, n, _ in files), "sha256": digest}

    def verify(self) -> list[str]:
        """What of the manifest doesn't hold for the files as they are: version, schema, size or hash of a table."""
        m, out = self.manifest(), []
        if m.get("schema_version") != VERSION:
            out.append("schema version")
        for name, entry in m["tables"].items():
            if "parts" in entry:
                continue
            try:
                now = self._entry(entry["folder"])
            except Exception:  # noqa: BLE001
                out.append(f"{name}: unreadable")
                continue
            out.extend(f"{name}: {k}" for k in ("schema", "rows", "bytes", "sha256") if now[k] != entry[k])
        return out

    def publish(self, tables: dict[str, DataFrame], **facts: str) -> dict:
        """Writes tables anew and makes them current in one step; failing, it leaves everything as it was.

        The manifest keeps rows, size, schema and SHA-256 of each table.
        """
        written: dict[str, dict] = {}
        folders = {name: f"{name}-{uuid.uuid4().hex[:12]}" for name in tables}
        try:
            for name, df in tables.items():
                df.write.parquet(f"{self.path}/{folders[name]}")
                written[name] = self._entry(folders[name])
        except Exception:
            for folder in folders.values():
                self._fs.delete(self._path(f"{self.path}/{folder}"), True)
            raise
        return self._commit(written, facts)

    def publish_parts(self, tables: dict[str, DataFrame], parts: int, touched: list[int] | None = None, **facts: str) -> dict:
        """The same for tables with a column ``part``, of which only the ``touched`` parts are written anew.

        The manifest names a folder for every part, so what a change costs is the parts it falls into.
        """
        known = self.manifest()["tables"]
        written: dict[str, dict] = {}
        for name, df in tables.items():
            folder = f"{name}-{uuid.uuid4().hex[:12]}"
            df.repartition("part").write.partitionBy("part").parquet(f"{self.path}/{folder}")
            kept = dict(known.get(name, {}).get("parts", {}))
            there = {s.getPath().getName().split("=")[1] for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")) if s.isDirectory()}
            for p in range(parts) if touched is None else touched:
                kept.pop(str(p), None)
                if str(p) in there:
                    kept[str(p)] = f"{folder}/part={p}"
            written[name] = {"folder": folder, "schema": df.drop("part")._jdf.schema().toDDL(), "parts": kept}
        return self._commit(written, facts)

    def part(self, table: str, parts: list[int]) -> DataFrame:
        """The rows of some parts of a table, with their part; an empty one if there are none."""
        entry = self.manifest()["tables"][table]
        out = self.spark.createDataFrame([], entry["schema"]).withColumn("part", F.lit(0))
        for p in parts:
            if folder := entry["parts"].get(str(p)):
                out = out.unionByName(self.spark.read.schema(entry["schema"]).parquet(f"{self.path}/{folder}").withColumn("part", F.lit(p)))
        return out

    def _commit(self, written: dict[str, dict], facts: dict[str, str]) -> dict:
        m = self.manifest()
        m = {"schema_version": VERSION, "tables": m["tables"] | written, "written": time.time(), "facts": m.get("facts", {}) | facts}
        draft, final = self._path(f"{self.path}/manifest.{uuid.uuid4().hex[:8]}"), self._path(f"{self.path}/manifest.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(m, sort_keys=True).encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(draft, final, options)
        return m

    def vacuum(self, older: float = 3600.0) -> list[str]:
        """Deletes folders that no manifest names and that were last changed ``older`` seconds ago or more, and tells which.

        A reader of the manifest before keeps its files for that time.
        """
        kept = {f.split("/")[0] for t in self.manifest()["tables"].values() for f in [t["folder"], *t.get("parts", {}).values()]}
        limit = (time.time() - older) * 1000
        gone = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)) if s.isDirectory() and s.getPath().getName() not in kept and s.getModificationTime() <= limit]
        for name in gone:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
        return gone


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Old rows whose key isn't among the new ones, and the last new row of each key."""
    if order:
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order)))
        new = new.withColumn("_n", n).where("_n = 1").drop("_n")
    else:
        new = new.dropDuplicates(keys)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def cascade(children: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Children without those whose parent is gone."""
    return children.join(gone.select(key), key, "left_anti")


def numbered(rows: DataFrame, order: list[str], name: str = "id", start: int = 1) -> DataFrame:
    """Rows with ids by a total order, counted per range partition and then offset, without one big sort task."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    ranged = checkpoint(ranged)  # ranges are sampled: both uses below must see the same ones
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per partition
    offsets = sizes.withColumn("_before", before).drop("_n")
    return ranged.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_before") + F.col("_m") - F.col("_first") + start).drop("_p", "_m", "_first", "_before")


def cached(requests: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Hits with the cache's columns, and the requests that miss; a version belongs among the keys."""
    return requests.join(cache, keys), requests.join(cache.select(*keys), keys, "left_anti")


def vectors(old: DataFrame, new: DataFrame, model: str) -> DataFrame:
    """The vector table with new rows of ``chunk_id, embedding, created_at``: float32, dimension and model; the last of a chunk wins."""
    rows = new.select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding"), F.size("embedding").alias("dimension"), F.lit(model).alias("model"), "created_at")
    return upsert(old, rows, ["chunk_id"], "created_at")


def tag_tables(rows: DataFrame, id_col: str, tags: str) -> tuple[DataFrame, DataFrame]:
    """Tags with ids by name, and the bridge of rows and tags; blank tags are none, repeated ones count once."""
    pairs = rows.select(F.col(id_col).alias("example_id"), F.explode(tags).alias("name")).where("trim(name) <> ''").distinct()
    named = numbered(pairs.select("name").distinct(), ["name"])
    return named.select("id", "name"), pairs.join(named, "name").select("example_id", F.col("id").alias("tag_id"))


def children(pages: DataFrame, id_col: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """Section rows and code-block rows of nested pages."""
    sections = pages.select(id_col, F.posexplode("sections").alias("order_num", "s")).select(id_col, "order_num", "s.heading", "s.level", "s.content", "s.code_blocks")
    blocks = sections.select(id_col, F.col("order_num").alias("section_order"), F.posexplode("code_blocks").alias("block", "b")).select(id_col, "section_order", "block", "b.language", "b.code", "b.caption")
    return sections.drop("code_blocks"), blocks
