"""Readers of small line and archive formats, as DataFrames."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.quality import gate


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """``loc, lastmod, changefreq, priority`` of the URL entries of sitemap files (gzip is read as it is)."""
    schema = "loc string, lastmod string, changefreq string, priority double"
    return spark.read.format("xml").option("rowTag", "url").schema(schema).load(path)


def sitemap_parts(spark: SparkSession, path: str) -> DataFrame:
    """``loc`` of the sitemaps that index files name; they are listed, not followed."""
    return spark.read.format("xml").option("rowTag", "sitemap").schema("loc string, lastmod string").load(path).select(F.trim("loc").alias("loc"))


def wiki_route(path: Column, site: str = "") -> Column:
    """The address of a Markdown file of a documentation tree: no docs folder, suffix or index, no slash at the end."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^docs/", ""), r"\.md$", ""), "/?index$", "")
    return F.regexp_replace(F.concat(F.lit(site + "/"), out), "/+$", "")


def key_route(key: Column, site: str = "") -> Column:
    """The address behind a flat key, in which underscores stand for slashes."""
    return F.concat(F.lit(site + "/"), F.replace(F.regexp_replace(key, r"\.md$", ""), F.lit("_"), F.lit("/")))


def sitemap_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """``loc, lastmod`` from text in which URLs and ISO times follow each other."""
    found = F.explode(F.regexp_extract_all(F.col(column), F.lit(r"https?://\S+?\s*\d{4}-\d\d-\d\dT[\d:.+Z-]+"), 0)).alias("e")
    return lines.select(found).select(F.regexp_extract("e", r"^(\S+?)\s*\d{4}-\d\d-\d\dT", 1).alias("loc"), F.regexp_extract("e", r"(\d{4}-\d\d-\d\dT\S+)$", 1).alias("lastmod"))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """RFC 4180 files with a header: quoted commas, doubled quotes, line ends of both kinds."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True)


def last_rows(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key; rows without one are dropped."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc_nulls_last(o) for o in order)))
    return rows.where(F.length(F.trim(key)) > 0).withColumn("_n", n).where("_n = 1").drop("_n")


def names(rows: DataFrame, *order: str) -> DataFrame:
    """``searge, name, javadoc`` of names CSV rows: the last of each name by ``order``; blank documentation is none."""
    kept = last_rows(rows.where("length(name) > 0 and searge <> 'searge'"), "searge", *order)
    return kept.select("searge", "name", F.when(F.trim("desc") != "", F.col("desc")).alias("javadoc"))


def parameter_names(rows: DataFrame, *order: str) -> DataFrame:
    """``param, name`` of parameters CSV rows, the last of each token."""
    return last_rows(rows.where("length(name) > 0 and param <> 'param'"), "param", *order).select("param", "name")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """``file, value``: whole files, one row each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


def sidecar(lines: DataFrame, fields: list[str]) -> DataFrame:
    """Fields of white-space separated lines in ``value``; blank lines and comments after # are left out."""
    lines = lines.select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("v")).where("v <> ''")
    parts = F.split("v", r"\s+")
    return lines.select(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(fields)))


def _numbered(files: DataFrame) -> DataFrame:
    """Lines of whole files with their numbers; each file is one row until it is split."""
    return files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).where("line <> ''")


def tsrg(files: DataFrame) -> DataFrame:
    """``file, class_from, class_to, what, name_from, name_to, descriptor, is_static, slot`` of indented mappings in ``file, value``.

    Both versions. ``what`` is class, field, method or parameter; a parameter has its slot, and name_from and
    descriptor of its method. The name to is the second column, or the last of a parameter's line.
    """
    rows = _numbered(files).where("line not like 'tsrg2%' and line not like '#%'")
    depth = F.length(F.regexp_extract("line", "^\t*", 0))
    parts = F.split(F.trim(F.regexp_replace("line", "^\t+", "")), " +")
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    carried = lambda i: F.last(F.when(depth == 0, F.get(parts, F.lit(i))), ignorenulls=True).over(w)
    member = F.count_if(depth <= 1).over(w)
    out = rows.select("file", "n", depth.alias("d"), parts.alias("p"), carried(0).alias("class_from"), carried(1).alias("class_to"), member.alias("m"))
    of = lambda i: F.max(F.when(F.col("d") == 1, F.get("p", F.lit(i)))).over(Window.partitionBy("file", "m"))
    out = out.withColumns({"one": of(0), "two": of(1), "three": of(2), "static": F.bool_or((F.col("d") == 2) & (F.get("p", F.lit(0)) == "static")).over(Window.partitionBy("file", "m"))})
    method = F.coalesce(F.startswith("two", F.lit("(")), F.lit(False))
    typed = F.col("three").isNotNull()  # a field with its descriptor
    what = F.when(F.col("d") == 0, "class").when((F.col("d") == 1) & method, "method").when(F.col("d") == 1, "field").when((F.col("d") == 2) & method & (F.get("p", F.lit(0)) != "static"), "parameter")
    top = F.col("d") == 0
    return out.withColumn("what", what).where("what is not null").select(
        "file", "class_from", "class_to", "what", F.when(top, F.col("class_from")).otherwise(F.col("one")).alias("name_from"),
        F.when(top, F.col("class_to")).when(F.col("what") == "parameter", F.element_at("p", -1)).when(method | typed, F.col("three")).otherwise(F.col("two")).alias("name_to"),
        F.when(~top & (method | typed), F.col("two")).alias("descriptor"), ((F.col("what") == "method") & F.coalesce("static", F.lit(False))).alias("is_static"),
        F.when(F.col("what") == "parameter", F.get("p", F.lit(0)).cast("int")).alias("slot"),
    )


def proguard(files: DataFrame) -> DataFrame:
    """``class_from, class_to, what, type, name_from, arguments, name_to`` of a shrinker's mappings in ``file, value``."""
    rows = _numbered(files).where("line not like '#%'")
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    is_class = F.col("line").rlike(r"^\S.* -> .*:$")
    part = lambda i: F.last(F.when(is_class, F.regexp_extract("line", r"^(\S+) -> (\S+):$", i)), ignorenulls=True).over(w)
    out = rows.select("line", is_class.alias("c"), part(1).alias("class_from"), part(2).alias("class_to"))
    rx = r"^\s+(?:\d+:\d+:)?(\S+) ([^\s(]+)(\([^)]*\))? -> (\S+)$"
    member = lambda i: F.when(~F.col("c"), F.regexp_extract("line", rx, i))
    what = F.when(F.col("c"), "class").when(F.contains("line", F.lit("(")), "method").otherwise("field")
    return out.select("class_from", "class_to", what.alias("what"), member(1).alias("type"), member(2).alias("name_from"), member(3).alias("arguments"), member(4).alias("name_to"))


_NAMED = "name: string, javadoc: array<string>"
DOCUMENTED = (
    f"version string, packages array<struct<{_NAMED}>>, classes array<struct<{_NAMED}, fields: array<struct<descriptor: string, {_NAMED}>>, "
    f"methods: array<struct<descriptor: string, {_NAMED}, parameters: array<struct<index: int, name: string, javadoc: string>>>>>>"
)


def documented_names(files: DataFrame) -> DataFrame:
    """``what, class, name, descriptor, slot, parameter, javadoc`` of JSON files of documented names in ``value``.

    ``what`` is package, class, field, method or parameter. Lines of documentation are joined by line ends; an
    empty list is none.
    """
    tree = files.select(F.from_json("value", DOCUMENTED).alias("t"))
    doc = lambda c: F.when(F.size(c) > 0, F.array_join(c, "\n"))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("int")

    def rows(df: DataFrame, what: str, owner: Column, name: Column, descriptor: Column = text, slot: Column = number, parameter: Column = text, javadoc: Column = text) -> DataFrame:
        return df.select(F.lit(what).alias("what"), owner.alias("class"), name.alias("name"), descriptor.alias("descriptor"), slot.alias("slot"), parameter.alias("parameter"), javadoc.alias("javadoc"))

    packages = tree.select(F.explode("t.packages").alias("p"))
    classes = tree.select(F.explode("t.classes").alias("c"))
    fields = classes.select("c.name", F.explode("c.fields").alias("f"))
    methods = classes.select("c.name", F.explode("c.methods").alias("m"))
    parameters = methods.select("name", "m", F.explode("m.parameters").alias("p"))
    out = rows(packages, "package", text, F.col("p.name"), javadoc=doc(F.col("p.javadoc")))
    for part in (
        rows(classes, "class", F.col("c.name"), F.col("c.name"), javadoc=doc(F.col("c.javadoc"))),
        rows(fields, "field", F.col("name"), F.col("f.name"), F.col("f.descriptor"), javadoc=doc(F.col("f.javadoc"))),
        rows(methods, "method", F.col("name"), F.col("m.name"), F.col("m.descriptor"), javadoc=doc(F.col("m.javadoc"))),
        rows(parameters, "parameter", F.col("name"), F.col("m.name"), F.col("m.descriptor"), F.col("p.index"), F.col("p.name"), F.col("p.javadoc")),
    ):
        out = out.unionByName(part)
    return out


def release_list(text: DataFrame, column: str = "value") -> DataFrame:
    """Versions named by a metadata file or a directory listing."""
    xml = F.regexp_extract_all(F.col(column), F.lit(r"<version>([^<]+)</version>"), 1)
    links = F.regexp_extract_all(F.col(column), F.lit(r"href=\"([0-9][^\"/]*)/\""), 1)
    return text.select(F.explode(F.array_distinct(F.concat(xml, links))).alias("version"))


def unzipped(files: DataFrame, pattern: str = r"\.java$") -> DataFrame:
    """``archive, path, content`` of the text entries of zip files in ``path, content``, without their top directory and package files."""
    import re

    wanted = re.compile(pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows = []
                    for e in z.infolist():
                        inner = e.filename.split("/", 1)[-1]
                        if not e.is_dir() and wanted.search(inner) and not inner.endswith("package-info.java"):
                            rows.append((name, inner, z.read(e).decode("utf-8", "replace")))
                yield pd.DataFrame(rows, columns=["archive", "path", "content"])

    return files.select("path", "content").mapInPandas(run, "archive string, path string, content string")


def archive(spark: SparkSession, path: str, pattern: str = r"\.java$", least: int = 0) -> DataFrame:
    """The text entries of the zip files of a folder; fewer than ``least`` fail the read."""
    out = unzipped(spark.read.format("binaryFile").load(path), pattern)
    if least:
        gate("entries missing", max(0, least - out.count()))
    return out


def topics(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a folder of YAML topic files; a folder that isn't there holds none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return topic_entries(spark.createDataFrame([], "file string, value string"))
    return topic_entries(texts(spark, path))


def topic_entries(files: DataFrame) -> DataFrame:
    """``file, topic, entry, error``: entries of YAML topic files as JSON; a file that can't be read gives one error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml

        for batch in batches:
            rows = []
            for name, text in zip(batch["file"], batch["value"], strict=True):
                try:
                    tree = yaml.safe_load(text)
                    rows.extend((name, tree.get("topic"), json.dumps(e, default=str), None) for e in tree.get("entries", []))
                except Exception as error:  # noqa: BLE001
                    rows.append((name, None, None, str(error)[:200]))
            yield pd.DataFrame(rows, columns=["file", "topic", "entry", "error"])

    return files.select("file", "value").mapInPandas(run, "file string, topic string, entry string, error string")
