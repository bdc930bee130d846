"""Documents into sections, chunks and summaries."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import strip_zero_width, truncate

SIZE, OVERLAP, LEAST = 1000, 100, 50
_END = re.compile(r"[.!?][\"')\]»”’]*(?=\s|$)|\n\s*\n")


def windows(text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """A text in pieces of about ``size``: to the last sentence end, else white space, else the whole token.

    Pieces below ``least`` characters are dropped; every next piece starts at a word, ``overlap`` before the
    last end and at least ``least`` after the last start.
    """
    if len(text) <= size:
        return [text]
    out, start, n = [], 0, len(text)
    while start < n:
        hard = start + size
        if hard >= n:
            end = n
        else:
            ends = [m.end() for m in _END.finditer(text, start + least, hard)]
            end = ends[-1] if ends else 0
            if not end:
                space = max(text.rfind(c, start + 1, hard) for c in " \n\t\r")
                if space > start:
                    end = space
                else:
                    m = re.compile(r"\s").search(text, hard)
                    end = m.start() if m else n
        piece = text[start:end].strip()
        if len(piece) >= least:
            out.append(piece)
        if end >= n:
            break
        nxt = max(start + least, end - overlap)
        if nxt > 0 and not text[nxt - 1].isspace():
            m = re.compile(r"\s+").search(text, nxt)
            nxt = m.end() if m else nxt
        start = nxt
    return out


def pieces(text: Column, size: int = SIZE) -> Column:
    """The pieces of texts as an array, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: windows(t, size) if t is not None else None)

    return cut(text)


def in_groups(rows: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], Group]) -> DataFrame:
    """Rows of each key given, in order, to an object made by ``start``, which returns rows at once and at the end.

    Rows are sorted inside their partitions and streamed in Arrow batches: no group is ever held as a whole,
    however many rows it has. The key comes first in every row. Equal rows, which lie side by side, count once.
    """
    same = F.xxhash64(*rows.columns)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, now, last = None, None, None
        types = [_ARROW[f.split()[1]] for f in schema.split(", ")]

        def packed(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(names), types, strict=True)], names=names)

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row == last:
                    continue
                last = row
                if group is None or row[0] != now:
                    if group is not None:
                        out.extend(group.end())
                    group, now = start(), row[0]
                out.extend(group.add(row))
            yield packed(out)
        if group is not None:
            yield packed(list(group.end()))

    sorted_ = rows.withColumn("_same", same).repartition(key).sortWithinPartitions(key, *order, "_same").drop("_same")
    return sorted_.mapInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


class Group:
    """What in_groups needs."""

    def add(self, row: tuple) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> list[tuple]:
        return []


_SCHEMA = "document_id bigint, chunk_type string, content string, section_heading string, order_num int, word_count bigint, has_code boolean"


class _Page(Group):
    """The chunks of a page: its row comes first, then those of its sections."""

    def __init__(self, size: int):
        self.size, self.number, self.page, self.sections = size, 0, None, 0

    def _out(self, kind: str, text: str, heading: str | None, code: bool) -> tuple:
        self.number += 1
        return self.page[0], kind, text, heading, self.number - 1, max(len(text.split()), 1), code

    def add(self, row: tuple) -> list[tuple]:
        _, kind, _, _, title, content, heading, blocks = row
        if kind == 0:
            if self.page is None:
                self.page = row
                return [self._out("title", f"{title or ''}\n\n{(content or '')[: self.size]}", None, False)]
            return []
        if self.page is None:
            return []
        self.sections += 1
        heading, body, out = heading or "", (content or "").strip(), []
        for block in blocks or []:
            if block["code"]:
                out.append(self._out("code", "\n".join(x for x in (heading, block["caption"], block["code"]) if x), heading, True))
        if len(body) >= LEAST:
            out.extend(self._out("section", f"{heading}\n\n{piece}" if heading else piece, heading, False) for piece in windows(body, self.size))
        return out

    def end(self) -> list[tuple]:
        return [] if self.page is None or self.sections else [self._out("full", self.page[5] or "", None, False)]


def chunk(pages: DataFrame, sections: DataFrame, size: int = SIZE) -> DataFrame:
    """Title, code and section chunks of each page; a full chunk where there are no sections.

    A page's row and its sections' rows pass in order; chunks are numbered from 0. Null contents count as
    empty, equal rows of a section once, sections without a page not at all.
    """
    kind = dict(sections.dtypes)["code_blocks"]
    rows = pages.select("document_id", F.lit(0).alias("kind"), F.lit(0).alias("o"), F.lit(None).cast("bigint").alias("i"), "title", "content", F.lit(None).cast("string").alias("heading"), F.lit(None).cast(kind).alias("code_blocks"))
    parts = sections.where("document_id is not null").select("document_id", F.lit(1).alias("kind"), F.coalesce("order_num", F.lit(0)).alias("o"), F.col("section_id").alias("i"), F.lit(None).cast("string").alias("title"), "content", "heading", "code_blocks")
    return in_groups(rows.unionByName(parts), "document_id", ["kind", "o", "i", "heading", "content"], _SCHEMA, lambda: _Page(size))


def sanitise(sections: DataFrame, least: int = 25) -> DataFrame:
    """Sections cleaned of zero-width signs, without tiny ones and without the same one twice on a page."""
    clean = sections.withColumn("heading", F.trim(strip_zero_width(F.coalesce("heading", F.lit(""))))).withColumn("content", F.trim(strip_zero_width(F.coalesce("content", F.lit("")))))
    kept = clean.where((F.length("content") >= least) | (F.size("code_blocks") > 0))
    n = F.row_number().over(Window.partitionBy("document_id", F.xxhash64("heading", "content", F.to_json("code_blocks"))).orderBy("order_num", "section_id"))
    return kept.withColumn("_n", n).where("_n = 1").drop("_n")


class _Bodies(Group):
    """Bodies a page has kept, by digest."""

    def __init__(self) -> None:
        self.seen: set[bytes] = set()
        self.place = 0

    def add(self, row: tuple) -> list[tuple]:
        key, _, section, heading, content, blocks = row
        self.place += 1
        codes = "\n".join(b["code"] or "" for b in blocks or [])
        body = (content or "").strip() or codes
        for option in (body, f"{body}\n\n{codes}".strip(), f"{heading or ''}\n\n{body}".strip()):
            digest = hashlib.blake2b(option.encode("utf-8", "replace"), digest_size=16).digest()
            if option and digest not in self.seen:
                self.seen.add(digest)
                return [(key, section, self.place - 1, option)]
        return []


def unique_bodies(sections: DataFrame) -> DataFrame:
    """Stored bodies, unique on their page: a repeated one takes its code, then its heading, else is dropped.

    The rule is sequential within a page; a page's rows are streamed, and digests of its bodies are all it keeps.
    """
    rows = sections.where("document_id is not null").select("document_id", F.coalesce("order_num", F.lit(0)).alias("o"), "section_id", "heading", "content", "code_blocks")
    return in_groups(rows, "document_id", ["o", "section_id", "heading", "content"], "document_id bigint, section_id bigint, place int, body string", _Bodies)


def meaningful(content: Column, heading: Column) -> Column:
    """A body of 20 characters or more, longer than its heading, that doesn't start in lower case."""
    text = F.trim(F.coalesce(content, F.lit("")))
    return (F.length(text) >= 20) & (F.length(text) > F.length(F.coalesce(heading, F.lit("")))) & ~text.rlike("^[a-z]")


class _Canonical(Group):
    """Headings and bodies a page has kept."""

    def __init__(self, most: int | None):
        self.most, self.heads, self.bodies, self.place = most, set(), set(), 0

    def add(self, row: tuple) -> list[tuple]:
        key, _, section, head, body = row
        if (self.most is not None and self.place >= self.most) or head in self.heads or body in self.bodies:
            return []
        self.heads.add(head)
        self.bodies.add(body)
        self.place += 1
        return [(key, section, self.place)]


def canonical_sections(sections: DataFrame, most: int | None = None) -> DataFrame:
    """``document_id, section_id, place``: the first meaningful section per heading and per body of each page.

    A section counts as seen only if it was kept, so the rule is sequential within a page, whose rows are
    streamed as digests. ``most`` bounds what a page shows, if it is given.
    """
    key = lambda c: F.unhex(F.md5(F.lower(F.trim(F.coalesce(c, F.lit("")))))).alias(c)
    rows = sections.where(meaningful(F.col("content"), F.col("heading"))).where("document_id is not null")
    slim = rows.select("document_id", F.coalesce("order_num", F.lit(0)).alias("o"), "section_id", key("heading"), key("content"))
    return in_groups(slim, "document_id", ["o", "section_id"], "document_id bigint, section_id bigint, place int", lambda: _Canonical(most))


def sentences(text: Column, least: int = 20) -> Column:
    """Sentences of ``least`` characters or more that don't start in lower case."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t-\r ]+", " "), r"(?<=[.!?]) ")
    return F.filter(parts, lambda s: (F.length(s) >= least) & ~s.rlike("^[a-z]"))


def summary(pages: DataFrame, id_col: str, text: Column, terms: list[str], most: int = 3, limit: int = 400) -> DataFrame:
    """An extract of each document: the sentences with most terms, earlier ones first, cut at a boundary."""
    hits = F.lit(0)
    for t in terms:
        hits = hits + F.contains(F.lower("s"), F.lit(t.lower())).cast("int")
    rows = pages.select(F.col(id_col), F.posexplode(sentences(text)).alias("p", "s")).withColumn("hits", hits)
    n = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("hits"), "p"))
    joined = rows.withColumn("n", n).where(F.col("n") <= most).groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), " ").alias("summary"))

    return joined.select(id_col, truncate(F.col("summary"), limit).alias("summary"))


def key_points(pages: DataFrame, id_col: str, text: Column, terms: list[str], most: int = 8) -> DataFrame:
    """Sentences of 20 to 200 characters that name a term, the first of each document."""
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(F.lower("s"), F.lit(t.lower()))
    rows = pages.select(F.col(id_col), F.posexplode(sentences(text)).alias("p", "s")).where(hit & (F.length("s") <= 200))
    n = F.row_number().over(Window.partitionBy(id_col).orderBy("p"))
    return rows.withColumn("place", n).where(F.col("place") <= most).select(id_col, "place", F.col("s").alias("sentence"))
