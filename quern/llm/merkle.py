"""Copies that differ only in formatting, found by digests of records built from the leaves up.

A record is a tree. Its leaves are texts, normalised to letters and digits in one case. The children of
an object (named fields) are unordered, so their digests are sorted before the object's own is made;
the items of a list and plain text keep their order. Records with the same root digest are grouped, and
their whole normal forms are compared before they are called copies.

Only what looks like named fields is parsed, in Python; plain text is one leaf, normalised and hashed by
the JVM. Digests have 128 bits. Texts are never shuffled; normal forms are, once, and for records alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import checkpoint
from quern.sources import spread

FIELDS_AT_LEAST = 3
_NOT_ALNUM = r"[^\p{L}\p{N}]+"
_LEAD = re.compile(r"""[\s>*+|-]*["'`*_]*""")
_SEPARATOR = re.compile(":|=>|->|=")
_NAME = re.compile(r"[^\W_][\w .\-/]*")
_JSON = re.compile(r"""\s*(?:("(?:[^"\\\x00-\x1f]|\\.)*")|(-?\d[\d.eE+-]*|true|false|null)|([{}\[\]:,]))""")
_ESCAPE = re.compile(r'\\(?:u([0-9a-fA-F]{4})|(.))')
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _norm(text: str) -> str:
    return "".join(ch for ch in text.upper() if ch.isalpha() or ch.isnumeric())


def _digest(kind: str, *parts: str) -> str:
    return hashlib.blake2b("\x1f".join((kind, *parts)).encode("utf-8", "replace"), digest_size=16).hexdigest()


class _Pairs(list):
    """The members of an object, repeated names included."""


def _unescaped(text: str) -> str:
    """The value of a JSON string; halves of a pair become one character, single ones a replacement."""
    if "\\" not in text:
        return text[1:-1]
    out = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else _ESCAPED.get(m[2], m[2]), text[1:-1])
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def read_json(text: str) -> object:
    """A JSON text as lists, pairs and strings, however deep; numbers and null as written. ValueError if it is none."""
    stack: list[tuple[list, str | None]] = []  # containers around the current one, with the name each has in its own
    top: list = []
    into, name, state = top, None, "value"  # what may come next: value, key, colon, comma
    at, n = 0, len(text.rstrip())
    while at < n:
        m = _JSON.match(text, at)
        if not m:
            raise ValueError(at)
        at = m.end()
        string, word, sign = m.groups()
        if string is not None and state in ("key", "first key"):
            name, state = _unescaped(string), "colon"
        elif (string is not None or word is not None) and state in ("value", "first value"):
            value = _unescaped(string) if string is not None else word
            into.append((name, value) if isinstance(into, _Pairs) else value)
            state = "comma"
        elif sign == ":" and state == "colon":
            state = "value"
        elif sign == "," and state == "comma" and stack:
            state = "key" if isinstance(into, _Pairs) else "value"
        elif sign in ("{", "[") and state in ("value", "first value"):
            stack.append((into, name))
            into, state = (_Pairs(), "first key") if sign == "{" else ([], "first value")
        elif sign in ("}", "]") and stack and (sign == "}") == isinstance(into, _Pairs) and state in ("comma", "first key", "first value"):
            whole = into
            into, name = stack.pop()
            into.append((name, whole) if isinstance(into, _Pairs) else whole)
            state = "comma"
        else:
            raise ValueError(at)
    if stack or len(top) != 1:
        raise ValueError(at)
    return top[0]


def _field(part: str) -> tuple[str, str] | None:
    """Name and value around the first separator behind bullets and quotes; the name may have any length."""
    part = part[_LEAD.match(part).end() :]
    if not (m := _SEPARATOR.search(part)):
        return None
    name = part[: m.start()].rstrip().rstrip("\"'`*_")
    value = part[m.end() :].strip()
    return (name, value[:-1].rstrip() if value[-1:] in (",", ";") else value) if _NAME.fullmatch(name) and _norm(value) else None


def fields(text: str) -> list[tuple[str, object]] | None:
    """Names and values if the text consists of named fields only: an object, lines, or a list split by semicolons."""
    body = text.strip()
    if body[:1] == "{" and body[-1:] == "}":
        try:
            return list(read_json(body))
        except ValueError:
            body = body[1:-1]
    for parts in (body.split(";"), re.split("[;\n]", body), body.split("\n"), body.split(",")):
        parts = [p for p in parts if _norm(p)]
        if len(parts) > 1 and all(found := [_field(p) for p in parts]):
            return found
    return None


def _fold(tree: object, leaf, items, members) -> str:
    """A tree folded from its leaves up with a stack of its own, so depth is no limit."""
    out: list[str] = []
    work: list[tuple[object, bool]] = [(tree, False)]
    while work:
        value, ready = work.pop()
        if not isinstance(value, list):
            out.append(leaf(value))
        elif not ready:
            work.append((value, True))
            work.extend((x[1] if isinstance(value, _Pairs) else x, False) for x in reversed(value))
        else:
            done = out[len(out) - len(value) :]
            del out[len(out) - len(value) :]
            out.append(members([k for k, _ in value], done) if isinstance(value, _Pairs) else items(done))
    return out[0]


def root(tree: object) -> str:
    """The Merkle root: digests of sorted fields for objects, of items in order for lists, of letters for leaves."""
    return _fold(
        tree, lambda v: _digest("leaf", _norm(v)), lambda parts: _digest("list", *parts),
        lambda names, parts: _digest("object", *sorted(_digest("field", _norm(k), d) for k, d in zip(names, parts, strict=True))),
    )


def form(tree: object) -> str:
    """The whole structure in one normal form, for the comparison in full."""
    return _fold(tree, _norm, lambda parts: f"[{','.join(parts)}]", lambda names, parts: "{" + ",".join(sorted(f"{_norm(k)}:{p}" for k, p in zip(names, parts, strict=True))) + "}")


def record(text: str, least: int = FIELDS_AT_LEAST) -> tuple[str, str] | None:
    """Root digest and normal form of a text of named fields; None for other texts, or too few fields."""
    found = fields(text)
    if found is None or len(found) < least:
        return None
    tree = _Pairs(found)
    return root(tree), form(tree)


def digests(rows: DataFrame, least: int = FIELDS_AT_LEAST) -> DataFrame:
    """``group, id, plain, root, form`` of rows of ``group, id, text``.

    ``plain`` is the digest of the letters and digits in order, ``root`` that of the record and ``form`` its
    normal form, both null for plain text. Rows without letters and digits are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [record(t, least) or (None, None) for t in batch.column(2).to_pylist()]
            roots = pa.array([bytes.fromhex(r) if r else None for r, _ in found], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(3), roots, pa.array([f for _, f in found], pa.string())], names=["group", "id", "plain", "root", "form"])

    letters = F.regexp_replace(F.upper("text"), _NOT_ALNUM, "")
    # exploded, not filtered: a filter would be pushed down and the letters be made once more for it
    digest = F.transform(F.filter(F.array(letters), lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    hashed = rows.where("text is not null").select("group", "id", "text", F.explode(digest).alias("plain"))
    marked = F.replace(F.col("text"), F.lit("->"), F.lit("="))
    separators = F.length(marked) - F.length(F.translate(marked, ":=", ""))
    kind = dict(hashed.dtypes)
    parsed = hashed.where(separators >= least).mapInArrow(run, f"group {kind['group']}, id {kind['id']}, plain struct<a: bigint, b: bigint>, root binary, form string")
    return parsed.unionByName(hashed.where(separators < least).select("group", "id", "plain", F.lit(None).cast("binary").alias("root"), F.lit(None).cast("string").alias("form")))


def _classes(links: DataFrame) -> DataFrame:
    """``group, plain, class``: the least of all letters that records link; ``links`` are ``group, plain, root, form``.

    Records are grouped by root and whole normal form. Letters of one record only, as nearly all are, have
    their class at once; where fields part differently for the same letters the least class spreads over the
    links, in rounds of aggregations, until nothing moves.
    """
    low = links.groupBy("group", "root", "form").agg(F.min("plain").alias("low"))
    sides = checkpoint(links.join(low, ["group", "root", "form"]).select("group", "plain", "low").distinct())
    found = sides.groupBy("group", "plain").agg(F.min("low").alias("class"), F.count("*").alias("records"))
    moved = not found.where("records > 1").isEmpty()
    found = found.drop("records")
    while moved:
        least = sides.join(found, ["group", "plain"]).groupBy("group", "low").agg(F.min("class").alias("class"))
        new = checkpoint(sides.join(least, ["group", "low"]).groupBy("group", "plain").agg(F.min("class").alias("class")))
        moved = not new.exceptAll(found).isEmpty()
        found = new
    return found


def copies(chunks: DataFrame, id_col: str = "id", group_col: str = "document_id", text_col: str = "content", least: int = FIELDS_AT_LEAST, salts: int = 16) -> DataFrame:
    """``first_id, copy_id, copies``: each further member of a group of equal records, with the group's size.

    Groups lie within one value of ``group_col``; null is a value of its own. Contents that are null or
    have no letters and digits never count, nor does a row repeated under the same id. A plain text whose
    letters and digits are those of a record, in its order, is a copy of that record, and so are two
    records whose letters and digits agree in order though their fields part differently.

    Digests are made once and written. Rows with the same letters are one cell, by partial aggregation, and
    records link cells, so a text or record with a third of all rows never meets in one task. Rows come back
    once, joined to the cells of groups with copies over ``salts`` parts.
    """
    rows = spread(chunks.select(F.struct(F.col(group_col).alias("g")).alias("group"), F.col(id_col).alias("id"), F.col(text_col).alias("text")))  # in a struct null equals null
    slim = checkpoint(digests(rows, least).distinct())
    cells = slim.groupBy("group", "plain").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    classes = _classes(slim.where("root is not null").select("group", "plain", "root", "form").distinct())
    cells = cells.join(classes, ["group", "plain"], "left").select("group", "plain", F.coalesce("class", "plain").alias("class"), "first", "n")
    groups = cells.groupBy("group", "class").agg(F.min("first").alias("first_id"), F.sum("n").alias("copies")).where("copies > 1")
    of_cell = cells.join(groups, ["group", "class"]).select("group", "plain", "first_id", "copies", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    members = slim.select("group", "plain", "id", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    return members.join(of_cell, ["group", "plain", "salt"]).where("id <> first_id").select("first_id", F.col("id").alias("copy_id"), "copies").distinct()
