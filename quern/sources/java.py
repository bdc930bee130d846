"""Type and member rows of Java sources, read by tokens and braces; broken files give what can be read."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.sources.tables import spread

SCHEMA = "file_id bigint, fqn string, simple_name string, outer_fqn string, what string, name string, signature string, line int, javadoc string"
_TOKEN = re.compile(r"/\*.*?(?:\*/|$)|//[^\n]*|\"\"\".*?(?:\"\"\"|$)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|[\w$.]+|@|[^\s\w]", re.S)
_TYPE = re.compile(r"\b(class|interface|enum|record|@ ?interface)\s+([\w$]+)")
_METHOD = re.compile(r"([\w$]+)\s*\(")
_FIELD = re.compile(r"([\w$]+)\s*(?:=|;|$)")


def parse(source: str | None) -> list[tuple]:
    """(fqn, simple name, outer fqn, what, name, signature, line, javadoc) of each type, method and field."""
    if not source:
        return []
    package = re.search(r"^\s*package\s+([\w.]+)", source, re.M)
    scope: list[tuple[str, int]] = []  # type names with the depth of their bodies
    out: list[tuple] = []
    depth, head, begin, doc = 0, [], 0, None
    for m in _TOKEN.finditer(source):
        t = m[0]
        if t.startswith("/*"):
            if t.startswith("/**") and not head:
                doc = t
            continue
        if t.startswith("//"):
            continue
        inside = not scope or depth == scope[-1][1]
        if t in "{};" and len(t) == 1:
            text = re.sub(r"\s*([.,()<>\[\]@])\s*", r"\1", " ".join(head)).replace(",", ", ")
            text = re.sub(r"(?<=[)\]>])(?=\w)", " ", text)
            line = source.count("\n", 0, begin) + 1
            prefix = package[1] + "." if package else ""
            outer = prefix + ".".join(n for n, _ in scope) if scope else None
            if inside and head:
                bare = re.sub(r"@[\w.]+(?:\([^()]*\))?\s*", "", text)
                kind = _TYPE.search(bare)
                if kind and t == "{":
                    fqn = (outer + "." if outer else prefix) + kind[2]
                    out.append((fqn, kind[2], outer, kind[1], kind[2], bare, line, doc))
                    scope.append((kind[2], depth + 1))
                elif scope and t in "{;":
                    call = _METHOD.search(bare)
                    equals = bare.find("=")
                    if call and (equals < 0 or call.start() < equals) and call[1] not in ("if", "for", "while", "switch", "catch", "return", "new"):
                        what = "constructor" if call[1] == scope[-1][0] else "method"
                        out.append((outer, scope[-1][0], None, what, call[1], bare, line, doc))
                    elif t == ";" and (field := _FIELD.search(bare)) and " " in bare and not bare.startswith(("return", "import", "package", "throw")):
                        out.append((outer, scope[-1][0], None, "field", field[1], bare.split("=")[0].strip(), line, doc))
            head, doc = [], None
            if t == "{":
                depth += 1
            elif t == "}":
                if scope and depth == scope[-1][1]:
                    scope.pop()
                depth = max(depth - 1, 0)
            continue
        if inside or not scope:
            if not head:
                begin = m.start()
            head.append(t)
        elif depth > (scope[-1][1] if scope else 0):
            head = []
    return out


_COLUMNS = (("file_id", pa.int64()), ("fqn", pa.string()), ("simple_name", pa.string()), ("outer_fqn", pa.string()), ("what", pa.string()), ("name", pa.string()), ("signature", pa.string()), ("line", pa.int32()), ("javadoc", pa.string()))


def symbols(files: DataFrame) -> DataFrame:
    """Rows of all Java files of a table of ``file_id, path, content``; null contents give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, *row) for f, c in zip(*(x.to_pylist() for x in batch.columns), strict=True) for row in parse(c)]
            parts = list(zip(*rows, strict=True)) or [()] * len(_COLUMNS)
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(parts, _COLUMNS, strict=True)], names=[n for n, _ in _COLUMNS])

    rows = files.where("path like '%.java' and content is not null").select("file_id", "content")
    return spread(rows).mapInArrow(run, SCHEMA)
