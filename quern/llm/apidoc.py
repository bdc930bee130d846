"""Functions paired with their documentation, from source files and from a table of API members.

Sources are cut into tokens by a lexer that recovers at line ends, and every documentation comment is the
start of a generalised LL parse of the declaration behind it (gll.py). What surrounds a declaration is
never needed, so functions are found in files that don't parse as a whole; where the parse fails, the
next comment is tried. Java, Groovy and Kotlin share one ambiguous grammar.

A description that many members of other names share word for word is a template or a placeholder; both
are found by counts of hashes over all descriptions of the corpus, with no list of them, and dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.gll import Grammar, Parser
from quern.session import checkpoint
from quern.sources import spread

WORDS, SHARED_BY = 4, 5
COMMON = frozenset(("the", "and", "for", "this", "that", "with", "from"))

_LEX = re.compile(
    r"(?P<c>/\*(?:.*?\*/|[^\n]*)|//[^\n]*)"
    r"|(?P<s>\"\"\"(?:.*?\"\"\"|[^\n]*)|'''(?:.*?'''|[^\n]*)|\"(?:[^\"\\\n]|\\.)*(?:\"|(?=\n)|$)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|$))"
    r"|(?P<i>[^\W\d]\w*(?:\$\w+)*|\$\w+|`[^`\n]*`)|(?P<n>\d[\w.]*)|(?P<l>\n)|(?P<p>[^\s\w])",
    re.S,
)
#: Words that can't be a type or a name in front of a parameter list.
_KEYWORDS = frozenset(
    "class interface enum record object trait new return throw else if for while do switch case default try catch finally package import assert val var "
    "break continue when is in as goto instanceof extends implements throws typealias companion super this fun".split()
)
_MODIFIERS = frozenset(
    "public protected private static final abstract native synchronized transient volatile strictfp default sealed open override inline infix operator tailrec "
    "suspend external internal actual expect lateinit const data inner".split()
)

# a token is (kind, text, start, line, first on its line), that of a matched opening bracket also has the place behind its closing one


def _word(*texts: str):
    wanted = frozenset(texts)
    return lambda t, i: i + 1 if i < len(t) and t[i][0] == "i" and t[i][1] in wanted else -1


def _sign(text: str):
    return lambda t, i: i + 1 if i < len(t) and t[i][0] == "p" and t[i][1] == text else -1


def _identifier(t: list, i: int) -> int:
    return i + 1 if i < len(t) and t[i][0] == "i" and t[i][1] not in _KEYWORDS and t[i][1] not in _MODIFIERS else -1


def _type_word(t: list, i: int) -> int:
    return i + 1 if i < len(t) and t[i][0] == "i" and t[i][1] not in _KEYWORDS and t[i][1] not in _MODIFIERS else -1


def _any_word(t: list, i: int) -> int:
    return i + 1 if i < len(t) and t[i][0] == "i" else -1


def _round(t: list, i: int) -> int:
    """A whole list in round brackets, whatever stands in it; one step, however long it is."""
    return t[i][5] if i < len(t) and t[i][0] == "p" and t[i][1] == "(" and len(t[i]) > 5 else -1


def _in_angles(t: list, i: int) -> int:
    return i + 1 if i < len(t) and (t[i][0] == "i" or t[i][1] in "?,.&[]*:@") else -1


def _line_end(t: list, i: int) -> int:
    return i if i >= len(t) or t[i][4] or t[i][1] == "}" else -1


GRAMMAR: Grammar = {
    "Member": [("Notes", "Mods", "Function")],
    "Notes": [(), ("Note", "Notes")],
    "Note": [(_sign("@"), "Path", "Arguments")],
    "Path": [(_any_word,), (_any_word, _sign("."), "Path"), (_any_word, _sign(":"), "Path")],
    "Arguments": [(), (_round,)],
    "Mods": [(), (_word(*_MODIFIERS), "Mods"), ("Note", "Mods")],
    "Function": [
        ("TypeParameters", "Type", _identifier, "Tail"),
        ("TypeParameters", _identifier, "Body"),
        ("TypeParameters", _word("def", "void"), _identifier, "Tail"),
        (_word("fun"), "TypeParameters", _identifier, "KotlinTail"),
        (_word("fun"), "TypeParameters", "Type", _sign("."), _identifier, "KotlinTail"),
    ],
    "TypeParameters": [(), (_sign("<"), "Angles", _sign(">"))],
    "Angles": [(), ("Angles", _in_angles), ("Angles", _sign("<"), "Angles", _sign(">"))],
    "Type": [("TypePath", "TypeParameters", "Dims")],
    "TypePath": [(_type_word,), (_type_word, "TypeParameters", _sign("."), "TypePath")],
    "Dims": [(), (_sign("["), _sign("]"), "Dims"), (_sign("?"), "Dims")],
    "Tail": [("Parameters", "Dims", "Throws", "End")],
    "Body": [("Parameters", "Throws", _sign("{"))],
    "KotlinTail": [("Parameters",)],
    "Parameters": [(_round,)],
    "Throws": [(), (_word("throws"), "ThrowList")],
    "ThrowList": [("TypePath", "TypeParameters"), ("TypePath", "TypeParameters", _sign(","), "ThrowList")],
    "End": [(_sign("{"),), (_sign(";"),), (_word("default"),), (_line_end,)],
}
_PARSER = Parser(GRAMMAR, ("Tail", "Body", "KotlinTail", "Notes"))


def tokens(source: str) -> tuple[list[tuple], list[tuple[int, str, int]]]:
    """Code tokens, and the comments as (place among the tokens, text, start)."""
    code: list[tuple] = []
    comments: list[tuple[int, str, int]] = []
    line, fresh = 1, True
    for m in _LEX.finditer(source):
        kind = m.lastgroup
        if kind == "l":
            line += 1
            fresh = True
            continue
        text = m[0]
        if kind == "c":
            comments.append((len(code), text, m.start()))
            line += text.count("\n")
            continue
        code.append((kind, text, m.start(), line, fresh))
        fresh = False
        if kind == "s":
            line += text.count("\n")
    opened: list[int] = []
    for i, token in enumerate(code):
        if token[0] == "p" and token[1] in "([{":
            opened.append(i)
        elif token[0] == "p" and token[1] in ")]}":
            if opened and code[opened[-1]][1] + token[1] in ("()", "[]", "{}"):
                code[opened.pop()] += (i + 1,)
            else:  # it breaks all that are open
                opened.clear()
    return code, comments


def pairs(source: str) -> list[tuple[str, int, str, str]]:
    """Name, line of the name, signature and raw documentation of each documented function of a source."""
    if "/**" not in source:
        return []
    code, comments = tokens(source)
    out = []
    for k, (place, text, _) in enumerate(comments):
        if not text.startswith("/**") or text == "/**/" or not text.endswith("*/") or place >= len(code):
            continue
        head = code[place]
        if head[0] != "i" and head[1] not in "@<":
            continue
        if head[0] == "i" and head[1] in _KEYWORDS and head[1] not in ("default", "fun"):
            continue
        ends, spans = _PARSER.parse(code, "Member", place)
        if not ends:
            continue
        tails = [a for what, a, b in spans if what != "Notes" and (b in ends)]
        if not tails:
            continue
        name = min(tails) - 1
        # no other comment between the documentation and the declaration proper
        begin = max((b for what, a, b in spans if what == "Notes" and a == place and b <= name), default=place)
        if k + 1 < len(comments) and comments[k + 1][0] <= begin:
            continue
        stop = code[min(ends) - 1][2] + len(code[min(ends) - 1][1])
        out.append((code[name][1].strip("`"), code[name][3], " ".join(source[code[place][2] : stop].rstrip("{;").split()), text))
    return out


_MARKS = re.compile(r"^[ \t]*/\*+|^[ \t]*\*+(?:/[ \t]*$)?|\*+/[ \t]*$", re.M)
_INLINE = re.compile(r"\{@[^{}]*(?:\{[^{}]*\}[^{}]*)*\}?")
_TAGS = re.compile(r"</?[a-zA-Z][^<>]*>|&[a-zA-Z]+;|&#\d+;")
_BLOCK = re.compile(r"^[ \t]*@\w+.*", re.M | re.S)
_WORD = re.compile(r"[^\W\d_]{3,}")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")


def description(raw: str, inline: bool = False) -> str:
    """Documentation without comment marks, block tags, mark-up and, unless ``inline``, inline tags."""
    text = _MARKS.sub("", raw.replace("\r\n", "\n"))
    text = _BLOCK.sub("", text, count=1)
    return " ".join(_TAGS.sub(" ", text if inline else _INLINE.sub(" ", text)).split())


def normal(text: str) -> str:
    """Letters and digits of a description in one case, single-spaced."""
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def trivial(text: str, name: str, words: int = WORDS) -> bool:
    """Whether a description says too little beyond the name; placeholders that say more are found by counts."""
    own = {p.lower() for p in _PARTS.findall(name)}
    own |= {name.lower()} | COMMON
    own |= {p + "s" for p in own - COMMON}
    return len({w.lower() for w in _WORD.findall(text)} - own) < words


def _of_sources(full: bool, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.extend(_row(key, line, name, signature, raw, full, words) for name, line, signature, raw in pairs(content))
            yield _batch(rows)

    return run


def _of_members(full: bool, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([_row(key, 0, name or "", signature, raw, full, words) for key, name, signature, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True)])

    return run


_FIELDS = [("record_id", pa.int64()), ("line_no", pa.int64()), ("name", pa.string()), ("signature", pa.string()), ("description", pa.string()), ("digest", pa.int64()), ("trivial", pa.bool_())]
_SCHEMA = "record_id bigint, line_no bigint, name string, signature string, description string, digest bigint, trivial boolean"


def _row(key: int, line: int, name: str, signature: str, raw: str, full: bool, words: int) -> tuple:
    text = description(raw, inline=True)
    digest = int.from_bytes(hashlib.blake2b(normal(text).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
    dull = trivial(description(raw) if "{@" in raw else text, name, words)
    return key, line, name, signature if full and not dull else None, text if full and not dull else None, digest, dull


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_FIELDS)
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


def documented(sources: DataFrame, members: DataFrame, full: bool = True, words: int = WORDS, shared_by: int = SHARED_BY) -> DataFrame:
    """``source_table, record_id, line_no`` and, if ``full``, ``name, signature, description`` of each pair kept.

    Null contents, members without a signature, and functions without documentation give no row; so do
    trivial descriptions and those that members of ``shared_by`` different names share word for word, which
    counts over all descriptions, trivial ones too. A record delivered several times counts once. Counts are
    partial sums by (description, name), so a template that a third of all rows carry is no hot key.
    """
    doc = F.when(F.length("javadoc") > 0, F.col("javadoc")).otherwise(F.col("javadoc_summary"))
    of_members = (
        members.where("kind in ('method', 'constructor') and length(signature) > 0")
        .select("member_id", "name", "signature", doc.alias("doc"))
        .where(F.length("doc") > 0)
    )
    of_sources = sources.where("content is not null").select("file_id", "content")
    found = (
        spread(of_sources).mapInArrow(_of_sources(full, words), _SCHEMA).withColumn("source_table", F.lit("source_files"))
        .unionByName(spread(of_members).mapInArrow(_of_members(full, words), _SCHEMA).withColumn("source_table", F.lit("api_members")))
    )
    found = checkpoint(found)
    templates = found.groupBy("digest", "name").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias("names")).where(F.col("names") >= shared_by)
    kept = found.where("not trivial").join(templates, "digest", "left_anti")
    return kept.select("source_table", "record_id", "line_no", *(["name", "signature", "description"] if full else [])).distinct()
