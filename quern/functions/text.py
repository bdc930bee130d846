"""Text functions as Column expressions, and scalar ones for Arrow UDFs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_WIDTH = "[​-‍﻿]"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; an empty array for null."""
    return F.filter(F.split(F.coalesce(F.lower(text), F.lit("")), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def strip_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, ZERO_WIDTH, "")


def clean_lines(text: Column) -> Column:
    """Crawler cleaning: no zero-width signs, single spaces, trimmed lines, at most one blank line in a row."""
    out = F.regexp_replace(strip_zero_width(text), "\r\n?", "\n")
    out = F.regexp_replace(out, "[ \t]+", " ")
    out = F.regexp_replace(out, " ?\n ?", "\n")
    return F.trim(F.regexp_replace(out, "\n{3,}", "\n\n"))


def plain_quotes(text: Column) -> Column:
    """Documentation cleaning: straight quotes, plain line ends, single spaces, at most one blank line."""
    out = F.translate(text, "‘’“”", "''\"\"")
    out = F.regexp_replace(F.regexp_replace(out, "\r\n?", "\n"), "[ \t]+", " ")
    return F.trim(F.regexp_replace(out, "\n{3,}", "\n\n"))


def without(text: Column, patterns: list[str]) -> Column:
    """The text without anything a noise pattern matches."""
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, "")
    return text


#: White space of all kinds, no-break spaces and the byte-order mark included.
SPACE = r"[\t-\r\p{Z}\x{FEFF}]"


def word_count(text: Column) -> Column:
    """Words split at white space; an empty text counts as one."""
    bare = F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")
    return F.size(F.split(bare, f"{SPACE}+")).cast("bigint")


def change_hash(text: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def record_hash(**fields: Column) -> Column:
    """SHA-256 of a record as JSON with its names in order, so that no order of writing changes it; null is a value."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def _units(text: Column) -> Column:
    """The UTF-16 units of a text as numbers."""
    digits = F.hex(F.encode(text, "UTF-16BE"))
    n = (F.length(digits) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.substr(digits, i * 4 - 3, F.lit(4)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def rolling_id(text: Column) -> Column:
    """A short id: the rolling 32-bit hash (times 31 plus the unit), without its sign, to the base 36. Not free of collisions."""
    h = F.aggregate(_units(text), F.lit(0).cast("bigint"), lambda acc, c: F.pmod(acc * 31 + c, F.lit(1 << 32)))
    return F.lower(F.conv(F.when(h >= 1 << 31, (1 << 32) - h).otherwise(h).cast("string"), 10, 36))


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash over UTF-16 units, as eight hexadecimal digits."""
    h = F.aggregate(_units(text), F.lit(0x811C9DC5).cast("bigint"), lambda acc, c: F.pmod(acc.bitwiseXOR(c) * 0x01000193, F.lit(1 << 32)))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def slug(text: Column, most: int = 120) -> Column:
    """Lower-case words joined by hyphens; one over ``most`` characters is cut and ended by its FNV-1a hash."""
    out = F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most - 9), F.lit("-"), fnv1a(out))).otherwise(out)


def entry_key(topic: Column, vocabulary: Column, name: Column) -> Column:
    """The key of a correspondence: topic, vocabulary and slug of the name."""
    return F.concat_ws("/", topic, vocabulary, slug(name))


def camel_words(name: Column) -> Column:
    """Lower-case words of a snake, kebab, camel or acronym name."""
    out = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2")
    out = F.regexp_replace(out, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(out, r"[_\-\s]+", " ")), " "), lambda x: x != "")


def search_bag(*columns: Column) -> Column:
    """Search text of a symbol: its parts and their words, each once, in order."""
    bag = F.flatten(F.array(*(F.concat(F.array(F.lower(F.coalesce(c, F.lit("")))), camel_words(F.coalesce(c, F.lit("")))) for c in columns)))
    return F.array_join(F.array_distinct(F.filter(bag, lambda x: x != "")), " ")


def without_type_arguments(name: Column, depth: int = 4) -> Column:
    """A type name without its generic arguments, nested at most ``depth`` deep, single-spaced."""
    for _ in range(depth):
        name = F.regexp_replace(name, r"<[^<>]*>", "")
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def imports(code: Column) -> Column:
    """Distinct imported names of a source, in order."""
    found = F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(r"(?m)^\s*import\s+(?:static\s+)?([A-Za-z_][\w.]*(?:\.\*)?)"), 1)
    return F.array_distinct(found)


def mentions(code: Column, name: Column) -> Column:
    """Whether a name occurs as a whole word."""
    return F.coalesce(F.regexp_like(code, F.concat(F.lit(r"\b\Q"), name, F.lit(r"\E\b"))), F.lit(False))


def symbol_tokens(code: Column, pattern: str = r"\b(?:func|field)_\d+_\w+") -> Column:
    """Distinct tokens of a pattern in code, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(pattern), 0))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("bigint")


def like_escape(text: str) -> str:
    """A text as a literal part of a LIKE pattern."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def like_any(column: Column, patterns: list[str], most: int | None = None) -> Column:
    """Case-insensitive containment of any of the first ``most`` texts."""
    chosen = patterns[:most] if most else patterns
    out = F.lit(False)
    for p in chosen:
        out = out | F.contains(F.lower(column), F.lit(p.lower()))
    return F.coalesce(out, F.lit(False))


def identifier_like(term: str) -> bool:
    """Whether a search term looks like code: camel case, a dot, an underscore, a hash or brackets."""
    return bool(re.search(r"[a-z][A-Z]|[._#()]", term))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"[\t-\r ]+$", "")


def truncate(text: Column, limit: int) -> Column:
    """Cut at a sentence end or blank line beyond 45 % of the limit, else at white space with dots, else after the first word."""
    head = F.substring(text, 1, limit)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?][\"')\]]*)(?:[\t-\r ]|$)", 1)
    blank = F.regexp_extract(head, r"(?s)^(.*\n[\t-\r ]*\n)", 1)
    end = F.when(F.length(blank) > F.length(sentence), blank).otherwise(sentence)
    space = F.regexp_extract(head, r"(?s)^(.+)[ \n\t]", 1)
    word = F.regexp_extract(text, r"^[^\t-\r ]+", 0)
    out = F.when(F.length(end) >= 0.45 * limit, _bare(end)).when(space != "", F.concat(_bare(space), F.lit("..."))).when(word != "", word).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(out)


def truncate_code(text: Column, limit: int) -> Column:
    """Cut code behind the last semicolon or brace in the second half of the limit."""
    head = F.substring(text, 1, limit)
    end = F.regexp_extract(head, r"(?s)^(.*[;}])", 1)
    cut = F.when(F.length(end) > limit / 2 + 1, end).otherwise(_bare(head))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("\n// ...")))
