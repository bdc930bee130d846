"""What a URL says: site, category and versions, from small tables of rules passed in as data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    return F.lower(F.parse_url(url, F.lit("HOST")))


def site(url: Column, hosts: list[tuple[str, str]], hints: list[tuple[str, str]] = (), otherwise: str = "neutral") -> Column:
    """The first site whose host is the URL's or above it, else whose path hint the URL holds."""
    name = host(url)
    out = F.lit(otherwise)
    for hint, label in reversed(hints):
        out = F.when(F.contains(url, F.lit(hint)), label).otherwise(out)
    for h, label in reversed(hosts):
        out = F.when((name == h) | F.endswith(name, F.lit("." + h)), label).otherwise(out)
    return out


def segments(url: Column, noise: list[str] = ()) -> Column:
    """Lower-case path parts, split at slash, colon and underscore, without noise and versions."""
    parts = F.split(F.lower(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit(""))), "[/:_]")
    return F.filter(parts, lambda x: (x != "") & ~x.rlike(r"^v?[0-9]+(\.[0-9]+)*$") & ~x.isin(*(noise or ["\x00"])))


def category(url: Column, specific: dict[str, str], container: dict[str, str], noise: list[str] = (), otherwise: str = "general") -> Column:
    """The label of the first part in the specific table, else of the first in the container table."""
    parts = segments(url, noise)

    def first(table: dict[str, str]) -> Column:
        m = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
        return F.get(F.filter(F.transform(parts, lambda x: F.element_at(m, x)), lambda x: x.isNotNull()), F.lit(0))

    return F.coalesce(first(specific), first(container), F.lit(otherwise))


def version(url: Column, content: Column | None = None, otherwise: str = "unknown") -> Column:
    """A version in the path, else one the content names, else the sentinel."""
    in_url = F.regexp_extract(url, r"/v?([0-9]+\.[0-9]+(?:\.[0-9]+)?)(?:/|$)", 1)
    out = F.when(in_url != "", in_url)
    if content is not None:
        in_text = F.regexp_extract(F.coalesce(content, F.lit("")), r"(?i)\bversion ([0-9]+\.[0-9]+(?:\.[0-9]+)?)\b", 1)
        out = F.coalesce(out, F.when(in_text != "", in_text))
    return F.coalesce(out, F.lit(otherwise))


def page_key(url: Column) -> Column:
    """A URL without its first version part, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"(?<=.)[?#].*$", ""), r"^(.*?)/[0-9]+\.[0-9]+(?:\.[0-9]+)?(?=/|$)", "$1")


def keep_urls(url: Column, include: list[str] = (), exclude: list[str] = (), locale: str | None = None) -> Column:
    """Sitemap filter: no locale part, any of the inclusions, none of the exclusions."""
    out = F.lit(True)
    if locale:
        out = out & ~url.rlike(locale)
    if include:
        hit = F.lit(False)
        for p in include:
            hit = hit | url.rlike(p)
        out = out & hit
    for p in exclude:
        out = out & ~url.rlike(p)
    return F.coalesce(out, F.lit(False))


def glob(pattern: str) -> str:
    """A path glob as a regular expression: ``**`` crosses directories, ``*`` and ``?`` don't."""
    import re

    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"
