"""Dotted versions: order, filters, boosts and extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"
SHAPE = r"^[0-9]+\.[0-9]+(\.[0-9]+)*$"


def sort_key(version: Column, parts: int = 4) -> Column:
    """Numbers of a version's first parts as an array that sorts as the version does; null for none."""
    split = F.split(F.regexp_extract(version, r"^[0-9]+(?:\.[0-9]+)*", 0), r"\.")
    numbers = [F.coalesce(F.get(split, F.lit(i)).try_cast("bigint"), F.lit(0)) for i in range(parts)]
    return F.when(version.isNotNull(), F.array(*numbers))


def well_shaped(version: Column) -> Column:
    return F.coalesce(version.rlike(SHAPE), F.lit(False))


def exact_or_child(version: Column, wanted: str) -> Column:
    """The version itself or one below it: 1.12 takes 1.12 and 1.12.2, not 1.120."""
    return (version == wanted) | F.startswith(version, F.lit(wanted + "."))


def is_release(version: Column) -> Column:
    """Neither a snapshot nor a pre-release nor a candidate."""
    return ~F.coalesce(F.lower(version).rlike(r"snapshot|alpha|beta|[-_.]?(pre|rc)[-_.]?[0-9]*$|^[0-9]+w[0-9]+[a-z]$"), F.lit(False))


def minor(version: Column) -> Column:
    """The first two parts."""
    return F.regexp_extract(version, r"^[0-9]+\.[0-9]+", 0)


def boost(version: Column, target: str) -> Column:
    """50 points for the same version, 30 for the same minor one, 10 for the same major one."""
    head = ".".join(target.split(".")[:2])
    return (
        F.when(version == target, 50.0)
        .when((minor(version) == head) & (F.lit(head) != ""), 30.0)
        .when(F.split_part(version, F.lit("."), F.lit(1)) == target.split(".")[0], 10.0)
        .otherwise(0.0)
    )


def from_text(text: Column) -> Column:
    """The first version written in a text, or null."""
    found = F.regexp_extract(text, r"\b([0-9]+\.[0-9]+(?:\.[0-9]+)?)\b", 1)
    return F.when(found != "", found)


def bump(version: str, part: str) -> str:
    """The next version by part: major, minor or patch; a tag's leading v is dropped."""
    numbers = [int(x) for x in version.lstrip("v").split("-")[0].split(".")]
    numbers += [0] * (3 - len(numbers))
    k = ("major", "minor", "patch").index(part)
    return ".".join(map(str, [*numbers[:k], numbers[k] + 1, *[0] * (2 - k)]))


def bumped(version: Column, part: str) -> Column:
    """The same for a column; null for what isn't a version."""
    numbers = F.split(F.regexp_extract(version, r"^v?([0-9]+(?:\.[0-9]+){0,2})", 1), r"\.")
    at = [F.coalesce(F.get(numbers, F.lit(i)).try_cast("bigint"), F.lit(0)) for i in range(3)]
    k = ("major", "minor", "patch").index(part)
    return F.when(version.rlike("^v?[0-9]"), F.concat_ws(".", *(c + 1 if i == k else c if i < k else F.lit(0) for i, c in enumerate(at))))
