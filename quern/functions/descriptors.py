"""JVM descriptors and internal names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ONE = r"\[*(?:[BCDFIJSZ]|L[^;]+;)"
_PRIMITIVES = {"void": "V", "boolean": "Z", "byte": "B", "char": "C", "short": "S", "int": "I", "long": "J", "float": "F", "double": "D"}


def parameters(descriptor: Column) -> Column:
    """Descriptors of the parameters, in order."""
    return F.regexp_extract_all(F.regexp_extract(descriptor, r"^\(([^)]*)\)", 1), F.lit(_ONE), 0)


def slots(descriptor: Column, static: Column) -> Column:
    """The local-variable slot of each parameter: wide ones take two, an instance takes the first."""
    width = F.transform(parameters(descriptor), lambda p: F.when(p.isin("J", "D"), 2).otherwise(1))
    first = F.when(static, 0).otherwise(1)
    return F.transform(width, lambda _, i: first + F.aggregate(F.slice(width, F.lit(1), i), F.lit(0), lambda a, w: a + w))


def split_internal(name: Column) -> tuple[Column, Column]:
    """Package (dotted) and simple name of ``a/b/C``."""
    simple = F.substring_index(name, "/", -1)
    return F.when(F.contains(name, F.lit("/")), F.replace(F.substring(name, F.lit(1), F.length(name) - F.length(simple) - 1), F.lit("/"), F.lit("."))).otherwise(""), simple


def remap(descriptor: str, names: dict[str, str]) -> str:
    """A descriptor with its class names replaced."""
    return re.sub(r"L([^;]+);", lambda m: f"L{names.get(m[1], m[1])};", descriptor)


def of_java_type(name: str) -> str:
    """The descriptor of a source type: ``int[]`` is ``[I``."""
    dims = name.count("[]")
    base = re.sub(r"<.*>", "", name.replace("[]", "")).strip()
    return "[" * dims + (_PRIMITIVES[base] if base in _PRIMITIVES else f"L{base.replace('.', '/')};")
