"""JSON as models and people write it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extract(text: str | None) -> dict | None:
    """The object in a text: as it is, else between the outer braces, else repaired; arrays and scalars are none."""
    if not text:
        return None
    start, stop = text.find("{"), text.rfind("}")
    tries = [text]
    if 0 <= start < stop:
        inner = text[start : stop + 1]
        tries += [inner, re.sub(r",\s*([}\]])", r"\1", re.sub(r"[“”]", '"', inner))]
    for t in tries:
        try:
            found = json.loads(t)
        except ValueError:
            continue
        return found if isinstance(found, dict) else None
    return None


def strings(value: Any, most: int | None = None) -> list[str]:
    """Texts of a list, trimmed and without empty ones; a single text is a list of one, all else none."""
    if isinstance(value, str):
        value = [value]
    if not isinstance(value, list):
        return []
    out = [v.strip() for v in value if isinstance(v, str) and v.strip()]
    return out[:most] if most else out


def unit(value: Any, otherwise: float = 0.5) -> float:
    """A number brought to 0 to 1."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value:
        return otherwise
    return max(0.0, min(1.0, float(value)))


def extracted(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns ``keep`` and ``object``: the object in a text as plain JSON, null where there is none.

    What is JSON already never leaves the JVM; only the rest is repaired, in Arrow batches.
    """
    valid = F.coalesce(F.json_object_keys(text).isNotNull() & F.trim(text).rlike(r"(?s)^\{.*\}$"), F.lit(False))
    marked = rows.select(*keep, F.col(text).alias("_t"), valid.alias("_ok"))
    kinds = dict(marked.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            out = pa.array([None if f is None else json.dumps(f, ensure_ascii=False, separators=(",", ":")) for f in found], pa.string())
            yield pa.record_batch([*batch.columns[:-1], out], names=[*keep, "object"])

    repaired = marked.where("not _ok").drop("_ok").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", object string")
    return marked.where("_ok").select(*keep, F.trim("_t").alias("object")).unionByName(repaired)
