"""Documentation comments: body, first sentence and tags."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

_ABBREVIATIONS = re.compile(r"\b(?:e\.g|i\.e|etc|vs|cf|approx|incl|excl|no)\.$", re.I)


def first_sentence(text: str) -> str:
    """Up to the first full stop before white space that doesn't end an abbreviation."""
    for m in re.finditer(r"[.!?](?=\s|$)", text):
        if not _ABBREVIATIONS.search(text[: m.end()]):
            return text[: m.end()]
    return text


def parse(raw: str | None) -> dict:
    """body, summary, deprecated (its note or null) and since of a comment; inline tags are read as their text."""
    if not raw:
        return {"body": None, "summary": None, "deprecated": None, "since": None}
    text = re.sub(r"^[ \t]*/\*+|\*+/[ \t]*$", "", raw.strip())
    lines = [re.sub(r"^[ \t]*\*+ ?", "", x) for x in text.split("\n")]
    body, tags = [], []
    for line in lines:
        if m := re.match(r"\s*@(\w+)\s*(.*)", line):
            tags.append([m[1], m[2]])
        elif tags:
            tags[-1][1] += " " + line.strip()
        else:
            body.append(line)
    plain = lambda s: " ".join(re.sub(r"<[^>]+>", " ", re.sub(r"\{@\w+\s*([^{}]*)\}", lambda m: m[1].replace("#", "."), s)).split())
    found = {k: plain(v) for k, v in reversed(tags)}
    text = plain("\n".join(body))
    return {"body": text, "summary": first_sentence(text), "deprecated": found.get("deprecated"), "since": found.get("since")}


def parsed(raw: Column) -> Column:
    """The parts of a comment as a struct."""

    @pandas_udf("body string, summary string, deprecated string, since string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parse(x) for x in batch], columns=["body", "summary", "deprecated", "since"])

    return run(raw)
