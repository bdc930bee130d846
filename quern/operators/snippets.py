"""Code regions of repositories, chosen under caps with a fair spread over files and directories."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.urls import glob
from quern.sources.tables import spread

_MASK = re.compile(r"/\*.*?(?:\*/|$)|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?", re.S)


def masked(source: str) -> str:
    """A source with comments and literals blanked, offsets and lines unchanged."""
    return _MASK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def masked_code(files: DataFrame, keep: list[str], column: str) -> DataFrame:
    """The columns ``keep`` and ``masked``: every source with comments and literals blanked; null stays null."""
    chosen = files.select(*keep, column)
    kinds = dict(chosen.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if c is None else masked(c) for c in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array(found, pa.string())], names=[*keep, "masked"])

    return spread(chosen).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", masked string")


def regions(source: str, most_lines: int = 60) -> list[tuple[int, int, str, str]]:
    """(first line, last line, signature, code) of brace regions one level inside a type, within ``most_lines``.

    A signature may be spread over several lines; it is given on one.
    """
    plain = masked(source)
    out: list[tuple[int, int, str, str]] = []
    depth, head, begin = 0, 0, -1
    for i, ch in enumerate(plain):
        if ch == "{":
            if depth == 1:
                begin = i
            depth += 1
        elif ch == "}":
            depth = max(depth - 1, 0)
            if depth == 1 and begin >= 0:
                text = plain[head:begin]
                start = head + len(text) - len(text.lstrip())
                signature = " ".join(text.split())
                if "(" in signature:
                    first, last = source.count("\n", 0, start) + 1, source.count("\n", 0, i) + 1
                    if last - first < most_lines:
                        out.append((first, last, signature, source[start : i + 1]))
                begin = -1
            if depth <= 1:
                head = i + 1
        elif ch == ";" and depth == 1:
            head = i + 1
        elif depth == 0:
            head = i + 1
        if ch == "{" and depth == 1:
            head = i + 1
    return out


def extract(files: DataFrame, include: list[str], exclude: list[str], most_bytes: int = 200_000, most_lines: int = 60) -> DataFrame:
    """``repo, path, start_line, end_line, signature, code`` of the regions of all files that pass globs and size."""
    hit = F.lit(False)
    for g in include:
        hit = hit | F.col("path").rlike(glob(g))
    for g in exclude:
        hit = hit & ~F.col("path").rlike(glob(g))
    rows = files.where(hit & (F.col("bytes") <= most_bytes) & F.col("content").isNotNull()).select("repo", "path", "content").distinct()

    names = ("repo", "path", "start_line", "end_line", "signature", "code")
    types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(r, p, *x) for r, p, c in zip(*(x.to_pylist() for x in batch.columns), strict=True) for x in regions(c, most_lines)]
            parts = list(zip(*found, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(parts, types, strict=True)], names=list(names))

    return rows.mapInArrow(run, "repo string, path string, start_line int, end_line int, signature string, code string")


def markers(code: Column, needles: list[tuple[str, str]]) -> Column:
    """Names of the marker groups any of whose needles the code holds, in order of the groups."""
    groups: dict[str, Column] = {}
    for marker, needle in needles:
        groups[marker] = groups.get(marker, F.lit(False)) | F.contains(code, F.lit(needle))
    return F.array_compact(F.array(*(F.when(c, F.lit(m)) for m, c in groups.items())))


def under_cap(snippets: DataFrame, cap: int, per_file: int = 3) -> DataFrame:
    """At most ``cap`` snippets of a repository, spread in turns over its files; few stay as they are.

    Ranked by marker groups, then place. Each file gives ``per_file`` in turns before any gives more.
    """
    order = [F.desc(F.size("markers")), F.asc("path"), F.asc("start_line")]
    in_file = F.row_number().over(Window.partitionBy("repo", "path").orderBy(*order))
    turn = snippets.withColumn("turn", in_file).withColumn("extra", F.col("turn") > per_file)
    n = F.row_number().over(Window.partitionBy("repo").orderBy("extra", "turn", *order))
    return turn.withColumn("place", n).where(F.col("place") <= cap).drop("turn", "extra")


#: Directories whose files come last, and the fewest lines a snippet that says something has.
DEMOTED, TRIVIAL_LINES = r"(?i)(?:^|/)(?:generated|integration|compat)(?:/|$)", 3


def importance(path: Column, lines: Column, groups: Column) -> Column:
    """What snippets are ranked by, least first: demoted directories last, then trivial ones, then by marker groups."""
    return F.struct(F.coalesce(path.rlike(DEMOTED), F.lit(False)).cast("int").alias("demoted"), (lines <= TRIVIAL_LINES).cast("int").alias("trivial"), (-groups).alias("groups"))


def directory_order(heads: dict[str, tuple]) -> list[str]:
    """Directories in the order they take turns: each before those below it, and of those, the ones with the better head in turns.

    ``heads`` has the rank of the best item of every directory that holds any.
    """
    below: dict[str, set[str]] = defaultdict(set)
    for folder in heads:
        parts = folder.split("/") if folder else []
        for k in range(len(parts)):
            below["/".join(parts[:k])].add("/".join(parts[: k + 1]))
    order: dict[str, list[str]] = {}
    best: dict[str, tuple] = {}
    for folder in sorted({*heads, *below, *(c for v in below.values() for c in v)}, key=lambda f: -f.count("/") if f else 1):  # the deepest first, the root last
        children = sorted(below.get(folder, ()), key=lambda c: best[c])
        own = [folder] if folder in heads else []
        order[folder] = own + _turns([order[c] for c in children])
        best[folder] = min([*(heads[f] for f in own), *(best[c] for c in children)])
    return order[""] if order else []


def _turns(lists: list[list]) -> list:
    return [v[k] for k in range(max(map(len, lists), default=0)) for v in lists if k < len(v)]


def directory_spread(items: list[tuple[str, int, tuple]], cap: int, per_file: int = 3) -> list[int]:
    """Indices chosen from (path, index, rank): directories in turns along their tree, files in turns within each.

    A file gives ``per_file`` at most; if that leaves places, a second round takes what is left without that
    limit. ``cap`` items or fewer are all kept. The order given is kept.
    """
    if len(items) <= cap:
        return sorted(i for _, i, _ in items)
    chosen: list[int] = []
    for quota in (per_file, None):
        taken = set(chosen)
        files: dict[str, list[tuple]] = defaultdict(list)
        for path, i, rank in items:
            if i not in taken:
                files[path].append((rank, i))
        folders: dict[str, list[list[tuple]]] = defaultdict(list)
        for path, found in files.items():
            folders[path.rpartition("/")[0]].append(sorted(found)[:quota])
        streams = {f: _turns(sorted(lists, key=lambda v: v[0])) for f, lists in folders.items()}
        walk = directory_order({f: s[0] for f, s in streams.items()})
        chosen += [i for _, i in _turns([streams[f] for f in walk])][: cap - len(chosen)]
        if len(chosen) >= cap:
            break
    return sorted(chosen)


def spread_directories(snippets: DataFrame, cap: int, per_file: int = 3) -> DataFrame:
    """At most ``cap`` snippets of a repository, taken in turns along its directory tree.

    A repository is judged as a whole, since its tree is; what is judged are slim rows without code, cut before
    to the best ``cap`` of every file, so the group is bounded by the files of one repository. A null
    repository is one of its own.
    """
    rank = importance(F.col("path"), F.col("end_line") - F.col("start_line") + 1, F.size("markers"))
    rows = snippets.withColumn("rank", rank)
    n = F.row_number().over(Window.partitionBy("repo", "path").orderBy("rank", "start_line"))
    slim = rows.withColumn("n", n).where(F.col("n") <= cap).select("repo", "path", "start_line", "rank.demoted", "rank.trivial", "rank.groups")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["path", "start_line"]).reset_index(drop=True)
        ranks = zip(pdf["demoted"], pdf["trivial"], pdf["groups"], range(len(pdf)), strict=True)
        picked = directory_spread([(p, i, r) for i, (p, r) in enumerate(zip(pdf["path"], ranks, strict=True))], cap, per_file)
        return pdf.loc[picked, ["repo", "path", "start_line"]]

    chosen = slim.groupBy("repo").applyInPandas(run, "repo string, path string, start_line int")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("repo", "path", "start_line")]
    return snippets.alias("a").join(chosen.alias("b"), same[0] & same[1] & same[2], "left_semi")


def first_rule(text: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The label of the first rule whose pattern matches."""
    out = F.lit(otherwise)
    for label, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out
