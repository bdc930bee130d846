"""Cutting of oversized items into pieces at natural boundaries.

Two ways are offered. ``pieces`` cuts greedily: as far as the limit allows, at the last natural end,
with the overlap stated. It gives the positions the data description fixes. ``balanced`` computes the
least number of pieces first, places targets of equal length, snaps each to the strongest boundary
nearby, and adds a piece whenever a limit fails; its pieces are of even size but lie elsewhere.

Only items over the limit reach Python: lengths are compared by the scan's own stage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, LEAST = 1000, 100, 200
WHITE = " \t\r\n"
_SENTENCE = re.compile(r"[.!?](?=[ \t\r\n])|\n(?=\n)")
_WORD = re.compile(r"(?<=[ \t\r\n])[^ \t\r\n]")
_LINE = re.compile(r"\n")
SCHEMA = "source_table string, record_id string, item_no bigint, piece_no bigint, start_pos bigint, end_pos bigint"


def pieces(text: str, limit: int, code: bool, least: int = LEAST, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of each piece of a text over the limit.

    A limit below 1 counts as 1, and a next start never lies at or before the last one, so that even
    a heading as long as the limit leaves pieces that advance.
    """
    limit = max(limit, 1)
    ends = _LINE if code else _SENTENCE
    out, start, n = [], 0, len(text)
    while n - start > limit:
        low, high = start + least, start + limit
        end = 0
        if low <= high:
            # the character that ends a unit stands just before the end; look-aheads may pass the window
            for m in ends.finditer(text, low - 1):
                if m.end() > high:
                    break
                end = m.end()
            if not end:
                for p in range(high, low - 1, -1):
                    if p < n and text[p] in WHITE:
                        end = p
                        break
        end = end or high
        out.append((start, end))
        begin = max(end - overlap, 0)
        nxt = begin
        if code:
            at = text.find("\n", max(begin - 1, 0), end - 1)
            nxt = at + 1 if at >= 0 else begin
        elif m := _WORD.search(text, begin, end):
            nxt = m.start()
        start = max(nxt, start + 1)
    out.append((start, n))
    return out


def balanced(text: str, limit: int, overlap: int = OVERLAP, reach: float = 0.25) -> list[tuple[int, int]]:
    """Start and end of each of the fewest even pieces, every one within the limit.

    Each inner cut is the strongest boundary (blank line, line, sentence, white space, any) within
    ``reach`` of a piece's length around its target; the overlap is taken before the cut and is at most half
    a limit that leaves no room for more, as under a very long heading. A limit below 1 counts as 1.
    """
    limit = max(limit, 1)
    overlap = min(overlap, (limit - 1) // 2)
    n = len(text)
    if n <= limit:
        return [(0, n)]
    count = -(-(n - overlap) // (limit - overlap))
    while True:
        size, cuts = n / count, [0]
        for k in range(1, count):
            target, radius = round(k * size), max(1, int(size * reach))
            low = max(cuts[-1] + 1, overlap + 1, target - radius)  # a piece never begins where the first does
            high = min(n - 1, max(low, target + radius), cuts[-1] + limit - (overlap if k > 1 else 0))
            best = None
            for p in range(low, high + 1):
                a, b = text[p - 1], text[p]
                rank = 4 if a == "\n" and b == "\n" else 3 if a == "\n" else 2 if a in ".!?" and b in WHITE else 1 if b in WHITE else 0
                key = (rank, -abs(p - target), -p)
                best = max(best, (key, p)) if best else (key, p)
            if best is None:
                break
            cuts.append(best[1])
        bounds = list(zip([max(c - overlap, 0) for c in cuts], [*cuts[1:], n], strict=True))
        if len(cuts) == count and all(0 < b - a <= limit for a, b in bounds):
            return bounds
        count += 1


def _run(way):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for table, key, item, text, limit, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.extend((table, key, item, k, a, b) for k, (a, b) in enumerate(way(text, limit, code), 1))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.string(), pa.string(), *[pa.int64()] * 4]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["source_table", "record_id", "item_no", "piece_no", "start_pos", "end_pos"])

    return run


def items(chunks: DataFrame, sections: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``source_table, record_id, item_no, text, room, code`` of each item over its limit.

    Null texts are no items. Of rows delivered several times one is kept: equal ones are the same item.
    """
    heading = F.when(F.length("section_heading") > 0, F.length("section_heading") + 2).otherwise(0)
    of_chunks = chunks.select(
        F.lit("doc_chunks").alias("source_table"), F.col("id").alias("record_id"), F.lit(0).cast("bigint").alias("item_no"),
        F.col("content").alias("text"), (F.lit(limit) - heading).alias("room"), F.coalesce(F.col("chunk_type") == "code", F.lit(False)).alias("code"),
    )
    of_sections = (
        sections.select("section_id", F.posexplode("code_blocks"))
        .select(F.lit("doc_sections").alias("source_table"), F.col("section_id").cast("string").alias("record_id"), F.col("pos").cast("bigint").alias("item_no"),
                F.col("col.code").alias("text"), F.lit(limit).alias("room"), F.lit(True).alias("code"))
    )
    return of_chunks.where(F.length("text") > F.greatest("room", F.lit(1))).unionByName(of_sections.where(F.length("text") > F.col("room"))).dropDuplicates()


def split(chunks: DataFrame, sections: DataFrame, limit: int = LIMIT, even: bool = False) -> DataFrame:
    """One row per piece of every item over the limit; nothing for items within it.

    ``even`` takes balanced pieces instead of greedy ones. Positions count code points. Null and empty
    texts and empty tables give no rows; equal rows count once.
    """
    way = (lambda text, room, code: balanced(text, room)) if even else pieces
    return items(chunks, sections, limit).mapInArrow(_run(way), SCHEMA)
