"""Encoding of texts by a byte-level BPE vocabulary of public_tokenizers.

Short texts are encoded whole. A text beyond ``leaf`` characters is encoded as a tree: halves are cut
down to leaves, the leaves are encoded independently, and every join of two encoded halves is repaired
by re-encoding a window around it, which grows until both sides agree. The parts of a text beyond ``far``
characters are encoded in parallel, by different tasks; one task then joins them, which costs windows only.

Why the repair is exact. The encoder first cuts a text into pieces by a pattern that is matched from
left to right and never looks back; each piece is then encoded by itself. Hence (1) every piece border
of the left half before its last piece is a border of the joined text, and (2) from the first border of
the right half that is also a border of the joined text on, all borders are the same. The window starts
at a border of kind 1, its pieces are computed again, and it is accepted once one of its borders beyond
the join is a border of the right half too; otherwise it grows, at most to both halves.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources import spread

VOCABULARY = "byte_bpe_50k"
SCHEMA = "doc_id bigint, ids array<int>"
LEAF, FAR = 1 << 15, 1 << 18


@functools.lru_cache(maxsize=4)
def _encoding(path: str):
    import public_tokenizers as public
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("quern", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def _pieces():
    import public_tokenizers as public
    import regex

    return regex.compile(public.PATTERN)


def _borders(text: str, start: int = 0) -> list[int]:
    """Ends of the pieces of ``text`` from the border ``start`` on."""
    return [m.end() for m in _pieces().finditer(text, start)]


class _Node:
    """An encoded stretch: its text and the ids and length of each piece."""

    __slots__ = ("ends", "ids", "text")

    def __init__(self, text: str, ends: list[int], ids: list[list[int]]):
        self.text, self.ends, self.ids = text, ends, ids


def _leaf(encoding, text: str) -> _Node:
    ends = _borders(text)
    starts = [0, *ends[:-1]]
    return _Node(text, ends, [encoding.encode_ordinary(text[a:b]) for a, b in zip(starts, ends, strict=True)])


def _join(encoding, left: _Node, right: _Node, window: int) -> _Node:
    text, cut = left.text + right.text, len(left.text)
    right_ends = {0: 0} | {e: i + 1 for i, e in enumerate(right.ends)}
    back = 1
    while True:
        kept = max(0, len(left.ends) - 1 - back)  # pieces of the left half that stay; its last one never does
        begin = left.ends[kept - 1] if kept else 0
        stop = min(len(text), cut + window)
        ends: list[int] = []
        for end in _borders(text[:stop], begin):
            # a piece that touches the window's end, or white space just before it, may be cut short there
            if end >= stop - 1 and stop < len(text):
                break
            ends.append(end)
            if end >= cut and end - cut in right_ends:
                skip = right_ends[end - cut]
                starts = [begin, *ends[:-1]]
                middle = [encoding.encode_ordinary(text[a:b]) for a, b in zip(starts, ends, strict=True)]
                return _Node(text, left.ends[:kept] + ends + [e + cut for e in right.ends[skip:]], left.ids[:kept] + middle + right.ids[skip:])
        if stop == len(text):
            raise AssertionError("the end of the text is a border of both")
        window, back = window * 2, back * 2


def _tree(encoding, text: str, leaf: int, window: int) -> _Node:
    if len(text) <= leaf:
        return _leaf(encoding, text)
    middle = len(text) // 2
    return _join(encoding, _tree(encoding, text[:middle], leaf, window), _tree(encoding, text[middle:], leaf, window), window)


def _joined(encoding, nodes: list[_Node], window: int) -> _Node:
    """Neighbouring stretches joined in pairs until one is left."""
    while len(nodes) > 1:
        pairs = [_join(encoding, a, b, window) for a, b in zip(nodes[::2], nodes[1::2], strict=False)]
        nodes = pairs + nodes[len(pairs) * 2 :]
    return nodes[0]


def encode(text: str | None, path: str, leaf: int = LEAF, window: int = 64) -> list[int]:
    """Ids of one text; none for a null or an empty one. Characters without UTF-8 form become U+FFFD."""
    if not text:
        return []
    encoding = _encoding(path)
    if len(text) <= leaf:
        return encoding.encode_ordinary(text)
    return [i for piece in _tree(encoding, text, leaf, window).ids for i in piece]


def vocabulary_path(folder: str | None = None, name: str = VOCABULARY) -> str:
    """Where the vocabulary lies: in ``folder``, else in the installed package of public tokenizers."""
    if folder is None:
        import public_tokenizers as public

        return str(public.path(f"{name}.tiktoken"))
    return str(Path(folder, f"{name}.tiktoken"))


_INT = pa.list_(pa.int32())


def _parts_ids(long: DataFrame, kind: str, at, leaf: int, far: int, window: int, id_col: str) -> DataFrame:
    """Ids of texts beyond ``far``: their parts encoded by all tasks, then joined by one task a text, in order."""
    once = long.groupBy(F.struct(F.col(id_col).alias("id")).alias("key"), F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.any_value("text").alias("text"), F.count("*").alias("times"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / far).cast("int")), lambda k: F.substr("text", k * far + 1, F.lit(far)))
    parts = once.select("key", "h", "times", F.posexplode(cut).alias("no", "part"))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(at())
        for batch in batches:
            nodes = [_tree(encoding, t, leaf, window) for t in batch.column(4).to_pylist()]
            columns = [pa.array([n.ends for n in nodes], _INT), pa.array([[len(p) for p in n.ids] for n in nodes], _INT), pa.array([[i for p in n.ids for i in p] for n in nodes], _INT)]
            yield pa.record_batch([*batch.columns, *columns], names=["key", "h", "times", "no", "part", "ends", "sizes", "ids"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(at())
        nodes, now = [], None

        def done() -> pa.RecordBatch:
            ids = [i for p in _joined(encoding, nodes, window).ids for i in p]
            return pa.record_batch([pa.array([now[0]["id"]] * now[2], id_type), pa.array([ids] * now[2], _INT)], names=[id_col, "ids"])

        for batch in batches:
            id_type = batch.schema.field("key").type.field(0).type
            for key, h, times, _, part, ends, sizes, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and now[:2] != (key, h):
                    yield done()
                    nodes = []
                now = (key, h, times)
                stops = [0]
                for n in sizes:
                    stops.append(stops[-1] + n)
                nodes.append(_Node(part, ends, [ids[a:b] for a, b in zip(stops, stops[1:], strict=False)]))
        if now is not None:
            yield done()

    key = f"key struct<id: {kind}>, h bigint, times bigint, no int, part string"
    encoded = parts.repartition("key", "h", "no").mapInArrow(leaves, f"{key}, ends array<int>, sizes array<int>, ids array<int>")
    return encoded.repartition("key", "h").sortWithinPartitions("key", "h", "no").mapInArrow(whole, f"`{id_col}` {kind}, ids array<int>")


def token_ids(documents: DataFrame, folder: str | None = None, leaf: int = LEAF, far: int = FAR, window: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` of every row, without special tokens; whole texts.

    Null and empty texts give an empty list, blank ones their own tokens. Rows with repeated ids come
    out as often as they come in; other columns are ignored, whatever their names. Only texts beyond ``far``
    characters are shuffled, as parts.
    """
    path = None if folder is None else vocabulary_path(folder)
    at = lambda: path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode(text, at(), leaf, window) for text in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, _INT)], names=[id_col, "ids"])

    rows = documents.select(id_col, F.col(text_col).alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    long = F.coalesce(F.length("text") > far, F.lit(False))
    near = spread(rows.where(~long)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
    return near.unionByName(_parts_ids(rows.where(long), kind, at, leaf, far, window, id_col))
