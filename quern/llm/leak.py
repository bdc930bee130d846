"""Held-out items found in a corpus through an FM-index of every shard.

A shard is a bounded run of documents of one partition. Its words become symbols; words no item uses are
one separator, and runs of item words shorter than the match length are left out, since no match lies in
them. Over the remaining symbols a suffix order is computed, the Burrows-Wheeler transform is stored in a
wavelet tree, and all phrases of the match length of all items are searched backwards at once. Matches are
located by walking to the nearest sampled suffix position, and their spans are merged.

The phrases are bounded: they come from the items, a fixed test set. If there are more than
``block_phrases`` of them, the items are taken in blocks, each a further pass over the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources import spread

WORDS = 12
_WORD = re.compile(r"[^\W_]+")
SAMPLE = 8


class WaveletTree:
    """Levels of bits of an array of symbols, each with its running count of ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        level = symbols
        for b in range(bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(level) - int(bit.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])  # stable

    def rank(self, symbol: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each stop."""
        start, stop = np.zeros_like(stop), stop.copy()
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[level]
            one = ((symbol >> b) & 1).astype(bool)
            start = np.where(one, self.zeros[level] + ones[start], start - ones[start])
            stop = np.where(one, self.zeros[level] + ones[stop], stop - ones[stop])
        return stop - start

    def at(self, place: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        out, place = np.zeros_like(place), place.copy()
        for level in range(self.bits):
            ones = self.ones[level]
            one = ones[place + 1] - ones[place]
            place = np.where(one == 1, self.zeros[level] + ones[place], place - ones[place])
            out = out << 1 | one
        return out


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: max(n - k, 0)] = rank[k:] + 1
        key = rank * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or k >= n:
            return order
        k *= 2


class FMIndex:
    """Backward search and location over an array of symbols from 1 on; 0 is put at the end."""

    def __init__(self, symbols: np.ndarray, top: int, sample: int = SAMPLE):
        text = np.concatenate([symbols, [0]]).astype(np.int64)
        order = suffix_order(text)
        last = text[order - 1]
        self.size = len(text)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.tree = WaveletTree(last, max(1, int(top).bit_length()))
        kept = order % sample == 0
        self.kept, self.count = kept, np.concatenate([[0], np.cumsum(kept)])
        self.places = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end of the rows that begin with each phrase (a row of symbols)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, k]
            low[live] = self.below[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.below[symbol] + self.tree.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        found = np.zeros(len(phrases), bool)
        found[live] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position in the text of each row."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while open_.size:
            done = self.kept[rows[open_]]
            at = open_[done]
            out[at] = self.places[self.count[rows[at]]] + steps[at]
            open_ = open_[~done]
            if open_.size:
                symbol = self.tree.at(rows[open_])
                rows[open_] = self.below[symbol] + self.tree.rank(symbol, rows[open_])
                steps[open_] += 1
        return out


class Items:
    """The vocabulary of all items, their phrases as rows of symbols, and the items of each phrase."""

    def __init__(self, items: list[tuple[int, str | None]], words: int = WORDS):
        self.words, self.vocabulary = words, {}
        holders: dict[tuple[int, ...], set[int]] = {}
        for key, text in items:
            found = _WORD.findall((text or "").lower())
            if len(found) < words:
                continue
            symbols = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in found]  # 1 separates
            for i in range(len(symbols) - words + 1):
                holders.setdefault(tuple(symbols[i : i + words]), set()).add(key)
        self.phrases = np.array(list(holders), np.int64).reshape(-1, words)
        self.holders = [sorted(v) for v in holders.values()]


def _runs(text: str, vocabulary: dict[str, int], words: int, first: int, symbols: list[int], at: list[tuple[int, int, int]]) -> None:
    """Append the symbols of ``text`` that lie in runs of ``words`` item words or more, and where each stands."""
    run: list[tuple[int, int, int]] = []
    for m in _WORD.finditer(text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)):
        symbol = vocabulary.get(m[0])
        if symbol is not None:
            run.append((symbol, m.start(), m.end()))
            continue
        if len(run) >= words:
            symbols.extend(s for s, _, _ in run)
            symbols.append(1)
            at.extend((first, a, b) for _, a, b in run)
            at.append((first, -1, -1))
        run = []
    if len(run) >= words:
        symbols.extend(s for s, _, _ in run)
        symbols.append(1)
        at.extend((first, a, b) for _, a, b in run)
        at.append((first, -1, -1))


def search_shard(texts: list[str | None], items: Items) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Index of the text, item, and merged character spans, for every text of a shard that holds a phrase."""
    symbols: list[int] = []
    at: list[tuple[int, int, int]] = []
    for k, text in enumerate(texts):
        if text:
            _runs(text, items.vocabulary, items.words, k, symbols, at)
    if not symbols or not len(items.phrases):
        return []
    index = FMIndex(np.array(symbols, np.int64), len(items.vocabulary) + 2)
    low, high = index.search(items.phrases)
    hits = np.flatnonzero(high > low)
    n = (high - low)[hits]
    rows = np.repeat(low[hits], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for phrase, place in zip(np.repeat(hits, n).tolist(), index.locate(rows).tolist(), strict=True):
        k, begin, _ = at[place]
        end = at[place + items.words - 1][2]
        for item in items.holders[phrase]:
            spans.setdefault((k, item), []).append((begin, end))
    out = []
    for (k, item), found in sorted(spans.items()):
        merged: list[tuple[int, int]] = []
        for begin, end in sorted(found):
            if merged and begin <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((begin, end))
        out.append((k, item, merged))
    return out


def leaks(documents: DataFrame, items: DataFrame, words: int = WORDS, block_phrases: int = 1_000_000, shard_chars: int = 16_000_000) -> DataFrame:
    """``doc_id, item_id, spans``: each document that holds ``words`` consecutive words of an item, and where.

    Words are runs of letters and digits in any case. Null and empty texts hold nothing, items of fewer
    words never count, equal rows count once. The held-out items are read to the driver in blocks of at
    most ``block_phrases`` phrases; the corpus is never moved.
    """
    spark = documents.sparkSession
    corpus = spread(documents.select("doc_id", "text").where("text is not null"))
    found = None
    pending: list[tuple[int, str]] = []
    size = 0

    def scan() -> DataFrame:
        """One pass over the corpus for the items read last; the driver keeps them no longer than that."""
        shared = spark.sparkContext.broadcast(Items(pending, words))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def emit(ids: list[int], texts: list[str]) -> pa.RecordBatch:
                rows = [(ids[k], item, [{"start_pos": a, "end_pos": b} for a, b in spans]) for k, item, spans in search_shard(texts, shared.value)]
                columns = list(zip(*rows, strict=True)) or [[], [], []]
                span = pa.list_(pa.struct([("start_pos", pa.int64()), ("end_pos", pa.int64())]))
                return pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], span)], names=["doc_id", "item_id", "spans"])

            ids, texts, chars = [], [], 0
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids.append(key)
                    texts.append(text)
                    chars += len(text)
                    if chars >= shard_chars:
                        yield emit(ids, texts)
                        ids, texts, chars = [], [], 0
            if ids:
                yield emit(ids, texts)

        return corpus.mapInArrow(run, "doc_id bigint, item_id bigint, spans array<struct<start_pos: bigint, end_pos: bigint>>")

    for row in items.select("item_id", "text").where("text is not null").distinct().orderBy("item_id").toLocalIterator():
        pending.append((row[0], row[1]))
        size += len(row[1]) // 2
        if size >= block_phrases:
            found = scan() if found is None else found.unionByName(scan())
            pending, size = [], 0
    if pending or found is None:
        found = scan() if found is None else found.unionByName(scan())
    return found.distinct()


def scrub_spans(found: DataFrame) -> DataFrame:
    """``doc_id, spans``: the spans of all items of a document, merged, for removal."""
    merged = F.aggregate(
        F.array_sort(F.flatten(F.collect_set("spans"))),
        F.expr("cast(array() as array<struct<start_pos: bigint, end_pos: bigint>>)"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start_pos"] <= F.element_at(acc, -1)["end_pos"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["start_pos"].alias("start_pos"), F.greatest(F.element_at(acc, -1)["end_pos"], s["end_pos"]).alias("end_pos"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return found.groupBy("doc_id").agg(merged.alias("spans"))
