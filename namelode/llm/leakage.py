"""Passages of evaluation items inside a corpus, found through an FM-index of each shard of it."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_WORD = regex.compile(r"[^\W_]+")
_END, _BREAK, _FIRST = 0, 1, 2  # symbols: the shard's end, between runs of words, the first word


class FMIndex:
    """Counts and locates short sequences in a text of whole numbers, its last one smaller than all others.

    The Burrows-Wheeler transform is held as a wavelet matrix with ranks; every ``every``-th position of
    the text keeps its place, others are found by stepping back to one.
    """

    def __init__(self, text: np.ndarray, symbols: int, every: int = 8):
        self.size, self.every = len(text), every
        order = suffix_order(text)
        last = text[order - 1]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.levels = max(1, int(symbols - 1).bit_length())
        self.zeros, self.ranks = [], []
        row = last.copy()
        for level in reversed(range(self.levels)):
            bits = (row >> level) & 1
            ones = np.zeros(self.size + 1, np.int32)
            np.cumsum(bits, out=ones[1:])
            self.ranks.append(ones)
            self.zeros.append(self.size - int(ones[-1]))
            row = np.concatenate([row[bits == 0], row[bits == 1]])
        self.last = last
        self.sampled = order % every == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` occurs in the transform before place ``upto``."""
        low, high = np.zeros_like(upto), upto.copy()
        for at, level in enumerate(reversed(range(self.levels))):
            ones, zeros = self.ranks[at], self.zeros[at]
            bit = (symbol >> level) & 1 == 1
            low = np.where(bit, zeros + ones[low], low - ones[low])
            high = np.where(bit, zeros + ones[high], high - ones[high])
        return high - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of places of each row of ``patterns``, searched from its last symbol to its first."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        alive = np.arange(len(patterns))
        for column in reversed(range(patterns.shape[1])):
            symbol = patterns[alive, column]
            low[alive] = self.starts[symbol] + self.rank(symbol, low[alive])
            high[alive] = self.starts[symbol] + self.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, high

    def locate(self, places: np.ndarray) -> np.ndarray:
        """The text positions of ``places``."""
        now, steps = places.astype(np.int64).copy(), np.zeros(len(places), np.int64)
        walking = np.flatnonzero(~self.sampled[now])
        while len(walking):
            at = now[walking]
            symbol = self.last[at].astype(np.int64)
            now[walking] = self.starts[symbol] + self.rank(symbol, at)
            steps[walking] += 1
            walking = walking[~self.sampled[now[walking]]]
        return self.samples[self.sample_rank[now]] + steps


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of ``text`` in order, by sorting on prefixes of doubled length until all differ."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)

    def renumber(keys: np.ndarray) -> int:
        new = np.concatenate([[0], np.cumsum(keys[order][1:] != keys[order][:-1])])
        rank[order] = new
        return int(new[-1])

    top, width = renumber(text.astype(np.int64)), 1
    while top < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        keys = rank * (n + 1) + after
        order = np.argsort(keys, kind="stable")
        top = renumber(keys)
        width *= 2
    return order


class Passages:
    """All sequences of ``least`` words of the items, over numbered words."""

    def __init__(self, items: list[tuple[int, str | None]], least: int):
        self.least = least
        numbers: dict[str, int] = {}
        holders: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for item, text in items:
            words = [numbers.setdefault(w.casefold(), len(numbers) + _FIRST) for w in _WORD.findall(text or "")]
            for at in range(len(words) - least + 1):
                holders[tuple(words[at : at + least])].add(item)
        self.numbers, self.symbols = numbers, len(numbers) + _FIRST
        self.patterns = np.array(list(holders), np.int64).reshape(-1, least)
        self.items = [sorted(x) for x in holders.values()]


class _Numbers(dict):
    """Word numbers by the word as written; words of no item are 0."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.known = numbers

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        number = self[word] = self.known.get(word.casefold(), 0)
        return number


class _Shard:
    """The runs of item words of some documents; only runs as long as a passage can hold one."""

    def __init__(self, passages: Passages):
        self.passages, self.runs, self.size = passages, [], 0
        self.numbers = _Numbers(passages.numbers)

    def add(self, doc: object, text: str) -> None:
        words = _WORD.findall(text)
        least = self.passages.least
        if len(words) < least:
            return
        look = self.numbers
        ids = np.fromiter((look[w] for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]])))
        long_ones = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if b - a >= least]
        if long_ones:
            at = np.array([m.span() for m in _WORD.finditer(text)], np.int64)
            for a, b in long_ones:
                self.runs.append((doc, ids[a:b], at[a:b]))
                self.size += b - a + 1

    def found(self) -> Iterator[tuple[object, int, int, int]]:
        """(doc, item, start, end) of each place, in characters, that holds a passage of an item."""
        runs, self.runs, self.size = self.runs, [], 0
        if not runs:
            return
        text = np.concatenate([np.concatenate([ids, [_BREAK]]) for _, ids, _ in runs] + [[_END]]).astype(np.int64)
        starts = np.cumsum([0] + [len(ids) + 1 for _, ids, _ in runs[:-1]])
        index = FMIndex(text, self.passages.symbols)
        low, high = index.search(self.passages.patterns)
        hit = np.flatnonzero(low < high)
        counts = (high - low)[hit]
        pattern = np.repeat(hit, counts)
        places = np.repeat(low[hit], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        positions = index.locate(places)
        spans: dict[tuple[int, int], list[int]] = defaultdict(list)
        for p, position in zip(pattern.tolist(), positions.tolist()):
            run = int(np.searchsorted(starts, position, "right")) - 1
            for item in self.passages.items[p]:
                spans[run, item].append(position - int(starts[run]))
        for (run, item), at in spans.items():
            doc, _, chars = runs[run]
            at.sort()
            begin = at[0]
            for here, following in zip(at, [*at[1:], None]):
                if following is None or following > here + self.passages.least:
                    yield doc, item, int(chars[begin][0]), int(chars[here + self.passages.least - 1][1])
                    begin = following


def leaked_spans(
    docs: DataFrame,
    items: DataFrame,
    least: int = 12,
    shard_words: int = 2_000_000,
    item_block: int = 20_000,
) -> DataFrame:
    """(doc_id, item_id, span_start, span_end): places of documents with ``least`` words or more of an item.

    Words are runs of letters and digits; their case and whatever stands between them don't count. Each
    task indexes the documents it reads in shards of ``shard_words`` words, leaving out words that no item
    has, and looks up all passages of the items in each. Spans are characters of the text, from 0, end
    exclusive; passages that touch are one span. Null, empty and short texts hold none; a long text is
    indexed whole; repeated documents and items each give their own rows. The items are a stated query set; they are sent
    in blocks of ``item_block``, all of which are looked up while the corpus is read once. Items too short to be found
    are named by ``unsearchable_items``.
    """
    spark = docs.sparkSession
    source = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    kind = source.schema["doc_id"].dataType.simpleString()

    blocks, block = [], []
    for row in items.select("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == item_block:
            blocks.append(spark.sparkContext.broadcast(Passages(block, least)))
            block = []
    if block or not blocks:
        blocks.append(spark.sparkContext.broadcast(Passages(block, least)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [_Shard(shared.value) for shared in blocks]

        def rows(shard: _Shard) -> pa.RecordBatch:
            found = list(shard.found())
            columns = list(zip(*found)) if found else [[], [], [], []]
            types = (batch_type, pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "item_id", "span_start", "span_end"]
            )

        batch_type = pa.int64()
        for batch in batches:
            batch_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for shard in shards:
                    shard.add(doc, text)
                    if shard.size * len(shards) >= shard_words:
                        yield rows(shard)
        yield from map(rows, shards)

    return source.mapInArrow(run, f"doc_id {kind}, item_id bigint, span_start int, span_end int")


def unsearchable_items(items: DataFrame, least: int = 12) -> DataFrame:
    """(item_id, words): the items of fewer than ``least`` words, null and empty ones among them, which no document can be found to hold."""
    words = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), 0)), F.lit(0))
    return items.select("item_id", F.when(F.col("text").isNull(), 0).otherwise(words).alias("words")).filter(F.col("words") < least)


def leaked_items(docs: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, item_id): each document and each item of which it holds a passage, once."""
    return leaked_spans(docs, items, least).select("doc_id", "item_id").distinct()


def removal_spans(docs: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, span_start, span_end, items): the leaked places of each document, overlapping ones merged."""
    along = Window.partitionBy("doc_id").orderBy("span_start", "span_end")
    before = F.max("span_end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    spans = leaked_spans(docs, items, least).distinct()
    numbered = spans.withColumn("new", F.when(F.col("span_start") <= before, 0).otherwise(1)).withColumn(
        "n", F.sum("new").over(along)
    )
    return numbered.groupBy("doc_id", "n").agg(
        F.min("span_start").alias("span_start"),
        F.max("span_end").alias("span_end"),
        F.countDistinct("item_id").alias("items"),
    ).drop("n")
