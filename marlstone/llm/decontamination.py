"""Benchmark decontamination by greedy string tiling.

Shared runs of min_words words (seeds) name the documents and test items that
can share a tile at all. For those, running Karp-Rabin greedy string tiling
(Wise 1993) marks the longest non-overlapping matches first, again and again
down to min_words; the share of an item's words under tiles is its coverage.
Tiles may stand anywhere, so a passage with its parts reordered is caught.

A tile of n words holds n - min_words + 1 seeds, so an item that is covered enough
shares a number of its seeds at least; leaving out that many less one, the
commonest, it is found by the rest (prefix). A pair is tiled only if the item's
words under shared seeds are enough. So a seed that all items have costs nothing.

It is one pass over the documents without a shuffle. The test items go to the
executors in blocks of at most block_chars characters, one after the other: a
benchmark beyond that takes one pass for each block.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmaps import without
from .common import WordHasher, class_table, lower_table, materialise, shingles, text_chunks, tidy, word_bounds

MIN_WORDS = 5
MIN_COVERAGE = 0.8
BLOCK_CHARS = 16_000_000
SCHEMA = "n_tiles long, covered_words long, item_words long, coverage double"


def tile(item: list[int], text: list[int], min_words: int, first: int = 64) -> list[tuple[int, int, int]]:
    """Tiles (item start, text start, length), strictly longest first; of equal ones the first in the item, then in the text. Negative words match nothing.

    Each round looks for matches of the current length or more by rolling hashes
    over the unmarked words and marks them from the longest down. A match that a
    tile cuts into goes back among the others with what is left of it. Then the
    length is halved, until min_words.
    """
    free_item = bytearray(w >= 0 for w in item)
    free_text = bytearray(w >= 0 for w in text)
    tiles: list[tuple[int, int, int]] = []
    length = max(min_words, min(first, len(item)))
    while True:
        found: list[tuple[int, int, int]] = []
        places = defaultdict(list)
        for start, value in _rolling(text, free_text, length):
            places[value].append(start)
        for i, value in _rolling(item, free_item, length):
            inside = i and free_item[i - 1]
            for j in places.get(value, ()):
                if inside and j and free_text[j - 1] and item[i - 1] == text[j - 1]:
                    continue  # part of the match that begins a word earlier
                k = 0
                for x, y, f, g in zip(item[i:], text[j:], free_item[i:], free_text[j:], strict=False):
                    if x != y or not f or not g:
                        break
                    k += 1
                if k >= length:
                    found.append((-k, i, j))
        heapify(found)
        while found:
            k, i, j = heappop(found)
            at = 0
            while at < -k:
                end = at
                while end < -k and free_item[i + end] and free_text[j + end]:
                    end += 1
                if end == -k and at == 0:
                    free_item[i : i + end] = free_text[j : j + end] = bytes(end)
                    tiles.append((i, j, end))
                elif end - at >= length:
                    heappush(found, (at - end, i + at, j + at))
                at = end + 1
        if length == min_words:
            return tiles
        length = max(min_words, length // 2)


def _rolling(words: list[int], free: bytearray, length: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of each run of so many free words."""
    base, mod = 1_000_003, (1 << 61) - 1
    top = pow(base, length, mod)
    value = run = 0
    for at, word in enumerate(words):
        if not free[at]:
            value = run = 0
            continue
        value = (value * base + word) % mod
        run += 1
        if run > length:
            value = (value - words[at - length] * top) % mod
        if run >= length:
            yield at - length + 1, value


class Block:
    """A bounded block of test items with their seeds."""

    def __init__(self, items: list[tuple[object, str]], min_words: int, min_coverage: float) -> None:
        self.min_words, self.min_coverage = min_words, min_coverage
        hasher, is_word, lower = WordHasher(), class_table("alnum"), lower_table()
        self.ids: list[object] = []
        self.words: list[np.ndarray] = []
        self.own: list[np.ndarray] = []  # the seed at each place of an item
        widths: dict[int, list[int]] = {}
        for item_id, text in items:
            data = lower[np.frombuffer((text or "").encode(), dtype=np.uint8)]
            starts, ends, _ = word_bounds(data, np.array([0, len(data)]), is_word)
            words = hasher(data, starts, ends)
            if not len(words):
                continue
            width = min(min_words, len(words))
            widths.setdefault(width, []).append(len(self.ids))
            self.ids.append(item_id)
            self.words.append(words)
            self.own.append(shingles(words, width))
        self.seeds = {}
        for width, members in widths.items():
            h = np.concatenate([np.unique(self.own[i]) for i in members])
            unique, count = np.unique(h, return_counts=True)
            posted = [self.rarest(i, width, unique, count) for i in members]
            h, o = np.concatenate(posted), np.repeat(members, [len(x) for x in posted])
            order = np.argsort(h, kind="stable")
            sieve = np.zeros(1 << 20, bool)
            sieve[(h >> np.uint64(44)).astype(np.int64)] = True
            self.seeds[width] = (h[order], o[order], sieve)

    def rarest(self, i: int, width: int, unique: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The seeds under which an item is found: all but so many common ones as it can lack and yet be covered."""
        own, times = np.unique(self.own[i], return_counts=True)
        common = count[np.searchsorted(unique, own)]
        order = np.lexsort((own, -common))
        spare = math.ceil(math.ceil(self.min_coverage * len(self.words[i])) / width) - 1
        return own[order][np.cumsum(times[order]) > spare]

    def matches(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, tiles, covered words) for each item that the words of a document may cover enough."""
        for width, (hashes, owners, sieve) in self.seeds.items():
            if len(words) < width:
                continue
            own = shingles(words, width)
            some = np.unique(own[sieve[(own >> np.uint64(44)).astype(np.int64)]])
            low, high = np.searchsorted(hashes, some), np.searchsorted(hashes, some, side="right")
            items = np.unique(np.concatenate([owners[a:b] for a, b in zip(low, high, strict=True)])) if len(some) else ()
            there = np.unique(own) if len(items) else own
            for item in map(int, items):
                seeds = self.own[item]
                under = np.zeros(len(self.words[item]) + 1, np.int64)
                shared = np.flatnonzero(there[np.minimum(np.searchsorted(there, seeds), len(there) - 1)] == seeds)
                np.add.at(under, shared, 1)
                np.add.at(under, shared + width, -1)
                if (np.cumsum(under) > 0).sum() < self.min_coverage * len(self.words[item]):
                    continue
                kept: list[int] = []  # only the words under seeds can lie under a tile
                end = -1
                for a in np.flatnonzero(np.isin(own, seeds)).tolist():
                    if a > end:
                        kept.append(-1)
                    kept.extend((words[max(a, end) : a + width] >> np.uint64(4)).tolist())
                    end = a + width
                tiles = tile((self.words[item] >> np.uint64(4)).tolist(), kept, width)
                yield item, len(tiles), sum(k for _, _, k in tiles)


def blocks(items: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about block_chars characters, read one by one, so that what is sent out stays bounded."""
    total = items.agg(F.sum(F.length(text))).first()[0] or 0
    n = -(-total // block_chars) or 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64(text), F.lit(n)) == k) if n > 1 else items
        yield [(r[0], r[1]) for r in part.select(item_id, text).where(F.col(text).isNotNull()).collect()]


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, min_coverage: float = MIN_COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document row and item with coverage >= min_coverage.

    Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters. An
    item of fewer than min_words words must appear as a whole. Null or empty
    texts and items without words match nothing; repeated rows each give their
    own result; a null id is carried through; texts of any length are read whole;
    matches of one length are marked in the order of the item, then of the text.
    Other columns are ignored. With several blocks, each one's rows are written to
    the shared folder and its items are let go before the next one is read.
    """
    spark = docs.sparkSession
    id_type = items.schema[item_id].dataType.simpleString()
    out, before = None, None
    for block in blocks(items, item_id, item_text, block_chars):
        if before is not None:
            out = materialise(out, "block")
            before.destroy()
        held = before = spark.sparkContext.broadcast(Block(block, min_words, min_coverage))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            hasher, is_word, lower, block = WordHasher(), class_table("alnum"), lower_table(), held.value
            for batch in batches:
                rows: list[tuple] = []
                for first, _, data, offsets in text_chunks(batch.column(1)):
                    data = lower[data]
                    starts, ends, bounds = word_bounds(data, offsets, is_word)
                    words = hasher(data, starts, ends)
                    for row in suspects(words, bounds, block):
                        for item, n_tiles, covered in block.matches(words[bounds[row] : bounds[row + 1]]):
                            size = len(block.words[item])
                            if covered >= min_coverage * size:
                                rows.append((first + row, block.ids[item], n_tiles, covered, size, covered / size))
                at, *rest = zip(*rows, strict=True) if rows else ([],) * 6
                columns = [batch.column(0).take(pa.array(at, pa.int64())), *map(pa.array, rest)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "n_tiles", "covered_words", "item_words", "coverage"]) if rows else pa.RecordBatch.from_arrays([batch.column(0)[:0], pa.array([], pa.int64()), *[pa.array([], pa.int64())] * 3, pa.array([], pa.float64())], names=["doc_id", "item_id", "n_tiles", "covered_words", "item_words", "coverage"])

        kind = docs.schema[doc_id].dataType.simpleString()
        part = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(scan), f"doc_id {kind}, item_id {id_type}, {SCHEMA}")
        out = part if out is None else out.unionByName(part)
    return out


def suspects(words: np.ndarray, bounds: np.ndarray, block: Block) -> np.ndarray:
    """Rows of a chunk with a word run that the sieve lets through; runs across rows only add false alarms."""
    rows: list[np.ndarray] = []
    for width, (_, _, sieve) in block.seeds.items():
        if len(words) >= width:
            at = np.flatnonzero(sieve[(shingles(words, width) >> np.uint64(44)).astype(np.int64)])
            rows.append(np.searchsorted(bounds, at, side="right") - 1)
    return np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64)


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no test item; their columns stay as they are. Documents without an id stay."""
    bad = contamination(docs, items, **options).select("doc_id").where("doc_id is not null").distinct()
    return without(docs, options.get("doc_id", "doc_id"), materialise(bad, "contaminated"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
