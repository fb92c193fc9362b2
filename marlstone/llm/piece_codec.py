"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

A text gets a whitespace marker in front and one for each space. Pieces hold
markers only at their start and no line feed, so the best segmentation
of a text is that of its units (markers and what follows, or a line feed) in a row: each
different unit is segmented once, and a document's pieces are gathered from them.
It is one pass without a shuffle; the vocabulary is a fixed file of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, WordHasher, text_chunks, tidy
from .exchange import ranges
from .pieces import Vocabulary, default_model

#: Units whose pieces a task remembers.
MEMORY = 200_000
COLUMNS = "n_pieces long, n_byte_pieces long, log_score double, ids_sha256 string, round_trip boolean"


def marked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space put in front, but for empty ones."""
    full = np.diff(offsets) > 0
    return np.insert(data, offsets[:-1][full], 0x20), offsets + np.concatenate([[0], np.cumsum(full)])


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of units, and first unit of each row: cuts stand before a space after something else, and around line feeds."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    new = data == 0x20
    new[1:] &= data[:-1] != 0x20
    line = data == 0x0A
    new |= line
    new[1:] |= line[:-1]
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(new)
    return starts, np.searchsorted(starts, offsets)


class Codec:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.hasher = WordHasher()
        self.forget()

    def forget(self) -> None:
        self.memory: dict[bytes, int] = {}
        self.flat, self.sizes, self.scores = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0)

    def look_up(self, found: list[bytes]) -> np.ndarray:
        """Place of each unit in flat, sizes and scores; new ones are segmented first."""
        if len(self.memory) > MEMORY or len(self.flat) > 8 * MEMORY:
            self.forget()
        known = self.memory.get
        at = np.array([known(u, -1) for u in found], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [found[i] for i in new.tolist()]
            flat, sizes, scores = self.vocabulary.best(fresh)
            at[new] = np.arange(len(self.sizes), len(self.sizes) + len(new))
            self.memory.update(zip(fresh, at[new].tolist(), strict=True))
            self.flat, self.sizes, self.scores = (np.concatenate(x) for x in ((self.flat, flat), (self.sizes, sizes), (self.scores, scores)))
        return at

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets of rows in them, log scores of rows)."""
        data, offsets = marked(data, offsets)
        starts, rows = units(data, offsets)
        ends = np.append(starts[1:], len(data))
        _, first, at = np.unique(self.hasher(data, starts, ends), return_index=True, return_inverse=True)
        text = data.tobytes()
        found = [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        at = self.look_up(found)[at]
        sizes, scores = self.sizes, self.scores
        ids = self.flat[ranges((np.cumsum(sizes) - sizes)[at], sizes[at])]
        bounds = np.concatenate([[0], np.cumsum(sizes[at])])[rows]
        sums = np.concatenate([[0.0], np.cumsum(scores[at])])
        return ids, bounds, sums[rows[1:]] - sums[rows[:-1]]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets): pieces' bytes in a row, markers as spaces, without the first one of each row."""
        v = self.vocabulary
        lengths = v.lengths[ids]
        data = v.bytes[ranges(v.begins[ids], lengths)]
        offsets = np.concatenate([[0], np.cumsum(lengths)])[bounds]
        full = np.diff(offsets) > 0
        return np.delete(data, offsets[:-1][full]), offsets - np.concatenate([[0], np.cumsum(full)])


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row for each document row: its piece ids, their number, those of byte fallback, the log score, a hash of
    the ids, and whether decoding them gives the text back.

    Null and empty texts have no pieces and a score of 0. Repeated rows each give
    their own result; a null id is carried through; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary(model or default_model()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(held.value)
        is_byte = np.zeros(len(held.value.texts), np.int64)
        is_byte[held.value.byte_ids] = 1
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1), CHUNK_BYTES):
                ids, bounds, scores = codec.encode(data, offsets)
                back, back_offsets = codec.decode(ids, bounds)
                same = (back_offsets == offsets).all() and (back == data).all()
                trip = [True] * (end - first) if same else [back[back_offsets[i] : back_offsets[i + 1]].tobytes() == data[offsets[i] : offsets[i + 1]].tobytes() for i in range(end - first)]
                fallen = np.concatenate([[0], np.cumsum(is_byte[ids])])[bounds]
                little = ids.astype("<i4")
                hashes = [hashlib.sha256(little[a:b].tobytes()).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                columns = [batch.column(0)[first:end], pa.array(np.diff(bounds)), pa.array(np.diff(fallen)), pa.array(scores), pa.array(hashes, pa.string()), pa.array(trip, pa.bool_())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(little)))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "n_byte_pieces", "log_score", "ids_sha256", "round_trip", "ids"][: len(columns)])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(scan), f"doc_id {kind}, {COLUMNS}" + ", ids array<int>" * with_ids)


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", model: str | None = None) -> DataFrame:
    """The texts of piece ids, one row for each; null ids give an empty text. Bytes that are no UTF-8 become U+FFFD."""
    held = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model or default_model()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(held.value)
        for batch in batches:
            texts = []
            for own in batch.column(1).to_pylist():
                own = np.array(own or [], np.int32)
                data, _ = codec.decode(own, np.array([0, len(own)]))
                texts.append(data.tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema[doc_id].dataType.simpleString()
    return encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(tidy(scan), f"doc_id {kind}, text string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
