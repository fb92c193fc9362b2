"""Bucketed exchanges: documents are dealt to buckets once, questions about their
parts go to key buckets, and the answers come back to the same document buckets.

Rows that would each hold a few bytes travel as compressed column blocks, one
for each sender and receiver. A bucket holds a bounded share of the documents
(their number follows spark.sql.shuffle.partitions), and a key that many
documents share sends one record for each document bucket, not for each document.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, mix, partitions, release, text_chunks, tidy, whole_numbers

#: Text that one packing task holds before it sends its blocks.
PACK_BYTES = 24 << 20
#: Stands for a null id; it is larger than every id.
NO_ID = np.iinfo(np.int64).max
DEALT = "b int, kind int, src int, block binary"


def encode(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd block, byte planes apart so that high bytes compress away."""
    parts = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        code = a.dtype.str.encode()
        parts.append(struct.pack("<BQ", len(code), len(a)) + code)
        parts.append(a.tobytes() if a.itemsize == 1 else np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def decode(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    out, at = [], 1
    for _ in range(raw[0]):
        size, n = struct.unpack_from("<BQ", raw, at)
        kind = np.dtype(raw[at + 9 : at + 9 + size].decode())
        at += 9 + size
        data = np.frombuffer(raw, dtype=np.uint8, count=n * kind.itemsize, offset=at)
        at += n * kind.itemsize
        out.append(data.view(kind) if kind.itemsize == 1 else np.ascontiguousarray(data.reshape(kind.itemsize, n).T).reshape(-1).view(kind))
    return out


def cut(keys: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of each bucket present in sorted bucket numbers."""
    bounds = np.searchsorted(keys, np.arange(n + 1))
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        yield b, slice(int(bounds[b]), int(bounds[b + 1]))


def spark_hash(value: int) -> int:
    """Spark's hash of an int (Murmur3, seed 42), by which it deals groups to partitions."""
    low = 0xFFFFFFFF
    k = value * 0xCC9E2D51 & low
    k = ((k << 15) | (k >> 17)) * 0x1B873593 & low
    h = 42 ^ k
    h = (((h << 13) | (h >> 19)) & low) * 5 + 0xE6546B64 & low
    h ^= 4
    h = (h ^ (h >> 16)) * 0x85EBCA6B & low
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & low
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


class Buckets:
    """n buckets, and n more that only pass messages on; names are their keys in rows.

    There are as many as shuffle partitions, and each of the n has a name that
    Spark's hash deals to a partition of its own.
    """

    def __init__(self, n: int) -> None:
        self.n = n
        own: list[list[int]] = [[] for _ in range(n)]
        short, value = 2 * n, 0
        while short:
            place = own[spark_hash(value) % n]
            if len(place) < 2:
                place.append(value)
                short -= 1
            value += 1
        self.names = [x[0] for x in own] + [x[1] for x in own]
        self.index = {name: i for i, name in enumerate(self.names)}

    def batch(self, rows: Iterable[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        """Rows of DEALT, from (bucket, kind, source, block)."""
        b, kind, src, block = zip(*rows, strict=True) if (rows := list(rows)) else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array([self.names[i] for i in b], pa.int32()), pa.array(kind, pa.int32()), pa.array(src, pa.int32()), pa.array(block, pa.binary())], names=["b", "kind", "src", "block"])


def buckets_for(docs: DataFrame) -> Buckets:
    return Buckets(partitions(docs.sparkSession))


def deal(docs: DataFrame, doc_id: str, text: str, buckets: Buckets) -> DataFrame:
    """The documents in buckets by their id, as blocks of (ids, lengths, bytes). Null texts are empty; ids that aren't whole numbers are an error."""
    whole_numbers(docs, doc_id)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, end, data, offsets in text_chunks(batch.column(1)):
                held.append((ids[first:end], np.diff(offsets), data.copy()))
                size += len(data)
                if size >= PACK_BYTES:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    def flush(held: list) -> pa.RecordBatch:
        ids, lengths, data = (np.concatenate(x) for x in zip(*held, strict=True))
        with np.errstate(over="ignore"):
            spread = np.where(ids == NO_ID, np.arange(len(ids)), 0).astype(np.uint64)
            bucket = (mix(ids.view(np.uint64) + np.uint64(77) + mix(spread)) % np.uint64(buckets.n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        rows = []
        for b, part in cut(bucket[order], buckets.n):
            own = order[part]
            rows.append((b, 0, 0, encode(ids[own], lengths[own], data[ranges(offsets[own], lengths[own])])))
        return buckets.batch(rows)

    ids = F.col(doc_id).cast("long").alias("id")
    return docs.select(ids, F.col(text).alias("text")).mapInArrow(tidy(pack), DEALT)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all [start, start + length) in a row."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def blocks_of(rows: pa.Table) -> Iterator[tuple[int, int, int, bytes]]:
    return zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True)


def texts_of(blocks: Iterable[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, offsets, bytes) of chunks of about limit bytes out of dealt blocks."""
    for block in blocks:
        ids, lengths, data = decode(block)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        row = 0
        while row < len(ids):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
            yield ids[row:end], offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
            row = end


def trimmed(result: pa.Table) -> pa.Table:
    """The result of a group, after the memory that it took is given back."""
    release()
    return result


def ask(dealt: DataFrame, buckets: Buckets, question: Callable[[int, list[bytes]], Iterable[tuple]]) -> DataFrame:
    """question(bucket, document blocks) -> rows, the bucket in them being the key bucket that answers."""

    def run(key, rows):
        return trimmed(pa.Table.from_batches([buckets.batch(question(buckets.index[key[0].as_py()], [x[3] for x in blocks_of(rows)]))]))

    return dealt.groupBy("b").applyInArrow(run, DEALT)


def answer(asked: DataFrame, buckets: Buckets, reply: Callable[[int, list[tuple]], Iterable[tuple]]) -> DataFrame:
    """reply(key bucket, rows) -> rows, the bucket in them being the document bucket that asked."""

    def run(key, rows):
        return trimmed(pa.Table.from_batches([buckets.batch(reply(buckets.index[key[0].as_py()], list(blocks_of(rows))))]))

    return asked.groupBy("b").applyInArrow(run, DEALT)


def conclude(asked: DataFrame, buckets: Buckets, last: Callable[[int, list[tuple]], pa.Table], schema: str) -> DataFrame:
    """last(key bucket, rows) -> table of the schema, in the worker that has the rows: another function behind answer() would take a second one in each task."""

    def run(key, rows):
        return trimmed(last(buckets.index[key[0].as_py()], list(blocks_of(rows))))

    return asked.groupBy("b").applyInArrow(run, schema)


def ask_again(dealt: DataFrame, replies: DataFrame, buckets: Buckets, question: Callable[[int, list[bytes], list[tuple]], Iterable[tuple]]) -> DataFrame:
    """question(bucket, document blocks, replies) -> rows. The dealt documents' exchange is used again."""

    def run(key, left, right):
        return trimmed(pa.Table.from_batches([buckets.batch(question(buckets.index[key[0].as_py()], [x[3] for x in blocks_of(left)], list(blocks_of(right))))]))

    return dealt.groupBy("b").cogroup(replies.groupBy("b")).applyInArrow(run, DEALT)


def gather(dealt: DataFrame, replies: DataFrame, buckets: Buckets, finish: Callable[[int, list[bytes], list[tuple]], pa.Table], schema: str) -> DataFrame:
    """finish(bucket, document blocks, replies) -> table of the schema."""

    def run(key, left, right):
        return trimmed(finish(buckets.index[key[0].as_py()], [x[3] for x in blocks_of(left)], list(blocks_of(right))))

    return dealt.groupBy("b").cogroup(replies.groupBy("b")).applyInArrow(run, schema)
