"""What the operators share: text buffers, word hashing, shared folders.

Texts are handled as UTF-8 bytes in numpy: a batch of rows becomes one byte
array with row offsets, so a pass over the text is a handful of vector
operations instead of a Python step per character.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegralType

# Functions travel to the executors with their code, so that those need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: Bytes of text handled at once; eight-byte work arrays of this length stay near the CPU's cache.
CHUNK_BYTES = 1 << 20

#: Stand-ins for the shared folder, by application.
LOCAL: dict[str, str] = {}

SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir, which driver and executors share.

    Where that setting is missing, a temporary folder stands in, one for each
    application, if all of it runs in one process; on a cluster that would be
    another folder on each machine, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in LOCAL:
            LOCAL[app] = tempfile.mkdtemp(prefix="marlstone-")
        base = LOCAL[app]
    return base.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_base(spark)}/{uuid.uuid4().hex}"


def whole_numbers(df: DataFrame, column: str) -> None:
    """Raises where a column of ids isn't of an integer type: a cast would make other ids null."""
    kind = df.schema[column].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{column} must be of an integer type, not {kind.simpleString()}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Gives freed memory back to the system. Python workers outlive their tasks, and several of them share an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, giving its memory back when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (Steele, Lea and Flood 2014), on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random uint64, from their rank and seed alone."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about limit bytes; null texts are empty.

    A row longer than the limit makes a chunk of its own.
    """
    for array in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        array = array.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(array.buffers()[1], dtype=np.int64, count=len(array) + 1, offset=array.offset * 8) if len(array) else np.zeros(1, np.int64)
        data = np.frombuffer(array.buffers()[2] or b"", dtype=np.uint8)
        row = 0
        while row < len(array):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
            own = offsets[row : end + 1]
            yield row, end, data[own[0] : own[-1]], own - own[0]
            row = end


def class_table(kind: str) -> np.ndarray:
    """Which bytes belong to words. blank: all but ASCII white space. alnum: 0-9, a-z and all bytes from 0x80 on."""
    if kind == "blank":
        out = np.ones(256, bool)
        out[list(SPACE)] = False
        return out
    out = np.zeros(256, bool)
    out[0x30:0x3A] = out[0x61:0x7B] = out[0x80:] = True
    return out


def lower_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[0x41:0x5B] += 32
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row): words are maximal runs of word bytes within a row."""
    inside = is_word[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    starts[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cuts[cuts > 0] - 1
    last[before] = inside[before]
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(last) + 1, np.searchsorted(at, offsets)


class WordHasher:
    """64-bit hashes of byte ranges: a polynomial over randomised byte values, mixed at the end."""

    def __init__(self, seed: int = 11) -> None:
        self.values = random64(256, seed) | np.uint64(1)
        self.base = int(random64(1, seed + 1)[0] | np.uint64(5))
        self.size = 0

    def _grow(self, n: int) -> None:
        if n > self.size:
            inverse = pow(self.base, -1, 1 << 64)
            with np.errstate(over="ignore"):
                for name, b in (("power", self.base), ("back", inverse)):
                    steps = np.full(n, b, dtype=np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.cumprod(steps))
            self.size = n

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), dtype=np.uint64)
        at = 0
        while at < len(starts):
            low = starts[at]
            end = max(at + 1, int(np.searchsorted(ends, low + CHUNK_BYTES, side="right")))
            part = data[low : ends[end - 1]]
            self._grow(len(part) + 1)
            with np.errstate(over="ignore"):
                sums = np.zeros(len(part) + 1, dtype=np.uint64)
                np.cumsum(self.values[part] * self.power[: len(part)], out=sums[1:])
                s = starts[at:end] - low
                e = ends[at:end] - low
                out[at:end] = mix((sums[e] - sums[s]) * self.back[s] + (e - s).astype(np.uint64))
            at = end
        return out


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words; with fewer words, of the whole sequence; of none, none."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    weights = random64(width, 100 + width) | np.uint64(1)
    with np.errstate(over="ignore"):
        out = words[: n - width + 1] * weights[0]
        for i in range(1, width):
            out += words[i : n - width + 1 + i] * weights[i]
        return mix(out + np.uint64(width))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
