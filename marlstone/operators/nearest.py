"""Nearest neighbours of a stated query set, by matrix products of blocks."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Functions travel with their code; executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors of a block; distances of this many by as many are one product.
BLOCK = 2048
DIGITS = 4


def blocks(vectors: DataFrame) -> DataFrame:
    """(id, vector) in blocks (size, ids, matrix) as bytes; vectors that are null or hold nulls are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_pylist()
            for size in sorted({len(v) for v in lists}):
                at = [i for i, v in enumerate(lists) if len(v) == size]
                for a in range(0, len(at), BLOCK):
                    part = at[a : a + BLOCK]
                    matrix = np.array([lists[i] for i in part], np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([ids[part].tobytes()]), pa.array([matrix.tobytes()])], names=["size", "ids", "matrix"])

    good = F.col("vector").isNotNull() & ~F.coalesce(F.exists("vector", lambda x: x.isNull()), F.lit(False))
    return vectors.where(good & F.col("id").isNotNull()).select("id", "vector").mapInArrow(run, "size long, ids binary, matrix binary")


def closest(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(probe, id, distance) of each probe's k nearest others in a block; the product chooses, plain differences decide."""
    square = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T
    rough = np.sqrt(np.maximum(square, 0))
    rough[a[:, None] == b] = np.inf
    limit = np.partition(rough, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
    row, col = np.nonzero((rough <= limit[:, None] + 10.0**-DIGITS + 1e-6) & np.isfinite(rough))
    exact = np.round(np.sqrt(((x[row] - y[col]) ** 2).sum(1)), DIGITS)
    order = np.lexsort((b[col], exact, row))
    row, col, exact = row[order], col[order], exact[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    for i in np.flatnonzero(rank < k).tolist():
        yield int(a[row[i]]), int(b[col[i]]), float(exact[i])


def nearest(probes: DataFrame, vectors: DataFrame, k: int = 2) -> DataFrame:
    """(probe, id, distance, rank): the k nearest vectors of each probe but itself, by distance to DIGITS places and then by id.

    Both sides have columns id and vector. The vectors' blocks are dealt to as many
    groups as there are shuffle partitions, and each group sees all the probes'
    blocks; a group gives k rows for a probe and block of vectors.
    """
    groups = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = blocks(probes).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).toDF("size", "pids", "pmatrix", "g")
    right = blocks(vectors).withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (np.frombuffer(parts[i], np.int64) for i in (0, 2))
                x, y = (np.frombuffer(parts[i], np.float64).reshape(-1, size) for i in (1, 3))
                found = list(closest(a, x, b, y, k))
                columns = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["probe", "id", "distance"])

    pairs = left.join(right, ["g", "size"]).select("size", "pids", "pmatrix", "ids", "matrix")
    found = pairs.mapInArrow(run, "probe long, id long, distance double")
    rank = F.row_number().over(W.partitionBy("probe").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
