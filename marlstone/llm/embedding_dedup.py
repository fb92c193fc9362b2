"""Embedding near-dedup by randomised-rotation binary codes (RaBitQ, Gao and Long 2024).

A unit vector o is rotated at random and kept as the signs of its coordinates
(code c, as a unit vector) with the correction factor f = <c, o>. For another
unit vector q, <c, q> / f is an unbiased estimate of <o, q> whose error has a
standard deviation of sqrt((1 - f^2) / f^2 / (D - 1)). q itself is stored with 8
bits a coordinate and the norm of what that leaves out, which bounds its error.

1. Equal vectors are one class from here on. Each class is indexed once: code,
   factor, rounded vector, and its keys in hash tables over sign bits of a few
   rotations; the number and width of tables follow the number of classes, for a
   chance to miss a pair at the threshold below MISS.
2. What travels to the tables' buckets is the index entry, not the vector. There,
   a pair is ruled out if the upper bound of either side's estimate, EPSILON
   deviations up, is below the threshold; a vector with a pair left is called for.
3. Vectors that are called for come to those buckets, and their pairs are computed
   in double precision. A pair that meets in several tables counts in the first.

Buckets over BLOCK entries are compared block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import materialise, release, tidy, whole_numbers
from .components import components, join_hot

THRESHOLD = 0.95
EPSILON = 4.0
MISS = 1e-5
BLOCK = 2048
#: Vectors of a bucket on average; smaller buckets need more tables.
BUCKET = 512
ROTATIONS = 4
GROUP = ["t", "dim", "key", "i", "j"]


def rotations(dim: int, count: int = ROTATIONS) -> list[np.ndarray]:
    rng = np.random.default_rng(1000 + dim)
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return out


def table_plan(count: int, threshold: float) -> tuple[int, int]:
    """(bits of a key, tables) for so many vectors."""
    bits = min(24, max(2, math.ceil(math.log2(max(count, 2) / BUCKET))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - meet))


def rotation_count(dim: int, bits: int, tables: int) -> int:
    """So many that no two tables share a sign."""
    return max(ROTATIONS, math.ceil(bits * tables / dim))


def chosen_bits(dim: int, bits: int, tables: int) -> np.ndarray:
    rng = np.random.default_rng(2000 + dim)
    return rng.permutation(rotation_count(dim, bits, tables) * dim)[: bits * tables].reshape(tables, bits)


def unit(lists: list) -> np.ndarray:
    x = np.array(lists, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def entries(turned: np.ndarray) -> np.ndarray:
    """Index entries of rotated unit vectors, as rows of bytes: code, factor, least coordinate, step, norm left out, rounded coordinates."""
    dim = turned.shape[1]
    low = turned.min(1, keepdims=True)
    step = np.maximum((turned.max(1, keepdims=True) - low) / 255, 1e-12)
    low, step = low.astype(np.float32), step.astype(np.float32)
    whole = np.clip(np.rint((turned - low) / step), 0, 255).astype(np.uint8)
    rest = np.sqrt(((turned - (low + step * whole.astype(np.float32))) ** 2).sum(1, keepdims=True)) * (1 + 1e-6)
    factor = np.abs(turned).sum(1, keepdims=True) / math.sqrt(dim)
    head = np.concatenate([factor, low, step, rest], axis=1).astype(np.float32)
    return np.concatenate([np.packbits(turned > 0, axis=1), np.ascontiguousarray(head).view(np.uint8), whole], axis=1)


def read_entries(blocks: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signs as 1 and -1, factor, norm left out, rounded vectors)."""
    raw = np.frombuffer(b"".join(blocks), np.uint8).reshape(len(blocks), -1)
    size = (dim + 7) // 8
    signs = np.unpackbits(raw[:, :size], axis=1)[:, :dim].astype(np.float32) * 2 - 1
    factor, low, step, rest = np.ascontiguousarray(raw[:, size : size + 16]).view(np.float32).T
    return signs, factor, rest, low[:, None] + step[:, None] * raw[:, size + 16 :].astype(np.float32)


def upper_bounds(entry: tuple, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """What the inner products of these rows may reach, by the codes of own and the vectors of other."""
    signs, factor, rest, near = entry
    dim = signs.shape[1]
    f = factor[own, None]
    slack = EPSILON * np.sqrt(np.maximum(1 - f * f, 0) / (f * f) / max(dim - 1, 1))
    return signs[own] @ near[other].T / (math.sqrt(dim) * f) + slack + rest[other] / f + 1e-5


def called_for(entry: tuple, side: np.ndarray, cross: bool, threshold: float) -> np.ndarray:
    """Which rows of a bucket have a pair (of its two sides, if cross) that the bounds don't rule out."""
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (np.arange(len(side)),) * 2
    out = np.zeros(len(side), bool)
    for a in range(0, len(left), 256):
        own = left[a : a + 256]
        open_ = (upper_bounds(entry, own, right) >= threshold) & (upper_bounds(entry, right, own).T >= threshold)
        if not cross:
            open_[np.arange(len(own)), own] = False
        out[own] |= open_.any(1)
        out[right] |= open_.any(0)
    return out


def compare(t: int, x: np.ndarray, keys: np.ndarray, cls: np.ndarray, reps: np.ndarray, weights: np.ndarray, side: np.ndarray, cross: bool, threshold: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """((class, vectors linked to it), links that connect representatives) of a bucket; cross: of its two sides."""
    edges: list[tuple[int, int]] = []
    part, total = np.arange(len(x)), np.zeros(len(x), np.int64)
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (np.arange(len(x)),) * 2
    for a in range(0, len(left), 256):
        own = left[a : a + 256]
        i, j = np.nonzero(x[own] @ x[right].T >= threshold - 1e-9)
        i, j = own[i], right[j]
        later = np.ones(len(i), bool) if cross else i < j
        i, j = i[later], j[later]
        near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        i, j = i[near], j[near]
        if t:
            first = ~(keys[i, :t] == keys[j, :t]).any(1)
            i, j = i[first], j[first]
        np.add.at(total, i, weights[j])
        np.add.at(total, j, weights[i])
        for k, m in zip(i.tolist(), j.tolist(), strict=True):
            if part[k] != part[m]:
                edges.append((int(reps[k]), int(reps[m])))
                part[part == part[m]] = part[k]
    some = np.flatnonzero(total)
    return list(zip(cls[some].tolist(), total[some].tolist(), strict=True)), edges


def indexed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """The classes with their dimension, index entry and keys in the tables."""
    kind = classes.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            size = np.array(batch.column(0).value_lengths().to_pylist(), np.int64)
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                turn, places = held[dim] if dim in held else held.setdefault(dim, (np.concatenate(rotations(dim, rotation_count(dim, bits, tables))), chosen_bits(dim, bits, tables)))
                weights = 1 << np.arange(places.shape[1])
                for a in range(0, len(at), 1024):
                    part = batch.take(pa.array(at[a : a + 1024]))
                    turned = unit(part.column(0).to_pylist()) @ turn.T
                    keys = ((turned > 0)[:, places] @ weights).astype(np.int32)
                    columns = [*part.columns, pa.array(np.full(part.num_rows, dim)), pa.array([e.tobytes() for e in entries(turned[:, :dim])], pa.binary()), pa.array(list(keys), pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["embedding", "h1", "h2", "rep", "weight", "cls", "dim", "entry", "keys"])

    columns = classes.select("embedding", "h1", "h2", "rep", "weight", F.monotonically_increasing_id().alias("cls"))
    return columns.mapInArrow(tidy(run), f"embedding {kind}, h1 long, h2 int, rep long, weight long, cls long, dim long, entry binary, keys array<int>")


def good(v: Column) -> Column:
    """Whether a vector may link: not null, not all zero, finite throughout."""
    return F.coalesce(v.isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def found_links(index: DataFrame, threshold: float) -> DataFrame:
    """(a, n, b): n vectors linked to class a; or with b, a link of two representatives."""
    posted = index.select("cls", "dim", "entry", F.posexplode("keys").alias("t", "key"))
    large = index.select("dim", F.posexplode("keys").alias("t", "key")).groupBy("t", "dim", "key").count().where(F.col("count") > BLOCK).select("t", "dim", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    sized = posted.join(large, ["t", "dim", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    sized = sized.withColumn("place", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("t", "dim", "key", F.least("place", "other").alias("i"), F.greatest("place", "other").alias("j"), (F.col("place") > F.col("other")).cast("int").alias("side"), "cls", "entry")

    def call(key, rows):
        _, dim, _, i, j = (k.as_py() for k in key)
        side = rows.column("side").to_numpy()
        some = pa.array(np.flatnonzero(called_for(read_entries(rows.column("entry").to_pylist(), dim), side, i != j, threshold)))
        release()
        return rows.select([*GROUP, "side", "cls"]).take(some)

    called = dealt.groupBy(*GROUP).applyInArrow(call, "t int, dim long, key int, i int, j int, side int, cls long")
    whole = called.join(index.select("cls", "embedding", "keys", "rep", "weight"), "cls")

    def run(key, rows):
        t, *_, i, j = (k.as_py() for k in key)
        cls, reps, weights, side = (rows.column(c).to_numpy() for c in ("cls", "rep", "weight", "side"))
        keys = np.array(rows.column("keys").to_pylist(), np.int32)
        counts, edges = compare(t, unit(rows.column("embedding").to_pylist()), keys, cls, reps, weights, side, i != j, threshold)
        release()
        out = [(c, n, None) for c, n in counts] + [(a, 0, b) for a, b in edges]
        a, n, b = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "n": pa.array(n, pa.int64()), "b": pa.array(b, pa.int64())})

    return whole.groupBy(*GROUP).applyInArrow(run, "a long, n long, b long")


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row: n_links, component_id, kept.

    Null or zero vectors, those of no components and those with null or
    non-finite ones link with nothing; neither do rows without an id (component
    null, kept). Vectors of different lengths don't link. Repeated rows count as
    vectors of their own. Vectors of one id have each their own links and one
    component, since what one of them reaches, the id reaches. Ids that aren't
    whole numbers are an error. Other columns are ignored.
    """
    whole_numbers(vectors, vec_id)
    kind = vectors.schema[embedding].dataType
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding) if kind == ArrayType(FloatType(), kind.containsNull) else F.col(embedding).cast("array<double>"))
    own = own.toDF("vec_id", "embedding").withColumn("good", F.col("vec_id").isNotNull() & good(F.col("embedding")))
    same = F.transform("embedding", lambda x: x + F.lit(0).cast(own.schema["embedding"].dataType.elementType))  # -0 is 0
    rows = own.where("good").select("vec_id", same.alias("embedding")).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.hash("embedding"))
    classes = materialise(rows.groupBy("embedding").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "classes")
    count, total = classes.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    index = materialise(indexed(classes, *table_plan(count, threshold)), "index")
    found = materialise(found_links(index, threshold), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    ids = rows.select("vec_id", "h1", "h2").unionByName(own.where("not good and vec_id is not null").selectExpr("vec_id", "cast(null as long) AS h1", "cast(null as int) AS h2"))
    several = ids.groupBy("vec_id").agg(F.min(F.struct("h1", "h2")).alias("a"), F.max(F.struct("h1", "h2")).alias("b")).where("a <> b").select("vec_id")
    named = index.select("cls", "h1", "h2", "rep", "weight")
    versions = rows.select("vec_id", "h1", "h2").join(several, "vec_id", "left_semi").distinct().join(named.select("h1", "h2", "rep"), ["h1", "h2"]).select("vec_id", "rep")
    linked = components(found.where("b is not null").select("a", "b").unionByName(versions.toDF("a", "b")))
    named = named.join(counts, "cls", "left").join(linked, F.col("rep") == F.col("node"), "left")
    named = named.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"), "weight")
    out = join_hot(rows.select("vec_id", "h1", "h2"), named, ["h1", "h2"], "weight", total).select("vec_id", "n_links", "component")
    alone = own.where("not good").select("vec_id").join(linked, F.col("vec_id") == F.col("node"), "left").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
    return out.unionByName(alone).withColumnRenamed("component", "component_id").withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
