import random

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm.exchange import Buckets, decode, encode, ranges, spark_hash


def test_blocks_come_back():
    arrays = [np.array([1, 2**63 - 1, -5]), np.zeros(0, np.uint8), np.array([3, 4], np.uint16), np.array([0.5])]
    back = decode(encode(*arrays))
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, back, strict=True))


def test_ranges():
    rnd = random.Random(0)
    spans = [(rnd.randint(0, 50), rnd.randint(0, 4)) for _ in range(30)]
    want = [k for a, n in spans for k in range(a, a + n)]
    assert ranges(np.array([a for a, _ in spans]), np.array([n for _, n in spans])).tolist() == want


def test_names_spread_over_partitions(spark):
    rows = spark.range(200).select(F.col("id").cast("int").alias("i")).select("i", F.hash("i").alias("h")).collect()
    assert all(spark_hash(r.i) == r.h for r in rows)
    b = Buckets(13)
    assert sorted(spark_hash(x) % 13 for x in b.names[:13]) == list(range(13)) and len(set(b.names)) == 26
