import pytest

from marlstone.llm import bitmaps


@pytest.mark.parametrize("bits", [1 << 25, 64, 3])
def test_without_is_an_anti_join(spark, monkeypatch, bits):
    monkeypatch.setattr(bitmaps, "BITS", bits)
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(300)] + [(7, "again"), (None, "none")], "doc_id long, text string")
    gone = spark.createDataFrame([(i,) for i in range(0, 300, 7)] + [(10**12,)], "k long")
    out = bitmaps.without(rows, "doc_id", gone)
    assert out.columns == rows.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([i for i in range(300) if i % 7] + [None], key=str)
    assert bitmaps.without(rows, "doc_id", gone.limit(0)).count() == 302 and bitmaps.without(rows.limit(0), "doc_id", gone).count() == 0


def test_set_bits_are_found(spark):
    values = spark.range(20_000).selectExpr("id * 7919 AS k")
    got = bitmaps.marked(spark.range(0, 20_000 * 7919, 7919).selectExpr("id AS k"), bitmaps.F.col("k"), bitmaps.bitmap(values), "maybe")
    assert got.where("maybe").count() == 20_000
    others = bitmaps.marked(spark.range(1, 20_000 * 7919, 7919).selectExpr("id AS k"), bitmaps.F.col("k"), bitmaps.bitmap(values), "maybe")
    assert others.where("maybe").count() < 100
