import json

from pyspark.sql import functions as F

from marlstone.sources import files


def test_registry_is_text_with_null_blanks(spark, tmp_path):
    (tmp_path / "r.csv").write_text('id,"bmi (kg/m2)",note\n1,22.5,"a, ""b"""\n2,,é\n')
    df = files.read_registry(spark, str(tmp_path / "r.csv"))
    assert [tuple(r) for r in df.orderBy("key").collect()] == [("H1", "22.5", 'a, "b"'), ("H2", None, "é")]
    assert set(dict(df.dtypes).values()) == {"string"}


def test_webhook(spark):
    body = {"entry": [{"changes": [{"value": {"messages": [{"from": "1", "type": "text", "text": {"body": "hi"}}, {"from": "1", "type": "interactive", "interactive": {"list_reply": {"id": "x", "title": "X"}}}, {"from": "2", "type": "image", "image": {"id": "m1"}}, {"from": "2", "type": "audio"}]}}]}]}
    out = files.webhook_messages(spark.createDataFrame([(json.dumps(body),), ("no json",), (None,)], "payload string"))
    assert sorted(tuple(r) for r in out.collect()) == [("1", "button", "x"), ("1", "text", "hi"), ("2", "photo", "m1")]


def test_outgoing_and_export(spark, tmp_path):
    df = spark.createDataFrame([("m", [f"b{i}" for i in range(n)]) for n in (0, 2, 7, 12)], "m string, b array<string>")
    got = [(r.x.shape, len(r.x.titles)) for r in df.select(files.outgoing(F.col("m"), F.col("b")).alias("x")).collect()]
    assert got == [("text", 0), ("button", 2), ("list", 7), ("list", 10)]
    assert not files.export(df.select("m"), str(tmp_path / "o"), "midwife") and files.export(df.select("m"), str(tmp_path / "o"), "analyst")
    assert spark.read.csv(str(tmp_path / "o"), header=True).count() == 4
    assert [r.m for r in files.since(spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "n int, m string"), "n", 1).collect()] == ["b", "c"]
    assert files.table_or_empty(spark, "nowhere", "a int").count() == 0
