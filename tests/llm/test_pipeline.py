import random

import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__
import corpus_pipeline
from marlstone.llm.secret_scan import MASK


def test_stages_on_a_small_corpus(spark, tmp_path):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("bcdfgh") + rnd.choice("aeiou") for _ in range(3))
    plain = [" ".join(word() for _ in range(60)) for _ in range(60)]
    item = " ".join(word() for _ in range(25))
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(plain)]
    labels = [(i, 1, 0) for i in range(60)]
    for i in range(60, 100):  # toxic ones
        t = " ".join(word() for _ in range(30)) + " grumble grumbly grumblan " + word()
        docs.append((i, t, "en", "s", len(t)))
        labels.append((i, 0, 1))
    docs.append((200, plain[3], "en", "s", 0))  # an exact copy
    docs.append((201, plain[4] + " " + word(), "en", "s", 0))  # a near copy
    cut = item.split(" ")
    docs.append((202, " ".join([word() for _ in range(20)] + cut[12:] + [word()] + cut[:12]), "en", "s", 0))  # a passage with its parts swapped
    docs.append((203, "key token = abcdef0123456789 " + " ".join(word() for _ in range(20)), "en", "s", 0))
    docs.append((204, None, None, None, None))
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    pq.write_table(pa.table(dict(zip(names, map(list, zip(*docs, strict=True)), strict=True))), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [x[0] for x in labels], "quality": [x[1] for x in labels], "toxic": [x[2] for x in labels]}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": [0, 1], "text": [item, None]}), tmp_path / "benchmark.parquet")
    at = str(tmp_path)
    seen = spark.read.parquet(f"{at}/documents.parquet")
    columns, ids = seen.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = spark.createDataFrame(stage(spark, seen, at).collect(), seen.schema)
        assert seen.columns == columns
        ids.append({r.doc_id for r in seen.collect()})
    assert ids[0] & set(range(60, 100)) <= set() and set(range(60)) <= ids[0]
    assert ids[0] - ids[1] == {200, 201} and ids[1] - ids[2] == {202} and ids[3] == ids[2]
    assert next(r.text for r in seen.collect() if r.doc_id == 203).startswith(f"key {MASK} ")
    out = corpus_pipeline.run(spark, at).collect()
    assert {r.doc_id for r in out} == ids[3] and all(r.round_trip for r in out)


def test_registered_queries():
    names = set(__spark_entry__.queries())
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names
