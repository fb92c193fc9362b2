import hashlib
import random
import re

from marlstone.llm import bitmaps
from marlstone.llm.secret_scan import LEDGER, MASK, RULES, ledger_of, op8_secret_scan, read_ledger, redact, secrets, version, with_ledger

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    found.sort()
    name = ",".join(f"{('assign', 'access', 'hex')[r]}:{a}:{b}" for a, r, b in found)
    return (*(sum(x[1] == r for x in found) for r in range(3)), hashlib.sha256(name.encode()).hexdigest(), set(name.split(",")) - {""})


def texts():
    rnd = random.Random(2)
    bits = ["token = ", "token=token=", "token=token ", "passWORD': \"", "API_KEY:", "secret", "x", "é😀", " ", "AKIA", "A1B2C3D4E5F6G7H8", "AKIAAKIA", "deadbeef" * 3, "0f" * 11, "\n", "abc123", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18, "'"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(300)] + [None, "", "token = " + "a" * 40000, "deadbeef" * 5000]


def test_base_spans(spark):
    rows = [(i, t, 7, "s") for i, t in enumerate(texts())] + [(None, "token = abcdef", 1, "s"), (3, "token = ghijkl", 1, "s"), (3, "token = ghijkl", 1, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, blob int, spans string")
    out = secrets(df).collect()
    assert len(out) == len(rows)
    got = sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in out)
    assert got == sorted((str(d), *base(t)[:4]) for d, t, *_ in rows)
    by = {r.doc_id: r.spans for r in out}
    for d, t, *_ in rows[:304]:
        assert d == 3 or base(t)[4] <= set(by[d].split(","))
    assert any("private_key" in s for s in by.values()) and any("forge_token" in s for s in by.values())
    assert secrets(df.limit(0)).count() == 0


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "ledger")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    one = secrets(frame([(1, "token = abcdef"), (2, "clean"), (3, "token = abcdef")]), path)
    assert sorted((r.doc_id, r.n_assign) for r in one.collect()) == [(1, 1), (2, 0), (3, 1)]
    assert spark.read.parquet(path).count() == 2
    two = secrets(frame([(4, "clean"), (5, "token = abcdef"), (6, "secret: uvwxyz")]), path)
    assert sorted((r.doc_id, r.n_assign) for r in two.collect()) == [(4, 0), (5, 1), (6, 1)]
    assert spark.read.parquet(path).count() == 3
    spark.read.parquet(path).selectExpr("blob", "0 AS rule_version", "spans").write.parquet(path + "0")
    secrets(frame([(1, "clean")]), path + "0").collect()
    assert spark.read.parquet(path + "0").count() == 4
    changed = (*RULES[:-1], RULES[-1]._replace(pattern="x+"))
    assert version(changed) != version(RULES) == version(tuple(RULES))
    with_ledger(frame([(1, "clean"), (2, "xx")]), path, rules=changed).collect()
    assert spark.read.parquet(path).groupBy("rule_version").count().count() == 2


def test_an_empty_ledger_takes_no_python_workers(spark, tmp_path):
    empty = read_ledger(spark, str(tmp_path / "ledger"))
    assert empty.schema == spark.createDataFrame([], LEDGER).schema and empty.count() == 0
    assert "RDD" not in empty._jdf.queryExecution().toString()


def test_findings_come_from_the_ledger(spark, tmp_path):
    """A blob that is in the ledger isn't scanned: what the ledger says of it is what comes out."""
    path = str(tmp_path / "ledger")
    df = spark.createDataFrame([(1, "token = abcdef"), (2, "token = ghijkl")], "doc_id long, text string")
    secrets(df, path).collect()
    spark.read.parquet(path).selectExpr("blob", "rule_version", "transform(spans, s -> named_struct('start', 1, 'rank', s.rank, 'end', 2)) AS spans").write.parquet(path + "1")
    more = df.unionByName(spark.createDataFrame([(3, "token = mnopqr")], "doc_id long, text string"))
    assert {r.doc_id: r.spans for r in secrets(more, path + "1").collect()} == {1: "assign:1:2", 2: "assign:1:2", 3: "assign:0:14"}


def test_the_query_keeps_its_ledger(spark, tmp_path):
    spark.createDataFrame([(1, "token = abcdef"), (2, "clean")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    first = sorted(op8_secret_scan(spark, str(tmp_path)).collect())
    path = ledger_of(spark, str(tmp_path))
    assert spark.read.parquet(path).count() == 2
    spark.createDataFrame([(3, "secret: uvwxyz"), (4, "clean")], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    assert sorted(op8_secret_scan(spark, str(tmp_path)).collect())[:2] == first and spark.read.parquet(path).count() == 3


def test_crowded_bitmap(spark, monkeypatch):
    """With two bits for all blobs nearly every row is a false alarm; the results are the same."""
    rows = [(i, t) for i, t in enumerate(texts()[:60] * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(secrets(df).collect())
    monkeypatch.setattr(bitmaps, "BITS", 2)
    assert sorted(secrets(df).collect()) == want


def test_redaction(spark):
    rows = [(1, "a token = abcdef z", "x", 18), (2, None, "x", 0), (3, "fine", "x", 4), (4, "token=" + "deadbeef" * 3 + " and AKIA" + "B" * 16, "y", 1)]
    out = {r.doc_id: r for r in redact(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")).collect()}
    assert [out[i].text for i in (1, 2, 3, 4)] == [f"a {MASK} z", None, "fine", f"{MASK} and {MASK}"]
    assert out[1].n_chars == len(out[1].text) and len(RULES) > 3
