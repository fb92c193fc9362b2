import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from marlstone import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    df = catalogue.queries()[name](spark, str(DATA))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = sql.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, cursor.fetchall())


def test_imports_without_the_training_data_part(tmp_path):
    """The entry works in a copy that lacks the subpackage and the pipeline."""
    root = Path(__file__).resolve().parent.parent
    for p in [root / "__spark_entry__.py", *(root / "marlstone").rglob("*.py")]:
        own = p.relative_to(root)
        if "llm" not in own.parts:
            (tmp_path / own).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / own).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hist_suppressed' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120)
