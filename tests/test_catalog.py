"""Every query of the engine against its SQL, on the smallest of the driver's tables."""

import os

import pytest

from ranksmith.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    r = duck.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(x[names.index(c)] for c in cols) for x in r.fetchall()), key=repr)


def test_scalars_of_large_numbers(spark, tmp_path):
    """Numbers of which products leave 32 bits, as in the driver's larger tables."""
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        key = {"orders": "o_orderkey", "lineitem": "l_orderkey"}.get(t)
        c.execute(f"COPY (SELECT * {f'REPLACE ({key} + 8_999_000 AS {key})' if key else ''} FROM '{DATA}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = catalog.queries()["f_scalars"](spark, str(tmp_path))
    assert dict(df.dtypes)["number"] == "int"
    r = c.execute(SQL["f_scalars"])
    names = [d[0] for d in r.description]
    got = sorted((tuple(x[n] for n in names) for x in df.collect()), key=repr)
    assert got == sorted(r.fetchall(), key=repr) and len(got) >= 1000


def test_entry_imports_without_the_optional_parts():
    import subprocess
    import sys
    import tempfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as d:
        import shutil

        shutil.copy(f"{root}/__spark_entry__.py", d)
        shutil.copytree(f"{root}/ranksmith", f"{d}/ranksmith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=d, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": d})
        assert out.returncode == 0 and int(out.stdout.split()[-1]) >= 90, out.stderr
