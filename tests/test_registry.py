"""Every core query with oracle SQL agrees with it on the smallest tables."""

import glob
import os

import duckdb
import pytest

from wayspring import catalog

Q, O = catalog.queries(), catalog.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return f"{v:.5f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def test_every_oracle_has_a_query():
    assert set(O) <= set(Q)


@pytest.mark.parametrize("name", sorted(Q))
def test_query(name, spark, small, duck):
    df = Q[name](spark, small)
    got = df.collect()
    if name in O:
        r = duck.execute(O[name])
        cols = [d[0] for d in r.description]
        assert sorted(df.columns) == sorted(cols)
        assert rows(df.columns, got) == rows(cols, r.fetchall())


def test_entry_without_session_import():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-600:]


def test_python_workers_get_the_package_from_any_folder(small, tmp_path):
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e; from wayspring.runtime import build_session as b; print(e.queries()['chunk_counts'](b(cpus=2), {small!r}).count())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-600:]


def test_no_module_outside_the_subpackage_imports_it():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for p in glob.glob(f"{root}/wayspring/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in p:
            with open(p, encoding="utf-8") as f:
                assert "wayspring.llm" not in f.read(), p
