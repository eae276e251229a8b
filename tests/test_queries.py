"""Every core query against its DuckDB counterpart, on the smallest tables."""

import glob
import os

import duckdb
import pytest
from sondage import catalog


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return str(v).replace("+00:00", "").removesuffix(" 00:00:00")
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_counterpart(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    mine = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    places = [want.columns.index(c) for c in order]
    theirs = sorted(tuple(plain(r[k]) for k in places) for r in want.fetchall())
    assert mine == theirs


def test_every_query_without_sql_runs(spark, sf):
    for name in set(catalog.QUERIES) - set(catalog.ORACLES):
        assert catalog.QUERIES[name](spark, sf).count() >= 0


def test_nothing_imports_the_optional_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{root}/sondage/**/*.py", recursive=True):
        if "/llm/" not in path:
            with open(path) as f:
                assert "sondage.llm" not in f.read(), path


@pytest.mark.parametrize("left", ["", "pipeline"])
def test_the_entry_works_without_the_optional_subpackage(tmp_path, left):
    """Copied without the subpackage (and its pipeline), the entry registers the core queries; a broken one isn't hidden."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/sondage", tmp_path / "sondage", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    if left:
        (tmp_path / "corpus_pipeline.py").write_text("from sondage.llm import packing\n")
        (tmp_path / "sondage/llm/__pycache__").mkdir(parents=True)
    ask = [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run(ask, cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert list(map(int, out)) == [len(catalog.QUERIES), len(catalog.ORACLES)]
    (tmp_path / "sondage/llm").mkdir(exist_ok=True)
    (tmp_path / "sondage/llm/__init__.py").write_text("")
    (tmp_path / "sondage/llm/queries.py").write_text("import no_such_library\n")
    (tmp_path / "corpus_pipeline.py").write_text("")
    assert "no_such_library" in subprocess.run(ask, cwd=tmp_path, env=env, capture_output=True, text=True).stderr


def test_texts_over_the_tables_keep_their_braces(spark, sf):
    from sondage.sources import projection

    assert projection.view(spark, sf, "SELECT DISTINCT '/items/{id}' AS route FROM nation").collect()[0].route == "/items/{id}"
    assert {r.full_path for r in catalog.QUERIES["mounted_routes"](spark, sf).collect() if "items" in r.full_path and "nation_0/" in r.full_path} == {"/nation_0/items/{id}"}
