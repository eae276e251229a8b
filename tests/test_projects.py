"""Project files on fixtures, and the states and chains that no query covers."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F
from sondage.operators import graph, states, verify
from sondage.sources import projects


def test_compose_databases(spark):
    text = "version: '3'\nservices:\n  db:\n    # the store\n    image: \"docker.io/library/postgres:16\"\n  cache:\n    image: redis\n  web:\n    image: me/app:1\nvolumes:\n  postgres:\n    image: mysql\n"
    files = spark.createDataFrame([("a/docker-compose.yml", text), ("a/other.yml", text), ("b/compose.yaml", "services:\n")], "path string, text string")
    assert sorted(map(tuple, projects.compose_databases(files).collect())) == [("a/docker-compose.yml", "cache", "redis"), ("a/docker-compose.yml", "db", "postgres")]


def test_check_pyproject(spark):
    rows = [("a/pyproject.toml", '[project]\nname = "x"\nversion = "1"\n'), ("b/pyproject.toml", "[project\n"), ("c/pyproject.toml", '[project]\ndependencies = "x"\n'), ("d/pyproject.toml", "[tool.x]\n"), ("e/x.toml", "["), ("f/pyproject.toml", None)]
    got = {}
    for r in projects.check_pyproject(spark.createDataFrame(rows, "path string, text string")).collect():
        got.setdefault(r.path, []).append(r.problem)
    assert set(got) == {"b/pyproject.toml", "c/pyproject.toml"} and got["c/pyproject.toml"] == ["name is missing", "version is neither given nor dynamic", "dependencies is not a list"]


def test_working_tree_and_lock(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    git("init", "-q")
    for name in ("a.py", "b.py"):
        (tmp_path / name).write_text("x = 1\n")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("x = 2\n")
    (tmp_path / "b.py").unlink()
    (tmp_path / "new one.py").write_text("")
    assert [tuple(r) for r in projects.working_tree(spark, str(tmp_path)).collect()] == [("a.py", "M"), ("b.py", "D"), ("new one.py", "??")]
    assert [tuple(r) for r in projects.working_tree(spark, str(tmp_path), "HEAD").collect()] == [("a.py", "M"), ("b.py", "D")]
    with projects.single_writer(str(tmp_path)):
        with pytest.raises(RuntimeError), projects.single_writer(str(tmp_path)):
            pass
    (tmp_path / ".analysis.lock").write_text("999999999")
    with projects.single_writer(str(tmp_path)):
        assert os.path.exists(tmp_path / ".analysis.lock")


def test_contract_files_are_written_and_pruned(spark, tmp_path):
    rows = spark.createDataFrame([("orders/a.txt", "enum é"), ("b.txt", "two")], "path string, text string")
    assert projects.write_contracts(rows, str(tmp_path / "c")) == (2, 0)
    assert projects.write_contracts(rows.where("path = 'b.txt'"), str(tmp_path / "c")) == (1, 1)
    assert [p.name for p in (tmp_path / "c").rglob("*.txt")] == ["b.txt"] and (tmp_path / "c/b.txt").read_text() == "two"


def test_active_set_in_its_three_cases(spark):
    latest, added, gone = (spark.createDataFrame([(k,) for k in ks], "id int") for ks in ((1, 2, 3), (9,), (2,)))
    log = spark.createDataFrame([(1, 1, "added"), (2, 1, "added"), (1, 2, "resolved")], "id int, run int, op string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(states.active_set(latest)) == [1, 2, 3] and ids(states.active_set(latest, added, gone)) == [1, 3, 9]
    assert ids(states.active_set(latest, log=log, run=1)) == [1, 2] and ids(states.active_set(latest, log=log, run=2)) == [2]


def test_function_filter_and_constraints(spark):
    f = spark.createDataFrame([("saveAll", True, False, ["a"]), ("load", False, True, [])], "name string, is_async boolean, is_handler boolean, params array<string>")
    assert [r.name for r in f.where(states.function_filter(is_async=True, least_params=1, names=("save",))).collect()] == ["saveAll"]
    assert [r.name for r in f.where(states.function_filter(is_handler=True)).collect()] == ["load"]
    got = spark.range(1).select(verify.numeric_constraints(F.lit("qty >= 3 and 10 > total or x != -2")).alias("c")).first().c
    assert [(x.op, x.literal) for x in got] == [(">=", 3), ("!=", -2), ("<", 10)]


def test_first_decisions_are_all_added(spark):
    head = spark.createDataFrame([("Enum", "a", "x")], "kind string, identity string, body string")
    assert [tuple(r) for r in verify.diff_decisions(head, None).collect()] == [("Enum", "a", "added")]


def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "_first_reaching", lambda *a, f=graph._first_reaching: rounds.append(1) or f(*a))
    e = spark.range(149).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target")).union(spark.createDataFrame([(149, 140)], "source long, target long"))
    got = {r.node: r.label for r in graph.components(e, spark.range(151).select(F.col("id").alias("node")), "node").collect()}
    assert got == {k: k if k < 140 or k == 150 else 140 for k in range(151)} and len(rounds) <= 2 * 14


def test_shortest_cycles_of_large_components(spark):
    ring = [(k, (k + 1) % 8) for k in range(8)] + [(5, 2), (20, 21), (21, 20)]
    e = spark.createDataFrame(ring, "source long, target long")
    labels = graph.components(e, e.select(F.explode(F.array("source", "target")).alias("node")), "node")
    assert [(r.label, list(r.path), r.n) for r in graph.shortest_cycles(e, labels).collect()] == [(0, [2, 3, 4, 5], 4)]
    assert [list(r.path) for r in graph.component_cycles(e, labels).collect()] == [[20, 21]]
