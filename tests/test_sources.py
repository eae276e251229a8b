"""Files to facts to findings, the run store and the change stream, on hand-written fixtures."""

import datetime

from pyspark.sql import functions as F
from sondage.operators import rules
from sondage.sources import code
from sondage.sources.store import RunStore
from sondage.streaming import changes

GOOD = "import os\nfrom .util import helper\n\n\ndef ok(a, b):\n    return helper(a) is None\n"
BAD = """from os import *
import subprocess, yaml


def f(a, b, c, d, e, g, h=[]):
    try:
        eval(a)
        subprocess.run(b, shell=True)
        yaml.load(c)
        yaml.load(c, Loader=yaml.SafeLoader)
    except:
        pass
    return a == None
"""


def project(spark, tmp_path):
    for name, text in {"app/main.py": GOOD, "app/util.py": "def helper(x):\n    return x\n", "app/bad.py": BAD, "app/broken.py": "def (:\n", "node_modules/x/skip.py": BAD, "app/api.g.cs": "class A {}"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    files = code.read_files(spark, str(tmp_path))
    return files.withColumn("path", F.regexp_replace("path", f"^.*{tmp_path.name}/", ""))


def test_files_nodes_imports_and_rules(spark, tmp_path):
    files = code.code_files(project(spark, tmp_path))
    assert {r.path for r in files.collect()} == {"app/main.py", "app/util.py", "app/bad.py", "app/broken.py"}
    nodes = code.parse_python(files).cache()
    assert {r.name: (r.params, r.nesting) for r in code.functions_of(nodes).collect()} == {"ok": (2, 0), "helper": (1, 0), "f": (7, 1)}
    assert [(r.source, r.target, r.imported_names) for r in code.import_edges(nodes, files).collect()] == [("app/main.py", "app/util.py", ["helper"])]
    found = {(r.rule_key, r.path, r.line_start) for r in rules.run_rules(nodes).collect()}
    assert found == {
        ("code-quality/star-import", "app/bad.py", 1), ("bugs/mutable-default", "app/bad.py", 5), ("architecture/too-many-parameters", "app/bad.py", 5), ("security/eval-call", "app/bad.py", 7),
        ("security/shell-call", "app/bad.py", 8), ("security/unsafe-yaml", "app/bad.py", 9), ("bugs/bare-except", "app/bad.py", 11), ("bugs/swallowed-exception", "app/bad.py", 11), ("bugs/compare-to-none", "app/bad.py", 13), ("bugs/unparsable-file", "app/broken.py", 1),
    }
    assert rules.run_rules(nodes, disabled=("security/eval-call",)).count() == len(found) - 1
    outer = rules.inside(nodes, "Call", ("FunctionDef",)).join(nodes.select("path", F.col("node").alias("outer"), "name"), ["path", "outer"])
    assert {r.name for r in outer.collect()} == {"ok", "f"}
    assert {r.callee for r in code.calls_of(nodes).collect()} == {"helper", "eval", "subprocess.run", "yaml.load"}


def test_sql_predicates(spark):
    sql = "SELECT * FROM orders o WHERE o.status IN ('a', 'b,c') AND created BETWEEN 1 AND 2 AND x IS NOT NULL AND (a = 1 OR b = 2) AND n >= :p AND t.a = t.b ORDER BY 1"
    got = code.sql_predicates(spark.createDataFrame([("q", sql), ("none", "SELECT 1"), ("null", None)], "query_id string, sql string")).collect()
    assert [(r.kind, r.table, r.column, r.values) for r in got] == [
        ("in", "o", "status", ["s:a", "s:b,c"]), ("between", "orders", "created", ["n:1", "n:2"]), ("is-not-null", "orders", "x", []), ("raw", None, None, []),
        ("gte", "orders", "n", ["p::p"]), ("column-compare", "t", "a", ["i:t.b"]),
    ]


def test_schemas_manifests_and_markdown(spark):
    files = spark.createDataFrame([
        ("a/schema.prisma", "model User {\n  id Int @id\n  posts Post[]\n  nick String?\n}\n"), ("a/package.json", '{"dependencies": {"x": "1"}, "devDependencies": {"y": "2"}}'),
        ("a/requirements.txt", "Flask==2\n# note\nrequests>=1\n"), ("a/doc.md", "intro\n# One\ntext\n## Two\nmore"),
    ], "path string, text string")
    assert {(r.table, r.column, r.type, r.optional, r.many) for r in code.prisma_columns(files).collect()} == {("User", "id", "Int", False, False), ("User", "posts", "Post", False, True), ("User", "nick", "String", True, False)}
    assert {r.dependency for r in code.manifest_dependencies(files).collect()} == {"x", "y", "flask", "requests"}
    assert [(r.block, r.level, r.heading) for r in code.markdown_blocks(files.where("path like '%.md'")).orderBy("block").collect()] == [(0, 0, None), (1, 1, "One"), (2, 2, "Two")]


def test_context_batches(spark):
    files = spark.createDataFrame([(f"f{k}", "x" * (k * 10 % 70 + 1)) for k in range(100)], "path string, text string")
    sizes = rules.context_batches(files, most_chars=100, lanes=3).groupBy("lane", "batch").agg(F.sum("n").alias("n")).collect()
    assert sum(r.n for r in sizes) == sum(k * 10 % 70 + 1 for k in range(100)) and max(r.n for r in sizes) <= 200


def test_run_store(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    rows = lambda *s: spark.createDataFrame([(k, x, "high") for k, x in enumerate(s)], "id int, status string, severity string")
    store.append_run("r1", rows("new", "new"))
    store.append_run("r2", rows("unchanged", "resolved", "new"))
    store.append_run("r2", rows("unchanged", "resolved"))
    store.write_latest(rows("unchanged"))
    assert store.names() == ["r1", "r2"] and store.run("r1").count() == 2 and store.latest().count() == 1
    assert {(r.run, r.new, r.unchanged, r.resolved, r.high) for r in store.history().collect()} == {("r1", 2, 0, 0, 2), ("r2", 0, 1, 1, 2)}


def test_change_stream(spark, tmp_path):
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, 0) + datetime.timedelta(seconds=s)
    spark.createDataFrame([("r", "a", t(0)), ("r", "b", t(0.2)), ("r", "a", t(0.3)), ("r", "c", t(5)), ("s", "a", t(600))], "root string, path string, ts timestamp").write.parquet(str(tmp_path / "in"))
    query = changes.debounced(changes.change_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("batches").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.root, r.n, r.n_paths) for r in spark.table("batches").collect()) == [("r", 1, 1), ("r", 3, 2)]
    done = changes.rescan(changes.change_stream(spark, str(tmp_path / "in")), lambda paths: paths, str(tmp_path / "out"), str(tmp_path / "cp"))
    done.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
