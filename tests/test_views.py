"""The graph view on a small graph: lifted edges, edges that stand in, marks and roll-ups."""

from pyspark.sql import functions as F
from sondage.operators import views


def small(spark):
    modules = spark.createDataFrame([(1, "a", "api", "f1"), (2, "a", "service", "f2"), (3, "b", "data", "f3"), (4, "b", "api", "f3"), (5, "b", "data", "f3"), (6, "c", "data", "f9")], "module_id long, service string, layer string, file_path string")
    deps = spark.createDataFrame([(1, 2, 2), (2, 3, 5), (9, 1, 1)], "source long, target long, n long")
    methods = spark.createDataFrame([(10, 1), (20, 2), (21, 2), (30, 3)], "method_id long, module_id long")
    calls = spark.createDataFrame([(10, 20, 4), (20, 21, 1), (10, 99, 1)], "source long, target long, n long")
    http = spark.createDataFrame([("a", "b", 7), ("b", "c", 1)], "source string, target string, n long")
    return modules, deps, methods, calls, http


def test_edges(spark):
    modules, deps, methods, calls, http = small(spark)
    bad = spark.createDataFrame([(3, 2, "second"), (3, 2, "first")], "source long, target long, title string")
    got = {(r.level, r.source_kind, r.source, r.target): (r.n, r.kind, r.reason) for r in views.graph_edges(modules, deps, methods, calls, http, bad).collect()}
    assert got == {
        ("service", "service", "a", "b"): got[("service", "service", "a", "b")], ("service", "service", "b", "c"): (1, "http", None),
        ("module", "module", "1", "2"): (2, "module-dep", None), ("module", "module", "2", "3"): (5, "module-dep", "first"), ("module", "module", "2", "4"): (7, "http", None), ("module", "module", "3", "6"): (1, "http", None),
        ("method", "method", "10", "20"): (4, "method-dep", None), ("method", "method", "20", "21"): (1, "method-dep", None), ("method", "module", "2", "3"): (5, "module-dep", "first"), ("method", "module", "2", "4"): (7, "http", None), ("method", "module", "3", "6"): (1, "http", None),
    }
    services = [(r.source, r.target, r.n, r.kind) for r in views.graph_edges(modules, deps, methods, calls, http, bad).where("level = 'service'").collect()]
    assert sorted(services) == [("a", "b", 5, "module-dep"), ("a", "b", 7, "http"), ("b", "c", 1, "http")]
    assert views.graph_edges(modules, deps.limit(0), methods, calls.limit(0), http.limit(0), bad).count() == 0


def test_nodes(spark):
    modules, deps, methods, calls, _ = small(spark)
    found = spark.createDataFrame([(1, 10, 2), (1, None, 1), (3, 30, 4), (99, None, 0)], "module_id long, method_id long, rank int")
    nodes = lambda dbs: {(r.kind, r.id): (r.parent, r.dead, r.n, r.worst) for r in views.graph_nodes(modules, deps, methods, calls, spark.createDataFrame([(d,) for d in dbs], "service string"), found, F.col("rank")).collect()}
    got = nodes(["x"])
    assert got["service", "a"] == (None, False, 2, 1) and got["layer", "a__api"] == ("a", False, 2, 1) and got["module", "1"] == ("a__api", False, 2, 1)
    assert got["method", "10"] == ("1", False, 1, 2) and got["method", "30"] == ("3", True, 1, 4) and got["method", "21"] == ("2", False, 0, None)
    assert {k[1] for k, v in got.items() if k[0] == "module" and v[1]} == {"4", "5"}
    assert {k[1] for k, v in nodes(["b"]).items() if k[0] == "module" and v[1]} == {"4"}
