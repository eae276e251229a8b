"""Laws and fixtures of the core operators."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F
from sondage.functions import scalars as S
from sondage.operators import claims, classify, contracts, findings, graph

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
KEYS = st.lists(st.integers(0, 6), max_size=12)


def keyed(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "k int")


@FEW
@given(KEYS, KEYS)
def test_diff_laws(spark, a, b):
    same = {r.change for r in findings.diff_keys(keyed(spark, a), keyed(spark, a), "k").collect()}
    assert same <= {"unchanged"}
    got = {r.k: r.change for r in findings.diff_keys(keyed(spark, a), keyed(spark, b), "k").collect()}
    assert {k for k, c in got.items() if c == "added"} == set(b) - set(a)
    assert {k for k, c in got.items() if c == "removed"} == set(a) - set(b)


def test_replay_equals_the_materialised_state(spark):
    log = [(1, 1, "added"), (2, 1, "added"), (1, 3, "resolved"), (3, 2, "added"), (3, 3, "resolved"), (3, 4, "added"), (2, 4, "resolved"), (2, 4, "added")]
    df = spark.createDataFrame(log, "id int, run int, op string")
    for run in range(1, 5):
        state = set()
        for i, r, op in sorted(log, key=lambda x: (x[1], x[2] == "added")):
            if r <= run:
                (state.add if op == "added" else state.discard)(i)
        assert {r.id for r in findings.replay(df, run).collect()} == state


def test_lifecycle_of_two_findings_that_become_one(spark):
    schema = "rule string, id int, first_seen int"
    before, now = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("b", 3, 1)], schema), spark.createDataFrame([("a", 9, 2), ("c", 10, 2)], schema)
    got = {(r.id, r.status, r.first_seen) for r in findings.lifecycle(now, before, ["rule"]).collect()}
    assert got == {(9, "unchanged", 1), (10, "new", 2), (3, "resolved", 1)}


@pytest.mark.parametrize(("edges", "want"), [
    ([(1, 2), (2, 1), (3, 4)], [{1, 2}, {3}, {4}]),
    ([(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 1), (6, 7), (7, 8), (8, 7)], [{1, 2, 3, 4, 5, 6}, {7, 8}]),
])
def test_strong_components(spark, edges, want):
    e = spark.createDataFrame(edges, "source int, target int")
    nodes = e.select(F.explode(F.array("source", "target")).alias("node"))
    groups = {}
    for r in graph.components(e, nodes, "node").collect():
        groups.setdefault(r.label, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))


def test_short_cycles_and_flows(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 1), (3, 4), (4, 4)], "source long, target long")
    assert {tuple(r.path) for r in graph.short_cycles(e, 3).collect()} == {(1, 2), (1, 2, 3)}
    steps = graph.traced_flows(e, spark.createDataFrame([(1,)], "node long")).orderBy("step").collect()
    assert [(r.step, r.node, r.depth) for r in steps] == [(0, 1, 0), (1, 2, 1), (2, 3, 2), (3, 4, 3)]


def test_globs_and_routes(spark):
    row = spark.range(1).select(
        S.glob_match(F.lit("a/b/c.py"), "**/*.py").alias("a"), S.glob_match(F.lit("a/b/c.py"), "a/*.py").alias("b"), S.glob_match(F.lit("c.py"), "**/*.py").alias("c"),
        S.route_match(F.lit("/u/7"), F.lit("/u/:id")).alias("d"), S.route_match(F.lit("/u/7/x"), F.lit("/u/:id")).alias("e"), S.route_match(F.lit("/u/7"), F.lit("/v/{id}")).alias("f"),
    ).first()
    assert tuple(row) == (True, False, True, True, False, False)


def test_scalars(spark):
    row = spark.range(1).select(S.entropy(F.lit("aabb")).alias("a"), S.entropy(F.lit("")).alias("b"), S.half_up(F.lit(-2.5)).alias("c"), S.entity_key(F.lit("db.Order_Items")).alias("d"), S.enum_key(F.lit("OrderStatus")).alias("e"), S.slug(F.lit("  A b!C ")).alias("f"), S.severity_rank(F.lit("odd")).alias("g")).first()
    assert tuple(row) == (1.0, 0.0, -2, "orderitem", "order", "a-b-c", 5)


def test_layers_and_minified(spark):
    row = spark.range(1).select(classify.layers(F.array(F.lit("zod")), F.lit("api/x.ts"), F.lit(0)).alias("a"), classify.layers(F.array(F.lit("zod")), F.lit("api/x.ts"), F.lit(1)).alias("b"), classify.looks_minified(F.lit("x" * 20_000)).alias("c"), classify.looks_minified(F.lit("x\n" * 10_000)).alias("d")).first()
    assert tuple(row) == (["service"], ["api"], True, False)


@pytest.mark.parametrize(("spec", "code", "match"), [
    (["a", "b", "c"], ["a", "b", "c", "d"], True), (["a", "b", "c"], ["a", "x", "y"], False), (["a", "b"], ["a", "b"], True), (["a", "b"], ["a", "b", "c"], False),
    (["a", "b", "c", "d", "e"], ["a", "b", "c"], True), (["a", "b", "c", "d", "e", "f"], ["a", "b", "c"], False),
])
def test_enum_matching_around_its_thresholds(spark, spec, code, match):
    s, c = spark.createDataFrame([("n", spec)], "name string, values array<string>"), spark.createDataFrame([("m", code)], "code_name string, code_values array<string>")
    assert (contracts.match_enums(s, c).count() == 1) == match


def test_claims_settle_by_each_pass(spark):
    schema = "id int, topic string, subject string, content string, status string, doc_kind string, touched date"
    day = "2024-01-0"
    rows = [(1, "t", "same", "x", "shipped", "spec", 1), (2, "t", "same", "x", "shipped", "prd", 2), (3, "t", "status", "x", "deferred", "spec", 1), (4, "t", "status", "x", "shipped", "readme", 1),
            (5, "t", "rank", "x", None, "adr", 1), (6, "t", "rank", "y", None, "readme", 9), (7, "t", "open", "x", None, "spec", 1), (8, "t", "open", "y", None, "prd", 2)]
    import datetime

    df = spark.createDataFrame([(*r[:6], datetime.date.fromisoformat(f"{day}{r[6]}")) for r in rows], schema)
    assert {r.subject: (r.how, r.chosen) for r in claims.settle(df).collect()} == {"same": ("identical", 2), "status": ("status", 4), "rank": ("dominance", 5), "open": ("conflict", 8)}


def test_innermost_against_every_range_however_long(spark):
    import random

    rng = random.Random(3)
    ranges = [(k, rng.randrange(2), a := rng.randrange(-40, 300), a + rng.choice([-1, 0, 1, 7, 50, 200, 1000])) for k in range(300)] + [(900, 0, None, 5), (901, 0, 5, None), (902, 0, 5, 10**13)]
    points = [(k, rng.randrange(3), rng.randrange(-60, 500)) for k in range(400)] + [(1000, 0, None), (1001, 0, 10**12 + 77)]
    p, r = spark.createDataFrame(points, "point_id long, file int, line long"), spark.createDataFrame(ranges, "method_id long, file int, line_start long, line_end long")
    held = {k: [(b - a, m) for m, f, a, b in ranges if None not in (a, b, line) and f == file and a <= line <= b] for k, file, line in points}
    assert {tuple(x) for x in graph.innermost(p, r).collect()} == {(k, min(v)[1]) for k, v in held.items() if v}
    assert {tuple(x) for x in graph.innermost(p, r, first=True).collect()} == {(k, min(m for _, m in v)) for k, v in held.items() if v}
    # 3,000 ranges around each of 3,000 lines
    many = graph.innermost(spark.range(3000).selectExpr("id AS point_id", "0 AS file", "10000 + id AS line"), spark.range(3000).selectExpr("id AS method_id", "0 AS file", "id AS line_start", "20000 + 2 * id AS line_end"))
    assert many.agg({"point_id": "count", "method_id": "sum"}).first()[:] == (3000, 0)


@pytest.mark.parametrize("first", [False, True])
def test_innermost_makes_a_row_per_power_of_two_not_one_per_range(spark, first):
    """400 ranges hold each of 400 lines: no step may make 160,000 rows of them."""

    def steps(plan):
        kids = plan.children()
        yield plan
        for k in range(kids.size()):
            yield from steps(kids.apply(k))

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = graph.innermost(spark.range(400).selectExpr("id AS point_id", "0 AS file", "1000 + id AS line"), spark.range(400).selectExpr("id AS method_id", "0 AS file", "id AS line_start", "3000 + 2 * id AS line_end"), first=first)
        assert {tuple(x) for x in got.collect()} == {(k, 0) for k in range(400)}
        rows = [s.metrics().apply("numOutputRows").value() for s in steps(got._jdf.queryExecution().executedPlan()) if s.metrics().contains("numOutputRows")]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(rows) > 5
    assert 400 <= max(rows) < 400 * 64


def test_mounted_routes_at_any_depth(spark):
    mounts = [(k, k + 1, f"/m{k}") for k in range(12)] + [(0, 12, "/short"), (12, 11, "/back"), (31, 32, "/a"), (32, 31, "/b")]
    routes = [(12, "/deep"), (40, "/alone"), (31, "/loop"), (0, "/root")]
    got = graph.mounted_routes(spark.createDataFrame(mounts, "parent int, child int, path string"), spark.createDataFrame(routes, "router int, route string"))
    deep = "".join(f"/m{k}" for k in range(12)) + "/deep"
    assert sorted(map(tuple, got.collect())) == [(0, "/root"), (12, deep), (12, "/short/deep"), (31, "/loop"), (40, "/alone")]


def test_traced_flows_against_a_plain_walk(spark):
    import random

    rng = random.Random(5)
    edges = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(60)})
    calls, entries = spark.createDataFrame(edges, "source long, target long"), [0, 3, 17, 29]
    want = set()
    for e in entries:
        seen, order = {}, []

        def walk(node, depth, seen=seen, order=order):
            if node in seen:
                return
            seen[node] = depth
            order.append((node, depth))
            for a, b in edges:
                if a == node:
                    walk(b, depth + 1)

        walk(e, 0)
        want |= {(e, k, node, depth) for k, (node, depth) in enumerate(order)}
    got = graph.traced_flows(calls, spark.createDataFrame([(e,) for e in entries], "node long"), depth=40)
    assert {tuple(r) for r in got.collect()} == want
