"""Names in random trees of scopes, against a walk up each scope's parents; and Python's own scopes."""

import random

import pytest
from sondage.operators import scopes as op
from sondage.sources import code

SCOPES = "path string, scope long, kind string, begin long, `end` long"
DECLARED = "path string, scope long, name string, kind string, at long, exported boolean, private boolean"
USED = "path string, scope long, name string, at long, role string, type_position boolean"


def trees(seed, files=6, size=60):
    """Random trees; a scope often begins or ends where its parent does, and siblings touch."""
    rng, scopes, parents, declared, used = random.Random(seed), [], {}, [], []
    for f in range(files):
        path, n = f"f{f}", 0

        def grow(begin, end, parent, depth, path=path):
            nonlocal n
            me, n = n, n + 1
            kind = "module" if parent is None else rng.choice(["function", "class", "block", "catch"])
            scopes.append((path, me, kind, begin, end))
            parents[path, me] = parent
            at = begin
            while depth < 7 and at < end and n < size:
                low = at if rng.random() < 0.6 else rng.randint(at, end)
                high = end if rng.random() < 0.2 else rng.randint(low, end)
                if high <= low or (low, high) == (begin, end):
                    break
                grow(low, high, me, depth + 1)
                at = high if rng.random() < 0.7 else high + 1

        grow(0, 1 << 16, None, 0)
        for scope in range(n):
            for name in rng.sample(["a", "b", "_c", "__d__", "e"], rng.choice([0, 1, 1, 2])):
                declared.append((path, scope, name, rng.choice(["const", "let", "var", "parameter"]), rng.randint(0, 50), rng.random() < 0.2, name == "_c"))
            for _ in range(rng.choice([0, 1, 2])):
                used.append((path, scope, rng.choice(["a", "b", "_c", "__d__", "e", "f", "print"]), rng.randint(0, 50), rng.choice(["read", "write", "call"]), rng.random() < 0.2))
    return scopes, parents, declared, sorted(set(used))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_a_walk_up_the_parents(spark, seed):
    scopes, parents, declared, used = trees(seed)
    kinds = {(p, s): k for p, s, k, _, _ in scopes}
    first = {}
    for d in declared:
        key = d[:3]
        first[key] = min(first.get(key, (99, "", False, False)), (d[4], d[3], d[5], d[6]))

    def up(path, scope):
        while scope is not None:
            yield scope
            scope = parents[path, scope]

    bound = {u: next((s for s in up(u[0], u[1]) if (u[0], s, u[2]) in first), None) for u in used}
    s, d, u = (spark.createDataFrame(rows, schema).repartition(3) for rows, schema in ((scopes, SCOPES), (declared, DECLARED), (used, USED)))
    got = {(r.path, r.scope, r.name, r.at, r.role, r.type_position): r.declared for r in op.resolve(s, d, u).collect()}
    assert got == bound and None in bound.values()
    shadow = {(p, n, i, next((o for o in list(up(p, i))[1:] if (p, o, n) in first), None)) for p, i, n in first}
    assert {tuple(r) for r in op.shadowed(s, d).select("path", "name", "inner", "outer").collect()} == {x for x in shadow if x[3] is not None}
    early = {}
    for use, where in bound.items():
        if where is not None and not use[5] and not any(kinds[use[0], x] == "function" for x in up(use[0], use[1]) if x in list(up(use[0], use[1]))[: list(up(use[0], use[1])).index(where)]):
            key = use[0], where, use[2]
            early[key] = min(early.get(key, 99), use[3])
    want = {(*k, first[k][0], at) for k, at in early.items() if first[k][1] != "var" and at < first[k][0]}
    assert {tuple(r) for r in op.used_before_defined(s, d, u).collect()} == want and want
    hit = {(x[0], w, x[2]) for x, w in bound.items() if w is not None}
    idle = {k for k, v in first.items() if k not in hit and not v[2] and not (v[1] == "parameter" and k[2].startswith("_")) and not k[2].startswith("__")}
    assert {(r.path, r.scope, r.name) for r in op.unused(s, d, u).collect()} == idle
    known = spark.createDataFrame([("print",)], "name string")
    assert {tuple(r) for r in op.undeclared(s, d, u, known).collect()} == {(x[0], x[2], x[3]) for x, w in bound.items() if w is None and x[2] != "print"}
    private = {k: {x[4] for x, w in bound.items() if (x[0], w, x[2]) == k} for k, v in first.items() if v[3] and kinds[k[:2]] == "class"}
    assert {(r.path, r.scope, r.name): {n for n, on in (("write", r.written), ("read", r.read), ("call", r.called)) if on} for r in op.private_members(s, d, u).collect()} == private
    assert op.resolve(s.limit(0), d.limit(0), u.limit(0)).count() == 0


def test_python_names(spark):
    text = "import os.path\ndef f(a, b):\n    x = a\n    print(y)\n    y = 1\n    def g(c):\n        x = c\n        return os\n    return [x for x in z], g\nclass K:\n    _p = 1\n    q = _p\n"
    nodes = code.parse_python(spark.createDataFrame([("m.py", text)], "path string, text string"))
    scopes, declared, used = op.python_scopes(nodes)
    assert sorted(r.kind for r in scopes.collect()) == ["class", "function", "function", "function", "module"]
    assert {r.name for r in op.unused(scopes, declared, used).collect()} == {"b", "x", "f", "K", "q"}
    assert {r.name for r in op.used_before_defined(scopes, declared, used).collect()} >= {"y"}
    assert {r.name for r in op.shadowed(scopes, declared).collect()} == {"x"}
    assert {r.name for r in op.undeclared(scopes, declared, used, spark.createDataFrame([("print",)], "name string")).collect()} == {"z"}
    assert [(r.name, r.read) for r in op.private_members(scopes, declared, used).collect()] == [("_p", True)]


def test_what_goes_through_the_sweep_is_no_more_than_it_needs(spark, monkeypatch):
    seen, real = [], op.nearest
    monkeypatch.setattr(op, "nearest", lambda intervals, points, *a, **k: seen.append((intervals, points)) or real(intervals, points, *a, **k))
    scopes, _, declared, used = trees(4)
    s, d, u = (spark.createDataFrame(rows, schema) for rows, schema in ((scopes, SCOPES), (declared, DECLARED), (used, USED)))
    op.private_members(s, d, u)
    assert {r.name for df in seen.pop() for r in df.select("name").distinct().collect()} == {"_c"}
    op.unused(s, d, u)
    assert set(seen.pop()[1].columns) == {"path", "scope", "name", "begin", "end"}
    op.used_before_defined(s, d, u)
    assert set(seen[0][1].columns) == {"path", "scope", "name", "at", "begin", "end"}


def test_scopes_dealt_as_numbers_are_those_of_the_sql(spark, sf):
    from sondage.plans import names
    from sondage.sources import projection

    mine, sql = (sorted(map(tuple, projection.view(spark, sf, text).collect())) for text in (names.DEALT_SQL, names.SCOPES_SQL))
    assert mine == sql and mine
