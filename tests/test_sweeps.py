"""Ignore rules by hand-made cases, and the replayed trend against a replay per run."""

import random

from sondage.operators import ignoring, trends


def judge(spark, rules, paths):
    files = spark.createDataFrame([(p, 1) for p in paths], "path string, size int")
    rows = spark.createDataFrame(rules, "dir string, rank int, pattern string")
    return {r.path: (r.ignored, r.reincluded) for r in ignoring.judged(files, rows).collect()}


def test_ignore_rules(spark):
    lines = lambda text, at="": [(at, k, line) for k, line in enumerate(text.split("\n"))]
    assert judge(spark, lines("reference/\n**/*.gen.ts"), ["reference/specs/a.md", "src/api.gen.ts", "src/api.ts", "api.gen.ts", "other/reference"]) == {
        "reference/specs/a.md": (True, False), "src/api.gen.ts": (True, False), "src/api.ts": (False, False), "api.gen.ts": (True, False), "other/reference": (False, False),
    }
    assert judge(spark, lines("*"), ["../sibling.md", "a/b", None]) == {"../sibling.md": (False, False), "a/b": (True, False), None: (False, False)}
    assert judge(spark, lines("*.md\n!docs/build/**"), ["docs/build/x.md", "docs/build/assets/y.md", "docs/other.md", "src/app.ts"]) == {
        "docs/build/x.md": (False, True), "docs/build/assets/y.md": (False, True), "docs/other.md": (True, False), "src/app.ts": (False, False),
    }
    # nothing comes back from a directory that is ignored; the deepest file and its last line decide
    nested = [*lines("build/\n!build/keep.txt\n/top.log\na/**/z\n\\!odd\nq?.ts\n[ab].c"), *lines("!*.log\nsub/x", "logs"), *lines("*.log", "logs/old")]
    got = judge(spark, nested, ["build/keep.txt", "top.log", "in/top.log", "a/z", "a/b/c/z", "!odd", "q1.ts", "q12.ts", "a.c", "d.c", "logs/top.log", "logs/old/top.log", "logs/sub/x/y", "sub/x"])
    assert {p for p, (i, _) in got.items() if i} == {"build/keep.txt", "top.log", "a/z", "a/b/c/z", "!odd", "q1.ts", "a.c", "logs/old/top.log", "logs/sub/x/y"}
    assert got["logs/top.log"] == (False, True)
    assert judge(spark, [("", 0, "")], ["a/b"]) == {"a/b": (False, False)}


def test_trend_against_a_replay_per_run(spark):
    rng = random.Random(3)
    log = [(f"i{rng.randint(0, 30)}", rng.randint(0, 60), rng.choice(["added", "added", "resolved"]), rng.choice(trends.SEVERITIES), f"r{rng.randint(0, 4)}") for _ in range(500)]
    log = [(i, r, o, s, f"r{int(i[1:]) % 5}") for i, r, o, s, _ in log]
    runs = sorted(rng.sample(range(0, 70), 40))
    want = {}
    live = [x for x in log if x[4] != "r2"]
    for run in runs:
        last = {}
        for i, r, o, s, _ in sorted((x for x in live if x[1] <= run), key=lambda x: (x[1], x[2] == "added", x[3])):
            last[i] = o == "added" and s
        active = [s for s in last.values() if s]
        new, gone = ({i for i, r, o, _, _ in live if r == run and o == op} for op in ("added", "resolved"))
        want[run] = (*(active.count(s) for s in trends.SEVERITIES), len(active), len(new), max(0, len(active) - len(new)), len(gone))
    rows = spark.createDataFrame(log, "id string, run int, op string, severity string, rule_key string").repartition(3)
    out = trends.replayed(rows, spark.createDataFrame([(r,) for r in runs], "run int"), spark.createDataFrame([("r2",)], "rule_key string"))
    assert {r.run: tuple(r)[1:] for r in out.collect()} == want


def test_running_sums_over_ranges(spark):
    rows = spark.range(1000).selectExpr("id AS k", "id % 7 - 3 AS a", "1L AS b").repartition(5)
    got = {r.k: (r.a, r.b) for r in trends.running_sums(rows, "k", ["a", "b"], 6).collect()}
    total, want = 0, {}
    for k in range(1000):
        total += k % 7 - 3
        want[k] = total, k + 1
    assert got == want
