from collections import defaultdict

from helpers import AWKWARD, documents
from sondage.llm.exact_dedup import IGNORED, exact_dedup, exact_groups


def plain(t):
    return "".join(c for c in t or "" if c not in IGNORED)


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append((-len(t or ""), i is None, i or 0, i))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


def test_groups_match_brute_force(spark):
    rows = AWKWARD + [(100 + k, f"text {k % 7}" + " " * (k % 3)) for k in range(60)]
    got = exact_groups(documents(spark, rows), run_rows=5, fanout=2).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    by_text = {(i, t): want[plain(t)] for i, t in rows}
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == sorted((str(i), str(by_text[i, t][0]), by_text[i, t][1]) for i, t in rows)
    assert sum(r.kept for r in got) == len(want)


def test_dedup_keeps_one_of_each_with_all_columns(spark):
    docs = documents(spark, AWKWARD)
    got = exact_dedup(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == len({plain(t) for _, t in AWKWARD})
    assert {plain(r.text) for r in rows} == {plain(t) for _, t in AWKWARD}


def test_hot_group_and_empty_table(spark):
    rows = [(k, "same text") for k in range(300)] + [(1000 + k, f"t{k}") for k in range(30)]
    got = exact_groups(documents(spark, rows)).where("kept").collect()
    assert len(got) == 31 and {r.doc_id for r in got if r.group_size == 300} == {0}
    empty = documents(spark, rows).limit(0)
    assert exact_groups(empty).count() == 0 and exact_dedup(empty).count() == 0


def test_rounds_deal_ranges_evenly(spark, monkeypatch):
    """After the last round each partition holds its share of the digests, and a hot digest was met once per run."""
    from sondage.llm import exact_dedup as X

    seen = []
    monkeypatch.setattr(X, "_merged", lambda rows, part, parts, checks, f=X._merged: seen.append((f(rows, part, parts, checks), part)) or seen[-1][0])
    docs = documents(spark, [(k, f"text {k}" if k % 3 else "hot") for k in range(6000)]).repartition(40)
    exact_groups(docs, fanout=4).count()
    assert len(seen) == 4
    last, part = seen[-1]
    sizes = [r["count"] for r in last.groupBy(part).count().collect()]
    assert sum(sizes) == 4001 and max(sizes) < 2 * 4001 / 40 and len(sizes) >= 40
    assert seen[0][0].where("n > 1").count() == 40


def test_no_python_in_the_plan(spark):
    plan = exact_groups(documents(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("MapInArrow", "MapInPandas", "PythonUDF", "ArrowEval"))
