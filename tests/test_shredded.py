"""The merge of claims on shredded contents, against a plain walk over each group."""

import json
import random

from pyspark.sql import functions as F
from sondage.operators import shredded

SCHEMA = "id long, topic string, subject string, file string, kind string, content string, status string, doc_kind string, touched int"
RANK = {"adr": 4, "rfc": 4, "prd": 3, "spec": 3, "design-note": 2, "runbook": 2, "readme": 1}
NONE = object()


def text(v):
    return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


class Apart(Exception):
    pass


def join(a, b, mode):
    """Two contents in one; ``mode``: subset (keys in order), deep (any keys), last (the later wins)."""
    if isinstance(a, dict) and isinstance(b, dict):
        if mode == "subset" and not (a.keys() <= b.keys() or b.keys() <= a.keys()):
            raise Apart
        return {k: join(a[k], b[k], mode) if k in a and k in b else a.get(k, b.get(k)) for k in a | b}
    if mode != "last" and text(a) != text(b):
        raise Apart
    return b


def attempt(contents, mode):
    try:
        out = contents[0]
        for c in contents[1:]:
            out = join(out, c, mode)
        return out
    except Apart:
        return NONE


def rich(v):
    return sum(map(rich, v.values())) if isinstance(v, dict) else sum(map(rich, v)) if isinstance(v, list) else int(v is not None)


def plain(group):
    def read(t):
        try:
            return json.loads(t) if t is not None and t.strip() else None
        except ValueError:
            return t.strip(" ")

    rows = [dict(zip(("id", "topic", "subject", "file", "kind", "content", "status", "doc_kind", "touched"), r, strict=True)) for r in group]
    for r in rows:
        r["v"], r["kind"], r["rank"] = read(r["content"]), r["kind"] or "definition", RANK.get(r["doc_kind"], 0)
    rows = [r for r in rows if r["v"] not in (None, {}, [])] or rows
    rows = [r for r in rows if r["status"] in (None, "shipped")] or rows
    rows.sort(key=lambda r: (r["touched"], r["id"]))
    head, contents, topic = rows[0], [r["v"] for r in rows], rows[0]["topic"] or ""
    texts, states = {text(v) for v in contents}, {r["status"] or "" for r in rows}
    default = lambda rs: max(rs, key=lambda r: (r["rank"], r["touched"], rich(r["v"]), -r["id"]))["id"]
    if len(rows) == 1:
        return "single", head["id"], head["v"]
    if len({(text(r["v"]), r["status"] or "") for r in rows}) == 1:
        return "identical", head["id"], head["v"]
    if len(texts) == 1:
        best = max(rows, key=lambda r: ({"shipped": 4, "deferred": 2, "out-of-scope": 1, "deprecated": 0}.get(r["status"], 3), -rows.index(r)))
        return "status", best["id"], best["v"]
    if len({r["file"] for r in rows}) == 1:
        if topic == "overview":
            best = max(rows, key=lambda r: (rich(r["v"]), -rows.index(r)))
            return "same-file", best["id"], best["v"]
        if (got := attempt(contents, "last" if topic == "data" else "subset")) is not NONE:
            return "same-file", head["id"], got
    by = sorted(rows, key=lambda r: -r["rank"])
    if by[0]["rank"] - by[1]["rank"] >= 3 and all(attempt([by[0]["v"], r["v"]], "subset") is not NONE for r in by[1:]):
        return "dominance", by[0]["id"], by[0]["v"]
    if len(states) == 1 and (got := attempt(contents, "subset")) is not NONE:
        return "superset", head["id"], got
    definitions, narrow = [r for r in rows if r["kind"] == "definition"], [r["v"] for r in rows if r["kind"] == "constraint"]
    if definitions and narrow:
        folds = [attempt([r["v"], *narrow], "deep") for r in definitions]
        if NONE not in [f if f is NONE else None for f in folds]:
            if len({(text(f), r["status"] or "") for f, r in zip(folds, definitions, strict=True)}) == 1:
                return "constrained", definitions[0]["id"], folds[0]
            for r, f in zip(definitions, folds, strict=True):
                r["v"] = f
            return "conflict", default(definitions), None
    return "conflict", default(rows), None


def contents(rng, depth=0):
    if depth < 3 and rng.random() < (0.85, 0.5, 0.3)[depth]:
        return {k: contents(rng, depth + 1) for k in rng.sample(["a", "b", 'q"\\', "é"], rng.randint(0, 3))}
    return rng.choice([1, 1, 2, "x", 'say "hi" \\ \n', True, None, [1, {"z": 1, "a": 2}], [], "Ä"])


def check(spark, rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[1] or "", r[2] or ""), []).append(r)
    want = sorted((*g, *(x if k < 2 else text(x) if x is not None else None for k, x in enumerate(plain(rs)))) for g, rs in groups.items())
    got = shredded.merge_claims(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    null = lambda r: "null" if r.content is None and r.how != "conflict" else r.content
    mine = sorted((r.topic, r.subject, r.how, r.chosen, null(r)) for r in got)
    want = [(*w[:4], "null" if w[4] is None and w[2] != "conflict" else w[4]) for w in want]
    assert mine == want
    assert all((r.conflict_id is None) == (r.how != "conflict") for r in got)
    return {r.how for r in got}


def test_random_groups_against_a_plain_walk(spark):
    rng, rows, n = random.Random(11), [], 0
    for g in range(500):
        base, files, kinds = contents(rng), rng.choice([1, 1, 3]), rng.choice([(None,), (None, "definition", "constraint")])
        for _ in range(rng.choice([1, 2, 2, 3, 4])):
            n += 1
            c = base
            if rng.random() < 0.6 and isinstance(base, dict):
                c = {k: v for k, v in base.items() if rng.random() < 0.7} | ({rng.choice("abc"): contents(rng, 2)} if rng.random() < 0.25 else {})
            elif rng.random() < 0.2:
                c = contents(rng)
            content = json.dumps(c) if rng.random() < 0.95 else rng.choice([None, "  ", "not json {", "{}"])
            doc = rng.choice(["adr", "readme", "unknown", None]) if g % 3 else rng.choice(["adr", *["readme"] * 3])
            rows.append((n, rng.choice([None, "data", "overview", "auth", "errors"]) if False else ["data", "overview", "auth", "errors", None][g % 5], f"s{g}", f"f{rng.randint(1, files)}", rng.choice(kinds), content, rng.choice([None, None, None, "shipped", "deferred"]), doc, rng.randint(1, 3)))
    assert check(spark, rows) == {"single", "identical", "status", "same-file", "dominance", "superset", "constrained", "conflict"}


def test_a_hot_subject_and_later_objects_over_values(spark):
    rows = [(k, "data", "s", "f", None, json.dumps({"a": {"b": k, f"k{k % 40}": 1}}), None, None, k) for k in range(3000)]
    rows += [(10_001, "data", "t", "f", None, '{"a":{"x":1,"y":2}}', None, None, 1), (10_002, "data", "t", "f", None, '{"a":5}', None, None, 2), (10_003, "data", "t", "f", None, '{"a":{"z":{"w":1}}}', None, None, 3)]
    rows += [(10_004, "data", "u", "f", None, '{"a":{"x":1}}', None, None, 1), (10_005, "data", "u", "f", None, '{"a":[1]}', None, None, 2)]
    check(spark, rows)


def test_empty_sources_and_decisions(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert shredded.merge_claims(none).collect() == []
    rows = spark.createDataFrame([(1, "auth", "s", "f", None, '{"a":1}', None, None, 1), (2, "auth", "s", "g", None, '{"a":2}', None, None, 2), (3, "auth", "s", "g", None, "{}", None, None, 2)], SCHEMA)
    merged = shredded.merge_claims(rows)
    assert sorted(r.id for r in shredded.merge_sources(rows, merged).collect()) == [1, 2]
    taken = merged.select("conflict_id", F.lit(1).cast("long").alias("picked"), F.lit(7).alias("resolved_at"))
    assert [(r.how, r.chosen) for r in shredded.decided(merged, taken).collect()] == [("decided", 1)]
    again = shredded.merge_claims(rows.withColumn("touched", -F.col("touched")))
    assert [r.conflict_id for r in merged.collect()] == [r.conflict_id for r in again.collect()]


def test_no_python_runs(spark):
    rows = spark.createDataFrame([(1, "auth", "s", "f", None, '{"a":1}', None, None, 1)], SCHEMA)
    assert "Python" not in shredded.merge_claims(rows)._jdf.queryExecution().executedPlan().toString()


def test_only_groups_that_facts_leave_open_are_shredded(spark, monkeypatch):
    seen, real = [], shredded.shred
    monkeypatch.setattr(shredded, "shred", lambda rows: seen.extend(r.subject for r in rows.select("subject").collect()) or real(rows))
    rows = [(1, "auth", "single", "f", None, '{"a":1}', None, None, 1), (2, "auth", "open", "f", None, '{"a":1}', None, None, 1), (3, "auth", "open", "g", None, '{"a":2}', None, None, 2)]
    rows += [(4, "auth", "same", "f", None, '{"a":1}', None, None, 1), (5, "auth", "same", "g", None, '{"a": 1}', None, None, 2), (6, "auth", "status", "f", None, "{}", None, None, 1), (7, "auth", "status", "f", None, "{}", "shipped", None, 1)]
    rows += [(8, "overview", "rich", "f", None, '{"a":1}', None, None, 1), (9, "overview", "rich", "f", None, '{"a":2,"b":3}', None, None, 2)]
    assert check(spark, rows) == {"single", "identical", "status", "same-file", "conflict"}
    assert sorted(seen) == ["open", "open"]
