"""The stream's end state against the lifecycle of all scans, whatever the order of batches."""

import random

import pytest
from sondage.streaming.recompute import FindingsState, lifecycle_of

SCHEMA = "file_path string, scan long, rule_key string"


def scans(seed):
    rng, rows = random.Random(seed), []
    for f in range(12):
        for scan in sorted(rng.sample(range(20), rng.randint(1, 7))):
            found = rng.sample(["r1", "r2", "r3"], rng.randint(0, 3))
            rows += [(f"f{f}", scan, r) for r in found] or [(f"f{f}", scan, None)]
    return rows


def plain(rows):
    out, by = {}, {}
    for f, s, r in rows:
        by.setdefault(f, {}).setdefault(s, set()).update({r} - {None})
    for f, seen in by.items():
        order, before = sorted(seen), set()
        for s in order:
            for r in seen[s]:
                out[f, r] = ["active", out[f, r][1] if r in before else s, s, None]
            for r in before - seen[s]:
                out[f, r][0], out[f, r][3] = "resolved", s
            before = seen[s]
    return {k: tuple(v) for k, v in out.items()}


def state(df):
    return {(r.file_path, r.rule_key): (r.status, r.first_seen, r.last_seen, r.resolved_at) for r in df.collect()}


def test_lifecycle_of_all_scans(spark):
    rows = scans(1)
    assert state(lifecycle_of(spark.createDataFrame([*rows, *rows[:9], (None, 1, "r"), ("f0", None, "r")], SCHEMA).repartition(3))) == plain(rows)


@pytest.mark.parametrize("order", ["forward", "backward"])
def test_a_stream_in_any_order_of_batches(spark, tmp_path, order):
    rows = scans(2)
    keys = sorted({(s, f) for f, s, _ in rows}, reverse=order == "backward")
    parts = [keys[k::3] if order == "forward" else keys[len(keys) * k // 3 : len(keys) * (k + 1) // 3] for k in range(3)]
    parts.append(parts[0])  # a batch that comes again
    for k, part in enumerate(parts):
        spark.createDataFrame([r for r in rows if (r[1], r[0]) in part], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = FindingsState(spark, f"file:{tmp_path}/state", compact_every=2)
    kept.follow(stream, str(tmp_path / "cp")).awaitTermination(300)
    assert state(kept.current()) == plain(rows)
    kept.update(spark.createDataFrame(rows[:5], SCHEMA), 3)  # the last batch once more, as after a failure
    assert state(kept.current()) == plain(rows)
