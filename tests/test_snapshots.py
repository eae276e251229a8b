"""The snapshot store: time travel, writers at once, compaction, diffs by scope."""

import threading

import pytest
from sondage.sources.snapshots import SnapshotStore

SCHEMA = "k long, v string"


def state(df):
    return {r.k: r.v for r in df.collect()}


def test_commits_changes_and_time_travel(spark, tmp_path):
    store, frame = SnapshotStore(spark, f"file:{tmp_path}", "drifts", ["k"]), lambda rows: spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(LookupError):
        store.read("r")
    store.write_full("r", "c1", "2024-01-01", frame([(1, "a"), (2, "b"), (3, "c")]))
    store.write_changes("r", "c2", "2024-01-02", frame([(2, "B"), (4, "d")]), frame([(1, None), (2, None), (9, None)]))
    store.write_changes("r", "c3", "2024-01-03", frame([(1, "again")]), frame([(4, None)]))
    want = {"c1": {1: "a", 2: "b", 3: "c"}, "c2": {2: "B", 3: "c", 4: "d"}, "c3": {1: "again", 2: "B", 3: "c"}}
    check = lambda: {c: state(store.read("r", c)) for c in want} == want and state(store.read("r")) == want["c3"]
    assert check()
    assert sorted(tuple(r) for r in store.diff("r", "c1", "c3").collect()) == [(1, "changed"), (2, "changed")]
    assert sorted(tuple(r) for r in store.diff("r", "c2", "c3").collect()) == [(1, "added"), (4, "removed")]
    store.compact("r", "c2")
    assert check() and [m["kind"] for m in store.history("r")] == ["full", "full", "changes"]
    store.write_full("r", "c4", "2024-01-04", frame([(7, "x")]))
    assert state(store.read("r")) == {7: "x"} and state(store.read("r", "c3")) == want["c3"]
    assert store.delete("r", "c4") and not store.delete("r", "c4") and check()
    other = SnapshotStore(spark, f"file:{tmp_path}", "contracts", ["k"])
    assert other.history("r") == [] and store.history("other") == []


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    store = SnapshotStore(spark, f"file:{tmp_path}", "drifts", ["k"])
    store.write_full("r", "base", "2024-01-01", spark.createDataFrame([(0, "base")], SCHEMA))

    def write(k):
        store.write_changes("r", f"w{k}", "2024-01-02", spark.createDataFrame([(k, f"by {k}")], SCHEMA), spark.createDataFrame([], SCHEMA))

    writers = [threading.Thread(target=write, args=(k,)) for k in range(1, 7)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert state(store.read("r")) == {0: "base", **{k: f"by {k}" for k in range(1, 7)}} and len(store.history("r")) == 7


def test_a_writer_that_fails_leaves_nothing_that_is_read(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, f"file:{tmp_path}", "drifts", ["k"])
    store.write_full("r", "base", "2024-01-01", spark.createDataFrame([(0, "base")], SCHEMA))
    monkeypatch.setattr(store, "_put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.write_full("r", "next", "2024-01-02", spark.createDataFrame([(1, "half")], SCHEMA))
    assert state(SnapshotStore(spark, f"file:{tmp_path}", "drifts", ["k"]).read("r")) == {0: "base"}


def test_diffs_by_scope(spark, tmp_path):
    store, frame = SnapshotStore(spark, f"file:{tmp_path}", "drifts", ["k"]), lambda v: spark.createDataFrame([(1, v)], SCHEMA)
    assert store.read_diff("r") is None
    store.write_diff("r", frame("tree"))
    store.write_diff("r", frame("pr"), "pr/12: a")
    store.write_diff("r", frame("pr again"), "pr/12: a")
    assert state(store.read_diff("r")) == {1: "tree"} and state(store.read_diff("r", "pr/12: a")) == {1: "pr again"}
    assert store.delete_diff("r", "pr/12: a") and store.read_diff("r", "pr/12: a") is None and state(store.read_diff("r")) == {1: "tree"}
