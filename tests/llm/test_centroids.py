import hashlib

import numpy as np
import pytest
from sondage.llm.centroids import Bounds, cluster, group_centroids, largest, squared, with_inertia

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, x string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 9, "x") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k, rounds, dims, scale=1024, seed="3:"):
    """Plain rounds over all distances in Python's whole numbers."""
    kept = [(i, [int(np.floor(scale * float(np.float32(e)))) for e in v]) for i, v in rows if v is not None and len(v) == dims and all(e is not None and np.isfinite(e) for e in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [list(v) for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for n in range(rounds + 1):
        own = [min((far(v, y), j) for j, y in enumerate(c)) for _, v in kept]
        if n < rounds:
            for j in range(len(c)):
                of = [v for (_, v), (_, o) in zip(kept, own, strict=True) if o == j]
                if of:
                    c[j] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    sums = {j: sum(d for d, o in own if o == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    return sorted(((i, o, d, sums[o], sum(sums.values()), sha[o]) for (i, _), (d, o) in zip(kept, own, strict=True)), key=str)


def run(spark, rows, k, rounds, dims, **more):
    found, centroids, scanned = cluster(table(spark, rows), k, rounds, dims=dims, buckets=3, **more)
    return sorted((tuple(r) for r in with_inertia(found, centroids).collect()), key=str), scanned


@pytest.mark.parametrize("seed,k", [(1, 8), (2, 11), (3, 1)])
def test_against_brute_force(spark, seed, k):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, 6)) * 2
    rows = [(int(n), np.float32(centres[n % 5] + rng.standard_normal(6) * 0.7).tolist()) for n in range(400)]
    rows += [(900, rows[3][1])] * 150 + [(900, rows[4][1]), (None, rows[5][1]), (None, rows[6][1])]  # a hot vector, repeated and null ids
    rows += [(1, None), (2, []), (3, [1.0] * 5), (4, [None] * 6), (5, [float("nan")] * 6), (6, [float("inf")] * 6), (7, [0.0] * 6)]
    got, scanned = run(spark, rows, k, 6, 6, group_size=3, block_rows=64)
    assert got == brute(rows, k, 6, 6) and len(scanned) == 7
    assert k < 8 or scanned[-1] < scanned[0] / 2  # the filters spare most distances


def test_grid_points_with_many_ties(spark):
    rng = np.random.default_rng(5)
    rows = [(n, [float(x) / 1024 for x in rng.integers(-2, 3, 2)]) for n in range(300)]
    assert run(spark, rows, 6, 8, 2, group_size=2)[0] == brute(rows, 6, 8, 2)


def test_few_none_and_too_large(spark):
    rows = [(1, [0.5, 1.0]), (2, [-0.25, 3.0])]
    assert run(spark, rows, 8, 3, 2)[0] == brute(rows, 8, 3, 2)
    assert cluster(table(spark, [(1, None)]), 8, dims=2)[0].collect() == []
    found = with_inertia(*cluster(table(spark, [(1, None)]), 8, dims=2)[:2])
    assert found.collect() == [] and found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="does not fit"):
        run(spark, [(1, [1e30, 0.0]), (2, [0.0, 0.0])], 1, 1, 2)


def test_bounds_hold_while_centroids_wander():
    rng = np.random.default_rng(6)
    for scale in (50, 1 << 25):
        x = rng.integers(-scale, scale, (200, 4))
        now = rng.integers(-scale, scale, (9, 4))
        groups = group_centroids(now, 3)
        state = Bounds.first(x, now, groups)
        for _ in range(12):
            after = now + rng.integers(-scale // 8, scale // 8 + 1, now.shape) * (rng.random((9, 1)) < 0.6)
            drift = np.sqrt(((after - now) ** 2).sum(1)) * (1 + 1e-15)
            state.move(x, after, groups, drift)
            now = after
            d = squared(x, now)
            assert (d == np.array([[sum(int(a - b) ** 2 for a, b in zip(p, c, strict=True)) for c in now] for p in x])).all()
            assert (state.own == d.argmin(1)).all()
            root = np.sqrt(d)
            assert (state.upper >= root[np.arange(200), state.own]).all()
            root[np.arange(200), state.own] = np.inf
            assert all((state.lower[:, g] <= root[:, groups == g].min(1, initial=np.inf)).all() for g in range(3))


def test_largest_keeps_distances_in_a_long():
    assert all(dims * (2 * largest(dims)) ** 2 < 1 << 63 for dims in (1, 2, 64, 1000))


def test_rounds_join_without_an_exchange_of_vectors(spark):
    from sondage.llm.centroids import Store

    store = Store(spark, 3)
    a = store.write(spark.range(50).selectExpr("id AS block", "cast(id AS string) AS x").repartition(3, "block"), "a")
    b = store.write(a.select("block", "x"), "b")
    plan = a.join(b.hint("shuffle_hash"), "block")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan
    store.drop("a")
    store.drop("b")
