import numpy as np
from sondage.llm.ann import Forest, fit, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string"


def brute(rows, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(e is not None and np.isfinite(e) for e in v) and any(v)]
    out = {}
    for q, a in good:
        if q % 100 == 0:
            out[q] = sorted({(float(np.sqrt(((b - a) ** 2).sum())), i) for i, b in good if i != q})[:k]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA).repartition(3)


def search(spark, rows, **kw):
    vectors = table(spark, rows)
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), **kw).collect()


def test_recall_against_brute_force_and_exact_scores(spark):
    rng = np.random.default_rng(9)
    rows = [(k, np.float32(rng.standard_normal(16)).tolist()) for k in range(1500)]
    rows += [(5000 + k, rows[200][1]) for k in range(40)]  # a hot vector
    rows += [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16), (9300, [None] * 16), (None, rows[3][1]), (9400, [float("inf")] + [1.0] * 15)]
    got, want = search(spark, rows, shard_rows=400, query_rows=8), brute(rows)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(want)
    hit = total = 0
    for q, found in by.items():
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        exact = {i: d for d, i in brute([x for x in rows if x[0] == q or x[0] in {i for _, i, _ in found}], 20)[q]}
        assert all(abs(exact[i] - s) < 1e-12 for _, i, s in found)
        hit += len({i for _, i, _ in found} & {i for _, i in want[q]})
        total += 10
    assert hit >= 0.9 * total
    assert [(i, s) for _, i, s in sorted(by[200])] == [(5000 + k, 0.0) for k in range(10)]


def test_few_and_no_rows(spark):
    assert search(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])])[0].vec_id == 1
    assert search(spark, [(0, [1.0, 0.0])]) == [] and search(spark, [(7, None)]) == []


def test_descent_finds_the_longest_prefix():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 8))
    hashes, share = fit(x, trees=4)
    forest, codes = Forest(x, hashes), hashes.codes(x[:5])
    begin, end = forest.ranges(codes, np.full(5, 32))
    assert ((end - begin) >= 1).all() and 0 < share <= 1
    assert all(len(r) == 500 or len(r) >= 10 for r, _ in forest.search(x[:5], codes, 1.0, 500))
