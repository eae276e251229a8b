import numpy as np
from helpers import AWKWARD, documents
from sondage.llm import _linear as L, quality
from sondage.llm._linear import FOLDS, predict


def known_of(x, y):
    return quality.Labelled(x, y, np.arange(len(y)) % FOLDS, tuple([np.arange(a.shape[1])] * (FOLDS + 1) for a in x))


def pooled(pool, known):
    return lambda weights: quality.pseudo_counts(pool, weights, known.places)


def test_cotraining_uses_confident_labels_of_the_other_view():
    """The second view's telling feature is in no labelled row; only the first view can teach it."""
    rng = np.random.default_rng(2)
    y, pool_y = rng.integers(0, 2, 200).astype(float), rng.integers(0, 2, 4000).astype(float)
    noise = lambda n: rng.integers(0, 2, (n, 3)).astype(float)
    x = (np.c_[y, noise(200)], np.c_[np.zeros(200), noise(200)])
    pool = (np.c_[pool_y, noise(4000)], np.c_[pool_y, noise(4000)])
    known = known_of(x, y)
    alone, both = (quality.cotrain(known, pooled(pool, known), (list("abcd"), list("efgh")), rounds) for rounds in (0, 3))
    assert abs(alone.weights[1][0]) < 0.1 < both.weights[1][0]
    assert ((both.probabilities(pool)[:, 2] > 0.5) == (pool_y > 0)).mean() > 0.98


def test_counts_are_sums_over_all_rows():
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 100).astype(float)
    x = (np.c_[y, rng.integers(0, 2, (100, 2))].astype(float), np.c_[rng.integers(0, 2, (100, 2)), y].astype(float))
    known = known_of(x, y)
    weights = [[quality._fit(known, k, v, None) for v in (0, 1)] for k in range(FOLDS + 1)]
    whole = quality.pseudo_counts(x, weights, known.places)
    parts = sum(quality.pseudo_counts(tuple(a[i::7] for a in x), weights, known.places) for i in range(7))
    assert (whole == parts).all()
    for k in range(FOLDS + 1):
        for v in (0, 1):
            p = predict(x[v], weights[k][v])
            for label, sure in ((0, p <= 0.05), (1, p >= 0.95)):
                assert whole[k, 1 - v, label].tolist() == [*x[1 - v][sure].sum(0), sure.sum(), x[1 - v][sure].sum()]


def test_an_idle_view_does_no_harm():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 200).astype(float)
    x = (np.c_[y, rng.integers(0, 2, 200)].astype(float), rng.integers(0, 2, (200, 2)).astype(float))
    known = known_of(x, y)
    model = quality.cotrain(known, pooled((x[0][:0], x[1][:0]), known), (list("ab"), list("cd")))
    assert ((model.probabilities(x)[:, 2] > 0.5) == (y > 0)).all()


def test_the_distributed_exchange_matches_a_plain_version(spark):
    """All unlabelled rows are in play: the model equals one whose counts are taken in memory."""
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(w + ("***" if k % 5 == 0 else "") for w in rng.choice(words, 30))) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 5 != 0)) for k in range(0, 200, 2)], "doc_id long, quality int")
    docs = documents(spark, rows)
    model = quality.train(docs, labels)
    seen = quality._seen(docs, "doc_id", "text")
    chosen, known_rows = L.labelled(seen, labels, "doc_id", "quality", 6000)
    named = [L.places_of(L.associated(known_rows, v, "y", least=least)) for v, least in zip(quality.VIEWS, (30.0, 8.0), strict=True)]
    got = [L.matrix(known_rows, v, f) for v, (f, _) in zip(quality.VIEWS, named, strict=True)]
    known = quality.Labelled((got[0][0], got[1][0]), got[0][1], got[0][2], tuple(p for _, p in named))
    free = [r.asDict() for r in seen.collect() if r.doc_id % 2 or r.doc_id >= 200]
    assert len(free) == 500
    pool = tuple(np.array([[f in v(r) for f in fs] for r in free], float).reshape(len(free), len(fs)) for v, (fs, _) in zip(quality.VIEWS, named, strict=True))
    want = quality.cotrain(known, pooled(pool, known), tuple(f for f, _ in named))
    assert model.features == want.features
    for a, b in zip((*model.weights, *model.calibration, model.combined), (*want.weights, *want.calibration, want.combined), strict=True):
        assert np.allclose(a, b)
    one = {r.doc_id: r for r in quality.fit_and_score(docs, labels).collect()}
    for r in quality.score(docs, model).collect():
        assert np.allclose(r.quality_score, one[r.doc_id].quality_score) and r.keep == one[r.doc_id].keep


def test_held_out_accuracy_and_defined_cases(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(w + ("***" if k % 6 == 0 else "") for w in rng.choice(words, 40))) for k in range(300)]
    docs = documents(spark, rows + [(10**6 + k, t) for k, (_, t) in enumerate(AWKWARD)])
    labels = spark.createDataFrame([(k, int(k % 6 != 0), 0) for k in range(0, 300, 2)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == docs.count()
    seen = [r for r in got if r.doc_id is not None and r.doc_id < 300]
    assert np.mean([r.keep == (r.doc_id % 6 != 0) for r in seen]) >= 0.99
    assert quality.score(docs.limit(0), quality.train(docs, labels.limit(0))).count() == 0
