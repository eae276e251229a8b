import numpy as np
from helpers import AWKWARD, documents
from sondage.llm import _linear as L, toxicity
from sondage.llm._linear import FOLDS


def corpus(spark, n=400):
    """Every eighth text holds a word that only toxic texts hold, or one with a telling beginning."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(words, 30))
        if k % 8 == 0:
            text += " scumbag" if k % 16 else f" vequ{rng.integers(10**6)} vequ{rng.integers(10**6)} vequx{rng.integers(10**6)}"
        rows.append((k, text))
    labels = spark.createDataFrame([(k, 1, int(k % 8 == 0)) for k in range(0, n, 2)] + [(3, 1, None), (None, 0, 1), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    return rows, labels


def test_held_out_accuracy_and_defined_cases(spark):
    rows, labels = corpus(spark)
    docs = documents(spark, rows + [(10**7 + k, t) for k, (_, t) in enumerate(AWKWARD)])
    chain = toxicity.train(docs, labels)
    got = toxicity.score(docs, chain).collect()
    assert len(got) == docs.count()
    seen = [r for r in got if r.doc_id is not None and r.doc_id < 400]
    assert np.mean([r.toxic == (r.doc_id % 8 == 0) for r in seen]) >= 0.99
    assert not any(r.toxic for r in got if r.doc_id is None or r.doc_id >= 10**7)
    clean = toxicity.keep_clean(docs, chain)
    assert clean.columns == docs.columns and clean.count() == sum(not r.toxic for r in got)


def test_no_labels_and_empty_tables(spark):
    rows, labels = corpus(spark, 20)
    docs = documents(spark, rows)
    chain = toxicity.train(docs, labels.limit(0))
    assert not any(r.toxic for r in toxicity.score(docs, chain).collect())
    assert toxicity.score(docs.limit(0), chain).count() == 0


def two_kinds(n=4000, seed=1):
    """Rows with 20 terms; toxic ones hold some of one kind's terms (0-4 or 5-9), clean ones few and of both."""
    rng = np.random.default_rng(seed)
    y, kind = (rng.random(n) < 0.2).astype(float), rng.integers(0, 2, n)
    x = (rng.random((n, 20)) < 0.1).astype(float)
    for k in range(n):
        if y[k]:
            x[k, 5 * kind[k] : 5 * kind[k] + 5] = rng.random(5) < 0.45
    return x, y, np.arange(n) % FOLDS


def test_kinds_are_clusters_of_toxic_rows():
    x, y, _ = two_kinds()
    centres = toxicity.kinds_of(x[y > 0], 2)
    first = {int(np.argmax(c)) // 5 for c in centres}
    assert first == {0, 1}
    assert (toxicity.categories_of(x, y, centres).sum(1) <= y).all()
    assert np.allclose(toxicity.matched(centres[::-1], centres), centres)


def test_the_chain_against_the_label_alone():
    """An ablation on held-out rows: the kinds tell what a linear model of the label alone can't."""
    x, y, fold = two_kinds()
    places, features = [np.arange(20)] * (FOLDS + 1), [str(k) for k in range(20)]
    loss = {}
    for kinds in (0, 2):
        p = np.zeros(len(y))
        for k in range(2):
            here = fold % 2 == k
            chain = toxicity.fit_chain(x[~here], y[~here], np.arange((~here).sum()) % FOLDS, places, features, kinds)
            p[here] = chain.probabilities(x[here])[:, -1]
        loss[kinds] = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    assert [len(w) for w in chain.weights] == [21, 22, 23]
    assert loss[2] < loss[0]


def test_training_and_scoring_match_a_plain_version(spark):
    """The distributed counts, selection and scores against the same on plain lists."""
    rows, labels = corpus(spark)
    docs, held = documents(spark, rows), {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    _, known = L.labelled(docs.select("doc_id", "text"), labels, "doc_id", "toxic", 6000)
    fold = {r.doc_id: r.fold for r in known.collect()}
    assert set(fold) == {i for i, _ in rows if i in held}
    views = {i: L.words_and_stems(t) for i, t in rows if i in fold}
    sets = []
    for out in (None, *range(FOLDS)):
        ids = [i for i in fold if fold[i] != out]
        total, pos, where = len(ids), sum(held[i] for i in ids), {}
        for i in ids:
            for f in views[i]:
                where.setdefault(f, set()).add(i)
        best = {}
        for f, at in where.items():
            n, p = len(at), sum(held[i] for i in at)
            cells = [(p, n * pos / total), (n - p, n * (1 - pos / total)), (pos - p, (total - n) * pos / total), (total - n - pos + p, (total - n) * (1 - pos / total))]
            g = 2 * sum(k * np.log(k / e) for k, e in cells if k)
            if 3 <= n < total and g >= 30:
                best[frozenset(at)] = max(best.get(frozenset(at), (0, "", 0)), (len(f), f, g))
        sets.append([f for _, f, _ in sorted(best.values(), key=lambda b: (-round(b[2], 6), b[1]))][:256])
    assert [set(s) for s in L.associated(known, toxicity._view, "y")] == [set(s) for s in sets]
    chain = toxicity.train(docs, labels)
    x = np.array([[f in L.words_and_stems(t) for f in chain.features] for _, t in rows], float)
    want = {i: p for (i, _), p in zip(rows, chain.probabilities(x), strict=True)}
    for r in toxicity.score(docs, chain).collect():
        assert np.allclose([r[f"p_{c}"] for c in toxicity.CATEGORIES], want[r.doc_id]) and r.toxic == (want[r.doc_id][-1] >= 0.5)


def test_later_models_learn_from_unseen_predictions():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (300, 5)).astype(float)
    y = x[:, 0] * (rng.random(300) < 0.9)
    p = L.out_of_fold(x, y, np.arange(300) % FOLDS)
    assert p.shape == (300,) and abs(p[x[:, 0] == 1].mean() - y[x[:, 0] == 1].mean()) < 0.05
