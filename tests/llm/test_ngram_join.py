from collections import Counter
from itertools import combinations

import numpy as np
from helpers import AWKWARD, documents
from sondage.llm import ngram_join as J


def brute(rows):
    """Links and groups between the distinct texts, from all pairs."""
    shingler, texts = J.Shingler(), {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    keys = list(texts)
    sets = [set(shingler.hashes(t).tolist()) for t in keys]
    links, root = Counter(), list(range(len(keys)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(keys)), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for k, t in enumerate(keys):
        groups.setdefault(find(k), []).extend(i for i in texts[t] if i is not None)
    return {t: (min(groups[find(k)], default=None), links[k]) for k, t in enumerate(keys)}


def rows_of(seed=1, groups=12, hot=60):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{k}" for k in range(900)])
    passage = list(rng.choice(words, 60))
    rows, n = [], 0
    for g in range(groups):
        base = list(rng.choice(words, 120)) + passage
        for _ in range(hot if g == 0 else 5):
            text = list(base)
            for at in rng.choice(120, rng.integers(0, 5), replace=False):
                text[at] = str(rng.choice(words))
            rows.append((n, " ".join(text)))
            n += 1
    return rows + [(n + k, rows[k][1]) for k in range(20)]


def test_links_and_groups_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "SMALL", 16)
    monkeypatch.setattr(J, "BLOCK", 16)
    rows = rows_of() + [(5000 + k if i is not None else None, t) for k, (i, t) in enumerate(AWKWARD)]
    want = brute(rows)
    got = J.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    expected = sorted((str(i), *map(str, want[t or ""])) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.class_id), str(r.n_links)) for r in got) == expected


def pairs_at_the_threshold(count, seed=5):
    """Texts of 50 to 60 words and again with one word changed: similarities from 0.80 to 0.84."""
    rng = np.random.default_rng(seed)
    words = np.array([f"w{k}" for k in range(3000)])
    rows = []
    for k in range(count):
        text = list(rng.choice(words, rng.integers(50, 60)))
        other = list(text)
        other[int(rng.integers(10, 40))] = f"changed{k}"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    return rows


def test_recall_at_the_threshold(spark):
    rows = pairs_at_the_threshold(1000)
    got = {r.doc_id: r for r in J.near_duplicates(documents(spark, rows)).collect()}
    shingler, truly = J.Shingler(), []
    for k in range(1000):
        a, b = (set(shingler.hashes(rows[2 * k + i][1]).tolist()) for i in (0, 1))
        if len(a & b) >= 0.8 * len(a | b):
            truly.append(k)
    assert len(truly) > 900
    assert sum(got[2 * k + 1].class_id == 2 * k for k in truly) >= 0.98 * len(truly)
    assert sum(r.n_links for r in got.values()) <= 2 * len(truly)


def test_buckets_are_split_beyond_the_first_levels(spark, monkeypatch):
    """A hundred texts share long passages, so that paths of one level leave them together."""
    monkeypatch.setattr(J, "BLOCK", 8)
    deeper = []
    monkeypatch.setattr(J, "_deeper", lambda *a, f=J._deeper: deeper.append(1) or f(*a))
    rng = np.random.default_rng(4)
    words = np.array([f"w{k}" for k in range(900)])
    passages = [list(rng.choice(words, 40)) for _ in range(6)]
    rows = []
    for k in range(60):
        text = [w for p in rng.permutation(6)[:4] for w in passages[p]] + list(rng.choice(words, 30))
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join([*text, f"more{k}"]))]
    want = brute(rows)
    got = J.near_duplicates(documents(spark, rows), levels=1, small=4).collect()
    assert deeper
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted((i, *want[t]) for i, t in rows)


def test_runs_are_repeated_until_the_measured_recall(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(J, "_linked", lambda *a, f=J._linked: asked.append(a[6]) or f(*a))
    monkeypatch.setattr(J, "runs_for", lambda *a: 2)
    rows = pairs_at_the_threshold(200)
    got = {r.doc_id: r.class_id for r in J.near_duplicates(documents(spark, rows)).collect()}
    assert len(asked) > 1 and asked[:2] == [2, 2]
    assert sum(got[2 * k + 1] == 2 * k for k in range(200)) >= 180
    assert J.recall_of(0, 0, 0, 7) == J.recall_of(10, 0, 0, 7) == 1 and J.recall_of(90, 30, 30, 10) < 0.9


def test_a_bucket_eight_levels_deep_leaves_texts_with_few_buckets(spark):
    """Each text takes one of two passages at forty places, so that a level parts a bucket in halves; two hundred texts are in none."""
    from pyspark.sql import functions as F
    from sondage.llm._common import text_or_empty

    rng = np.random.default_rng(8)
    words = np.array([f"w{k}" for k in range(5000)])
    passages = rng.choice(words, (40, 2, 8))
    deep = [" ".join(passages[np.arange(40), rng.integers(0, 2, 40)].ravel()) for _ in range(3000)]
    rows = list(enumerate([*deep, *(" ".join(rng.choice(words, 40)) for _ in range(200))]))
    docs = documents(spark, rows)
    sketches = J._sketches(docs, "doc_id", "text", 5, 2, 1).cache()
    texts = docs.select(J._key(text_or_empty("text")).alias("key"), F.col("text").alias("t"))
    means = []
    deeper = lambda *a, f=J._deeper: means.append(a[4]) or f(*a)
    old, J._deeper = J._deeper, deeper
    try:
        leaves = J._leaves(sketches, lambda keys: texts.join(keys.drop("rep"), "key").select("key", "paths", "t"), 5, 2, 1, 1, 2, 0.8)
        widths = [r["count"] for r in leaves.groupBy("key").count().collect()]
    finally:
        J._deeper = old
    assert len(means) >= 8 and means[:3] == [2, 2, 1.25] and means[-1] == 1.25
    assert max(widths) < 2 * 2 ** len(means) / 2 and sum(widths) < 2 * 16 * len(deep)


def test_in_common_counts_shared_buckets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(0, 30)))) for _ in range(40)]
    got = J._in_common(sets)
    assert all(got[i, j] == len(set(sets[i]) & set(sets[j])) for i in range(40) for j in range(40) if i != j)


def test_one_of_each(spark):
    rows = rows_of(seed=2, groups=4, hot=8)
    docs = documents(spark, rows)
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in brute(rows).values()})


def test_empty_table(spark):
    assert J.near_duplicates(documents(spark, AWKWARD).limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in J.components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_runs():
    assert 1 - (1 - 0.8**3) ** J.runs_for(0.8, 3, 0.99) >= 0.99
