import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import AWKWARD
from sondage.llm.divergence import UNIT, divergence, smoothed_counts

SCHEMA = "doc_id long, text string, lang string, source string, a string, term string, g int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, "x", "y", 3) for i, (lang, source, t) in enumerate(rows)], SCHEMA).repartition(4)


def brute(rows, min_docs=10, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.translate(lower)) for _, _, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        df, count = Counter(), defaultdict(Counter)
        for (at, source, _), w in zip(rows, words, strict=True):
            if at == lang:
                df.update(set(w))
                count[source].update(w)
        kept = sorted((t for t in df if df[t] >= min_docs), key=str.encode)
        share = lambda c: {t: 1 + UNIT * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        whole, p = share(sum(count.values(), Counter())), {s: share(c) for s, c in count.items()}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in count:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in count if o != s]
            term = [(f(p[s][t], whole[t]), t) for t in kept if count[s][t] and p[s][t] > whole[t]]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, top)):
                for k, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.append((lang, s, part, item, value, k + 1))
    return sorted(out)


def rows_of(df):
    assert [t for _, t in df.dtypes] == ["string", "string", "string", "string", "bigint", "int"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("sizes", [{}, {"block_groups": 2, "chunk_terms": 5, "stripe_chunks": 2}])
def test_against_brute_force(spark, sizes):
    rng = np.random.default_rng(4)
    words = ["Ab", "ab", "ÄB", "äb", "naïve", "x1y", "don't", "日本", "zz"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40)]
    rows = []
    for lang, sources in (("en", 7), ("de", 3), (None, 2), ("", 1), ("lone", 1), ("few", 3)):
        for _ in range(6 if lang == "few" else 60):
            s = int(rng.integers(0, sources) * rng.integers(0, 2))
            rows.append((lang, [None, "", "src1", "src2", "Ä", "z", "src10"][s] if lang == "en" else f"s{s}", " ".join(rng.choice(words, int(rng.integers(0, 12))))))
    rows += [("en", "no terms", "1 2 3"), ("en", "no terms", None), ("de", "hot", "ab zz " * 30_000)] + [("en", "src1", "ab ab")] * 40
    assert rows_of(divergence(table(spark, rows), **sizes)) == brute(rows)


def test_awkward_and_empty_tables(spark):
    rows = [(None, None, t) for _, t in AWKWARD]
    assert rows_of(divergence(table(spark, rows), min_docs=1)) == brute(rows, 1)
    rows = [("a", "s", "one two"), ("a", "t", None), ("b", "s", "x")]
    assert rows_of(divergence(table(spark, rows))) == brute(rows) == [("a", "s", "pair", "t", 0, 1), ("a", "t", "pair", "s", 0, 1)]
    assert divergence(table(spark, [("a", "b", "c")]).where("false")).collect() == []


def test_shares_of_huge_counts_are_exact():
    n = np.array([[0, 1, 7, 10**10, 3 * 10**14, 10**15 - 9]], np.int64)
    down = np.array([[10**15 + 77]], np.int64)
    assert smoothed_counts(n, down).tolist() == [[1 + UNIT * (x + 2) // (10**15 + 77) for x in n[0].tolist()]]
    assert smoothed_counts(n[:, :3], down).tolist() == [[1 + UNIT * (x + 2) // (10**15 + 77) for x in (0, 1, 7)]]
