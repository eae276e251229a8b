"""The pipeline's stages over a small folder of tables, each against a brute-force version of itself."""

from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from sondage.llm.exact_dedup import IGNORED
from sondage.llm.secrets import redact, scan
from test_ngram_join import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, path):
    rng = np.random.default_rng(8)
    words = np.array([f"w{k}" for k in range(400)])
    texts = []
    for k in range(160):
        text = " ".join(rng.choice(words, 60))
        texts.append(text + " scumbag" if k % 8 == 0 else text)
    texts += [texts[k] + " " for k in range(0, 40, 3)]  # exact copies, toxic ones among them
    for k in range(1, 40, 5):  # near copies: one word in sixty
        parts = texts[k].split(" ")
        parts[30] = "changed"
        texts.append(" ".join(parts))
    texts += ['here token = "abcdef1234567890" stands ' + texts[2], "", None]
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 8 == 0)) for k in range(0, 160, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def plain(t):
    return "".join(c for c in t or "" if c not in IGNORED)


def test_stages(spark, tmp_path):
    rows = {r[0]: r for r in folder(spark, str(tmp_path))}
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen[name] = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {name: {r.doc_id for r in got} for name, got in seen.items()}

    assert ids["toxicity"] == {i for i, r in rows.items() if "scumbag" not in (r[1] or "")}
    groups = defaultdict(list)
    for i in ids["toxicity"]:
        groups[plain(rows[i][1])].append((-len(rows[i][1] or ""), i))
    assert ids["exact dedup"] == {min(g)[1] for g in groups.values()}
    left = [(i, rows[i][1]) for i in ids["exact dedup"]]
    assert ids["near duplicates"] == {c for c, _ in brute(left).values()} and len(ids["near duplicates"]) < len(left)
    assert ids["secret removal"] == ids["near duplicates"]
    for r in seen["secret removal"]:
        was = rows[r.doc_id][1]
        assert r.text == (was and redact(was, scan(was)[1])) and (r.text is None or r.n_chars == len(r.text))
    assert {r.doc_id for r in seen["packing"]} == ids["secret removal"]
    places = defaultdict(list)
    for r in seen["packing"]:
        places[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 4096 and sorted(p)[0][0] == 0 for p in places.values())


def test_a_run_that_was_cut_short_goes_on(spark, tmp_path, monkeypatch):
    rows = folder(spark, str(tmp_path))
    calls = []
    stages = [(name, lambda *a, f=f, name=name: calls.append(name) or f(*a)) for name, f in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*stages[:3], ("secret removal", lambda *a: 1 / 0), stages[4]])
    with pytest.raises(ZeroDivisionError):
        corpus_pipeline.run(spark, str(tmp_path), f"{tmp_path}/runs")
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    got = corpus_pipeline.run(spark, str(tmp_path), f"{tmp_path}/runs").collect()
    assert calls == [name for name, _ in stages] and {r.doc_id for r in got} <= {r[0] for r in rows}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path), f"{tmp_path}/runs").collect()} == {r.doc_id for r in got} and len(calls) == 5
    assert sorted(p.name for p in (tmp_path / "runs").iterdir()) == ["4"]


def test_run_registers_the_same_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near duplicates", "secret removal", "packing"]
