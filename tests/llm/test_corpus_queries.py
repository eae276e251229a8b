"""The corpus queries that SQL can express, against DuckDB; the rest run and return every row."""

import glob
import os

import duckdb
import pytest
from sondage.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf), duck.sql(ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    places = [want.columns.index(c) for c in order]
    assert sorted((tuple(map(str, (r[c] for c in order))) for r in got.collect())) == sorted(tuple(str(r[k]) for k in places) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_returns_every_row(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).collect()
    count = lambda sql: duck.sql(sql).fetchall()[0][0]
    if name == "op7_ann":
        assert len(got) == 10 * count("SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0") and {r.query_id % 100 for r in got} == {0}
        return
    assert {r.doc_id for r in got} == {r[0] for r in duck.sql("SELECT doc_id FROM documents").fetchall()}
    if name != "op1_pack":
        assert len(got) == count("SELECT count(*) FROM documents")
    else:
        fill = {}
        for r in got:
            fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in fill.values():
            assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
        assert len(fill) <= 1.01 * -(-sum(r.length for r in got) // 4096) + 1


def test_the_pipeline_runs(spark, sf):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows and {r.doc_id for r in rows} <= docs and len({(r.doc_id, r.piece) for r in rows}) == len(rows)


def test_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
