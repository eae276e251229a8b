"""All operators over one table whose columns have every awkward name and type."""

import public_tokenizers
import pytest
from helpers import AWKWARD
from pyspark.sql import functions as F
from sondage.llm import ann, byte_bpe, chat_format, exact_dedup, licenses, ngram_join, packing, quality, secrets, toxicity

EXTRA = {
    "a.b": "map('k', id)", "b`c": "id", "__n": "id", "__id": "'x'", "__keep": "id", "__sha": "'s'", "__digest": "'d'", "__key": "'k'", "__uid": "1L", "__row": "id", "__text": "'t'", "__conv": "id",
    "r": "struct(id as r)", "t": "array(id)", "row": "id", "path": "'p/q'", "part": "1", "id": "id", "key": "'k'", "keep": "id", "sha": "'s'", "digest": "'d'", "chars": "1", "score": "0.5D", "license": "'MIT'", "dest": "3", "block": "'b'", "fold": "2",
    "y": "1", "free": "true", "bits": "id", "length_": "1", "shard": "2", "v": "id", "ids": "id", "lang": "cast(null as string)", "source": "'s'", "best": "id", "n": "id", "class_id": "id",
}
TEXTS = [t for _, t in AWKWARD] + ["Released under the MIT License.", 'token = "abcdef1234567890"', "one two three four five six seven eight " * 9]
NAME, TEXT = "the.id", "the `text`"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, None), (3, TEXTS[3]), (3, TEXTS[3])]
    base = spark.createDataFrame(rows, "id long, text string")
    return base.select(F.col("id").alias(NAME), F.col("text").alias(TEXT), *[F.expr(e).alias(n) for n, e in EXTRA.items()]).repartition(3)


def test_rows_that_stay_keep_their_columns(spark, docs):
    for kept in (exact_dedup.exact_dedup(docs, NAME, TEXT), ngram_join.one_of_each(docs, NAME, TEXT), secrets.redact_secrets(docs, TEXT, None), toxicity.keep_clean(docs, toxicity.Chain([], [toxicity.L.fit(toxicity.np.zeros((0, 0)), toxicity.np.zeros(0))]), TEXT)):
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        rows = kept.collect()
        assert 0 < len(rows) <= docs.count()
        for r in rows:
            assert r["a.b"] is None or r["a.b"] == {"k": r["b`c"]}
    assert docs.limit(0).transform(lambda d: exact_dedup.exact_dedup(d, NAME, TEXT)).count() == 0


def test_rows_are_counted_once(spark, docs):
    n = docs.count()
    labels = docs.select(F.col(f"`{NAME}`"), (F.col("id") % 2).alias("quality"), (F.col("id") % 3).alias("toxic"))
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    for got in (
        exact_dedup.exact_groups(docs, NAME, TEXT), ngram_join.near_duplicates(docs, NAME, TEXT), secrets.find_secrets(docs, NAME, TEXT), licenses.license_scan(docs, F.col("path"), NAME, TEXT),
        toxicity.score(docs, toxicity.train(docs, labels, NAME, TEXT), NAME, TEXT), quality.fit_and_score(docs, labels, NAME, TEXT), byte_bpe.encode(docs, path, pattern, NAME, TEXT), byte_bpe.digests(docs, path, pattern, NAME, TEXT),
    ):
        assert got.columns[0] == NAME and got.count() == n
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), NAME, TEXT)
    assert packing.pack(pieces).count() == pieces.count() >= n


def test_decoding_keeps_other_columns(spark, docs):
    rows = docs.select("*", F.array(F.lit(1)).alias("token.ids"))
    got = byte_bpe.decode(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), "token.ids")
    assert got.columns == [*rows.columns, "decoded"] and got.count() == rows.count()


def test_chats_and_vectors(spark, docs):
    chats = docs.select(F.lit(1).alias("the conv"), F.col(f"`{NAME}`").alias("the.turn"), F.lit(None).cast("string").alias("ro.le"), F.col(f"`{TEXT.replace('`', '``')}`").alias("te.xt"), "t", "r")
    assert chat_format.format_chats(chats, "the conv", "the.turn", "ro.le", "te.xt").count() == 1
    vectors = docs.select(F.col(f"`{NAME}`").alias("vec.id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("em.b"), "v", "ids", "`a.b`")
    got = ann.nearest(vectors, vectors.where("v < 3"), 2, "vec.id", "em.b")
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.count() == 6
