"""A corpus pipeline of the operators in ``sondage.llm``, each stage stored before the next.

In every stage a null text counts as empty, repeated rows and null ids are rows
of their own, ties go by the operator's stated order, an empty table gives an
empty result, and all but the last return the columns that they were given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sondage.llm import exact_dedup, ngram_join, packing, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that a classifier chain fitted on ``labels`` finds toxic; without labels of both kinds none does."""
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, chain)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text one stays: the longest as it is written, then the smallest id; null and empty texts are equal."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; texts without words are alike to equal ones only."""
    return ngram_join.one_of_each(docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by marks, and ``n_chars`` follows; a null text stays null."""
    return secrets.redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and place there; an empty text is one piece, its end."""
    import public_tokenizers

    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near duplicates", drop_near_copies),
    ("secret removal", remove_secrets),
    ("packing", pack_sequences),
]

#: Learned models, sampled joins and packing have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def _files(spark: SparkSession, path: str):
    """The file system of a path, whatever store it is in, and the path there."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written and read again.

    A stage's rows are removed once those of the next are written. With
    ``folder``, a run that was cut short goes on from the last stage that it
    had finished there; without, a new folder in the shared one is used.
    """
    from sondage.llm._common import shared_folder

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    places = [f"{base}/{k}" for k in range(len(STAGES))]
    done = -1
    for k, place in enumerate(places):
        files, there = _files(spark, f"{place}/_SUCCESS")
        done = k if files.exists(there) else done
    for k, (_, stage) in enumerate(STAGES):
        if k > done:
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(places[k])
        if k >= done:
            docs = spark.read.parquet(places[k])
        if 0 < k and k > done:
            files, there = _files(spark, places[k - 1])
            files.delete(there, True)
    return docs
