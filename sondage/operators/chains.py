"""Version chains of documents from several sources, their statistics, pairs to look at again, and artifacts' identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Sources of a chain, the one whose label stays first.
SOURCES = ("filename", "llm", "manual")


def merged_sources(chains: DataFrame) -> DataFrame:
    """(chain_id, older, newer, source): chains that several sources found, once, by the source that comes first.

    A chain's id depends on its two documents, not on their order.
    """
    pair = F.array_sort(F.array("older", "newer"))
    named = chains.withColumn("chain_id", F.sha2(F.array_join(pair, "\n").cast("binary"), 256))
    order = F.struct(F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source")).alias("k"), "older")
    return named.groupBy("chain_id").agg(F.min_by(F.struct("older", "newer", "source"), order).alias("c")).select("chain_id", "c.older", "c.newer", "c.source")


def chain_stats(chains: DataFrame, claims: DataFrame, most: int = 8) -> DataFrame:
    """(chain_id, file, n, topics, subjects): what each document of a chain claims; up to ``most`` subjects, by name."""
    files = chains.select("chain_id", F.explode(F.array("older", "newer")).alias("file")).distinct()
    topics = claims.groupBy("file", "topic").agg(F.count("*").alias("k")).groupBy("file").agg(F.sum("k").alias("n"), F.array_sort(F.collect_list(F.concat_ws("=", "topic", F.col("k").cast("string")))).alias("topics"))
    ranked = claims.select("file", "subject").distinct().withColumn("r", F.row_number().over(W.partitionBy("file").orderBy("subject"))).where(F.col("r") <= most)
    subjects = ranked.groupBy("file").agg(F.array_sort(F.collect_list("subject")).alias("subjects"))
    none = F.array().cast("array<string>")
    return files.join(topics, "file", "left").join(subjects, "file", "left").select("chain_id", "file", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("topics", none).alias("topics"), F.coalesce("subjects", none).alias("subjects"))


def recheck_pairs(candidates: DataFrame, docs: DataFrame, chained: DataFrame, fundamental: Column) -> DataFrame:
    """(conflict_id, older, newer): documents of one kind that disagree on a fundamental subject and aren't chained yet.

    candidates: conflict_id, subject, doc_kind, file; docs: file, touched. Each
    pair comes once, with the least conflict; the older is touched earlier, ties
    by name. A conflict's candidates are its few documents, so their pairs are few.
    """
    files = candidates.where(fundamental & (F.col("doc_kind") == "prd")).select("conflict_id", "file").distinct().join(docs, "file")
    a = files.select("conflict_id", F.col("file").alias("older"), F.col("touched").alias("t1"))
    b = files.select("conflict_id", F.col("file").alias("newer"), F.col("touched").alias("t2"))
    pairs = a.join(b, "conflict_id").where((F.col("t1") < F.col("t2")) | ((F.col("t1") == F.col("t2")) & (F.col("older") < F.col("newer"))))
    return pairs.join(chained.select("older", "newer").distinct(), ["older", "newer"], "left_anti").groupBy("older", "newer").agg(F.min("conflict_id").alias("conflict_id"))


def identities(artifacts: DataFrame) -> DataFrame:
    """(kind, identity, n): artifacts that say the same, once, under names that depend on what they say.

    artifacts: kind, name, body. Those of equal kind and body are one; the least
    of their names, as a slug, is its name; where several bodies want one name,
    all but the first by the body's hash get the hash's first eight signs too.
    """
    digest = F.sha2(F.col("body").cast("binary"), 256)
    one = artifacts.groupBy("kind", digest.alias("h")).agg(F.min(F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-+|-+$", "")).alias("slug"), F.count("*").alias("n"))
    k = F.row_number().over(W.partitionBy("kind", "slug").orderBy("h"))
    return one.withColumn("k", k).select("kind", F.when(F.col("k") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.substring("h", 1, 8))).alias("identity"), "n")


def remerge(claims: DataFrame, chains: DataFrame, decisions: DataFrame) -> DataFrame:
    """(topic, subject, how, chosen): the merge of stored claims once more, from chains and decisions, without extraction.

    Claims of documents that a newer version replaces go, then those without
    content and those that aren't live; groups are settled, and a decision that
    was taken for a conflict takes the place of its default.
    """
    from sondage.operators import claims as op

    rows = op.live(op.without_empty(op.superseded(claims, chains)))
    settled = op.settle(rows)
    open_ = op.conflicts(rows, settled)
    taken = open_.join(op.decide(open_, decisions).withColumnRenamed("chosen", "taken"), "conflict_id").where("decided").select("topic", "subject", "taken").distinct()
    return settled.join(taken, ["topic", "subject"], "left").select("topic", "subject", F.when(F.col("taken").isNotNull(), "decision").otherwise(F.col("how")).alias("how"), F.coalesce("taken", "chosen").alias("chosen"))
