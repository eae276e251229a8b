"""Consolidation of documented claims: passes that settle a group, conflicts, chains, modules, fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: The authority of document kinds, and the order in which a claim's status counts.
AUTHORITY = {"adr": 4, "rfc": 4, "prd": 3, "spec": 3, "design-note": 2, "runbook": 2, "readme": 1}
STATUS = {"shipped": 4, "deferred": 2, "out-of-scope": 1, "deprecated": 0}
UNSET_STATUS, DOMINANCE = 3, 3
GROUP = ("topic", "subject")


def ranked(column: Column, table: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, rank in table.items():
        out = F.when(column == name, rank).otherwise(out)
    return out


def fingerprint(content: Column, status: Column) -> Column:
    return F.sha2(F.concat(content, F.lit("\x1f"), F.coalesce(status, F.lit(""))).cast("binary"), 256)


def without_empty(claims: DataFrame) -> DataFrame:
    """Claims with content; all of a group's claims where none has any."""
    full = F.coalesce(F.trim("content") != "", F.lit(False))
    return claims.withColumn("__full", full).withColumn("__any", F.max("__full").over(W.partitionBy(*GROUP))).where("__full or not __any").drop("__full", "__any")


def live(claims: DataFrame) -> DataFrame:
    """Shipped claims and those without status, where a group has any; else all of it."""
    alive = F.col("status").isNull() | (F.col("status") == "shipped")
    return claims.withColumn("__live", alive).withColumn("__any", F.max("__live").over(W.partitionBy(*GROUP))).where("__live or not __any").drop("__live", "__any")


def settle(claims: DataFrame) -> DataFrame:
    """One row per group: how it is settled and by which claim.

    ``identical``: one content and status; ``status``: one content, the status
    of highest priority counts; ``dominance``: one document kind alone is at
    least three ranks above every other claim; else ``conflict``, whose default
    is the claim of most authority, then the latest, the longest, the least id.
    Each group needs its counts and best rows only, so one aggregation serves.
    """
    rank = ranked(F.col("doc_kind"), AUTHORITY, 0)
    priority = ranked(F.coalesce("status", F.lit("")), STATUS, UNSET_STATUS)
    first = F.struct((-rank).alias("r"), (-F.unix_seconds(F.col("touched").cast("timestamp"))).alias("t"), (-F.length("content")).alias("l"), "id")
    kept = F.struct((-priority).alias("p"), (-F.unix_seconds(F.col("touched").cast("timestamp"))).alias("t"), "id")
    out = claims.groupBy(*GROUP).agg(
        F.count("*").alias("n"), F.countDistinct(fingerprint(F.col("content"), F.col("status"))).alias("prints"), F.countDistinct("content").alias("contents"),
        F.min(first).alias("first"), F.min(kept).alias("kept"), F.max(rank).alias("top"), F.max_by("content", F.struct(rank, "id")).alias("c"),
        F.array_sort(F.collect_set(rank)).alias("ranks"),
    )
    tops = claims.select(*GROUP, rank.alias("rank")).groupBy(*GROUP, "rank").agg(F.count("*").alias("k")).groupBy(*GROUP).agg(F.max_by("k", "rank").alias("at_top"))
    gap = F.when(F.size("ranks") > 1, F.element_at("ranks", -1) - F.element_at("ranks", -2))
    how = (
        F.when(F.col("prints") == 1, "identical").when(F.col("contents") == 1, "status")
        .when((F.col("at_top") == 1) & (gap >= DOMINANCE), "dominance").otherwise("conflict")
    )
    chosen = F.when(F.col("contents") == 1, F.col("kept.id")).otherwise(F.col("first.id"))
    return out.join(tops, list(GROUP)).select(*GROUP, "n", how.alias("how"), chosen.alias("chosen"))


def conflicts(claims: DataFrame, settled: DataFrame) -> DataFrame:
    """(conflict_id, candidates, chosen): the id depends on the candidates' contents alone, not on their order."""
    open_ = claims.join(settled.where("how = 'conflict'").select(*GROUP, "chosen"), list(GROUP))
    prints = F.array_sort(F.collect_set(F.sha2(F.col("content").cast("binary"), 256)))
    return open_.groupBy(*GROUP, "chosen").agg(F.sha2(F.array_join(prints, ",").cast("binary"), 256).alias("conflict_id"), F.countDistinct("content").alias("candidates"))


def decide(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Conflicts with the decision that was taken for them, or their default."""
    last = decisions.groupBy("conflict_id").agg(F.max_by("picked", "resolved_at").alias("picked"))
    return conflicts.join(last, "conflict_id", "left").select("conflict_id", F.coalesce("picked", "chosen").alias("chosen"), F.col("picked").isNotNull().alias("decided"))


def version_chains(docs: DataFrame) -> DataFrame:
    """(older, newer): documents of one directory and prefix with successive version numbers.

    A window over the few versions of one document, instead of all pairs.
    """
    parts = docs.select("path", F.regexp_extract("path", r"^(.*?)[-_.]?v(\d+)\.\w+$", 1).alias("prefix"), F.regexp_extract("path", r"^(.*?)[-_.]?v(\d+)\.\w+$", 2).alias("v")).where("v <> ''")
    w = W.partitionBy("prefix").orderBy(F.col("v").cast("int"), "path")
    return parts.select(F.col("path").alias("older"), F.lead("path").over(w).alias("newer")).where("newer is not null")


def superseded(claims: DataFrame, chains: DataFrame) -> DataFrame:
    """Claims of documents that no newer version replaces."""
    return claims.join(chains.select(F.col("older").alias("file")).distinct(), "file", "left_anti")


def attribute(claims: DataFrame, modules: DataFrame) -> DataFrame:
    """(id, module): the module whose tokens a claim shares most, ties by name, else ``_shared``."""
    words = claims.select("id", F.explode(F.array_distinct(F.filter(F.split(F.lower("content"), "[^a-z0-9]+"), lambda w: F.length(w) > 2))).alias("w"))
    hits = words.join(modules.select("module", F.explode("tokens").alias("w")), "w").groupBy("id", "module").agg(F.count("*").alias("n"))
    best = hits.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "module")).alias("b")).select("id", "b.module")
    return claims.select("id").join(best, "id", "left").select("id", F.coalesce("module", F.lit("_shared")).alias("module"))


def merge_fragments(fragments: DataFrame) -> DataFrame:
    """(kind, identity, chosen, clashing): the fragment of highest rank, then specificity, then first.

    ``clashing`` counts other bodies of the same rank.
    """
    order = F.struct((-F.col("rank")).alias("r"), (-F.col("specificity")).alias("s"), "ordinal")
    best = fragments.groupBy("kind", "identity").agg(F.min_by("ordinal", order).alias("chosen"), F.min_by("body", order).alias("body"), F.max("rank").alias("rank"))
    same = fragments.select("kind", "identity", "rank", F.col("body").alias("other")).distinct()
    return best.join(same, ["kind", "identity", "rank"]).groupBy("kind", "identity", "chosen").agg(F.count_if(F.col("other") != F.col("body")).alias("clashing"))


def slices(claims: DataFrame) -> DataFrame:
    """(module, topic, n, hash): what a slice holds, in order of id, and its cache key."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("id", "content"))), lambda x: x["content"])
    return claims.groupBy("module", "topic").agg(F.count("*").alias("n"), F.sha2(F.array_join(ordered, "\n").cast("binary"), 256).alias("hash"))
