"""Contract comparison: documented facts against code facts, as joins that emit drifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sondage.functions.scalars import overlap

ENUM_OVERLAP, ENUM_GAP = 0.6, 2


def compare_operations(spec: DataFrame, code: DataFrame) -> DataFrame:
    """(operation, drift): operations that one side alone has; planned or deferred ones may be missing."""
    joined = spec.select("operation", "spec_status").join(code.select("operation").distinct().withColumn("here", F.lit(True)), "operation", "full_outer")
    missing = F.col("here").isNull() & ~F.coalesce("spec_status", F.lit("")).isin("planned", "deferred", "out-of-scope")
    unwanted = F.col("here") & F.coalesce("spec_status", F.lit("")).isin("out-of-scope", "deprecated")
    drift = F.when(missing, "operation-missing").when(unwanted, "operation-unwanted").when(F.col("spec_status").isNull(), "operation-undocumented")
    return joined.select("operation", drift.alias("drift")).where("drift is not null")


def corpus_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, side, missing): keys of one side, and what the left's arrays have that the right's lack."""
    j = left.select("key", F.col("items").alias("a")).join(right.select("key", F.col("items").alias("b")), "key", "full_outer")
    side = F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").otherwise("both")
    return j.select("key", side.alias("side"), F.size(F.array_except("a", "b")).alias("missing"))


def coverage(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, ratio): the share of a key's obligations that the other side has; 1 where there are none."""
    rows = left.select("key", F.explode_outer("items").alias("o"))
    got = right.select("key", F.explode("items").alias("o")).distinct().withColumn("m", F.lit(1))
    return rows.join(got, ["key", "o"], "left").groupBy("key").agg(F.count("o").alias("n"), F.count(F.when(F.col("o").isNotNull(), F.col("m"))).alias("k")).select("key", F.when(F.col("n") == 0, 1.0).otherwise(F.round(F.col("k") / F.col("n"), 6)).alias("ratio"))


def layered(primary: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """The primary layer, and the base's rows for keys it doesn't have."""
    return primary.unionByName(base.join(primary.select(key).distinct(), key, "left_anti").select(*primary.columns))


def dangling(refs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """References without a target, neither as they are nor without their last ``.field``."""
    known = artifacts.select(F.col("identity").alias("ref")).distinct()
    parent = refs.join(known, "ref", "left_anti").withColumn("parent", F.regexp_replace("ref", r"\.[^.]*$", ""))
    return parent.join(known.withColumnRenamed("ref", "parent"), "parent", "left_anti").select("ref")


def match_enums(spec: DataFrame, code: DataFrame) -> DataFrame:
    """(name, code_name, overlap): by name, else the most similar values of those that share one.

    Values are exploded to an equi join, so that no pair without a common value
    is ever made; the best has overlap, then the least name. Two or fewer
    values must agree in full.
    """
    named = spec.join(code, F.col("name") == F.col("code_name")).select("name", "code_name", overlap(F.col("values"), F.col("code_values")).alias("overlap"))
    rest = spec.join(named.select("name").distinct(), "name", "left_anti")
    pairs = rest.select("name", "values", F.explode("values").alias("v")).join(code.select("code_name", "code_values", F.explode("code_values").alias("v")), "v").select("name", "code_name", "values", "code_values").distinct()
    share = overlap(F.col("values"), F.col("code_values"))
    fits = (share >= ENUM_OVERLAP) & (F.abs(F.size("values") - F.size("code_values")) <= ENUM_GAP) & ((F.size("values") >= 3) | (share == 1.0))
    scored = pairs.withColumn("overlap", share).where(fits)
    best = scored.groupBy("name").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "code_name")).alias("b")).select("name", "b.code_name", (-F.col("b.o")).alias("overlap"))
    return named.unionByName(best)


def compare_enums(spec: DataFrame, code: DataFrame, matched: DataFrame) -> DataFrame:
    """(name, drift, value): values that one side lacks, and enums without a counterpart."""
    j = spec.join(matched.select("name", "code_name"), "name", "left").join(code, "code_name", "left")
    gone = F.transform(F.array_except("values", "code_values"), lambda v: F.struct(F.lit("missing-value").alias("drift"), v.alias("value")))
    more = F.transform(F.array_except("code_values", "values"), lambda v: F.struct(F.lit("extra-value").alias("drift"), v.alias("value")))
    none = F.array(F.struct(F.lit("no-code-counterpart").alias("drift"), F.lit(None).cast("string").alias("value")))
    return j.select("name", F.explode(F.when(F.col("code_name").isNull(), none).otherwise(F.concat(gone, more))).alias("d")).select("name", "d.drift", "d.value")


def compare_transitions(spec: DataFrame, code: DataFrame, terminal: Column) -> DataFrame:
    """(entity, from, to, drift): transitions that the documents don't have; leaving an end state is a regression."""
    extra = code.join(spec, ["entity", "from", "to"], "left_anti")
    return extra.select("entity", "from", "to", F.when(terminal, "illegal-regression").otherwise("undocumented-transition").alias("drift"))


def compare_predicates(required: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, column, drift): required predicates that no query has, or that have other values.

    Lists of values are compared as sets.
    """
    as_set = F.array_sort(F.array_distinct("values"))
    want = required.select("entity", "column", "kind", as_set.alias("want"))
    have = found.select("entity", "column", "kind", as_set.alias("have")).groupBy("entity", "column", "kind").agg(F.collect_set("have").alias("haves"))
    j = want.join(have, ["entity", "column", "kind"], "left")
    drift = F.when(F.col("haves").isNull(), "predicate-missing").when(~F.array_contains("haves", F.col("want")), "value-mismatch")
    return j.select("entity", "column", drift.alias("drift")).where("drift is not null")


def consensus(queries: DataFrame, least: int = 2) -> DataFrame:
    """(table, predicate): predicates that every query of a table has, for tables with enough queries."""
    sizes = queries.groupBy("table").agg(F.countDistinct("query_id").alias("n")).where(F.col("n") >= least)
    per = queries.groupBy("table", "predicate").agg(F.countDistinct("query_id").alias("k"))
    return per.join(sizes, "table").where("k = n").select("table", "predicate", F.col("n").alias("queries"))


def date_range_columns(predicates: DataFrame) -> DataFrame:
    """Columns that a query binds from below and from above."""
    low, high = F.col("op").isin("gt", "gte"), F.col("op").isin("lt", "lte")
    return predicates.groupBy("query_id", "column").agg(F.bool_or(low).alias("a"), F.bool_or(high).alias("b")).where("a and b").select("query_id", "column")


def unprotected(operations: DataFrame, protected: DataFrame, selected: Column) -> DataFrame:
    """Selected operations whose file isn't protected: for authorization and for idempotency."""
    return operations.where(selected).join(protected.select("file").distinct(), "file", "left_anti")


def missing_channels(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(field, drift, channels): fields exposed nowhere, or not on every expected channel."""
    got = found.groupBy("field").agg(F.collect_set("channel").alias("got"))
    j = expected.join(got, "field", "left").withColumn("lack", F.array_sort(F.array_except("channels", F.coalesce("got", F.array().cast("array<string>")))))
    return j.where(F.size("lack") > 0).select("field", F.when(F.col("got").isNull(), "not-exposed").otherwise("channel-missing").alias("drift"), F.array_join("lack", ",").alias("lack"))


def compare_constants(spec: DataFrame, code: DataFrame) -> DataFrame:
    """(name, stage, drift): by equal key, else by the last dotted part; a value that differs or no counterpart."""
    key = F.regexp_replace(F.lower("name"), "[^a-z0-9.]", "")
    last = F.element_at(F.split(key, r"\."), -1)
    s = spec.select("name", F.col("value").alias("want"), key.alias("key"), last.alias("last"))
    c = code.select(key.alias("key"), last.alias("last"), F.col("value").alias("have"))
    by_key = s.join(c.groupBy("key").agg(F.collect_set("have").alias("h0")), "key", "left")
    both = by_key.join(c.groupBy("last").agg(F.collect_set("have").alias("h1")), "last", "left")
    have = F.coalesce("h0", "h1")
    drift = F.when(have.isNull(), "no-code-counterpart").when(~F.array_contains(have, F.col("want")), "value-mismatch")
    return both.select("name", F.when(F.col("h0").isNotNull(), 0).when(F.col("h1").isNotNull(), 1).alias("stage"), drift.alias("drift")).where("drift is not null")
