"""Calls between services: entry points, steps of a flow, addresses, and imports through barrels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Verbs by which a data layer's methods read and write.
READ_VERBS, WRITE_VERBS = ("get", "find", "list", "load", "read", "fetch", "count"), ("create", "insert", "update", "save", "delete", "remove", "set", "add")
ENTRY_LAYERS, FALLBACK_LAYERS = ("api", "controller", "route"), ("service", "data")


def entry_points(methods: DataFrame) -> DataFrame:
    """Exported methods of the outer layers; a service without any has the first of its fallback layers, one alone."""
    outer = methods.where(F.col("exported") & F.col("layer").isin(*ENTRY_LAYERS)).select("service", "method_id")
    order = F.struct(F.array_position(F.array(*[F.lit(x) for x in FALLBACK_LAYERS]), F.col("layer")).alias("k"), "method_id")
    rest = methods.where(F.col("exported") & F.col("layer").isin(*FALLBACK_LAYERS)).join(outer.select("service").distinct(), "service", "left_anti")
    return outer.unionByName(rest.groupBy("service").agg(F.min_by("method_id", order).alias("method_id")))


def step_kind(same_service: Column, http: Column, layer: Column, name: Column) -> Column:
    """``http`` or ``cross-service`` between services; in the data layer by the method's verb; else a call."""
    starts = lambda verbs: F.lower(name).rlike("^(" + "|".join(verbs) + ")")
    return (
        F.when(~same_service & http, "http").when(~same_service, "cross-service")
        .when((layer == "data") & starts(WRITE_VERBS), "db-write").when((layer == "data") & starts(READ_VERBS), "db-read").otherwise("call")
    )


def address_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of an address: without protocol, port, query and fragment."""
    plain = F.regexp_replace(F.regexp_replace(url, "^[a-z]+://", ""), "[?#].*$", "")
    return F.lower(F.regexp_replace(F.split(plain, "/")[0], ":[0-9]+$", "")), F.concat(F.lit("/"), F.regexp_replace(plain, "^[^/]*/?", ""))


def services_of(urls: DataFrame, services: DataFrame) -> DataFrame:
    """(url, service): the service whose host is the address's or the longest of its endings.

    Each host gives its endings; an equi join finds services by them.
    """
    host, _ = address_parts(F.col("url"))
    labels = F.split(host, r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hit = urls.select("url", F.explode(endings).alias("host")).join(services, "host")
    return hit.groupBy("url").agg(F.max_by("service", F.struct(F.length("host"), "service")).alias("service"))


def through_barrels(imports: DataFrame, reexports: DataFrame) -> DataFrame:
    """(source, target, name): imports of a barrel's names lead to the files that the names come from."""
    named = imports.join(reexports.select(F.col("barrel").alias("target"), "name", F.col("origin")), ["target", "name"], "left")
    return named.select("source", F.coalesce("origin", "target").alias("target"), "name").where("source <> target").distinct()


def worst_per_edge(edges: DataFrame, findings: DataFrame, rank: Column) -> DataFrame:
    """(source, target, worst): the worst severity of the findings at either end of an edge."""
    worst = findings.groupBy("node").agg(F.min(rank).alias("r"))
    a = edges.join(worst.select(F.col("node").alias("source"), F.col("r").alias("a")), "source", "left")
    return a.join(worst.select(F.col("node").alias("target"), F.col("r").alias("b")), "target", "left").select("source", "target", F.least("a", "b").alias("worst"))


def nth_versions(runs: DataFrame, keep: int) -> DataFrame:
    """Runs by age within their branch, and whether they are among the ``keep`` newest."""
    w = W.partitionBy("branch").orderBy(F.desc("created_at"), F.desc("run"))
    return runs.withColumn("age", F.row_number().over(w) - 1).withColumn("kept", F.col("age") < keep)
