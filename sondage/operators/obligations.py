"""Further comparators of contracts with code, inference, and checks of the contracts themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sondage.functions.scalars import entropy

#: What a contract of each kind must hold to be complete.
NEEDED = {"Enum": ("values",), "StateMachine": ("states", "transitions"), "QueryRule": ("predicates",), "Operation": ("method", "path")}


def missing_envelopes(responses: DataFrame, status_class: str, field: str = "error") -> DataFrame:
    """Responses of a status class that lack the envelope's field; ``4xx`` stands for 400 to 499."""
    pattern = "^" + status_class.replace("x", "[0-9]") + "$"
    return responses.where(F.col("status").cast("string").rlike(pattern) & ~F.array_contains("fields", field))


def pagination_drifts(handlers: DataFrame, forbidden: tuple[str, ...]) -> DataFrame:
    """(operation, drift, parameter): forbidden parameters in use, and limits that aren't clamped."""
    used = handlers.select("operation", F.explode(F.array_intersect("parameters", F.array(*[F.lit(p) for p in forbidden]))).alias("parameter")).select("operation", F.lit("forbidden-parameter").alias("drift"), "parameter")
    loose = handlers.where(F.array_contains("parameters", "limit") & ~F.col("clamped")).select("operation", F.lit("limit-not-clamped").alias("drift"), F.lit("limit").alias("parameter"))
    return used.unionByName(loose)


def forbidden_artifacts(rules: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, name): environment variables, dependencies and flags that are there and must not be."""
    return rules.join(found.select("kind", "name").distinct(), ["kind", "name"], "left_semi")


def effect_drifts(expected: DataFrame, emitted: DataFrame) -> DataFrame:
    """(operation, effect): effects that no branch emits, unless an operation emits one that isn't known beforehand."""
    dynamic = emitted.where("effect is null").select("operation").distinct()
    return expected.join(emitted.where("effect is not null").select("operation", "effect").distinct(), ["operation", "effect"], "left_anti").join(dynamic, "operation", "left_anti")


def conditions(spec: DataFrame, code: DataFrame) -> DataFrame:
    """(target, drift): rules that aren't enforced, or enforced with another effect or on another condition.

    One target may be enforced in several places; the best of them counts.
    """
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    s = spec.select("target", norm(F.col("target")).alias("k"), F.col("effect").alias("e"), F.col("condition").alias("c"))
    got = code.select(norm(F.col("target")).alias("k"), "effect", "condition")
    rank = F.when(F.col("effect").isNull(), 3).when(F.col("effect") != F.col("e"), 2).when(~F.col("condition").eqNullSafe(F.col("c")), 1).otherwise(0)
    best = s.join(got, "k", "left").groupBy("target", "k", "e", "c").agg(F.min(rank).alias("r"))
    return best.where("r > 0").select("target", F.element_at(F.array(F.lit("condition-mismatch"), F.lit("effect-mismatch"), F.lit("not-enforced")), F.col("r")).alias("drift"))


def defaults(spec: DataFrame, code: DataFrame) -> DataFrame:
    """(field, drift): fallbacks that aren't applied or have another default."""
    got = code.groupBy("field").agg(F.collect_set("value").alias("have"))
    drift = F.when(F.col("have").isNull(), "not-applied").when(~F.array_contains("have", F.col("value")), "default-mismatch")
    return spec.join(got, "field", "left").select("field", drift.alias("drift")).where("drift is not null")


def choices(decisions: DataFrame, observed: DataFrame) -> DataFrame:
    """(topic, drift): a decision that nothing bears out, or another choice seen; nothing seen at all is inconclusive."""
    seen = observed.groupBy("topic").agg(F.collect_set("choice").alias("seen"))
    other = F.size(F.array_except("seen", F.array("chosen"))) > 0
    drift = F.when(F.col("seen").isNull(), "inconclusive").when(~F.array_contains("seen", F.col("chosen")), "chosen-unmet").when(other, "other-choice")
    return decisions.join(seen, "topic", "left").select("topic", drift.alias("drift")).where("drift is not null")


def inferred(facts: DataFrame, covered: DataFrame, key: Column) -> DataFrame:
    """Facts in code that no contract covers, one per kind and normalised key."""
    named = facts.withColumn("key", key)
    return named.join(covered.select("kind", "key").distinct(), ["kind", "key"], "left_anti").groupBy("kind", "key").agg(F.min("name").alias("name"), F.count("*").alias("n"))


def incomplete(contracts: DataFrame) -> DataFrame:
    """(kind, identity, field): what a contract of its kind should hold and doesn't."""
    needed = F.create_map(*[x for k, v in NEEDED.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))])
    lack = F.array_except(F.coalesce(F.try_element_at(needed, F.col("kind")), F.array().cast("array<string>")), "fields")
    return contracts.select("kind", "identity", F.explode(lack).alias("field"))


def tagged(operations: DataFrame, tags: DataFrame) -> DataFrame:
    """Operations with their own tags and those of every contract that selects their group, sorted."""
    more = tags.groupBy("group").agg(F.collect_set("tag").alias("more"))
    return operations.join(more, "group", "left").select("operation", F.array_sort(F.array_distinct(F.concat("tags", F.coalesce("more", F.array().cast("array<string>"))))).alias("tags"))


def cache_plan(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """(id, action): blocks to extract, to take from the cache, and to remove from it."""
    j = wanted.select("id", F.lit(True).alias("w")).join(cached.select("id", F.lit(True).alias("c")), "id", "full_outer")
    return j.select("id", F.when(F.col("c").isNull(), "extract").when(F.col("w").isNull(), "remove").otherwise("reuse").alias("action"))


def cycle_kinds(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """(cycle, kind): type-only if each edge is, dynamic if any is, else static."""
    steps = cycles.select("cycle", F.posexplode("path").alias("k", "source"), "path").withColumn("target", F.element_at(F.concat("path", F.array(F.element_at("path", 1))), F.col("k") + 2))
    joined = steps.join(edges.groupBy("source", "target").agg(F.bool_and("type_only").alias("t"), F.bool_or("dynamic").alias("d")), ["source", "target"])
    kind = F.when(F.bool_and("t"), "type-only").when(F.bool_or("d"), "dynamic").otherwise("static")
    return joined.groupBy("cycle").agg(kind.alias("kind"))


def secret_literals(literals: DataFrame, stopwords: DataFrame, least_bits: float = 3.5, least_length: int = 16) -> DataFrame:
    """Literals long and disordered enough to be secrets that hold no stopword as a part between signs."""
    found = literals.where(F.length("value") >= least_length).withColumn("bits", F.round(entropy(F.col("value")), 6)).where(F.col("bits") >= least_bits)
    parts = found.select("id", F.explode(F.split(F.lower("value"), "[^a-z0-9]+")).alias("word")).join(stopwords, "word", "left_semi").select("id").distinct()
    return found.join(parts, "id", "left_anti")
