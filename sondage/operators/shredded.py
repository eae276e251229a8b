"""The whole merge of claims, over contents shredded to rows of path and value.

A content is a JSON text. Every object and every other value in it is a row:
its path, and either an object's keys or a value's text (arrays are values). What
contents say about each other are joins and counts of these rows: two agree if
no path has two forms; one covers another if none of its keys is missing; a
running union has all keys whose first claim came before. Rows are first made
distinct per path and form, so a subject that very many claims speak of is
counted in many tasks, and what is compared in one is its distinct forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sondage.operators.claims import AUTHORITY, DOMINANCE, GROUP, STATUS, UNSET_STATUS, ranked
from sondage.operators.graph import kept

G = list(GROUP)


def quoted(text: Column) -> Column:
    """A string as JSON writes it."""
    whole = F.to_json(F.struct(text.alias("k")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def canonical(content: Column) -> Column:
    """JSON with its keys in order; what isn't JSON is a string, null is null."""
    return F.when(content.isNull(), "null").otherwise(F.coalesce(F.to_json(F.try_parse_json(content)), quoted(content)))


def richness(canon: Column) -> Column:
    """The number of values that aren't null, in objects and arrays alike, counted in the text without its strings."""
    bare = F.regexp_replace(canon, r'"(?:[^"\\]|\\.)*"', "~")
    return F.regexp_count(bare, F.lit(r"~(?!:)|-?[0-9][0-9.eE+-]*|true|false"))


def active(claims: DataFrame) -> DataFrame:
    """Claims that take part: with content, if any of their group has some; of these the live ones, if there are any.

    Adds canon, print, rank, priority, rich and at (their order). Null topics
    and subjects count as empty.
    """
    rows = claims.select(
        "id", F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("file", F.lit("")).alias("file"),
        F.coalesce("kind", F.lit("definition")).alias("kind"), "status", "touched", canonical(F.nullif(F.trim("content"), F.lit(""))).alias("canon"),
        ranked(F.col("doc_kind"), AUTHORITY, 0).alias("rank"), ranked(F.coalesce("status", F.lit("")), STATUS, UNSET_STATUS).alias("priority"),
    )
    rows = rows.withColumns({
        "at": F.struct("touched", "id"), "rich": richness(F.col("canon")), "print": F.concat_ws("\n", F.coalesce("status", F.lit("")), "canon"),
        "full": ~F.col("canon").isin("null", "{}", "[]"), "live": F.col("status").isNull() | (F.col("status") == "shipped"),
    })
    any_ = rows.groupBy(*G).agg(F.max("full").alias("fulls"), F.max(F.col("full") & F.col("live")).alias("live_fulls"), F.max("live").alias("lives"))
    takes = (F.col("full") | ~F.col("fulls")) & (F.col("live") | ~F.when(F.col("fulls"), F.col("live_fulls")).otherwise(F.col("lives")))
    return rows.join(any_, G).where(takes).drop("full", "live", "fulls", "live_fulls", "lives")


def shred(claims: DataFrame) -> DataFrame:
    """(topic, subject, id, kind, at, path, keys, value): a row per object and per other value; one job per level of nesting."""
    spark = claims.sparkSession
    level = claims.select(*G, "id", "kind", "at", F.array().cast("array<string>").alias("path"), F.col("canon").alias("text"))
    nodes = None
    while True:
        is_object = F.startswith(F.col("text"), F.lit("{"))
        rows = level.select(*G, "id", "kind", "at", "path", F.when(is_object, F.array_sort(F.json_object_keys("text"))).alias("keys"), F.when(~is_object, F.col("text")).alias("value"))
        nodes = rows if nodes is None else nodes.unionByName(rows)
        inner = level.where(is_object & (F.col("text") != "{}")).withColumn("v", F.parse_json("text"))
        level = kept(inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(*G, "id", "kind", "at", F.concat("path", F.array("key")).alias("path"), F.to_json("value").alias("text")))
        if level.isEmpty():
            return nodes


def assemble(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content): the JSON text of each key's rows (path, value; no value: an object), from the deepest level up."""
    rows = kept(nodes.select(*keys, "path", "value", F.size("path").alias("depth")))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    below = None
    for depth in range(deepest, -1, -1):
        here = rows.where(F.col("depth") == depth)
        if below is not None:
            here = here.join(below, [*keys, "path"], "left")
        text = F.coalesce("value", *(["inner"] if below is not None else []), F.lit("{}"))
        if not depth:
            return here.select(*keys, text.alias("content"))
        pair = F.struct(F.element_at("path", -1).alias("key"), text.alias("text"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda p: F.concat(quoted(p["key"]), F.lit(":"), p["text"])), ",")
        below = here.groupBy(*keys, F.slice("path", F.lit(1), F.lit(depth - 1)).alias("path")).agg(F.concat(F.lit("{"), joined, F.lit("}")).alias("inner"))
    raise AssertionError


def _form() -> Column:
    """What a path holds: a value, or an object whatever its keys."""
    return F.coalesce("value", F.lit("{}"))


def disagreeing(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Keys under which some path has two forms."""
    return nodes.select(*by, "path", _form().alias("form")).distinct().groupBy(*by, "path").agg(F.count("*").alias("forms")).where("forms > 1").select(*by).distinct()


def unordered(nodes: DataFrame) -> DataFrame:
    """Groups in which, at some path, a claim's keys and those of all claims before neither hold nor are held by each other."""
    shapes = nodes.where("keys is not null").groupBy(*G, "path", "keys").agg(F.min("at").alias("at"))
    each = shapes.select(*G, "path", "at", F.explode("keys").alias("key"))
    first = each.groupBy(*G, "path", "key").agg(F.min("at").alias("at")).groupBy(*G, "path", "at").agg(F.count("*").alias("new"))
    counted = shapes.select(*G, "path", "at", F.size("keys").alias("size")).join(first, [*G, "path", "at"], "left").fillna(0, ["new"])
    before = F.coalesce(F.sum("new").over(W.partitionBy(*G, "path").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("before", before).where("new > 0 and size - new < before").select(*G).distinct()


def beyond(nodes: DataFrame, winners: DataFrame) -> DataFrame:
    """Groups in which some claim doesn't go with the winner's content: another form, or keys of which neither are all the other's."""
    best = nodes.join(winners.select(*G, "id"), [*G, "id"], "left_semi").select(*G, "path", F.col("keys").alias("k"), _form().alias("f"))
    others = nodes.select(*G, "path", "keys", _form().alias("form")).distinct()
    apart = (F.size(F.array_except("k", "keys")) > 0) & (F.size(F.array_except("keys", "k")) > 0)
    return others.join(best, [*G, "path"]).where((F.col("form") != F.col("f")) | F.coalesce(apart, F.lit(False))).select(*G).distinct()


def last_words(nodes: DataFrame) -> DataFrame:
    """(topic, subject, path, value) of each group's contents written over each other in order.

    A value takes the place of all that stood at or below its path; an object
    goes into the one before it, or takes a value's place. So what a path holds
    is what was written there last, unless a value was written above it later.
    """
    last = nodes.groupBy(*G, "path").agg(F.max(F.when(F.col("value").isNotNull(), F.col("at"))).alias("valued"), F.max("at").alias("at"), F.max_by("value", "at").alias("value"))
    above = last.select(*G, "path", "at", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.size("path")), lambda k: F.slice("path", F.lit(1), k)), lambda p: F.size(p) < F.size("path"))).alias("over"))
    hidden = above.join(last.where("valued is not null").select(*G, F.col("path").alias("over"), "valued"), [*G, "over"]).where("valued > at").select(*G, "path").distinct()
    return last.join(hidden, [*G, "path"], "left_anti").select(*G, "path", "value")


def _facts(rows: DataFrame) -> DataFrame:
    """A row per group: its counts, what all its claims share, and the claims that come first in the several orders.

    Whether they share something is told by its least and its greatest value, as
    counts of distinct ones would take a copy of all rows each. ``open``: the
    group's contents have to be compared.
    """
    claim = F.struct("id", "canon", "status")
    definition = F.col("kind") == "definition"
    first = lambda *order: F.min_by(claim, F.struct(*order, "touched", "id"))
    one = lambda c: F.min(c) == F.max(c)
    counts = F.array(*[F.count_if(F.col("rank") == r) for r in range(max(AUTHORITY.values()) + 1)])
    facts = rows.groupBy(*G).agg(
        F.count("*").alias("n"), one(F.col("canon")).alias("one_content"), one(F.col("file")).alias("one_file"),
        one(F.coalesce("status", F.lit(""))).alias("one_status"), counts.alias("ranks"), first().alias("head"), first(-F.col("priority")).alias("by_status"),
        first(-F.col("rich")).alias("richest"), first(-F.col("rank")).alias("top"), F.max_by(claim, F.struct("rank", "touched", "rich", -F.col("id"))).alias("default"),
        F.count_if(definition).alias("definitions"), F.count_if(F.col("kind") == "constraint").alias("constraints"),
        F.min_by(claim, F.when(definition, F.col("at"))).alias("defined"),
    )
    held = F.filter(F.sequence(F.lit(0), F.size("ranks") - 1), lambda r: F.get("ranks", r) > 0)
    facts = facts.withColumn("open", ~(F.col("one_content") | (F.col("one_file") & (F.col("topic") == "overview"))))
    return facts.withColumn("held", held).withColumn("gap", F.when((F.size("held") > 1) & (F.get("ranks", F.element_at("held", -1)) == 1), F.element_at("held", -1) - F.element_at("held", -2)).otherwise(0)).drop("ranks", "held")


def _digest(contents: DataFrame, by: list[str]) -> DataFrame:
    """(by, conflict_id, candidates): an id of the distinct contents, whatever their order; their digests are summed, not collected."""
    h = F.sha2(F.col("content").cast("binary"), 256)
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(4)]
    summed = contents.select(*by, h.alias("h")).distinct().groupBy(*by).agg(F.count("*").alias("candidates"), *parts)
    return summed.select(*by, F.sha2(F.concat_ws(",", "candidates", *[F.col(f"p{k}").cast("string") for k in range(4)]).cast("binary"), 256).alias("conflict_id"), "candidates")


def merge_claims(claims: DataFrame) -> DataFrame:
    """(topic, subject, how, chosen, content, n, conflict_id, candidates): each group of claims through all passes, in order.

    claims: id (a long, once in its group), topic, subject, file, kind (null: a
    definition), content, status, doc_kind, touched. ``how`` is the first pass
    that settles a group: ``single``; ``identical``; ``status`` (one content);
    ``same-file`` (data by the last word, an overview by the richest claim,
    others if each goes with those before); ``dominance`` (one claim at least
    three ranks above all others, which all go with it); ``superset``;
    ``constrained`` (every constraint folded into every definition, which are
    then one); else ``conflict``, whose ``chosen`` is its default and whose
    content is null. ``n`` claims stand behind a row. An empty table gives an
    empty result.
    """
    rows = kept(active(claims))
    every = kept(_facts(rows))
    facts = every.where("open")
    # groups that their facts settle are neither shredded nor joined
    at_once = (
        F.when(F.col("n") == 1, "single").when(F.col("one_content") & F.col("one_status"), "identical").when(F.col("one_content"), "status").otherwise("same-file")
    )
    done = every.where("not open").withColumn("how", at_once)
    done = done.withColumn("c", F.when(F.col("how") == "status", F.col("by_status")).when(F.col("how") == "same-file", F.col("richest")).otherwise(F.col("head")))
    done = done.select(*G, "how", F.col("c.id").alias("chosen"), F.col("c.canon").alias("content"), "n", F.lit(None).cast("string").alias("conflict_id"), F.lit(None).cast("long").alias("candidates"))
    rows = kept(rows.join(facts.select(*G), G, "left_semi"))
    nodes = kept(shred(rows))
    flag = lambda df, name: df.withColumn(name, F.lit(True))
    apart = disagreeing(nodes, G).unionByName(unordered(nodes)).distinct()
    dominant = facts.where(F.col("gap") >= DOMINANCE).select(*G, "top.id")
    # constraints that agree with each other and with every definition are folded into all of these
    both = facts.where("definitions > 0 and constraints > 0").select(*G)
    here = nodes.join(both, G, "left_semi")
    narrow = kept(here.where("kind = 'constraint'").select(*G, "path", "value", _form().alias("form")).distinct())
    at_odds = here.where("kind = 'definition'").select(*G, "path", _form().alias("f")).distinct().join(narrow, [*G, "path"]).where("f <> form").select(*G).unionByName(disagreeing(narrow, G)).distinct()
    agreed = kept(both.join(at_odds, G, "left_anti"))
    of_definitions = rows.where("kind = 'definition'").join(agreed, G, "left_semi").select(*G, "id", F.coalesce("status", F.lit("")).alias("status"))
    own = here.where("kind = 'definition'").join(agreed, G, "left_semi").select(*G, "id", "path", "value")
    folded = kept(assemble(own.unionByName(of_definitions.select(*G, "id").join(narrow, G).select(*G, "id", "path", "value")).distinct(), [*G, "id"]).join(of_definitions, [*G, "id"]))
    one = folded.groupBy(*G).agg(F.count_distinct("content", "status").alias("folds"), F.min("content").alias("fold"))
    known = (
        facts.join(flag(apart, "apart"), G, "left").join(flag(beyond(nodes, dominant), "beyond"), G, "left").join(one, G, "left")
    )
    covered = F.col("apart").isNull()
    how = (
        F.when(F.col("one_file") & ((F.col("topic") == "data") | covered), "same-file")
        .when((F.col("gap") >= DOMINANCE) & F.col("beyond").isNull(), "dominance")
        .when(F.col("one_status") & covered, "superset").when(F.col("folds") == 1, "constrained").otherwise("conflict")
    )
    settled = kept(known.withColumn("how", how))
    unite = settled.where("how = 'superset' or (how = 'same-file' and topic <> 'data')").select(*G)
    written = settled.where("how = 'same-file' and topic = 'data'").select(*G)
    united = nodes.join(unite, G, "left_semi").select(*G, "path", "value").distinct()
    merged = assemble(united.unionByName(last_words(nodes.join(written, G, "left_semi"))), G)
    # a conflict's candidates are its definitions where the constraints were folded, else all its claims
    open_ = settled.where("how = 'conflict'").select(*G)
    contents = rows.join(open_, G, "left_semi").join(agreed, G, "left_anti").select(*G, F.col("canon").alias("content")).unionByName(folded.join(open_, G, "left_semi").select(*G, "content"))
    chosen = (
        F.when(F.col("how") == "dominance", F.col("top")).when(F.col("how") == "constrained", F.col("defined"))
        .when(F.col("how") == "conflict", F.when(F.col("folds").isNull(), F.col("default"))).otherwise(F.col("head"))
    )
    pick = _defaults(rows.where("kind = 'definition'").join(open_, G, "left_semi").join(agreed, G, "left_semi"), folded)
    out = settled.withColumn("c", chosen).join(merged, G, "left").join(_digest(contents, G), G, "left").join(pick, G, "left")
    content = F.when(F.col("how") == "constrained", F.col("fold")).when(F.col("how") != "conflict", F.coalesce("content", "c.canon"))
    return done.unionByName(out.select(*G, "how", F.coalesce("pick", "c.id").alias("chosen"), content.alias("content"), "n", "conflict_id", "candidates"))


def _defaults(definitions: DataFrame, folded: DataFrame) -> DataFrame:
    """(topic, subject, pick): the default among definitions that constraints were folded into."""
    rows = definitions.select(*G, "id", "rank", "touched").join(folded.select(*G, "id", "content"), [*G, "id"])
    return rows.groupBy(*G).agg(F.max_by("id", F.struct("rank", "touched", richness(F.col("content")).alias("rich"), -F.col("id"))).alias("pick"))


def merge_sources(claims: DataFrame, merged: DataFrame) -> DataFrame:
    """(topic, subject, id, file): the claims that stand behind each row of ``merged``, one row each."""
    return active(claims).join(merged.select(*G), G, "left_semi").select(*G, "id", "file")


def decided(merged: DataFrame, decisions: DataFrame) -> DataFrame:
    """``merged`` with ``how`` = ``decided`` and the picked claim where a decision (conflict_id, picked, resolved_at) was taken; the last one counts."""
    last = decisions.groupBy("conflict_id").agg(F.max_by("picked", "resolved_at").alias("picked"))
    out = merged.join(last, "conflict_id", "left")
    taken = F.col("picked").isNotNull()
    return out.withColumn("how", F.when(taken, "decided").otherwise(F.col("how"))).withColumn("chosen", F.when(taken, F.col("picked")).otherwise(F.col("chosen"))).drop("picked").select(*merged.columns)
