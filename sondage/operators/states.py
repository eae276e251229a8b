"""States of a repository at a run: pages with totals, active findings, graphs, diffs; and lookups beside the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sondage.operators import findings as found

#: By which verbs a method's name tells the call that it makes.
VERBS = (
    ("GET", ("get", "find", "fetch", "list", "load", "read", "search", "query")), ("POST", ("create", "add", "insert", "save", "register", "post")),
    ("PUT", ("update", "put", "replace", "set", "modify")), ("PATCH", ("update", "patch", "modify")), ("DELETE", ("delete", "remove", "destroy", "drop")),
)
ONE, MANY = "byid|one|single|byname|byemail|byslug|specific", "all|list|many|multiple|every|batch"
#: Column types of schema languages, by simple name.
TYPES = {
    "integer": "int", "int": "int", "serial": "int", "smallint": "int", "bigint": "bigint", "bigserial": "bigint", "biginteger": "bigint", "float": "float", "real": "float", "doubleprecision": "float", "numeric": "decimal",
    "decimal": "decimal", "string": "string", "text": "string", "varchar": "string", "char": "string", "unicode": "string", "boolean": "boolean", "bool": "boolean", "date": "date", "datetime": "datetime", "timestamp": "datetime",
    "time": "time", "json": "json", "jsonb": "json", "uuid": "uuid", "largebinary": "bytes", "bytea": "bytes", "enum": "enum", "pgenum": "enum",
}


def page(rows: DataFrame, limit: int, offset: int = 0, *order) -> DataFrame:
    """A page of ordered rows, each with ``total``, the number of all rows before paging; a limit of 0 gives all."""
    total = rows.agg(F.count("*").alias("total"))
    ordered = rows.orderBy(*order)
    shown = ordered if limit <= 0 else (ordered.offset(offset) if offset else ordered).limit(limit)
    return shown.join(F.broadcast(total))  # one row


def active_set(latest: DataFrame, added: DataFrame | None = None, resolved: DataFrame | None = None, log: DataFrame | None = None, run: int | None = None) -> DataFrame:
    """The ids that are active: in the latest state, after a diff on top of it, or after a run in the past."""
    if log is not None and run is not None:
        return found.replay(log, run).select("id")
    if added is not None:
        gone = latest.select("id") if resolved is None else latest.join(resolved.select("id").distinct(), "id", "left_anti").select("id")
        return gone.unionByName(added.select("id")).distinct()
    return latest.select("id")


def resolved_graph(graphs: DataFrame, run: Column | None = None) -> DataFrame:
    """The graph of a run, or, where none is named, of the latest there is; graphs are partitioned by run."""
    if run is not None:
        return graphs.where(F.col("run") == run)
    last = graphs.agg(F.max("run").alias("last"))
    return graphs.join(F.broadcast(last), F.col("run") == F.col("last"), "left_semi")


def diff_result(diff: DataFrame, disabled: DataFrame, runs: DataFrame) -> DataFrame:
    """(change, severity, n, stale): a stored diff without disabled rules, counted anew; stale if a newer run is there.

    diff: base_run, change, rule_key, severity.
    """
    newest = runs.agg(F.max("run").alias("newest"))
    kept = found.enabled(diff, disabled).join(F.broadcast(newest))  # one row
    return kept.groupBy("change", "severity").agg(F.count("*").alias("n"), F.max(F.col("base_run") != F.col("newest")).alias("stale"))


def method_calls(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """(service, module, method, call_id, how): the call to another service that a method makes.

    Exact by method; else the module's only call; else, of the calls with the
    verb that the method's name begins with, the only one; else by whether the
    name speaks of one or of many, matching addresses with or without a
    parameter; else the first of them. calls: service, module, method, call_id, verb, url.
    """
    key = ["service", "module"]
    exact = calls.groupBy(*key, "method").agg(F.min("call_id").alias("exact"))
    per = calls.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("call_id", "verb", "url"))).alias("calls"))
    low, verb = F.lower("method"), F.lit(None).cast("string")
    for name, starts in reversed(VERBS):
        verb = F.when(low.rlike("^(" + "|".join(starts) + ")"), F.lit(name)).otherwise(verb)
    j = methods.select(*key, "method").distinct().join(exact, [*key, "method"], "left").join(per, key, "left").withColumn("verb", verb)
    fit = F.filter("calls", lambda c: c["verb"] == F.col("verb"))
    param = lambda c: c["url"].rlike("(?i):[a-z]")
    one, many = low.rlike(ONE), low.rlike(MANY)
    told = F.filter(fit, lambda c: (one & param(c)) | (many & ~param(c)))
    n = F.coalesce(F.size("calls"), F.lit(0))
    first = lambda xs: F.get(xs, F.lit(0))["call_id"]
    how = F.when(F.col("exact").isNotNull(), "exact").when(n == 1, "only").when(F.size(fit) == 1, "verb").when((F.size(fit) > 1) & (F.size(told) > 0), "number").when(F.size(fit) > 1, "first")
    call = F.when(F.col("exact").isNotNull(), F.col("exact")).when(n == 1, first(F.col("calls"))).when(F.size(told) > 0, first(told)).otherwise(first(fit))
    return j.select(*key, "method", call.alias("call_id"), how.alias("how")).where("how is not null")


def flows_not_reached(flows: DataFrame, steps: DataFrame) -> DataFrame:
    """Flows whose entry no other service's flow calls by http: the others are parts of those."""
    reached = steps.where("kind = 'http' and target_service <> entry_service").select(F.col("target_service").alias("service"), F.col("target").alias("entry")).distinct()
    return flows.join(reached, ["service", "entry"], "left_anti")


def delegations(flows: DataFrame, steps: DataFrame) -> DataFrame:
    """(entry, merged_into): flows whose first call is to another flow's entry of the same service; else null.

    A flow that is itself merged away takes none in. steps: entry, position (from 1, the trigger), source_service, target_service, target.
    """
    first = steps.where("position > 1").groupBy("entry").agg(F.min_by(F.struct("source_service", "target_service", "target"), "position").alias("s"))
    into = first.where("s.source_service = s.target_service and s.target <> entry").select("entry", F.col("s.target").alias("target"))
    into = into.join(flows.select(F.col("entry").alias("target")), "target", "left_semi")
    chained = into.select(F.col("entry").alias("target")).distinct()
    final = into.join(chained, "target", "left_anti")
    return flows.select("entry").join(final, "entry", "left").select("entry", F.col("target").alias("merged_into"))


def file_filter(has_async: bool | None = None, has_routes: bool | None = None, imports_from: tuple[str, ...] = (), calls_to: tuple[str, ...] = (), test_file: bool | None = None, languages: tuple[str, ...] = (), has_catch: bool | None = None, database_packages: tuple[str, ...] = (), has_database: bool | None = None) -> Column:
    """Whether a file's facts fit what a check wants to see: columns functions, routes, imports, calls, is_test, language, text."""
    out = F.lit(True)
    if has_async is not None:
        out = out & (F.exists("functions", lambda f: f["is_async"]) == F.lit(has_async))
    if has_routes is not None:
        out = out & ((F.size("routes") > 0) == F.lit(has_routes))
    if has_database is not None:
        out = out & (F.arrays_overlap("imports", F.array(*[F.lit(p) for p in database_packages])) == F.lit(has_database))
    if has_catch is not None:
        out = out & (F.coalesce(F.col("text").rlike(r"\bcatch\s*\("), F.lit(False)) == F.lit(has_catch))
    for column, parts in (("imports", imports_from), ("calls", calls_to)):
        if parts:
            out = out & F.exists(column, _holds_any(parts))
    if test_file is not None:
        out = out & (F.col("is_test") == F.lit(test_file))
    return out & F.col("language").isin(*languages) if languages else out


def _holds_any(parts: tuple[str, ...]):
    return lambda x: F.greatest(F.lit(False), *[F.contains(x, F.lit(p)) for p in parts])


def function_filter(is_async: bool | None = None, is_handler: bool | None = None, least_params: int | None = None, names: tuple[str, ...] = ()) -> Column:
    """Whether a function's facts fit what a check wants to see: columns name, is_async, is_handler, params."""
    out = F.lit(True)
    if is_async is not None:
        out = out & (F.col("is_async") == F.lit(is_async))
    if is_handler is not None:
        out = out & (F.col("is_handler") == F.lit(is_handler))
    if least_params is not None:
        out = out & (F.size("params") >= least_params)
    return out & _holds_any(names)(F.col("name")) if names else out


def unused_exports(exports: DataFrame, uses: DataFrame) -> DataFrame:
    """(file, name): exports whose name no other file's use holds, as a part of it even.

    A name meets only uses that hold the rarest of its stretches of three
    letters (of fewer, where it is shorter), by counts over all uses: what
    thousands of names begin with, such as ``get``, brings none together. A
    name with a stretch that no use holds meets none.
    """
    stretches = lambda c, k: F.explode(F.array_distinct(F.expr(f"transform(sequence(1, length({c}) - {k - 1}), i -> substring({c}, i, {k}))"))).alias("gram")
    grams = lambda rows, c: [rows.where(F.length(c) >= k).select("*", F.lit(k).alias("n"), stretches(c, k)) for k in (1, 2, 3)]
    held = uses.select(F.col("file").alias("user"), "used").distinct()
    all_held = grams(held, "used")
    all_held = all_held[0].unionByName(all_held[1]).unionByName(all_held[2])
    names = exports.where("name <> ''").select("name").distinct()
    own = grams(names, "name")
    own = own[0].where(F.length("name") == 1).unionByName(own[1].where(F.length("name") == 2)).unionByName(own[2])
    counted = own.join(all_held.groupBy("n", "gram").agg(F.count("*").alias("uses")), ["n", "gram"], "left").fillna(0, ["uses"])
    rarest = counted.groupBy("name").agg(F.min_by(F.struct("n", "gram", "uses"), F.struct("uses", "gram")).alias("r")).where("r.uses > 0").select("name", "r.n", "r.gram")
    hit = exports.select("file", "name").join(rarest, "name").join(all_held, ["n", "gram"]).where((F.col("user") != F.col("file")) & F.contains("used", F.col("name"))).select("file", "name").distinct()
    return exports.where("name <> ''").join(hit, ["file", "name"], "left_anti").select("file", "name")


def resolve_columns(uses: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Uses (use_id, table, column) with the schema's table and type: tables go by name or alias, in any case."""
    known = tables.select(F.lower("name").alias("k"), F.col("name").alias("schema_table")).unionByName(tables.where("alias is not null").select(F.lower("alias").alias("k"), F.col("name").alias("schema_table"))).distinct()
    typed = columns.select(F.col("table").alias("schema_table"), F.col("column"), simple_type(F.col("type")).alias("type"))
    return uses.withColumn("k", F.lower("table")).join(known, "k").join(typed, ["schema_table", "column"], "left").select("use_id", "schema_table", "column", "type")


def simple_type(name: Column) -> Column:
    """A schema language's column type by its simple name; without its length; an unknown one stays as it is."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(name, r"\(.*$", "")), r"[^a-z]", "")
    table = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, plain), F.lower(name))


def exempt_cycles(cycles: DataFrame, models: DataFrame, edges: DataFrame) -> DataFrame:
    """Cycles (cycle, path) that count: neither all of models, nor with an edge that is made at run time."""
    steps = cycles.select("cycle", "path", F.posexplode("path").alias("k", "source")).withColumn("target", F.element_at(F.concat("path", F.array(F.element_at("path", 1))), F.col("k") + 2))
    is_model = models.select(F.col("node").alias("source")).distinct().withColumn("model", F.lit(True))
    late = edges.groupBy("source", "target").agg(F.bool_or("dynamic").alias("late"))
    told = steps.join(is_model, "source", "left").join(late, ["source", "target"], "left").groupBy("cycle").agg(F.bool_and(F.coalesce("model", F.lit(False))).alias("all_models"), F.bool_or(F.coalesce("late", F.lit(False))).alias("late"))
    return told.where("not all_models and not late").select("cycle")


def services_of_files(files: DataFrame, manifests: tuple[str, ...] = ("package.json", "pyproject.toml", "go.mod", "pom.xml")) -> DataFrame:
    """(path, service): a file's nearest directory above it with a manifest; without any, the root, an empty name."""
    parts = F.split("path", "/")
    base = F.element_at(parts, -1)
    roots = files.where(base.isin(*manifests)).select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("above")).distinct()
    above = F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    near = files.select("path", above.alias("above")).join(roots, "above").groupBy("path").agg(F.max_by("above", F.length("above")).alias("service"))
    return files.select("path").join(near, "path", "left").select("path", F.coalesce("service", F.lit("")).alias("service"))
