"""Queries of the replayed trend and of ignore rules."""

from __future__ import annotations

from sondage.operators import ignoring, trends
from sondage.registry import query
from sondage.sources import projection as P

#: What one user did of one sort is a finding; a day on which an event's number is divisible by four resolves it.
LOG_SQL = """SELECT event_type || CAST(user_id AS VARCHAR) AS id, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS run, CASE WHEN event_id % 4 = 0 THEN 'resolved' ELSE 'added' END AS op,
CASE event_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity, event_type || '/r' || CAST(user_id % 12 AS VARCHAR) AS rule_key FROM events"""
_SPARK_LOG = LOG_SQL.replace("datediff('day', DATE '2024-01-01', CAST(ts AS DATE))", "CAST(datediff(CAST(ts AS DATE), DATE '2024-01-01') AS BIGINT)")
_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in trends.SEVERITIES)


@query("trend_replayed", f"""WITH g AS (SELECT * FROM ({LOG_SQL}) WHERE split_part(rule_key, '/r', 2) NOT IN ('1', '5')), r AS (SELECT DISTINCT run FROM ({LOG_SQL})),
a AS (SELECT r.run, g.id, arg_max(CASE WHEN op = 'added' THEN severity END, (g.run, op = 'added', severity)) AS severity, arg_max(op, (g.run, op = 'added', severity)) AS op FROM r JOIN g ON g.run <= r.run GROUP BY 1, 2),
t AS (SELECT run, {_COUNTS}, count(*) AS total FROM a WHERE op = 'added' GROUP BY 1), n AS (SELECT run, count(DISTINCT id) FILTER (op = 'added') AS new, count(DISTINCT id) FILTER (op = 'resolved') AS resolved FROM g GROUP BY 1)
SELECT run, {', '.join(f'coalesce({s}, 0) AS {s}' for s in trends.SEVERITIES)}, coalesce(total, 0) AS total, coalesce(new, 0) AS new, greatest(0, coalesce(total, 0) - coalesce(new, 0)) AS unchanged, coalesce(resolved, 0) AS resolved FROM r LEFT JOIN t USING (run) LEFT JOIN n USING (run)""")
def _(spark, sf):
    log = P.view(spark, sf, _SPARK_LOG)
    disabled = log.where("split_part(rule_key, '/r', 2) IN ('1', '5')").select("rule_key").distinct()
    return trends.replayed(log, log.select("run").distinct(), disabled)


PATHS_SQL = "SELECT DISTINCT lower(replace(p_type, ' ', '/')) || '/' || lower(replace(p_brand, '#', '_')) || CASE p_partkey % 4 WHEN 0 THEN '.gen.ts' WHEN 1 THEN '.ts' WHEN 2 THEN '.md' ELSE '/index.ts' END AS path FROM part"
#: Ignore files of the root and of three directories below it, by line.
RULES = (
    ("", 0, "# comment"), ("", 1, "**/*.gen.ts"), ("", 2, "/economy/**/*.md"), ("", 3, "nickel/"), ("", 4, "!economy/plated/nickel/"), ("", 5, "brand_1?"), ("", 6, "!small/**/brand_1[!35].ts"),
    ("promo", 0, "*.md"), ("promo", 1, "!/burnished/tin/*.md"), ("promo/burnished", 0, "!*.gen.ts"), ("standard/anodized", 0, "/*/brand_2*"), ("standard/anodized", 1, "!/steel/"), ("small", 0, "brushed/"),
)
#: The same, by hand: directory, rank, pattern over what lies below it, whether it includes again, and whether it asks for a directory.
_BY_HAND = (
    ("", 1, r"^(.*/)?[^/]*\.gen\.ts$", 0, 0), ("", 2, r"^economy/(.*/)?[^/]*\.md$", 0, 0), ("", 3, "^(.*/)?nickel$", 0, 1), ("", 4, "^economy/plated/nickel$", 1, 1), ("", 5, "^(.*/)?brand_1[^/]$", 0, 0), ("", 6, r"^small/(.*/)?brand_1[^35]\.ts$", 1, 0),
    ("promo", 0, r"^(.*/)?[^/]*\.md$", 0, 0), ("promo", 1, r"^burnished/tin/[^/]*\.md$", 1, 0), ("promo/burnished", 0, r"^(.*/)?[^/]*\.gen\.ts$", 1, 0), ("standard/anodized", 0, "^[^/]*/brand_2[^/]*$", 0, 0), ("standard/anodized", 1, "^steel$", 1, 1), ("small", 0, "^(.*/)?brushed$", 0, 1),
)
_VALUES = ", ".join(f"('{d}', {k}, '{r}', {bool(n)}, {bool(o)})" for d, k, r, n, o in _BY_HAND)


@query("paths_ignored", f"""WITH p AS ({PATHS_SQL}), r(dir, rank, regex, negated, folders) AS (VALUES {_VALUES}),
x AS (SELECT path, array_to_string(string_split(path, '/')[1:k], '/') AS prefix, k < len(string_split(path, '/')) AS folder FROM p, range(1, 9) t(k) WHERE k <= len(string_split(path, '/'))),
m AS (SELECT path, prefix, folder, arg_max(negated, (length(dir), rank)) AS negated FROM x JOIN r ON (dir = '' OR starts_with(prefix, dir || '/')) AND (folder OR NOT folders) AND regexp_matches(CASE WHEN dir = '' THEN prefix ELSE substr(prefix, length(dir) + 2) END, regex) GROUP BY 1, 2, 3)
SELECT path, coalesce(bool_or(NOT negated), false) AS ignored, coalesce(bool_or(negated AND NOT folder), false) AND NOT coalesce(bool_or(NOT negated), false) AS reincluded FROM p LEFT JOIN m USING (path) GROUP BY path""")
def _(spark, sf):
    return ignoring.judged(P.view(spark, sf, PATHS_SQL), spark.createDataFrame(RULES, "dir string, rank int, pattern string"))
