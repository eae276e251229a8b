"""The driver's tables seen as code facts, in Spark and in the same words in SQL.

Findings come from ``events``; runs are the events' days; modules, methods and
calls come from ``supplier``, ``part`` and ``lineitem``; contracts and claims
from ``part``, ``documents`` and ``conversations``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sondage.session import table

FINDINGS_SQL = """
SELECT event_id AS id, ts AS created_at, event_type || '/r' || CAST(event_id % 12 AS VARCHAR) AS rule_key,
       CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium'
            WHEN 'view' THEN 'low' ELSE 'info' END AS severity,
       CASE event_id % 4 WHEN 0 THEN 'new' WHEN 3 THEN 'resolved' ELSE 'unchanged' END AS status,
       CASE WHEN event_id % 5 = 0 THEN 'module' ELSE 'code' END AS type,
       'svc' || CAST(user_id % 5 AS VARCHAR) AS service,
       CASE WHEN user_id % 11 = 0 THEN NULL ELSE 'mod' || CAST(user_id % 30 AS VARCHAR) END AS module,
       '/repo/svc' || CAST(user_id % 5 AS VARCHAR) || '/mod' || CAST(user_id % 30 AS VARCHAR) || '.ts' AS file_path,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 400 AS INT) END AS line_start,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(event_id % 400 + 3 AS INT) END AS line_end,
       event_type || ' by ' || CAST(user_id AS VARCHAR) AS title, user_id, value,
       CAST(date_trunc('day', ts) AS DATE) AS day
FROM events
"""

RULES_SQL = """
SELECT DISTINCT event_type || '/r' || CAST(event_id % 12 AS VARCHAR) AS rule_key, event_type AS category,
       CASE WHEN event_id % 12 < 8 THEN 'code' ELSE 'architecture' END AS kind, event_id % 12 AS number
FROM events
"""

MODULES_SQL = """
SELECT s_suppkey AS module_id, s_name AS name, 'svc' || CAST(s_nationkey % 5 AS VARCHAR) AS service,
       CASE s_suppkey % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'service' WHEN 2 THEN 'data' ELSE 'external' END AS layer,
       '/repo/svc' || CAST(s_nationkey % 5 AS VARCHAR) || '/' || lower(replace(s_name, '#', '_')) || '.ts' AS file_path,
       CAST(s_suppkey % 23 AS INT) AS method_count, CAST(s_suppkey % 160 AS INT) AS file_count
FROM supplier
"""

METHODS_SQL = """
SELECT p_partkey AS method_id, p_name AS name, p_partkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS module_id,
       CAST(p_size AS INT) AS statements, CAST(p_partkey % 9 AS INT) AS params, CAST(p_partkey % 6 AS INT) AS nesting,
       p_partkey % 3 = 0 AS exported, CAST((p_partkey * 37) % 1000 AS INT) AS line_start,
       CAST((p_partkey * 37) % 1000 + p_size AS INT) AS line_end
FROM part
"""

#: A call of one module by another, through the suppliers of one order's lines.
CALLS_SQL = """
SELECT l_suppkey AS caller, l_partkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS callee, l_orderkey, l_linenumber
FROM lineitem
"""

#: A sparse graph with cycles and ends: a module of a fair balance imports one, of a high balance a second one.
IMPORTS_SQL = """
SELECT s_suppkey AS source, (s_suppkey * 7 + s_nationkey) % (SELECT max(s_suppkey) FROM supplier) + 1 AS target FROM supplier WHERE s_acctbal > 2000
UNION SELECT s_suppkey, (s_suppkey * 11 + s_nationkey * 5) % (SELECT max(s_suppkey) FROM supplier) + 1 FROM supplier WHERE s_acctbal > 5000
"""


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """One of the texts above over the tables in ``sf_dir``."""
    names = {n: table(spark, sf_dir, n) for n in re.findall(r"(?:FROM|JOIN) (\w+)", text)}
    text = text.replace("{", "{{").replace("}", "}}")
    for n in names:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text.replace("AS VARCHAR", "AS STRING"), **names)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FINDINGS_SQL)


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RULES_SQL)


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, MODULES_SQL)


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, METHODS_SQL)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CALLS_SQL)


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, IMPORTS_SQL)
