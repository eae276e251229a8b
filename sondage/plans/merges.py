"""The whole merge of claims, over the events as claims with structured contents."""

from __future__ import annotations

from sondage.operators import shredded
from sondage.registry import query
from sondage.sources import projection as P

#: Claims whose contents are JSON in canonical form, at most two levels deep; a subject is a part of what one user did.
STRUCTURED_SQL = """SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'data' WHEN 'view' THEN 'overview' WHEN 'purchase' THEN 'auth' ELSE event_type END AS topic, 'u' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 7 AS VARCHAR) AS subject,
CASE WHEN user_id % 4 = 0 THEN 'f' ELSE 'f' || CAST(event_id % 3 AS VARCHAR) END AS file, CASE WHEN event_id % 9 = 4 THEN 'constraint' WHEN event_id % 2 = 0 THEN 'definition' END AS kind,
CASE WHEN event_id % 11 = 0 THEN '{}' WHEN event_id % 5 = 0 THEN '{"a":' || CAST(user_id % 3 AS VARCHAR) || ',"b":{"c":' || CAST(user_id % 2 AS VARCHAR) || '}}' WHEN event_id % 5 = 1 THEN '{"a":' || CAST(user_id % 3 AS VARCHAR) || '}'
WHEN event_id % 5 = 2 THEN '{"b":{"c":' || CAST(user_id % 2 AS VARCHAR) || ',"d":[1,2]}}' WHEN event_id % 5 = 3 AND event_id % 3 = 0 THEN '{"a":' || CAST(event_id % 2 AS VARCHAR) || ',"b":7}'
WHEN event_id % 5 = 3 THEN '{"a":' || CAST(user_id % 3 AS VARCHAR) || ',"b":{"c":' || CAST(user_id % 2 AS VARCHAR) || ',"d":[1,2]},"e":"t"}' ELSE '{"a":' || CAST(user_id % 3 AS VARCHAR) || ',"f":{}}' END AS content,
CASE event_id % 13 WHEN 0 THEN 'shipped' WHEN 1 THEN 'deferred' WHEN 2 THEN 'deprecated' END AS status,
CASE WHEN user_id % 3 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'adr' ELSE 'readme' END WHEN event_id % 6 = 1 THEN 'spec' WHEN event_id % 6 = 3 THEN 'unknown' ELSE 'runbook' END AS doc_kind, ts AS touched FROM events"""


def _assembled(name: str, rows: str, keys: str) -> str:
    """CTEs that write ``rows`` (keys, fullkey, path, key, value, depth) as JSON texts of two levels."""
    return f"""{name}2 AS (SELECT {keys}, path, string_agg('"' || key || '":' || value, ',' ORDER BY key) AS inner_ FROM {rows} WHERE depth = 2 GROUP BY {keys}, path),
{name} AS (SELECT {keys}, '{{' || string_agg('"' || key || '":' || coalesce(value, '{{' || coalesce(inner_, '') || '}}'), ',' ORDER BY key) || '}}' AS content
FROM (SELECT r.*, inner_ FROM {rows} r LEFT JOIN {name}2 USING ({keys}) WHERE depth = 1 AND ({name}2.path IS NULL OR {name}2.path = r.fullkey)
UNION ALL SELECT r.*, NULL FROM {rows} r WHERE depth = 1 AND EXISTS (SELECT 1 FROM {name}2 t WHERE {' AND '.join(f't.{k} = r.{k}' for k in keys.split(', '))}) AND NOT EXISTS (SELECT 1 FROM {name}2 t WHERE {' AND '.join(f't.{k} = r.{k}' for k in keys.split(', '))} AND t.path = r.fullkey)) GROUP BY {keys})"""


_RANK = "CASE doc_kind WHEN 'adr' THEN 4 WHEN 'spec' THEN 3 WHEN 'runbook' THEN 2 WHEN 'readme' THEN 1 ELSE 0 END"
_PRIORITY = "CASE coalesce(status, '') WHEN 'shipped' THEN 4 WHEN 'deferred' THEN 2 WHEN 'deprecated' THEN 0 ELSE 3 END"
MERGED_SQL = f"""WITH c AS ({STRUCTURED_SQL}),
a0 AS (SELECT *, max(CASE WHEN content <> '{{}}' THEN 1 ELSE 0 END) OVER g AS fulls FROM c WINDOW g AS (PARTITION BY topic, subject)),
a1 AS (SELECT *, coalesce(status, 'shipped') = 'shipped' AS live FROM a0 WHERE content <> '{{}}' OR fulls = 0),
a2 AS (SELECT *, max(CASE WHEN live THEN 1 ELSE 0 END) OVER (PARTITION BY topic, subject) AS lives FROM a1),
r AS MATERIALIZED (SELECT id, topic || '/' || subject AS g, topic, subject, file, coalesce(kind, 'definition') AS kind, content, coalesce(status, '') AS status, touched, {_RANK} AS rk, {_PRIORITY} AS pr,
  row_number() OVER (PARTITION BY topic, subject ORDER BY touched, id) AS ord FROM a2 WHERE live OR lives = 0),
n0 AS (SELECT r.g, r.id, r.ord, r.kind, t.fullkey, t.path, t.key, CASE WHEN t.type <> 'OBJECT' THEN CAST(t.value AS VARCHAR) END AS value, len(string_split(t.fullkey, '.')) - 1 AS depth FROM r, json_tree(r.content) t WHERE t.fullkey NOT LIKE '%[%'),
n AS MATERIALIZED (SELECT *, coalesce(value, '{{}}') AS form FROM n0),
rich AS (SELECT r.id, len(regexp_extract_all(regexp_replace(r.content, '"[^"]*"', '~', 'g'), '~[,}}\\]]|[0-9]+')) AS rich FROM r),
o AS (SELECT n.g, n.fullkey, n.id, n.ord, count(k.id) AS size FROM n LEFT JOIN n k ON k.id = n.id AND k.path = n.fullkey AND k.depth = n.depth + 1 WHERE n.value IS NULL GROUP BY 1, 2, 3, 4),
first_ AS (SELECT g, path, ord, count(*) AS new FROM (SELECT g, path, key, min(ord) AS ord FROM n WHERE depth > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2, 3),
q AS (SELECT o.*, coalesce(f.new, 0) AS new, coalesce(sum(coalesce(f.new, 0)) OVER (PARTITION BY o.g, o.fullkey ORDER BY o.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o LEFT JOIN first_ f ON f.g = o.g AND f.path = o.fullkey AND f.ord = o.ord),
apart AS (SELECT g FROM q WHERE new > 0 AND size - new < before UNION SELECT g FROM n GROUP BY g, fullkey HAVING count(DISTINCT form) > 1),
top_ AS (SELECT g, max(rk) AS top, arg_min(id, (-rk, ord)) AS winner FROM r GROUP BY 1),
gap AS (SELECT g, any_value(winner) AS winner, any_value(top) - max(rk) FILTER (rk < top) AS gap, count(*) FILTER (rk = top) AS at_top FROM r JOIN top_ USING (g) GROUP BY 1),
dom AS (SELECT g, winner FROM gap WHERE at_top = 1 AND gap >= 3),
keys_ AS (SELECT n.g, n.id, n.fullkey, list(k.key) FILTER (k.key IS NOT NULL) AS ks FROM n LEFT JOIN n k ON k.id = n.id AND k.path = n.fullkey AND k.depth = n.depth + 1 WHERE n.value IS NULL GROUP BY 1, 2, 3),
beyond AS (SELECT n.g FROM n JOIN dom USING (g) JOIN n w ON w.g = n.g AND w.id = dom.winner AND w.fullkey = n.fullkey WHERE n.form <> w.form
  UNION SELECT x.g FROM keys_ x JOIN dom USING (g) JOIN keys_ w ON w.g = x.g AND w.id = dom.winner AND w.fullkey = x.fullkey WHERE NOT list_has_all(coalesce(x.ks, []), coalesce(w.ks, [])) AND NOT list_has_all(coalesce(w.ks, []), coalesce(x.ks, []))),
both_ AS (SELECT g FROM r GROUP BY 1 HAVING count(*) FILTER (kind = 'constraint') > 0 AND count(*) FILTER (kind = 'definition') > 0),
narrow AS MATERIALIZED (SELECT DISTINCT n.g, fullkey, path, key, value, form, depth FROM n JOIN both_ USING (g) WHERE kind = 'constraint'),
odds AS (SELECT n.g FROM n JOIN narrow USING (g, fullkey) WHERE n.kind = 'definition' AND n.form <> narrow.form UNION SELECT g FROM narrow GROUP BY g, fullkey HAVING count(*) > 1),
agreed AS MATERIALIZED (SELECT g FROM both_ WHERE g NOT IN (SELECT g FROM odds)),
frows AS MATERIALIZED (SELECT n.g, n.id, fullkey, path, key, value, depth FROM n JOIN agreed USING (g) WHERE kind = 'definition' UNION SELECT r.g, r.id, fullkey, path, narrow.key, value, depth FROM r JOIN agreed USING (g) JOIN narrow USING (g) WHERE r.kind = 'definition'),
{_assembled('fold', 'frows', 'g, id')},
folded AS MATERIALIZED (SELECT fold.*, status, rk, touched, ord, rich FROM fold JOIN r USING (g, id) JOIN rich USING (id)),
one AS (SELECT g, count(DISTINCT (content, status)) AS folds, min(content) AS fold FROM folded GROUP BY 1),
f AS (SELECT g, any_value(topic) AS topic, any_value(subject) AS subject, count(*) AS n, count(DISTINCT (content, status)) AS prints, count(DISTINCT content) AS contents, count(DISTINCT file) AS files, count(DISTINCT status) AS statuses,
  arg_min(id, ord) AS head, arg_min(id, (-pr, ord)) AS by_status, arg_min(id, (-rich, ord)) AS richest, arg_min(id, (-rk, -epoch_us(touched), -rich, id)) AS dflt, arg_min(id, ord) FILTER (kind = 'definition') AS defined FROM r JOIN rich USING (id) GROUP BY 1),
s AS MATERIALIZED (SELECT f.*, one.folds, one.fold, CASE WHEN n = 1 THEN 'single' WHEN prints = 1 THEN 'identical' WHEN contents = 1 THEN 'status' WHEN files = 1 AND (topic IN ('data', 'overview') OR g NOT IN (SELECT g FROM apart)) THEN 'same-file'
  WHEN g IN (SELECT g FROM dom) AND g NOT IN (SELECT g FROM beyond) THEN 'dominance' WHEN statuses = 1 AND g NOT IN (SELECT g FROM apart) THEN 'superset' WHEN folds = 1 THEN 'constrained' ELSE 'conflict' END AS how FROM f LEFT JOIN one USING (g)),
lastp AS (SELECT n.g, fullkey, any_value(path) AS path, any_value(n.key) AS key, any_value(depth) AS depth, max(ord) AS ord, max(ord) FILTER (value IS NOT NULL) AS valued, arg_max(CASE WHEN value IS NULL THEN '~' ELSE value END, ord) AS v FROM n JOIN s USING (g) WHERE how = 'same-file' AND s.topic = 'data' GROUP BY 1, 2),
urows AS MATERIALIZED (SELECT DISTINCT n.g, fullkey, path, n.key, value, depth FROM n JOIN s USING (g) WHERE how = 'superset' OR (how = 'same-file' AND s.topic NOT IN ('data', 'overview'))
  UNION ALL SELECT g, fullkey, path, key, nullif(v, '~'), depth FROM lastp x WHERE NOT EXISTS (SELECT 1 FROM lastp y WHERE y.g = x.g AND y.depth < x.depth AND starts_with(x.fullkey, y.fullkey || '.') AND y.valued > x.ord)),
{_assembled('united', 'urows', 'g')},
pick AS (SELECT g, arg_min(id, (-rk, -epoch_us(touched), -len(regexp_extract_all(regexp_replace(content, '"[^"]*"', '~', 'g'), '~[,}}\\]]|[0-9]+')), id)) AS pick FROM folded GROUP BY 1),
open_ AS (SELECT DISTINCT g, content FROM (SELECT r.g, content FROM r JOIN s USING (g) WHERE how = 'conflict' AND g NOT IN (SELECT g FROM agreed) UNION ALL SELECT folded.g, folded.content FROM folded JOIN s USING (g) WHERE how = 'conflict')),
cand AS (SELECT g, count(*) AS candidates, sha256(concat_ws(',', count(*), {', '.join(f"sum(CAST('0x' || substr(sha256(content), {1 + 15 * k}, 15) AS BIGINT)::HUGEINT)" for k in range(4))})) AS conflict_id FROM open_ GROUP BY 1)
SELECT s.topic, s.subject, how, CASE how WHEN 'status' THEN by_status WHEN 'dominance' THEN (SELECT winner FROM dom WHERE dom.g = s.g) WHEN 'constrained' THEN defined WHEN 'conflict' THEN coalesce(pick, dflt) WHEN 'same-file' THEN CASE WHEN s.topic = 'overview' THEN richest ELSE head END ELSE head END AS chosen,
  CASE WHEN how = 'constrained' THEN fold WHEN how <> 'conflict' THEN coalesce(united.content, r.content) END AS content, n, conflict_id, candidates
FROM s LEFT JOIN united USING (g) LEFT JOIN cand USING (g) LEFT JOIN pick USING (g)
JOIN r ON r.g = s.g AND r.id = CASE how WHEN 'status' THEN by_status WHEN 'dominance' THEN (SELECT winner FROM dom WHERE dom.g = s.g) WHEN 'same-file' THEN CASE WHEN s.topic = 'overview' THEN richest ELSE head END ELSE head END"""


@query("claims_merged", MERGED_SQL)
def _(spark, sf):
    return shredded.merge_claims(P.view(spark, sf, STRUCTURED_SQL))
