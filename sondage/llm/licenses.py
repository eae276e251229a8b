"""License scans with built-in functions only.

The lines of a text, its paragraphs, and its runs of neighbouring lines that
mostly hold words of licences are compared with templates as sparse TF-IDF
vectors by cosine. What is close enough is a header; where it makes up the text,
or the file is named as licence files are, the text is a licence file. A
document without a notice of its own inherits from the licence file in the
nearest directory above it, found by joins on directory paths.

Texts that can't hold a notice are passed over by a test that loses none: a
cosine of c takes words that make up c² of the template's squared length, so
rare words that make up more than the rest of it cannot all be missing.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import cache

from pyspark.sql import Column, DataFrame, Window, functions as F

from sondage.llm._common import col, partitions, stored, tasks_for, text_or_empty
from sondage.llm.licence_texts import templates

TEMPLATES = templates()
#: How a licence file's name begins, in upper case.
FILE_NAMES = ("LICENSE", "LICENCE", "COPYING", "UNLICENSE", "UNLICENCE")
THRESHOLD = 0.75
#: What a word is split at, and what is cut off its ends: versions stay whole.
BETWEEN, AROUND = r"[^\p{L}\p{N}.+-]+", ".+-"
#: Rows of a directory, in the mean, that one task gives what the directory inherits.
PIECE_ROWS = 1 << 20


def tokens(text: Column) -> Column:
    """Lower-case words; dots, pluses and hyphens stay inside, so that versions do."""
    return F.filter(F.transform(F.split(F.lower(text), BETWEEN), lambda w: F.btrim(w, F.lit(AROUND))), lambda w: w != "")


@cache
def template_tokens() -> tuple[tuple[str, tuple[str, ...]], ...]:
    out = []
    for name, text in TEMPLATES:
        words = (w.strip(AROUND) for w in re.split(r"[^\w.+-]+", text.lower().replace("_", " ")))
        out.append((name, tuple(w for w in words if w)))
    return tuple(out)


def vocabulary() -> list[str]:
    return sorted({t for _, words in template_tokens() for t in words})


def _texts(words: list[str]) -> Column:
    """The words as one constant."""
    return F.split(F.lit("\n".join(words)), "\n")


def _constant(value, kind: str) -> Column:
    """A value of lists, objects, numbers and texts as one constant of the type ``kind``; doubles stay exactly what they are."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def weights(docs: DataFrame, text_col: str) -> tuple[dict[str, float], float]:
    """The idf of the templates' words, and that of a word seen nowhere, from all documents and templates.

    What comes to the driver is a number per word of the templates, whatever the corpus.
    """
    words = F.array_intersect(tokens(text_or_empty(text_col)), _texts(vocabulary()))
    seen = docs.select(F.explode_outer(words).alias("t")).groupBy("t").count()
    df = {r.t: r["count"] for r in seen.collect()}
    n = docs.count() + len(TEMPLATES)
    for _, own in template_tokens():
        for t in set(own):
            df[t] = df.get(t, 0) + 1
    return {t: math.log((n + 1) / (df[t] + 1)) + 1 for t in vocabulary()}, math.log(n + 1) + 1


def telling(idf: dict[str, float], threshold: float) -> list[str]:
    """Words of which a text holds at least one if any part of it is as close to a template as ``threshold``."""
    out = set()
    for _, words in template_tokens():
        parts = sorted(((c * idf[t]) ** 2, t) for t, c in Counter(words).items())
        most, found = (1 - threshold**2) * sum(w for w, _ in parts), 0.0
        for w, t in sorted(parts, key=lambda x: (-idf[x[1]], x[1])):
            out.add(t)
            found += w
            if found > most * (1 + 1e-9):
                break
    return sorted(out)


def _segments(rows: DataFrame, telling_words: list[str]) -> DataFrame:
    """(part, row, kind, seg, line, words): lines (0), paragraphs (1) and runs (2) of the rows (part, row, t).

    Lines without words end a paragraph. A run goes on over these and ends at
    a line of whose distinct words less than half are the templates'. Only
    segments with a telling word come back.
    """
    known, own = _texts(vocabulary()), F.array_distinct("words")
    of_row = Window.partitionBy("part", "row").orderBy("line")
    lines = (
        rows.select("part", "row", F.posexplode(F.split("t", "\n")).alias("line", "text")).select("part", "row", "line", tokens(F.col("text")).alias("words")).where(F.size("words") > 0)
        .withColumn("mostly", 2 * F.size(F.array_intersect(own, known)) >= F.size(own)).withColumn("telling", F.arrays_overlap("words", _texts(telling_words)))
        .withColumn("r", F.row_number().over(of_row)).withColumn("run", F.when(F.col("mostly"), F.col("r") - F.sum(F.col("mostly").cast("int")).over(of_row)))
    )
    parts = [F.struct(F.lit(0).alias("kind"), F.col("line").alias("seg")), F.struct(F.lit(1).alias("kind"), (F.col("line") - F.col("r")).alias("seg")), F.when(F.col("mostly"), F.struct(F.lit(2).alias("kind"), F.col("run").alias("seg")))]
    each = lines.select("part", "row", "line", "words", "telling", F.explode(F.array_compact(F.array(*parts))).alias("s")).select("part", "row", "line", "words", "telling", "s.kind", "s.seg")
    whole = Window.partitionBy("part", "row", "kind", "seg")
    return each.withColumn("any", F.max("telling").over(whole)).where("any").withColumn("line", F.min("line").over(whole)).select("part", "row", "kind", "seg", "line", "words")


def _scored(segments: DataFrame, idf: dict[str, float], rare: float) -> DataFrame:
    """(part, row, line, best, size): each segment's nearest template as (score, license), and its words.

    Among equal scores the name that sorts last counts. A word that no template
    has weighs as one seen nowhere; the table of the templates' words has a row
    per word, whatever the corpus. A product with number -1 is the segment's
    with itself.
    """
    known = [(name, {t: c * idf[t] for t, c in Counter(words).items()}) for name, words in template_tokens()]
    entries = [{"token": t, "idf": idf[t], "per": [{"k": -1, "w": idf[t]}] + [{"k": k, "w": w[t]} for k, (_, w) in enumerate(known) if t in w]} for t in sorted(idf)]
    table = F.broadcast(segments.sparkSession.range(1).select(F.inline(_constant(entries, "array<struct<token:string,idf:double,per:array<struct<k:int,w:double>>>>"))))
    keys = ["part", "row", "kind", "seg"]
    counted = segments.select(*keys, "line", F.explode("words").alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    alone = F.array(F.struct(F.lit(-1).alias("k"), F.lit(rare).alias("w")))
    weighed = counted.join(table, "token", "left").select(*keys, "line", "n", F.explode(F.coalesce("per", alone)).alias("p"), (F.col("n") * F.coalesce("idf", F.lit(rare))).alias("w"))
    own = F.when(F.col("p.k") < 0, F.col("n") * F.col("w")).otherwise(F.col("w"))  # n * idf, for each of the n
    dots = weighed.groupBy(*keys, F.col("p.k").alias("k")).agg(F.sum(own * F.col("p.w")).alias("dot"), F.sum("n").alias("n"), F.min("line").alias("line"))
    each = dots.groupBy(*keys).agg(F.collect_list(F.when(F.col("k") >= 0, F.struct("k", "dot"))).alias("d"), F.max(F.when(F.col("k") < 0, F.struct(F.sqrt("dot").alias("norm"), "n", "line"))).alias("s"))
    sizes = _constant([math.sqrt(sum(w * w for w in t.values())) for _, t in known], "array<double>")
    names = _texts([name for name, _ in known])
    near = F.array_max(F.transform("d", lambda x: F.struct(F.round(x["dot"] / (F.col("s.norm") * F.get(sizes, x["k"])), 6).alias("score"), F.get(names, x["k"]).alias("license"))))
    return each.select(*keys, near.alias("best"), F.col("s.n").alias("size"), F.col("s.line").alias("line"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """The path without its last part; without any slash, the root, an empty string."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")


def notices(placed: DataFrame, idf: dict[str, float], rare: float, telling_words: list[str], threshold: float) -> DataFrame:
    """(row, score, license, line, whole): of rows (row, path, t) those with a notice, the best one.

    ``line``: the first line, from 0, of the best; ``whole``: a notice makes up
    the text, or the file is named as licence files are.
    """
    held = placed.where("t is not null")
    tasks = max(tasks_for(held), partitions(held.sparkSession))
    # a text's lines stay in one task from here on, so nothing that follows is exchanged again
    dealt = held.select(F.pmod(F.xxhash64("row"), F.lit(tasks)).cast("int").alias("part"), "row", "t").repartitionById(tasks, F.col("part"))
    found = _scored(_segments(dealt, telling_words), idf, rare).where(F.col("best.score") >= threshold)
    best = found.groupBy("part", "row").agg(F.max(F.struct(F.col("best.score").alias("score"), F.col("best.license").alias("license"), (-F.col("line")).alias("line"))).alias("h"), F.max("size").alias("most"))
    named = F.lit(False)
    for name in FILE_NAMES:
        named = named | F.startswith(F.upper(base_name(F.col("path"))), F.lit(name))
    size = held.select("row", F.size(tokens(F.col("t"))).alias("words"), F.coalesce(named, F.lit(False)).alias("named"))
    return best.join(size, "row").select("row", "h.score", "h.license", (-F.col("h.line")).alias("line"), (F.col("named") | (F.col("most") >= threshold * F.col("words"))).alias("whole"))


def license_scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: its licence and where that comes from.

    Columns: the id; ``license``; ``score``, rounded to six places; ``origin``:
    ``header`` for a notice in the text, ``file`` where the notice makes up at
    least ``threshold`` of its words or the file is named as licence files are,
    ``inherited`` from the licence file nearest above in ``path``, null for
    none; ``from_dir``, the directory inherited from. Of several notices in a
    text the one of best score, then of the name that sorts last, counts; of
    several licence files in a directory the one of best score, then smallest
    id. Null texts count as empty; a null path inherits nothing; repeated rows
    and null ids are rows of their own, joined by a row number that is fixed
    before; an empty table gives an empty result; extra columns are not read.
    """
    idf, rare = weights(docs, text_col)
    found = telling(idf, threshold)
    text = text_or_empty(text_col)
    # the texts that may hold a notice are kept with all rows' places, each under its number
    placed = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), col(id_col).alias("id"), path.cast("string").alias("path"),
        F.when(F.arrays_overlap(tokens(text), _texts(found)), text).alias("t"),
    ))
    own = stored(notices(placed, idf, rare, found, threshold))
    dirs = placed.select("row", "id", directory(F.col("path")).alias("dir"))
    files = (
        own.where("whole").join(dirs.where("dir is not null"), "row").groupBy("dir")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), "license")).alias("f"))
        .select(F.col("dir").alias("above"), F.col("f.license").alias("file_license"), (-F.col("f.s")).alias("file_score"))
    )
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    distinct = dirs.select("dir").where("dir is not null").distinct().select("dir", F.explode(F.array_distinct(above)).alias("above"))
    nearest = distinct.join(files, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), F.col("above").alias("from_dir"), "file_license", "file_score")).alias("near"))
    # a directory may hold a third of all rows: its rows are dealt into pieces, and what it inherits goes to each piece that is there
    pieces = max(1, -(-placed.count() // PIECE_ROWS))
    dealt = dirs.withColumn("piece", F.when(F.col("dir").isNull(), F.col("row")).otherwise(F.pmod("row", F.lit(pieces))))
    sent = dealt.where("dir is not null").select("dir", "piece").distinct().join(nearest, "dir")
    joined = dealt.join(sent, ["dir", "piece"], "left").join(own, "row", "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("license", "near.file_license").alias("license"),
        F.coalesce("score", "near.file_score").alias("score"),
        F.when(F.col("whole"), "file").when(F.col("license").isNotNull(), "header").when(F.col("near").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("license").isNull(), F.col("near.from_dir")).alias("from_dir"),
    )


def query_op10(spark, sf_dir: str) -> DataFrame:
    """``license_scan`` of all ``documents``, which have no paths: source, language and id stand for one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return license_scan(docs, F.concat_ws("/", F.col("source"), F.col("lang"), F.col("doc_id").cast("string")))


def _oracle() -> str:
    """The same in DuckDB's SQL from the same templates, without the test that passes texts over."""
    quote = lambda x: x.replace("'", "''")
    values = ", ".join(f"({k}, '{name}', '{quote(text)}')" for k, (name, text) in enumerate(TEMPLATES))
    words = lambda c: rf"list_filter(list_transform(string_split_regex(lower({c}), '{BETWEEN}'), lambda w: trim(w, '{AROUND}')), lambda w: w <> '')"
    return rf"""
WITH tpl(tid, name, text) AS (VALUES {values}),
ttok AS (SELECT tid, name, unnest({words('text')}) AS token FROM tpl),
vocab AS (SELECT list(DISTINCT token) AS v FROM ttok),
d AS (SELECT doc_id, row_number() OVER () AS id, concat_ws('/', source, lang) AS dir, source, upper(CAST(doc_id AS VARCHAR)) AS base, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT id, {words('text')} AS words FROM d),
total AS (SELECT (SELECT count(*) FROM d) + {len(TEMPLATES)} AS n),
df AS (SELECT token, sum(n) AS df FROM (
  SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct(words)) AS token FROM w) WHERE token IN (SELECT token FROM ttok) GROUP BY 1
  UNION ALL SELECT token, count(DISTINCT tid) FROM ttok GROUP BY 1) GROUP BY 1),
idf AS MATERIALIZED (SELECT token, ln(((SELECT n FROM total) + 1) / (df + 1)) + 1 AS idf FROM df),
tvec AS MATERIALIZED (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY tid)) AS size FROM (SELECT tid, name, token, count(*) * any_value(idf) AS w FROM ttok JOIN idf USING (token) GROUP BY 1, 2, 3)),
l0 AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM d),
l1 AS (SELECT id, k, {words('line')} AS words FROM l0),
l2 AS (SELECT id, k, words, 2 * len(list_intersect(list_distinct(words), (SELECT v FROM vocab))) >= len(list_distinct(words)) AS mostly,
  row_number() OVER (PARTITION BY id ORDER BY k) AS r FROM l1 WHERE len(words) > 0),
l3 AS MATERIALIZED (SELECT *, r - sum(CAST(mostly AS INT)) OVER (PARTITION BY id ORDER BY k) AS run FROM l2),
segs AS (SELECT id, 0 AS kind, k AS seg, k, words FROM l3 UNION ALL SELECT id, 1, k - r, k, words FROM l3 UNION ALL SELECT id, 2, run, k, words FROM l3 WHERE mostly),
toks AS (SELECT id, kind, seg, min(k) AS k, token, count(*) AS n FROM (SELECT id, kind, seg, k, unnest(words) AS token FROM segs) GROUP BY id, kind, seg, token),
wt AS MATERIALIZED (SELECT toks.*, n * coalesce(idf, (SELECT ln(n + 1) + 1 FROM total)) AS w FROM toks LEFT JOIN idf USING (token)),
norms AS (SELECT id, kind, seg, sqrt(sum(w * w)) AS norm, sum(n) AS size, min(k) AS k FROM wt GROUP BY 1, 2, 3),
dots AS (SELECT wt.id, wt.kind, wt.seg, t.tid, any_value(t.name) AS name, any_value(t.size) AS tsize, sum(wt.w * t.w) AS dot FROM wt JOIN tvec t USING (token) GROUP BY 1, 2, 3, 4),
best AS (SELECT id, kind, seg, max(sc) AS score, arg_max(name, (sc, name)) AS license, any_value(size) AS size, any_value(k) AS k
  FROM (SELECT dots.*, norms.size, norms.k, round(dot / (norm * tsize), 6) AS sc FROM dots JOIN norms USING (id, kind, seg)) GROUP BY 1, 2, 3),
own AS (SELECT b.id, max(score) AS score, arg_max(license, (score, license)) AS license, max(size) >= {THRESHOLD} * any_value(len(w.words)) OR any_value(regexp_matches(d.base, '^({'|'.join(FILE_NAMES)})')) AS whole
  FROM best b JOIN w ON b.id = w.id JOIN d ON b.id = d.id WHERE score >= {THRESHOLD} GROUP BY 1),
files AS (SELECT dir, arg_min(license, (-score, doc_id)) AS license, max(score) AS score FROM own JOIN d USING (id) WHERE whole GROUP BY 1),
near AS (SELECT dir, arg_max(above, length(above)) AS from_dir, arg_max(license, length(above)) AS license, arg_max(score, length(above)) AS score
  FROM (SELECT x.dir, f.dir AS above, f.license, f.score FROM (SELECT DISTINCT dir, source FROM d) x JOIN files f ON f.dir IN ('', x.source, x.dir)) GROUP BY 1)
SELECT d.doc_id, coalesce(own.license, near.license) AS license, coalesce(own.score, near.score) AS score,
  CASE WHEN own.whole THEN 'file' WHEN own.id IS NOT NULL THEN 'header' WHEN near.dir IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN own.id IS NULL THEN near.from_dir END AS from_dir
FROM d LEFT JOIN own ON d.id = own.id LEFT JOIN near ON d.dir = near.dir
"""


ORACLE_OP10 = _oracle()
