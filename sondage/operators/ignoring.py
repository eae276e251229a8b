"""Ignore files, nested in directories, applied to paths by joins.

A path is judged with each of its directories above it. A rule counts for what
lies below its ignore file's directory; of the rules that match, the last one
of the deepest directory decides. A path is ignored if it is, or any directory
above it is: what lies in an ignored directory can't be included again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _regex(body: Column) -> Column:
    """A pattern's body as a regular expression over paths: ``*`` and ``?`` stay within a name, ``**`` goes over any."""
    plain = F.regexp_replace(body, r"([.+^$(){}|\\])", r"\\$1")
    steps = [(r"^\*\*/", "\x01"), (r"/\*\*/", "\x02"), (r"/\*\*$", "\x03"), (r"\*+", "\x04"), (r"\?", "\x05"), (r"\[!", "[^"), ("\x01", "(?:.*/)?"), ("\x02", "/(?:.*/)?"), ("\x03", "/.+"), ("\x04", "[^/]*"), ("\x05", "[^/]")]
    for old, new in steps:
        plain = F.regexp_replace(plain, old, new.replace("$", r"\$"))
    return plain


def compiled(rules: DataFrame) -> DataFrame:
    """(dir, rank, regex, negated, folders_only) of the lines (dir, rank, pattern) of ignore files.

    Blank lines and comments drop out, spaces at the end go. A pattern with a
    slash before its end is bound to its directory, any other matches at any
    depth below it; a slash at the end asks for a directory; ``!`` includes
    again; a backslash before ``!`` or ``#`` at the beginning is dropped.
    """
    line = F.rtrim(F.regexp_replace("pattern", "\r$", ""))
    rows = rules.select(F.coalesce("dir", F.lit("")).alias("dir"), "rank", line.alias("line")).where("line <> '' and line not like '#%'")
    rows = rows.withColumn("negated", F.startswith(F.col("line"), F.lit("!"))).withColumn("body", F.regexp_replace(F.when(F.col("negated"), F.substr(F.col("line"), F.lit(2))).otherwise(F.col("line")), r"^\\([!#])", "$1"))
    rows = rows.withColumn("folders_only", F.endswith(F.col("body"), F.lit("/"))).withColumn("body", F.regexp_replace("body", "/+$", ""))
    bound, inner = F.contains(F.col("body"), F.lit("/")), F.regexp_replace("body", "^/", "")
    return rows.where("body <> ''").select("dir", "rank", F.concat(F.lit("^"), F.when(bound, "").otherwise("(?:.*/)?"), _regex(inner), F.lit("$")).alias("regex"), "negated", "folders_only")


def judged(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` with ``ignored`` and ``reincluded``: whether ignore rules take a path out, or a rule brings just this path back.

    files: path, relative to the root, with ``/`` between names; rules: dir (''
    for the root), rank (the line's number in its file), pattern. Each prefix of
    a path is judged once, whatever lies below it, and meets the rules of the
    directories above it alone. Null paths and those outside the root (from
    ``..`` on) are never ignored; no rules ignore nothing.
    """
    inside = files.where("path is not null and path <> '' and path <> '..' and path not like '../%'").select("path").distinct()
    parts = F.split("path", "/")
    upto = lambda names, k: F.array_join(F.slice(names, F.lit(1), k), "/")
    prefixes = inside.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: upto(parts, k))).alias("prefix"))
    seen = prefixes.groupBy("prefix").agg(F.max(F.col("prefix") != F.col("path")).alias("folder"))
    names = F.split("prefix", "/")
    above = seen.select("prefix", "folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda k: upto(names, k))).alias("dir"))
    below = F.when(F.col("dir") == "", F.col("prefix")).otherwise(F.substr(F.col("prefix"), F.length("dir") + 2))
    met = above.join(compiled(rules), "dir").where(F.col("folder") | ~F.col("folders_only")).where(F.rlike(below, F.col("regex")))
    last = met.groupBy("prefix").agg(F.max_by("negated", F.struct(F.length("dir").alias("depth"), "rank")).alias("negated"))
    verdict = prefixes.join(last, "prefix", "left").groupBy("path").agg(
        F.coalesce(F.max(~F.col("negated")), F.lit(False)).alias("ignored"), F.coalesce(F.max(F.when(F.col("prefix") == F.col("path"), F.col("negated"))), F.lit(False)).alias("back"),
    )
    out = files.join(verdict, "path", "left")
    return out.select(*files.columns, F.coalesce("ignored", F.lit(False)).alias("ignored"), F.coalesce(F.col("back") & ~F.col("ignored"), F.lit(False)).alias("reincluded"))
