"""Exact duplicate removal by a tree merge of sorted digest runs, built-in functions only.

Every row is reduced to one digest row, and each partition of the input becomes
a run: its digest rows, sorted, equal ones merged. Runs are then merged in
binomial rounds. In round ``k`` partitions whose numbers differ in their k-th
digit alone exchange parts of their runs: each sends every partner the part
whose digests have the partner's digit, and merges the parts it gets, which are
sorted, into one run. A merge keeps per digest the row that stays and the
number of rows. After the last round every partition holds one range of digest
digits from all partitions. The winners then walk the same rounds backwards.
However hot a digest is, a task meets it once per run that it merges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from sondage.llm._common import col, stored, text_or_empty, whole_rows

#: The characters that do not count, `[\x20\x09-\x0D]`.
IGNORED = (" ", "\t", "\n", "\x0b", "\f", "\r")


def normalised(text: Column) -> Column:
    """The text without the ignored characters."""
    for c in IGNORED:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def radices(runs: int, fanout: int) -> list[int]:
    """How many runs are merged in each round, at most ``fanout``, so that their product is ``runs`` at least."""
    out, left = [], runs
    while left > 1:
        out.append(min(fanout, left))
        left = -(-left // out[-1])
    return out


def _best() -> Column:
    """Least for the row that stays: most code points, then the smallest id (an id before none), then the first row."""
    return F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))


def _merged(rows: DataFrame, part: str, parts: int, checks: list[str]) -> DataFrame:
    """The runs that each partition gets, sorted and merged into one: a row per digest.

    ``part`` is the number of the partition itself, so nothing is hashed and no
    further exchange happens. Rows meet only if digest, length and second hash
    agree, so an identifier that is kept has been verified at every level.
    """
    runs = rows.repartitionById(parts, F.col(part)).sortWithinPartitions(part, *checks)
    return runs.groupBy(part, *checks).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_rows: int = 1_000_000, fanout: int = 8) -> DataFrame:
    """One row per row of ``docs`` with the id that stays for its group.

    Texts are equal when identical after deleting ``IGNORED`` characters; null
    counts as empty. The row with the most code points stays, then the one with
    the smallest id (a null id comes last). Repeated rows are rows of their
    own: of rows that agree in id and length too, one alone is kept. An empty
    table gives an empty result; extra columns are not read.

    run_rows: rows in a first run, at most about; fanout: runs merged in a round.
    ``tied`` says that the row agrees with the one that stays in id and length,
    which is ``keep_chars``.
    """
    checks = ["sha", "bytes", "second"]
    digests = stored(
        docs.select(col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
        .select("id", F.char_length("t").alias("chars"), normalised(F.col("t")).alias("p"))
        .select(
            "id", "chars", F.unhex(F.sha2(F.col("p").cast("binary"), 256)).alias("sha"), F.octet_length("p").alias("bytes"), F.xxhash64("p").alias("second"),
            F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("part"),
        )
    )
    held, most = digests.agg(F.count("*"), F.max("part")).first()
    scanned = (most or 0) + 1
    split = max(1, -(-held // (run_rows * scanned)))  # runs that one partition of the input becomes
    rounds = radices(scanned * split, fanout)
    parts = math.prod(rounds)
    first = F.col("part") + scanned * F.pmod("row", F.lit(split)).cast("int")
    rows = digests.withColumn("p0", first.cast("int"))
    levels = [stored(_merged(rows.select("p0", *checks, _best().alias("best"), F.lit(1).cast("long").alias("n")), "p0", parts, checks))]
    digits, stride = F.pmod("second", F.lit(parts)), 1
    for k, radix in enumerate(rounds):
        # the k-th digit of the partition's number gives way to the digest's
        mine, wanted = F.floor(F.col(f"p{k}") / stride) % radix, F.floor(digits / stride) % radix
        moved = levels[-1].withColumn(f"p{k + 1}", (F.col(f"p{k}") + (wanted - mine) * stride).cast("int"))
        levels[-1] = moved.select(f"p{k}", f"p{k + 1}", *checks)
        levels.append(stored(_merged(moved.drop(f"p{k}"), f"p{k + 1}", parts, checks)))
        stride *= radix
    kept = ["keep_id", "keep_chars", "keep_row", "group_size"]
    top = levels[-1].select(f"p{len(rounds)}", *checks, F.col("best.id").alias("keep_id"), (-F.col("best.chars")).alias("keep_chars"), F.col("best.row").alias("keep_row"), F.col("n").alias("group_size"))
    for k in range(len(rounds) - 1, -1, -1):
        top = levels[k].join(top, [f"p{k + 1}", *checks]).select(f"p{k}", *checks, *kept)
    return rows.join(top, ["p0", *checks]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))).alias("tied"), "keep_chars",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, of any type and name.

    Null texts count as empty, null ids come last; an empty table gives an
    empty result. Rows that repeat the one that stays in id and text can't be
    told apart by a join; these alone are brought together, and one is taken.
    """
    stay = (
        exact_groups(docs, id_col, text_col).where("tied")
        .groupBy(col(id_col).alias("keep"), "keep_chars", F.unhex("text_sha256").alias("sha")).agg(F.count("*").alias("n"))
    )
    text = text_or_empty(text_col)
    named = whole_rows(docs, col(id_col).alias("id"), F.char_length(text).alias("chars"), F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"))
    found = named.join(stay, F.col("id").eqNullSafe(F.col("keep")) & (F.col("digest") == F.col("sha")) & (F.col("chars") == F.col("keep_chars")))
    repeated = found.where("n > 1").groupBy("keep", "sha").agg(F.first("r").alias("r"))
    return found.where("n = 1").select("r").unionByName(repeated.select("r")).select("r.*")


def query_op9(spark, sf_dir: str) -> DataFrame:
    """``exact_groups`` over all ``documents``: one row per row, dropped ones too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).drop("tied", "keep_chars")


ORACLE_OP9 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER w AS k
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r
"""
