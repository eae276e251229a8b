r"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted; neighbouring turns of one role are
merged into one block by slicing the sorted array where the role changes;
blocks are concatenated. A block reads

    <turn>role<body>text<part>text ...<end>\n

in which only these markers are control strings. Texts and roles are escaped
so that no control string can occur inside, and the escape is undone exactly
when the output is read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sondage.llm._common import col, text_or_empty

#: The template's control strings; each starts with the sign that is escaped in texts.
OPEN, ESCAPED = "<", "<lt>"
TURN, BODY, PART, END = "<turn>", "<body>", "<part>", "<end>\n"
LEARNT = "assistant"


def escaped(text: Column) -> Column:
    """Every sign that could open a control string is replaced; one-to-one."""
    return F.replace(text, F.lit(OPEN), F.lit(ESCAPED))


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit(ESCAPED), F.lit(OPEN))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``formatted`` and its ``loss_mask``.

    Turns go by turn number, null first, ties by role, then text; repeated
    rows are turns of their own. A null role or text counts as empty; rows of a
    null conversation form one. Neighbouring turns of one role share a block,
    as its parts. ``loss_mask`` covers ``formatted`` as runs of (chars, loss),
    in code points, one for each control string and each text between two; an
    assistant's parts alone are under loss. An empty table
    gives an empty result; extra columns are not read. A conversation is one
    output row, so its turns meet in one task, whatever the method.
    """
    one = F.struct(col(turn_col).alias("turn"), text_or_empty(role_col).alias("role"), text_or_empty(text_col).alias("text"))
    by_turn = turns.groupBy(col(conv_col).alias("__conv")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    changes = by_turn.withColumn("r", F.transform("t", lambda x: x["role"])).withColumn(
        "starts", F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.element_at("r", i) != F.element_at("r", F.greatest(i - 1, F.lit(1)))))
    )
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("t") + 1))
    blocks = F.zip_with(
        "starts", "ends",
        lambda s, e: F.struct(F.element_at("r", s).alias("role"), F.transform(F.slice("t", s, e - s), lambda x: escaped(x["text"])).alias("parts")),
    )
    shown = F.transform("blocks", lambda b: F.concat(F.lit(TURN), escaped(b["role"]), F.lit(BODY), F.array_join(b["parts"], PART), F.lit(END)))

    def run(chars: Column, loss: Column) -> Column:
        return F.struct(chars.cast("long").alias("chars"), loss.alias("loss"))

    def mask(b: Column) -> Column:
        no = F.lit(False)
        head = [run(F.lit(len(TURN)), no), run(F.char_length(escaped(b["role"])), no), run(F.lit(len(BODY)), no)]
        body = F.transform(b["parts"], lambda p, i: F.array(run(F.when(i > 0, len(PART)).otherwise(0), no), run(F.char_length(p), b["role"] == LEARNT)))
        return F.concat(F.array(*head), F.flatten(body), F.array(run(F.lit(len(END)), no)))

    return (
        changes.withColumn("ends", ends)
        .withColumn("blocks", blocks)
        .select(F.col("__conv").alias(conv_col), F.array_join(shown, "").alias("formatted"), F.filter(F.flatten(F.transform("blocks", mask)), lambda x: x["chars"] > 0).alias("loss_mask"))
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text), exactly as they went in.

    An empty text has none, and null gives null. Every block is split once, so
    the time grows with the text, however many parts a block has.
    """
    blocks = F.transform(F.filter(F.split(formatted, END), lambda b: b != ""), lambda b: F.split(F.substr(b, F.lit(len(TURN) + 1)), BODY))
    parts = F.transform(blocks, lambda b: F.struct(unescaped(F.get(b, F.lit(0))).alias("role"), F.split(F.get(b, F.lit(1)), PART).alias("parts")))
    return F.flatten(F.transform(parts, lambda b: F.transform(b["parts"], lambda p: F.struct(b["role"].alias("role"), unescaped(p).alias("text")))))


def learnt_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, in order, unescaped: what a model is trained to say.

    The text is cut once, before and after every control string, into what the
    mask has runs for; a mask that doesn't fit the text raises an error. An
    empty text, or one without anything under loss, gives an empty string.
    """
    signs = "|".join((TURN, BODY, PART, END))
    pieces = F.array_remove(F.split(formatted, f"(?={signs})|(?<={signs})"), "")
    fits = lambda t, x: F.char_length(t) == x["chars"]
    said = F.zip_with(pieces, loss_mask, lambda t, x: F.when(F.coalesce(fits(t, x), F.lit(False)), F.when(x["loss"], t)).otherwise(F.raise_error(F.lit("the loss mask doesn't fit the text"))))
    return unescaped(F.array_join(said, ""))


def query_op3(spark, sf_dir: str) -> DataFrame:
    """All ``conversations`` and one of control strings, formatted, and read back from the output and its mask."""
    hard = r"\### Assistant: </turn> ok"
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], chats.schema)
    out = format_chats(chats.unionByName(added)).select("conv_id", "formatted", read_turns(F.col("formatted")).alias("t"), learnt_text(F.col("formatted"), F.col("loss_mask")).alias("learnt"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_OP3 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), t AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS k
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(replace(text, '<', '<lt>'))
           + CASE WHEN before = role THEN 6 ELSE 18 + length(replace(role, '<', '<lt>')) END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
