import hashlib

import pytest
from pyspark.sql import functions as F
from sondage.llm.chat_format import END, OPEN, format_chats, learnt_text, read_turns

SCHEMA = "conv_id long, turn long, role string, text string, turns string, formatted string"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


ROWS = [
    (1, 1, "assistant", "</turn> <end>\n<part><lt>&lt;"), (1, 0, "user", "<turn>user<body>"), (1, 2, "assistant", "more"), (1, 3, "user", ""),
    (2, None, None, None), (2, 0, "assistant", "é<"), (None, 0, "user", "no conversation"), (3, 0, "assistant", "tie b"), (3, 0, "assistant", "tie a"), (3, 0, "assistant", "tie a"),
    (4, 0, "<role>", "\n"), (5, 0, "user", "long " * 20_000),
]


def order(r):
    return (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")


def test_round_trip_and_mask(spark):
    got = {r.conv_id: r for r in format_chats(chats(spark, ROWS)).withColumn("t", read_turns(F.col("formatted"))).withColumn("learnt", learnt_text(F.col("formatted"), F.col("loss_mask"))).collect()}
    assert set(got) == {r[0] for r in ROWS}
    for conv, row in got.items():
        want = sorted((r for r in ROWS if r[0] == conv), key=order)
        assert [(x.role, x.text) for x in row.t] == [(r[2] or "", r[3] or "") for r in want]
        assert sum(x.chars for x in row.loss_mask) == len(row.formatted)
        at, learnt = 0, ""
        for x in row.loss_mask:
            learnt += row.formatted[at : at + x.chars] if x.loss else ""
            at += x.chars
        assert learnt.replace("<lt>", OPEN) == row.learnt == "".join(r[3] or "" for r in want if r[2] == "assistant")


def test_neighbours_share_a_block(spark):
    got = {r.conv_id: r.formatted for r in format_chats(chats(spark, ROWS)).collect()}
    assert got[1].count(END) == 3 and got[3].count(END) == 1
    assert got[1].count("</turn>") == 0


def test_empty(spark):
    assert format_chats(chats(spark, ROWS).limit(0)).count() == 0


@pytest.mark.parametrize("roles", [["user", "assistant"], ["assistant"]])
def test_a_hundred_thousand_turns_take_time_in_proportion(spark, roles):
    import time

    from pyspark.sql import functions as F
    from sondage.llm.chat_format import format_chats, learnt_text, read_turns

    n, names = 100_000, F.array(*[F.lit(r) for r in roles])
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.get(names, (F.col("id") % len(roles)).cast("int")).alias("role"), F.concat(F.lit("wört <part> "), F.col("id").cast("string")).alias("text"))
    began = time.time()
    out = format_chats(turns).select(F.size(read_turns(F.col("formatted"))).alias("n"), F.sha2(learnt_text(F.col("formatted"), F.col("loss_mask")), 256).alias("h"), "formatted").first()
    assert time.time() - began < 30
    assert out.n == n
    assert out.h == hashlib.sha256("".join(f"wört <part> {k}" for k in range(n) if roles[k % len(roles)] == "assistant").encode()).hexdigest()


def test_a_mask_of_another_text_is_refused(spark):
    from pyspark.sql import functions as F
    from sondage.llm.chat_format import format_chats, learnt_text

    out = format_chats(spark.createDataFrame([(1, 0, "assistant", "abc")], "conv_id long, turn long, role string, text string"))
    with pytest.raises(Exception, match="doesn't fit"):
        out.select(learnt_text(F.concat("formatted", F.lit("<turn>user<body>x<end>\n")), F.col("loss_mask"))).collect()
