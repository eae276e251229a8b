"""Small tables with every awkward row: nulls, empty and long texts, ties, repeats, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, `__text` string, shard int"


def documents(spark, texts):
    """texts: (doc_id, text) pairs; the other columns clash with names that operators might use."""
    rows = [(i, t, "en", "src", None if t is None else len(t), 1, "k", "x", 2) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


AWKWARD = [(1, None), (2, ""), (2, ""), (None, "some words stand here in a row"), (None, None), (5, "a"), (6, "x " * 40_000), (7, "a"), (8, " \t\n a \r\n")]
