"""Frames with every awkward row: nulls, empty and long texts, repeats, clashing columns."""

LONG = "lorem ipsum dolor sit amet " * 8000


def texts(spark, extra=()):
    rows = [(1, "plain words in a row that go on for a while"), (2, None), (3, ""), (4, LONG), (5, "plain words in a row that go on for a while"), (5, "plain words in a row that go on for a while"), (6, "éß 日本 😀 \n\n x"), (None, "no id at all"), *extra]
    # Columns whose names operators use inside.
    return spark.createDataFrame([(i, t, "s", 7, "r", 1) for i, t in rows], "doc_id long, text string, source string, score long, found string, id long")


def nothing(spark):
    return texts(spark).limit(0)
