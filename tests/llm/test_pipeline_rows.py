"""The pipeline on awkward tables: nulls, empty and long texts, repeated rows, no rows, columns with clashing names."""

import pytest
from llm.helpers import LONG, texts
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")


def tables(spark, path, docs):
    """Documents with columns named as the stages name theirs, and labels of one kind, on which nothing is rejected."""
    extra = {c: F.lit(3) for c in ("_score", "_score_", "_key", "_spans", "_in", "_masked", "spans", "hash", "back", "component_id", "_t", "_row", "length", "start")}
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "found", "id").withColumns(extra)
    docs.write.parquet(f"{path}/documents.parquet")
    labels = spark.range(20).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    labels.write.parquet(f"{path}/labels.parquet")
    return docs


def test_every_stage_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline as c

    mail = "write to a.b@example.com or call"
    docs = tables(spark, tmp_path, texts(spark, [(None, mail), (9, mail + " 😀 +49 (30) 1234567"), (10, LONG + " x"), (10, "another text of the same id")]))
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in c.STAGES[:-1]:
        at = c.settle(stage(spark, at, str(tmp_path)))
        assert at.dtypes == docs.dtypes, name
    got = sorted(((r.doc_id or -1, r.text, r.n_chars) for r in at.collect()), key=str)
    # 5 is a copy of 1; one row of 10 is a near copy of 4, and both of its rows go.
    plain = "plain words in a row that go on for a while"
    want = [(1, plain, len(plain)), (2, None, 0), (3, "", 0), (4, LONG, len(LONG)), (6, "éß 日本 😀 \n\n x", 12), (-1, "no id at all", 12), (-1, "write to [EMAIL] or call", 24), (9, "write to [EMAIL] or call 😀 [PHONE]", 34)]
    assert got == sorted(want, key=str)
    packed = c.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {1, 2, 3, 4, 6, 9, None}
    assert packed.filter("doc_id = 2").first().doc_tokens == 1


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as c

    tables(spark, tmp_path, texts(spark).limit(0))
    assert c.run(spark, str(tmp_path)).count() == 0
