"""The corpus pipeline: five stages from the documents table to packed sequences.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and returns the frame that is written
and read again as the next one's docs. Rows that share a doc_id are one document's rows and stay or go together in the
near-duplicate stage; rows without an id are in no group that loses rows and stay. Null and empty texts pass the stages
that score them like any other text; empty tables pass. Further columns pass through all stages but the last, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import jaccard, packing, pii
from quire.llm.common import append, settle
from quire.llm.models import GOOD, TOXIC, quality_model, tokenizer_path, toxicity_model


def keep_where(docs: DataFrame, scores, wanted) -> DataFrame:
    """The rows whose score (scores(texts) -> list) the condition `wanted` on its column accepts."""
    name = "_score"
    while name in docs.columns:
        name += "_"
    return append(docs, "text", name, "double", scores).filter(wanted(F.col(name))).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold."""
    model = toxicity_model(spark, sf_dir)
    return keep_where(docs, model.score, lambda score: score < TOXIC)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality reaches the threshold."""
    net = quality_model(spark, sf_dir)
    scores = lambda texts: net.score([(t or "").encode("utf-8", "replace") for t in texts])
    return keep_where(docs, scores, lambda score: score >= GOOD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents (five words, a similarity of 0.8), the one with the smallest doc_id."""
    classes = jaccard.linked(docs, n=5, percent=80)
    gone = settle(classes.filter("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data gives way to its kind in brackets; n_chars follows. Of overlapping spans the first
    is masked, and of equal starts the longest."""
    key = F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("_key")
    spans = pii.scan_pii(docs.select(key, "text"), "_key", "text").filter(F.size("found") > 0).dropDuplicates(["_key"])
    start = F.transform("found", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["end"].alias("end"), F.upper(x["kind"]).alias("kind")))
    text = F.col("_in.text")
    step = lambda a, x: F.when(
        x["start"] >= a["at"],
        F.struct(F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, (x["start"] - a["at"]).cast("int")), F.lit("["), x["kind"], F.lit("]")).alias("out"), x["end"].alias("at")),
    ).otherwise(a)
    rest = lambda a: F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, F.length(text)))
    masked = F.aggregate("_spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step, rest)
    # The documents' own columns stand in one, so that none of them clashes with those made here.
    joined = docs.select(F.struct(*docs.columns).alias("_in"), key).join(spans.select("_key", F.array_sort(start).alias("_spans")), "_key", "left").withColumn("_masked", masked)
    changed = {"text": F.col("_masked"), "n_chars": F.length("_masked").cast("long")}
    return joined.select(*(F.when(F.col("_spans").isNotNull(), changed[c]).otherwise(F.col("_in")[c]).alias(c) if c in changed else F.col("_in")[c].alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and the sequences that hold them."""
    cut = settle(packing.pieces(docs, tokenizer_path("word_bpe_49k.json")))
    return packing.pack(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Compression, convolution and packing have no form in SQL; the tests hold run() against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
