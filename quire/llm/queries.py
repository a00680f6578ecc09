"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import sql
from .common import table
from .models import quality_model, tokenizer_path, toxicity_model

QUERIES, ORACLE = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _spans(kinds: tuple[str, ...], order: tuple[str, ...], column: str = "found"):
    """kind:start:end of the spans whose kind is given, sorted by `order`, comma-joined."""
    found = F.filter(column, lambda x: x["kind"].isin(list(kinds)))
    rank = lambda x: F.array_position(F.array(*map(F.lit, kinds)), x["kind"]).alias("rank")
    place = {"start": lambda x: x["start"].alias("start"), "kind": rank}
    keyed = F.transform(found, lambda x: F.struct(*(place[o](x) for o in order), x["end"].alias("end"), x["kind"].alias("name")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["name"], x["start"], x["end"])), ",")


def _is(kind: str):
    return lambda x: x["kind"] == F.lit(kind)


def _counts(kinds: tuple[str, ...]):
    return [F.size(F.filter("found", _is(k))).cast("long").alias(f"n_{k}") for k in kinds]


@query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import KINDS, scan_secrets

    base, order = KINDS[:3], ("start", "kind")
    return scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", *_counts(base), F.sha2(_spans(base, order), 256).alias("base_sha256"), _spans(KINDS, order).alias("spans")
    )


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import settle
    from .packing import pack, pieces

    cut = settle(pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))
    return pack(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc_mod
    from .quality import score_quality

    scored = score_quality(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc_mod
    from .toxicity import score_toxicity

    scored = score_toxicity(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import linked

    return linked(table(spark, sf_dir, "documents"), n=3, percent=90)


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, scan_pii

    base, order = KINDS[:4], ("kind", "start")
    return scan_pii(table(spark, sf_dir, "documents")).select(
        "doc_id", *_counts(base), F.sha2(_spans(base, order), 256).alias("base_sha256"), _spans(KINDS, order).alias("spans")
    )


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode

    coded = encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "repaired", "exact")


@query
def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import settle
    from .licences import UNKNOWN, may_hold, scan_licences

    # A row is told by its number, as ids may be null or repeated; texts without a word of licences are not kept.
    docs = table(spark, sf_dir, "documents").select("doc_id", F.monotonically_increasing_id().alias("row"), F.when(may_hold("text"), F.col("text")).alias("text"))
    docs = settle(docs)
    found = scan_licences(docs.select("row", "text")).filter((F.col("family") != UNKNOWN) & F.col("confirmed"))
    per = found.groupBy("row").agg(
        F.count("*").alias("n_licences"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "family"))), lambda x: F.concat_ws(":", x["paragraph"], x["family"])), ",").alias("places"),
        F.max(F.round("probability", 6)).alias("probability"),
    )
    return docs.select("doc_id", "row").join(per, "row", "left").drop("row").na.fill({"n_licences": 0, "families": "", "places": ""})


#: Hits that a query gets.
HITS = 10


@query
def op4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 100 asks, with all its terms, for the others most like it."""
    from .search import top_k

    docs = table(spark, sf_dir, "documents")
    asks = docs.filter(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return top_k(docs, asks, HITS, exclude_self=True)


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import group_variants

    return group_variants(table(spark, sf_dir, "documents"))


@query
def op12_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pages import fitted, main_text

    pages = table(spark, sf_dir, "pages")
    return main_text(pages, fitted(pages))


@query
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, and what they say of texts whose case was changed."""
    from .common import crc_mod
    from .manifest import fold, leaf_of, manifest, siblings

    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = leaf_of(*(F.translate("text", upper, upper.lower()) if f == "text" else F.col(f) for f in fields))
    keep = {"doc_id": F.col("doc_id"), "tampered": F.when(crc_mod("doc_id", 3) == 0, changed)}
    made = manifest(table(spark, sf_dir, "documents"), fields, "lang", ["doc_id"], keep)
    folded = made.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE |= sql.ORACLE
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
