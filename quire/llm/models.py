"""The classifiers and tokenizers that queries and the pipeline share."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import quality, toxicity
from .common import crc_mod, labelled_sample, table

#: Most labelled rows that a classifier is fitted on.
FIT_ROWS = 6000
#: Least scores of a document of good quality, and of a toxic one.
GOOD, TOXIC = 0.7, 0.5


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Network:
    return quality.train(labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", crc_mod("doc_id", 4) != 2, FIT_ROWS))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.train(labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", crc_mod("doc_id", 5) != 0, FIT_ROWS))
