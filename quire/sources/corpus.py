"""Reading and writing corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .settled import release, settle

#: Columns of the corpus tables, as DDL; nested bodies stay text until an operator asks for them.
TABLES = {
    "documents": "document_id string, kind string, org_id string, slug string, partner_slug string, title string, subject string, audience string",
    "sections": "id string, document_id string, parent_id string, address string, title string, order_index double, step_number int, ownership string, core_section_id string, hidden boolean, added boolean, apparatus boolean, body_json string",
    "versions": "version_id string, document_id string, status string, version_no long, label string, release_notes string, published_at timestamp",
    "version_sections": "version_id string, section_id string, parent_address string, address string, title string, order_index double, hidden boolean, point_of_care boolean, body_json string, body_hash string, html string, markdown string, last_changed_version_no long",
    "reviews": "review_id string, document_id string, version_id string, requested_at timestamp",
    "review_sections": "review_id string, section_id string, change string, body_hash string, decision string",
    "comments": "id string, document_id string, section_id string, kind string, reply_to string, body string, author_id string, created_at timestamp, resolved_at timestamp",
    "references": "id string, document_id string, citation string, url string, supersedes string",
    "events": "id string, document_id string, kind string, actor_id string, detail string, at timestamp",
    "memberships": "user_id string, org_id string, role string, name string",
}


def load_corpus(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every corpus table below a folder with its fixed schema; nothing is inferred and unused columns are never read."""
    return {name: spark.read.schema(ddl).parquet(f"{path}/{name}") for name, ddl in TABLES.items()}


def read_models(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sections, blocks) of extracted documents, one JSON file each: {source, sections: [{id, title, blocks: [{type, text}],
    sections: [...]}]}. A file that is no JSON gives no rows.

    Sections are unfolded level by level; depth is bounded by the data."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("v")).filter("v is not null")
    level = files.select("file", F.array().cast("array<int>").alias("path"), F.posexplode(F.try_variant_get("v", "$.sections", "array<variant>")).alias("at", "s")).select("file", F.concat("path", F.array("at")).alias("path"), "s")
    found = []
    while True:
        level = settle(level)
        if level.isEmpty():
            if found:  # else the empty level is the result
                release(level)
            break
        found.append(level)
        level = level.select("file", "path", F.posexplode(F.try_variant_get("s", "$.sections", "array<variant>")).alias("at", "t")).select("file", F.concat("path", F.array("at")).alias("path"), F.col("t").alias("s"))
    every = found[0] if found else level
    for x in found[1:]:
        every = every.unionByName(x)
    sections = every.select("file", "path", F.try_variant_get("s", "$.id", "string").alias("id"), F.try_variant_get("s", "$.title", "string").alias("title"))
    blocks = every.select("file", "path", F.posexplode(F.try_variant_get("s", "$.blocks", "array<variant>")).alias("block", "b"))
    return sections, blocks.select("file", "path", "block", F.try_variant_get("b", "$.type", "string").alias("type"), F.try_variant_get("b", "$.text", "string").alias("text"))
