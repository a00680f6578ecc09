"""The corpus tables as views over the given ones, each with the same view in SQL.

A binding is a function (spark, dir) -> DataFrame and, in SQL, the WITH clauses of the same name, so that an operator
and its SQL start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines that stand in so many documents are references.
COMMON = 4


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, pos, line): the lines of a document that are not blank; pos counts all lines from 0."""
    split = read(spark, path, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return split.select("doc_id", F.col("pos").cast("long").alias("pos"), F.trim("line").alias("line")).filter("line <> ''")


LINES = """lines AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, trim(line) AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line) <> '')"""


def sections(spark: SparkSession, path: str) -> DataFrame:
    """The tree region - nation - customer - order: (document_id, id, parent_id, address, title, order_index, hidden,
    added, ownership). A document is a region."""
    r = read(spark, path, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title"), F.col("r_regionkey").cast("long").alias("key"))
    n = read(spark, path, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name", F.col("n_nationkey").cast("long"))
    c = read(spark, path, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), "c_name", F.col("c_custkey").cast("long"))
    o = read(spark, path, "orders").select(F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey"), "o_orderpriority", F.col("o_orderkey").cast("long"))
    rows = r.union(n).union(c).union(o)
    return rows.select(
        "id", "parent_id", "title", F.col("key").cast("double").alias("order_index"), "key",
        F.when(F.col("id").startswith("c"), F.col("key") % 7 == 3).otherwise(F.lit(False)).alias("hidden"),
        F.when(F.col("id").startswith("o"), F.col("key") % 2 == 0).otherwise(F.lit(False)).alias("added"),
    )


SECTIONS = """sections AS (SELECT id, parent_id, title, CAST(key AS DOUBLE) AS order_index, key,
  (id LIKE 'c%' AND key % 7 = 3) AS hidden, (id LIKE 'o%' AND key % 2 = 0) AS added FROM (
  SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent_id, r_name AS title, CAST(r_regionkey AS BIGINT) AS key FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, n_nationkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, c_custkey FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderpriority, o_orderkey FROM orders))"""


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(version_id, document_id, version_no, status, published_at): the orders of a customer in time; the last is the
    draft, the one before it is published."""
    w = Window.partitionBy("o_custkey")
    o = read(spark, path, "orders").withColumn("version_no", F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")).cast("long")).withColumn("n", F.count("*").over(w))
    status = F.when(F.col("version_no") == F.col("n"), "draft").when(F.col("version_no") == F.col("n") - 1, "published").otherwise("archived")
    return o.select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("document_id"), "version_no", status.alias("status"), F.col("o_orderdate").alias("published_at"), F.col("o_orderpriority").alias("label"))


VERSIONS = """versions AS (SELECT o_orderkey AS version_id, o_custkey AS document_id, no AS version_no,
  CASE WHEN no = n THEN 'draft' WHEN no = n - 1 THEN 'published' ELSE 'archived' END AS status, o_orderdate AS published_at, o_orderpriority AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS no, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders))"""


def version_sections(spark: SparkSession, path: str) -> DataFrame:
    """(version_id, section_id, body, body_hash, hidden, order_index, chars): the lines of an order, one for each number."""
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    line = read(spark, path, "lineitem").withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    body = F.concat(F.lit("q"), F.floor(F.col("l_quantity") / 17).cast("long").cast("string"))
    return line.select(
        F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").cast("long").alias("section_id"), body.alias("body"), F.sha2(body, 256).alias("body_hash"),
        (F.col("l_returnflag") == "R").alias("hidden"), F.col("l_linenumber").cast("double").alias("order_index"), F.col("l_quantity").cast("long").alias("chars"),
    )


VERSION_SECTIONS = """version_sections AS (SELECT l_orderkey AS version_id, CAST(l_linenumber AS BIGINT) AS section_id, body, sha256(body) AS body_hash, l_returnflag = 'R' AS hidden,
  CAST(l_linenumber AS DOUBLE) AS order_index, CAST(l_quantity AS BIGINT) AS chars FROM (
  SELECT *, 'q' || CAST(floor(l_quantity / 17) AS BIGINT) AS body, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn FROM lineitem) WHERE rn = 1)"""


def reviews(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(reviews, pins): a review for each source, with one pin for each labelled document of it."""
    docs = read(spark, path, "documents")
    rev = docs.groupBy(F.col("source").alias("review_id")).agg(F.min("doc_id").alias("requested_at"), (F.min("doc_id") % 5).alias("version_id"))
    lab = read(spark, path, "labels").join(docs.select("doc_id", "source", "text"), "doc_id")
    decision = F.when(F.col("toxic") == 1, "changes_requested").when(F.col("quality") == 1, "approved")
    change = F.when(F.col("doc_id") % 3 == 0, "removed").otherwise("changed")
    return rev, lab.select(F.col("source").alias("review_id"), F.col("doc_id").alias("section_id"), decision.alias("decision"), change.alias("change"), F.sha2("text", 256).alias("body_hash"))


REVIEWS = """reviews AS (SELECT source AS review_id, min(doc_id) AS requested_at, min(doc_id) % 5 AS version_id FROM documents GROUP BY source),
pins AS (SELECT source AS review_id, doc_id AS section_id, CASE WHEN toxic = 1 THEN 'changes_requested' WHEN quality = 1 THEN 'approved' END AS decision,
  CASE WHEN doc_id % 3 = 0 THEN 'removed' ELSE 'changed' END AS change, sha256(text) AS body_hash FROM labels JOIN documents USING (doc_id))"""


def comments(spark: SparkSession, path: str) -> DataFrame:
    """(id, document_id, reply_to, kind, body, created_at, open): turn 0 of a conversation, and its replies."""
    t = read(spark, path, "conversations")
    return t.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("conv_id") % 50).alias("document_id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000).alias("reply_to"),
        F.when(F.col("conv_id") % 2 == 0, "suggestion").otherwise("comment").alias("kind"), F.col("text").alias("body"), F.col("turn").alias("created_at"), (F.col("conv_id") % 3 != 0).alias("open"),
    )


COMMENTS = """comments AS (SELECT conv_id * 1000 + turn AS id, conv_id % 50 AS document_id, CASE WHEN turn > 0 THEN conv_id * 1000 END AS reply_to,
  CASE WHEN conv_id % 2 = 0 THEN 'suggestion' ELSE 'comment' END AS kind, text AS body, turn AS created_at, conv_id % 3 <> 0 AS open FROM conversations)"""


def activity(spark: SparkSession, path: str) -> DataFrame:
    e = read(spark, path, "events")
    return e.select("event_id", F.col("user_id").alias("document_id"), F.col("event_type").alias("kind"), F.col("ts").alias("at"), "value", "props")


ACTIVITY = "activity AS (SELECT event_id, user_id AS document_id, event_type AS kind, ts AS at, value, props FROM events)"


def mentions(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, pos, reference_id): lines that at least COMMON documents hold are citations; the id is a hash."""
    every = lines(spark, path)
    common = every.groupBy("line").agg(F.countDistinct("doc_id").alias("n")).filter(F.col("n") >= COMMON).select("line")
    return every.join(common, "line").select(F.col("doc_id").alias("document_id"), "pos", F.substring(F.sha2("line", 256), 1, 12).alias("reference_id"))


def references(spark: SparkSession, path: str) -> DataFrame:
    """(id, document_id, citation): each common line, owned by the first document that holds it."""
    every = lines(spark, path).groupBy("line").agg(F.countDistinct("doc_id").alias("n"), F.min("doc_id").alias("document_id")).filter(F.col("n") >= COMMON)
    return every.select(F.substring(F.sha2("line", 256), 1, 12).alias("id"), "document_id", F.col("line").alias("citation"))


MENTIONS = LINES + f""",
common AS (SELECT line, min(doc_id) AS document_id FROM lines GROUP BY line HAVING count(DISTINCT doc_id) >= {COMMON}),
mentions AS (SELECT doc_id AS document_id, pos, substr(sha256(line), 1, 12) AS reference_id FROM lines JOIN common USING (line)),
refs AS (SELECT substr(sha256(line), 1, 12) AS id, document_id, line AS citation FROM common)"""


def quoted(text) -> Column:
    """A text as a JSON string."""
    return F.btrim(F.to_json(F.array(F.coalesce(text, F.lit("")))), F.lit("[]"))


def bodies(spark: SparkSession, path: str, said: DataFrame | None = None) -> DataFrame:
    """(document_id, body_json): a document's lines as a node tree; common lines are citation nodes. said: mentions(), where
    they are at hand."""
    at = lines(spark, path)
    cited = (mentions(spark, path) if said is None else said).select(F.col("document_id").alias("doc_id"), "pos", "reference_id")
    cited_node = F.concat(F.lit('{"type":"citation","attrs":{"referenceId":'), quoted("reference_id"), F.lit("}}"))
    node = F.when(F.col("reference_id").isNotNull(), cited_node).otherwise(F.concat(F.lit('{"type":"text","text":'), quoted("line"), F.lit("}")))
    para = at.join(cited, ["doc_id", "pos"], "left").select("doc_id", "pos", F.concat(F.lit('{"type":"paragraph","content":['), node, F.lit("]}")).alias("p"))
    joined = para.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: x["p"]), ",").alias("ps"))
    return joined.select(F.col("doc_id").alias("document_id"), F.concat(F.lit('{"type":"doc","content":['), "ps", F.lit("]}")).alias("body_json"))


def memberships(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, org_id, role): suppliers and customers in the team of their nation; team 0 is central."""
    ladder = F.array(*map(F.lit, ROLES))
    s = read(spark, path, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("user_id"), F.col("s_nationkey").cast("long").alias("org_id"), F.col("s_suppkey").cast("long").alias("k"), F.col("s_name").alias("name"))
    c = read(spark, path, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.col("c_nationkey").cast("long"), F.col("c_custkey").cast("long"), "c_name")
    return s.union(c).select("user_id", "org_id", "name", F.element_at(ladder, (F.abs("k") % 4 + 1).cast("int")).alias("role"))


ROLES = ("viewer", "member", "admin", "owner")
MEMBERSHIPS = """memberships AS (SELECT user_id, org_id, name, CASE k % 4 WHEN 0 THEN 'viewer' WHEN 1 THEN 'member' WHEN 2 THEN 'admin' ELSE 'owner' END AS role FROM (
  SELECT 's' || s_suppkey AS user_id, CAST(s_nationkey AS BIGINT) AS org_id, abs(s_suppkey) AS k, s_name AS name FROM supplier
  UNION ALL SELECT 'c' || c_custkey, CAST(c_nationkey AS BIGINT), abs(c_custkey), c_name FROM customer))"""


def with_clauses(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(names) + "\n"
