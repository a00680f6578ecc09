"""The public read operations as queries over published documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import body_as
from ..operators import lifecycle, tree, versions
from ..operators import citations as C
from ..sources import bindings as B
from . import editions as E
from .contents import _LEAF
from .registry import register

_V = B.with_clauses(B.VERSIONS, B.VERSION_SECTIONS, E._DRAFT, E._DOCS)
_STEP = "CASE WHEN section_id % 3 = 2 AND section_id < 6 THEN section_id END"


def _published(spark, d):
    v = versions.published_versions(E.documents(spark, d), B.versions(spark, d))
    return v, versions.published_sections(B.versions(spark, d), B.version_sections(spark, d)).join(E.documents(spark, d).select("document_id", "slug"), "document_id")


@register("list_documents", _V + "SELECT slug, title, version_no, row_number() OVER (ORDER BY published_at DESC, document_id) AS place FROM docs JOIN versions USING (document_id) WHERE status = 'published' ORDER BY published_at DESC, document_id LIMIT 50")
def _(spark, d):
    top = versions.newest_published(_published(spark, d)[0], 50)
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("published_at"), "document_id")).cast("long")).select("slug", "title", "version_no", "place")


@register("get_document", _V + "SELECT slug, section_id, row_number() OVER (PARTITION BY slug ORDER BY order_index, section_id) AS position FROM pub JOIN docs USING (document_id) WHERE NOT hidden")
def _(spark, d):
    s = _published(spark, d)[1].select("slug", "section_id", "order_index", F.concat_ws("/", "slug", F.col("section_id").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent_id"))
    from pyspark.sql import Window

    return s.withColumn("position", F.row_number().over(Window.partitionBy("slug").orderBy("order_index", "section_id")).cast("long")).select("slug", "section_id", "position")


@register("get_section", _V + "SELECT slug, section_id, body FROM pub JOIN docs USING (document_id) WHERE NOT hidden AND section_id = 2")
def _(spark, d):
    return _published(spark, d)[1].filter("section_id = 2").select("slug", "section_id", body_as("json", json="body"))


@register("get_document_full", _V + f", w AS (SELECT p.*, d.slug, {_STEP} AS step FROM pub p JOIN docs d USING (document_id) WHERE NOT hidden), z AS (SELECT *, min(CASE WHEN step IS NOT NULL THEN order_index END) OVER (PARTITION BY document_id) AS f FROM w), t AS (SELECT *, CASE WHEN step IS NOT NULL THEN 'step-' || step WHEN f IS NULL OR order_index < f THEN 'front' ELSE 'back' END AS part FROM z) SELECT slug, part, string_agg('## ' || section_id || chr(10) || body, chr(10) || chr(10) ORDER BY order_index) AS text FROM t GROUP BY 1, 2")
def _(spark, d):
    s = _published(spark, d)[1].withColumn("step", F.when((F.col("section_id") % 3 == 2) & (F.col("section_id") < 6), F.col("section_id")))
    s = tree.parts_of(s, "document_id", "order_index").withColumn("_k", F.struct("slug", "part"))
    return lifecycle.assemble_documents(s, "_k", "order_index", F.col("section_id").cast("string"), F.col("body")).select("_k.slug", "_k.part", "text")


@register("get_quick_reference_guide", B.with_clauses(B.MENTIONS) + ", n AS (SELECT document_id, reference_id, row_number() OVER (PARTITION BY document_id ORDER BY min(pos), reference_id) AS number FROM mentions GROUP BY 1, 2) SELECT DISTINCT m.document_id, m.reference_id, n.number FROM mentions m JOIN n USING (document_id, reference_id)")
def _(spark, d):
    m = B.mentions(spark, d)
    return m.select("document_id", "reference_id").distinct().join(C.citation_numbers(m), ["document_id", "reference_id"])


@register("list_versions", _V + "SELECT slug, version_no, status, row_number() OVER (PARTITION BY slug ORDER BY version_no DESC) AS place FROM versions JOIN docs USING (document_id) WHERE status <> 'draft'")
def _(spark, d):
    v = versions.version_history(B.versions(spark, d).filter("status <> 'draft'"))
    return v.join(E.documents(spark, d).select("document_id", "slug"), "document_id").select("slug", "version_no", "status", "place")


@register("fetch", _V + "SELECT slug || '#' || section_id AS id, body AS text FROM pub JOIN docs USING (document_id) WHERE NOT hidden")
def _(spark, d):
    s = _published(spark, d)[1]
    asked = s.select(F.concat(F.col("slug"), F.lit("#"), F.col("section_id").cast("string")).alias("id"))
    want = asked.select("id", F.regexp_replace("id", "#[0-9]+$", "").alias("slug"), F.regexp_extract("id", "#([0-9]+)$", 1).cast("long").alias("section_id"))
    return want.join(s.select("slug", "section_id", F.col("body").alias("text")), ["slug", "section_id"]).select("id", "text")


@register("get_composed", _V + """, x AS (SELECT p.*, d.slug FROM pub p JOIN docs d USING (document_id) WHERE NOT hidden), a AS (SELECT document_id + 1 AS pair, section_id AS address, order_index FROM x), b AS (SELECT document_id AS pair, section_id AS address, order_index FROM x WHERE body = 'q1'),
  r AS (SELECT pair, address, order_index AS o, 'a' AS source, NULL AS own FROM a UNION ALL SELECT b.pair, b.address, a.order_index, 'b', b.order_index FROM b LEFT JOIN a USING (pair, address))
  SELECT pair, row_number() OVER (PARTITION BY pair ORDER BY o NULLS LAST, source, own, address) AS place, address, source FROM r""")
def _(spark, d):
    s = _published(spark, d)[1]
    cut = lambda pair: s.select(pair.alias("pair"), F.col("section_id").alias("address"), "order_index", (F.col("body") == "q1").alias("owned"))
    return versions.compose(cut(F.col("document_id") + 1), cut(F.col("document_id")))


@register("body_as", "SELECT l_orderkey, l_linenumber, l_comment_ AS body FROM (SELECT DISTINCT l_orderkey, l_linenumber, 'm' || l_partkey AS l_comment_ FROM lineitem)")
def _(spark, d):
    t = B.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("m"), "l_partkey").alias("markdown"), F.lit("h").alias("html"), F.lit("{}").alias("body_json")).distinct()
    return t.select("l_orderkey", "l_linenumber", body_as("markdown"))


@register("instructions_outline", """WITH core AS (SELECT 'n' || n_nationkey AS id, n_regionkey AS r, n_nationkey % 2 = 0 AS m FROM nation), c AS (SELECT 'c' || c_custkey AS id, n_regionkey AS r, n_nationkey % 2 = 0 AS m FROM customer JOIN nation ON n_nationkey = c_nationkey),
  o AS (SELECT 'o' || o_orderkey AS id, r, m FROM orders JOIN c ON c.id = 'c' || o_custkey)
  SELECT s_suppkey AS document_id, id, CAST(l AS BIGINT) AS level FROM supplier JOIN (SELECT id, r, 0 AS l FROM core WHERE m UNION ALL SELECT id, r, 1 FROM c WHERE m UNION ALL SELECT id, r, 2 FROM o WHERE m) ON r = s_suppkey % 5""")
def _(spark, d):
    sec = B.sections(spark, d).withColumn("apparatus", F.expr("id like 'n%' and key % 2 = 0"))
    asks = B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("document_id"), F.concat(F.lit("r"), F.col("s_suppkey") % 5).alias("template"))
    return tree.instructions_outline(tree.outline(sec), asks)


@register("draft_reading", _V + """, s AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY order_index, section_id) AS position FROM draft WHERE NOT hidden), c AS (SELECT l_orderkey AS version_id, CAST(l_linenumber AS BIGINT) AS section_id, l_suppkey AS reference_id FROM lineitem),
  m AS (SELECT d.document_id, c.section_id, c.reference_id FROM c JOIN versions d USING (version_id) WHERE status = 'draft'), n AS (SELECT document_id, reference_id, row_number() OVER (PARTITION BY document_id ORDER BY min(section_id), reference_id) AS number FROM m GROUP BY 1, 2),
  k AS (SELECT document_id, section_id, string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) AS cited FROM (SELECT DISTINCT m.document_id, m.section_id, n.number FROM m JOIN n USING (document_id, reference_id)) GROUP BY 1, 2)
  SELECT s.document_id, s.section_id, s.position, s.body, coalesce(k.cited, '') AS cited FROM s LEFT JOIN k USING (document_id, section_id)""")
def _(spark, d):
    draft, _p = E.sides(spark, d)
    v = B.versions(spark, d).filter("status = 'draft'").select("version_id", "document_id")
    cites = B.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").cast("long").alias("section_id"), F.col("l_suppkey").alias("reference_id")).join(v, "version_id")
    return versions.draft_reading(draft, C.citation_numbers(cites.withColumn("pos", F.col("section_id"))), cites)


@register("guide", B.with_clauses(B.MENTIONS, _LEAF) + ", k AS (SELECT DISTINCT document_id FROM leaf) SELECT document_id, 'section' AS kind, '' AS path FROM k WHERE document_id % 3 = 0 UNION ALL SELECT document_id, 'item', k || '.0' FROM leaf WHERE reference_id IS NOT NULL AND document_id % 3 <> 0")
def _(spark, d):
    from ..operators import nodes

    bodies = B.bodies(spark, d)
    marked = bodies.select("document_id", (F.col("document_id") % 3 == 0).alias("point_of_care"))
    return nodes.guide(marked, nodes.explode_body(bodies), ["citation"]).select("document_id", "kind", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))


_GUIDE = B.with_clauses(B.MENTIONS, _LEAF, """sec AS (
  SELECT doc_id, source, lang || ' ' || doc_id AS title, coalesce(lang = 'en', false) AS marked, doc_id % 4 + 1 AS step, min(doc_id) OVER (PARTITION BY source, doc_id % 4) = doc_id AS opens FROM documents)""", """entries AS (
  SELECT s.*, 'section' AS kind, '' AS path, NULL::BIGINT AS k FROM sec s WHERE marked
  UNION ALL SELECT s.*, 'item', CAST(k AS VARCHAR), k FROM sec s JOIN leaf ON document_id = doc_id WHERE reference_id IS NOT NULL AND NOT marked)""")


def _guide(spark, d):
    """Sources are documents whose sections are their texts, by steps; the texts' citations stand in check lists for use at
    the point of care, their other lines in lists that are not."""
    from pyspark.sql import Window

    from ..operators import nodes

    key = F.col("doc_id")
    opens = F.min("doc_id").over(Window.partitionBy("source", key % 4)) == key
    step = F.concat(F.lit("step-"), (key % 4 + 1).cast("string"))
    docs = B.read(spark, d, "documents").withColumn("address", F.when(opens, step).otherwise(F.concat_ws("/", step, key.cast("string"))))
    sections = docs.select(
        F.col("source").alias("document_id"), key.alias("section_id"), "address", F.concat("lang", F.lit(" "), key.cast("string")).alias("title"), (F.col("lang") == "en").alias("point_of_care"), key.alias("place")
    )
    as_list = lambda text, leaf, flag: F.replace(text, F.lit('{"type":"paragraph","content":[{"type":"%s"' % leaf), F.lit('{"type":"list","attrs":{"kind":"check","pointOfCare":%s},"content":[{"type":"%s"' % (flag, leaf)))
    body = B.bodies(spark, d).select(F.col("document_id").alias("section_id"), as_list(as_list(F.col("body_json"), "text", "false"), "citation", "true").alias("body_json"))
    said = B.mentions(spark, d).withColumnRenamed("document_id", "doc_id").join(docs.select("doc_id", "source"), "doc_id")
    numbers = C.citation_numbers(said.select(F.col("source").alias("document_id"), "reference_id", (key * 10**9 + F.col("pos")).alias("pos")))
    return nodes.guide_page(sections, nodes.explode_body(body, key="section_id"), numbers)


@register("guide_page", _GUIDE + """SELECT e.source AS document_id, e.doc_id AS section_id, e.kind, e.path, e.title, e.step, o.title AS step_title FROM entries e LEFT JOIN sec o ON o.source = e.source AND o.step = e.step AND o.opens""")
def _(spark, d):
    path = F.array_join(F.col("path").cast("array<string>"), ".").alias("path")
    return _guide(spark, d)[0].select("document_id", "section_id", "kind", path, "title", F.col("step").cast("long").alias("step"), "step_title")


@register("guide_references", _GUIDE + """, m AS (SELECT source, doc_id, reference_id, doc_id * 1000000000 + pos AS place FROM mentions JOIN documents ON doc_id = document_id),
  n AS (SELECT source, reference_id, row_number() OVER (PARTITION BY source ORDER BY min(place), reference_id) AS number FROM m GROUP BY 1, 2)
  SELECT DISTINCT n.source AS document_id, n.reference_id, n.number FROM n JOIN m USING (source, reference_id) WHERE m.doc_id IN (SELECT doc_id FROM entries)""")
def _(spark, d):
    return _guide(spark, d)[1].select("document_id", "reference_id", "number")
