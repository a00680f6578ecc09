"""Queries of the tree operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import slugify
from ..operators import tree as O
from ..sources import bindings as B
from .registry import register

_OUT = """out AS (SELECT *, id AS root, 0 AS depth, [order_index] AS path, [id] AS ancestors, hidden AS off FROM sections WHERE parent_id IS NULL
  UNION ALL SELECT s.*, o.root, o.depth + 1, list_append(o.path, s.order_index), list_append(o.ancestors, s.id), o.off OR s.hidden FROM sections s JOIN out o ON s.parent_id = o.id)"""
_WITH = B.with_clauses(B.SECTIONS, _OUT, recursive=True)


def _outlined(spark, d):
    return O.outline(B.sections(spark, d))


@register("outline", _WITH + "SELECT id, root, CAST(depth AS BIGINT) AS depth, row_number() OVER (PARTITION BY root ORDER BY path, id) AS position, off FROM out")
def _(spark, d):
    return _outlined(spark, d).select("id", "root", F.col("depth").cast("long").alias("depth"), "position", "off")


@register("orphans_last", """WITH s AS (SELECT n_nationkey, n_regionkey, n_name FROM nation)
  SELECT 'n' || n_nationkey AS id, n_regionkey IN (3, 4) AS orphan, CASE WHEN n_regionkey NOT IN (3, 4) THEN 1 + row_number() OVER (PARTITION BY n_regionkey, n_regionkey IN (3, 4) ORDER BY n_nationkey) END AS position FROM s
  UNION ALL SELECT 'r' || r_regionkey, false, 1 FROM region WHERE r_regionkey NOT IN (3, 4)""")
def _(spark, d):
    sec = B.sections(spark, d).filter("id like 'n%' or id like 'r%'").filter("id not in ('r3', 'r4')")
    return O.orphans_last(O.outline(sec), sec).select("id", "orphan", "position")


@register("live_sections", _WITH + "SELECT id FROM out WHERE NOT off")
def _(spark, d):
    return O.live_sections(_outlined(spark, d)).select("id")


_TOPS = "SELECT id FROM sections WHERE id LIKE 'n%' AND key % 3 = 0 OR id LIKE 'c%' AND key % 50 = 0"


def _tops(spark, d):
    return B.sections(spark, d).filter("id like 'n%' and key % 3 = 0 or id like 'c%' and key % 50 = 0").select("id")


@register("subtree", _WITH + f"SELECT t.id AS top, o.id, CAST(o.depth - u.depth AS BIGINT) AS relative_depth FROM ({_TOPS}) t JOIN out u ON u.id = t.id JOIN out o ON list_contains(o.ancestors, t.id)")
def _(spark, d):
    return O.subtree(_outlined(spark, d), _tops(spark, d))


@register("root_of", _WITH + "SELECT id, root, coalesce(ancestors[2], root) AS part FROM out")
def _(spark, d):
    return O.root_of(_outlined(spark, d))


_HID = B.SECTIONS.replace("(id LIKE 'c%' AND key % 7 = 3) AS hidden", "(id LIKE 'c%' AND key % 7 = 3 OR id LIKE 'o%' AND key % 5 = 1 OR id = 'n4') AS hidden")


def _more_hidden(spark, d):
    return B.sections(spark, d).withColumn("hidden", F.expr("id like 'c%' and key % 7 = 3 or id like 'o%' and key % 5 = 1 or id = 'n4'"))


@register("topmost_hidden", B.with_clauses(_HID) + "SELECT s.id, s.parent_id FROM sections s LEFT JOIN sections p ON p.id = s.parent_id WHERE s.hidden AND NOT coalesce(p.hidden, false)")
def _(spark, d):
    return O.topmost_hidden(_more_hidden(spark, d)).select("id", "parent_id")


@register("visible_with_descendant", _WITH + "SELECT a AS id, max(has) AS visible FROM (SELECT unnest(ancestors) AS a, id LIKE 'o%' AND key % 11 = 0 AS has FROM out) GROUP BY 1")
def _(spark, d):
    return O.visible_with_descendant(_outlined(spark, d).withColumn("has", F.expr("id like 'o%' and key % 11 = 0")), "has")


@register("hide_subtrees", B.with_clauses(_HID, _OUT, recursive=True) + """, req AS (SELECT s.id, s.key % 2 = 0 AS hide, p.hidden AS up FROM sections s JOIN sections p ON p.id = s.parent_id WHERE s.id LIKE 'c%' AND s.key % 3 = 0),
  good AS (SELECT * FROM req WHERE hide OR NOT up)
  SELECT o.id, g.hide AS hidden FROM out o JOIN good g ON list_contains(o.ancestors, g.id) WHERE o.hidden <> g.hide""")
def _(spark, d):
    sec = _more_hidden(spark, d)
    return O.hide_subtrees(sec, O.outline(sec), sec.filter("id like 'c%' and key % 3 = 0").select("id", (F.col("key") % 2 == 0).alias("hide")))[0]


@register("hide_subtrees_rejects", B.with_clauses(_HID) + """SELECT s.id AS key, 'the parent is hidden' AS reason FROM sections s JOIN sections p ON p.id = s.parent_id WHERE s.id LIKE 'c%' AND s.key % 3 = 0 AND s.key % 2 = 1 AND p.hidden""")
def _(spark, d):
    sec = _more_hidden(spark, d)
    return O.hide_subtrees(sec, O.outline(sec), sec.filter("id like 'c%' and key % 3 = 0").select("id", (F.col("key") % 2 == 0).alias("hide")))[1]


def _moves(spark, d):
    sec = B.sections(spark, d)
    up = F.when(F.col("key") % 40 == 0, "none").when(F.col("key") % 20 == 0, F.col("id")).otherwise("n1")
    return sec.filter("id like 'c%' and key % 10 = 0").select("id", up.alias("parent_id"), F.lit(0.5).alias("order_index"))


_MOVES = "moves AS (SELECT id, CASE WHEN key % 40 = 0 THEN 'none' WHEN key % 20 = 0 THEN id ELSE 'n1' END AS new_parent FROM sections WHERE id LIKE 'c%' AND key % 10 = 0), asked AS (SELECT m.*, u.depth AS up, h.depth AS old, list_contains(u.ancestors, m.id) AS cyc FROM moves m LEFT JOIN out u ON u.id = m.new_parent LEFT JOIN out h ON h.id = m.id)"


@register("move_subtrees", B.with_clauses(B.SECTIONS, _OUT, _MOVES, recursive=True) + """SELECT o.id, CASE WHEN o.id = a.id THEN a.new_parent ELSE o.parent_id END AS parent_id, CASE WHEN o.id = a.id THEN 0.5 ELSE o.order_index END AS order_index, CAST(o.depth + a.up + 1 - a.old AS BIGINT) AS depth
  FROM asked a JOIN out o ON list_contains(o.ancestors, a.id) WHERE a.up IS NOT NULL AND NOT a.cyc""")
def _(spark, d):
    return O.move_subtrees(_outlined(spark, d), _moves(spark, d))[0]


@register("move_subtrees_rejects", B.with_clauses(B.SECTIONS, _OUT, _MOVES, recursive=True) + "SELECT id AS key, CASE WHEN up IS NULL THEN 'no such section' ELSE 'the parent is inside the subtree' END AS reason FROM asked WHERE up IS NULL OR cyc")
def _(spark, d):
    return O.move_subtrees(_outlined(spark, d), _moves(spark, d))[1]


_DEL = "tops AS (SELECT id FROM sections WHERE id LIKE 'o%' OR id LIKE 'c%' AND key % 5 = 0), below AS (SELECT t.id AS top, o.id, o.added FROM tops t JOIN (SELECT *, unnest(ancestors) AS a FROM out) o ON o.a = t.id), state AS (SELECT top, min(CASE WHEN NOT added THEN id END) AS blocker FROM below GROUP BY 1)"


def _deleted(spark, d):
    return O.delete_subtrees(_outlined(spark, d), B.sections(spark, d).filter("id like 'o%' or id like 'c%' and key % 5 = 0"))


@register("delete_subtrees", B.with_clauses(B.SECTIONS, _OUT, _DEL, recursive=True) + "SELECT DISTINCT b.id FROM below b JOIN state s USING (top) WHERE blocker IS NULL")
def _(spark, d):
    return _deleted(spark, d)[0]


@register("delete_subtrees_rejects", B.with_clauses(B.SECTIONS, _OUT, _DEL, recursive=True) + "SELECT top AS key, 'not added: ' || blocker AS reason FROM state WHERE blocker IS NOT NULL")
def _(spark, d):
    return _deleted(spark, d)[1]


@register("scaffold", """WITH core AS (SELECT 'r' || n_regionkey AS id, NULL AS parent_id, n_regionkey AS t, min(n_regionkey) AS o, 'region' AS title FROM nation GROUP BY n_regionkey
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_regionkey, n_nationkey, n_name FROM nation)
  SELECT s_suppkey AS document_id, substr(sha256(s_suppkey || '/' || id), 1, 16) AS id, CASE WHEN parent_id IS NOT NULL THEN substr(sha256(s_suppkey || '/' || parent_id), 1, 16) END AS parent_id, title, CAST(o AS DOUBLE) AS order_index, id AS source_id
  FROM supplier JOIN core ON t = s_suppkey % 5""")
def _(spark, d):
    n = B.read(spark, d, "nation")
    leaf = n.select(F.col("n_regionkey").alias("template"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("title"), F.col("n_nationkey").cast("double").alias("order_index"))
    top = n.groupBy(F.col("n_regionkey").alias("template")).agg(F.lit("region").alias("title")).select("template", F.concat(F.lit("r"), "template").alias("id"), F.lit(None).cast("string").alias("parent_id"), "title", F.col("template").cast("double").alias("order_index"))
    return O.scaffold(top.unionByName(leaf), B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("document_id"), (F.col("s_suppkey") % 5).alias("template")))


_STEP = "CASE WHEN l_linenumber % 3 = 2 AND l_linenumber < 6 THEN l_linenumber END"
_LINES = "l AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS n, CAST(min(" + _STEP + ") AS BIGINT) AS step FROM lineitem GROUP BY 1, 2)"


def _steps(spark, d):
    t = B.read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("n")).distinct()
    return t.withColumn("step", F.when((F.col("n") % 3 == 2) & (F.col("n") < 6), F.col("n")))


@register("band_of_roots", "WITH " + _LINES + """, w AS (SELECT *, last_value(step IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY n ROWS UNBOUNDED PRECEDING) AS b, max(CASE WHEN step IS NOT NULL THEN n END) OVER (PARTITION BY l_orderkey) AS z FROM l)
  SELECT l_orderkey, n, CASE WHEN b IS NULL THEN 'front' WHEN n > z THEN 'back' ELSE 'step-' || b END AS band FROM w""")
def _(spark, d):
    return O.band_of_roots(_steps(spark, d), "l_orderkey", "n").select("l_orderkey", "n", "band")


@register("parts_of", "WITH " + _LINES + """, w AS (SELECT *, min(CASE WHEN step IS NOT NULL THEN n END) OVER (PARTITION BY l_orderkey) AS z FROM l)
  SELECT l_orderkey, n, CASE WHEN step IS NOT NULL THEN 'step-' || step WHEN z IS NULL OR n < z THEN 'front' ELSE 'back' END AS part FROM w""")
def _(spark, d):
    return O.parts_of(_steps(spark, d), "l_orderkey", "n").select("l_orderkey", "n", "part")


@register("midpoint_order", """WITH s AS (SELECT c_nationkey AS p, c_custkey AS k, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS hi, min(c_custkey) OVER (PARTITION BY c_nationkey) AS low FROM customer)
  SELECT 'x' || k AS id, 'n' || p AS parent_id, CAST(CASE WHEN k % 4 = 0 THEN low - 1 WHEN hi IS NULL THEN k + 1 ELSE (k + hi) / 2 END AS DOUBLE) AS order_index FROM s""")
def _(spark, d):
    c = B.sections(spark, d).filter("id like 'c%'")
    new = c.select(F.concat(F.lit("x"), "key").alias("id"), "parent_id", F.when(F.col("key") % 4 != 0, F.col("id")).alias("after"))
    return O.midpoint_order(new, c)


@register("unique_addresses", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS i FROM part), r AS (SELECT p_partkey, p_brand, replace(lower(p_name), ' ', '-') AS base, i, max(i) OVER (PARTITION BY p_brand, p_name) AS z FROM n)
  SELECT p_partkey, CASE WHEN k + i = 1 THEN base ELSE base || '-' || (k + i) END AS address FROM (SELECT *, CASE WHEN p_brand LIKE '%1' THEN 3 ELSE 0 END AS k FROM r)""")
def _(spark, d):
    p = B.read(spark, d, "part").select("p_partkey", "p_brand", slugify("p_name").alias("base"))
    taken = p.filter("p_brand like '%1'").select("p_brand", F.explode(F.array("base", F.concat("base", F.lit("-3")))).alias("address")).distinct()
    return O.unique_addresses(p, taken, "p_brand", "base", "p_partkey").select("p_partkey", "address")


@register("add_nodes", """WITH s AS (SELECT n_regionkey AS p, max(n_nationkey) AS k FROM nation GROUP BY 1)
  SELECT 'x' || p || '-' || t AS id, 'r' || p AS parent_id, CASE WHEN t = 1 THEN 'INDIA' ELSE 'New part' END AS title, CAST(k + 1 AS DOUBLE) AS order_index, CAST(1 AS BIGINT) AS depth,
  CASE WHEN t = 1 AND EXISTS (SELECT 1 FROM nation WHERE n_regionkey = p AND n_name = 'INDIA') THEN 'india-2' WHEN t = 1 THEN 'india' ELSE 'new-part' END AS address FROM s, (VALUES (1), (2)) v(t)""")
def _(spark, d):
    sec = B.sections(spark, d).filter("id like 'r%' or id like 'n%'")
    last = sec.filter("id like 'n%'").groupBy("parent_id").agg(F.max_by("id", "key").alias("after"))
    new = last.select("parent_id", "after", F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.lit(x).alias("title")) for i, x in ((1, "INDIA"), (2, " New part "), (3, "  "))))).alias("x"))
    new = new.select(F.concat(F.lit("x"), F.substring("parent_id", 2, 9), F.lit("-"), "x.t").alias("id"), "parent_id", "after", "x.title")
    return O.add_nodes(O.outline(sec), new, slugify)[0]


@register("step_map", _WITH + """SELECT coalesce(ancestors[2], root) AS part, count(*) AS sections, CAST(sum(CASE WHEN id LIKE 'o%' THEN key % 3 ELSE 0 END) AS BIGINT) AS open_items, max(CASE WHEN id LIKE 'o%' THEN key END) AS updated FROM out GROUP BY 1""")
def _(spark, d):
    items = B.sections(spark, d).filter("id like 'o%'").select("id", (F.col("key") % 3).alias("open"), F.col("key").alias("updated"))
    return O.step_map(_outlined(spark, d), items)
