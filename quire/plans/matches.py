"""Queries of matching and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import matching as O
from ..sources import bindings as B
from .registry import register

_L = B.with_clauses(B.LINES)


@register("match_titles", """WITH p AS (SELECT p_partkey, p_brand, p_name, list_distinct(string_split(p_name, ' ')) AS t FROM part), q AS (SELECT p_partkey, p_brand, list_distinct([split_part(p_name, ' ', 1), lower(split_part(p_type, ' ', 1))]) AS t FROM part),
  a AS (SELECT p_partkey AS title_id, p_brand, len(t) AS na, unnest(t) AS token FROM q),
  b AS (SELECT p_partkey AS candidate_id, p_brand, length(p_name) AS l, len(t) AS nb, unnest(t) AS token FROM p), m AS (SELECT title_id, candidate_id, na, nb, l, count(*) AS n FROM a JOIN b USING (p_brand, token) GROUP BY ALL),
  j AS (SELECT *, n / (na + nb - n) AS j FROM m WHERE n / least(na, nb) >= 0.6 AND n / (na + nb - n) >= 0.25 AND (na > 1 OR nb <= 2))
  SELECT title_id, candidate_id, round(j, 9) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY j DESC, l, candidate_id) AS r FROM j) WHERE r = 1""")
def _(spark, d):
    p = B.read(spark, d, "part").withColumn("tokens", F.array_distinct(F.split("p_name", " ")))
    asked = F.array_distinct(F.array(F.split("p_name", " ")[0], F.lower(F.split("p_type", " ")[0])))
    return O.match_titles(p.select(F.col("p_partkey").alias("title_id"), "p_brand", asked.alias("tokens")), p.select(F.col("p_partkey").alias("candidate_id"), "p_brand", F.col("p_name").alias("title"), "tokens"), "p_brand")


@register("nearest_documents", """WITH n AS (SELECT p_partkey AS document_id, p_name AS title, unnest(string_split(p_name, ' ')) AS w FROM part), q AS (SELECT DISTINCT p_partkey AS query_id, unnest([substr(split_part(p_name, ' ', 1), 2), split_part(p_name, ' ', 2)]) AS word FROM part WHERE p_partkey % 20 = 0),
  s AS (SELECT query_id, word, document_id, title, max(CASE WHEN word = w THEN 1.0 WHEN length(word) > 3 AND abs(length(word) - length(w)) <= 1 AND levenshtein(word, w) = 1 THEN 0.75 WHEN length(word) > 4 AND starts_with(w, word) THEN 0.5 END) AS s FROM q, n GROUP BY 1, 2, 3, 4),
  t AS (SELECT query_id, document_id, title, round(sum(s), 6) AS score FROM s WHERE s IS NOT NULL GROUP BY 1, 2, 3)
  SELECT query_id, place, document_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, document_id) AS place FROM t) WHERE place <= 3""")
def _(spark, d):
    p = B.read(spark, d, "part")
    names = p.select(F.col("p_partkey").alias("document_id"), F.col("p_name").alias("title"), F.explode(F.split("p_name", " ")).alias("word"))
    w = F.split("p_name", " ")
    q = p.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.explode(F.array(F.expr("substring(split(p_name, ' ')[0], 2)"), w[1])).alias("word")).distinct()
    return O.nearest_documents(q, names)


@register("apply_placements", "SELECT p_partkey, p_brand, p_size, 'place-' || p_size % 7 AS target FROM part WHERE p_size % 4 <> 0")
def _(spark, d):
    rules = B.read(spark, d, "part").filter("p_size % 4 <> 0").select("p_brand", "p_size", F.concat(F.lit("place-"), F.col("p_size") % 7).alias("target")).distinct()
    return O.apply_placements(B.read(spark, d, "part").select("p_partkey", "p_brand", "p_size"), rules, ["p_brand", "p_size"])[0].select("p_partkey", "p_brand", "p_size", "target")


@register("apply_placements_rejects", "SELECT p_partkey, 'no rule' AS reason FROM part WHERE p_size % 4 = 0")
def _(spark, d):
    rules = B.read(spark, d, "part").filter("p_size % 4 <> 0").select("p_brand", "p_size").distinct()
    return O.apply_placements(B.read(spark, d, "part").select("p_partkey", "p_brand", "p_size"), rules, ["p_brand", "p_size"])[1].select("p_partkey", "reason")


_LISTS = "l AS (SELECT c_nationkey AS document_id, c_custkey AS list_id, CASE WHEN c_custkey % 3 = 0 THEN 'appendix' ELSE 'main' END AS kind, c_custkey % 40 AS a, c_custkey % 40 + 12 AS b, c_custkey % 30 AS n FROM customer)"


@register("reference_lists_for_page", "WITH " + _LISTS + """, p AS (SELECT n_nationkey AS document_id, CAST(g AS BIGINT) AS page FROM nation, range(0, 60) t(g)),
  h AS (SELECT p.document_id, p.page, l.list_id, row_number() OVER (PARTITION BY p.document_id, p.page ORDER BY CASE WHEN kind = 'appendix' THEN 0 ELSE 1 END, list_id) AS r FROM p JOIN l ON l.document_id = p.document_id AND p.page BETWEEN l.a AND l.b WHERE l.n >= CASE WHEN kind = 'main' THEN 20 ELSE 5 END)
  SELECT document_id, page, list_id FROM h WHERE r = 1""")
def _(spark, d):
    k = F.col("c_custkey")
    lists = B.read(spark, d, "customer").select(F.col("c_nationkey").alias("document_id"), k.alias("list_id"), F.when(k % 3 == 0, "appendix").otherwise("main").alias("kind"), (k % 40).alias("first_page"), (k % 40 + 12).alias("last_page"), (k % 30).alias("entries"))
    pages = B.read(spark, d, "nation").select(F.col("n_nationkey").alias("document_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"))).alias("page"))
    return O.reference_lists_for_page(lists, pages)


_BOX = "b AS (SELECT p_size AS page, CAST(p_partkey % 50 AS DOUBLE) AS x0, CAST(p_partkey % 70 AS DOUBLE) AS y0, p_partkey % 50 + 30.0 AS x1, p_partkey % 70 + 30.0 AS y1 FROM part), l AS (SELECT c_custkey, c_custkey % 50 AS page, c_custkey * 7 % 60 + 0.5 AS x0, c_custkey * 3 % 80 + 0.5 AS y0 FROM customer)"


def _geometry(spark, d):
    k, s = F.col("p_partkey"), F.col("c_custkey")
    num = lambda c: c.cast("double")
    boxes = B.read(spark, d, "part").select(F.lit(1).alias("doc"), F.col("p_size").alias("page"), num(k % 50).alias("x0"), num(k % 70).alias("y0"), num(k % 50 + 30).alias("x1"), num(k % 70 + 30).alias("y1"))
    at = B.read(spark, d, "customer").select("c_custkey", F.lit(1).alias("doc"), (s % 50).alias("page"), (num(s * 7 % 60) + 0.5).alias("x0"), (num(s * 3 % 80) + 0.5).alias("y0"))
    return at.withColumns({"x1": F.col("x0") + 5, "y1": F.col("y0") + 2}), boxes


_IN = "EXISTS (SELECT 1 FROM b WHERE b.page = l.page AND l.x0 >= b.x0 - 1 AND l.y0 >= b.y0 - 1 AND l.x0 + 5 <= b.x1 + 1 AND l.y0 + 2 <= b.y1 + 1)"


@register("lines_in_boxes", "WITH " + _BOX + f" SELECT c_custkey FROM l WHERE {_IN}")
def _(spark, d):
    return O.lines_in_boxes(*_geometry(spark, d)).select("c_custkey")


@register("lines_outside_boxes", "WITH " + _BOX + f" SELECT c_custkey FROM l WHERE NOT {_IN}")
def _(spark, d):
    return O.lines_in_boxes(*_geometry(spark, d), inside=False).select("c_custkey")


_AUDIT = _L.rstrip() + """, w AS (SELECT doc_id, pos, unnest(string_split(lower(line), ' ')) AS word FROM lines), p AS (SELECT doc_id, word, count(*) AS p FROM w WHERE word <> '' GROUP BY 1, 2), m AS (SELECT doc_id, word, count(*) AS m FROM (SELECT * FROM w WHERE pos % 5 <> 1 UNION ALL SELECT doc_id, pos, 'added' FROM w WHERE pos % 9 = 2) WHERE word <> '' GROUP BY 1, 2),
a AS (SELECT doc_id, word, least(coalesce(p, 0), coalesce(m, 0)) AS matched, greatest(coalesce(p, 0) - coalesce(m, 0), 0) AS missing, greatest(coalesce(m, 0) - coalesce(p, 0), 0) AS extra FROM p FULL JOIN m USING (doc_id, word))"""


def _audit(spark, d):
    # Lines are dealt by document before they are cut, so that no word is shuffled.
    every = B.lines(spark, d).repartition("doc_id").select("doc_id", "pos", F.explode(F.split(F.lower("line"), " ")).alias("word"))
    w = every.filter("word <> ''")
    model = w.filter("pos % 5 <> 1").unionByName(every.filter("pos % 9 = 2").withColumn("word", F.lit("added")))
    return O.coverage_audit(w, model, ["doc_id"])


@register("coverage_audit", _AUDIT + " SELECT * FROM a")
def _(spark, d):
    return _audit(spark, d)


@register("top_extras", _AUDIT + " SELECT word, CAST(sum(extra) AS BIGINT) AS extra FROM a GROUP BY 1 HAVING sum(extra) > 0 ORDER BY 2 DESC, 1 LIMIT 40")
def _(spark, d):
    return O.top_extras(_audit(spark, d))


@register("neighbour_fill", """WITH m AS (SELECT l_suppkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page, strftime(l_shipdate, '%Y') AS word, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3),
  e AS (SELECT l_suppkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page, strftime(l_shipdate, '%Y') AS word, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2, 3),
  f AS (SELECT m.*, least(m.n, coalesce(e.n, 0)) AS t FROM m LEFT JOIN e ON e.doc_id = m.doc_id AND e.page = m.page - 1 AND e.word = m.word), r AS (SELECT e.doc_id, e.page, e.word, e.n - coalesce(f.t, 0) AS n FROM e LEFT JOIN f ON f.doc_id = e.doc_id AND f.page = e.page + 1 AND f.word = e.word)
  SELECT f.doc_id, f.page, f.word, f.t + least(f.n - f.t, coalesce(r.n, 0)) AS filled FROM f LEFT JOIN r ON r.doc_id = f.doc_id AND r.page = f.page + 1 AND r.word = f.word WHERE f.t + least(f.n - f.t, coalesce(r.n, 0)) > 0""")
def _(spark, d):
    t = B.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("page"), F.date_format("l_shipdate", "yyyy").alias("word"), "l_returnflag")
    side = lambda f: t.filter(F.col("l_returnflag") == f).groupBy("doc_id", "page", "word").agg(F.count("*").alias("n"))
    return O.neighbour_fill(side("R"), side("A"))


_WL = "w AS (SELECT lang, length(w) AS size, count(*) AS n FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY 1, 2)"


def _sizes(spark, d):
    return B.read(spark, d, "documents").select("lang", "source", F.explode(F.split("text", " ")).alias("w")).filter("w <> ''").select("lang", "source", F.length("w").cast("long").alias("size"))


@register("weighted_mode", "WITH " + _WL + " SELECT lang, size, CAST(size * n AS BIGINT) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY size * n DESC, size) AS r FROM w) WHERE r = 1")
def _(spark, d):
    return O.weighted_mode(_sizes(spark, d), ["lang"], "size", "size")


@register("recurring_above", "WITH " + _WL + ", b AS (SELECT lang, size AS body FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY size * n DESC, size) AS r FROM w) WHERE r = 1) SELECT lang, size, n FROM w JOIN b USING (lang) WHERE size > body AND n >= 8")
def _(spark, d):
    return O.recurring_above(_sizes(spark, d), ["lang"], "size", "size")


@register("link_span_targets", """SELECT p_partkey AS span_id, 'https://Example.org/' || p_size || '/' AS address, CAST(length(p_name) + 1 AS BIGINT) AS start,
  CASE WHEN p_size % 2 = 0 THEN 'http://www.example.org/' || p_size END AS target FROM part
  UNION ALL SELECT p_partkey, 'http://other.net/x', CAST(length(p_name || ' https://Example.org/' || p_size || '/ and ') AS BIGINT), NULL FROM part""")
def _(spark, d):
    p = B.read(spark, d, "part")
    spans = p.select(F.col("p_partkey").alias("span_id"), F.concat("p_name", F.lit(" https://Example.org/"), "p_size", F.lit("/ and http://other.net/x.")).alias("text"))
    named = p.filter("p_size % 2 = 0").select(F.col("p_partkey").alias("span_id"), F.concat(F.lit("http://www.example.org/"), "p_size").alias("target"))
    return O.link_span_targets(spans, named.unionByName(p.select(F.col("p_partkey").alias("span_id"), F.lit("https://unrelated.org").alias("target"))))


@register("body_values", "WITH " + _WL + ", c AS (SELECT *, coalesce(sum(size * n) OVER (PARTITION BY lang ORDER BY size * n DESC, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(size * n) OVER (PARTITION BY lang) AS t FROM w) SELECT lang, size, CAST(size * n AS BIGINT) AS weight FROM c WHERE b < 0.85 * t")
def _(spark, d):
    return O.body_values(_sizes(spark, d), "lang", "size", "size")


@register("enriched_values", """WITH g AS (SELECT l_shipmode_ AS by_, l_suppkey AS v, sum(CAST(l_quantity AS BIGINT)) AS a, sum(CASE WHEN l_linenumber = 7 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS s FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem) GROUP BY 1, 2),
  h AS (SELECT *, a / sum(a) OVER (PARTITION BY by_) AS share, s / nullif(sum(s) OVER (PARTITION BY by_), 0) AS own, row_number() OVER (PARTITION BY by_ ORDER BY a DESC, v) AS place FROM g)
  SELECT by_ AS flag, v AS l_suppkey, round(own, 9) AS own, round(share, 9) AS share FROM h WHERE own >= 0.002 AND own > 1.2 * share AND place > 1""")
def _(spark, d):
    t = B.read(spark, d, "lineitem").withColumn("flag", F.concat("l_returnflag", "l_linestatus")).withColumn("q", F.col("l_quantity").cast("long"))
    return O.enriched_values(t, "flag", "l_suppkey", "q", F.col("l_linenumber") == 7, 0.002, 1.2)


@register("repeated_elements", _L + "SELECT line, count(DISTINCT doc_id) AS pages FROM lines GROUP BY 1 HAVING count(DISTINCT doc_id) >= 4")
def _(spark, d):
    return O.repeated_elements(B.lines(spark, d), "line", "doc_id")


@register("entry_lexicon", _L + r"SELECT entry, count(*) AS n FROM (SELECT unnest(regexp_extract_all(line, '([A-Z][a-z]+ License)', 1)) AS entry FROM lines) GROUP BY 1")
def _(spark, d):
    return O.entry_lexicon(B.lines(spark, d), "([A-Z][a-z]+ License)")


_NOTES = """notes AS (SELECT p_partkey AS note_id, CASE p_partkey % 4 WHEN 0 THEN 'please see ' || p_name WHEN 1 THEN 'at https://example.org/' || p_size || ' online' WHEN 2 THEN 'Ibid.' ELSE 'nothing' END AS before FROM part),
t AS (SELECT p_name AS name, min('#' || p_name) AS address FROM part WHERE p_size > 10 GROUP BY 1), r AS (SELECT note_id, before, t.address, CASE WHEN t.address IS NOT NULL THEN 'names a section' WHEN before LIKE '%https%' THEN 'prints an address' WHEN before = 'Ibid.' THEN 'repeats a note' ELSE 'no rule fits' END AS rule FROM notes LEFT JOIN t ON before = 'please see ' || t.name),
links AS (SELECT note_id, CASE rule WHEN 'names a section' THEN 'section' WHEN 'prints an address' THEN 'link' ELSE 'left' END AS outcome, CASE rule WHEN 'names a section' THEN address WHEN 'prints an address' THEN split_part(before, ' ', 2) END AS target, rule FROM r)"""


def _links(spark, d):
    p = B.read(spark, d, "part")
    k = F.col("p_partkey") % 4
    before = F.when(k == 0, F.concat(F.lit("please see "), "p_name")).when(k == 1, F.concat(F.lit("at https://example.org/"), "p_size", F.lit(" online"))).when(k == 2, "Ibid.").otherwise("nothing")
    return O.resolve_links(p.select(F.col("p_partkey").alias("note_id"), before.alias("before")), p.filter("p_size > 10").select(F.col("p_name").alias("name"), F.concat(F.lit("#"), "p_name").alias("address")).distinct())


@register("resolve_links", "WITH " + _NOTES + " SELECT * FROM links")
def _(spark, d):
    return _links(spark, d)


@register("link_resolution_audit", "WITH " + _NOTES + """, said AS (SELECT p_partkey AS note_id, p_name || ' ' || p_type AS text, length(p_name) + 2 AS p FROM part)
  SELECT note_id, CASE WHEN p > 6 THEN '…' ELSE '' END || substr(text, greatest(1, p - 5), least(length(text), p + 3) - greatest(1, p - 5) + 1) || CASE WHEN p + 3 < length(text) THEN '…' ELSE '' END AS around,
    outcome, CASE WHEN outcome <> 'left' THEN rule END AS rule, target, CASE WHEN outcome = 'left' THEN rule END AS reason FROM said JOIN links USING (note_id)""")
def _(spark, d):
    p = B.read(spark, d, "part").select(F.col("p_partkey").alias("note_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"), F.col("p_type").alias("link"))
    return O.link_resolution_audit(p, _links(spark, d), 5, 4)


@register("resolution_counts", "WITH " + _NOTES + " SELECT outcome, rule, count(*) AS n FROM links GROUP BY ROLLUP (outcome, rule)")
def _(spark, d):
    return O.resolution_counts(_links(spark, d))


@register("placement_summary", "SELECT p_brand AS document_id, count(*) FILTER (p_size % 3 = 0) AS matched, count(*) FILTER (p_size % 3 = 1) AS ruled, count(*) FILTER (p_size % 3 = 2) AS left_over FROM part GROUP BY 1")
def _(spark, d):
    how = F.when(F.col("p_size") % 3 == 0, "matched").when(F.col("p_size") % 3 == 1, "ruled").otherwise("left_over")
    return O.placement_summary(B.read(spark, d, "part").select(F.col("p_brand").alias("document_id"), how.alias("how")), ["matched", "ruled", "left_over"])


@register("origin_share", "SELECT l_orderkey AS section_id, l_suppkey AS origin, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS chars, round(sum(CAST(l_quantity AS BIGINT)) / sum(sum(CAST(l_quantity AS BIGINT))) OVER (PARTITION BY l_orderkey), 9) AS share FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return O.origin_share(B.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("section_id"), F.col("l_suppkey").alias("origin"), F.col("l_quantity").cast("long").alias("chars")))


@register("provenance", "SELECT l_orderkey AS section_id, l_suppkey AS legacy_section_id, CAST(s_nationkey AS BIGINT) AS legacy_document_id, CAST(l_quantity AS BIGINT) AS chars FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey")
def _(spark, d):
    origins = B.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("section_id"), F.col("l_suppkey").alias("legacy_section_id"), F.col("l_quantity").cast("long").alias("chars"))
    old = B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("legacy_section_id"), F.col("s_nationkey").cast("long").alias("legacy_document_id"))
    return O.provenance(B.read(spark, d, "orders").select(F.col("o_orderkey").alias("section_id")), origins, old, B.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("legacy_document_id")))


@register("fill_spanned", """WITH l AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS n, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2), v AS (SELECT *, CASE WHEN s % 3 = 0 THEN s END AS cell, s % 4 AS span FROM l)
  SELECT a.l_orderkey, a.n, b.cell AS filled FROM v a LEFT JOIN v b ON b.l_orderkey = a.l_orderkey AND b.n = (SELECT max(c.n) FROM v c WHERE c.l_orderkey = a.l_orderkey AND c.n <= a.n AND c.cell IS NOT NULL) AND a.n < b.n + b.span""")
def _(spark, d):
    t = B.read(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("n")).agg(F.min("l_suppkey").alias("s"))
    return O.fill_spanned(t.select("l_orderkey", "n", F.when(F.col("s") % 3 == 0, F.col("s")).alias("cell"), (F.col("s") % 4).alias("span")), ["l_orderkey"], "n", "cell", "span").select("l_orderkey", "n", "filled")


@register("merge_runs", """WITH f AS (SELECT o_custkey, o_orderkey, o_orderstatus, CASE WHEN lag(o_orderstatus) OVER w IS NOT DISTINCT FROM o_orderstatus THEN 0 ELSE 1 END AS new FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), r AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM f)
  SELECT o_custkey, CAST(run AS BIGINT) AS run, o_orderstatus, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS rows FROM r GROUP BY 1, 2, 3""")
def _(spark, d):
    return O.merge_runs(B.read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey", ["o_orderstatus"])


@register("join_wrapped_lines", _L.rstrip() + """, f AS (SELECT *, CASE WHEN coalesce(lag(length(line) % 3 = 0) OVER w, false) THEN 0 ELSE 1 END AS new FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f)
  SELECT doc_id, min(pos) AS first, string_agg(line, '' ORDER BY pos) AS text FROM r GROUP BY doc_id, run""")
def _(spark, d):
    return O.join_wrapped_lines(B.lines(spark, d), ["doc_id"], "pos", "line", F.length("line") % 3 == 0)


@register("figure_index", "SELECT l_orderkey, l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_extendedprice) AS figure FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey, l_extendedprice FROM lineitem)")
def _(spark, d):
    t = B.read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_extendedprice").distinct().withColumn("o", F.struct("l_orderkey", "l_partkey", "l_extendedprice"))
    return O.figure_index(t, ["l_suppkey"], "o").select("l_orderkey", "l_suppkey", "l_partkey", "figure")


@register("main_table", """WITH t AS (SELECT o_custkey AS chapter, o_orderkey AS table_id, CAST(o_totalprice AS BIGINT) AS rows, o_orderkey % 3 AS columns, o_orderstatus AS header FROM orders), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY rows DESC, table_id) AS r FROM t WHERE columns > 1) WHERE r = 1)
  SELECT t.chapter, t.table_id, t.table_id = m.table_id AS main FROM t JOIN m ON m.chapter = t.chapter AND m.header = t.header WHERE t.columns > 1""")
def _(spark, d):
    o = B.read(spark, d, "orders").select(F.col("o_custkey").alias("chapter"), F.col("o_orderkey").alias("table_id"), F.round("o_totalprice").cast("long").alias("rows"), (F.col("o_orderkey") % 3).alias("columns"), F.col("o_orderstatus").alias("header"))
    return O.main_table(o)


@register("dedupe_lines", _L + f"SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, regexp_replace(lower(line), '[^a-z0-9]+', '', 'g') ORDER BY pos) AS n FROM lines) WHERE n = 1")
def _(spark, d):
    return O.dedupe_lines(B.lines(spark, d), "doc_id", "pos", F.regexp_replace(F.lower("line"), "[^a-z0-9]+", "")).select("doc_id", "pos")


@register("subset_check", "SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda w: w NOT IN (lower(p_type), 'red', 'blue', 'green', lower(split_part(p_type, ' ', 1))))) = 0 AS subset FROM part")
def _(spark, d):
    p = B.read(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("a"), F.array(F.lower("p_type"), F.lit("red"), F.lit("blue"), F.lit("green"), F.lower(F.split("p_type", " ")[0])).alias("b"))
    return O.subset_check(p, "a", "b").select("p_partkey", "subset")


@register("fit_link_spans", "SELECT page_id AS span_id, url AS address, CAST(unnest([4, 16 + length(url)]) AS BIGINT) AS start FROM pages")
def _(spark, d):
    text = F.concat(F.lit("See "), "url", F.lit(", or again <"), "url", F.lit(">."))
    return O.fit_link_spans(B.read(spark, d, "pages").select(F.col("page_id").alias("span_id"), text.alias("text")))
