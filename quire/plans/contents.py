"""Queries of nested bodies and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intext
from ..operators import citations as C
from ..operators import nodes as O
from ..operators import render as R
from ..sources import bindings as B
from ..sources.settled import settle
from .registry import register

_LEAF = """leaf AS (SELECT l.doc_id AS document_id, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.pos) - 1 AS k, m.reference_id,
  CASE WHEN m.reference_id IS NULL THEN l.line END AS text
  FROM lines l LEFT JOIN mentions m ON m.document_id = l.doc_id AND m.pos = l.pos)"""
_L = B.with_clauses(B.MENTIONS, _LEAF)
_M = B.with_clauses(B.MENTIONS)


def nodes(spark, d):
    return O.explode_body(B.bodies(spark, d))


def _path(p="path"):
    return F.array_join(F.col(p).cast("array<string>"), ".").alias("path")


@register("explode_body", _L + """SELECT DISTINCT document_id, '' AS path, 'doc' AS type, NULL AS text FROM leaf UNION ALL SELECT document_id, CAST(k AS VARCHAR), 'paragraph', NULL FROM leaf
  UNION ALL SELECT document_id, k || '.0', CASE WHEN reference_id IS NULL THEN 'text' ELSE 'citation' END, text FROM leaf""")
def _(spark, d):
    return nodes(spark, d).select("document_id", _path(), "type", "text")


@register("plain_text", _L + r"SELECT document_id, string_agg(trim(regexp_replace(text, '\s+', ' ', 'g')), chr(10) ORDER BY k) AS text FROM leaf WHERE text IS NOT NULL GROUP BY 1")
def _(spark, d):
    return O.plain_text(nodes(spark, d))


@register("search_text", _L + r"""SELECT document_id, trim(regexp_replace(regexp_replace(string_agg(coalesce(text, '') || chr(10), '' ORDER BY k), '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'), ' ' || chr(10)) AS text
  FROM leaf GROUP BY 1""")
def _(spark, d):
    return O.search_text(nodes(spark, d))


@register("citations_in", _L + ", h AS (SELECT DISTINCT document_id FROM leaf), c AS (SELECT document_id, 0 AS s, 0 AS k, 'heading' AS reference_id FROM h UNION ALL SELECT document_id, 1, k, reference_id FROM leaf WHERE reference_id IS NOT NULL) SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY s, k) AS place, reference_id FROM c")
def _(spark, d):
    heads = B.bodies(spark, d).select("document_id", F.lit(0).alias("place"), F.lit("heading").alias("reference_id"))
    return O.citations_in(nodes(spark, d), heads)


@register("construct_counts", _L + "SELECT document_id, count(*) AS n_paragraph, count(text) AS n_text, count(reference_id) AS n_citation FROM leaf GROUP BY 1")
def _(spark, d):
    return O.construct_counts(nodes(spark, d), ["paragraph", "text", "citation"])


@register("validate_nodes", _L + "SELECT document_id, k || '.0' AS path, 'citation' AS type, 'paragraph' AS parent_type FROM leaf WHERE reference_id IS NOT NULL")
def _(spark, d):
    rules = spark.createDataFrame([(None, "doc"), ("doc", "paragraph"), ("paragraph", "text")], "parent_type string, type string")
    return O.validate_nodes(nodes(spark, d), rules).select("document_id", _path(), "type", "parent_type")


@register("content_hash", _L + """, n AS (
    SELECT DISTINCT document_id, [-1] AS o, '0' AS p, 'doc' AS t, '' AS x, '' AS a FROM leaf
    UNION ALL SELECT document_id, [k], '1', 'paragraph', '', '' FROM leaf
    UNION ALL SELECT document_id, [k, 0], '2', CASE WHEN reference_id IS NULL THEN 'text' ELSE 'citation' END, coalesce(text, ''),
      CASE WHEN reference_id IS NULL THEN '' ELSE '{"referenceId":"' || reference_id || '"}' END FROM leaf)
  SELECT document_id, sha256(string_agg(p || chr(31) || t || chr(31) || x || chr(31) || a || chr(31), chr(30) ORDER BY o)) AS content_hash FROM n GROUP BY 1""")
def _(spark, d):
    return O.content_hash(nodes(spark, d))


@register("repoint_citations", _L + "SELECT document_id, k || '.0' AS path, CASE WHEN reference_id < '8' THEN 'new-' || reference_id ELSE reference_id END AS reference_id FROM leaf WHERE reference_id IS NOT NULL")
def _(spark, d):
    moved = B.references(spark, d).filter("id < '8'").select(F.col("id").alias("old_id"), F.concat(F.lit("new-"), "id").alias("new_id"))
    return O.repoint_citations(nodes(spark, d), moved).select("document_id", _path(), "reference_id")


@register("open_items", _L + "SELECT document_id, 'citation' AS type, count(*) AS n FROM leaf WHERE reference_id IS NOT NULL GROUP BY 1")
def _(spark, d):
    return O.open_items(nodes(spark, d), ["citation", "checkbox"])


def _drafts(spark, d):
    """Bodies of documents' whole texts: every third has its alternatives standing, every second a placeholder, of which
    every fourth stands for the subject."""
    t = B.read(spark, d, "documents").filter("text is not null")
    label = F.when(F.col("doc_id") % 4 == 0, "[Cancer type].").otherwise("[name]")
    mark = F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.lit("placeholder").alias("type"), F.struct(label.alias("label")).alias("attrs"))))
    leaf = F.struct(F.lit("text").alias("type"), F.col("text"), mark.alias("marks"))
    block = F.struct(F.when(F.col("doc_id") % 3 == 0, "variants").otherwise("paragraph").alias("type"), F.array(leaf).alias("content"))
    return O.explode_body(t.select(F.col("doc_id").alias("document_id"), F.to_json(F.struct(F.lit("doc").alias("type"), F.array(block).alias("content"))).alias("body_json")))


@register("open_choices", "SELECT doc_id AS document_id, CAST(doc_id % 3 = 0 AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return O.open_choices(_drafts(spark, d))


@register("blocking_placeholders", "SELECT doc_id AS document_id, CAST(doc_id % 4 = 2 AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return O.blocking_placeholders(_drafts(spark, d))


@register("margin_notes", _L + "SELECT document_id, CAST(k AS VARCHAR) AS path, text AS note, false AS done FROM leaf WHERE text IS NOT NULL")
def _(spark, d):
    return O.margin_notes(nodes(spark, d), ["paragraph"]).select("document_id", _path("block"), "note", "done")


@register("timeframe_snapshot", _L + "SELECT document_id, k AS box, text AS statements FROM leaf WHERE trim(text) <> ''")
def _(spark, d):
    return O.timeframe_snapshot(nodes(spark, d))


_NUM = "num AS (SELECT document_id, reference_id, row_number() OVER (PARTITION BY document_id ORDER BY min(pos), reference_id) AS number FROM mentions GROUP BY 1, 2)"


@register("render_markdown", _L + "," + _NUM + r""", b AS (
    SELECT l.document_id, k, CASE WHEN l.reference_id IS NULL THEN regexp_replace(l.text, '([\\`*_\[\]<>])', '\\\1', 'g') ELSE '[^' || n.number || ']' END AS block
    FROM leaf l LEFT JOIN num n USING (document_id, reference_id))
  SELECT document_id, regexp_replace(string_agg(block, chr(10) || chr(10) ORDER BY k) FILTER (regexp_replace(block, '\s+', '', 'g') <> ''), '^\s+|\s+$', '', 'g') AS markdown FROM b GROUP BY 1""")
def _(spark, d):
    return R.render_markdown(nodes(spark, d), C.citation_numbers(B.mentions(spark, d)))


@register("diff_sizes", r"""SELECT doc_id, CAST(CASE WHEN c THEN 5 ELSE 0 END AS BIGINT) AS inserted, CASE WHEN c THEN length(w) ELSE 0 END AS deleted, c AS changed
  FROM (SELECT doc_id, w, coalesce(doc_id % 3 = 0 AND w <> '' AND w <> 'other', false) AS c FROM (SELECT doc_id, regexp_extract(text, '^(\S+) (\S+)', 2) AS w FROM documents))""")
def _(spark, d):
    t = B.read(spark, d, "documents").select("doc_id", F.substring("text", 1, 10**9).alias("old"))
    return O.diff_sizes(t.select("doc_id", "old", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("old", r"^([^\t\n\f\r ]+) [^\t\n\f\r ]+", "$1 other")).otherwise(F.col("old")).alias("new"))).select("doc_id", "inserted", "deleted", "changed")


@register("citation_numbers", _M + "," + _NUM + " SELECT * FROM num")
def _(spark, d):
    return C.citation_numbers(B.mentions(spark, d))


@register("missing_references", _M + "SELECT DISTINCT document_id, reference_id FROM mentions WHERE reference_id NOT IN (SELECT id FROM refs WHERE id >= '4')")
def _(spark, d):
    return C.missing_references(B.mentions(spark, d), B.references(spark, d).filter("id >= '4'"))


@register("where_cited", _M + "SELECT r.id AS reference_id, count(DISTINCT m.document_id) AS documents, count(m.pos) AS mentions FROM refs r LEFT JOIN mentions m ON m.reference_id = r.id GROUP BY 1")
def _(spark, d):
    return C.where_cited(B.mentions(spark, d), B.references(spark, d))


@register("citing_places", _M + """, said AS (SELECT DISTINCT document_id, reference_id FROM mentions), head AS (SELECT document_id, arg_min(reference_id, pos) AS reference_id FROM mentions GROUP BY 1)
  SELECT s.reference_id, d.source AS document_id, v.version_no, s.document_id AS address, v.version_no IS NULL AND h.reference_id = s.reference_id AS in_heading, true AS in_body
  FROM said s JOIN documents d ON d.doc_id = s.document_id JOIN head h ON h.document_id = s.document_id, (SELECT NULL::BIGINT AS version_no UNION ALL SELECT 2 UNION ALL SELECT 1) v
  WHERE s.reference_id >= '3'""")
def _(spark, d):
    """Sources are documents whose sections are their texts. Each has a draft, whose headings cite what the text cites first,
    two frozen editions without headings, and a version that is still a draft."""
    said = settle(B.mentions(spark, d))  # read for the headings, the bodies and the ids that are asked for
    head = said.groupBy(F.col("document_id").alias("doc_id")).agg(F.array(F.min_by("reference_id", "pos")).alias("head"))
    states = F.array(*(F.struct(F.lit(v).cast("long").alias("no"), F.lit(status).alias("status")) for v, status in ((None, "none"), (1, "archived"), (2, "published"), (3, "draft"))))
    docs = B.read(spark, d, "documents").select("doc_id", "source").join(head, "doc_id", "left")
    x = docs.select("*", F.explode(states).alias("v")).withColumn("section_id", F.concat_ws("/", "doc_id", F.coalesce("v.no", F.lit(0))))
    version = F.when(F.col("v.no").isNotNull(), F.concat_ws("/", "source", "v.no"))
    sections = x.select("section_id", F.col("source").alias("document_id"), version.alias("version_id"), F.col("doc_id").alias("address"), F.when(F.col("v.no").isNull(), F.col("head")).alias("title_citations"))
    versions = x.filter("v.no is not null").select(version.alias("version_id"), F.col("v.no").alias("version_no"), F.col("v.status").alias("status")).distinct()
    copies = O.explode_body(B.bodies(spark, d, said)).select("*", F.explode(F.array(*map(F.lit, range(4)))).alias("no"))
    asked = said.filter("reference_id >= '3'").select("reference_id").distinct()  # every reference is a line that is cited
    return C.citing_places(asked, sections, copies.withColumn("section_id", F.concat_ws("/", "document_id", "no")), versions)


@register("reference_successors", """WITH RECURSIVE v AS (SELECT o_orderkey AS id, lead(o_orderkey) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
  c AS (SELECT id, id AS latest, 0 AS steps FROM v UNION ALL SELECT c.id, v.nxt, steps + 1 FROM c JOIN v ON v.id = c.latest WHERE v.nxt IS NOT NULL)
  SELECT id, arg_max(latest, steps) AS latest, CAST(max(steps) AS BIGINT) AS steps FROM c GROUP BY 1""")
def _(spark, d):
    from pyspark.sql import Window

    o = B.read(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return C.reference_successors(o.select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(w).alias("supersedes")))


@register("deletable_references", _M + """, p AS (SELECT reference_id, list_sort(list(DISTINCT document_id))[1:5] AS p FROM mentions GROUP BY 1)
  SELECT id, p IS NULL AS deletable, coalesce(array_to_string(p, ','), '') AS places FROM refs LEFT JOIN p ON reference_id = id""")
def _(spark, d):
    return C.deletable_references(B.references(spark, d), B.mentions(spark, d))


@register("reference_register", _M + "," + _NUM + """, r AS (SELECT * FROM refs WHERE id >= '4'), o AS (SELECT CASE WHEN id < '6' THEN -1 ELSE document_id END AS document_id, id FROM r)
  SELECT n.document_id, n.reference_id, n.number, coalesce(o.document_id = n.document_id, false) AS own, o.id IS NULL AS missing, false AS unused FROM num n LEFT JOIN o ON o.id = n.reference_id
  UNION ALL SELECT o.document_id, o.id, NULL, true, false, true FROM o WHERE NOT EXISTS (SELECT 1 FROM mentions m WHERE m.document_id = o.document_id AND m.reference_id = o.id)""")
def _(spark, d):
    ref = B.references(spark, d).filter("id >= '4'").withColumn("document_id", F.when(F.col("id") < "6", F.lit(-1).cast("long")).otherwise(F.col("document_id")))
    return C.reference_register(B.mentions(spark, d), ref)


@register("reference_flags", _M + "," + _NUM + """, own AS (SELECT * FROM refs WHERE id >= '2'), chain AS (SELECT id, CASE WHEN id < 'a' THEN NULL ELSE (SELECT min(id) FROM refs) END AS supersedes FROM own),
  said AS (SELECT document_id, reference_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS sections FROM (SELECT DISTINCT document_id, reference_id, pos FROM mentions) GROUP BY 1, 2)
  SELECT n.document_id, n.reference_id, n.number, coalesce(o.document_id = n.document_id, false) AS own, o.id IS NULL AS missing, false AS unused, n.reference_id IN (SELECT supersedes FROM chain WHERE supersedes IS NOT NULL) AS superseded,
    EXISTS (SELECT 1 FROM mentions m WHERE m.document_id % 3 = 0 AND m.reference_id = n.reference_id) AS in_published, s.sections
  FROM num n LEFT JOIN own o ON o.id = n.reference_id JOIN said s ON s.document_id = n.document_id AND s.reference_id = n.reference_id
  UNION ALL SELECT o.document_id, o.id, NULL, true, false, true, o.id IN (SELECT supersedes FROM chain WHERE supersedes IS NOT NULL), EXISTS (SELECT 1 FROM mentions m WHERE m.document_id % 3 = 0 AND m.reference_id = o.id), ''
  FROM own o WHERE NOT EXISTS (SELECT 1 FROM mentions m WHERE m.document_id = o.document_id AND m.reference_id = o.id)""")
def _(spark, d):
    """Every third document is published; entries from "a" on supersede the first one."""
    ref, said = B.references(spark, d), B.mentions(spark, d)
    least = ref.agg(F.min("id").alias("_least"))
    own = ref.filter("id >= '2'").join(F.broadcast(least)).withColumn("supersedes", F.when(F.col("id") >= "a", F.col("_least")))
    return C.reference_flags(said, own, said.filter("document_id % 3 = 0"))


@register("reference_union", _M + "SELECT document_id, reference_id FROM mentions UNION SELECT document_id, id FROM refs")
def _(spark, d):
    return C.reference_union(B.mentions(spark, d), B.references(spark, d))


_EDIT = "e AS (SELECT id, document_id, citation || ' (revised)' AS citation, id < '8' AS frozen FROM refs)"


@register("supersede_references", _M + "," + _EDIT + " SELECT CASE WHEN frozen THEN substr(sha256(id || '/' || citation), 1, 12) ELSE id END AS id, document_id, citation, CASE WHEN frozen THEN id END AS supersedes FROM e")
def _(spark, d):
    ref = B.references(spark, d)
    edits = ref.select("id", F.concat("citation", F.lit(" (revised)")).alias("citation"))
    return C.supersede_references(ref.select("id", "document_id"), edits, ref.filter("id < '8'"))[0]


#: Fixed values of the SQL: names as they are listed (listed) and six forms in which each is cited (form, name, year).
_CITED = r"""listed AS (
  SELECT p_partkey AS reference_id, lower(p_type) AS list_id, CAST(1990 + p_size % 20 AS VARCHAR) AS year,
    CASE WHEN p_partkey % 7 = 0 THEN 'bof' || chr(CAST(97 + p_partkey % 13 AS INTEGER)) ELSE p_name || ' of ' || replace(lower(p_brand), '#', '') END AS name FROM part),
cited AS (
  SELECT reference_id * 10 + f AS mention, list_id, CASE f WHEN 5 THEN '1970' ELSE year END AS year, CASE f
    WHEN 0 THEN name WHEN 1 THEN split_part(name, ' ', 1) || CASE WHEN contains(name, ' ') THEN ' ' || split_part(name, ' ', 2) ELSE '' END
    WHEN 2 THEN left(split_part(name, ' ', 1), 1) || left(split_part(name, ' ', 2), 1) || left(split_part(name, ' ', 4), 1)
    WHEN 3 THEN 'new ' || name WHEN 4 THEN split_part(name, ' ', -1) WHEN 6 THEN 'bank of ' || name ELSE name END AS name
  FROM listed, range(7) t(f)),
keyed AS (SELECT *, list_transform(list_filter(string_split(name, ' '), lambda w: w NOT IN ('', 'of', 'and', 'the', 'for', 'on', 'in', 'to', 'a', 'an')), lambda w: left(w, 1)) AS i FROM listed),
asked AS (SELECT *, list_transform(list_filter(string_split(name, ' '), lambda w: w NOT IN ('', 'of', 'and', 'the', 'for', 'on', 'in', 'to', 'a', 'an')), lambda w: left(w, 1)) AS i FROM cited),
hits AS (
  SELECT mention, 0 AS rule, reference_id FROM asked a JOIN keyed k USING (list_id, name, year)
  UNION ALL SELECT mention, 1, reference_id FROM asked a JOIN keyed k USING (list_id, year) WHERE starts_with(k.name || ' ', a.name || ' ')
  UNION ALL SELECT mention, 2, reference_id FROM asked a JOIN keyed k USING (list_id, year) WHERE regexp_full_match(a.name, '[a-z]{2,7}') AND array_to_string(k.i, '') = a.name
  UNION ALL SELECT mention, 3, reference_id FROM asked a JOIN keyed k USING (list_id, year) WHERE contains(a.name, ' ') AND k.name = array_to_string(a.i, '')
  UNION ALL SELECT mention, 4, reference_id FROM asked a JOIN keyed k USING (list_id, year)
    WHERE CASE WHEN len(string_split(a.name, ' ')) >= 3 THEN string_split(a.name, ' ')[-3:] = string_split(k.name, ' ')[-3:] ELSE NOT contains(a.name, ' ') AND length(a.name) >= 8 AND split_part(k.name, ' ', -1) = a.name END
  UNION ALL SELECT mention, 5, reference_id FROM asked a JOIN keyed k USING (list_id, name)),
single AS (SELECT mention, rule, min(reference_id) AS r FROM hits GROUP BY 1, 2 HAVING count(DISTINCT reference_id) = 1),
first AS (SELECT mention, min(rule) AS rule, arg_min(r, rule) AS r FROM single GROUP BY 1),
near AS (SELECT mention, count(DISTINCT reference_id) FILTER (k.year = a.year) AS same, count(DISTINCT reference_id) AS any FROM asked a JOIN keyed k USING (list_id, name) GROUP BY 1)"""


@register("resolve_citations", "WITH " + _CITED + """
SELECT mention, f.r AS reference_id, CASE WHEN f.r IS NOT NULL THEN ['exact', 'prefix', 'initials', 'abbreviation', 'tail', 'year slip'][rule + 1]
  WHEN same > 1 THEN 'several entries' WHEN n.any > 0 THEN 'other years' ELSE 'no entry' END AS rule
FROM asked LEFT JOIN first f USING (mention) LEFT JOIN near n USING (mention)""")
def _(spark, d):
    """Every part is an entry and is cited in seven forms."""
    p = B.read(spark, d, "part")
    key = F.col("p_partkey")
    letter = F.char((97 + key % 13).cast("int"))
    name = F.when(key % 7 == 0, F.concat(F.lit("bof"), letter)).otherwise(F.concat("p_name", F.lit(" of "), F.replace(F.lower("p_brand"), F.lit("#"), F.lit(""))))
    keys = p.select(key.alias("reference_id"), F.lower("p_type").alias("list_id"), (1990 + F.col("p_size") % 20).cast("string").alias("year"), name.alias("name"))
    word = lambda n: F.coalesce(F.get(F.split("name", " "), n - 1), F.lit(""))
    initial = lambda n: F.substring(word(n), 1, 1)
    forms = [
        F.col("name"), F.concat_ws(" ", F.slice(F.split("name", " "), 1, 2)), F.concat(initial(1), initial(2), initial(4)), F.concat(F.lit("new "), "name"),
        F.element_at(F.split("name", " "), -1), F.col("name"), F.concat(F.lit("bank of "), "name"),
    ]
    each = keys.select("*", F.posexplode(F.array(*forms)).alias("f", "form"))
    mentions = each.select((F.col("reference_id") * 10 + F.col("f")).alias("mention"), "list_id", F.when(F.col("f") == 5, "1970").otherwise(F.col("year")).alias("year"), F.col("form").alias("name"))
    return C.resolve_citations(mentions, keys)


@register("undefined_markers", "SELECT DISTINCT l_suppkey AS list_id, CAST(l_linenumber AS BIGINT) AS number FROM lineitem WHERE l_returnflag = 'R' AND (l_suppkey, l_linenumber) NOT IN (SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_quantity > 48)")
def _(spark, d):
    t = B.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("list_id"), F.col("l_linenumber").cast("long").alias("number"), "l_returnflag", "l_quantity")
    return C.undefined_markers(t.filter("l_returnflag = 'R'").select("list_id", "number").distinct(), t.filter("l_quantity > 48"))


#: Fixed values of the SQL: what a document's text is followed by, so that every form of in-text citation occurs.
_SAID = """said AS (SELECT doc_id, text || ' As ' || n || '’s (' || y || ') model and the plan (' || y || ') say (see ' || n || ' et al. ' || y || 'a, ' || y || 'b; ' || m || ' & Wu ' || (y + 1)
  || ', ' || n || ' ' || (y + 2) || '; ' || (y + 3) || ') [adapted from ' || m || ' ' || y || ' ' || n || ' ' || (y + 4) || ', table 3, ' || (y + 5) || '] (March ' || y || ') (palliage ' || y || ' (' || m || '; ' || y || '))' AS text
  FROM (SELECT doc_id, text, 1990 + doc_id % 31 AS y, ['Smith', 'Müller', 'O’Neil', 'World Health Organization', 'van der Berg', 'Laidsaar-Powell'][1 + doc_id % 6] AS n, ['Lee', 'Garcia', 'Éluard', 'AIHW'][1 + doc_id % 4] AS m FROM documents))"""


@register("citation_parts", "WITH " + _SAID + r""",
found AS MATERIALIZED (SELECT doc_id, generate_subscripts(m, 1) AS bracket, unnest(m) AS m FROM (SELECT doc_id, regexp_extract_all(text,
  '(?:(\p{Lu}[\p{L}’''-]*(?: (?:&|and) \p{Lu}[\p{L}’''-]*)?(?: et al\.?)?)\s*)?(?:\[([^()\[\]]*)\]|\(([^()\[\]]*)\))') AS m FROM said)),
one AS (SELECT doc_id, bracket, regexp_extract(m, '^(.*?)\s*[(\[]', 1) AS before, trim(m[length(regexp_extract(m, '^[^(\[]*')) + 2:-2]) AS held FROM found),
good AS (SELECT *, regexp_full_match(held, '(?:19|20)[0-9]{2}[a-z]?(?:, *(?:19|20)[0-9]{2}[a-z]?)*') AS alone FROM one
  WHERE regexp_matches(held, '\b(?:19|20)[0-9]{2}[a-z]?\b') AND NOT regexp_full_match(held, '(?i:january|february|march|april|may|june|july|august|september|october|november|december) (?:19|20)[0-9]{2}')),
piece AS (SELECT doc_id, bracket, before, alone, generate_subscripts(string_split(held, ';'), 1) AS p, unnest(string_split(held, ';')) AS piece FROM good),
parted AS (SELECT *, regexp_split_to_array(piece, '\b(?:19|20)[0-9]{2}[a-z]?\b(?:, *\b(?:19|20)[0-9]{2}[a-z]?\b)*') AS heads,
  regexp_extract_all(piece, '\b(?:19|20)[0-9]{2}[a-z]?\b(?:, *\b(?:19|20)[0-9]{2}[a-z]?\b)*') AS years FROM piece),
head AS (SELECT doc_id, bracket, before, alone, p, generate_subscripts(heads, 1) AS k, trim(unnest(heads), ', ') AS head, unnest(years) AS years FROM parted),
named AS (SELECT *, CASE WHEN head <> '' AND (k = 1 OR regexp_full_match(head, '(?:\p{Lu}[\p{L}’''-]*|de|del|den|der|da|di|la|le|van|von|&|and|et al\.?)(?: (?:\p{Lu}[\p{L}’''-]*|de|del|den|der|da|di|la|le|van|von|&|and|et al\.?))*')) THEN head END AS new FROM head WHERE head IS NOT NULL),
carried AS (SELECT *, coalesce(last_value(new IGNORE NULLS) OVER (PARTITION BY doc_id, bracket ORDER BY p, k), CASE WHEN alone AND before <> '' THEN before END) AS name FROM named),
worded AS (SELECT doc_id, bracket, p, k, years, list_filter(string_split(trim(regexp_replace(lower(strip_accents(regexp_replace(regexp_replace(regexp_replace(name,
    '^(?i:see table [0-9]+ in|adapted from|summarised in|reviewed in|from|see|e\.g\.|cf\.|source|in)(?: *:)? +', ''), '(?i)\b(?:et|el|at) al\b\.?', ' ', 'g'), '’s?$|''s?$', ''))), '[^a-z0-9]+', ' ', 'g')), ' '),
    lambda w: w NOT IN ('', 'and')) AS words FROM carried WHERE years IS NOT NULL AND name IS NOT NULL),
dated AS (SELECT doc_id, bracket, p, k, array_to_string(CASE WHEN len(words) > 1 THEN list_filter(words, lambda w: length(w) > 1) ELSE words END, ' ') AS name,
  unnest(regexp_extract_all(years, '(?:19|20)[0-9]{2}[a-z]?')) AS year, generate_subscripts(regexp_extract_all(years, '(?:19|20)[0-9]{2}[a-z]?'), 1) AS j FROM worded)
SELECT doc_id, bracket, j AS at, name, year FROM dated WHERE name <> ''""")
def _(spark, d):
    """Whole texts of documents, each followed by every form in which print cites."""
    t = B.read(spark, d, "documents")
    key = F.col("doc_id")
    name = F.get(F.array(*map(F.lit, ("Smith", "Müller", "O’Neil", "World Health Organization", "van der Berg", "Laidsaar-Powell"))), (key % 6).cast("int"))
    other = F.get(F.array(*map(F.lit, ("Lee", "Garcia", "Éluard", "AIHW"))), (key % 4).cast("int"))
    said = F.format_string(
        " As %1$s’s (%3$d) model and the plan (%3$d) say (see %1$s et al. %3$da, %3$db; %2$s & Wu %4$d, %1$s %5$d; %6$d) [adapted from %2$s %3$d %1$s %7$d, table 3, %8$d] (March %3$d) (palliage %3$d (%2$s; %3$d))",
        name, other, *((1990 + key % 31 + n).cast("long") for n in (0, 1, 2, 3, 4, 5)),
    )
    parts = intext.citation_parts(t.select("doc_id", F.concat("text", said).alias("text")))
    return parts.select("doc_id", F.col("bracket").cast("long").alias("bracket"), F.col("at").cast("long").alias("at"), "name", "year")
