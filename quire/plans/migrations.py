"""Queries of the migration of printed documents. A part is a line, an entry, a row, a box and a section in turn."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import migration as M
from ..sources import bindings as B
from .registry import register


def _parts(spark, d):
    return B.read(spark, d, "part").withColumn("key", F.col("p_partkey").cast("long"))


def _first(column="p_name"):
    return F.substring_index(column, " ", 1)


# --- headings -----------------------------------------------------------------------------------------------------

_LINES = """lines AS (
  SELECT p_brand AS document_id, CAST(p_partkey AS BIGINT) AS line_no, p_name AS text, p_size % 8 + CASE WHEN p_partkey % 3 = 0 THEN 0.25 ELSE 0 END AS size,
    p_type AS colour, p_partkey % 2 = 0 AS bold, CASE WHEN p_size % 5 = 0 THEN p_partkey % 6 END AS tagged FROM part),
styles AS (SELECT DISTINCT p_brand AS document_id, p_partkey % 4 + 1 AS level, CAST(p_size % 8 AS DOUBLE) AS size, p_type AS colour, p_partkey % 2 = 0 AS bold FROM part WHERE p_size < 40)"""


@register("classify_lines", f"""WITH RECURSIVE {_LINES},
found AS (
  SELECT l.document_id, l.line_no, l.tagged, list_sort(list(DISTINCT s.level)) AS levels, row_number() OVER (PARTITION BY l.document_id ORDER BY l.line_no) AS n
  FROM lines l JOIN styles s ON s.document_id = l.document_id AND s.colour = l.colour AND s.bold = l.bold AND abs(s.size - l.size) <= 0.5 GROUP BY 1, 2, 3),
fold AS (
  SELECT DISTINCT document_id, 0 AS n, 0 AS level, CAST(NULL AS BIGINT) AS line_no FROM found
  UNION ALL SELECT f.document_id, h.n,
    CASE WHEN list_contains(h.levels, h.tagged) THEN h.tagged WHEN list_max(h.levels) > f.level THEN list_min(list_filter(h.levels, lambda v: v > f.level)) ELSE list_min(h.levels) END,
    h.line_no
  FROM fold f JOIN found h ON h.document_id = f.document_id AND h.n = f.n + 1)
SELECT document_id, line_no, CAST(level AS INT) AS level FROM lines LEFT JOIN fold USING (document_id, line_no)""")
def _(spark, d):
    p, k = _parts(spark, d), F.col("p_partkey")
    size = F.col("p_size") % 8
    lines = p.select(
        F.col("p_brand").alias("document_id"), F.col("key").alias("line_no"), F.col("p_name").alias("text"), (size + F.when(k % 3 == 0, 0.25).otherwise(0.0)).alias("size"),
        F.col("p_type").alias("colour"), (k % 2 == 0).alias("bold"), F.when(F.col("p_size") % 5 == 0, (k % 6).cast("int")).alias("tagged"),
    )
    styles = p.filter("p_size < 40").select(F.col("p_brand").alias("document_id"), (k % 4 + 1).cast("int").alias("level"), size.cast("double").alias("size"), F.col("p_type").alias("colour"), (k % 2 == 0).alias("bold"))
    return M.classify_lines(lines, styles.distinct())


# --- entries ------------------------------------------------------------------------------------------------------

_ENTRIES = """names AS (SELECT DISTINCT lower(p_name) AS k FROM part WHERE p_size < 20), roles AS (SELECT DISTINCT 'senior ' || lower(p_type) AS k FROM part WHERE p_size < 30),
halls AS (SELECT DISTINCT 'royal ' || p_name || ' hospital' AS a, split_part(p_name, ' ', 1) || ' centre' AS b FROM part WHERE p_size > 5),
whole AS (SELECT a AS k FROM halls UNION SELECT b FROM halls UNION SELECT a || ' ' || b FROM halls),
clauses AS (SELECT a AS k FROM halls UNION SELECT b FROM halls),
lines AS (
  SELECT p_partkey * 8 + f AS line_id, f, p_name, p_type, CASE f WHEN 3 THEN 'royal ' || p_name || ' hospital' WHEN 4 THEN 'royal ' || p_name WHEN 5 THEN split_part(p_name, ' ', 1) || ' centre'
    WHEN 6 THEN 'royal ' || p_name || ' hospital ' || split_part(p_name, ' ', 1) || ' centre' ELSE 'no' END AS k
  FROM part, range(8) t(f))"""


@register("entry_openings", f"""WITH {_ENTRIES}
SELECT line_id, CASE f WHEN 0 THEN true WHEN 1 THEN lower(p_name) IN (FROM names) OR 'senior ' || lower(p_type) IN (FROM roles)
    OR length(p_type) > 3 AND lower(p_type) IN (SELECT substr(k, 8) FROM roles) WHEN 2 THEN lower(p_name) IN (FROM names) WHEN 7 THEN length(p_type) > 3 AND lower(p_type) IN (SELECT substr(k, 8) FROM roles) ELSE false END AS person,
  k IN (FROM whole) AS complete, EXISTS (SELECT 1 FROM clauses c WHERE starts_with(c.k, lines.k || ' ')) AND length(k) >= 5 AS opens FROM lines""")
def _(spark, d):
    """Every part gives eight lines: persons by honorific, by role, by name, organisations whole, begun and listed, and a role."""
    p = _parts(spark, d)
    name, first = F.initcap("p_name"), F.initcap(_first())
    hall = F.concat(F.lit("Royal "), name, F.lit(" Hospital"))
    centre = F.concat(first, F.lit(" Centre"))
    role = F.concat(F.lit("Senior "), F.col("p_type"))
    lexicon = p.filter("p_size < 20").select(F.lit("name").alias("kind"), name.alias("text"))
    lexicon = lexicon.unionByName(p.filter("p_size < 30").select(F.lit("role").alias("kind"), role.alias("text")))
    lexicon = lexicon.unionByName(p.filter("p_size > 5").select(F.lit("entry").alias("kind"), F.concat_ws(", ", hall, centre).alias("text")))
    forms = [
        F.concat(F.lit("Dr "), name), F.concat_ws(", ", name, role), F.concat_ws(", ", name, F.lit("Nobody (x)")), hall,
        F.concat(F.lit(" royal "), name), centre, F.concat_ws("; ", hall, centre), F.concat_ws(", ", F.concat(F.lit("Xy van "), first), F.concat(F.lit("Deputy "), F.col("p_type"))),
    ]
    lines = p.select("key", F.posexplode(F.array(*forms)).alias("f", "text")).select((F.col("key") * 8 + F.col("f")).alias("line_id"), "text")
    return M.entry_openings(lines, lexicon.distinct())


# --- notes --------------------------------------------------------------------------------------------------------

RULES = [
    M.LinkRule("entry", r"^\s*(([\w ]+?)\s*\(entry\))\s*$", "entry"),
    M.LinkRule("named", r"\b(see ([\w ]+))$", "entry"),
    M.LinkRule("numbered", r"\b(section (\d+)\b\s*([\w ]*))$", "section", title=3),
]
#: The texts before the three notes of each part's block.
_WINDOWS = """windows AS (
  SELECT p_partkey AS document_id, f, p_brand, p_name, p_size, CASE f WHEN 0 THEN p_name || ' (entry)' WHEN 1 THEN ' as said: see ' || p_name WHEN 2 THEN ' and section ' || p_size || ' ' || split_part(p_name, ' ', 1) ELSE '' END AS before
  FROM part, range(4) t(f))"""


def _noted(spark, d):
    """Blocks with four notes, the last straight after the third."""
    p = _parts(spark, d)
    text = [F.concat("p_name", F.lit(" (entry)")), F.concat(F.lit(" as said: "), F.lit("see ")), F.col("p_name"), F.concat(F.lit(" and section "), "p_size", F.lit(" "), _first())]
    kinds = [("text", text[0]), ("note", None), ("text", text[1]), ("text", text[2]), ("note", None), ("text", text[3]), ("note", None), ("note", None), ("text", F.lit(" after"))]
    nodes = F.array(*(F.struct(F.array(F.lit(0), F.lit(i)).alias("path"), F.lit(k).alias("type"), (F.lit(None).cast("string") if t is None else t).alias("text")) for i, (k, t) in enumerate(kinds)))
    return p, M.note_windows(p.select(F.col("key").alias("document_id"), F.inline(nodes)))


@register("note_windows", f"WITH {_WINDOWS} SELECT document_id, '0.' || [1, 4, 6, 7][f + 1] AS path, before FROM windows")
def _(spark, d):
    return _noted(spark, d)[1].select("document_id", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "before")


@register("resolve_notes", f"""WITH {_WINDOWS},
entries AS (SELECT p_name AS name, min('#' || p_name) AS address FROM part WHERE p_size > 10 GROUP BY 1),
numbered AS (SELECT p_brand, p_size, arg_min(p_name, '/' || p_partkey) AS title, min('/' || p_partkey) AS address FROM part WHERE p_size % 2 = 0 GROUP BY 1, 2),
met AS (
  SELECT w.*, CASE f WHEN 2 THEN n.address ELSE e.address END AS address, ['entry', 'named', 'numbered'][f + 1] AS rule,
    CASE f WHEN 0 THEN before WHEN 1 THEN 'see ' || w.p_name WHEN 2 THEN 'section ' || w.p_size || ' ' || split_part(w.p_name, ' ', 1) END AS words,
    f = 2 AND NOT list_contains(string_split(n.title, ' '), split_part(w.p_name, ' ', 1)) AS other
  FROM windows w LEFT JOIN entries e ON e.name = w.p_name LEFT JOIN numbered n ON n.p_brand = w.p_brand AND n.p_size = w.p_size)
SELECT document_id * 10 + [1, 4, 6, 7][f + 1] AS note_id, CASE WHEN f < 3 AND address IS NOT NULL AND NOT other THEN 'resolved' ELSE 'left' END AS outcome,
  CASE WHEN f < 3 AND address IS NOT NULL AND NOT other THEN rule END AS rule, CASE WHEN f < 3 AND address IS NOT NULL AND NOT other THEN words END AS words,
  CASE WHEN f < 3 AND address IS NOT NULL AND NOT other THEN address END AS address,
  CASE WHEN f = 3 THEN 'nothing before the note' WHEN address IS NULL THEN 'no such target' WHEN other THEN 'the title is another one' END AS reason FROM met""")
def _(spark, d):
    p, windows = _noted(spark, d)
    notes = windows.join(p.select(F.col("key").alias("document_id"), "p_brand"), "document_id")
    notes = notes.select((F.col("document_id") * 10 + F.element_at("path", -1)).alias("note_id"), F.col("p_brand").alias("document_id"), "before")
    text = lambda c: F.lit(c).cast("string")
    entries = p.filter("p_size > 10").select(text(None).alias("document_id"), text("entry").alias("kind"), F.col("p_name").alias("name"), F.concat(F.lit("#"), "p_name").alias("address"), F.col("p_name").alias("title"))
    numbered = p.filter("p_size % 2 = 0").select(F.col("p_brand").alias("document_id"), text("section").alias("kind"), F.col("p_size").cast("string").alias("name"), F.concat(F.lit("/"), "p_partkey").alias("address"), F.col("p_name").alias("title"))
    return M.resolve_notes(notes, entries.unionByName(numbered), RULES)


# --- summary tables -----------------------------------------------------------------------------------------------

_TABLES = """numbered AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS row_no FROM part),
printed AS (SELECT p_brand AS document_id, row_no, CASE WHEN p_size % 9 > 0 THEN p_size % 9 END AS step, split_part(p_name, ' ', 1) || ' ' || lower(p_type) AS care_point,
    CASE WHEN row_no % 3 = 1 THEN 'patients should ' || p_name || ' within weeks' END AS statement FROM numbered),
filled AS (
  SELECT a.document_id, a.row_no, a.step, a.care_point, coalesce(a.statement, b.statement) AS statement
  FROM printed a LEFT JOIN printed b ON b.document_id = a.document_id AND b.row_no = a.row_no - 1 AND a.statement IS NULL WHERE coalesce(a.statement, b.statement) IS NOT NULL),
long AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(statement), '[^a-z0-9]+'), lambda w: length(w) > 3)) AS t FROM filled),
boxes AS (SELECT p_brand AS document_id, p_size % 9 AS step, list_distinct(list_filter(string_split_regex('within weeks patients ' || p_name || ' ' || lower(p_type), '[^a-z0-9]+'), lambda w: length(w) > 3)) AS t FROM part WHERE p_retailprice > 1000),
hit AS (
  SELECT DISTINCT l.document_id, l.row_no FROM long l JOIN boxes b ON b.document_id = l.document_id
  WHERE len(list_intersect(l.t, b.t)) >= 0.6 * len(l.t) - 1e-9 AND (l.step IS NULL OR l.step = b.step) OR l.step IS NOT NULL AND len(list_intersect(l.t, b.t)) = len(l.t)),
known AS (SELECT DISTINCT p_brand AS document_id, p_size % 9 AS step, split_part(p_name, ' ', 1) AS title, CAST(p_size % 9 AS VARCHAR) || '/' || split_part(p_name, ' ', 1) AS address FROM part WHERE p_size % 2 = 0),
free AS (SELECT l.* FROM long l WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.document_id = l.document_id AND hit.row_no = l.row_no)),
best AS (
  SELECT f.document_id, f.row_no, arg_min(k.address, (length(k.title), k.address)) AS address
  FROM free f JOIN known k ON k.document_id = f.document_id AND k.step = f.step AND list_contains(string_split(f.care_point, ' '), k.title) GROUP BY 1, 2),
fresh AS (
  SELECT f.document_id, f.row_no, f.care_point, f.statement, coalesce(k.address, f.step || '/timeframes') AS address, k.address IS NULL AS new
  FROM free f LEFT JOIN best k USING (document_id, row_no))"""


def _rows(spark, d):
    p = _parts(spark, d)
    row = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    said = F.when(F.col("row_no") % 3 == 1, F.concat(F.lit("patients should "), "p_name", F.lit(" within weeks")))
    step = (F.col("p_size") % 9).cast("int")
    rows = p.withColumn("row_no", row).select(F.col("p_brand").alias("document_id"), "row_no", F.when(step > 0, step).alias("step"), F.concat_ws(" ", _first(), F.lower("p_type")).alias("care_point"), said.alias("statement"), F.lit(2).alias("span"))
    boxes = p.filter("p_retailprice > 1000").select(F.col("p_brand").alias("document_id"), F.col("key").alias("box_id"), step.alias("step"), F.concat_ws(" ", F.lit("Within weeks, patients"), "p_name", "p_type").alias("text"))
    sections = p.filter("p_size % 2 = 0").select(F.col("p_brand").alias("document_id"), F.concat(step.cast("string"), F.lit("/"), _first()).alias("address"), step.alias("step"), _first().alias("title")).distinct()
    return M.table_rows_to_boxes(rows, boxes, sections)


@register("table_rows_to_boxes", f"""WITH {_TABLES} SELECT document_id, row_no, 'body' AS source, NULL AS address FROM hit
UNION ALL SELECT document_id, row_no, 'row', address FROM fresh""")
def _(spark, d):
    return _rows(spark, d)[0]


@register("new_boxes", f"WITH {_TABLES} SELECT document_id, address, row_no, care_point, statement, new FROM fresh WHERE address IS NOT NULL")
def _(spark, d):
    return _rows(spark, d)[1]


# --- whole documents ----------------------------------------------------------------------------------------------

#: Every part is a section of the template and a printed one, whose title is the same, longer, or another.
_IMPORT = """core AS (SELECT min(CAST(p_partkey AS BIGINT)) AS target, p_size % 7 AS step, p_name AS title FROM part GROUP BY 2, 3),
s AS (SELECT CAST(p_partkey AS BIGINT) AS section_id, p_brand AS document_id, p_type AS parent_id, p_size % 7 AS step, p_name AS body,
  CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || lower(p_type) ELSE 'appendix ' || lower(p_type) || ' ' || p_size END AS title FROM part),
ruled AS (SELECT section_id, document_id, CASE WHEN document_id = 'Brand#1' THEN -2 ELSE -1 END AS target FROM s WHERE title = 'red ring' OR title = 'blue bolt' AND document_id = 'Brand#1'),
equal AS (SELECT s.section_id, s.document_id, c.target FROM s JOIN core c USING (step, title) WHERE section_id NOT IN (SELECT section_id FROM ruled)),
rest AS (SELECT * FROM s WHERE section_id NOT IN (SELECT section_id FROM ruled UNION ALL SELECT section_id FROM equal)),
a AS (SELECT section_id, document_id, step, len(list_distinct(string_split(title, ' '))) AS na, unnest(list_distinct(string_split(title, ' '))) AS w FROM rest),
b AS (SELECT target, step, length(title) AS l, len(list_distinct(string_split(title, ' '))) AS nb, unnest(list_distinct(string_split(title, ' '))) AS w FROM core),
m AS (SELECT section_id, document_id, target, na, nb, l, count(*) AS n FROM a JOIN b USING (step, w) GROUP BY ALL),
j AS (SELECT *, n / (na + nb - n) AS j FROM m WHERE n / least(na, nb) >= 0.6 AND n / (na + nb - n) >= 0.25 AND (na > 1 OR nb <= 2)),
known AS (SELECT section_id, target, 'rule' AS how FROM ruled UNION ALL SELECT section_id, target, 'title' FROM equal
  UNION ALL SELECT section_id, target, 'words' FROM (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY j DESC, l, target) AS r FROM j) WHERE r = 1),
chain AS (SELECT s.*, target, how, last_value(target IGNORE NULLS) OVER (PARTITION BY document_id, parent_id ORDER BY section_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s LEFT JOIN known USING (section_id)),
placed AS (SELECT document_id, section_id, coalesce(target, before) AS target, CASE WHEN target IS NOT NULL THEN how ELSE 'sibling' END AS how, body FROM chain WHERE coalesce(target, before) IS NOT NULL),
printed AS (SELECT p.document_id, p.target, string_agg(body, chr(10) ORDER BY section_id) AS body, sha256(string_agg(body, chr(10) ORDER BY section_id)) AS body_hash FROM placed p GROUP BY 1, 2),
held AS (SELECT p.*, coalesce(p.body <> c.title, true) AS diverged FROM printed p LEFT JOIN core c ON c.target = p.target)"""


def _imported(spark, d):
    p = _parts(spark, d)
    size, step = F.col("p_size"), (F.col("p_size") % 7).cast("int").alias("step")
    words = lambda t: F.array_distinct(F.split(t, " "))
    title = F.when(size % 3 == 0, F.col("p_name")).when(size % 3 == 1, F.concat_ws(" ", "p_name", F.lower("p_type"))).otherwise(F.concat_ws(" ", F.lit("appendix"), F.lower("p_type"), size))
    sections = p.select(F.col("p_brand").alias("document_id"), F.col("key").alias("section_id"), F.col("p_type").alias("parent_id"), F.col("key").alias("order_index"), step, title.alias("title"), words(title).alias("tokens"), F.col("p_name").alias("body"))
    core = p.groupBy(step, F.col("p_name").alias("title")).agg(F.min("key").alias("target")).withColumn("tokens", words("title")).withColumn("body", F.col("title"))
    rules = spark.createDataFrame([(2, None, "Red ring", -1), (1, "Brand#1", "red  ring", -2), (1, "Brand#1", "Blue Bolt", -2)], "priority int, document_id string, title string, target long")
    return M.import_legacy(sections, core, rules)


@register("import_legacy", f"WITH {_IMPORT} SELECT document_id, section_id, target, how FROM placed")
def _(spark, d):
    return _imported(spark, d)["placed"]


@register("import_legacy_ledger", f"""WITH {_IMPORT} SELECT document_id, count(*) FILTER (how = 'rule') AS rule, count(*) FILTER (how = 'title') AS title,
  count(*) FILTER (how = 'words') AS words, count(*) FILTER (how = 'sibling') AS sibling FROM placed GROUP BY 1""")
def _(spark, d):
    return _imported(spark, d)["ledger"]


@register("import_legacy_versions", f"""WITH {_IMPORT} SELECT document_id, v AS version_no, target, CASE WHEN v = 1 OR diverged THEN body END AS body, body_hash, diverged
FROM held, (VALUES (1), (2)) t(v)""")
def _(spark, d):
    return _imported(spark, d)["version_sections"].drop("last_changed_version_no")


@register("import_legacy_rejects", f"WITH {_IMPORT} SELECT document_id, section_id, 'no place' AS reason FROM chain WHERE coalesce(target, before) IS NULL")
def _(spark, d):
    return _imported(spark, d)["rejects"]


@register("import_legacy_origins", f"""WITH {_IMPORT} SELECT document_id, section_id, target, CAST(length(body) AS BIGINT) AS chars,
  round(length(body) / sum(length(body)) OVER (PARTITION BY document_id, target), 9) AS share FROM placed""")
def _(spark, d):
    return _imported(spark, d)["origins"]
