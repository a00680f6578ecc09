"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import bindings as B
from .registry import register

_FOLD = f"translate(lower({{0}}), '{T.ACCENTED}', '{T.PLAIN}')"
_KEY = "trim(regexp_replace(" + _FOLD + ", '[^a-z0-9]+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def _fold(x):
    return _FOLD.format(x)


def _key(x):
    return _KEY.format(x)


def _words(x):
    return f"list_filter(string_split({_key(x)}, ' '), lambda w: w <> '' AND w NOT IN ({_STOP}))"


_STEM = "CASE WHEN length(w) > 5 THEN regexp_replace(w, '(ing|ed|es|s)$', '') WHEN length(w) > 3 THEN regexp_replace(w, 's$', '') ELSE w END"


def _tokens(x):
    return f"list_distinct(list_transform({_words(x)}, lambda w: {_STEM}))"


@register("deterministic_id", """SELECT p_partkey, substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' ||
  substr('89ab', (('0x' || substr(h,17,1))::INT & 3) + 1, 1) || substr(h,18,3) || '-' || substr(h,21,12) AS id
  FROM (SELECT p_partkey, sha256('quire:part:' || p_partkey) AS h FROM part)""")
def _(spark, d):
    return B.read(spark, d, "part").select("p_partkey", T.deterministic_id("part", "p_partkey").alias("id"))


@register("slugify", f"""SELECT doc_id, pos, CASE WHEN length(s) <= 64 THEN s WHEN instr(substr(s,1,64), '-') > 0 THEN regexp_replace(substr(s,1,64), '-[^-]*$', '') ELSE substr(s,1,64) END AS slug
  FROM ({B.with_clauses(B.LINES)} SELECT doc_id, pos, regexp_replace(regexp_replace({_fold('line')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM lines)""")
def _(spark, d):
    return B.lines(spark, d).select("doc_id", "pos", T.slugify("line").alias("slug"))


@register("audit_words", f"""{B.with_clauses(B.LINES)} SELECT doc_id, pos, array_to_string(list_filter(string_split_regex(
  regexp_replace(regexp_replace(regexp_replace(lower(line), '([^\\p{{L}}\\p{{N}}\\s])', ' \\1 ', 'g'), '(\\p{{L}})(\\p{{N}})', '\\1 \\2', 'g'), '(\\p{{N}})(\\p{{L}})', '\\1 \\2', 'g'), '\\s+'), lambda w: w <> ''), ' ') AS words FROM lines""")
def _(spark, d):
    return B.lines(spark, d).select("doc_id", "pos", F.array_join(T.audit_words("line"), " ").alias("words"))


@register("normalise_key", f"{B.with_clauses(B.LINES)} SELECT doc_id, pos, {_key('line')} AS key FROM lines")
def _(spark, d):
    return B.lines(spark, d).select("doc_id", "pos", T.normalise_key("line").alias("key"))


@register("title_tokens", f"SELECT p_partkey, array_to_string(list_sort({_tokens('p_name')}), ' ') AS tokens FROM part")
def _(spark, d):
    return B.read(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(T.title_tokens("p_name")), " ").alias("tokens"))


def _pairs(spark, d):
    p = B.read(spark, d, "part").select("p_name", "p_type").distinct()
    return p.select("p_name", "p_type", T.title_tokens("p_name").alias("a"), T.title_tokens(F.concat_ws(" ", "p_type", "p_name")).alias("b"))


_PAIRS = f"pairs AS (SELECT DISTINCT p_name, p_type, {_tokens('p_name')} AS a, {_tokens(chr(40) + 'p_type || chr(32) || p_name' + chr(41))} AS b FROM part)"


@register("containment", f"WITH {_PAIRS} SELECT p_name, p_type, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0 END, 9) AS share FROM pairs")
def _(spark, d):
    return _pairs(spark, d).select("p_name", "p_type", F.round(T.containment("a", "b"), 9).alias("share"))


@register("jaccard", f"WITH {_PAIRS} SELECT p_name, p_type, round(CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 9) AS similarity FROM pairs")
def _(spark, d):
    return _pairs(spark, d).select("p_name", "p_type", F.round(T.jaccard("a", "b"), 9).alias("similarity"))


@register("initials_of", f"SELECT p_partkey, upper(array_to_string(list_transform({_words('p_name')}, lambda w: substr(w, 1, 1)), '')) AS initials FROM part")
def _(spark, d):
    return B.read(spark, d, "part").select("p_partkey", T.initials_of("p_name").alias("initials"))


_CITED = "'Reviewed in ' || s_name || ', (Smith and Jones, ' || (1990 + s_suppkey % 30) || ') and Lee et al. ' || (2000 + s_suppkey % 20)"


@register("author_year_keys", """SELECT s_suppkey, 'smith jones ' || (1990 + s_suppkey % 30) || '; lee ' || (2000 + s_suppkey % 20) AS keys FROM supplier""")
def _(spark, d):
    return B.read(spark, d, "supplier").select("s_suppkey", F.array_join(T.author_year_keys(F.expr(_CITED.replace("s_name", "'text'"))), "; ").alias("keys"))


@register("reference_key", "SELECT s_suppkey, 'omalley ' || (1990 + s_suppkey % 30) AS key FROM supplier")
def _(spark, d):
    text = F.concat(F.lit("OMalley R, Wu T. A title. Journal "), (F.col("s_suppkey") % 30 + 1990).cast("string"), F.lit("; 3:4"))
    return B.read(spark, d, "supplier").select("s_suppkey", T.reference_key(text).alias("key"))


@register("expand_markers", """SELECT l_orderkey, l_linenumber, n, CASE WHEN n < 20 THEN array_to_string(range(a, a + n + 1), ',') ELSE a || ',' || (a + n) END || ',' || b AS numbers FROM (
  SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_suppkey AS BIGINT) AS a, CAST(l_quantity AS BIGINT) AS n, CAST(l_linenumber AS BIGINT) AS b FROM lineitem)""")
def _(spark, d):
    t = B.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("a"), F.col("l_quantity").cast("long").alias("n")).distinct()
    marks = F.concat(F.col("a").cast("string"), F.lit("–"), (F.col("a") + F.col("n")).cast("string"), F.lit(", "), F.col("l_linenumber").cast("string"))
    return t.select("l_orderkey", "l_linenumber", "n", F.array_join(T.expand_markers(marks), ",").alias("numbers"))


_BARE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '^[hH][tT][tT][pP][sS]?://', ''), '^[wW][wW][wW]\\.', ''), '[?#].*$', ''), '/+$', '')"
_ADDRESS = f"lower(string_split({_BARE}, '/')[1]) || substr({_BARE}, length(string_split({_BARE}, '/')[1]) + 1)"


@register("address_key", f"SELECT page_id, {_ADDRESS} AS key FROM pages")
def _(spark, d):
    return B.read(spark, d, "pages").select("page_id", T.address_key("url").alias("key"))


@register("same_address", f"""WITH k AS (SELECT page_id, {_ADDRESS} AS x, lower(string_split({_BARE}, '/')[1]) AS y FROM pages)
  SELECT page_id, x = y OR starts_with(x, y || '/') OR starts_with(y, x || '/') AS same FROM k""")
def _(spark, d):
    host = F.concat(F.lit("HTTPS://WWW."), F.regexp_replace(F.regexp_extract("url", "^(?i:https?)://([^/?#]+)", 1), "^www\\.", ""), F.lit("/"))
    return B.read(spark, d, "pages").select("page_id", T.same_address("url", host).alias("same"))


@register("edition_of", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS INT) END AS edition FROM part")
def _(spark, d):
    said = F.when(F.col("p_size") % 3 == 1, F.concat_ws(" ", "p_name", F.lit("("), F.concat("p_size", F.lit("th")), F.lit("Edition)"))).when(
        F.col("p_size") % 3 == 2, F.concat("p_name", F.lit(" "), "p_size", F.lit("nd edition"))).otherwise(F.col("p_name"))
    return B.read(spark, d, "part").select("p_partkey", T.edition_of(said).alias("edition"))


@register("publication_date", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') END AS published FROM orders""")
def _(spark, d):
    o = B.read(spark, d, "orders")
    said = F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("First published in May 1971. Published in "), F.date_format("o_orderdate", "MMMM yyyy"))).otherwise("nothing")
    name = F.when(F.col("o_orderkey") % 3 == 2, F.concat(F.lit("guide-"), F.date_format("o_orderdate", "yyyy-MM"), F.lit(".pdf"))).otherwise("guide.pdf")
    return o.select("o_orderkey", T.publication_date(said, name).cast("string").alias("published"))


@register("page_span", "SELECT l_orderkey, CASE WHEN min(l_linenumber) = max(l_linenumber) THEN CAST(min(l_linenumber) AS VARCHAR) ELSE min(l_linenumber) || '-' || max(l_linenumber) END AS pages FROM lineitem GROUP BY 1")
def _(spark, d):
    low = B.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"))
    return low.select("l_orderkey", T.page_span("a", "b").alias("pages"))


@register("step_of_address", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS INT) END AS step FROM part")
def _(spark, d):
    address = F.concat(F.when(F.col("p_partkey") % 2 == 0, "step-").otherwise("stepping-"), "p_size", F.lit("/a"))
    return B.read(spark, d, "part").select("p_partkey", T.step_of_address(address).alias("step"))


_HEX = "substr(sha256(p_name || p_partkey), 1, 6)"


def _channels(at):
    return "(('0x' || substr(h, %d, 2))::INT / 255.0)" % at


@register("colour_family", f"""WITH h AS (SELECT p_partkey, {_HEX} AS h FROM part), v AS (SELECT p_partkey, {_channels(1)} AS r, {_channels(3)} AS g, {_channels(5)} AS b FROM h),
  w AS (SELECT *, greatest(r, g, b) AS t, greatest(r, g, b) - least(r, g, b) AS d FROM v),
  u AS (SELECT *, 60 * CASE WHEN d = 0 THEN 0 WHEN t = r THEN (g - b) / d + CASE WHEN g < b THEN 6 ELSE 0 END WHEN t = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END AS hue FROM w)
  SELECT p_partkey, CASE WHEN d < 0.08 THEN 'grey' WHEN hue < 30 THEN 'red' WHEN hue < 75 THEN 'yellow' WHEN hue < 165 THEN 'green' WHEN hue < 255 THEN 'blue' WHEN hue < 330 THEN 'purple' ELSE 'red' END AS family FROM u""")
def _(spark, d):
    p = B.read(spark, d, "part").select("p_partkey", F.substring(F.sha2(F.concat("p_name", "p_partkey"), 256), 1, 6).alias("h"))
    return p.select("p_partkey", T.colour_family("h").alias("family"))


def _lin(at):
    x = _channels(at)
    return f"(CASE WHEN {x} <= 0.03928 THEN {x} / 12.92 ELSE pow(({x} + 0.055) / 1.055, 2.4) END)"


@register("contrast", f"""WITH h AS (SELECT p_partkey, {_HEX} AS h FROM part), l AS (SELECT p_partkey, 0.2126 * {_lin(1)} + 0.7152 * {_lin(3)} + 0.0722 * {_lin(5)} AS a FROM h)
  SELECT p_partkey, round(1.05 / (a + 0.05), 6) AS ratio FROM l""")
def _(spark, d):
    p = B.read(spark, d, "part").select("p_partkey", F.substring(F.sha2(F.concat("p_name", "p_partkey"), 256), 1, 6).alias("h"))
    return p.select("p_partkey", F.round(T.contrast("h", F.lit("#ffffff")), 6).alias("ratio"))


@register("statement_coverage", f"""WITH b AS (SELECT item_id, list_sort(list_distinct(list_filter(string_split({_key('text')}, ' '), lambda w: w <> ''))) AS w FROM benchmark),
  s AS (SELECT item_id, list_filter(w, lambda x: length(x) > 3) AS long, w[1:10] AS body, item_id % 2 = 0 AS same FROM b)
  SELECT item_id, CASE WHEN len(long) > 0 THEN len(list_intersect(long, body)) / len(long) ELSE 0 END >= CASE WHEN same THEN 0.6 ELSE 1 END AS covered FROM s""")
def _(spark, d):
    b = B.read(spark, d, "benchmark").select("item_id", F.array_sort(F.array_distinct(F.filter(F.split(T.normalise_key("text"), " "), lambda w: w != ""))).alias("w"))
    return b.select("item_id", T.statement_coverage("w", F.slice("w", 1, 10), F.col("item_id") % 2 == 0).alias("covered"))


@register("clean_url", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE url END AS url FROM pages")
def _(spark, d):
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("ftp://"), "url")).otherwise(F.concat(F.lit("  "), "url", F.lit(" ")))
    return B.read(spark, d, "pages").select("page_id", T.clean_url(raw).alias("url"))


@register("clean_citation", f"{B.with_clauses(B.LINES)} SELECT doc_id, pos, CASE WHEN length(t) <= 400 THEN t END AS citation FROM (SELECT doc_id, pos, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS t FROM lines)")
def _(spark, d):
    return B.lines(spark, d).select("doc_id", "pos", T.clean_citation("line", 400).alias("citation"))


@register("sentence_window", """SELECT item_id, CASE WHEN p > 21 THEN '…' ELSE '' END || substr(text, greatest(1, p - 20), least(length(text), p + 29) - greatest(1, p - 20) + 1) || CASE WHEN p + 29 < length(text) THEN '…' ELSE '' END AS around
  FROM (SELECT item_id, text, CAST(length(text) // 2 AS BIGINT) AS p FROM benchmark)""")
def _(spark, d):
    return B.read(spark, d, "benchmark").select("item_id", T.sentence_window("text", F.floor(F.length("text") / 2).cast("int"), 20, 30).alias("around"))


@register("pathway_slug", """SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part""")
def _(spark, d):
    name = F.concat(F.format_string("%02d-", (F.col("p_partkey") % 50).cast("int")), "p_name", F.lit("-2nd-edition-2021-06.PDF"))
    return B.read(spark, d, "part").select("p_partkey", T.pathway_slug(name).alias("slug"))


@register("reference_address", """SELECT page_id, 'See ' AS before, regexp_replace(url, '^http://', 'https://') AS address, ' for more' AS after FROM pages""")
def _(spark, d):
    bare = F.concat(F.lit("See <"), F.regexp_replace("url", "^https?://", ""), F.lit("> for more"))
    return B.read(spark, d, "pages").select("page_id", T.reference_address(bare).alias("x")).select("page_id", "x.before", "x.address", "x.after")


@register("opens_entry", "SELECT s_suppkey, s_suppkey % 3 = 0 AS opens FROM supplier")
def _(spark, d):
    line = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "Dr. ").when(F.col("s_suppkey") % 3 == 1, "dr ").otherwise(""), F.when(F.col("s_suppkey") % 3 == 1, F.lower("s_name")).otherwise(F.col("s_name")))
    return B.read(spark, d, "supplier").select("s_suppkey", T.opens_entry(line).alias("opens"))


@register("document_name", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Principles: ' || upper(substr(t,1,1)) || substr(t,2) WHEN c_custkey % 2 = 0 THEN 'Guide to ' || t ELSE upper(substr(t,1,1)) || substr(t,2) END AS name
  FROM (SELECT *, lower(c_name) AS t FROM customer)""")
def _(spark, d):
    c = B.read(spark, d, "customer").withColumn("t", F.lower("c_name")).withColumn("kind", F.when(F.col("c_mktsegment") == "BUILDING", "core").otherwise("pathway"))
    return c.withColumn("audience", F.when(F.col("c_custkey") % 2 == 0, "consumer")).select("c_custkey", T.document_name("kind", "audience", "t").alias("name"))


@register("section_label", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'Step ' || p_size || ': ' || p_name ELSE p_name END AS label FROM part")
def _(spark, d):
    return B.read(spark, d, "part").withColumn("step", F.when(F.col("p_size") > 25, F.col("p_size"))).select("p_partkey", T.section_label("step", "p_name").alias("label"))


@register("first_note_line", "SELECT doc_id, list_filter(string_split(chr(10) || ' ' || chr(10) || text, chr(10)), lambda x: trim(x) <> '')[1] AS note FROM documents")
def _(spark, d):
    return B.read(spark, d, "documents").select("doc_id", T.first_note_line(F.concat(F.lit("\n \n"), "text")).alias("note"))


@register("relative_age", """SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || ' min' WHEN m < 1440 THEN m // 60 || ' h' WHEN m // 1440 < 2 THEN 'yesterday' WHEN m // 1440 < 14 THEN m // 1440 || ' days' ELSE strftime(ts, '%Y-%m-%d') END AS age
  FROM (SELECT event_id, ts, CAST(round((floor(epoch(n)) - floor(epoch(ts))) / 60) AS BIGINT) AS m FROM events, (SELECT max(ts) AS n FROM events))""")
def _(spark, d):
    e = B.read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    now = e.agg(F.max("ts").alias("n"))
    return e.join(F.broadcast(now)).select("event_id", T.relative_age("ts", "n").alias("age"))
