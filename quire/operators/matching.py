"""Matching of titles, names, links and places, and audits of what was placed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import address_key, sentence_window


def shared_tokens(a: DataFrame, b: DataFrame, by: str, share: float, whole: bool = True) -> DataFrame:
    """(a, b, na, nb, both): how many tokens the pairs share, of all that share at least `share` of the smaller set's (or, with
    whole=False, of a's). a: (a, by, tokens), b: (b, by, tokens); tokens are sets.

    Pairs are found by rare tokens only: of n tokens, of which at least m must be shared, the n - m + 1 that are rarest in
    b's documents hold a shared one. So a token that many titles have brings pairs only where nothing rarer is left."""
    count = b.select(by, F.explode("tokens").alias("token")).groupBy(by, "token").agg(F.count("*").alias("_f"))

    def rare(df, me):
        """The tokens of which a shared one must be, by their counts."""
        each = df.select(me, by, F.size("tokens").alias("_n"), F.explode("tokens").alias("token")).join(count, [by, "token"], "left")
        listed = each.groupBy(me, by, "_n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), "token"))).alias("x"))
        # Rounded first, so that 0.6 * 5 is 3.
        least = F.ceil(F.round(F.col("_n") * share, 6))
        keep = (F.col("_n") - F.greatest(least, F.lit(1)) + 1).cast("int")
        return listed.select(me, by, F.explode(F.slice("x", F.lit(1), keep)).alias("x")).select(me, by, "x.token")

    full = lambda df, me: df.select(me, by, F.explode("tokens").alias("token"))
    met = rare(a, "a").join(full(b, "b"), [by, "token"]).select("a", "b")
    if whole:
        met = met.unionByName(full(a, "a").join(rare(b, "b"), [by, "token"]).select("a", "b"))
    pairs = met.distinct().join(a.select("a", F.col("tokens").alias("_x")), "a").join(b.select("b", F.col("tokens").alias("_y")), "b")
    pairs = pairs.select("a", "b", F.size("_x").alias("na"), F.size("_y").alias("nb"), F.size(F.array_intersect("_x", "_y")).alias("both"))
    return pairs.filter(F.col("both") >= share * (F.least("na", "nb") if whole else F.col("na")) - 1e-9)


def match_titles(titles: DataFrame, candidates: DataFrame, by: str, min_containment: float = 0.6, min_jaccard: float = 0.25) -> DataFrame:
    """(title_id, candidate_id, jaccard): each title's best candidate within `by`, by shared tokens.

    titles: (title_id, by, tokens), candidates: (candidate_id, by, title, tokens); tokens are sets. A title of one word
    needs that word and a candidate of at most two. Best Jaccard, then the shorter title, then the smaller id.

    Titles of one set are matched once, and of the candidates of one set only the first by length and id can be the best, so
    pairs grow with the different sets and not with their copies."""
    sets = lambda df: df.withColumn("tokens", F.array_sort("tokens"))
    name = F.sha2(F.to_json(F.struct(F.col(by).alias("by"), "tokens")), 256)
    asked = sets(titles).select(name.alias("a"), "title_id", by, "tokens")
    known = sets(candidates).groupBy(by, "tokens").agg(F.min(F.struct(F.length("title").alias("len"), F.col("candidate_id").alias("id"))).alias("first"))
    known = known.select(name.alias("b"), by, "tokens", "first")
    pairs = shared_tokens(asked.select("a", by, "tokens").distinct(), known.drop("first"), by, min_containment).join(known.select("b", "first"), "b")
    j = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    good = pairs.withColumn("jaccard", j).filter((j >= min_jaccard) & ((F.col("na") > 1) | (F.col("nb") <= 2)))
    best = good.groupBy("a").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "first")).alias("x"))
    return asked.select("a", "title_id").join(best, "a").select("title_id", F.col("x.first.id").alias("candidate_id"), F.round(-F.col("x.j"), 9).alias("jaccard"))


def nearest_documents(q: DataFrame, names: DataFrame, synonyms: DataFrame | None = None, k: int = 3) -> DataFrame:
    """(query_id, place, document_id, score): per query word the best of 1 for an equal word, .75 for one edit in words over
    three letters, .5 for a beginning over four; summed; ties by title. q: (query_id, word), names: (document_id, title, word).

    Edits are looked for only among words that share the beginning or the end, and whose lengths differ by at most one.
    Queries of one set of words are answered once. Documents of one title and set of words score alike, so each such group is
    scored once, and its first k documents are all that can be shown.
    """
    if synonyms is not None:
        q = q.unionByName(q.join(synonyms, "word").select("query_id", F.col("to").alias("word"))).distinct()
    known = names.select("word").distinct().withColumnRenamed("word", "w")
    # One edit leaves the first or the second half of a word as it was.
    half = lambda c: F.array(F.concat(F.lit("<"), F.substring(c, 1, 2)), F.concat(F.lit(">"), F.expr(f"right({c}, 2)")))
    sets = F.array_sort(F.collect_set("word"))
    each = q.groupBy("query_id").agg(sets.alias("words")).withColumn("class", F.sha2(F.to_json("words"), 256))
    classes = each.groupBy("class").agg(F.first("words").alias("words")).select("class", F.explode("words").alias("word"))
    told = names.groupBy("document_id", "title").agg(sets.alias("words"))
    rows = told.withColumn("_n", F.row_number().over(Window.partitionBy("title", "words").orderBy("document_id"))).filter(F.col("_n") <= k)
    rows = rows.withColumn("group", F.sha2(F.to_json(F.struct("title", "words"), {"ignoreNullFields": "false"}), 256))
    groups = rows.filter("_n = 1").select("group", "title", F.explode("words").alias("w"))

    asked = q.select("word").distinct()
    pairs = asked.select("word", F.explode(half("word")).alias("b")).join(known.select("w", F.explode(half("w")).alias("b")), "b").select("word", "w").distinct()
    near = F.when(F.col("word") == F.col("w"), 1.0).when((F.length("word") > 3) & (F.abs(F.length("word") - F.length("w")) <= 1) & (F.levenshtein("word", "w", 1) == 1), 0.75)
    near = near.when((F.length("word") > 4) & F.col("w").startswith(F.col("word")), 0.5)
    scored = pairs.withColumn("s", near).filter("s is not null")
    per = classes.join(scored, "word").join(groups, "w").groupBy("class", "group", "title", "word").agg(F.max("s").alias("s"))
    total = per.groupBy("class", "group", "title").agg(F.round(F.sum("s"), 6).alias("score"))
    # Each group before another has a document, so those of a rank beyond k show none.
    w = Window.partitionBy("class").orderBy(F.desc("score"), "title")
    best = total.withColumn("_r", F.rank().over(w)).filter(F.col("_r") <= k).join(rows.select("group", "document_id"), "group")
    best = best.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "title", "document_id")).cast("long")).filter(F.col("place") <= k)
    return each.select("query_id", "class").join(best, "class").select("query_id", "place", "document_id", "score")


def apply_placements(sections: DataFrame, rules: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(placed, rejects): exact lookup in a table of rules (keys and target)."""
    placed = sections.join(rules, keys)
    return placed, sections.join(rules, keys, "left_anti").withColumn("reason", F.lit("no rule"))


def reference_lists_for_page(lists: DataFrame, pages: DataFrame, least_main: int = 20, least_appendix: int = 5) -> DataFrame:
    """(document_id, page, list_id): the list that serves a page; an appendix's beats the main one. Lists of too few entries
    do not count. lists: (document_id, list_id, kind, first_page, last_page, entries)."""
    big = lists.filter(F.col("entries") >= F.when(F.col("kind") == "main", least_main).otherwise(least_appendix))
    hit = pages.join(big, "document_id").filter((F.col("page") >= F.col("first_page")) & (F.col("page") <= F.col("last_page")))
    w = Window.partitionBy("document_id", "page").orderBy(F.when(F.col("kind") == "appendix", 0).otherwise(1), "list_id")
    return hit.withColumn("n", F.row_number().over(w)).filter("n = 1").select("document_id", "page", "list_id")


def lines_in_boxes(lines: DataFrame, boxes: DataFrame, tol: float = 1.0, inside: bool = True) -> DataFrame:
    """Lines within (or outside all of) the boxes of their page. lines: (doc, page, x0, y0, x1, y1), boxes alike."""
    b = boxes.select("doc", "page", *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    cond = (lines["doc"] == b["doc"]) & (lines["page"] == b["page"]) & (lines["x0"] >= b["b_x0"] - tol) & (lines["y0"] >= b["b_y0"] - tol) & (lines["x1"] <= b["b_x1"] + tol) & (lines["y1"] <= b["b_y1"] + tol)
    return lines.join(b, cond, "left_semi" if inside else "left_anti")


def coverage_audit(printed: DataFrame, model: DataFrame, by: list[str]) -> DataFrame:
    """(by, word, matched, missing, extra): the two multisets of words, place by place.

    Both are counted in one grouping, so that words which are dealt by their place already are not dealt again. A word or
    place that is null equals none on the other side."""
    keys = [*by, "word"]
    unknown = F.exists(F.array(*(F.col(k).isNull() for k in keys)), lambda x: x)
    side = lambda df, p: df.select(*keys, F.lit(p).alias("p"), F.lit(1 - p).alias("m"), F.when(unknown, F.lit(p)).alias("_apart"))
    both = side(printed, 1).unionByName(side(model, 0)).groupBy(*keys, "_apart").agg(F.sum("p").alias("p"), F.sum("m").alias("m"))
    return both.select(*keys, F.least("p", "m").alias("matched"), F.greatest(F.col("p") - F.col("m"), F.lit(0)).alias("missing"), F.greatest(F.col("m") - F.col("p"), F.lit(0)).alias("extra"))


def neighbour_fill(missing: DataFrame, extra: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page, word, filled): missing words met by extras of the page before, then of the page after.

    missing and extra: (key, page, word, n). Each extra is spent once."""
    def take(need, have, shift):
        there = have.select(key, (F.col("page") + shift).alias("page"), "word", F.col("n").alias("_h"))
        return need.join(there, [key, "page", "word"], "left").withColumn("_t", F.least("n", F.coalesce("_h", F.lit(0)))).drop("_h")

    one = take(missing, extra, 1)
    spent = one.select(key, (F.col("page") - 1).alias("page"), "word", F.col("_t").alias("_s"))
    left = extra.join(spent, [key, "page", "word"], "left").withColumn("n", F.col("n") - F.coalesce("_s", F.lit(0))).drop("_s")
    two = take(one.select(key, "page", "word", (F.col("n") - F.col("_t")).alias("n"), F.col("_t").alias("_first")), left, -1)
    return two.select(key, "page", "word", (F.col("_first") + F.col("_t")).alias("filled")).filter("filled > 0")


def top_extras(audit: DataFrame, k: int = 40) -> DataFrame:
    return audit.groupBy("word").agg(F.sum("extra").alias("extra")).filter("extra > 0").orderBy(F.desc("extra"), "word").limit(k)


def weighted_mode(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The value of each group with the greatest summed weight; ties to the smallest value."""
    s = df.groupBy(*by, value).agg(F.sum(weight).alias("weight"))
    w = Window.partitionBy(*by).orderBy(F.desc("weight"), value)
    return s.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def recurring_above(df: DataFrame, by: list[str], value: str, weight: str, least: int = 8) -> DataFrame:
    """(by, value, n): the values above a group's weighted mode that at least `least` rows have: sizes of headings over the body's."""
    body = weighted_mode(df, by, value, weight).select(*by, F.col(value).alias("_body"))
    n = df.groupBy(*by, value).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return n.join(body, by).filter(F.col(value) > F.col("_body")).select(*by, value, "n")


def enriched_values(df: DataFrame, by: str, value: str, weight: str, subset: Column, least: float = 0.2, times: float = 3.0) -> DataFrame:
    """Values whose share in the subset is at least `least` and over `times` their share overall, the dominant one excepted."""
    g = df.groupBy(by, value).agg(F.sum(weight).alias("all"), F.sum(F.when(subset, F.col(weight)).otherwise(0)).alias("sub"))
    w = Window.partitionBy(by)
    g = g.withColumn("share", F.col("all") / F.sum("all").over(w)).withColumn("own", F.col("sub") / F.nullif(F.sum("sub").over(w), F.lit(0)))
    g = g.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("all"), value)))
    return g.filter((F.col("own") >= least) & (F.col("own") > times * F.col("share")) & (F.col("place") > 1)).select(by, value, F.round("own", 9).alias("own"), F.round("share", 9).alias("share"))


def body_values(df: DataFrame, by: str, value: str, weight: str, share: float = 0.85) -> DataFrame:
    """The most common values that make up to `share` of the weight."""
    g = df.groupBy(by, value).agg(F.sum(weight).alias("weight"))
    w = Window.partitionBy(by).orderBy(F.desc("weight"), value)
    before = F.coalesce(F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return g.filter("true").withColumn("_b", before).withColumn("_t", F.sum("weight").over(Window.partitionBy(by))).filter(F.col("_b") < share * F.col("_t")).drop("_b", "_t")


def repeated_elements(df: DataFrame, element: str, page: str, n: int = 4) -> DataFrame:
    return df.groupBy(element).agg(F.countDistinct(page).alias("pages")).filter(F.col("pages") >= n)


def entry_lexicon(lines: DataFrame, pattern: str, line: str = "line") -> DataFrame:
    """Distinct first groups of the pattern, with how often they occur."""
    return lines.select(F.explode(F.regexp_extract_all(line, F.lit(pattern), 1)).alias("entry")).filter("entry <> ''").groupBy("entry").agg(F.count("*").alias("n"))


def resolution_counts(rows: DataFrame) -> DataFrame:
    """Totals by outcome and rule with their subtotals: (outcome, rule, n); nulls stand for all."""
    return rows.rollup("outcome", "rule").agg(F.count("*").alias("n"))


def placement_summary(placed: DataFrame, hows: list[str], by: str = "document_id") -> DataFrame:
    return placed.groupBy(by).agg(*(F.count_if(F.col("how") == h).alias(h) for h in hows))


def origin_share(origins: DataFrame) -> DataFrame:
    """(section_id, origin, chars, share) of the characters that each source gave a section."""
    g = origins.groupBy("section_id", "origin").agg(F.sum("chars").alias("chars"))
    return g.withColumn("share", F.round(F.col("chars") / F.nullif(F.sum("chars").over(Window.partitionBy("section_id")), F.lit(0)), 9))


def provenance(sec: DataFrame, origins: DataFrame, legacy_sec: DataFrame, legacy_doc: DataFrame) -> DataFrame:
    return sec.join(origins, "section_id").join(legacy_sec, "legacy_section_id").join(legacy_doc, "legacy_document_id").select("section_id", "legacy_section_id", "legacy_document_id", "chars")


def fill_spanned(rows: DataFrame, by: list[str], order: str, value: str, span: str) -> DataFrame:
    """Adds filled: a cell that spans n rows supplies those beneath it."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.coalesce(span, F.lit(1)).alias("n"), F.col(value).alias("v")))
    last = F.last(at, ignorenulls=True).over(w)
    return rows.withColumn("filled", F.when(F.col(order) < last["o"] + last["n"], last["v"]))


def merge_runs(df: DataFrame, by: list[str], order: str, same: list[str]) -> DataFrame:
    """(by, run, same, first, last, rows): consecutive rows that agree on `same` become one."""
    w = Window.partitionBy(*by).orderBy(order)
    key = F.struct(*same)
    new = F.coalesce((~key.eqNullSafe(F.lag(key).over(w))).cast("int"), F.lit(1))
    runs = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "run", *same).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows"))


def join_wrapped_lines(lines: DataFrame, by: list[str], order: str, text: str, is_open: Column) -> DataFrame:
    """(by, first, text): a line that is open takes the next one down."""
    w = Window.partitionBy(*by).orderBy(order)
    start = F.coalesce((~F.lag(is_open).over(w)).cast("int"), F.lit(1))
    runs = lines.withColumn("_s", start).withColumn("_run", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = runs.groupBy(*by, "_run").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("x"))
    return g.select(*by, F.col("x")[0][order].alias("first"), F.array_join(F.transform("x", lambda z: z[text]), "").alias("text"))


def figure_index(figures: DataFrame, by: list[str], order: str) -> DataFrame:
    return figures.withColumn("figure", F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long"))


def main_table(tables: DataFrame, by: str = "chapter") -> DataFrame:
    """The largest table of several columns in each chapter, and those that repeat its header: (by, table_id, main)."""
    wide = tables.filter("columns > 1")
    first = wide.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("rows"), "table_id"))).filter("_n = 1").select(by, "header", F.col("table_id").alias("_main"))
    return wide.join(first, [by, "header"]).select(by, "table_id", (F.col("table_id") == F.col("_main")).alias("main"))


def dedupe_lines(lines: DataFrame, by: str, order: str, key: Column) -> DataFrame:
    """The first of the lines of a document with equal keys."""
    w = Window.partitionBy(by, "_k").orderBy(order)
    return lines.withColumn("_k", key).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_k", "_n")


def subset_check(pairs: DataFrame, part: str, whole: str) -> DataFrame:
    return pairs.withColumn("subset", F.size(F.array_except(part, whole)) == 0)


def resolve_links(notes: DataFrame, targets: DataFrame) -> DataFrame:
    """(note_id, outcome, target, rule): rules in order; the first that fits decides.

    notes: (note_id, before) with the words before the note; targets: (name, address). "see <name>" gives that section,
    an address gives a link, "ibid" the reason "repeats a note", anything else stays with "no rule fits".
    """
    name = F.lower(F.trim(F.regexp_extract("before", r"(?i:\bsee )([\w ]+)$", 1)))
    link = F.regexp_extract("before", r"(https?://[^\s<>\"]+)", 1)
    x = notes.withColumn("_n", name).join(targets.select(F.lower("name").alias("_n"), "address").dropDuplicates(["_n"]), "_n", "left")
    rule = F.when(F.col("address").isNotNull(), "names a section").when(link != "", "prints an address").when(F.col("before").rlike(r"(?i)\bibid\b"), "repeats a note").otherwise("no rule fits")
    outcome = F.when(rule == "names a section", "section").when(rule == "prints an address", "link").otherwise("left")
    return x.select("note_id", outcome.alias("outcome"), F.when(outcome == "section", F.col("address")).when(outcome == "link", link).alias("target"), rule.alias("rule"))


def fit_link_spans(spans: DataFrame) -> DataFrame:
    """(span_id, address, start): each address printed inside a wider span of text, with its place from 0, once for each
    time that it is printed."""
    pattern = r"(https?://[^\s<>\"']+[^\s<>\"'.,;)])"
    mark = "\x00"  # stands before each address, so that the pieces between are what was printed there
    parts = F.split(F.regexp_replace(F.replace("text", F.lit(mark), F.lit(" ")), pattern, mark + "$1"), mark)
    before = F.expr("aggregate(slice(_parts, 1, _i), 0L, (n, x) -> n + length(x))")
    each = spans.withColumn("_parts", parts).select("span_id", "_parts", F.posexplode("_parts").alias("_i", "_part")).filter("_i > 0")
    return each.select("span_id", F.regexp_extract("_part", pattern, 1).alias("address"), before.alias("start"))


def link_span_targets(spans: DataFrame, targets: DataFrame) -> DataFrame:
    """fit_link_spans() with the target that each printed address names, null where none does: addresses are equal without
    scheme, www., closing slashes and query. targets: (span_id, target); of several the first in order."""
    found = fit_link_spans(spans).withColumn("_key", address_key("address"))
    named = targets.withColumn("_key", address_key("target")).groupBy("span_id", "_key").agg(F.min("target").alias("target"))
    return found.join(named, ["span_id", "_key"], "left").drop("_key")


def link_resolution_audit(links: DataFrame, resolved: DataFrame, before: int = 180, after: int = 80) -> DataFrame:
    """Each link occurrence with what stands around it, how it was resolved and why.

    links: (note_id, text, link), resolved: what resolve_links() gives for the same note_id. A link that was resolved to
    nothing keeps its rule as the reason; one that the resolution does not know has the outcome "left" and the reason
    "not resolved"; a link that its text does not print stands around the beginning."""
    at = F.greatest(F.instr("text", F.col("link")), F.lit(1))
    x = links.join(resolved, "note_id", "left")
    outcome = F.coalesce("outcome", F.lit("left"))
    reason = F.when(outcome == "left", F.coalesce("rule", F.lit("not resolved")))
    return x.select("note_id", sentence_window("text", at, before, after).alias("around"), outcome.alias("outcome"), F.when(outcome != "left", F.col("rule")).alias("rule"), "target", reason.alias("reason"))
