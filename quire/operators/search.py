"""Full-text search over sections: an index of terms, BM25 with a weighted title, diversified hits and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.settled import settle
from ..functions.text import fold_accents, fold_word, stem_title
from .versions import diversify

K1, B, TITLE, BODY = 1.2, 0.75, 3.0, 1.0
#: Pairs of a query and a term's posting that a task scores.
PORTION = 1_000_000
_WORD = r"[\p{L}\p{N}]+"


def tokens(text) -> Column:
    return F.transform(F.regexp_extract_all(fold_accents(text), F.lit(_WORD), 0), stem_title)


def build_index(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings (section_id, term, title_tf, body_tf), lengths (section_id, length)) of sections (section_id, title, body).

    Terms are folded and stemmed; a section's length counts all its tokens. Null texts have none. The texts are read once and
    dealt by section before they are cut into words, so that no word is shuffled; postings are kept in files, and lengths are
    sums over them."""
    found = lambda text: F.regexp_extract_all(F.lower(F.col(text)), F.lit(_WORD), 0)
    dealt = sections.select("section_id", "title", "body").repartition("section_id")
    two = dealt.select("section_id", F.explode(F.array(F.struct(F.lit(1).alias("t"), found("title").alias("w")), F.struct(F.lit(0).alias("t"), found("body").alias("w")))).alias("x"))
    words = two.select("section_id", "x.t", F.explode("x.w").alias("w")).select("section_id", "t", fold_word(F.col("w")).alias("w")).select("section_id", "t", stem_title(F.col("w")).alias("term"))
    postings = settle(words.groupBy("section_id", "term").agg(F.sum("t").alias("title_tf"), F.sum(1 - F.col("t")).alias("body_tf")))
    sums = postings.groupBy("section_id").agg(F.sum(F.col("title_tf") + F.col("body_tf")).alias("length"))
    return postings, sections.select("section_id").join(sums, "section_id", "left").na.fill({"length": 0})


def asked_postings(sections: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """build_index() for the asked terms (query_id, at, term) alone: their postings, and all lengths, in one pass over the
    texts. section_id is a key. Only words that are asked for are shuffled."""
    wanted = settle(terms.select("term").distinct())
    found = lambda text: F.coalesce(F.regexp_extract_all(F.lower(F.col(text)), F.lit(_WORD), 0), F.array().cast("array<string>"))
    cut = sections.select("section_id", found("title").alias("title"), found("body").alias("body"))
    kinds = F.array(F.struct(F.lit(1).alias("t"), F.col("title").alias("w")), F.struct(F.lit(0).alias("t"), F.col("body").alias("w")))
    length = F.size("title") + F.size("body")
    # A section's length stands in a row of its own, without a term.
    kinds = F.concat(kinds, F.array(F.struct(length.alias("t"), F.array(F.lit(None).cast("string")).alias("w"))))
    words = cut.select("section_id", F.explode(kinds).alias("x")).select("section_id", "x.t", F.explode("x.w").alias("w")).select("section_id", "t", fold_word(F.col("w")).alias("w")).select("section_id", "t", stem_title(F.col("w")).alias("term"))
    kept = words.join(wanted.withColumn("_asked", F.lit(True)), "term", "left").filter("_asked or term is null")
    held = settle(kept.groupBy("section_id", "term").agg(F.sum("t").alias("title_tf"), F.sum(1 - F.col("t")).alias("body_tf")))
    return held.filter("term is not null"), held.filter("term is null").select("section_id", F.col("title_tf").alias("length"))


def reindex(index: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index with the rows of changed sections replaced by fresh ones."""
    return index.join(changed.select("section_id").distinct(), "section_id", "left_anti").unionByName(fresh)


def parse_terms(q: DataFrame, most: int = 12, text: str = "text") -> DataFrame:
    """(query_id, at, term): the query's distinct words in order, at most `most`; everything else is dropped."""
    words = F.slice(F.array_distinct(tokens(text)), 1, most)
    return q.select("query_id", F.posexplode(words).alias("at", "term"))


def search_published(q: DataFrame, postings: DataFrame, lengths: DataFrame, owner: DataFrame, k: int = 20, per_document: int = 3) -> DataFrame:
    """(query_id, place, section_id, score): sections with all terms; for a query that none answers, with any term.

    owner: (section_id, document_id). Scores are rounded before ranking; ties go to the smaller section id.
    """
    terms = parse_terms(q)
    n, mean = lengths.agg(F.count("*"), F.avg("length")).first()
    count = postings.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("_df"))
    size = terms.groupBy("query_id").agg(F.count("*").alias("_t"))
    told = settle(terms.join(count, "term").join(size, "query_id").select("query_id", "term", "_df", "_t"))
    at = lengths.join(owner, "section_id").select("section_id", "length", "document_id")
    idf = F.greatest(F.log((F.lit(n) - F.col("_df") + 0.5) / (F.col("_df") + 0.5)), F.lit(1e-6))
    tf = TITLE * F.col("title_tf") + BODY * F.col("body_tf")
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    score = F.round(F.sum(part), 6).alias("score")
    # Sections with all terms hold the rarest one, so they are looked for among its postings alone.
    rare = told.groupBy("query_id").agg(F.min(F.struct("_df", "term"))["term"].alias("term"))
    near = settle(postings.select("section_id", "term").join(rare, "term").select("query_id", "section_id"))
    full = near.join(told, "query_id").join(postings, ["section_id", "term"]).join(at, "section_id").groupBy("query_id", "section_id", "document_id")
    hits = settle(full.agg(score, F.count("*").alias("_m"), F.max("_t").alias("_t")).filter("_m = _t").drop("_m", "_t"))
    told = settle(told.join(hits.select("query_id").distinct(), "query_id", "left_anti"))
    pairs = told.agg(F.sum("_df")).first()[0]
    if pairs:  # queries that no section answers whole
        # A section's terms meet the queries in the task that holds the section, so that only the best of a task are moved.
        parts = -(-pairs // PORTION)
        x = postings.repartition(parts, "section_id").join(at.repartition(parts, "section_id"), "section_id").join(told, "term")
        hits = hits.unionByName(_best_within(x.groupBy("query_id", "section_id", "document_id").agg(score), k))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "section_id")))
    return diversify(ranked, "document_id", per_document).filter(F.col("place") <= k).select("query_id", "place", "section_id", "score")


def _best_within(hits: DataFrame, k: int) -> DataFrame:
    """The k best sections of each query and document: what comes after them has k sections before it in any case."""
    w = Window.partitionBy("query_id", "document_id").orderBy(F.desc("score"), "section_id")
    return hits.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def snippet(hits: DataFrame, terms: DataFrame, sections: DataFrame, width: int = 24) -> DataFrame:
    """(query_id, section_id, snippet): the first window of `width` words with the most matches, matches in brackets."""
    stem = lambda w: stem_title(F.regexp_replace(fold_accents(w), r"[^\p{L}\p{N}]", ""))
    hits = settle(hits.select("query_id", "section_id"))  # read four times
    some = sections.join(hits.select("section_id").distinct(), "section_id", "left_semi")
    some = settle(some.select("section_id", F.filter(F.split("body", r"\s+"), lambda w: w != "").alias("_w")))
    words = some.select("section_id", F.posexplode(F.transform("_w", stem)).alias("_at", "term"))
    met = words.join(hits.select("query_id", "section_id"), "section_id").join(terms.select("query_id", "term").distinct(), ["query_id", "term"])
    ahead = Window.partitionBy("query_id", "section_id").orderBy("_at").rangeBetween(0, width - 1)
    best = met.withColumn("_n", F.count("*").over(ahead)).groupBy("query_id", "section_id").agg(F.max(F.struct("_n", (-F.col("_at")).alias("_back"))).alias("_best"))
    asked = terms.groupBy("query_id").agg(F.collect_set("term").alias("_t"))
    x = hits.join(best, ["query_id", "section_id"], "left").join(asked, "query_id").join(some, "section_id")
    x = x.withColumn("_shown", F.slice("_w", F.coalesce(-F.col("_best._back"), F.lit(0)) + 1, width))
    shown = F.transform("_shown", lambda w: F.when(F.array_contains("_t", stem(w)), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return x.select("query_id", "section_id", F.array_join(shown, " ").alias("snippet"))


def search_workspace(q: DataFrame, postings: DataFrame, shared: DataFrame, own: int = 20, owner: DataFrame | None = None, elsewhere: int = 12) -> DataFrame:
    """(query_id, place, section_id): sections with a word that begins with each term, core hits shown at the sections
    that share them; own sections first. shared: (core_id, section_id).

    With owner (section_id, document_id), q also has here (a document) and central: the sections of that document come
    first, at most `own`, and after them, for central users only, at most `elsewhere` of other documents; the result then
    has a column here, true for the first of these groups."""
    terms = parse_terms(q, 8)
    # Words meet terms by their first three letters, or by as many as the term has.
    heads = F.array_distinct(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substring(F.col("word"), F.lit(1), n)))
    words = postings.select(F.col("term").alias("word")).distinct().select("word", F.explode(heads).alias("_b"))
    wide = terms.withColumn("_b", F.substring("term", 1, 3)).join(words, "_b").filter(F.col("word").startswith(F.col("term"))).select("query_id", "term", "word")
    hits = postings.withColumnRenamed("term", "word").join(wide, "word").groupBy("query_id", "section_id").agg(F.countDistinct("term").alias("m"), F.sum(F.col("title_tf") * 3 + F.col("body_tf")).alias("s"))
    # Read twice: as they are and at the sections that share them.
    hits = settle(hits.join(terms.groupBy("query_id").agg(F.count("*").alias("t")), "query_id").filter("m = t").select("query_id", "section_id", "s"))
    there = hits.join(shared, hits["section_id"] == shared["core_id"]).select("query_id", shared["section_id"], "s", F.lit(1).alias("kind"))
    rows = hits.select("query_id", "section_id", "s", F.lit(0).alias("kind")).unionByName(there).groupBy("query_id", "section_id").agg(F.min("kind").alias("kind"), F.max("s").alias("s"))
    order = ("kind", F.desc("s"), "section_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long")
    if owner is None:
        return rows.withColumn("place", place).filter(F.col("place") <= own).select("query_id", "place", "section_id")
    rows = rows.join(owner, "section_id").join(q.select("query_id", F.col("here").alias("_here"), "central"), "query_id")
    rows = rows.withColumn("here", F.coalesce(F.col("document_id") == F.col("_here"), F.lit(False))).filter("here or (central and kind = 0)")
    rank = F.row_number().over(Window.partitionBy("query_id", "here").orderBy(*order))
    rows = rows.withColumn("r", rank).filter(F.col("r") <= F.when(F.col("here"), own).otherwise(elsewhere))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("here"), "r")).cast("long")
    return rows.withColumn("place", place).select("query_id", "place", "section_id", "here")


def search_references(q: DataFrame, register: DataFrame, k: int = 30) -> DataFrame:
    """Entries that hold every word of the query as a substring, cited ones first. register: (reference_id, citation, cited),
    one row an entry. A query and an entry meet only where the entry holds the first three letters of the query's longest word."""
    words = q.select("query_id", F.filter(F.split(F.lower("text"), " "), lambda w: w != "").alias("_w"))
    longest = F.array_max(F.transform("_w", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]

    def pieces(n: int) -> Column:
        """All runs of n letters of the entry."""
        at = F.sequence(F.lit(1), F.length("_c") - n + 1)
        return F.when(F.length("_c") >= n, F.transform(at, lambda i: F.substring(F.col("_c"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(pieces(1), pieces(2), pieces(3)))
    held = register.withColumn("_c", F.lower("citation")).select("reference_id", F.explode(F.array_distinct(grams)).alias("_g"))
    met = held.join(words.withColumn("_g", F.substring(longest, 1, 3)), "_g").select("query_id", "_w", "reference_id")
    hits = met.join(register, "reference_id").filter(F.forall("_w", lambda w: F.lower("citation").contains(w)))
    w = Window.partitionBy("query_id").orderBy(F.desc("cited"), "citation", "reference_id")
    return hits.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= k).select("query_id", "place", "reference_id")


def search_people(people: DataFrame, team: DataFrame, text: str, k: int = 10) -> DataFrame:
    """People whose name or address holds the text and who are not on the team; the address is not returned."""
    hit = F.lower("name").contains(text.lower()) | F.lower("email").contains(text.lower())
    return people.filter(hit).join(team.select("user_id"), "user_id", "left_anti").orderBy("name", "user_id").limit(k).select("user_id", "name")
