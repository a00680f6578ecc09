"""Migration of printed documents: headings by learned styles, entries by a lexicon, notes and their links, rows of summary
tables, and the placement of whole documents' sections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_key
from ..sources.settled import settle
from .matching import fill_spanned, match_titles, shared_tokens

#: Most characters of a heading.
HEADING = 160
#: Lines that are folded at once.
BLOCK = 128


def classify_lines(lines: DataFrame, styles: DataFrame, by: str = "document_id", tolerance: float = 0.5) -> DataFrame:
    """(by, line_no, level) of every line: the heading level that it is printed at, or null.

    lines: (by, line_no, text, size, colour, bold, tagged), styles: (by, level, size, colour, bold) as learnt. A heading is a
    short line in a learned style: equal colour and weight, sizes at most `tolerance` apart. Of several levels its own tag
    decides; else the next level below that of the heading before it, or the shallowest where none is below.

    A line's level depends on the one before it, but only by way of the level where a block of lines is entered. So the lines
    of a document are folded in blocks of BLOCK, from each level that a block's first line may have; a second fold over the
    blocks tells which of them it was. Neither a document nor the lines between two known levels are a unit of work."""
    half = lambda size, move=0: (F.floor(F.col(size) / tolerance) + move).cast("long")
    short = F.length(F.trim("text")).between(1, HEADING)
    near = styles.select(by, "colour", "bold", F.col("size").alias("_s"), "level", F.explode(F.array(half("size", -1), half("size"), half("size", 1))).alias("_h"))
    asked = lines.filter(short).withColumn("_h", half("size"))
    fits = F.abs(F.col("size") - F.col("_s")) <= tolerance
    met = asked.join(near, [by, "_h", "colour", "bold"]).filter(fits).groupBy(by, "line_no").agg(F.array_sort(F.collect_set("level")).alias("_levels"), F.first("tagged").alias("_tag"))
    # A level that is known is the only one to choose from.
    open_to = F.when(F.array_contains("_levels", F.col("_tag")), F.array("_tag")).otherwise(F.col("_levels")).cast("array<int>")
    at = F.row_number().over(Window.partitionBy(by).orderBy("line_no"))
    dealt = met.select(by, F.col("line_no").cast("bigint").alias("line_no"), open_to.alias("_levels"), F.floor((at - 1) / BLOCK).alias("_block")).repartition(by, "_block")
    blocks = dealt.groupBy(by, "_block").agg(F.array_sort(F.collect_list(F.struct("line_no", "_levels"))).alias("_x"))
    below = lambda levels, now: F.coalesce(F.get(F.filter(levels, lambda v: v > now), 0), levels[0])

    # For every line a level for each way to enter its block, in the order of the first line's levels.
    entered = F.col("_x")[0]["_levels"]
    start = F.struct(entered.alias("now"), F.array(F.struct(F.col("_x")[0]["line_no"].alias("line_no"), entered.alias("now"))).alias("out"))

    def step(a, x):
        now = F.transform(a["now"], lambda v: below(x["_levels"], v))
        return F.struct(now.alias("now"), F.concat(a["out"], F.array(F.struct(x["line_no"].alias("line_no"), now.alias("now")))).alias("out"))

    folded = settle(blocks.select(by, "_block", entered.alias("_in"), F.aggregate(F.slice("_x", F.lit(2), F.size("_x")), start, step)["out"].alias("_out")))
    ends = folded.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_block", "_in", F.element_at("_out", -1)["now"].alias("_end")))).alias("_x"))
    begin = F.struct(F.lit(0).alias("now"), F.array().cast("array<struct<_block:bigint,_way:int>>").alias("out"))

    def enter(a, x):
        way = F.array_position(x["_in"], below(x["_in"], a["now"])).cast("int")
        return F.struct(F.element_at(x["_end"], way).alias("now"), F.concat(a["out"], F.array(F.struct(x["_block"].alias("_block"), way.alias("_way")))).alias("out"))

    ways = ends.select(by, F.inline(F.aggregate("_x", begin, enter)["out"]))
    found = folded.join(ways, [by, "_block"]).select(by, "_way", F.inline("_out")).select(by, "line_no", F.element_at("now", F.col("_way")).alias("level"))
    return lines.select(by, "line_no").join(found, [by, "line_no"], "left")


#: What stands before the names of persons, and small words within them.
HONORIFICS = ("dr", "prof", "professor", "associate professor", "mr", "mrs", "ms", "miss")
PARTICLES = ("van", "de", "der", "von")


def _last_word(key: Column) -> Column:
    return F.element_at(F.split(key, " "), -1)


def entry_openings(lines: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(line_id, person, complete, opens): whether a line starts the entry of a person; is an organisation's whole name; or is
    the beginning of one whose name goes on in the next line.

    lines: (line_id, text); lexicon: (kind, text) of entries, roles and names. A person is told by an honorific before a
    capital, or by two to four capitalised words before a comma that are a known name, or that are no known role and stand
    before one (or before words that end like one, as "Senior Physiotherapist" does for "Physiotherapist"). Names of
    organisations are whole entries and the clauses of entries, which commas and semicolons part; they are compared without
    case, accents and punctuation. Everything is an equal join on such keys: of clauses with all their beginnings.

    Each distinct text is looked up once; texts without a key meet nothing and are dealt by themselves."""
    known = lexicon.withColumn("key", normalise_key(F.col("text")))
    keys = lambda kind, name: known.filter(F.col("kind") == kind).select(F.col("key").alias(name)).distinct()
    roles = keys("role", "k")
    tails = roles.select(_last_word(F.col("k")).alias("k")).filter("length(k) > 3").distinct()

    head, rest = F.trim(F.substring_index("text", ",", 1)), F.get(F.split("text", ","), 1)
    words = F.filter(F.split(head, r"\s+"), lambda w: w != "")
    named = F.size(words).between(2, 4) & F.forall(words, lambda w: w.isin(*PARTICLES) | w.rlike(r"^\p{Lu}")) & rest.isNotNull()
    role = normalise_key(F.regexp_replace(rest, r"\s*\(.*$", ""))
    titled = F.lower(F.trim("text")).rlike(r"^(?:" + "|".join(HONORIFICS) + r")\.?\s") & F.trim("text").rlike(r"^(?:\p{L}+\.?\s+){1,2}\p{Lu}")
    texts = lines.filter("text is not null").select("text").distinct()
    none = F.concat(F.lit("\0"), F.xxhash64("text").cast("string"))  # is no key, which holds letters, digits and blanks only
    x = texts.select("text", normalise_key(F.col("text")).alias("_key"), F.coalesce(titled, F.lit(False)).alias("_titled"), F.coalesce(named, F.lit(False)).alias("_named"), head.alias("_head"), role.alias("_said"))
    name, said = F.when(F.col("_named"), normalise_key("_head")), F.when(F.col("_named"), F.col("_said"))
    x = x.select("text", "_key", "_titled", "_named", F.coalesce(name, none).alias("_name"), F.coalesce(said, none).alias("_role"), F.coalesce(_last_word(said), none).alias("_tail"))

    def flag(df, column, table, name):
        return df.join(table.select(F.col("k").alias(column), F.lit(True).alias(name)), column, "left").withColumn(name, F.coalesce(name, F.lit(False)))

    x = flag(x, "_name", keys("name", "k"), "_known")
    x = flag(x, "_name", roles, "_is_role")
    x = flag(x, "_role", roles, "_has_role")
    x = flag(x, "_tail", tails, "_like_role")
    person = F.col("_titled") | F.col("_named") & ~F.col("_is_role") & (F.col("_known") | F.col("_has_role") | F.col("_like_role"))

    parts = known.filter("kind = 'entry'").select("key", F.transform(F.split("text", r"\s*[,;]\s*"), normalise_key).alias("p"))
    clauses = parts.select(F.explode("p").alias("k")).filter("length(k) >= 4").distinct()
    whole = clauses.unionByName(parts.select(F.col("key").alias("k"))).distinct()
    pieces = F.split("k", " ")
    begun = clauses.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, F.lit(1), n), " "))).alias("b"), "k")
    begun = begun.filter("b <> k and length(b) >= 5").select(F.col("b").alias("k")).distinct()
    x = flag(flag(x, "_key", whole, "complete"), "_key", begun, "opens")
    told = x.select("text", person.alias("person"), "complete", "opens")
    return lines.select("line_id", "text").join(told, "text", "left").na.fill(False, ["person", "complete", "opens"]).select("line_id", "person", "complete", "opens")


def note_windows(nodes: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, path, before): for every note node the text of its block since the note before it.

    nodes: (key, path, type, text) of type text and note; a block is what has the same path but for the last place."""
    block = F.slice("path", 1, F.size("path") - 1)
    at = nodes.filter("type in ('text', 'note') and size(path) > 0").withColumn("_block", block).withColumn("_at", F.element_at("path", -1))
    order = Window.partitionBy(key, "_block").orderBy("_at")
    note = F.col("type") == "note"
    # A note closes its window: text after it belongs to the next.
    at = at.withColumn("_window", F.coalesce(F.sum(F.when(note, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~note, F.struct("_at", F.coalesce("text", F.lit("")).alias("text"))))), lambda x: x["text"]), "")
    held = at.groupBy(key, "_block", "_window").agg(F.max(F.when(note, F.struct("_at", "path"))).alias("_note"), said.alias("before"))
    return held.filter("_note is not null").select(key, F.col("_note.path").alias("path"), "before")


@dataclass(frozen=True)
class LinkRule:
    """Words that carry a link: where `pattern` fits, group `words` is what is linked, group `find` names a target of `kind` (by
    its number, or by its name), and group `title` (0: none) must say nothing that the target's title does not."""

    name: str
    pattern: str
    kind: str
    words: int = 1
    find: int = 2
    title: int = 0


def resolve_notes(notes: DataFrame, targets: DataFrame, rules: list[LinkRule], key: str = "document_id") -> DataFrame:
    """(note_id, outcome, rule, words, address, reason): what the words before each note link to.

    notes: (note_id, key, before); targets: (key, kind, name, address, title), a null key standing for every document. The
    first rule whose pattern fits decides: if it finds no target, the note is left with that reason and later rules are not
    tried. Names are compared without case, accents and punctuation, titles word by word."""
    fit = F.lit(None).cast("struct<rule:string,kind:string,words:string,find:string,title:string>")
    for r in reversed(rules):
        group = lambda n, p=r.pattern: F.regexp_extract("before", p, n)
        title = group(r.title) if r.title else F.lit("")
        made = F.struct(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), group(r.words).alias("words"), _name(group(r.find)).alias("find"), normalise_key(title).alias("title"))
        fit = F.when(F.col("before").rlike(r.pattern), made).otherwise(fit)
    empty = F.coalesce(F.trim("before") == "", F.lit(True))
    x = notes.withColumn("_f", F.when(~empty, fit)).select("*", F.col("_f.rule").alias("rule"), F.col("_f.kind").alias("kind"), F.col("_f.words").alias("words"), F.col("_f.find").alias("_find"), F.col("_f.title").alias("_said"))
    one = targets.select(F.col(key).alias("_k"), "kind", _name(F.col("name")).alias("_find"), "address", normalise_key("title").alias("_title")).groupBy("_k", "kind", "_find").agg(F.min(F.struct("address", "_title")).alias("t"))
    own = one.filter("_k is not null").withColumnRenamed("_k", key).withColumnRenamed("t", "_own")
    any_ = one.filter("_k is null").select("kind", "_find", F.col("t").alias("_any"))
    x = x.join(own, [key, "kind", "_find"], "left").join(any_, ["kind", "_find"], "left").withColumn("_t", F.coalesce("_own", "_any"))
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    other = F.size(F.array_except(words(F.col("_said")), words(F.coalesce("_t._title", F.lit(""))))) > 0
    reason = F.when(empty, "nothing before the note").when(F.col("rule").isNull(), "no rule fits").when(F.col("_t").isNull(), "no such target").when(other, "the title is another one")
    good = reason.isNull()
    return x.select("note_id", F.when(good, "resolved").otherwise("left").alias("outcome"), F.when(good, F.col("rule")).alias("rule"), F.when(good, F.col("words")).alias("words"), F.when(good, F.col("_t.address")).alias("address"), reason.alias("reason"))


def _name(text: Column) -> Column:
    """A number as it stands, any other name without case, accents and punctuation."""
    return F.when(text.rlike(r"^[0-9.]+$"), F.regexp_replace(text, r"\.$", "")).otherwise(normalise_key(text))


def _long_words(text) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 3))


def table_rows_to_boxes(rows: DataFrame, boxes: DataFrame, sections: DataFrame, share: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(placements (document_id, row_no, source, address), new boxes (document_id, address, row_no, care_point, statement, new)) of
    the rows of printed summary tables.

    rows: (document_id, row_no, step, care_point, statement, span): a statement that spans several rows stands in the first;
    rows without any are left out. boxes: (document_id, box_id, step, text) of the bodies; sections: (document_id, address,
    step, title). A row is covered (source "body") if a box of its step holds at least `share` of the statement's words of
    more than three letters, or a box of any step all of them. Any other row becomes a box: in the section of its step whose
    title fits the care point best, else in the step's section for timeframes, which is opened where it is new; a row
    without a step has no address."""
    filled = fill_spanned(rows, ["document_id"], "row_no", "statement", "span").filter("filled is not null")
    r = filled.select(F.struct("document_id", "row_no").alias("row"), "document_id", "row_no", "step", "care_point", F.col("filled").alias("statement"), _long_words("filled").alias("tokens"))
    b = boxes.select(F.struct("document_id", "box_id").alias("box"), "document_id", "step", _long_words("text").alias("tokens"))
    # Only boxes that hold enough of a row's words matter, so rare words are enough to find them.
    met = shared_tokens(r.select(F.col("row").alias("a"), "document_id", "tokens"), b.select(F.col("box").alias("b"), "document_id", "tokens"), "document_id", share, whole=False)
    met = met.join(r.select(F.col("row").alias("a"), F.col("step").alias("_sa")), "a").join(b.select(F.col("box").alias("b"), F.col("step").alias("_sb")), "b")
    same = F.col("_sa").isNull() | F.col("_sa").eqNullSafe(F.col("_sb"))
    hit = met.filter((F.col("both") >= share * F.col("na")) & same | (F.col("both") == F.col("na")) & F.col("_sa").isNotNull()).select(F.col("a").alias("row")).distinct()
    covered = r.join(hit, "row", "left_semi").unionByName(r.filter(F.size("tokens") == 0))
    body = covered.select("document_id", "row_no", F.lit("body").alias("source"), F.lit(None).cast("string").alias("address"))

    left = r.filter(F.size("tokens") > 0).join(hit, "row", "left_anti")
    place = F.struct("document_id", "step")
    title = lambda c: F.array_distinct(F.filter(F.split(normalise_key(c), " "), lambda w: w != ""))
    asks = left.filter("step is not null").select(F.col("row").alias("title_id"), place.alias("at"), title("care_point").alias("tokens"))
    known = sections.select(F.struct("document_id", "address").alias("candidate_id"), place.alias("at"), "title", title("title").alias("tokens"))
    best = match_titles(asks, known, "at").select(F.col("title_id").alias("row"), F.col("candidate_id.address").alias("_found"))
    opened = F.concat(F.col("step").cast("string"), F.lit("/timeframes"))
    new = left.join(best, "row", "left").withColumn("address", F.coalesce("_found", opened))
    held = sections.select("document_id", "address", F.lit(True).alias("_held")).distinct()
    made = new.filter("address is not null").join(held, ["document_id", "address"], "left")
    made = made.select("document_id", "address", "row_no", "care_point", "statement", F.col("_held").isNull().alias("new"))
    return body.unionByName(new.select("document_id", "row_no", F.lit("row").alias("source"), "address")), made


def import_legacy(sections: DataFrame, core: DataFrame, rules: DataFrame) -> dict[str, DataFrame]:
    """A whole migration as deltas.

    sections: (document_id, section_id, parent_id, order_index, step, title, tokens, body); core: (target, step, title, tokens,
    body); rules: (priority, document_id, title, target), a null document_id for all. Each section is placed by the first
    of: a standing rule (least priority), an equal title of its step, the best title of its step by shared words
    (match_titles), the place of the sibling printed before it. The rest is rejected.

    placed: with target and how; targets: per document and target the printed text in reading order, its hash, and whether it
    diverges from the core's; versions and version_sections: the printed edition (1, published) and the draft that goes on
    from it (2), whose shared sections have no body of their own; origins: the share of characters of each section in its
    target; ledger: how many sections each step placed; rejects: with a reason."""
    key = ["document_id", "section_id"]
    all_ = sections.withColumn("_title", normalise_key("title"))
    asked = rules.select("priority", F.col("document_id").alias("_d"), normalise_key("title").alias("_title"), F.col("target").alias("_t"))
    first = lambda df: df.groupBy(*key).agg(F.min(F.struct("priority", "_t"))["_t"].alias("target"))
    of_all = all_.join(asked.filter("_d is null"), "_title")
    of_one = all_.join(asked.filter("_d is not null").withColumnRenamed("_d", "document_id"), ["document_id", "_title"])
    columns = [*key, "priority", "_t"]
    ruled = first(of_all.select(*columns).unionByName(of_one.select(*columns))).withColumn("how", F.lit("rule"))

    left = all_.join(ruled, key, "left_anti")
    titles = core.groupBy("step", normalise_key("title").alias("_title")).agg(F.min("target").alias("target"))
    equal = left.join(titles, ["step", "_title"]).select(*key, "target", F.lit("title").alias("how"))
    left = left.join(equal, key, "left_anti")
    near = match_titles(
        left.filter("step is not null").select(F.struct(*key).alias("title_id"), "step", "tokens"), core.filter("step is not null").select(F.col("target").alias("candidate_id"), "step", "title", "tokens"), "step"
    )
    words = near.select("title_id.*", F.col("candidate_id").alias("target"), F.lit("words").alias("how"))
    known = ruled.unionByName(equal).unionByName(words)

    # What follows a placed sibling goes where that went.
    before = Window.partitionBy("document_id", "parent_id").orderBy("order_index", "section_id").rowsBetween(Window.unboundedPreceding, -1)
    chain = all_.select(*key, "parent_id", "order_index").join(known, key, "left").withColumn("_before", F.last("target", ignorenulls=True).over(before))
    placed = chain.select(*key, "order_index", F.coalesce("target", "_before").alias("target"), F.when(F.col("target").isNotNull(), F.col("how")).when(F.col("_before").isNotNull(), "sibling").alias("how"))
    rejects = placed.filter("target is null").select(*key, F.lit("no place").alias("reason"))
    placed = placed.filter("target is not null").join(all_.select(*key, F.coalesce("body", F.lit("")).alias("body")), key)

    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "section_id", "body"))), lambda x: x["body"]), "\n")
    printed = placed.groupBy("document_id", "target").agg(text.alias("body"))
    ours = core.select("target", F.sha2(F.coalesce("body", F.lit("")), 256).alias("_core"))
    printed = printed.withColumn("body_hash", F.sha2("body", 256)).join(ours, "target", "left").withColumn("diverged", ~F.col("body_hash").eqNullSafe(F.col("_core"))).drop("_core")
    two = F.explode(F.array(F.struct(F.lit(1).alias("version_no"), F.lit("published").alias("status")), F.struct(F.lit(2).alias("version_no"), F.lit("draft").alias("status"))))
    held = F.when((F.col("version_no") == 1) | F.col("diverged"), F.col("body"))
    whole = Window.partitionBy("document_id", "target")
    size = F.length("body")
    return {
        "placed": placed.select(*key, "target", "how"),
        "targets": printed,
        "versions": printed.select("document_id").distinct().select("document_id", two.alias("v")).select("document_id", "v.*"),
        "version_sections": printed.select("*", two.alias("v")).select("document_id", "v.version_no", "target", held.alias("body"), "body_hash", "diverged", F.lit(1).alias("last_changed_version_no")),
        "origins": placed.select(*key, "target", size.cast("long").alias("chars"), F.round(size / F.nullif(F.sum(size).over(whole), F.lit(0)), 9).alias("share")),
        "ledger": placed.groupBy("document_id").pivot("how", ["rule", "title", "words", "sibling"]).count().na.fill(0),
        "rejects": rejects,
    }
