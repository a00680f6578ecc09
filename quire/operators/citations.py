"""Citations: numbering, registers, supersession and matching of in-text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.settled import release, settle


def citation_numbers(mentions: DataFrame) -> DataFrame:
    """(document_id, reference_id, number): ids by their first mention in the document."""
    first = mentions.groupBy("document_id", "reference_id").agg(F.min("pos").alias("pos"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy("document_id").orderBy("pos", "reference_id")).cast("long")).drop("pos")


def missing_references(mentions: DataFrame, ref: DataFrame) -> DataFrame:
    return mentions.select("document_id", "reference_id").distinct().join(ref.select(F.col("id").alias("reference_id")), "reference_id", "left_anti")


def where_cited(mentions: DataFrame, ref: DataFrame) -> DataFrame:
    """Per reference: citing documents and mentions."""
    n = mentions.groupBy("reference_id").agg(F.countDistinct("document_id").alias("documents"), F.count("*").alias("mentions"))
    return ref.select(F.col("id").alias("reference_id")).join(n, "reference_id", "left").na.fill(0, ["documents", "mentions"])


def citing_places(asked: DataFrame, sections: DataFrame, nodes: DataFrame, versions: DataFrame) -> DataFrame:
    """(reference_id, document_id, version_no, address, in_heading, in_body): where the asked-for references are cited, a row
    for each section, in drafts (no version_no) and in every frozen edition, so that an entry which an edition still prints
    is found though no draft cites it.

    asked: (reference_id); sections: (section_id, document_id, version_id or null for a draft, address, title_citations);
    nodes: exploded bodies by section_id; versions: (version_id, version_no, status). A version that is itself a draft
    counts as none, as its sections are the draft's. Ids that nothing cites have no row."""
    body = nodes.filter("type = 'citation'").select("section_id", F.get_json_object("attrs", "$.referenceId").alias("reference_id"), F.lit(False).alias("_head"))
    head = sections.select("section_id", F.explode("title_citations").alias("reference_id"), F.lit(True).alias("_head"))
    wanted = asked.select("reference_id").distinct()
    said = head.unionByName(body).join(wanted, "reference_id", "left_semi")
    found = said.groupBy("section_id", "reference_id").agg(F.bool_or("_head").alias("in_heading"), F.bool_or(~F.col("_head")).alias("in_body"))
    frozen = versions.filter("status <> 'draft'").select("version_id", "version_no")
    at = sections.select("section_id", "document_id", "version_id", "address").join(frozen, "version_id", "left").filter("version_id is null or version_no is not null")
    return found.join(at, "section_id").select("reference_id", "document_id", "version_no", "address", "in_heading", "in_body")


def reference_successors(ref: DataFrame) -> DataFrame:
    """(id, latest, steps): the end of each reference's chain of successors. ref: (id, supersedes).

    The pairs double their reach in every round, so a chain of n takes log2(n) joins. Cycles raise an error.
    """
    nxt = ref.filter("supersedes is not null").groupBy(F.col("supersedes").alias("id")).agg(F.min("id").alias("to"))
    hop = ref.select("id").join(nxt, "id", "left").select("id", F.coalesce("to", "id").alias("latest"), F.col("to").isNotNull().cast("long").alias("steps"))
    reach, most = 1, ref.count()
    while True:
        hop, old = settle(hop), hop
        if reach > 1:
            release(old)
        step = hop.select(F.col("id").alias("latest"), F.col("latest").alias("_l"), F.col("steps").alias("_s"))
        new = hop.join(step, "latest").select("id", F.col("_l").alias("latest"), (F.col("steps") + F.col("_s")).alias("steps"))
        if hop.join(step, "latest").filter("_s > 0").isEmpty():
            return hop
        reach *= 2
        if reach > 2 * most:
            raise ValueError("references supersede each other in a circle")
        hop = new


def deletable_references(ref: DataFrame, mentions: DataFrame) -> DataFrame:
    """Adds deletable and the first five places that keep a reference."""
    at = mentions.groupBy(F.col("reference_id").alias("id")).agg(F.slice(F.array_sort(F.collect_set("document_id")), 1, 5).alias("_p"))
    return ref.join(at, "id", "left").select("id", F.col("_p").isNull().alias("deletable"), F.coalesce(F.array_join(F.col("_p").cast("array<string>"), ","), F.lit("")).alias("places"))


def reference_register(mentions: DataFrame, ref: DataFrame) -> DataFrame:
    """Per document: cited rows by number, then own uncited ones; flags own, unused and missing."""
    cited = citation_numbers(mentions).join(ref.select(F.col("id").alias("reference_id"), F.col("document_id").alias("owner")), "reference_id", "left")
    cited = cited.select("document_id", "reference_id", "number", (F.col("owner") == F.col("document_id")).alias("own"), F.col("owner").isNull().alias("missing"), F.lit(False).alias("unused"))
    own = ref.select("document_id", F.col("id").alias("reference_id")).join(mentions.select("document_id", "reference_id").distinct(), ["document_id", "reference_id"], "left_anti")
    rows = cited.unionByName(own.select("document_id", "reference_id", F.lit(None).cast("long").alias("number"), F.lit(True).alias("own"), F.lit(False).alias("missing"), F.lit(True).alias("unused")))
    return rows.withColumn("own", F.coalesce("own", F.lit(False)))


def reference_flags(mentions: DataFrame, ref: DataFrame, published: DataFrame) -> DataFrame:
    """reference_register() with what an editor must know of each row: whether a newer entry supersedes it, whether a published
    edition cites it, and where its document cites it (places in order, comma-joined). ref has `supersedes`; published:
    (reference_id, ...) of the published editions."""
    rows = reference_register(mentions, ref)
    old = ref.filter("supersedes is not null").select(F.col("supersedes").alias("reference_id"), F.lit(True).alias("superseded")).distinct()
    held = published.select("reference_id", F.lit(True).alias("in_published")).distinct()
    listed = F.array_join(F.array_sort(F.collect_set("pos")).cast("array<string>"), ",")
    said = mentions.groupBy("document_id", "reference_id").agg(listed.alias("sections"))
    out = rows.join(old, "reference_id", "left").join(held, "reference_id", "left").join(said, ["document_id", "reference_id"], "left")
    return out.na.fill({"superseded": False, "in_published": False, "sections": ""})


def reference_union(mentions: DataFrame, ref: DataFrame) -> DataFrame:
    """(document_id, reference_id) cited or owned, once each."""
    return mentions.select("document_id", "reference_id").union(ref.select("document_id", F.col("id"))).distinct()


def supersede_references(ref: DataFrame, edits: DataFrame, frozen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to write, map old_id - new_id for drafts). Never frozen: edited in place; frozen: a new row that supersedes."""
    e = edits.join(ref.select("id", "document_id"), "id").join(frozen.select("id", F.lit(True).alias("_f")).distinct(), "id", "left")
    new = F.substring(F.sha2(F.concat_ws("/", "id", "citation"), 256), 1, 12)
    rows = e.select(F.when(F.col("_f"), new).otherwise(F.col("id")).alias("id"), "document_id", "citation", F.when(F.col("_f"), F.col("id")).alias("supersedes"))
    return rows, e.filter("_f").select(F.col("id").alias("old_id"), new.alias("new_id"))


#: Words that initials leave out.
SMALL_WORDS = ("of", "and", "the", "for", "on", "in", "to", "a", "an")
#: What resolves a citation, in this order; "abbreviation" looks for an entry that is listed by its initials.
RULES = ("exact", "prefix", "initials", "abbreviation", "tail", "year slip")
_YEAR = r"^(?:19|20)\d\d[a-z]?$"


def _initials(words: Column) -> Column:
    return F.array_join(F.transform(F.filter(words, lambda w: (w != "") & ~w.isin(*SMALL_WORDS)), lambda w: F.substring(w, 1, 1)), "")


def _last(words: Column, n: int) -> Column:
    return F.array_join(F.slice(words, F.greatest(F.size(words) - (n - 1), F.lit(1)), n), " ")


def _listed(keys: DataFrame) -> DataFrame:
    """(list_id, kind, form, n, r): for every form that an entry can be asked by, how many entries have it (0, 1, or 2 for
    more) and the least of them. Entries of one name and year are one row before they are unfolded into forms, and forms
    are counted before anything is joined with them; the least and the greatest entry tell one from several."""
    keys = keys.groupBy("list_id", "name", "year").agg(F.min("reference_id").alias("r"), F.max("reference_id").alias("_most"))
    words = F.split("name", " ")
    form = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("form"))
    dated = lambda text: F.concat(text, F.lit("/"), F.col("year"))
    heads = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: form("prefix", dated(F.array_join(F.slice(words, F.lit(1), n), " "))))
    some = [form("exact", dated(F.col("name"))), form("initials", dated(_initials(words))), form("tail 1", dated(_last(words, 1))), form("year slip", F.col("name"))]
    three = F.when(F.size(words) >= 3, F.array(form("tail 3", dated(_last(words, 3))))).otherwise(F.array(form("none", F.lit(""))))
    plain = F.array(form("year", F.concat("name", F.lit("/"), F.substring("year", 1, 4))))
    forms = keys.select("list_id", "r", "_most", F.explode(F.concat(F.array(*some), heads, three, plain)).alias("f")).select("list_id", "r", "_most", "f.*")
    held = forms.filter("kind <> 'none'").groupBy("list_id", "kind", "form").agg(F.min("r").alias("r"), F.max("_most").alias("_most"))
    n = F.when(F.col("r").isNull(), 0).when(F.col("r") == F.col("_most"), 1).otherwise(2)
    return held.select("list_id", "kind", "form", n.alias("n"), "r")


def resolve_citations(mentions: DataFrame, keys: DataFrame) -> DataFrame:
    """(mention, reference_id, rule) of mentions (mention, list_id, name, year) by entries (reference_id, list_id, name, year) of
    the same list; names are lower-case words apart by one blank, years texts such as 2018 or 2018b.

    The first rule with exactly one entry resolves: the exact name and year; a name of that year which begins with the
    whole words of the one cited; the initials of a name of that year, for a cited name of two to seven letters; an entry
    listed by the initials of the cited name; the same last three words in that year, or the last word for a cited name
    of one word of eight letters or more; the same name in another year, recorded as a year slip. What none resolves has
    no reference and a reason: "several entries" of that name and year, "other years", or "no entry".

    Each distinct name and year is looked up once by all its forms, in one join with the counted forms of the entries."""
    words = F.split("name", " ")
    dated = lambda text: F.concat(text, F.lit("/"), F.col("year"))
    ask = lambda rule, kind, text: F.struct(F.lit(RULES.index(rule) if rule in RULES else len(RULES)).alias("at"), F.lit(kind).alias("kind"), text.alias("form"))
    tail = F.when(F.size(words) >= 3, F.struct(F.lit(4).alias("at"), F.lit("tail 3").alias("kind"), dated(_last(words, 3)).alias("form")))
    tail = tail.when((F.size(words) == 1) & (F.length("name") >= 8), F.struct(F.lit(4).alias("at"), F.lit("tail 1").alias("kind"), dated(F.col("name")).alias("form")))
    asked = F.array(
        ask("exact", "exact", dated(F.col("name"))),
        ask("prefix", "prefix", dated(F.col("name"))),
        F.when(F.col("name").rlike("^[a-z]{2,7}$"), ask("initials", "initials", dated(F.col("name")))),
        F.when(F.col("name").contains(" "), ask("abbreviation", "exact", dated(_initials(words)))),
        tail,
        ask("year slip", "year slip", F.col("name")),
        ask("", "year", F.concat("name", F.lit("/"), F.substring("year", 1, 4))),
    )
    good = (F.col("name") != "") & F.col("year").rlike(_YEAR)
    cited = mentions.filter(good).select("list_id", "name", "year").distinct()
    forms = cited.select("*", F.explode(F.array_compact(asked)).alias("a")).select("list_id", "name", "year", "a.*")
    met = forms.join(_listed(keys.filter(good)), ["list_id", "kind", "form"])
    known = met.groupBy("list_id", "name", "year").agg(
        F.min(F.when((F.col("n") == 1) & (F.col("at") < len(RULES)), F.struct("at", "r"))).alias("hit"),
        F.max(F.when(F.col("kind") == "year", F.col("n"))).alias("same"),
        F.max(F.when(F.col("kind") == "year slip", F.col("n"))).alias("any"),
    )
    out = mentions.join(known, ["list_id", "name", "year"], "left")
    miss = F.when((F.coalesce("same", F.lit(0)) > 1) & ~F.col("year").rlike("[a-z]$"), "several entries").when(F.coalesce("any", F.lit(0)) > 0, "other years").otherwise("no entry")
    rule = F.when(F.col("hit").isNotNull(), F.get(F.array(*map(F.lit, RULES)), F.col("hit.at"))).otherwise(miss)
    return out.select("mention", F.col("hit.r").alias("reference_id"), rule.alias("rule"))


def undefined_markers(markers: DataFrame, entries: DataFrame) -> DataFrame:
    """Numbered markers that the page's list lacks: both (list_id, number)."""
    return markers.join(entries.select("list_id", "number").distinct(), ["list_id", "number"], "left_anti")
