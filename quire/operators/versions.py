"""Versions, editions, reviews and the register of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.settled import settle


def published_versions(doc: DataFrame, ver: DataFrame) -> DataFrame:
    return doc.join(ver.filter("status = 'published'"), "document_id")


def published_sections(ver: DataFrame, vsec: DataFrame) -> DataFrame:
    """Visible frozen sections of published versions."""
    return vsec.filter("not hidden").join(ver.filter("status = 'published'").select("version_id", "document_id", "version_no"), "version_id")


def resolve_slug(q: DataFrame, doc: DataFrame, ver: DataFrame) -> DataFrame:
    """(query_id, document_id, version_id, found): a partner slug beats an own one; without a number the published
    version, with one that version if it is published or archived. Misses have nulls. q: (query_id, slug, version_no)."""
    names = doc.select(F.explode(F.array(F.struct(F.col("partner_slug").alias("slug"), F.lit(0).alias("rank")), F.struct(F.col("slug"), F.lit(1).alias("rank")))).alias("x"), "document_id")
    names = names.select("x.slug", "x.rank", "document_id").filter("slug is not null")
    best = q.join(names, "slug").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "document_id"))).filter("n = 1")
    open_ = ver.filter("status in ('published', 'archived')").select("document_id", "version_id", F.col("version_no").alias("no"), "status")
    hit = best.join(open_, "document_id").filter(F.when(F.col("version_no").isNull(), F.col("status") == "published").otherwise(F.col("no") == F.col("version_no")))
    out = q.select("query_id").join(hit.select("query_id", "document_id", "version_id"), "query_id", "left")
    return out.withColumn("found", F.col("version_id").isNotNull())


def review_state(rev: DataFrame, rsec: DataFrame) -> DataFrame:
    """Per review total, decided, approved and changes_requested; any change decides against, all decided approve."""
    n = rsec.groupBy("review_id").agg(F.count("*").alias("total"), F.count("decision").alias("decided"), F.count_if(F.col("decision") == "approved").alias("approved"), F.count_if(F.col("decision") == "changes_requested").alias("changes_requested"))
    out = rev.join(n, "review_id", "left").na.fill(0, ["total", "decided", "approved", "changes_requested"])
    state = F.when(F.col("changes_requested") > 0, "changes_requested").when((F.col("total") > 0) & (F.col("decided") == F.col("total")), "approved")
    return out.withColumn("decision", state)


def current_review(review_state: DataFrame) -> DataFrame:
    """The latest review of each version."""
    w = Window.partitionBy("version_id").orderBy(F.desc("requested_at"), F.desc("review_id"))
    return review_state.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def superseded_reviews(rev: DataFrame) -> DataFrame:
    """Adds superseded: a later review stands on the same version."""
    return rev.withColumn("superseded", F.max("requested_at").over(Window.partitionBy("version_id")) > F.col("requested_at"))


def draft_and_published(ver: DataFrame, vsec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sections of each document's draft and of its published version."""
    side = lambda status: vsec.join(ver.filter(F.col("status") == status).select("version_id", "document_id"), "version_id")
    return side("draft"), side("published")


def tick_states(draft: DataFrame, published: DataFrame, rsec: DataFrame) -> DataFrame:
    """(document_id, section_id, order_index, state): the review's decision where one pins the section, else new,
    published or changed by hash."""
    p = published.select("document_id", "section_id", F.col("body_hash").alias("_was"))
    pins = rsec.select("document_id", "section_id", F.coalesce("decision", F.lit("in_review")).alias("_pin"))
    out = draft.join(p, ["document_id", "section_id"], "left").join(pins, ["document_id", "section_id"], "left")
    state = F.when(F.col("_pin").isNotNull(), F.col("_pin")).when(F.col("_was").isNull(), "new").when(F.col("_was") == F.col("body_hash"), "published").otherwise("changed")
    return out.select("document_id", "section_id", "order_index", state.alias("state"))


def tick_summary(ticks: DataFrame) -> DataFrame:
    """Sections of each state per document."""
    is_ = lambda *s: F.count_if(F.col("state").isin(list(s)))
    return ticks.groupBy("document_id").agg(is_("published").alias("published"), is_("changed", "new").alias("changed"), is_("in_review").alias("in_review"), is_("approved").alias("approved"), is_("changes_requested").alias("changes_requested"))


def tick_runs(ticks: DataFrame) -> DataFrame:
    """Runs of equal states in reading order: (document_id, run, state, length)."""
    w = Window.partitionBy("document_id").orderBy("order_index", "section_id")
    new = F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(1))
    runs = ticks.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("document_id", "run").agg(F.first("state").alias("state"), F.count("*").alias("length"))


def atlas(ticks: DataFrame, bands: DataFrame) -> DataFrame:
    """Per document and band: the states in reading order and how many are changed. bands: (section_id, band)."""
    g = ticks.join(bands, "section_id").groupBy("document_id", "band")
    states = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "section_id", "state"))), lambda x: x["state"]), ",")
    return g.agg(states.alias("ticks"), F.count_if(F.col("state").isin("changed", "new")).alias("changed"))


def band_detail(ticks: DataFrame, bands: DataFrame, document, band) -> DataFrame:
    return ticks.join(bands, "section_id").filter((F.col("document_id") == document) & (F.col("band") == band))


def last_change(rows: DataFrame, by: str, at: str, who: str) -> DataFrame:
    """The latest change of each document and its author; of equal times the greatest author."""
    return rows.groupBy(by).agg(F.max(F.struct(at, who)).alias("x")).select(by, F.col(f"x.{at}").alias("changed_at"), F.col(f"x.{who}").alias("changed_by"))


def last_changed_version(vsec: DataFrame, ver: DataFrame) -> DataFrame:
    """Adds last_changed_version_no: the version in which the section's text or hidden flag last differed."""
    w = Window.partitionBy("document_id", "section_id").orderBy("version_no")
    rows = vsec.join(ver.select("version_id", "document_id", "version_no"), "version_id")
    same = (F.lag("body_hash").over(w) == F.col("body_hash")) & (F.lag("hidden").over(w) == F.col("hidden"))
    since = F.when(~F.coalesce(same, F.lit(False)), F.col("version_no"))
    return rows.withColumn("_since", since).withColumn("last_changed_version_no", F.last("_since", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_since")


def editions_imprint(changed: DataFrame) -> DataFrame:
    """Per version: visible sections, and those last changed in it."""
    return changed.filter("not hidden").groupBy("document_id", "version_no").agg(F.count("*").alias("sections"), F.count_if(F.col("last_changed_version_no") == F.col("version_no")).alias("changed"))


def next_version_no(ver: DataFrame) -> DataFrame:
    return ver.groupBy("document_id").agg((F.max("version_no") + 1).alias("next_no"), F.count_if(F.col("status") == "draft").alias("drafts"))


def version_history(ver: DataFrame) -> DataFrame:
    """Adds place: 1 is the newest version of the document."""
    return ver.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("version_no"))).cast("long"))


def recent_activity(ev: DataFrame, n: int = 30) -> DataFrame:
    w = Window.partitionBy("document_id").orderBy(F.desc("at"), F.desc("event_id"))
    return ev.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= n)


def newest_published(published: DataFrame, n: int) -> DataFrame:
    return published.orderBy(F.desc("published_at"), "document_id").limit(n)


def standing(register: DataFrame) -> DataFrame:
    """One line for each document of a register (in_review, decided, total, changed, published_no)."""
    s = (
        F.when(F.col("published_no").isNull(), "Not published").when(F.col("in_review") & (F.col("decided") < F.col("total")), F.concat(F.lit("In review: "), F.col("decided").cast("string"), F.lit(" of "), F.col("total").cast("string")))
        .when(F.col("changed") > 0, F.concat(F.col("changed").cast("string"), F.when(F.col("changed") == 1, " change").otherwise(" changes"), F.lit(" since edition "), F.col("published_no").cast("string")))
        .otherwise(F.concat(F.lit("Edition "), F.col("published_no").cast("string")))
    )
    return register.withColumn("standing", s)


def register_filter(register: DataFrame, name: str = "all", text: str = "") -> DataFrame:
    """all, in_review, changed, unpublished or pending, and a substring of any of four fields."""
    keep = {"all": F.lit(True), "in_review": F.col("in_review"), "changed": F.col("changed") > 0, "unpublished": F.col("published_no").isNull(), "pending": F.col("org").startswith("pending:")}[name]
    found = F.lower(F.concat_ws("\n", "title", "slug", "org", "subject")).contains(text.lower())
    return register.filter(keep & found)


def pending_documents(register: DataFrame) -> DataFrame:
    return register.filter(F.col("org").startswith("pending:"))


def order_register(register: DataFrame, by: str) -> DataFrame:
    """Adds place: by name, most changed or most recent, ties by name."""
    keys = {"name": [], "changed": [F.desc("changed")], "recent": [F.desc("updated")]}[by]
    return register.withColumn("place", F.row_number().over(Window.partitionBy("org").orderBy(*keys, "title", "document_id")).cast("long"))


def register_totals(register: DataFrame) -> DataFrame:
    return register.agg(F.count("*").alias("documents"), F.count_if("in_review").alias("in_review"), F.count_if(F.col("changed") > 0).alias("changed"), F.count_if(F.col("published_no").isNull()).alias("unpublished"))


def band_density(atlas: DataFrame) -> DataFrame:
    """The most sections that any document has in each band."""
    return atlas.groupBy("band").agg(F.max(F.size(F.split("ticks", ","))).cast("long").alias("most"))


def document_list_state(doc: DataFrame, ver: DataFrame, review_state: DataFrame) -> DataFrame:
    """(document_id, published_no, in_review): whether the draft has an undecided review that none supersedes."""
    p = ver.filter("status = 'published'").groupBy("document_id").agg(F.max("version_no").alias("published_no"))
    now = current_review(review_state).filter("decision is null and total > 0").select("version_id")
    d = ver.filter("status = 'draft'").join(now, "version_id", "left_semi").select("document_id").distinct().withColumn("in_review", F.lit(True))
    return doc.select("document_id").join(p, "document_id", "left").join(d, "document_id", "left").na.fill(False, ["in_review"])


def needs_attention(changes: DataFrame, review_state: DataFrame) -> DataFrame:
    """Changes that ask for action: undecided while the review is open, sent back once it is decided, all without one.

    changes: (document_id, section_id, decision), review_state: (document_id, decision as the review's)."""
    r = review_state.select("document_id", F.col("decision").alias("_r"), F.lit(True).alias("_has"))
    want = F.when(F.col("_has").isNull(), F.lit(True)).when(F.col("_r").isNull(), F.col("decision").isNull()).otherwise(F.col("decision") == "changes_requested")
    return changes.join(r, "document_id", "left").filter(F.coalesce(want, F.lit(False))).select("document_id", "section_id")


def compare_editions(left: DataFrame, right: DataFrame, by: str = "document_id") -> DataFrame:
    """Sections that differ between two editions: added, removed, changed, hidden or shown."""
    side = lambda d, s: d.select(by, "section_id", F.col("body_hash").alias(f"{s}_hash"), F.col("hidden").alias(f"{s}_hidden"), F.lit(True).alias(f"{s}_in"))
    both = side(left, "l").join(side(right, "r"), [by, "section_id"], "full_outer")
    change = (
        F.when(F.col("l_in").isNull(), F.when(~F.col("r_hidden"), "added")).when(F.col("r_in").isNull(), F.when(~F.col("l_hidden"), "removed"))
        .when(F.col("l_hidden") & F.col("r_hidden"), None).when(F.col("r_hidden"), "hidden").when(F.col("l_hidden"), "shown").when(F.col("l_hash") != F.col("r_hash"), "changed")
    )
    return both.withColumn("change", change).filter("change is not null").select(by, "section_id", "change")


def edition_changes(left: DataFrame, right: DataFrame, outline: DataFrame, by: str = "document_id") -> DataFrame:
    """compare_editions() as a reader sees it: with each section's band and its place, bands and sections in the order of the
    outline (by, section_id, band, position); what the outline does not have comes last, in a band of its own."""
    found = compare_editions(left, right, by).join(outline.select(by, "section_id", "band", "position"), [by, "section_id"], "left")
    first = F.min("position").over(Window.partitionBy(by, "band"))
    order = (F.col("_first").asc_nulls_last(), F.col("position").asc_nulls_last(), F.col("section_id"))
    placed = found.withColumn("_first", first).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))
    return placed.select(by, "section_id", "change", F.coalesce("band", F.lit("outside")).alias("band"), "place")


def compose(a: DataFrame, b: DataFrame, by: str = "pair") -> DataFrame:
    """a's sections in order, each followed by b's owned section at its address; b's others at the end."""
    x = a.select(by, "address", F.col("order_index").alias("_at"), F.lit("a").alias("source"))
    own = b.filter("owned").select(by, "address", F.col("order_index").alias("_own"))
    y = own.join(x.select(by, "address", "_at"), [by, "address"], "left").select(by, "address", "_at", F.lit("b").alias("source"), "_own")
    rows = x.withColumn("_own", F.lit(None).cast("double")).unionByName(y)
    w = Window.partitionBy(by).orderBy(F.col("_at").asc_nulls_last(), "source", "_own", "address")
    return rows.withColumn("place", F.row_number().over(w).cast("long")).select(by, "place", "address", "source")


def resolve_shared(sec: DataFrame, core_published: DataFrame, core_draft: DataFrame) -> DataFrame:
    """Adds body and core_source: a shared section (core_id set) takes the core's published body, else its draft one."""
    p = core_published.select(F.col("section_id").alias("core_id"), F.col("body").alias("_p"))
    q = core_draft.select(F.col("section_id").alias("core_id"), F.col("body").alias("_d"))
    out = sec.withColumnRenamed("body", "_own").join(p, "core_id", "left").join(q, "core_id", "left")
    source = F.when(F.col("core_id").isNull(), "own").when(F.col("_p").isNotNull(), "published").when(F.col("_d").isNotNull(), "draft")
    body = F.when(F.col("core_id").isNull(), F.col("_own")).otherwise(F.coalesce("_p", "_d"))
    return out.withColumn("body", body).withColumn("core_source", source).drop("_own", "_p", "_d")


def section_mark(rows: DataFrame) -> DataFrame:
    """Adds mark: shared, diverged, owned, scaffold or instructions."""
    m = F.when(F.col("apparatus"), "instructions").when(F.col("core_id").isNotNull() & ~F.col("diverged"), "shared").when(F.col("core_id").isNotNull(), "diverged").when(F.col("body").isNull(), "scaffold").otherwise("owned")
    return rows.withColumn("mark", m)


def diverged_from(sec: DataFrame) -> DataFrame:
    """Per core section: the documents that own a copy of it, sorted."""
    own = sec.filter("core_id is not null and diverged").groupBy("core_id")
    return own.agg(F.array_join(F.array_sort(F.collect_set(F.col("document_id").cast("string"))), ",").alias("documents"), F.countDistinct("document_id").alias("n"))


def reviewable_changes(draft: DataFrame, published: DataFrame) -> DataFrame:
    """Changes of a draft against the published version: changed and new texts of sections that are shown, and removals.

    draft: (document_id, section_id, parent_id, order_index, hidden, apparatus, body_hash); a section without parent_id or
    apparatus columns has none. What stands beneath a hidden section or an apparatus is not shown, at any depth. A removal is
    the topmost section of what was hidden since: hidden in the draft with a parent that is not, and not hidden as published."""
    for c, t in (("parent_id", dict(draft.dtypes)["section_id"]), ("apparatus", "boolean")):
        if c not in draft.columns:
            draft = draft.withColumn(c, F.lit(None).cast(t))
    key = ["document_id", "section_id"]
    draft = settle(draft.withColumn("apparatus", F.coalesce("apparatus", F.lit(False))))
    p = published.select(*key, F.col("body_hash").alias("_h"), F.col("hidden").alias("_hid"), F.lit(True).alias("_was"))
    parent = draft.select("document_id", F.col("section_id").alias("parent_id"), F.col("hidden").alias("_up"))
    # What is not shown: level by level downwards from sections that are left out themselves.
    out = level = settle(draft.filter(F.col("hidden") | F.col("apparatus")).select(*key))
    while True:
        below = draft.join(level.withColumnRenamed("section_id", "parent_id"), ["document_id", "parent_id"], "left_semi").select(*key)
        level = settle(below.join(out, key, "left_anti"))
        if level.isEmpty():
            break
        out = settle(out.unionByName(level))
    # One pass tells both: what is removed is left out, so no section is changed and removed.
    both = draft.join(p, key, "left").join(out.distinct().withColumn("_out", F.lit(True)), key, "left").join(parent, ["document_id", "parent_id"], "left")
    text = F.when(F.col("_was").isNull(), "new").when(~F.col("_h").eqNullSafe(F.col("body_hash")), "changed")
    top = F.col("hidden") & ~F.coalesce("_up", F.lit(False)) & ~F.col("apparatus") & ~F.coalesce("_hid", F.lit(False))
    change = F.when(top, "removed").when(F.col("_out").isNull(), text)
    return both.withColumn("change", change).filter("change is not null").select("document_id", "section_id", "order_index", "change", "body_hash")


def changes_union(changes: DataFrame) -> DataFrame:
    """Adds place: the changes in reading order."""
    return changes.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("order_index", "section_id")).cast("long"))


def structure_changes(draft: DataFrame, published: DataFrame) -> DataFrame:
    """Sections hidden since, and added since, the published version."""
    p = published.select("document_id", "section_id", F.col("hidden").alias("_was"))
    both = draft.join(p, ["document_id", "section_id"], "left")
    what = F.when(F.col("_was").isNull(), "added").when(F.col("hidden") & ~F.col("_was"), "hidden")
    return both.withColumn("what", what).filter("what is not null").select("document_id", "section_id", "what")


def request_review(changes: DataFrame) -> DataFrame:
    """Pins for every change; documents without a change get no review."""
    review = F.substring(F.sha2(F.concat_ws("/", F.lit("review"), F.col("document_id").cast("string")), 256), 1, 16)
    return changes.select(review.alias("review_id"), "document_id", "section_id", "change", "body_hash")


def unreviewed_changes(changes: DataFrame, rsec: DataFrame) -> DataFrame:
    """Changes that no pin holds, or that a pin holds as another kind."""
    return changes.join(rsec.select("document_id", "section_id", "change"), ["document_id", "section_id", "change"], "left_anti")


def review_drift(pins: DataFrame, changes: DataFrame) -> DataFrame:
    """Pins that no longer hold: the hash moved, or the change was undone."""
    now = changes.select("document_id", "section_id", F.col("body_hash").alias("_now"))
    why = F.when(F.col("_now").isNull(), "undone").when(F.col("_now") != F.col("body_hash"), "stale")
    return pins.join(now, ["document_id", "section_id"], "left").withColumn("drift", why).filter("drift is not null").select("document_id", "section_id", "drift")


def review_progress(changes: DataFrame, pins: DataFrame, part) -> DataFrame:
    """Per document and part: changes under review and decided."""
    p = pins.select("document_id", "section_id", "decision", F.lit(1).alias("_pin"))
    return changes.join(p, ["document_id", "section_id"], "left").groupBy("document_id", part.alias("part")).agg(F.count("_pin").alias("covered"), F.count("decision").alias("decided"), F.count("*").alias("changes"))


def publish_readiness(documents: DataFrame, gates: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """One row per document and gate: (document_id, gate, level, n, sections, blocked). A gate is (name, level when it has
    rows, rows with document_id and section_id); without rows its level is ok. sections lists what to look at, in order;
    blocked holds for a document with any blocking gate."""
    rows = None
    for name, level, found in gates:
        listed = F.array_join(F.array_sort(F.collect_set("section_id")).cast("array<string>"), ",")
        n = found.groupBy("document_id").agg(F.count("*").alias("n"), listed.alias("sections"))
        one = documents.select("document_id").join(n, "document_id", "left").select("document_id", F.lit(name).alias("gate"), F.when(F.col("n") > 0, level).otherwise("ok").alias("level"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sections", F.lit("")).alias("sections"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("blocked", F.max(F.col("level") == "block").over(Window.partitionBy("document_id")))


def comment_threads(com: DataFrame) -> DataFrame:
    """(root, document_id, open, replies, body): comments without a parent that is there, and their replies in order."""
    known = com.select(F.col("id").alias("reply_to"), F.lit(True).alias("_there"))
    c = com.join(known, "reply_to", "left").withColumn("root", F.when(F.col("_there"), F.col("reply_to")).otherwise(F.col("id")))
    g = c.groupBy("root").agg(F.array_sort(F.collect_list(F.when(F.col("root") != F.col("id"), F.struct("created_at", "id")))).alias("r"))
    replies = F.array_join(F.transform("r", lambda x: x["id"].cast("string")), ",")
    return g.join(com.withColumnRenamed("id", "root"), "root").select("root", "document_id", "open", F.size("r").cast("long").alias("n_replies"), replies.alias("replies"))


def suggestions_for_core(com: DataFrame, sec: DataFrame) -> DataFrame:
    """Suggestions on sections that share a core section, grouped by it, open ones first, newest first.

    com: comments with section_id; sec: (section_id, core_id)."""
    s = com.filter("kind = 'suggestion' and reply_to is null").join(sec.filter("core_id is not null"), "section_id")
    w = Window.partitionBy("core_id").orderBy(F.desc("open"), F.desc("created_at"), F.desc("id"))
    return s.withColumn("place", F.row_number().over(w).cast("long")).select("core_id", "place", "id", "open")


def diversify(hits: DataFrame, by: str, n: int = 3, query: str = "query_id", rank: str = "rank") -> DataFrame:
    """The first n of each document in rank order, then the rest: adds place within the query."""
    within = F.row_number().over(Window.partitionBy(query, by).orderBy(rank))
    rows = hits.withColumn("_n", within)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(F.col("_n") > n, rank)).cast("long")).drop("_n")


def draft_reading(resolved: DataFrame, numbers: DataFrame, cites: DataFrame) -> DataFrame:
    """A draft as it would publish: visible sections in order with resolved bodies and the numbers of what they cite.

    resolved: (document_id, section_id, order_index, hidden, body); cites: (document_id, section_id, reference_id);
    numbers: (document_id, reference_id, number)."""
    live = resolved.filter("not hidden")
    n = cites.join(numbers, ["document_id", "reference_id"]).groupBy("document_id", "section_id").agg(F.array_join(F.array_sort(F.collect_set("number")).cast("array<string>"), ",").alias("cited"))
    w = Window.partitionBy("document_id").orderBy("order_index", "section_id")
    return live.withColumn("position", F.row_number().over(w).cast("long")).join(n, ["document_id", "section_id"], "left").select("document_id", "section_id", "position", "body", F.coalesce("cited", F.lit("")).alias("cited"))
