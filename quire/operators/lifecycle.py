"""Batch transforms of the corpus: writes as tables of deltas, with rejects instead of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.settled import settle
from .citations import citation_numbers
from .nodes import citations_in, content_hash, explode_body
from .versions import review_state
from .render import publish_body, render_markdown


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """target with the rows of updates put in or in place of those with equal keys; twice is as once."""
    return target.join(updates.select(*keys), keys, "left_anti").unionByName(updates)


def replace_partition_prune(target: DataFrame, fresh: DataFrame, part_key: str) -> DataFrame:
    """target with each partition that fresh has replaced by fresh's rows."""
    return target.join(fresh.select(part_key).distinct(), part_key, "left_anti").unionByName(fresh)


def stale_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti")


def backfill(target: DataFrame, source: DataFrame, key: str, col: str) -> DataFrame:
    """target with nulls in col filled from source."""
    return target.join(source.select(key, F.col(col).alias("_s")), key, "left").withColumn(col, F.coalesce(col, "_s")).drop("_s")


def pending_work(versions: DataFrame, vsec: DataFrame, index: DataFrame) -> DataFrame:
    """Published versions that are not rendered yet, or not indexed: (version_id, work)."""
    pub = versions.filter("status = 'published'").select("version_id")
    bare = vsec.filter("html is null").join(pub, "version_id", "left_semi").select("version_id").distinct().withColumn("work", F.lit("render"))
    return bare.unionByName(pub.join(index.select("version_id").distinct(), "version_id", "left_anti").withColumn("work", F.lit("index")))


def assemble_documents(vsec: DataFrame, by: str, order: str, title: Column, body: Column) -> DataFrame:
    """(by, text): the sections in order, each a heading line and its body."""
    one = F.concat(F.lit("## "), title, F.lit("\n"), body)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, one.alias("t")))), lambda x: x["t"])
    return vsec.groupBy(by).agg(F.array_join(parts, "\n\n").alias("text"))


def write_ledger(df: DataFrame, path: str, by: str = "document_id") -> None:
    """One JSON line for each document: its placements and their counts, in folders by nothing but part files."""
    rows = df.groupBy(by).agg(F.count("*").alias("placed"), F.array_sort(F.collect_list(F.struct("how", "section"))).alias("placements"))
    rows.write.mode("overwrite").json(path)


def freeze(ver: DataFrame, draft: DataFrame, published: DataFrame, ready: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(version changes, frozen sections) of ready documents: the draft is published, the incumbent archived, a new draft
    opened; each frozen section carries the version that last changed it.

    ver: (version_id, document_id, version_no, status); draft and published: their sections, published with
    last_changed_version_no."""
    v = ver.join(ready.select("document_id").distinct(), "document_id")
    moved = v.filter("status in ('draft', 'published')").withColumn("status", F.when(F.col("status") == "draft", "published").otherwise("archived"))
    opened = v.filter("status = 'draft'").select((-F.col("version_id")).alias("version_id"), "document_id", (F.col("version_no") + 1).alias("version_no"), F.lit("draft").alias("status"))
    was = published.select("document_id", "section_id", F.col("body_hash").alias("_h"), F.col("hidden").alias("_hid"), F.col("last_changed_version_no").alias("_l"))
    now = draft.join(v.filter("status = 'draft'").select("document_id", "version_no"), "document_id").join(was, ["document_id", "section_id"], "left")
    same = (F.col("_h") == F.col("body_hash")) & (F.col("_hid") == F.col("hidden"))
    frozen = now.withColumn("last_changed_version_no", F.when(same, F.col("_l")).otherwise(F.col("version_no")))
    return moved.select("version_id", "document_id", "version_no", "status").unionByName(opened), frozen.select("document_id", "section_id", "version_no", "body_hash", "last_changed_version_no")


def freeze_bodies(sections: DataFrame, documents: DataFrame, before: DataFrame) -> DataFrame:
    """The sections of ready documents as a new version holds them: (document_id, section_id, order_index, hidden, body_hash,
    markdown, last_changed_version_no).

    sections: (document_id, section_id, order_index, hidden, body_json) with shared bodies resolved already; documents:
    (document_id, subject, template, version_no); before: the incumbent's (document_id, section_id, body_hash, hidden,
    last_changed_version_no). Bodies are published, hashed and rendered; citations are numbered through the document over
    its sections that are shown, others have no number there. A section whose hash and hidden flag stay keeps the version
    that last changed it. Sections without a body have an empty text and no hash."""
    return carried_versions(written_sections(sections, documents), before)


def written_sections(sections: DataFrame, documents: DataFrame) -> DataFrame:
    """The sections of documents with body_hash and markdown, as freeze_bodies() has them; other columns of documents than
    (document_id, subject, template) stay with their sections."""
    at = settle(sections.join(documents, "document_id").withColumn("_key", F.struct("document_id", "order_index", "section_id")))
    published = settle(publish_body(explode_body(at, "body_json", "_key"), at.select("_key", "subject", "template"), "_key"))
    shown = citations_in(published.join(at.filter("not hidden").select("_key"), "_key", "left_semi"), key="_key")
    placed = shown.select(F.col("_key.document_id").alias("document_id"), F.struct("_key", "place").alias("pos"), "reference_id")
    numbers = citation_numbers(placed)
    each = published.filter("type = 'citation'").select("_key", F.get_json_object("attrs", "$.referenceId").alias("reference_id")).distinct()
    numbers = each.withColumn("document_id", F.col("_key.document_id")).join(numbers, ["document_id", "reference_id"]).select("_key", "reference_id", "number")
    written = render_markdown(published, numbers, key="_key")
    hashed = content_hash(published, "_key").withColumnRenamed("content_hash", "body_hash")
    rows = at.drop("body_json", "subject", "template").join(hashed, "_key", "left").join(written, "_key", "left").drop("_key")
    return rows.withColumn("markdown", F.coalesce("markdown", F.lit("")))


def carried_versions(written: DataFrame, before: DataFrame) -> DataFrame:
    """What freeze_bodies() returns, of written_sections() with version_no."""
    was = before.select("document_id", "section_id", F.col("body_hash").alias("_h"), F.col("hidden").alias("_hid"), F.col("last_changed_version_no").alias("_l"))
    rows = written.join(was, ["document_id", "section_id"], "left")
    same = F.col("_l").isNotNull() & F.col("_h").eqNullSafe(F.col("body_hash")) & F.col("_hid").eqNullSafe(F.col("hidden"))
    last = F.when(same, F.col("_l")).otherwise(F.col("version_no")).alias("last_changed_version_no")
    return rows.select("document_id", "section_id", "order_index", "hidden", "body_hash", "markdown", last)


def core_version_used(sec: DataFrame, core_versions: DataFrame) -> DataFrame:
    """(document_id, core_version_id): by any shared section. core_versions: (core_id, version_id)."""
    return sec.filter("core_id is not null").join(core_versions, "core_id").groupBy("document_id").agg(F.max("version_id").alias("core_version_id"))


def refresh_shared_hashes(sec: DataFrame, core: DataFrame) -> DataFrame:
    """Sharers whose stored hash differs from the core's now: (document_id, section_id, body_hash)."""
    now = core.select(F.col("section_id").alias("core_id"), F.col("body_hash").alias("_now"))
    return sec.join(now, "core_id").filter(~F.col("body_hash").eqNullSafe(F.col("_now"))).select("document_id", "section_id", F.col("_now").alias("body_hash"))


def diverge(sec: DataFrame, core: DataFrame, ids: DataFrame) -> DataFrame:
    """The asked-for sharers as owners of a copy of the core body."""
    body = core.select(F.col("section_id").alias("core_id"), F.col("body").alias("_b"))
    return sec.filter("core_id is not null").join(ids, ["document_id", "section_id"], "left_semi").join(body, "core_id", "left").select("document_id", "section_id", "core_id", F.lit(True).alias("diverged"), F.col("_b").alias("body"))


def revert(sec: DataFrame, ids: DataFrame) -> DataFrame:
    """The asked-for diverged sections as references again: their own body goes, the core's shows."""
    own = sec.filter("core_id is not null and diverged").join(ids, ["document_id", "section_id"], "left_semi")
    return own.select("document_id", "section_id", "core_id", F.lit(False).alias("diverged"), F.lit(None).cast("string").alias("body"))


def apply_decisions(pins: DataFrame, rev: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pins with new decisions, rejects): superseded reviews and sections outside the review are refused.

    pins: (review_id, section_id, decision), rev: (review_id, superseded), decisions: (review_id, section_id, new)."""
    d = decisions.join(rev.select("review_id", "superseded"), "review_id", "left").join(pins.select("review_id", "section_id", F.lit(True).alias("_in")), ["review_id", "section_id"], "left")
    why = F.when(F.col("superseded").isNull(), "no such review").when(F.col("superseded"), "the review is superseded").when(F.col("_in").isNull(), "not in the review")
    good = d.filter(why.isNull()).select("review_id", "section_id", "new")
    out = pins.join(good, ["review_id", "section_id"]).select("review_id", "section_id", F.col("new").alias("decision"))
    return out, d.filter(why.isNotNull()).select("review_id", "section_id", why.alias("reason"))


def newly_decided(rev: DataFrame, pins: DataFrame, applied: DataFrame) -> DataFrame:
    """(review_id, decision) of reviews that decisions have just decided: open before, and not after. applied: what
    apply_decisions() returns of the pins (review_id, section_id, decision)."""
    key = ["review_id", "section_id"]
    after = pins.join(applied.select(*key, F.col("decision").alias("_new")), key, "left").withColumn("decision", F.coalesce("_new", "decision")).drop("_new")
    state = lambda p, name: review_state(rev.select("review_id"), p).select("review_id", F.col("decision").alias(name))
    both = state(pins, "_was").join(state(after, "decision"), "review_id")
    return both.filter("_was is null and decision is not null").select("review_id", "decision")


def apply_flags(rows: DataFrame, flags: DataFrame, key: str, column: str, guard: Column) -> DataFrame:
    """(key, column) of the rows whose flag changes, where the guard allows it."""
    return rows.filter(guard).join(flags.select(key, F.col(column).alias("_new")), key).filter(~F.col(column).eqNullSafe(F.col("_new"))).select(key, F.col("_new").alias(column))


def legacy_keys(outlined: DataFrame, chapters: list[tuple[str, str]], slug) -> DataFrame:
    """(id, key): a chapter's key by the first pattern that its title fits; below it the parent's key and the title's slug.

    outlined: with ancestors, id and title. Titles on the way are joined by id, so no level needs a join of its own."""
    base = F.lit(None)
    for pattern, key in reversed(chapters):
        base = F.when(F.col("title").rlike(pattern), key).otherwise(base)
    names = outlined.select(F.col("id").alias("a"), F.when(F.size("ancestors") == 1, F.coalesce(base, slug("title"))).otherwise(slug("title")).alias("part"))
    steps = outlined.select("id", F.posexplode("ancestors").alias("at", "a")).join(names, "a")
    return steps.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "/").alias("key"))


def ownership_of(runs: DataFrame, marks: list[str]) -> DataFrame:
    """owned where a run of the section bears one of the marks, else shared."""
    return runs.groupBy("section_id").agg(F.when(F.max(F.col("mark").isin(marks)), "owned").otherwise("shared").alias("ownership"))


def learn_styles(lines: DataFrame, least: int = 2) -> DataFrame:
    """(level, size, bold, n): heading styles seen often enough, or the only one of their level.

    lines: (level, size, bold) of known headings."""
    g = lines.groupBy("level", "size", "bold").agg(F.count("*").alias("n"))
    return g.withColumn("_k", F.count("*").over(Window.partitionBy("level"))).filter((F.col("n") >= least) | (F.col("_k") == 1)).drop("_k")
