"""Operators on section trees: adjacency lists with id, parent_id and order_index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.settled import release, settle

#: Levels beyond which a tree is taken to hold a cycle.
DEEPEST = 64


def outline(sec: DataFrame, parent_key: str = "parent_id", order: str = "order_index") -> DataFrame:
    """Depth-first reading order. Adds root, depth, path (order keys from the root), ancestors (ids from the root, the
    row's own last), off (hidden itself or below a hidden row) and position (from 1, within the root).

    One join for each level, so a corpus of any number of documents takes as many joins as its deepest tree has levels.
    Levels are kept in files. Positions need no sort of a root's rows: a row stands one place after its parent and after the
    subtrees of the siblings before it, so only siblings share a window. Siblings of one order keep the order of their ids,
    each with all that is below it.
    """
    hidden = F.col("hidden") if "hidden" in sec.columns else F.lit(False)
    own = sec.withColumn("_hidden", F.coalesce(hidden, F.lit(False)))
    level = own.filter(F.col(parent_key).isNull()).select(
        "*", F.col("id").alias("root"), F.lit(0).alias("depth"), F.array(order).alias("path"), F.array("id").alias("ancestors"), F.col("_hidden").alias("off")
    )
    levels = []
    while True:
        level = settle(level)
        if level.isEmpty():
            if levels:  # else the empty level is the result
                release(level)
            break
        levels.append(level)
        if len(levels) > DEEPEST:
            raise ValueError(f"sections nest deeper than {DEEPEST} levels")
        above = level.select(F.col("id").alias("_up"), "root", "depth", "path", "ancestors", "off")
        level = own.join(above, own[parent_key] == above["_up"]).select(
            *own.columns, "root", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array(order)).alias("path"),
            F.concat("ancestors", F.array("id")).alias("ancestors"), (F.col("off") | F.col("_hidden")).alias("off"),
        )
    out = levels[0] if levels else level
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.join(_positions(out, parent_key, order), "id", "left").select(*out.columns, "position").drop("_hidden")


def _positions(out: DataFrame, parent_key: str, order: str) -> DataFrame:
    """(id, position): 1 for a root, and for other rows the steps of their ancestors and themselves added to it. A row's step
    is 1 and the sizes of the subtrees of the siblings before it."""
    size = out.select(F.explode("ancestors").alias("id")).groupBy("id").agg(F.count("*").alias("_size"))
    before = Window.partitionBy("root", parent_key).orderBy(order, "id").rowsBetween(Window.unboundedPreceding, -1)
    sized = out.filter("depth > 0").select("id", "root", parent_key, order).join(size, "id")
    step = sized.select(F.col("id").alias("_a"), (F.coalesce(F.sum("_size").over(before), F.lit(0)) + 1).alias("_step"))
    up = out.select("id", F.explode_outer(F.slice("ancestors", 2, DEEPEST)).alias("_a")).join(step, "_a", "left")
    return up.groupBy("id").agg((F.coalesce(F.sum("_step"), F.lit(0)) + 1).cast("long").alias("position"))


def orphans_last(outlined: DataFrame, sec: DataFrame, document: Column | str = "document_id") -> DataFrame:
    """The outline's rows, then those that it does not reach, in their own order: (id, position, orphan)."""
    lost = sec.join(outlined.select("id"), "id", "left_anti").select("id", "order_index", F.lit(True).alias("orphan"), F.lit(None).cast("long").alias("position"))
    rows = outlined.select("id", "order_index", F.lit(False).alias("orphan"), "position").unionByName(lost)
    return rows.orderBy("orphan", "position", "order_index", "id")


def live_sections(outlined: DataFrame) -> DataFrame:
    """Rows neither hidden nor below a hidden row."""
    return outlined.filter(~F.col("off"))


def subtree(outlined: DataFrame, roots: DataFrame) -> DataFrame:
    """(top, id, relative_depth) of each asked-for row and all below it; roots has the column id."""
    below = outlined.select("id", "depth", F.posexplode("ancestors").alias("_at", "top"))
    return below.join(roots.select(F.col("id").alias("top")).distinct(), "top").select("top", "id", (F.col("depth") - F.col("_at")).cast("long").alias("relative_depth"))


def root_of(outlined: DataFrame) -> DataFrame:
    return outlined.select("id", "root", F.when(F.size("ancestors") > 1, F.col("ancestors")[1]).otherwise(F.col("root")).alias("part"))


def topmost_hidden(sec: DataFrame) -> DataFrame:
    """Hidden rows whose parent is not hidden."""
    up = sec.select(F.col("id").alias("parent_id"), F.col("hidden").alias("_up"))
    return sec.filter("hidden").join(up, "parent_id", "left").filter(~F.coalesce("_up", F.lit(False))).drop("_up")


def visible_with_descendant(outlined: DataFrame, has: str) -> DataFrame:
    """(id, visible): visible if the row or any below it has content."""
    return outlined.select(F.explode("ancestors").alias("id"), F.col(has).alias("h")).groupBy("id").agg(F.max("h").alias("visible"))


def hide_subtrees(sec: DataFrame, outlined: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a new `hidden`, rejects). changes: (id, hide); showing below a hidden parent is refused."""
    up = sec.select(F.col("id").alias("parent_id"), F.col("hidden").alias("_up"))
    asked = changes.join(sec.select("id", "parent_id"), "id", "left").join(up, "parent_id", "left")
    bad = ~F.col("hide") & F.coalesce("_up", F.lit(False))
    rejects = asked.filter(bad).select(F.col("id").alias("key"), F.lit("the parent is hidden").alias("reason"))
    tops = asked.filter(~bad).select(F.col("id").alias("top"), "hide")
    hit = outlined.select("id", F.explode("ancestors").alias("top"), F.size("ancestors").alias("n")).join(tops, "top")
    # Where requests nest, the lowest one decides.
    deep = outlined.select(F.col("id").alias("top"), "depth")
    last = hit.join(deep, "top").groupBy("id").agg(F.max_by("hide", "depth").alias("hide"))
    moved = sec.select("id", "hidden").join(last, "id").filter(F.col("hidden") != F.col("hide")).select("id", F.col("hide").alias("hidden"))
    return moved, rejects


def move_subtrees(outlined: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, parent_id, order_index, depth of every row that a move changes, rejects). moves: (id, parent_id, order_index);
    a parent inside the moved subtree is refused."""
    at = outlined.select(F.col("id").alias("new_parent"), F.col("depth").alias("up_depth"), F.col("ancestors").alias("up_path"))
    here = outlined.select("id", F.col("depth").alias("old_depth"))
    asked = moves.select("id", F.col("parent_id").alias("new_parent"), F.col("order_index").alias("new_order")).join(at, "new_parent", "left").join(here, "id", "left")
    cycle, missing = F.array_contains("up_path", F.col("id")), F.col("up_depth").isNull() | F.col("old_depth").isNull()
    reason = F.when(missing, "no such section").when(cycle, "the parent is inside the subtree")
    rejects = asked.filter(reason.isNotNull()).select(F.col("id").alias("key"), reason.alias("reason"))
    good = asked.filter(reason.isNull()).select(F.col("id").alias("top"), "new_parent", "new_order", (F.col("up_depth") + 1 - F.col("old_depth")).alias("shift"))
    below = outlined.select("id", "parent_id", "order_index", "depth", F.explode("ancestors").alias("top")).join(good, "top")
    own = F.col("id") == F.col("top")
    return below.select("id", F.when(own, F.col("new_parent")).otherwise(F.col("parent_id")).alias("parent_id"), F.when(own, F.col("new_order")).otherwise(F.col("order_index")).alias("order_index"), (F.col("depth") + F.col("shift")).cast("long").alias("depth")), rejects


def delete_subtrees(outlined: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids to delete, rejects naming a blocker): only where every row of the subtree was added."""
    below = subtree(outlined, ids).join(outlined.select("id", "added"), "id")
    state = below.groupBy("top").agg(F.min(F.when(~F.col("added"), F.col("id"))).alias("blocker"))
    rejects = state.filter("blocker is not null").select(F.col("top").alias("key"), F.concat(F.lit("not added: "), "blocker").alias("reason"))
    return below.join(state.filter("blocker is null").select("top"), "top").select("id").distinct(), rejects


def scaffold(core: DataFrame, requests: DataFrame) -> DataFrame:
    """A tree for each requested document from the core rows: (document_id, id, parent_id, title, order_index, source_id).

    requests: (document_id, template). core: (template, id, parent_id, title, order_index). New ids are hashes of
    document and source, so parents are named without a second join.
    """
    new = lambda key: F.substring(F.sha2(F.concat_ws("/", F.col("document_id").cast("string"), key), 256), 1, 16)
    rows = requests.join(core, "template")
    return rows.select("document_id", new(F.col("id")).alias("id"), F.when(F.col("parent_id").isNotNull(), new(F.col("parent_id"))).alias("parent_id"), "title", "order_index", F.col("id").alias("source_id"))


def band_of_roots(roots: DataFrame, by: str, order: str, step: str = "step") -> DataFrame:
    """Adds band: front before the first step, step-n, back after the last; a root between steps goes with the step before."""
    w = Window.partitionBy(by).orderBy(order)
    before = F.last(step, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = F.max(F.when(F.col(step).isNotNull(), F.col(order))).over(Window.partitionBy(by))
    band = F.when(before.isNull(), "front").when(F.col(order) > last, "back").otherwise(F.concat(F.lit("step-"), before.cast("string")))
    return roots.withColumn("band", band)


def midpoint_order(inserts: DataFrame, siblings: DataFrame) -> DataFrame:
    """(id, order_index) for new rows: inserts (id, parent_id, after): below `after`'s order key, or first where it is null."""
    w = Window.partitionBy("parent_id").orderBy("order_index")
    s = siblings.select("parent_id", F.col("id").alias("after"), F.col("order_index").alias("lo"), F.lead("order_index").over(w).alias("hi"))
    first = siblings.groupBy("parent_id").agg(F.min("order_index").alias("low"))
    got = inserts.join(s, ["parent_id", "after"], "left").join(first, "parent_id", "left")
    key = F.when(F.col("after").isNull(), F.coalesce(F.col("low") - 1, F.lit(0.0))).when(F.col("hi").isNull(), F.col("lo") + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
    return got.select("id", "parent_id", key.alias("order_index"))


def unique_addresses(df: DataFrame, taken: DataFrame, by: str, base: str, order: str) -> DataFrame:
    """Adds address: the base, or base-2, base-3 ... past those in `taken` (by, address) and earlier rows."""
    suffix = F.regexp_extract("address", r"-([0-9]+)$", 1)
    stem = F.when(suffix != "", F.regexp_replace("address", r"-[0-9]+$", "")).otherwise(F.col("address"))
    spent = taken.select(by, F.explode(F.array_distinct(F.array(F.struct(F.col("address").alias("b"), F.lit(1).alias("n")), F.struct(stem.alias("b"), F.coalesce(suffix.try_cast("int"), F.lit(1)).alias("n"))))).alias("x"))
    spent = spent.groupBy(by, F.col("x.b").alias(base)).agg(F.max("x.n").alias("spent"))
    n = F.row_number().over(Window.partitionBy(by, base).orderBy(order)) + F.coalesce("spent", F.lit(0))
    return df.join(spent, [by, base], "left").withColumn("address", F.when(n == 1, F.col(base)).otherwise(F.concat_ws("-", base, n.cast("string")))).drop("spent")


def add_nodes(outlined: DataFrame, requests: DataFrame, slug) -> tuple[DataFrame, DataFrame]:
    """(new rows, rejects) for requests (id, parent_id, after, title): order key, depth and address follow from the
    parent; blank and overlong titles are refused."""
    title = F.trim("title")
    reason = F.when(F.coalesce(title, F.lit("")) == "", "the title is blank").when(F.length(title) > 200, "the title is too long")
    asked = requests.withColumn("title", title)
    good = asked.filter(reason.isNull())
    up = outlined.select(F.col("id").alias("parent_id"), (F.col("depth") + 1).cast("long").alias("depth"))
    rows = good.join(midpoint_order(good, outlined), ["id", "parent_id"]).join(up, "parent_id").withColumn("base", slug("title"))
    taken = outlined.select("parent_id", slug("title").alias("address"))
    return unique_addresses(rows, taken, "parent_id", "base", "id").select("id", "parent_id", "title", "order_index", "depth", "address"), asked.filter(reason.isNotNull()).select(F.col("id").alias("key"), reason.alias("reason"))


def step_map(outlined: DataFrame, items: DataFrame) -> DataFrame:
    """Per part (the rows below a root): sections, items and the latest update over the subtree. items: (id, open, updated)."""
    part = root_of(outlined).select("id", "part")
    return part.join(items, "id", "left").groupBy("part").agg(F.count("*").alias("sections"), F.sum(F.coalesce("open", F.lit(0))).cast("long").alias("open_items"), F.max("updated").alias("updated"))


def parts_of(rows: DataFrame, by: str, order: str, step: str = "step") -> DataFrame:
    """Adds part: the step that a row stands in, front before the first and back for rows after that have no step."""
    w = Window.partitionBy(by)
    first = F.min(F.when(F.col(step).isNotNull(), F.col(order))).over(w)
    part = F.when(F.col(step).isNotNull(), F.concat(F.lit("step-"), F.col(step).cast("string"))).when(first.isNull() | (F.col(order) < first), "front").otherwise("back")
    return rows.withColumn("part", part)


def instructions_outline(outlined: DataFrame, requests: DataFrame, marked: str = "apparatus", deals: int = 64) -> DataFrame:
    """(document_id, id, level): for each document the rows of its template that are author instructions, or below such
    a row, with their depth below the first of them. requests: (document_id, template), template being a root.

    A row for each document and row of its template is asked for. Rows of a template are dealt into `deals` parts, each of
    which meets a copy of the requests, so a common template is no single task's work."""
    tops = outlined.filter(marked).select(F.col("id").alias("top"), F.col("depth").alias("_d"))
    below = outlined.select("id", F.col("root").alias("template"), "depth", F.explode("ancestors").alias("top")).join(tops, "top")
    rows = below.groupBy("template", "id").agg(F.max(F.col("depth") - F.col("_d")).cast("long").alias("level"))
    asked = requests.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))))
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64("id"), F.lit(deals)))
    return dealt.join(asked.hint("shuffle_hash"), ["template", "_deal"]).select("document_id", "id", "level")
