"""Bodies as they are published, and as Markdown: both from the node table, without walking a body in one place.

What is published is told from each node's own row (its type, its marks, the types above it) and its neighbours. Markdown
is folded upwards: the nodes of the deepest level are written first, then each level from the texts of its children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.settled import parts_for, settle

#: Subjects that stand in brackets until the publisher fills them in.
SUBJECTS = ("cancer type", "population group")
#: Containers that go when nothing but their band is left of them.
HOLDERS = ("box", "variants", "variant", "columns", "column", "figureRow", "resourceList", "resource", "list", "blockquote")
#: What Markdown reads as markup.
ESCAPED = r"([\\`*_\[\]<>])"

_MARKS = "array<struct<type:string,attrs:struct<label:string,href:string,address:string>>>"


def marks_of(marks="marks") -> Column:
    return F.from_json(marks, _MARKS)


def has_mark(kind: str) -> Column:
    return F.coalesce(F.exists(marks_of(), lambda m: m["type"] == kind), F.lit(False))


def _attribute(name: str) -> Column:
    return F.get_json_object("attrs", f"$.{name}")


def subject_form(text: Column, subjects: tuple[str, ...] = SUBJECTS) -> Column:
    """The stop after a bracketed subject ("[Cancer type]." or "<insert cancer type>"), "" without one; null for any other text."""
    t = F.trim(text)
    stop = F.when(F.right(t, F.lit(1)).isin(".", ",", ";", ":"), F.right(t, F.lit(1))).otherwise("")
    held = F.substring(t, F.lit(1), F.length(t) - F.length(stop))
    name = F.lower(F.trim(F.substring(held, F.lit(2), F.length(held) - 2)))
    name = F.when(name.startswith("insert "), F.ltrim(F.substring(name, F.lit(8), F.length(name)))).otherwise(name)
    bracketed = F.left(held, F.lit(1)).isin("[", "<") & F.right(held, F.lit(1)).isin("]", ">")
    return F.when(bracketed & name.isin(*subjects), stop)


def placeholder_label() -> Column:
    """The label of a text's placeholder mark, its text where the mark has none, null without a mark."""
    mark = F.get(F.filter(marks_of(), lambda m: m["type"] == "placeholder"), 0)
    return F.when(mark.isNotNull(), F.coalesce(mark["attrs"]["label"], F.coalesce("text", F.lit(""))))


def _prefixes(least: Column) -> Column:
    """The paths of the nodes above a node, from its parent up to those of at least `least` places."""
    return F.transform(F.sequence(F.size("path") - 1, least, F.lit(-1)), lambda n: F.slice("path", 1, n))


def publish_body(nodes: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """The nodes of bodies as they are published, for documents (key, subject, template); the body of a template stays as
    it is, as does one that `documents` does not name.

    Guidance goes with all that is below it. Texts marked as instructions go; the blanks before them go too where the
    sentence ends there or goes on with a blank or punctuation. A bracketed subject gives way to the document's, the stop
    after it stays. A holder that lost something and has only its band left goes too.

    Nodes are dealt by bodies once, into as many parts as their number asks for; all else is told by sorts within the parts: among siblings, among the nodes that tell of
    a holder, and in document order."""
    known = nodes.repartition(parts_for(nodes), key).join(documents.select(key, "subject", (~F.coalesce("template", F.lit(False))).alias("_open")), key, "left")
    known = known.withColumn("_open", F.coalesce("_open", F.lit(False)))
    kind = lambda *names: F.coalesce(F.col("type").isin(*names), F.lit(False))
    known = known.filter(~(F.col("_open") & F.array_contains("above", "guidance")))
    known = known.withColumn("_ins", F.col("_open") & kind("text") & has_mark("instruction")).withColumn("_goes", F.col("_ins") | F.col("_open") & kind("guidance"))
    above = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    known = known.withColumn("_up", F.when(F.size("path") > 0, above)).withColumn("_at", F.get("path", F.size("path") - 1))

    # The sentence around an instruction: the next sibling, and whether the next that stays closes it.
    later = Window.partitionBy(key, "_up").orderBy(F.desc("_at"))
    close = kind("text") & F.coalesce("text", F.lit("")).rlike(r"^[\s.,;:)]")
    then = F.last(F.when(~F.col("_ins"), close), ignorenulls=True).over(later.rowsBetween(Window.unboundedPreceding, -1))
    near = known.withColumns({"_next": F.lag("_ins", 1, False).over(later), "_then": F.coalesce(then, F.lit(True)), "_last": F.row_number().over(later) == 1})
    shut = F.col("_next") & ~F.col("_ins") & kind("text") & F.col("_then")
    near = near.withColumn("_shut", shut).withColumn("text", F.when(F.col("_shut"), F.regexp_replace("text", r"\s+$", "")).otherwise(F.col("text")))
    near = near.withColumn("_cut", F.col("_goes") | F.col("_shut") & (F.coalesce("text", F.lit("")) == ""))

    label, text = placeholder_label(), F.coalesce("text", F.lit(""))
    stop, named = subject_form(text), subject_form(label)
    subject = F.col("_open") & kind("text") & label.isNotNull() & (named.isNotNull() | stop.isNotNull())
    blank = lambda pattern: F.regexp_extract(text, pattern, 0)
    filled = F.when(stop.isNotNull(), F.concat(blank(r"^\s*"), "subject", stop, blank(r"\s*$"))).otherwise(F.col("subject"))
    # As a variant, marks keep whatever attributes they have.
    loose = F.filter(F.from_json("marks", "array<variant>"), lambda m: F.coalesce(F.try_variant_get(m, "$.type", "string") != "placeholder", F.lit(True)))
    left = F.when(subject, F.when(F.size(loose) > 0, F.to_json(loose))).otherwise(F.col("marks"))
    written = F.when(subject, filled).otherwise(F.col("text"))

    # A holder's chain: the holders above a node, up to the first that is none. A holder at the lower end of its chains is
    # whole where nothing was cut from it; one further up has a whole one below it where there are more holders in it than
    # groups of siblings that hold a holder or lost a node.
    holder = kind(*HOLDERS)
    siblings = Window.partitionBy(key, "_up")
    shown = near.withColumns({"text": written, "marks": left, "_holder": holder})
    shown = shown.withColumn("_poor", F.col("_last") & F.max(F.col("_holder") | F.col("_cut")).over(siblings))
    run = F.aggregate(F.reverse("above"), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, t: F.struct(F.when(a["go"] & t.isin(*HOLDERS), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["go"] & t.isin(*HOLDERS)).alias("go")))["n"]
    in_holder = F.col("_open") & F.coalesce(F.get("above", F.size("above") - 1).isin(*HOLDERS), F.lit(False))
    chain = F.when(in_holder, _prefixes(F.size("path") - run)).otherwise(F.array().cast("array<array<int>>"))
    told = shown.select("*", F.posexplode(F.concat(F.array("path"), chain)).alias("_n", "_of"))
    itself = F.col("_n") == 0
    told = told.withColumns({c: F.when(itself, F.col(c)) for c in ("text", "attrs", "marks", "parent_type", "above", "path")})

    of = Window.partitionBy(key, "_of")
    lost = F.max(~itself & F.col("_cut")).over(of)
    full = F.max(~itself & ~F.col("_cut") & ~F.col("_holder") & ~kind("banner")).over(of)
    whole = F.sum(F.col("_holder").cast("int") - (~itself & F.col("_poor")).cast("int")).over(of)
    told = told.withColumn("_gone", F.col("_open") & F.col("_holder") & lost & ~full & (whole <= 0)).filter(itself)
    # What stands before the end of a holder that went, in document order, goes with it.
    end = F.max(F.when(F.col("_gone"), F.concat("path", F.array(F.lit(2**31 - 1))))).over(Window.partitionBy(key).orderBy("_of").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return told.withColumn("_end", end).filter(~F.col("_cut") & ~F.coalesce(F.col("_end") >= F.col("path"), F.lit(False))).select(*nodes.columns)


def publishable_text(nodes: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, path, text): the texts of publish_body()."""
    return publish_body(nodes, documents, key).filter("type = 'text'").select(key, "path", "text")


def _text(name: str) -> Column:
    return F.coalesce(_attribute(name), F.lit(""))


def _marked() -> Column:
    """A text with its marks as Markdown, the first mark outermost; a blank text carries none."""
    escaped = F.regexp_replace(F.coalesce("text", F.lit("")), ESCAPED, r"\\$1")

    def wrap(out, m):
        both = lambda sign: F.concat(F.lit(sign), out, F.lit(sign))
        to = lambda url: F.concat(F.lit("["), out, F.lit("]("), url, F.lit(")"))
        shown = F.when(m["type"] == "bold", both("**"))
        for kind, sign in (("italic", "*"), ("strike", "~~"), ("superscript", "^"), ("subscript", "~")):
            shown = shown.when(m["type"] == kind, both(sign))
        shown = shown.when(m["type"] == "link", to(F.coalesce(m["attrs"]["href"], F.lit(""))))
        shown = shown.when(m["type"] == "sectionLink", to(F.concat(F.lit("#"), F.coalesce(m["attrs"]["address"], F.lit("")))))
        return shown.otherwise(out)

    marks = F.reverse(F.coalesce(marks_of(), F.array().cast(_MARKS)))
    return F.when(F.regexp_replace(escaped, r"\s+", "") == "", escaped).otherwise(F.aggregate(marks, escaped, wrap))


def _quoted(text: Column, by: str) -> Column:
    """Every line that is not empty behind a prefix."""
    return F.regexp_replace(text, "(?md)^(?=.)", by)


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\n+", " "))


def _texts() -> tuple[dict[str, Column], dict[str, Column]]:
    """The texts of a node from kids, those of its children: inline (in a line of text), block (as a block of its own), body
    (its children as blocks) and cells (its children as cells of a table's row); the second from the first."""
    inline = F.array_join(F.transform("kids", lambda k: k["inline"]), "")
    body = F.array_join(F.filter(F.transform("kids", lambda k: k["block"]), lambda b: F.length(F.regexp_replace(b, r"\s+", "")) > 0), "\n\n")
    first = {"_inline": inline, "body": body}
    image = F.concat(F.lit("!["), _text("alt"), F.lit("]("), _text("src"), F.lit(")"))

    kind = lambda *names: F.col("type").isin(*names)
    in_line = F.when(kind("text"), _marked()).when(kind("hardBreak"), F.lit("  \n"))
    in_line = in_line.when(kind("citation"), F.coalesce(F.concat(F.lit("[^"), F.col("number").cast("string"), F.lit("]")), F.lit("")))
    in_line = in_line.when(kind("footnote"), F.concat(F.lit(" ("), _text("text"), F.lit(")"))).when(kind("mention"), _text("value"))
    in_line = in_line.when(kind("image"), image).otherwise(F.col("_inline"))

    depth = F.least(F.lit(6), F.greatest(F.lit(1), F.coalesce(_attribute("level").try_cast("int"), F.lit(1))))
    tick = F.when(_attribute("negated") == "true", "- ✗").otherwise("- ✓")
    order = F.concat(F.coalesce(_attribute("order").try_cast("bigint"), F.lit(1)).cast("string"), F.lit("."))
    mark = F.when(_attribute("kind") == "ordered", order).when(_attribute("kind") == "check", tick).otherwise("-")
    tail = F.array_join(F.transform(F.slice("kids", F.lit(2), F.size("kids")), lambda k: _quoted(k["block"], "  ")), "\n")
    item = F.concat(mark, F.lit(" "), F.coalesce(F.get("kids", 0)["block"], F.lit("")), F.when(tail != "", F.concat(F.lit("\n"), tail)).otherwise(""))
    variants = F.transform("kids", lambda k, i: F.concat(F.when(i == 0, "").otherwise("*Or*\n\n"), k["body"]))
    title = F.regexp_replace(_text("title"), ESCAPED, r"\\$1")
    head = F.when(_text("url") != "", F.concat(F.lit("["), title, F.lit("]("), _text("url"), F.lit(")"))).otherwise(F.concat(F.lit("**"), title, F.lit("**")))
    about = _one_line(F.col("body"))
    resource = F.concat(F.lit("- "), head, F.when(about != "", F.concat(F.lit(" — "), about)).otherwise(""))

    rows = F.transform("kids", lambda k: k["cells"])
    width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    padded = lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    lines = F.transform(rows, lambda r: line(padded(r)))
    table = F.when(width == 0, "").otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(line(F.array_repeat(F.lit("---"), width))), F.slice(lines, F.lit(2), F.size(lines))), "\n"))

    block = F.when(kind("paragraph", "carePoint"), F.col("_inline")).when(kind("heading"), F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), F.col("_inline")))
    block = block.when(kind("banner"), F.concat(F.lit("**"), F.col("_inline"), F.lit("**"))).when(kind("blockquote", "box", "timeframe"), _quoted(F.col("body"), "> "))
    block = block.when(kind("horizontalRule", "pageBreak"), "---").when(kind("image"), image).when(kind("list"), item).when(kind("table"), table)
    block = block.when(kind("guidance", "pathwayMap"), "").when(kind("variants"), F.array_join(variants, "\n\n"))
    block = block.when(kind("resourceList"), F.array_join(F.transform("kids", lambda k: k["block"]), "\n")).when(kind("resource"), resource)
    block = block.when(kind("timeframeSnapshot"), F.coalesce("snapshot", F.lit(""))).otherwise(F.col("body"))
    cells = F.transform("kids", lambda k: F.trim(F.replace(_one_line(k["body"]), F.lit("|"), F.lit("\\|"))))
    return first, {"inline": in_line, "block": block, "cells": cells}


def render_markdown(nodes: DataFrame, numbers: DataFrame, snapshots: DataFrame | None = None, key: str = "document_id") -> DataFrame:
    """(key, markdown) of every body: headings, nested lists, ticks, tables, boxes, alternatives, resources, marks and
    escapes; citations as footnote marks by numbers (key, reference_id, number), those without a number left out. A
    timeframeSnapshot node shows snapshots (key, snapshot). Guidance is not shown.

    Folded from the deepest level upwards: in each step the texts of a level are collected by their parents. Nodes are dealt
    by bodies once, so that the steps that follow move and write nothing."""
    nodes = settle(nodes)
    number = numbers.select(key, "reference_id", "number")
    cited = nodes.filter("type = 'citation'").withColumn("reference_id", _attribute("referenceId")).join(number, [key, "reference_id"], "left").drop("reference_id")
    have = nodes.filter("type is null or type <> 'citation'").withColumn("number", F.lit(None).cast(numbers.schema["number"].dataType)).unionByName(cited)
    have = have.join(snapshots.select(key, "snapshot"), key, "left") if snapshots is not None else have.withColumn("snapshot", F.lit(None).cast("string"))
    told = ["type", "text", "attrs", "marks", "number", "snapshot"]
    have = have.select(key, "path", F.struct(*told).alias("own"), F.size("path").alias("depth"))
    first, second = _texts()
    kid = F.struct(F.element_at("path", -1).alias("at"), "type", "inline", "block", "body", "cells")
    kind = "struct<at:int,type:string,inline:string,block:string,body:string,cells:array<string>>"
    parts = parts_for(nodes)
    done = None
    for depth in range(nodes.agg(F.max(F.size("path"))).first()[0] or 0, -1, -1):
        level = have.filter(F.col("depth") == depth).select(key, "path", "own").repartition(parts, key)
        if done is None:
            level = level.withColumn("kids", F.array().cast(f"array<{kind}>"))
        else:
            up = done.select(key, F.slice("path", 1, F.size("path") - 1).alias("path"), F.lit(None).cast(level.schema["own"].dataType).alias("own"), kid.alias("kid"))
            level = level.withColumn("kid", F.lit(None).cast(kind)).unionByName(up)
            level = level.groupBy(key, "path").agg(F.first("own", ignorenulls=True).alias("own"), F.array_sort(F.collect_list("kid")).alias("kids")).filter("own is not null")
        level = level.select(key, "path", "kids", *(F.col(f"own.{c}").alias(c) for c in told))
        done = level.withColumns(first).withColumns(second).select(key, "path", "type", "inline", "block", "body", "cells")
    return done.select(key, F.regexp_replace("body", r"^\s+|\s+$", "").alias("markdown"))


def timeframe_rows(nodes: DataFrame, sections: DataFrame, key: str = "section_id") -> DataFrame:
    """(document_id, position, place, step, section, care_point, statements) of the timeframe boxes of bodies, in reading order:
    the care point is the box's own heading; each other block of the box is a statement, and where it offers variants, its
    alternatives. statements holds an array of alternatives for each.

    nodes: of explode_body(), by `key`; sections: (key, document_id, position, step, title). A text is told where it belongs
    by its own path and the types above it, so boxes are grouped and never walked. Texts and sections are dealt once: by
    documents where the key is a struct that holds document_id, else by the key; sections meet their boxes within the parts."""
    kind, parts = nodes.schema[key].dataType, parts_for(nodes)
    by_document = isinstance(kind, T.StructType) and "document_id" in kind.names
    deal = lambda df: df.withColumn("_deal", F.col(key)["document_id"] if by_document else F.col(key)).repartition(parts, "_deal")
    box = F.array_position("above", "timeframe") - 1
    said = nodes.filter((F.col("type") == "text") & F.array_contains("above", "timeframe") & ~F.array_contains("above", "guidance"))
    said = deal(said.select(key, "path", "text", box.cast("int").alias("_d"), F.slice("above", box.cast("int") + 2, 1).alias("above")))
    child = F.get("above", 0)
    x = said.select(
        "_deal", key, "path", F.coalesce("text", F.lit("")).alias("text"), F.slice("path", F.lit(1), F.col("_d")).alias("_box"), F.get("path", F.col("_d")).alias("_child"), child.alias("_kind"),
        F.when(child == "variants", F.get("path", F.col("_d") + 1)).otherwise(-1).alias("_way"), F.slice("path", 1, F.size("path") - 1).alias("_block"),
    )
    joined = lambda at, piece, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, piece))), lambda v: v[piece]), by)
    at = ["_deal", key, "_box"]
    lines = x.groupBy(*at, "_child", "_kind", "_way", "_block").agg(F.trim(F.regexp_replace(joined("path", "text", ""), r"\s+", " ")).alias("line"))
    ways = lines.filter("line <> ''").groupBy(*at, "_child", "_kind", "_way").agg(joined("_block", "line", " ").alias("way"))
    blocks = ways.groupBy(*at, "_child", "_kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("_way", "way"))), lambda v: v["way"]).alias("ways"))
    care = F.max(F.when(F.col("_kind") == "carePoint", F.col("ways")[0]))
    told = F.array_sort(F.collect_list(F.when(F.coalesce(F.col("_kind") != "carePoint", F.lit(True)), F.struct("_child", "ways"))))
    boxes = blocks.groupBy(*at).agg(F.coalesce(care, F.lit("")).alias("care_point"), F.transform(told, lambda v: v["ways"]).alias("statements"))
    held = deal(sections.select(key, F.struct("document_id", "position", "step", F.col("title").alias("section")).alias("_section")))
    both = boxes.withColumn("_section", F.lit(None).cast(held.schema["_section"].dataType)).unionByName(held, allowMissingColumns=True)
    placed = both.withColumn("_section", F.max("_section").over(Window.partitionBy("_deal", key))).filter("_box is not null and _section is not null")
    document = F.col("_deal" if by_document else "_section.document_id").alias("document_id")
    placed = placed.select(key, "_box", document, "_section.position", "_section.step", "_section.section", "care_point", "statements")
    order = Window.partitionBy("document_id").orderBy("position", key, "_box")
    return placed.withColumn("place", F.row_number().over(order).cast("long")).select("document_id", "position", "place", "step", "section", "care_point", "statements")


def snapshot_tables(rows: DataFrame) -> DataFrame:
    """(document_id, snapshot): timeframe_rows() as a Markdown table for each document, as a timeframeSnapshot node shows it:
    alternatives apart by "or", statements by semicolons."""
    cell = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    step = F.when(F.col("step").isNull(), "").otherwise(F.concat(F.lit("Step "), F.col("step").cast("string")))
    told = F.array_join(F.transform("statements", lambda ways: F.array_join(ways, " or ")), "; ")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", step, cell(F.col("section")), cell(F.col("care_point")), cell(told)), F.lit(" |"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "_line"))), lambda v: v["_line"])
    head = F.array(F.lit("| Step | Section | Care point | Timeframe |"), F.lit("| --- | --- | --- | --- |"))
    return rows.withColumn("_line", line).groupBy("document_id").agg(F.array_join(F.concat(head, listed), "\n").alias("snapshot"))
