"""Operators on nested bodies: JSON trees of {type, attrs, content, text, marks}."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import step_of_address
from ..sources.settled import is_settled, release, settle
from .render import SUBJECTS, has_mark, placeholder_label, subject_form

#: Levels beyond which a body is taken to be broken.
DEEPEST = 64
#: What stands between words, as in the SQL of the queries.
_BLANKS = re.compile(r"[\t\n\f\r ]+")


def explode_body(df: DataFrame, body: str = "body_json", key: str = "document_id") -> DataFrame:
    """(key, path, type, text, attrs, parent_type, marks, above) for every node; path holds the places from the root, whose
    own is empty, so that it sorts in document order; above holds the types of a node's ancestors from the root. attrs and
    marks are JSON text. Bodies that are no JSON have no nodes.

    Every level is a generator over the children of the one before, in the same task, so nodes are not moved, and each is
    written once, without what is below it; brackets in the text bound the number of levels. Bodies are written once as
    they came, not at all where df is settled.
    """
    strings = F.regexp_replace(F.regexp_replace(body, r"\\.", ""), '"[^"]*"', "")
    step = lambda a, c: F.when(c == "[", a["n"] + 1).otherwise(a["n"] - 1)
    nest = F.aggregate(
        F.split(F.regexp_replace(strings, r"[^\[\]]+", ""), "(?<=.)(?=.)"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("most")),
        lambda a, c: F.struct(step(a, c).alias("n"), F.greatest(a["most"], step(a, c)).alias("most")),
    )["most"]
    held = df if is_settled(df) else settle(df.select(key, body))
    bound = held.agg(F.max(nest)).first()[0] or 0
    whole = held.select(key, F.explode(F.array_compact(F.array(F.try_parse_json(body)))).alias("node"))

    get = lambda node, p: F.try_variant_get(node, p, "string")
    json = lambda node, p: F.to_json(F.try_variant_get(node, p, "variant"))
    told = lambda n: {"type": get(n, "$.type"), "text": get(n, "$.text"), "attrs": json(n, "$.attrs"), "marks": json(n, "$.marks"), "kids": F.try_variant_get(n, "$.content", "array<variant>")}
    root = {"path": F.array().cast("array<int>"), "parent_type": F.lit(None).cast("string"), "above": F.array().cast("array<string>")}
    at = whole.select(key, *(c.alias(n) for n, c in (root | told("node")).items()))
    itself = F.array(F.lit(None).cast("variant"))  # stands before the children, for the node that has them
    for level in range(1, min(bound, DEEPEST) + 1):
        at = at.select(*at.columns, F.posexplode(F.concat(itself, F.coalesce("kids", F.array().cast("array<variant>")))).alias("_at", "_kid"))
        kind = F.coalesce("type", F.lit(""))
        new = {"path": F.concat("path", F.array(F.col("_at") - 1)), "parent_type": kind, "above": F.concat("above", F.array(kind))} | told("_kid")
        kept = {n: F.when(F.col("_at") == 0, F.col(n)) for n in new if n != "kids"}
        at = at.select(key, *(kept[n].otherwise(c).alias(n) if n in kept else F.when(F.col("_at") > 0, c).alias(n) for n, c in new.items()))
        if level % 16 == 0:
            at = settle(at)
    if bound >= DEEPEST and not at.filter(F.size("path") >= DEEPEST).isEmpty():
        raise ValueError(f"bodies nest deeper than {DEEPEST} levels")
    out = settle(at.select(key, "path", "type", "text", "attrs", "parent_type", "marks", "above"))
    if held is not df:
        release(held)
    return out


def _block(path="path"):
    """The path of the block that an inline node stands in."""
    return F.slice(path, 1, F.size(path) - 1)


def _joined(at: str, piece: str, by: str):
    """A group's pieces in the order of `at`."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, piece))), lambda x: x[piece]), by)


def plain_text(nodes: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, text): the text of blocks, one line each, in document order. Superscripts are left out, a hard break counts
    as a blank, and runs of white space as one."""
    shown = nodes.filter("type = 'hardBreak'").select(key, "path", F.lit(" ").alias("text"))
    t = shown.unionByName(nodes.filter((F.col("type") == "text") & ~has_mark("superscript")).select(key, "path", "text"))
    line = F.trim(F.regexp_replace(_joined("path", "text", ""), r"\s+", " "))
    return t.groupBy(key, _block().alias("block")).agg(line.alias("line")).groupBy(key).agg(_joined("block", "line", "\n").alias("text"))


def search_text(nodes: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, text): a body's words for the index: all text in order, a line break after every node that has children,
    blank lines and runs of blanks folded. Bodies without text have an empty one."""
    ends = nodes.filter(F.size("path") > 0).select(key, F.concat(_block(), F.array(F.lit(2**31 - 1))).alias("path"), F.lit("\n").alias("text")).distinct()
    pieces = ends.unionByName(nodes.filter("type = 'text'").select(key, "path", F.coalesce("text", F.lit("")).alias("text")))
    whole = F.regexp_replace(F.regexp_replace(_joined("path", "text", ""), r"[ \t]+", " "), r"\n\s*\n+", "\n")
    return pieces.groupBy(key).agg(F.regexp_replace(whole, r"^\s+|\s+$", "").alias("text"))


def citations_in(nodes: DataFrame, headings: DataFrame | None = None, key: str = "document_id") -> DataFrame:
    """(key, place, reference_id) in order, repeats kept; ids of the heading (key, place, reference_id) come first."""
    found = nodes.filter("type = 'citation'").select(key, F.lit(1).alias("_from"), "path", F.get_json_object("attrs", "$.referenceId").alias("reference_id"))
    if headings is not None:
        found = headings.select(key, F.lit(0).alias("_from"), F.array(F.col("place").cast("int")).alias("path"), "reference_id").unionByName(found)
    w = Window.partitionBy(key).orderBy("_from", "path")
    return found.withColumn("place", F.row_number().over(w).cast("long")).select(key, "place", "reference_id")


def construct_counts(nodes: DataFrame, types: list[str], key: str = "document_id") -> DataFrame:
    return nodes.groupBy(key).agg(*(F.count_if(F.col("type") == t).alias(f"n_{t}") for t in types))


def validate_nodes(nodes: DataFrame, rules: DataFrame, key: str = "document_id") -> DataFrame:
    """Nodes whose type may not stand under their parent's. rules: (parent_type, type); the root has a null parent."""
    allowed = rules.withColumn("parent_type", F.coalesce("parent_type", F.lit("")))
    return nodes.withColumn("parent_type", F.coalesce("parent_type", F.lit(""))).join(F.broadcast(allowed), ["parent_type", "type"], "left_anti").select(key, "path", "type", "parent_type")


def schema_problems(nodes: DataFrame, rules: DataFrame, required: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, path, type, problem) of what breaks the schema: "unknown type" where no rule has the type, "not under <parent>"
    where it may not stand there, and "lacks <attribute>" for each attribute that is absent or null.

    rules: (parent_type, type), a null parent for the root; required: (type, attribute). Both are tables of the schema,
    joined by type, so whatever their size they are not copied whole."""
    at = nodes.withColumn("_parent", F.coalesce("parent_type", F.lit(""))).withColumn("type", F.coalesce("type", F.lit("")))
    allowed = rules.select(F.coalesce("parent_type", F.lit("")).alias("_parent"), "type", F.lit(True).alias("_ok")).distinct()
    known = rules.select("type", F.lit(True).alias("_known")).distinct()
    asked = required.groupBy("type").agg(F.array_sort(F.collect_set("attribute")).alias("_asked"))
    x = at.join(known, "type", "left").join(allowed, ["_parent", "type"], "left").join(asked, "type", "left")
    place = F.when(F.col("_known").isNull(), "unknown type").when(F.col("_ok").isNull(), F.concat(F.lit("not under "), F.when(F.col("_parent") == "", "nothing").otherwise(F.col("_parent"))))
    held = F.coalesce(F.map_keys(F.map_filter(F.from_json("attrs", "map<string,string>"), lambda _, v: v.isNotNull())), F.array().cast("array<string>"))
    lacks = F.transform(F.array_except(F.coalesce("_asked", F.array().cast("array<string>")), held), lambda a: F.concat(F.lit("lacks "), a))
    return x.select(key, "path", "type", F.explode(F.concat(F.array_compact(F.array(place)), lacks)).alias("problem"))


def content_hash(nodes: DataFrame, key: str = "document_id") -> DataFrame:
    """A hash of the canonical list of nodes in document order: depth, type, text, attributes and marks, whatever order keys
    were written in. Nodes that were taken out before leave no gap."""
    blank = F.lit("")
    one = F.concat_ws("\x1f", F.size("path").cast("string"), F.coalesce("type", blank), F.coalesce("text", blank), F.coalesce("attrs", blank), F.coalesce("marks", blank))
    return nodes.withColumn("_one", one).groupBy(key).agg(F.sha2(_joined("path", "_one", "\x1e"), 256).alias("content_hash"))


def repoint_citations(nodes: DataFrame, moved: DataFrame, key: str = "document_id") -> DataFrame:
    """Citation nodes with their ids replaced by the map (old_id, new_id)."""
    c = nodes.filter("type = 'citation'").select(key, "path", F.get_json_object("attrs", "$.referenceId").alias("old_id"))
    return c.join(moved, "old_id", "left").select(key, "path", F.coalesce("new_id", "old_id").alias("reference_id"))


def open_items(nodes: DataFrame, types: list[str], key: str = "document_id") -> DataFrame:
    """Per document, its nodes of the given kinds; guidance that is ticked done is not open."""
    done = F.coalesce((F.col("type") == "guidance") & (F.get_json_object("attrs", "$.done") == "true"), F.lit(False))
    return nodes.filter(F.col("type").isin(types) & ~done).groupBy(key, "type").agg(F.count("*").alias("n"))


def open_choices(nodes: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, n): groups of alternatives that still stand, 0 where none does."""
    return nodes.groupBy(key).agg(F.count_if(F.col("type") == "variants").alias("n"))


def blocking_placeholders(nodes: DataFrame, subjects: tuple[str, ...] = SUBJECTS, key: str = "document_id") -> DataFrame:
    """(key, n): placeholders that a drafter must replace, 0 where there are none. One that stands for the document's subject,
    by its label or by its text, does not block; a placeholder without a label is labelled by its text."""
    label = placeholder_label()
    stands = subject_form(label, subjects).isNotNull() | subject_form(F.coalesce("text", F.lit("")), subjects).isNotNull()
    return nodes.groupBy(key).agg(F.count_if((F.col("type") == "text") & label.isNotNull() & ~stands).alias("n"))


def margin_notes(nodes: DataFrame, kinds: list[str], key: str = "document_id") -> DataFrame:
    """Guidance and instruction blocks with their text: (key, block, note, done); done where the block is ticked off."""
    done = F.coalesce(F.get_json_object("attrs", "$.done") == "true", F.lit(False)).alias("done")
    blocks = nodes.filter(F.col("type").isin(kinds)).select(key, F.col("path").alias("block"), done)
    t = nodes.filter("type = 'text'").select(key, _block().alias("block"), "path", "text")
    return blocks.join(t, [key, "block"]).groupBy(key, "block", "done").agg(_joined("path", "text", "").alias("note"))


def timeframe_snapshot(nodes: DataFrame, key: str = "document_id") -> DataFrame:
    """Per document and block: its statements (text nodes) in order, joined."""
    t = nodes.filter("type = 'text' and trim(text) <> ''").select(key, F.element_at(_block(), -1).cast("long").alias("box"), "path", "text")
    return t.groupBy(key, "box").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), " / ").alias("statements"))


@F.pandas_udf(T.StructType([T.StructField("inserted", T.LongType()), T.StructField("deleted", T.LongType())]))
def _word_diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    out = []
    for a, b in zip(old.fillna(""), new.fillna("")):
        x, y = (list(filter(None, _BLANKS.split(t))) for t in (a, b))
        # What stands in both at the beginning and at the end is equal, wherever a longer block would fit.
        least, head, tail = min(len(x), len(y)), 0, 0
        while head < least and x[head] == y[head]:
            head += 1
        while tail < least - head and x[-1 - tail] == y[-1 - tail]:
            tail += 1
        x, y = x[head : len(x) - tail], y[head : len(y) - tail]
        ins = dele = 0
        for tag, i, j, k, m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            if tag != "equal":
                dele += sum(map(len, x[i:j]))
                ins += sum(map(len, y[k:m]))
        out.append((ins, dele))
    return pd.DataFrame(out, columns=["inserted", "deleted"])


def diff_sizes(pairs: DataFrame) -> DataFrame:
    """Adds inserted and deleted characters of a word diff of old and new; equal texts never reach Python. Words are apart by
    ASCII blanks; the beginning and the end that both share are equal, what is between them is aligned."""
    same = F.col("old").eqNullSafe(F.col("new"))
    kept = pairs.filter(same).withColumns({"inserted": F.lit(0).cast("long"), "deleted": F.lit(0).cast("long"), "changed": F.lit(False)})
    moved = pairs.filter(~same).withColumn("_d", _word_diff("old", "new")).withColumns({"inserted": F.col("_d.inserted"), "deleted": F.col("_d.deleted"), "changed": F.lit(True)}).drop("_d")
    return kept.unionByName(moved)


def guide(sections: DataFrame, nodes: DataFrame, kinds: list[str], key: str = "document_id") -> DataFrame:
    """(key, kind, path): what a quick reference shows: whole sections marked point_of_care, and in the others the nodes of
    the given kinds. sections: (key, point_of_care)."""
    whole = sections.filter("point_of_care").select(key, F.lit("section").alias("kind"), F.array().cast("array<int>").alias("path"))
    inside = nodes.filter(F.col("type").isin(kinds)).join(sections.filter("not point_of_care").select(key), key)
    return whole.unionByName(inside.select(key, F.lit("item").alias("kind"), "path"))


def guide_page(sections: DataFrame, nodes: DataFrame, numbers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, references) of each document's quick reference: whole sections that are marked point_of_care, and in the
    others the check lists that are, each with its section and the step that it belongs to; and the references that these
    cite, numbered as the whole document numbers them.

    sections: (document_id, section_id, address, title, point_of_care, place) in reading order; nodes: exploded bodies by
    section_id; numbers: (document_id, reference_id, number). entries: (document_id, place, section_id, path, kind, address,
    title, step, step_title), sorted by place and path; step is null outside the steps, step_title where the step has no
    section of its own. A citation finds its list by the beginnings of its path, so no list meets every citation."""
    steps = sections.select("document_id", step_of_address("address").alias("step"), "address", "title").filter(F.col("address") == F.concat(F.lit("step-"), "step"))
    steps = steps.groupBy("document_id", "step").agg(F.min("title").alias("step_title"))
    at = sections.withColumn("step", step_of_address("address")).join(steps, ["document_id", "step"], "left")
    told = ["document_id", "place", "section_id", "path", "kind", "address", "title", "step", "step_title"]
    marked = F.coalesce("point_of_care", F.lit(False))
    whole = at.filter(marked).withColumns({"path": F.array().cast("array<int>"), "kind": F.lit("section")})
    flagged = (F.get_json_object("attrs", "$.kind") == "check") & (F.get_json_object("attrs", "$.pointOfCare") == "true")
    lists = nodes.filter((F.col("type") == "list") & flagged).select("section_id", "path")
    items = at.filter(~marked).join(lists, "section_id").withColumn("kind", F.lit("item"))
    entries = whole.select(told).unionByName(items.select(told))

    starts = F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))
    said = nodes.filter("type = 'citation'").select("section_id", F.get_json_object("attrs", "$.referenceId").alias("reference_id"), F.explode(starts).alias("path"))
    cited = said.join(entries.select("document_id", "section_id", "path"), ["section_id", "path"]).select("document_id", "reference_id").distinct()
    return entries, numbers.join(cited, ["document_id", "reference_id"], "left_semi")
