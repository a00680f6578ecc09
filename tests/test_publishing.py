"""Bodies as published and as Markdown, against a plain walk of each body, on hand-made and on random trees."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from quire.operators import lifecycle, nodes, render


def text(t, *marks):
    return {"type": "text", "text": t, **({"marks": [m if isinstance(m, dict) else {"type": m} for m in marks]} if marks else {})}


def node(kind, /, *content, **attrs):
    return {"type": kind, **({"attrs": attrs} if attrs else {}), **({"content": list(content)} if content else {})}


def subject_stop(t):
    t = t.strip(" ")
    stop = t[-1] if t[-1:] in tuple(".,;:") else ""
    held = t[: len(t) - len(stop)]
    name = held[1:-1].strip(" ").lower()
    name = name[7:].lstrip(" ") if name.startswith("insert ") else name
    return stop if held[:1] in ("[", "<") and held[-1:] in ("]", ">") and name in render.SUBJECTS else None


def kinds(n):
    return [m["type"] for m in n.get("marks", [])]


def plain_publish(body, subject):
    """The published body, by walking it."""

    def walk(n):
        if n["type"] == "guidance":
            return None
        if n["type"] == "text":
            if "placeholder" in kinds(n):
                mark = n["marks"][kinds(n).index("placeholder")]
                label, own = mark.get("attrs", {}).get("label", n["text"]), subject_stop(n["text"])
                if own is not None or subject_stop(label) is not None:
                    t = n["text"]
                    new = subject if own is None else t[: len(t) - len(t.lstrip())] + subject + own + t[len(t.rstrip()) :]
                    rest = [m for m in n["marks"] if m["type"] != "placeholder"]
                    return {"type": "text", "text": new} | ({"marks": rest} if rest else {})
            return n
        if "content" not in n:
            return n
        kids = n["content"]
        ins = [k["type"] == "text" and "instruction" in kinds(k) for k in kids]
        left = []
        for i, k in enumerate(kids):
            if ins[i]:
                continue
            if k["type"] == "text" and i + 1 < len(kids) and ins[i + 1]:
                after = next((x for x, y in zip(kids[i + 1 :], ins[i + 1 :]) if not y), None)
                if after is None or after["type"] == "text" and re.match(r"[\s.,;:)]", after["text"]):
                    k = k | {"text": re.sub(r"\s+$", "", k["text"])}
                    if not k["text"]:
                        continue
            left.append(k)
        made = [x for k in left if (x := walk(k)) is not None]
        lost = len(made) < len(kids)
        if n["type"] in render.HOLDERS and lost and all(x["type"] == "banner" for x in made):
            return None
        return n | {"content": made}

    return walk(body)


def plain_markdown(body, numbers):
    esc = lambda t: re.sub(r"([\\`*_\[\]<>])", r"\\\1", t)
    signs = {"bold": "**", "italic": "*", "strike": "~~", "superscript": "^", "subscript": "~"}
    at = lambda n, a, otherwise="": n.get("attrs", {}).get(a, otherwise)

    def inline(n):
        kind = n["type"]
        if kind == "text":
            out = esc(n["text"])
            for m in reversed(n.get("marks", [])) if out.strip() else []:
                if m["type"] in signs:
                    out = signs[m["type"]] + out + signs[m["type"]]
                elif m["type"] == "link":
                    out = f"[{out}]({m['attrs']['href']})"
            return out
        if kind == "citation":
            return f"[^{numbers[at(n, 'referenceId')]}]" if at(n, "referenceId") in numbers else ""
        if kind == "hardBreak":
            return "  \n"
        if kind == "footnote":
            return f" ({at(n, 'text')})"
        return "".join(map(inline, n.get("content", [])))

    indent = lambda t, by: "\n".join(by + x if x else x for x in t.split("\n"))
    flat = lambda t: re.sub(r"\n+", " ", t).strip(" ")

    def blocks(ns):
        return "\n\n".join(b for b in map(block, ns) if b.strip())

    def block(n):
        kind, kids = n["type"], n.get("content", [])
        line = "".join(map(inline, kids))
        if kind in ("paragraph", "carePoint"):
            return line
        if kind == "heading":
            return "#" * min(6, max(1, at(n, "level", 1))) + " " + line
        if kind == "banner":
            return f"**{line}**"
        if kind in ("box", "blockquote", "timeframe"):
            return indent(blocks(kids), "> ")
        if kind == "horizontalRule":
            return "---"
        if kind == "guidance":
            return ""
        if kind == "variants":
            return "\n\n".join(("*Or*\n\n" if i else "") + blocks(v.get("content", [])) for i, v in enumerate(kids))
        if kind == "list":
            mark = {"ordered": f"{at(n, 'order', 1)}.", "check": "- ✗" if at(n, "negated", False) else "- ✓"}.get(at(n, "kind"), "-")
            tail = "\n".join(indent(block(k), "  ") for k in kids[1:])
            return f"{mark} {block(kids[0]) if kids else ''}" + (f"\n{tail}" if tail else "")
        if kind == "table":
            rows = [[flat(blocks(c.get("content", []))).replace("|", "\\|") for c in r.get("content", [])] for r in kids]
            width = max(map(len, rows), default=0)
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) if width else ""
        return blocks(kids)

    return re.sub(r"^\s+|\s+$", "", blocks(body.get("content", [])))


def random_body(rng):
    words = lambda: rng.choice(["a*b", "two words ", " | pipe", "[x]", "\\", "line\nbreak", " ", "é_ü", "end.", "(so", ", and"])

    def line():
        out = []
        for _ in range(rng.randint(0, 4)):
            r = rng.random()
            if r < 0.15:
                out.append({"type": "citation", "attrs": {"referenceId": rng.choice("rst")}})
            elif r < 0.25:
                out.append(node("hardBreak"))
            elif r < 0.4:
                out.append(text(words(), "instruction"))
            elif r < 0.5:
                out.append(text(rng.choice(["[Cancer type].", " <insert population group> ", "[dose]"]), "italic", {"type": "placeholder"} | ({"attrs": {"label": "[cancer type]"}} if rng.random() < 0.3 else {})))
            else:
                out.append(text(words(), *rng.sample(["bold", "italic", "strike", {"type": "link", "attrs": {"href": "/h"}}], rng.randint(0, 2))))
        # Blank texts before instructions would be read one after the other by the plain walk.
        return [x for x in out if not (x["type"] == "text" and not x["text"].strip() and "instruction" not in kinds(x))]

    def block(depth):
        kind = rng.choice(["paragraph", "paragraph", "heading", "list", "box", "variants", "table", "guidance", "blockquote", "horizontalRule", "section"] if depth else ["paragraph", "banner"])
        some = lambda least: [block(depth - 1) for _ in range(rng.randint(least, 3))]
        if kind in ("paragraph", "heading", "banner"):
            return node(kind, *line(), level=rng.randint(0, 8))
        if kind == "list":
            return node("list", node("paragraph", *line()), *some(0), kind=rng.choice(["bullet", "check", "ordered"]), order=rng.randint(1, 20), negated=rng.random() < 0.5)
        if kind == "variants":
            return node("variants", *(node("variant", *some(1)) for _ in range(2)))
        if kind == "table":
            return node("table", *(node("tableRow", *(node("tableCell", *some(0)) for _ in range(rng.randint(1, 3)))) for _ in range(2)))
        if kind == "horizontalRule":
            return node(kind)
        if kind == "box":
            return node("box", node("banner", text("Band")), *some(0))
        return node(kind, *some(1))

    return node("doc", *(block(3) for _ in range(rng.randint(0, 4))))


@pytest.fixture(scope="module")
def bodies():
    rng = random.Random(5)
    deep = node("doc", node("list", node("paragraph", text("one")), node("list", node("paragraph", text("two")), node("list", node("paragraph", text("three")), kind="check", negated=True), kind="ordered", order=7)))
    only = node("doc", node("box", node("banner", text("gone")), node("blockquote", node("guidance", node("paragraph", text("x"))))), node("box", node("banner", text("stays"))))
    return dict(enumerate([node("doc"), deep, only, *(random_body(rng) for _ in range(60))]))


NUMBERS = {"r": 1, "s": 12}


def exploded(spark, bodies):
    return nodes.explode_body(spark.createDataFrame([(i, json.dumps(b)) for i, b in bodies.items()] + [(-1, None), (-2, "{")], "document_id long, body_json string"))


def markdown(spark, n):
    numbers = n.select("document_id").distinct().crossJoin(spark.createDataFrame(list(NUMBERS.items()), "reference_id string, number long"))
    return {r.document_id: r.markdown for r in render.render_markdown(n, numbers).collect()}


def test_markdown_of_every_body(spark, bodies):
    assert markdown(spark, exploded(spark, bodies)) == {i: plain_markdown(b, NUMBERS) for i, b in bodies.items()}


def test_published_bodies(spark, bodies):
    known = spark.createDataFrame([(i, "lungs", i % 5 == 4) for i in bodies if i % 7 != 6], "document_id long, subject string, template boolean")
    want = {i: plain_markdown(b if i % 5 == 4 or i % 7 == 6 else plain_publish(b, "lungs"), NUMBERS) for i, b in bodies.items()}
    assert markdown(spark, render.publish_body(exploded(spark, bodies), known)) == want


def test_a_body_of_many_nodes(spark):
    body = node("doc", *(node("paragraph", text(f"t{i} "), text("note", "instruction"), text("."), {"type": "citation", "attrs": {"referenceId": "r"}}) for i in range(5000)))
    n = exploded(spark, {1: body})
    known = spark.createDataFrame([(1, "x", False)], "document_id long, subject string, template boolean")
    assert markdown(spark, render.publish_body(n, known)) == {1: "\n\n".join(f"t{i}.[^1]" for i in range(5000))}


def test_snapshots_and_empty_tables(spark):
    n = exploded(spark, {1: node("doc", node("timeframeSnapshot"), node("paragraph", text("x")))})
    numbers = spark.createDataFrame([], "document_id long, reference_id string, number long")
    shown = spark.createDataFrame([(1, "| a |")], "document_id long, snapshot string")
    assert render.render_markdown(n, numbers, shown).first().markdown == "| a |\n\nx"
    assert render.render_markdown(n.limit(0), numbers).count() == 0
    assert render.publish_body(n.limit(0), spark.createDataFrame([], "document_id long, subject string, template boolean")).count() == 0


def test_freezing_numbers_hashes_and_keeps_versions(spark):
    cite = lambda r: {"type": "citation", "attrs": {"referenceId": r}}
    page = lambda *inline: json.dumps(node("doc", node("paragraph", *inline)))
    sec = [(1, 10, 1, True, page(cite("x"))), (1, 11, 2, False, page(text("a "), text("b", "instruction"), cite("y"))), (1, 12, 3, False, page(cite("y"), cite("z"))), (1, 13, 4, False, None), (2, 14, 1, False, page(cite("z")))]
    sections = spark.createDataFrame(sec, "document_id long, section_id long, order_index long, hidden boolean, body_json string")
    documents = spark.createDataFrame([(1, "s", False, 1), (2, "s", False, 1)], "document_id long, subject string, template boolean, version_no long")
    none = spark.createDataFrame([], "document_id long, section_id long, body_hash string, hidden boolean, last_changed_version_no long")
    first = lifecycle.freeze_bodies(sections, documents, none)
    got = {r.section_id: (r.markdown, r.last_changed_version_no) for r in first.collect()}
    assert got == {10: ("", 1), 11: ("a [^1]", 1), 12: ("[^1][^2]", 1), 13: ("", 1), 14: ("[^1]", 1)}
    again = sections.withColumn("body_json", F.when(F.col("section_id") == 12, page(text("new"))).otherwise(F.col("body_json"))).withColumn("hidden", F.col("hidden") | (F.col("section_id") == 14))
    then = lifecycle.freeze_bodies(again, documents.withColumn("version_no", F.lit(2).cast("long")), first)
    assert {r.section_id: r.last_changed_version_no for r in then.collect()} == {10: 1, 11: 1, 12: 2, 13: 1, 14: 2}
