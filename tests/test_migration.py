"""Rules of the migration that the given tables do not show."""

import random

from quire.operators import matching, migration
from quire.operators.migration import LinkRule


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ties_between_levels_go_on_from_the_outline(spark):
    style = [(1, 1, 20.0), (1, 2, 14.0), (1, 3, 14.0), (1, 4, 10.0), (1, 2, 10.4)]
    styles = spark.createDataFrame([(d, v, s, "#000", True) for d, v, s in style], "document_id long, level int, size double, colour string, bold boolean")
    at = lambda n, size, tag=None, text="A heading", bold=True: (1, n, text, size, "#000", bold, tag)
    lines = [at(1, 14.0), at(2, 20.0), at(3, 14.0), at(4, 14.3), at(5, 14.0, 2), at(6, 14.0), at(7, 12.0), at(8, 10.2), at(9, 14.0, None, "x" * 161), at(10, 14.0, None, " "), at(11, 14.0, None, "plain", False), at(12, 14.0, 9)]
    df = spark.createDataFrame(lines, "document_id long, line_no long, text string, size double, colour string, bold boolean, tagged int")
    got = {r.line_no: r.level for r in migration.classify_lines(df, styles).collect()}
    assert got == {1: 2, 2: 1, 3: 2, 4: 3, 5: 2, 6: 3, 7: None, 8: 4, 9: None, 10: None, 11: None, 12: 2}
    assert migration.classify_lines(df.limit(0), styles).count() == 0


def test_levels_go_on_from_block_to_block(spark, monkeypatch):
    monkeypatch.setattr(migration, "BLOCK", 7)
    draw = random.Random(5)
    style = {s: sorted(draw.sample(range(1, 7), draw.choice((1, 2, 3)))) for s in (10, 12, 14, 16)}
    styles = spark.createDataFrame([(d, v, float(s), "#000", True) for d in (1, 2) for s, vs in style.items() for v in vs], "document_id long, level int, size double, colour string, bold boolean")
    # Document 1 has tags, document 2 has no line whose level is known.
    known = [(1, n, draw.choice(list(style)), draw.choice((None, None, None, 1, 4))) for n in range(100)]
    loose = [(2, n, draw.choice([s for s, v in style.items() if len(v) > 1]), None) for n in range(100)]
    want, now = {}, {1: 0, 2: 0}
    for d, n, s, tag in known + loose:
        levels = [tag] if tag in style[s] else style[s]
        want[d, n] = now[d] = next((v for v in levels if v > now[d]), levels[0])
    lines = spark.createDataFrame([(d, n, "A heading", float(s), "#000", True, tag) for d, n, s, tag in known + loose], "document_id long, line_no long, text string, size double, colour string, bold boolean, tagged int")
    assert {(r.document_id, r.line_no): r.level for r in migration.classify_lines(lines, styles).collect()} == want


def test_entries_without_an_honorific(spark):
    known = [("name", "Ann van Lee"), ("role", "Senior Physiotherapist"), ("role", "Medical Director"), ("entry", "Peter Mac Centre and The Royal Hospital, Sydney; Health Service of the North")]
    text = {
        1: "Dr Smith", 2: "dr. smith", 3: "Ann van Lee, anything", 4: "Bob Ray, Physiotherapist (retired), x", 5: "Bob Ray, Gardener", 6: "Medical Director, Medical Director", 7: "Peter Mac Centre and The Royal Hospital",
        8: "Health Service of", 9: "Sydney", 10: "Syd", 11: None, 12: "", 13: "Bob, Medical Director", 14: "Associate Professor Éva K", 15: "HEALTH service",
    }
    lines = spark.createDataFrame(list(text.items()), "line_id long, text string")
    got = {r.line_id: "".join(c for c, v in zip("pco", (r.person, r.complete, r.opens)) if v) for r in migration.entry_openings(lines, spark.createDataFrame(known, "kind string, text string")).collect()}
    assert got == {1: "p", 2: "", 3: "p", 4: "p", 5: "", 6: "", 7: "c", 8: "o", 9: "c", 10: "", 11: "", 12: "", 13: "", 14: "p", 15: "o"}


def test_two_notes_in_one_sentence_have_their_own_words(spark):
    said = [("text", "see Pain"), ("note", None), ("text", " and "), ("text", "section 3.2 Bone pain"), ("note", None), ("note", None), ("text", "see Pain")]
    nodes = [(1, [0, i], k, t) for i, (k, t) in enumerate(said)] + [(1, [1, 0], "text", "see Nothing"), (1, [1, 1], "note", None), (1, [2, 0], "note", None), (1, [3, 0], "text", "See section 3.2 of lungs"), (1, [3, 1], "note", None), (1, [4, 0], "text", "so what"), (1, [4, 1], "note", None)]
    w = migration.note_windows(spark.createDataFrame(nodes, "document_id long, path array<int>, type string, text string"))
    assert rows(w.select("path", "before")) == [([0, 1], "see Pain"), ([0, 4], " and section 3.2 Bone pain"), ([0, 5], ""), ([1, 1], "see Nothing"), ([2, 0], ""), ([3, 1], "See section 3.2 of lungs"), ([4, 1], "so what")]
    rules = [LinkRule("section", r"(?i)\b(section (\d+(?:\.\d+)*)\b ?(.*))$", "section", title=3), LinkRule("see", r"(?i)\bsee (\w+)$", "entry", find=1)]
    targets = spark.createDataFrame([(1, "section", "3.2", "/pain", "Managing bone pain"), (2, "section", "3.2", "/else", "lungs"), (None, "entry", "PAIN", "#pain", "Pain")], "document_id long, kind string, name string, address string, title string")
    got = {tuple(r.note_id): (r.outcome, r.rule, r.words, r.address, r.reason) for r in migration.resolve_notes(w.withColumnRenamed("path", "note_id"), targets, rules).collect()}
    none = (None, None, None)
    assert got == {
        (0, 1): ("resolved", "see", "Pain", "#pain", None), (0, 4): ("resolved", "section", "section 3.2 Bone pain", "/pain", None), (0, 5): ("left", *none, "nothing before the note"),
        (1, 1): ("left", *none, "no such target"), (2, 0): ("left", *none, "nothing before the note"), (3, 1): ("left", *none, "the title is another one"), (4, 1): ("left", *none, "no rule fits"),
    }


def test_rows_that_no_box_covers_open_one(spark):
    printed = [(1, 1, 2, "Referral", "patients should be seen within four weeks", 2), (1, 2, 2, "Surgery", None, None), (1, 3, 2, "Scan", None, None), (1, 4, 3, "Bone scan", "other words entirely here", 1), (1, 5, None, "Lost", "nowhere placed statement", 1), (1, 6, 3, "x", "seen patients should within four weeks", 1), (2, 1, 2, "Referral", "patients should be seen within four weeks", 1), (1, 7, 4, "y", "a b", 1)]
    rows_ = spark.createDataFrame(printed, "document_id long, row_no int, step int, care_point string, statement string, span int")
    boxes = spark.createDataFrame([(1, 1, 2, "Patients SHOULD be seen within four weeks, always")], "document_id long, box_id long, step int, text string")
    sections = spark.createDataFrame([(1, "3/scan", 3, "Scan"), (1, "2/scan", 2, "Bone scan")], "document_id long, address string, step int, title string")
    placed, made = migration.table_rows_to_boxes(rows_, boxes, sections)
    assert rows(placed.select("document_id", "row_no", "source", F_address())) == [(1, 1, "body", ""), (1, 2, "body", ""), (1, 4, "row", "3/scan"), (1, 5, "row", ""), (1, 6, "body", ""), (1, 7, "body", ""), (2, 1, "row", "2/timeframes")]
    assert rows(made.select("document_id", "row_no", "address", "new")) == [(1, 4, "3/scan", False), (2, 1, "2/timeframes", True)]


def F_address():
    from pyspark.sql import functions as F

    return F.coalesce("address", F.lit("")).alias("address")


def test_rare_tokens_find_every_pair(spark):
    """Against all pairs of random sets with very common tokens."""
    import random

    rng = random.Random(2)
    sets = {side: {i: sorted({rng.choice("aaabbcdefgh") for _ in range(rng.randint(1, 6))}) for i in range(60)} for side in "ab"}
    a, b = (spark.createDataFrame([(i, i % 2, t) for i, t in sets[s].items()], f"{s} long, g long, tokens array<string>") for s in "ab")
    for share, whole in ((0.6, True), (0.6, False), (1.0, False), (0.34, True)):
        want = [(i, j, len(x), len(y), len({*x} & {*y})) for i, x in sets["a"].items() for j, y in sets["b"].items() if i % 2 == j % 2 and len({*x} & {*y}) >= max(1, share * (min(len(x), len(y)) if whole else len(x)) - 1e-9)]
        assert rows(matching.shared_tokens(a, b, "g", share, whole)) == sorted(want)


def test_imports_are_deltas_of_two_versions(spark):
    printed = [(1, 1, None, 1, 2, "Pain!", "bone"), (1, 2, None, 2, 2, "Managing severe pain", "more"), (1, 3, None, 3, 2, "Unknown", "after"), (1, 4, 9, 4, 2, "Elsewhere", "lost"), (2, 5, None, 1, 2, "pain", "core text"), (2, 6, None, 2, None, "Old name", "ruled")]
    words = lambda t: t.lower().replace("!", "").split()
    sections = spark.createDataFrame([(*r[:6], words(r[5]), r[6]) for r in printed], "document_id long, section_id long, parent_id long, order_index long, step int, title string, tokens array<string>, body string")
    core = spark.createDataFrame([(10, 2, "Pain", ["pain"], "core text"), (11, 2, "Severe pain", ["severe", "pain"], "x"), (12, 3, "Unknown", ["unknown"], "y")], "target long, step int, title string, tokens array<string>, body string")
    rules = spark.createDataFrame([(1, None, "OLD name", 12), (0, 1, "old name", 10)], "priority int, document_id long, title string, target long")
    out = migration.import_legacy(sections, core, rules)
    assert rows(out["placed"].select("section_id", "target", "how")) == [(1, 10, "title"), (2, 11, "words"), (3, 11, "sibling"), (5, 10, "title"), (6, 12, "rule")]
    assert rows(out["rejects"].select("section_id", "reason")) == [(4, "no place")]
    assert rows(out["version_sections"].select("document_id", "version_no", "target", "diverged")) == [(1, 1, 10, True), (1, 1, 11, True), (1, 2, 10, True), (1, 2, 11, True), (2, 1, 10, False), (2, 1, 12, True), (2, 2, 10, False), (2, 2, 12, True)]
    assert {r.body for r in out["version_sections"].filter("document_id = 2 and target = 10 and version_no = 2").collect()} == {None}
    assert rows(out["targets"].filter("target = 11").select("body")) == [("more\nafter",)]
    assert rows(out["ledger"]) == [(1, 0, 1, 1, 1), (2, 1, 1, 0, 0)] and out["versions"].count() == 4
