"""Small hand-made corpora for rules that the given tables do not show."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import access, citations, lifecycle, matching, nodes, search, tree, versions
from quire.sources import corpus
from quire.streaming import feeds


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, T.slugify(F.lit("  Éine Über-Prüfung, 2nd!"))) == "eine-uber-prufung-2nd"
    assert one(spark, T.slugify(F.lit("ab-" * 40))) == "-".join(["ab"] * 21)
    assert one(spark, T.expand_markers(F.lit("4–6,9, 30-90, x"))) == [4, 5, 6, 9, 30, 90]
    assert one(spark, T.audit_words(F.lit("Take 5mg, daily"))) == ["take", "5", "mg", ",", "daily"]
    assert one(spark, T.edition_of(F.lit("Guide, 3 r d edition"))) == 3
    assert one(spark, T.clean_url(F.lit("javascript:alert(1)"))) is None
    assert round(one(spark, T.contrast(F.lit("#000000"), F.lit("#ffffff"))), 6) == 21.0
    assert one(spark, T.publication_date(F.lit("nothing"), F.lit("x-2020-05.pdf"))).isoformat() == "2020-05-01"


def test_outline_rejects_cycles_only_where_reached(spark):
    sec = spark.createDataFrame([("a", None, 1.0), ("b", "a", 2.0), ("c", "a", 1.0), ("x", "y", 1.0), ("y", "x", 1.0)], "id string, parent_id string, order_index double")
    out = tree.outline(sec)
    assert [r.id for r in out.orderBy("position").collect()] == ["a", "c", "b"]
    assert [r.id for r in tree.orphans_last(out, sec).collect()] == ["a", "c", "b", "x", "y"]
    assert tree.outline(sec.limit(0)).count() == 0


def test_hidden_parent_hides_the_subtree(spark):
    sec = spark.createDataFrame([("a", None, 1.0, False), ("b", "a", 1.0, True), ("c", "b", 1.0, False)], "id string, parent_id string, order_index double, hidden boolean")
    assert [r.id for r in tree.live_sections(tree.outline(sec)).collect()] == ["a"]
    ask = spark.createDataFrame([("c", False)], "id string, hide boolean")
    moved, rejects = tree.hide_subtrees(sec, tree.outline(sec), ask)
    assert moved.count() == 0 and [r.key for r in rejects.collect()] == ["c"]


def test_review_needs_every_decision(spark):
    rev = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "review_id string")
    pins = spark.createDataFrame([("r1", "a", "approved"), ("r1", "b", None), ("r2", "a", "approved"), ("r2", "b", "changes_requested")], "review_id string, section_id string, decision string")
    got = {r.review_id: (r.total, r.decision) for r in versions.review_state(rev, pins).collect()}
    assert got == {"r1": (2, None), "r2": (2, "changes_requested"), "r3": (0, None)}


def test_upsert_twice_is_once(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k long, v string")
    once = lifecycle.upsert(a, b, ["k"])
    assert rows(once) == rows(lifecycle.upsert(once, b, ["k"])) == [(1, "x"), (2, "z"), (3, "w")]


def test_body_walk_and_bad_json(spark):
    bodies = [(1, '{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"a "},{"type":"text","text":"b"},{"type":"citation","attrs":{"referenceId":"r"}}]}]}'), (2, "{not json"), (3, None)]
    n = nodes.explode_body(spark.createDataFrame(bodies, "document_id long, body_json string"))
    assert n.count() == 5
    assert rows(nodes.plain_text(n)) == [(1, "a b")]
    assert rows(nodes.citations_in(n)) == [(1, 1, "r")]


def test_hash_ignores_the_order_of_keys(spark):
    two = [(1, '{"type":"doc","content":[{"type":"text","text":"a"}]}'), (2, '{"content":[{"text":"a","type":"text"}],"type":"doc"}')]
    h = nodes.content_hash(nodes.explode_body(spark.createDataFrame(two, "document_id long, body_json string")))
    assert len({r.content_hash for r in h.collect()}) == 1


def test_diff_sizes(spark):
    pairs = spark.createDataFrame([(1, "a b c", "a x c"), (2, "same", "same"), (3, None, "new"), (4, None, None)], "id long, old string, new string")
    got = {r.id: (r.inserted, r.deleted, r.changed) for r in nodes.diff_sizes(pairs).collect()}
    assert got == {1: (1, 1, True), 2: (0, 0, False), 3: (3, 0, True), 4: (0, 0, False)}


def test_successors_in_a_circle_raise(spark):
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, supersedes string")
    with pytest.raises(ValueError):
        citations.reference_successors(ring)


def test_last_owner_stays(spark):
    mem = spark.createDataFrame([("t", "o", "owner"), ("t", "a", "admin"), ("t", "m", "member")], "org_id string, user_id string, role string")
    ask = [("t", "owner", "o", True, None), ("t", "admin", "m", False, "admin"), ("t", "owner", "a", False, "owner"), ("t", "member", "m", True, None)]
    got = access.may_change(spark.createDataFrame(ask, "org_id string, actor_role string, user_id string, self boolean, to string"), mem)
    assert rows(got.select("user_id", "actor_role", "allowed")) == [("a", "owner", True), ("m", "admin", False), ("m", "member", True), ("o", "owner", False)]


def test_appendix_list_beats_the_main_one(spark):
    lists = spark.createDataFrame([(1, 10, "main", 1, 9, 30), (1, 11, "appendix", 5, 9, 6), (1, 12, "appendix", 1, 9, 2)], "document_id long, list_id long, kind string, first_page long, last_page long, entries long")
    pages = spark.createDataFrame([(1, 4), (1, 6), (1, 20)], "document_id long, page long")
    assert rows(matching.reference_lists_for_page(lists, pages)) == [(1, 4, 10), (1, 6, 11)]


def test_audit_of_equal_multisets_is_empty(spark):
    w = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "page long, word string")
    assert matching.coverage_audit(w, w, ["page"]).filter("missing > 0 or extra > 0").count() == 0


def test_models_are_read_level_by_level(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"source":"x","sections":[{"id":"a","title":"A","blocks":[{"type":"p","text":"t"}],\n"sections":[{"id":"b","title":"B","blocks":[]}]}]}')
    (tmp_path / "bad.json").write_text("{")
    sections, blocks = corpus.read_models(spark, str(tmp_path))
    assert rows(sections.select("id", "title")) == [("a", "A"), ("b", "B")]
    assert [r.text for r in blocks.collect()] == ["t"]


def test_ledger_is_written(spark, tmp_path):
    placed = spark.createDataFrame([("d", "rule", "s1"), ("d", "title", "s2")], "document_id string, how string, section string")
    lifecycle.write_ledger(placed, str(tmp_path / "ledger"))
    assert spark.read.json(str(tmp_path / "ledger")).first().placed == 2


def test_corpus_schemas_read_back(spark, tmp_path):
    for name, ddl in corpus.TABLES.items():
        spark.createDataFrame([], ddl).write.parquet(str(tmp_path / name))
    assert {n: df.count() for n, df in corpus.load_corpus(spark, str(tmp_path)).items()} == dict.fromkeys(corpus.TABLES, 0)


def test_one_letter_finds_words_that_begin_with_it(spark):
    from quire.operators import search

    postings = spark.createDataFrame([(1, "tree", 1, 0), (2, "the", 0, 2), (3, "apple", 1, 1)], "section_id long, term string, title_tf long, body_tf long")
    q = spark.createDataFrame([(1, "t"), (2, "th")], "query_id long, text string")
    shared = spark.createDataFrame([], "core_id long, section_id long")
    got = sorted((r.query_id, r.section_id) for r in search.search_workspace(q, postings, shared).collect())
    assert got == [(1, 1), (1, 2), (2, 2)]


def _feed(spark, at, batches):
    """Event files of a stream that reads one file a batch, in this order."""
    ddl = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    for n, events in enumerate(batches):
        spark.createDataFrame(events, ddl).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{at}/events")
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{at}/events")


def _events(*rows_):
    from datetime import datetime

    return [(i, datetime(2024, 1, 1, hour), user, kind, 1.0, props) for i, hour, user, kind, props in rows_]


def _through(spark, at, start, read):
    start(f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return read(f"{at}/out")


LATE = [
    _events((2, 2, 1, "view", "new words"), (4, 4, 2, "error", ""), (5, 5, 3, "view", "a")),
    _events((1, 0, 1, "view", "old"), (3, 3, 2, "view", "gone"), (6, 6, 3, "error", "")),
    _events((7, 7, 3, "view", "back")),
]


def test_late_changes_do_not_undo_newer_ones(spark, tmp_path):
    s = _feed(spark, tmp_path, LATE)
    keep = lambda p, c: feeds.apply_change_feed(s, p, c, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", ["user_id", "ts", "event_id"])
    read = lambda p: feeds.latest_state(spark, p, feeds.newest(["user_id"], ["ts", "event_id"]))
    assert rows(_through(spark, tmp_path, keep, read).select("user_id", "event_id")) == [(1, 2), (3, 7)]


def test_index_follows_the_last_edit_by_time(spark, tmp_path):
    s = _feed(spark, tmp_path, [*LATE, LATE[0]])
    got = rows(_through(spark, tmp_path, lambda p, c: feeds.incremental_index(s, p, c), lambda p: feeds.indexed(spark, p)).select("section_id", "term", "tf"))
    assert got == [(1, "new", 1), (1, "view", 1), (1, "words", 1), (2, "error", 1), (3, "back", 1), (3, "view", 1)]


def test_presence_ends(spark, tmp_path):
    from datetime import datetime

    s = _feed(spark, tmp_path, LATE).withColumn("document_id", F.lit(9).cast("long"))
    state = _through(spark, tmp_path, lambda p, c: feeds.presence(s, p, c), lambda p: feeds.present(spark, p))
    assert rows(state.select("user_id")) == [(1,), (3,)]
    assert rows(feeds.still_present(state, F.lit(datetime(2024, 1, 1, 8)), "2 hours").select("user_id")) == [(3,)]


def test_citation_keys_of_several_authors_and_years(spark):
    said = "As Vijayvergia & Denlinger 2015, Wu et al. 2018a, 2018b and Fitch (2000) say (May 2019)."
    assert one(spark, T.author_year_keys(F.lit(said))) == ["vijayvergia denlinger 2015", "wu 2018a", "wu 2018b", "fitch 2000"]


def test_repeated_addresses_have_their_places(spark):
    text = "a https://x.org/a, https://x.org/a and https://x.org/ab."
    got = rows(matching.fit_link_spans(spark.createDataFrame([(1, text), (2, None), (3, "none")], "span_id long, text string")))
    assert got == [(1, "https://x.org/a", 2), (1, "https://x.org/a", 19), (1, "https://x.org/ab", 39)]


def test_done_guidance_is_not_open(spark):
    n = spark.createDataFrame([(1, "guidance", '{"done":true}'), (1, "guidance", '{"done":false}'), (1, "guidance", None)], "document_id long, type string, attrs string")
    assert rows(nodes.open_items(n, ["guidance"])) == [(1, "guidance", 2)]


def test_reverting_drops_the_own_body(spark):
    sec = spark.createDataFrame([(1, 1, 9, True, "own"), (1, 2, 9, False, None), (1, 3, None, True, "x")], "document_id long, section_id long, core_id long, diverged boolean, body string")
    assert rows(lifecycle.revert(sec, sec.select("document_id", "section_id"))) == [(1, 1, 9, False, None)]


def test_marks_breaks_choices_and_placeholders(spark):
    inline = '{"type":"text","text":" a  b"},{"type":"text","text":"1","marks":[{"type":"superscript"}]},{"type":"hardBreak"},{"type":"text","text":"c"}'
    held = lambda label, text: '{"type":"text","text":"%s","marks":[{"type":"bold"},{"type":"placeholder"%s}]}' % (text, f',"attrs":{{"label":"{label}"}}' if label else "")
    marked = ",".join([held("[Cancer type].", "x"), held(None, "<insert population group>"), held("name", "y"), held(None, "z"), held("name", "[cancer type]")])
    bodies = [(1, '{"type":"doc","content":[{"type":"p","content":[%s]},{"type":"p","content":[]},{"type":"variants","content":[{"type":"p","content":[%s]}]}]}' % (inline, marked)), (2, '{"type":"doc"}')]
    n = nodes.explode_body(spark.createDataFrame(bodies, "document_id long, body_json string"))
    assert rows(nodes.plain_text(n)) == [(1, "a b c\nx<insert population group>yz[cancer type]")]
    assert rows(nodes.search_text(n)) == [(1, "a b1c\nx<insert population group>yz[cancer type]")]
    assert rows(nodes.open_choices(n)) == [(1, 1), (2, 0)]
    assert rows(nodes.blocking_placeholders(n)) == [(1, 2), (2, 0)]


def test_entries_hold_every_word_of_a_query(spark):
    register = spark.createDataFrame([(1, "Über das Licht", True), (2, "licht", False), (3, "Ab", False), (4, None, False)], "reference_id long, citation string, cited boolean")
    q = spark.createDataFrame([(1, "licht"), (2, "b"), (3, " "), (4, "das über"), (5, None)], "query_id long, text string")
    assert rows(search.search_references(q, register)) == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 3), (4, 1, 1)]


def _size(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_a_batch_writes_what_it_changed(spark, tmp_path):
    """After a large batch a small one writes little; the log is folded, let go, and read alike all the time."""
    from datetime import datetime

    many = [(i, datetime(2024, 1, 1), i, "view", 1.0, "x" * 50) for i in range(20_000)]
    small = [_events((20_000 + n, 1 + n, n, "error" if n % 2 else "view", "")) for n in range(9)]
    s = _feed(spark, tmp_path, [many, *small])
    keep = lambda p, c: feeds.apply_change_feed(s, p, c, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", ["user_id", "ts", "event_id", "props"], every=4, remembered="1 hour")
    state = _through(spark, tmp_path, keep, lambda p: feeds.latest_state(spark, p, feeds.newest(["user_id"], ["ts", "event_id"])))
    assert state.count() == 20_000 - 4 and rows(state.filter("user_id < 9").select("user_id", "event_id")) == [(n, 20_000 + n) for n in range(0, 9, 2)]
    out = tmp_path / "out"
    assert sorted(p.name for p in out.iterdir()) == ["base=3", "base=7", "delta=4", "delta=5", "delta=6", "delta=7", "delta=8", "delta=9"]
    assert _size(out / "delta=8") < _size(out / "base=7") / 50
    # Deletions of more than an hour before the newest change are let go.
    assert spark.read.parquet(str(out / "base=7")).filter("_gone").count() == 1


def test_a_restart_goes_on_and_a_batch_may_run_again(spark, tmp_path):
    import shutil

    read = lambda p: feeds.latest_state(spark, p, feeds.newest(["user_id"], ["ts", "event_id"]))
    keep = lambda s: lambda p, c: feeds.apply_change_feed(s, p, c, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", ["user_id", "ts", "event_id"])
    _through(spark, tmp_path, keep(_feed(spark, tmp_path, LATE[:2])), read)
    # As if the driver had been lost after the second batch's files, before its commit.
    shutil.rmtree(tmp_path / "checkpoint" / "commits")
    (tmp_path / "checkpoint" / "commits").mkdir()
    state = _through(spark, tmp_path, keep(_feed(spark, tmp_path, LATE[2:])), read)
    assert rows(state.select("user_id", "event_id")) == [(1, 2), (3, 7)]


def test_a_silent_user_leaves(spark, tmp_path):
    """Of three users one leaves, one falls silent and one stays; only the others' events move the clock."""
    s = _feed(spark, tmp_path, [_events((1, 0, 1, "view", ""), (2, 0, 2, "view", ""), (3, 1, 2, "error", "")), _events((4, 1, 3, "view", "")), _events((5, 5, 3, "view", "")), _events((6, 6, 3, "view", ""))])
    s = s.withColumn("document_id", F.lit(9).cast("long"))
    out = _through(spark, tmp_path, lambda p, c: feeds.visits(s, p, c, ttl_seconds=7200), lambda p: spark.read.parquet(p))
    assert rows(out.select("user_id", "event_id", "signs", "ended_by")) == [(1, 1, 1, "silence"), (2, 2, 2, "left"), (3, 4, 1, "silence")]


def test_rows_moved_by_others_win_and_late_edits_lose(spark, tmp_path):
    say = lambda n, hour, kind, content: (n, hour, 1, kind, content)
    batches = [_events(say(1, 1, "edit", "a"), say(2, 2, "edit", "a"), say(3, 3, "row", "theirs")), _events(say(5, 5, "edit", "mine again"), say(4, 4, "edit", "mine")), _events(say(6, 2, "edit", "late"), say(7, 2, "row", "late too"), say(8, 6, "edit", "end"))]
    s = _feed(spark, tmp_path, batches).select(F.col("user_id").alias("section_id"), "event_id", "ts", (F.col("event_type") == "row").alias("moved"), F.col("props").alias("content"))
    out = _through(spark, tmp_path, lambda p, c: feeds.fold_edits(s, p, c), lambda p: spark.read.parquet(p))
    assert rows(out.select("event_id", "outcome", "content")) == [(1, "written", "a"), (4, "row", "theirs"), (5, "written", "mine again"), (8, "written", "end")]


def test_every_rule_of_the_citation_cascade(spark):
    listed = [
        (1, "smith 2018"), (2, "smith 2019a"), (3, "smith 2019b"), (4, "cancer council australia working party 2014"), (5, "world health organization 2018"), (6, "bsh 2020"),
        (7, "commonwealth department of health 2017"), (8, "indigenous healthinfonet 2024"), (9, "lee 2010"), (9, "lee and wu 2010"), (10, "doe 2011"), (11, "doe 2011"), (12, "cancer research fund 2014"),
    ]
    asked = {
        "smith 2018": (1, "exact"), "cancer council 2014": (4, "prefix"), "who 2018": (5, "initials"), "british society of haematology 2020": (6, "abbreviation"),
        "australian government department of health 2017": (7, "tail"), "healthinfonet 2024": (8, "tail"), "lee 2016": (9, "year slip"), "doe 2011": (None, "several entries"),
        "smith 2001": (None, "other years"), "nobody 2000": (None, "no entry"), "cancer 2014": (None, "no entry"), "health 2017": (None, "no entry"), "lee 2010": (9, "exact"), "smith": (None, "no entry"),
    }
    part = lambda k: k.rsplit(" ", 1) if k[-2:].strip() and k.rsplit(" ", 1)[-1][:1].isdigit() else [k, ""]
    keys = spark.createDataFrame([(i, 7, *part(k)) for i, k in listed], "reference_id long, list_id long, name string, year string")
    mentions = spark.createDataFrame([(k, 7, *part(k)) for k in asked] + [("else", 8, "smith", "2018"), (None, 7, None, None)], "mention string, list_id long, name string, year string")
    got = {r.mention: (r.reference_id, r.rule) for r in citations.resolve_citations(mentions, keys).collect()}
    assert got == asked | {"else": (None, "no entry"), None: (None, "no entry")}


def test_only_the_topmost_hidden_section_is_a_removal(spark):
    draft = [(1, None, False, False), (2, 1, True, False), (3, 2, True, False), (4, 3, False, False), (5, 1, True, True), (6, 1, False, False), (7, 6, True, False), (8, None, False, False)]
    d = spark.createDataFrame([(1, s, p, float(s), h, a, f"h{s}") for s, p, h, a in draft], "document_id long, section_id long, parent_id long, order_index double, hidden boolean, apparatus boolean, body_hash string")
    p = spark.createDataFrame([(1, s, "h1" if s == 1 else "old", s == 7) for s in range(1, 8)], "document_id long, section_id long, body_hash string, hidden boolean")
    assert rows(versions.reviewable_changes(d, p).select("section_id", "change")) == [(2, "removed"), (6, "changed"), (8, "new")]


def test_parts_of_printed_citations(spark):
    from quire.functions import intext

    said = {
        1: "(COSA 2013; palliAGED 2018)", 2: "(they may also be malnourished [WHO 2018])", 3: "Fitch’s (2000) model", 4: "Smith and Jones (2019a, 2019b) say", 5: "(May 2019)", 6: "the plan (2021)",
        7: "(AIHW 2018, Brewster et al. 2014)", 8: "(Jaenke et al. 2021 Whop et al. 2022 Wu 2023)", 9: "(adapted from Fizazi et al. 2015)", 10: "(Laidsaar-Powell et al; 2018a, 2018b)",
        11: "(Royal College of Pathologists 2013; 2017)", 12: "(Simms K T 2010)", 13: "(12018; 2018ab)", 14: None, 15: "", 16: "[x (a 2001) y", 17: "(Smith 2018, table 3, 2019)",
        18: "(" * 20000 + "A" * 200000 + "(2001", 19: "(" + "no year; " * 50000 + "Lee 2001)",
    }
    df = spark.createDataFrame(list(said.items()), "id int, text string").withColumn("name", F.lit("other"))
    got = {}
    for r in intext.citation_parts(df).orderBy("id", "bracket", "entry", "at").collect():
        got.setdefault(r["id"], []).append(f"{r['name']} {r['year']}")
    assert got == {
        1: ["cosa 2013", "palliaged 2018"], 2: ["who 2018"], 3: ["fitch 2000"], 4: ["smith jones 2019a", "smith jones 2019b"], 7: ["aihw 2018", "brewster 2014"],
        8: ["jaenke 2021", "whop 2022", "wu 2023"], 9: ["fizazi 2015"], 10: ["laidsaar powell 2018a", "laidsaar powell 2018b"], 11: ["royal college of pathologists 2013", "royal college of pathologists 2017"],
        12: ["simms 2010"], 16: ["a 2001"], 17: ["smith 2018", "smith 2019"], 19: ["lee 2001"],
    }


def test_siblings_of_one_order_keep_their_subtrees(spark):
    sec = spark.createDataFrame([("a", None, 1.0), ("b", "a", 1.0), ("c", "a", 1.0), ("d", "b", 2.0), ("e", "c", 1.0), ("f", "a", 0.5), ("g", "f", None), ("h", None, 9.0)], "id string, parent_id string, order_index double")
    got = tree.outline(sec).filter("root = 'a'").orderBy("position").select("id", "position").collect()
    assert [tuple(r) for r in got] == [("a", 1), ("f", 2), ("g", 3), ("b", 4), ("d", 5), ("c", 6), ("e", 7)]
    assert rows(tree.outline(sec).filter("root = 'h'").select("position")) == [(1,)]


def test_positions_against_a_walk(spark):
    import random

    dice = random.Random(7)
    pairs = [(i, None if i < 3 else dice.randrange(i), float(dice.randrange(4))) for i in range(300)]
    below, want = {}, {}
    for i, up, order in pairs:
        below.setdefault(up, []).append((order, i))

    def walk(i, root):
        want.setdefault(root, []).append(i)
        for _, k in sorted(below.get(i, [])):
            walk(k, root)

    for _, i in below[None]:
        walk(i, i)
    got = tree.outline(spark.createDataFrame(pairs, "id long, parent_id long, order_index double")).select("id", "root", "position")
    assert rows(got) == sorted((i, root, n) for root, ids in want.items() for n, i in enumerate(ids, 1))


def test_central_members_see_documents_of_no_team(spark):
    doc = spark.createDataFrame([(1, 5), (2, 0), (3, None)], "document_id long, org_id long")
    mem = spark.createDataFrame([("c", 0, "member"), ("c", 5, "viewer"), ("d", 0, "owner"), ("e", 5, "owner")], "user_id string, org_id long, role string")
    seen = access.visible_documents(doc, mem, 0)
    assert rows(seen) == [("c", 1, "viewer"), ("c", 2, "member"), ("c", 3, "admin"), ("d", 1, "admin"), ("d", 2, "owner"), ("d", 3, "admin"), ("e", 1, "owner")]
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and all("=" in line for line in plan.splitlines() if "Join" in line)


def test_places_that_cite(spark):
    sections = spark.createDataFrame(
        [("s1", 1, None, "a", ["r1", "r1"]), ("s2", 1, None, "b", None), ("f1", 1, "v1", "a", ["r2"]), ("f2", 1, "v2", "a", ["r1"])],
        "section_id string, document_id long, version_id string, address string, title_citations array<string>",
    )
    n = spark.createDataFrame([("s1", "citation", '{"referenceId":"r1"}'), ("s2", "citation", '{"referenceId":"r3"}'), ("f1", "text", None), ("f1", "citation", '{"referenceId":"r1"}')], "section_id string, type string, attrs string")
    v = spark.createDataFrame([("v1", 4, "archived"), ("v2", 5, "draft")], "version_id string, version_no long, status string")
    asked = spark.createDataFrame([("r1",), ("r2",), ("r9",), ("r1",)], "reference_id string")
    got = citations.citing_places(asked, sections, n, v).collect()
    want = [("r1", 1, None, "a", True, True), ("r1", 1, 4, "a", False, True), ("r2", 1, 4, "a", True, False)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_guide_of_a_document(spark):
    sections = spark.createDataFrame(
        [(1, "s1", "step-2", "Second", False, 1), (1, "s2", "step-2/a", "Doses", True, 2), (1, "s3", "step-3/b", "Notes", False, 3), (1, "s4", "about", "About", False, 4), (2, "t1", "step-2", "Other", False, 1)],
        "document_id long, section_id string, address string, title string, point_of_care boolean, place long",
    )
    flagged, plain = '{"kind":"check","pointOfCare":true}', '{"kind":"check","pointOfCare":false}'
    n = spark.createDataFrame(
        [
            ("s1", [0], "list", flagged), ("s1", [0, 0], "listItem", None), ("s1", [0, 0, 0], "citation", '{"referenceId":"r1"}'), ("s1", [1], "citation", '{"referenceId":"r2"}'),
            ("s2", [0], "citation", '{"referenceId":"r3"}'), ("s2", [1], "list", flagged), ("s3", [0], "list", plain), ("s4", [2], "list", flagged), ("t1", [0], "citation", '{"referenceId":"r1"}'),
        ], "section_id string, path array<int>, type string, attrs string",
    )
    numbers = spark.createDataFrame([(1, "r1", 7), (1, "r2", 8), (1, "r3", 9), (2, "r1", 1)], "document_id long, reference_id string, number long")
    entries, cited = nodes.guide_page(sections, n, numbers)
    got = entries.orderBy("place", "path").select("section_id", "path", "kind", "step", "step_title").collect()
    assert [tuple(r) for r in got] == [("s1", [0], "item", 2, "Second"), ("s2", [], "section", 2, "Second"), ("s4", [2], "item", None, None)]
    assert rows(cited) == [(1, "r1", 7), (1, "r3", 9)]
