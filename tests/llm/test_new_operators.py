"""Spelling variants, page texts and manifests against plain versions, on awkward rows, and the registered queries."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from llm.helpers import LONG, nothing, texts
from oracle import compare
from pyspark.sql import functions as F
from quire.llm import manifest, pages, queries, spelling


# --- spelling ---------------------------------------------------------------------------------------------------------


def lower(word):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)


def plain_variants(rows):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                count[w] += 1
    held = {w: n for w, n in count.items() if n >= 2}
    near, lacking = defaultdict(set), defaultdict(set)
    for w in held:
        for k in range(len(w)):
            less = w[:k] + w[k + 1 :]
            lacking[less, k].add(w)
            if less in held:
                near[w].add(less)
                near[less].add(w)
    for group in lacking.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in held.items():
        first = min(((-held[x], x) for x in near[w]), default=None)
        if first and -first[0] >= 10 * n:
            form[w] = first[1]

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), held.get(form.get(w))) for w, n in held.items())


def variants(df):
    return sorted(tuple(r) for r in spelling.group_variants(df).collect())


def test_variants_on_awkward_rows(spark):
    long = "longword" * 500
    extra = [(7, "Wonderful wonderful " * 150 + "wonderfull " * 2 + "wonderfu " * 30 + "onderfu " * 3), (8, "wonderfull wondérful wondérful wONDERFUL wonderfuÀ wonderfuÀ wonderfuÁ wonderfuÁ"), (9, f"{long} {long} {long}x {long}x"), (8, "wonderfux wonderfux " + "wonderfux wunderfu " * 2)]
    df = texts(spark, extra)
    got = variants(df)
    assert got == plain_variants([(r.doc_id, r.text) for r in df.collect()])
    assert any(r[1] for r in got) and any(r[2] != (r[1] or r[0]) for r in got) and max(len(r[0]) for r in got) > 4000
    assert variants(nothing(spark)) == []


def test_generated_neighbourhoods_hold_every_edit():
    """Any word within one edit has its key in the neighbourhood, however letters are reduced."""
    rng = random.Random(1)
    for _ in range(200):
        w = "".join(rng.choices("abcdefghéÿ", k=rng.randint(1, 12)))
        k = rng.randrange(len(w) + 1)
        for v in (w[:k] + w[k + 1 :], w[:k] + "z" + w[k + 1 :], w[:k] + "q" + w[k:]):
            if v:
                ((_, symbols),) = spelling._by_length([w])
                made = {int(h) for m in spelling.neighbourhood(symbols) for h in m.ravel()}
                assert int(spelling.keys([v])[0]) in made and int(spelling.keys([w])[0]) in made


def test_hot_reduced_word(spark):
    """Many words of one reduced form, and many near one another."""
    same = [chr(c) for c in range(ord("a"), ord("z") + 1) if zlib.crc32(bytes([c])) % spelling.SYMBOLS == zlib.crc32(b"a") % spelling.SYMBOLS]
    words = ["".join(random.Random(i).choices(same, k=7)) for i in range(400)]
    rows = [(i, f"{w} {w}") for i, w in enumerate(words)]
    assert variants(spark.createDataFrame(rows, "doc_id long, text string")) == plain_variants(rows)


# --- pages ------------------------------------------------------------------------------------------------------------


def plain_article(page):
    """The article of the given tables' pages, taken apart by its known elements."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|br|h1)>", "\0", inside)).split("\0")
    return " ".join(" ".join(html.unescape(p) for p in parts).split())


def test_page_texts_of_the_given_table(spark, data):
    rows = {r.page_id: r for r in queries.QUERIES["op12_pages"](spark, data).collect()}
    given = spark.read.parquet(f"{data}/pages.parquet").collect()
    assert len(rows) == len(given)
    for r in given:
        assert rows[r.page_id].text == plain_article(r.html) and rows[r.page_id].n_chars == len(rows[r.page_id].text) and rows[r.page_id].url == r.url


WEIGHTS = pages.fit([x for x in map(pages.labelled, [
    "<nav><ul><li><a>one</a></li><li><a>two</a></li></ul></nav><article><h1>A title of words</h1><p>" + "some words of text " * 9 + "<p>End.</article><footer>all rights are kept by them</footer>"
] * 20) if x])


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("   ", ""), ("just words", "just words"), ("a < b &amp; c &lt; d", "a < b & c < d"),
    ("<p>one<p>two <b>bo</b>ld</p>", "one two bold"),
    ("<article><header><h1>Title</h1><span>by me</span></header><p>Body &eacute;&#233;&am x.</p><aside>not this</aside><p>More</article>", "Title Body éé&am x. More"),
    ("<article><p>text of it</p><section class='comments'><p>first reader</p><p>second reader</p></section></article>", "text of it"),
    ("<article><p>text of it</p><article><p>a nested one is a comment</p></article><p>end</p></article>", "text of it end"),
    ("<header><h1>Site name and motto</h1></header><main><article><p>Kept words.</p></article></main><div id=sidebar>side words of many kinds here</div>", "Kept words."),
    ("<article>kept<div class='ad-slot'>buy</div><form><p>mail us</p></form><div role=alert>hear</div><div hidden>no</div><p style='display: none'>no</p>end</article>", "kept end"),
    ("<article><script>var a='</p><p>x';</script>t<style>p{}</style><!-- c <p>x</p> --><noscript>n</noscript><textarea>area</textarea>u</article>", "tu"),
    ("<article><p title='a > b'>x</p><img alt='<p>'><p>y\n\n z w</p></article>", "x y z w"),
    ("<article>unclosed <p>words <a href='x never closed", "unclosed words"),
    ("<body class='has-sidebar no-ads'><div class='content with-sidebar'><p>" + "words " * 30 + "</p></div><div class='sidebar'><p>" + "side " * 90 + "</p></div>", ("words " * 30).strip()),
    ("<ul><li><a href=/a>a</a><li><a href=/b>b</a></ul><div><p>" + "free words " * 20 + "</p></div><ul><li><a>z</a></ul>", ("free words " * 20).strip()),
])
def test_page_texts(page, text):
    assert pages.extract(page, WEIGHTS) == text


def test_the_run_is_the_best():
    rng = random.Random(3)
    for _ in range(300):
        s = [rng.randint(-4, 4) for _ in range(rng.randint(0, 14))]
        a, b = pages.best_run(s)
        assert sum(s[a:b]) == max([sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)], default=0)


def test_weights_part_pages_without_a_main_element():
    """Learnt on labelled pages, the weights find the same text where the main element has no name."""
    page = "<nav><ul><li><a>one</a></li><li><a>two</a></li></ul></nav><div><h1>A title of words</h1><p>" + "some words of text " * 9 + "<p>End.</div><footer>all rights are kept by them</footer>"
    assert pages.extract(page, WEIGHTS) == "A title of words " + "some words of text " * 9 + "End."
    assert all(w >= pages.LEAST_WORD if f in pages.PRIOR else w <= pages.MOST_TAG for f, w in WEIGHTS.items())


def test_long_and_broken_pages_are_linear(spark):
    """Deep, unclosed and quoted markup of a million characters."""
    for page in ("<div>" * 200_000 + "x", "<a href='" * 100_000, "<p><b>" * 150_000 + "y", "</span>" * 100_000, "<li>" * 200_000, "<!" * 300_000, "<article>" * 20_000 + LONG):
        pages.extract(page, WEIGHTS)
    odd = spark.createDataFrame([(1, "u", None, 1), (1, "u", "", 2), (None, None, "<p>x", 3), (2, "v", f"<article>{LONG}</article>", 4)], "page_id long, url string, html string, text long")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in pages.main_text(odd, pages.fitted(odd)).collect())
    assert got == [(0, "", "x", 1), (1, "u", "", 0), (1, "u", "", 0), (2, "v", LONG.strip(), len(LONG.strip()))]
    assert pages.main_text(odd.limit(0), pages.fitted(odd.limit(0))).count() == 0


# --- manifest ---------------------------------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The root of the nodes, and for each the digests left and right of it on the way."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
            paths[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        nodes = [digest(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [p // 8 for p in at]
    return nodes[0], paths


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof) of rows (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in order:
        held = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        made[g] = held, *climb([plain_leaf(*r) for r in held])
    root, above = climb([made[g][1] for g in order])
    return sorted((-1 if r[0] is None else r[0], plain_leaf(*r), made[g][1], root, tuple(p + above[i])) for i, g in enumerate(order) for r, p in zip(made[g][0], made[g][2]))


def proofs(df):
    made = manifest.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], "lang", ["doc_id"])
    return sorted((-1 if r.doc_id is None else r.doc_id, r.leaf, r.subroot, r.root, tuple((bytes(s.left).hex(), bytes(s.right).hex()) for s in r.proof)) for r in made.collect())


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root int"


@pytest.mark.parametrize("sizes", [{}, {"a": 1}, {"a": 8}, {"a": 9}, {"a": 65}, {"a": 64, None: 1}, {f"l{i}": 1 + i % 3 for i in range(20)} | {"a": 700, None: 3, "": 2}])
def test_proofs(spark, sizes):
    rows = [(i if i % 7 else None if i % 2 else 7, "s" if i % 3 else None, lang, i, "équal" if i % 5 == 0 else None if i % 5 == 1 else f"Text {i}", "x", 1) for n, (lang, size) in enumerate(sizes.items()) for i in range(size)]
    rows += rows[:3]
    got = proofs(spark.createDataFrame(rows, SCHEMA))
    assert got == plain_manifest([r[:5] for r in rows]) if rows else got == []


def test_a_proof_shows_what_was_changed(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    want = {r[0]: r for r in plain_manifest(rows)}
    texts_of = {r[0]: r[4] for r in rows}
    seen = Counter()
    for r in queries.QUERIES["op13_manifest"](spark, data).collect():
        i, leaf, subroot, root, proof = want[r.doc_id]
        changed = zlib.crc32(str(i).encode()) % 3 == 0 and lower(texts_of[i]) != texts_of[i]
        assert (r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) == (leaf, subroot, root, digest(*(a + b for a, b in proof)), not changed)
        assert (r.folded_root == root) == r.verified
        seen[r.verified] += 1
    assert len(seen) == 2 and sum(seen.values()) == len(rows)


@pytest.mark.parametrize("name", queries.ORACLE)
def test_sql(spark, data, name):
    assert compare(spark, data, queries.QUERIES[name], queries.ORACLE[name]) == "ok"


def test_awkward_rows_of_the_manifest(spark):
    df = texts(spark).withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]
    assert proofs(df) == plain_manifest(rows)
