"""The registered queries over whole tables, against brute force on a small hand-made corpus."""

import hashlib
import re

import pytest
from quire.plans import registry

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(path, {doc_id: lines}): documents of 1 to 90 lines, of which some are long and some are common."""
    path = str(tmp_path_factory.mktemp("corpus"))
    odd = 'é "quoted" \\ [a] {b} <c> \u00a0 & 日本 \U0001f600 \\n \t /'
    held = {i: [f"line {i} {n} {odd} " + "word, " * (n % 40) + "end." if n % 7 else f"common {n // 7}" for n in range(1, size)] for i, size in enumerate((2, 40, 60, 61, 75, 91))}
    spark.createDataFrame([(i, "\n".join(x)) for i, x in held.items()], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path, held


def leaves(held):
    """(document_id, k, text, reference_id) of every line."""
    docs = {}
    for i, x in held.items():
        for line in x:
            docs.setdefault(line, set()).add(i)
    for i, x in held.items():
        for k, line in enumerate(x):
            cited = len(docs[line]) >= 4
            yield i, k, None if cited else line, hashlib.sha256(line.encode()).hexdigest()[:12] if cited else None


def test_bodies_hold_every_line_whole(spark, corpus):
    path, held = corpus
    every = list(leaves(held))
    assert max(k for _, k, _, _ in every) > 60 and max(len(t or "") for _, _, t, _ in every) > 200 and any(r and k >= 40 for _, k, _, r in every)
    want = sorted([(i, "", "doc", "") for i in held] + [(i, str(k), "paragraph", "") for i, k, _, _ in every] + [(i, f"{k}.0", "citation" if r else "text", t or "") for i, k, t, r in every])
    assert sorted((r.document_id, r.path, r.type, r.text or "") for r in QUERIES["explode_body"](spark, path).collect()) == want
    text = {r.document_id: r.text for r in QUERIES["plain_text"](spark, path).collect()}
    assert text == {i: "\n".join(re.sub(r"[ \t]+", " ", t) for d, _, t, r in every if d == i and not r) for i in held}
    cited = sorted((r.document_id, r.path, r.reference_id) for r in QUERIES["repoint_citations"](spark, path).collect())
    assert cited == sorted((i, f"{k}.0", "new-" + r if r < "8" else r) for i, k, _, r in every if r)


def test_instructions_hold_the_rows_of_every_level(spark, data):
    table = lambda name: spark.read.parquet(f"{data}/{name}.parquet").collect()
    region = {n.n_nationkey: n.n_regionkey for n in table("nation") if n.n_nationkey % 2 == 0}
    home = {c.c_custkey: region[c.c_nationkey] for c in table("customer") if c.c_nationkey in region}
    held = [(f"n{k}", r, 0) for k, r in region.items()] + [(f"c{k}", r, 1) for k, r in home.items()]
    held += [(f"o{o.o_orderkey}", home[o.o_custkey], 2) for o in table("orders") if o.o_custkey in home]
    want = sorted((s.s_suppkey, i, level) for s in table("supplier") for i, r, level in held if r == s.s_suppkey % 5)
    got = registry.queries()["instructions_outline"](spark, data).select("document_id", "id", "level")
    assert sorted(map(tuple, got.collect())) == want
