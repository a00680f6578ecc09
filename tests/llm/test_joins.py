"""Neighbours, search, the Jaccard join and the pipeline against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.helpers import nothing, texts
from pyspark.sql import functions as F
from quire.llm import jaccard, neighbours, search


def vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 12)).round(3)
    v[100:160] = v[100]
    v[200] = 2 * v[201]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 12), (1003, [float("nan")] * 12), (1004, [None] * 12), (1005, [1.0, 2.0]), (7, rows[7][1]), (None, rows[8][1])]
    return spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, score int")


def test_neighbours_match_brute_force(spark):
    frame = vectors(spark)
    got = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    held = {r.vec_id: np.array(r.embedding, float) for r in frame.filter("vec_id < 600").collect()}
    ids = sorted(held)
    e = np.stack([held[i] for i in ids])
    e /= np.sqrt((e * e).sum(1))[:, None]
    for q in range(0, 600, 50):
        s = (e @ e[q]).round(12)
        want = [i for i in np.lexsort((ids, -s)) if i != q][:5]
        assert [got[q][k][0] for k in range(1, 6)] == want
        assert np.allclose([got[q][k][1] for k in range(1, 6)], s[want])
    assert 1002 not in got


def test_more_near_copies_than_asked_for(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(900, 24)).astype(np.float32)
    v[:150] = v[0] + rng.normal(size=(150, 24)).astype(np.float32) * 1e-4  # closer than one byte a component can tell
    v[150:200] = v[150] * np.float32(2.0) ** np.arange(50)[:, None]  # parallel: exact ties
    frame = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    e = v.astype(float)
    got = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 50 == 0, window=200, run=300).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    for q in (0, 50, 100, 150):
        s = (e @ e[q]) / np.linalg.norm(e, axis=1) / np.linalg.norm(e[q])
        s[q] = -2
        assert np.allclose([got[q][k][1] for k in range(1, 6)], np.sort(s)[::-1][:5], rtol=0, atol=1e-15)
    assert sorted(i for i, _ in got[150].values()) == [151, 152, 153, 154, 155]


def test_near_copies_do_not_go_on_by_whole_windows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 64)).astype(np.float32)
    v[:1000] = v[0] + rng.normal(size=(1000, 64)).astype(np.float32) * 0.07  # cosines of about 0.995
    frame = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    met = []
    monkeypatch.setattr(neighbours, "settle", lambda df, own=neighbours.settle: (kept := own(df), met.append(kept.count() if "low" in df.columns else 0))[0])
    got = neighbours.nearest(frame, F.col("vec_id") % 50 == 0, curves=6, window=400, run=800).collect()
    assert len(got) == 30 * 5 and 0 < max(met) <= 30 * 6 * 3 * 8


def test_window_of_a_small_share(spark):
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(300, 16))
    v = centre[rng.integers(0, 300, 6000)] + rng.normal(size=(6000, 16)) * 0.2
    frame = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 100 == 0, curves=8, window=60, run=500).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    found = 0
    for q in range(0, 6000, 100):
        s = u @ u[q]
        s[q] = -2
        found += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert found >= 0.9 * 300  # 8 windows of 120 hold at most 16 % of the vectors


def test_window_grows_with_the_vectors():
    assert [neighbours.width_for(n) for n in (0, 200_000, 512_820)] == [1024, 1024, 2075]


def test_few_or_no_vectors(spark):
    frame = vectors(spark)
    few = neighbours.nearest(frame.filter("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.rank) for r in sorted(few, key=lambda r: r.rank)] == [(0, 1), (0, 2)]
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_hilbert_steps_are_neighbours():
    for n, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        key = neighbours.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[key.argsort()], axis=0)).sum(1) == 1).all()


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 400), st.integers(1, 60), st.integers(1, 40), st.integers(1, 12), st.integers(0, 2**32 - 1), st.sampled_from([1, 4, 64]))
def test_block_max_wand_is_exact(docs, vocab, asked, k, seed, block):
    rng = np.random.default_rng(seed)
    rare = rng.random(vocab) ** 3  # some terms nearly everywhere, others nearly nowhere
    ids = np.sort(rng.choice(10_000, docs, replace=False))
    terms = [np.flatnonzero(rng.random(vocab) < rare) for _ in ids]
    tfs = [rng.integers(1, 5, len(t)).astype(np.int32) for t in terms]
    length = np.array([int(f.sum()) + 1 for f in tfs])
    query, idf = rng.permutation(vocab)[:asked], rng.random(vocab)[:asked] * 5
    old, search.BLOCK = search.BLOCK, block
    try:
        shuffled = rng.permutation(docs)
        index = search.Index(ids[shuffled], length[shuffled], [terms[i].astype(np.int64).tobytes() for i in shuffled], [tfs[i].tobytes() for i in shuffled], float(length.mean()), np.unique(query))
        got = index.best(query, idf, k)
    finally:
        search.BLOCK = old
    want = []
    for i, n, t, f in zip(ids, length, terms, tfs):
        tf = dict(zip(t.tolist(), f.tolist()))
        s = sum(w * tf[q] * 2.2 / (tf[q] + 1.2 * (0.25 + 0.75 * n / length.mean())) for q, w in zip(query.tolist(), idf.tolist()) if q in tf)
        if s:
            want.append((round(s, 9), i))
    want = sorted(want, key=lambda x: (-x[0], x[1]))[:k]
    assert np.allclose(got[1], [s for s, _ in want], atol=1e-8)
    if want:  # a threshold that is reached changes nothing
        again = index.best(query, idf, k, want[-1][0])
        assert again[0].tolist() == got[0].tolist() and again[1].tolist() == got[1].tolist()
    apart = np.diff(got[1]) < -1e-7
    if apart.all():
        assert got[0].tolist() == [i for _, i in want] or len(want) == k


def test_search_over_shards_and_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD", 30)
    monkeypatch.setattr(search, "QUERIES", 5)
    rng = np.random.default_rng(6)
    held = {i: [f"w{j}" for j in np.flatnonzero(rng.random(40) < rng.random(40) ** 2)] for i in range(90)}
    held |= {i: held[i - 90] for i in range(90, 96)}  # ties across shards
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in held.items()], "doc_id long, text string").repartition(3)
    asks = docs.filter("doc_id < 10").withColumnRenamed("doc_id", "query_id")
    got = {}
    for r in search.top_k(docs, asks, 4, exclude_self=True).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    n, mean = len(held), sum(map(len, held.values())) / len(held)
    df = Counter(w for t in held.values() for w in t)
    for q in range(10):
        score = {i: round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in set(held[q]) & set(t)), 9) for i, t in held.items() if i != q}
        want = sorted(((-s, i) for i, s in score.items() if s))[:4]
        assert [(i, s) for _, i, s in sorted(got.get(q, []))] == [(i, pytest.approx(-s, abs=1e-8)) for s, i in want]


def test_search_matches_brute_force(spark):
    rows = [(i, " ".join(["apple pear", "plum", "fig fig", "apple"][j] for j in range(4) if (i >> j) & 1)) for i in range(40)]
    docs = texts(spark, [(100 + i, t) for i, t in rows])
    asks = spark.createDataFrame([(1, "apple fig"), (2, "nowhere"), (3, None), (4, "plum plum")], "query_id long, text string")
    got = {}
    for r in search.top_k(docs, asks, 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.doc_id, r.score)
    held = {r.doc_id: search.words(r.text) for r in docs.filter("doc_id is not null").collect()}
    n, mean = len(held), sum(map(len, held.values())) / len(held)
    df = Counter(w for t in held.values() for w in set(t))
    for q, terms in ((1, ["apple", "fig"]), (4, ["plum"])):
        score = {}
        for i, t in held.items():
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in terms if w in t)
            if s:
                score[i] = round(s, 9)
        want = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [got[q][k][0] for k in sorted(got[q])] == [i for i, _ in want]
    assert 2 not in got and 3 not in got
    assert search.top_k(nothing(spark), asks).count() == 0


def brute(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
                links[i] += 1
                links[j] += 1
    return {i: (len(sets[i]), find(i), links[i]) for i in sets}


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (2, 70)])
def test_join_matches_brute_force(spark, n, percent, monkeypatch):
    import random

    rng = random.Random(n)
    rows, at = [], 0
    for size in (1, 2, 4, 9, 30, 31, 80, 200):
        base = [f"w{rng.randrange(500)}" for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9, 14):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            rows.append((at, " ".join(w).upper() if at % 3 else " ".join(w)))
            at += 1
    rows += [(900, None), (901, ""), (902, " \n "), (903, None)]
    monkeypatch.setattr(jaccard, "BLOCK", 3)  # so that groups take several blocks
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.linked(frame, n, percent).collect()}
    assert got == brute(rows, n, percent)


def test_join_of_awkward_rows(spark):
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard.linked(texts(spark)).collect())
    assert got == [(-1, -1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 1), (5, 1), (6, 6)]
    assert jaccard.linked(nothing(spark)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**32 - 1), st.sampled_from([70, 80, 90]))
def test_linked_sets_share_a_signature_and_have_close_sketches(size, seed, percent):
    rng = np.random.default_rng(seed)
    s = np.unique(rng.integers(0, 2**64, size, np.uint64))
    for _ in range(4):
        a = s[rng.random(len(s)) > rng.random() * 0.4]
        t = np.unique(np.concatenate([a, rng.integers(0, 2**64, int(rng.random() * 0.3 * len(s)), np.uint64)]))
        common = len(np.intersect1d(s, t))
        if not len(t) or 100 * common < percent * (len(s) + len(t) - common):
            continue
        bands = jaccard.Bands(percent)
        assert set(bands.signatures(s).tolist()) & set(bands.signatures(t).tolist())
        x, y = jaccard.fold([jaccard.sketch(s), jaccard.sketch(t)])
        assert np.bitwise_count(x ^ y).sum() <= len(s) + len(t) - 2 * common <= jaccard.allowed(len(s), len(t), percent)


def test_signatures_choose_two_of_three_subparts():
    s = np.unique(np.random.default_rng(2).integers(0, 2**64, 300, np.uint64))
    bands = jaccard.Bands(80)
    made = bands.signatures(s)
    assert len(jaccard._CHOICES) == 3 and all(len(c) == 2 for c in jaccard._CHOICES)
    changed = np.unique(np.append(s[1:], s[0] ^ np.uint64(1)))  # one subpart of one part differs in each band
    kept = np.isin(made, bands.signatures(changed)).sum()
    assert len(made) - kept == 4


def test_joined_rows_without_an_id_still_link(spark):
    words = " ".join(f"w{i}" for i in range(60))
    near = [words, words + " x", "y " + words + " x", " ".join(f"v{i}" for i in range(30))]
    frame = spark.createDataFrame([(5, near[0]), (None, near[1]), (9, near[2]), (9, near[3]), (4, near[3])], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.n_links) for r in jaccard.linked(frame, 5, 97).collect())
    assert got == [(-1, 57, 5, 2), (4, 26, 4, 1), (5, 56, 5, 1), (9, 26, 4, 1), (9, 58, 5, 1)]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in jaccard.components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and len(got) == 63


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    data = "/root/testdata/sf0.01"  # the smallest tables hold too few labels to fit on
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = c.settle(c.drop_toxic(spark, docs, data))
    assert kept.columns == docs.columns and 0.6 * docs.count() < kept.count() < docs.count()
    good = c.settle(c.drop_poor(spark, kept, data))
    assert good.columns == docs.columns and 0 < good.count() <= kept.count()
    single = c.settle(c.drop_near_copies(spark, good, data))
    rows = [(r.doc_id, r.text) for r in good.select("doc_id", "text").collect()]
    want = {i for i, (_, root, _) in brute(rows, 5, 80).items() if root == i}
    assert {r.doc_id for r in single.collect()} == want
    extra = spark.createDataFrame([(-1, "mail a.b@example.com or 10.0.0.1 now", "en", "s", 36), (-2, None, "en", "s", 0)], single.schema)
    masked = c.settle(c.mask_personal_data(spark, single.unionByName(extra), data))
    text = {r.doc_id: (r.text, r.n_chars) for r in masked.collect()}
    assert text[-1] == ("mail [EMAIL] or [IP] now", 24) and text[-2] == (None, 0) and len(text) == len(want) + 2
    packed = c.pack(spark, masked, data)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
    assert packed.select("doc_id").distinct().count() == len(text)
