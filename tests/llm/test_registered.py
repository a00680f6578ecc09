"""The registered queries with their own parameters over the whole given tables, against brute force."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from llm.test_joins import brute
from llm.test_scans import plain_pii, plain_secrets
from quire.llm import licences, pii, queries, secrets

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def documents(spark, data):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]


def answer(spark, data, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, data).collect()}


@pytest.mark.parametrize("name,plain,kinds,keyed", [("op2_secrets", plain_secrets, secrets.KINDS[:3], lambda k, s: (s, k)), ("op8_pii", plain_pii, pii.KINDS[:4], lambda k, s: (k, s))])
def test_base_spans(spark, data, documents, name, plain, kinds, keyed):
    got = answer(spark, data, name)
    assert len(got) == len(documents)
    for i, t in documents:
        spans = sorted(plain(t), key=lambda x: keyed(kinds.index(x[0]), x[1]))
        listed = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert got[i].base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(x[0] == k for x in spans) for k in kinds]
        every = got[i].spans.split(",") if got[i].spans else []
        assert [x for x in every if x.split(":")[0] in kinds] == listed


def test_pieces_are_the_tokenizers(spark, data, documents):
    from tokenizers import Tokenizer

    full, by, sequences = Tokenizer.from_file(P.path("word_bpe_49k.json")), {}, {}
    for r in queries.op6_packing(spark, data).collect():
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    total = 0
    for i, t in documents:
        ids, at = np.array([*full.encode(t, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
        total += at
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))] and sum(r.length for r in rows) <= 2048
    assert len(sequences) <= 1.05 * total / 2048 + 1


@pytest.mark.parametrize("name,n,rest,least", [("op7_quality", 4, 2, 0.7), ("op9_toxicity", 5, 0, 0.5)])
def test_scores_follow_the_contract(spark, data, documents, name, n, rest, least):
    got = answer(spark, data, name)
    assert len(got) == len(documents)
    for i, _ in documents:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % n == rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= least)


def test_components(spark, data, documents):
    want = brute(documents, 3, 90)
    assert {i: (r.n_shingles, r.component_id) for i, r in answer(spark, data, "op10_jaccard").items()} == {i: x[:2] for i, x in want.items()}


def test_neighbours(spark, data):
    held = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    ids = np.array(sorted(held))
    e = np.stack([held[i] for i in ids])
    e /= np.linalg.norm(e, axis=1)[:, None]
    got = {}
    for r in queries.op1_neighbours(spark, data).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    asked = [i for i in ids.tolist() if i % 50 == 0]
    assert sorted(got) == asked
    found = 0
    for q in asked:
        s = e @ e[np.searchsorted(ids, q)]
        s[np.searchsorted(ids, q)] = -2
        found += len({i for i, _ in got[q].values()} & set(ids[np.argsort(-s, kind="stable")[:5]].tolist()))
        assert sorted(got[q]) == [1, 2, 3, 4, 5] and all(math.isclose(x, s[np.searchsorted(ids, i)], abs_tol=1e-12) for i, x in got[q].values())
    assert found >= 0.98 * 5 * len(asked)


def test_libraries_agree_on_every_document(spark, data, documents):
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = answer(spark, data, "op3_sentencepiece")
    assert len(got) == len(documents)
    for i, t in documents:
        assert got[i].repaired == 0 and got[i].exact and got[i].n_ids == len(theirs.encode(t))


def plain_licences(text):
    """Confirmed (line, family) of a text, line by line and run by run."""
    classes, weights, bias = licences.model()
    families, found = classes[:-1], []
    threes = lambda w: {" ".join(w[k : k + 3]) for k in range(len(w) - 2)}

    def judge(p, whole):
        if not re.search(licences._ANCHOR, p):
            return None
        w = licences.words(p)
        z = bias + sum((weights[g] for g in licences.ngrams(w) if g in weights), np.zeros(len(classes)))
        likely = classes[int(z.argmax())] if 1 / np.exp(z - z.max()).sum() >= 0.6 else licences.UNKNOWN
        form = threes if whole else set
        share = [max(len(form(w) & form(licences.words(s))) / max(1, len(form(licences.words(s)))) for s in licences.forms()[f]) for f in families]
        if whole and max(share) >= 0.7:
            likely = families[share.index(max(share))]
        return likely if likely != licences.UNKNOWN and share[families.index(likely)] >= 0.7 else None

    run = []
    for k, line in [*enumerate(text.split("\n")), (-1, "")]:
        if re.fullmatch(r"[ \t\n\x0b\f\r]*", line):
            alone = [(j, f) for j, x in run if (f := judge(x, False))]
            found += alone
            if len(run) > 1 and (f := judge(" ".join(x for _, x in run), True)) and f not in {f for _, f in alone}:
                found.append((run[0][0], f))
            run = []
        else:
            run.append((k, line))
    return sorted(found)


def test_licences(spark, data, documents):
    got = answer(spark, data, "op5_licences")
    want = {i: plain_licences(t) for i, t in documents}
    assert any(want.values())
    for i, x in want.items():
        assert (got[i].n_licences, got[i].places, got[i].families) == (len(x), ",".join(f"{k}:{f}" for k, f in x), ",".join(sorted({f for _, f in x})))


def test_licences_of_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "Licensed under the MIT license."), (1, "Released under the MIT License."), (1, "x\nLicensed under CC BY 4.0."), (2, None), (None, "nothing"), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id or 0, r.n_licences, r.families, r.places) for r in queries.op5_licences(spark, str(tmp_path)).collect())
    assert got == [(0, 0, "", ""), (0, 1, "mit", "0:mit"), (1, 1, "cc-by", "1:cc-by"), (1, 1, "mit", "0:mit"), (2, 0, "", ""), (3, 0, "", "")]


def test_held_out_licence_sentences(spark):
    """Sentences that the fit has not seen: families are told, and other licences and prose are unknown."""
    fitted = {s for ss in licences.forms().values() for s in ss} | {*licences.OTHERS, *licences.FOREIGN}
    held = [(s, f) for f, ss in licences.HELD.items() for s in ss]
    assert not fitted & {s for s, _ in held}
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(held)], "doc_id long, text string")
    got = {r.doc_id: r.family for r in licences.scan_licences(df).collect()}
    right = [got.get(i, licences.UNKNOWN) == f for i, (_, f) in enumerate(held)]
    told = [got.get(i, licences.UNKNOWN) for i, (_, f) in enumerate(held) if f == licences.UNKNOWN]
    assert sum(right) >= 0.85 * len(held) and sum(x != licences.UNKNOWN for x in told) <= 1


def test_threads_do_not_change_ids(spark, data):
    from quire.llm import pieces

    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40)
    model = P.path("piece_bpe_32k.model")
    one, two = ({r.doc_id: list(r.ids) for r in pieces.encode(docs, model, threads=n).collect()} for n in (1, 2))
    assert one == two and len(one) == 40
