"""Classifiers on held-out rows, tokenizers by round trip, packing by its limits."""

import random

import numpy as np
import pytest
from llm.helpers import LONG, nothing, texts
from pyspark.sql import functions as F
from quire.llm import packing, pieces, quality, toxicity

P = pytest.importorskip("public_tokenizers")


def samples(seed, n=400):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("rstln") for _ in range(rng.randint(1, 3)))
    good = [" ".join(word() for _ in range(rng.randint(5, 200))) for _ in range(n)]
    return good, rng


def test_network_tells_junk_from_text():
    good, rng = samples(1)
    bad = [" ".join(w + "###" for w in t.split()) for t in samples(2)[0][:120]]
    data = [(t, 1) for t in good] + [(t, 0) for t in bad]
    rng.shuffle(data)
    net = quality.train(data[:400])
    score = net.score([t.encode() for t, _ in data[400:]])
    assert np.mean((score >= 0.5) == np.array([y for _, y in data[400:]])) > 0.95
    assert 0 <= net.score([b""])[0] <= 1


def test_chunks_cover_the_whole_text():
    rng = np.random.default_rng(0)
    net = quality.Network(rng.normal(size=(4, 256, 3)).astype(np.float32), np.zeros(3, np.float32), np.ones(4, np.float32))
    for n in (0, 1, 255, 256, 257, 512, 1000, 16_384, 16_385, 40_000):
        raw = rng.integers(0, 256, n, np.uint8)
        x = np.concatenate([raw, np.zeros(4 + (n == 0), np.uint8)])
        every = np.stack([sum(net.tables[k][x[i + k]] for k in range(4)) for i in range(max(n, 1))])
        starts = range(0, max(1, len(every) - quality.STEP), quality.STEP)
        want = np.stack([every[a : a + quality.CHUNK].max(0) for a in starts])
        assert np.allclose(net.peaks(raw.tobytes()), want, atol=1e-5)


def test_dictionaries_tell_toxic_text():
    good, rng = samples(3, 600)
    insults = ["blockhead", "numbskull", "dimwit", "nitwit", "fathead"]
    bad = []
    for t in samples(4, 200)[0]:
        w = t.split()
        for _ in range(3):
            w.insert(rng.randrange(len(w) + 1), rng.choice(insults))
        bad.append(" ".join(w))
    data = [(t, 0) for t in good] + [(t, 1) for t in bad]
    rng.shuffle(data)
    model = toxicity.train(data[:600])
    score = np.array(model.score([t for t, _ in data[600:]]))
    assert np.mean((score >= 0.5) == np.array([y for _, y in data[600:]])) > 0.95
    assert 0 <= model.score([None])[0] <= 1 and model.score(["a"]) == model.score(["a"])


def test_one_class_gives_a_constant():
    assert 0 <= quality.train([("a", 1)] * 8).score([b"x"])[0] <= 1
    assert 0 <= toxicity.train([("a", 0)] * 9).score(["x"])[0] <= 1
    assert 0 <= toxicity.train([]).score([""])[0] <= 1


def test_scores_of_awkward_rows(spark):
    good, _ = samples(5, 60)
    net, model = quality.train([(t, i % 2) for i, t in enumerate(good)]), toxicity.train([(t, i % 2) for i, t in enumerate(good)])
    for out in (quality.score_quality(texts(spark), net), toxicity.score_toxicity(texts(spark), model)):
        rows = out.collect()
        assert len(rows) == texts(spark).count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.score_quality(nothing(spark), net).count() == toxicity.score_toxicity(nothing(spark), model).count() == 0


def test_word_path_gives_the_tokenizer_s_ids():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    full, lean = Tokenizer.from_file(path), packing.Words(path)
    rng = random.Random(6)
    odd = ["", " ", "don't DON'T 's", "ΟΔΟΣ Σσς", "é é", "İIı", "ﬁ 　x y", "a\x1cb\x85c", "<|endoftext|>x", "😀!?.. 12.5%"]
    odd += ["".join(rng.choice(" abÉß'.,1#\n日Σ") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for t, got in zip(odd, lean.encode(odd)):
        assert np.frombuffer(got, np.uint32).tolist() == full.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("limits", [(100, 5, 100), (100, 100, 60), (100, 3, 40)])
def test_bins_keep_every_limit(limits):
    rng = np.random.default_rng(7)
    size = rng.integers(1, 40, 500)
    demand = np.stack([size, np.ones(500, int), rng.integers(0, size + 1)], 1)
    bins = packing.fill(demand, np.array(limits))
    used = np.stack([np.bincount(bins, demand[:, i]) for i in range(3)], 1)
    assert (used <= np.array(limits)).all() and len(bins) == 500
    least = max(-(-int(demand[:, i].sum()) // limits[i]) for i in range(3))
    assert used.shape[0] <= 1.15 * least + 1


def test_packing_of_awkward_rows(spark):
    cut = packing.pieces(texts(spark), P.path("word_bpe_49k.json"))
    rows = packing.pack(cut).collect()
    assert sum(r.length for r in rows if r.doc_id == 2) == 1 and sum(r.length for r in rows if r.doc_id == 4) == next(r.doc_tokens for r in rows if r.doc_id == 4)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    assert packing.pack(packing.pieces(nothing(spark), P.path("word_bpe_49k.json"))).count() == 0


def test_instruction_data_keeps_its_loss_limit(spark):
    cut = spark.createDataFrame([(i, 0, 100 + i % 50, 40 + i % 30) for i in range(300)], "conv_id long, start long, length long, loss long")
    out = packing.pack(cut, "conv_id", 1024, 8, 300, "loss").groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.sum("loss").alias("l")).collect()
    assert all(r.n <= 1024 and r.k <= 8 and r.l <= 300 for r in out)


def test_sentencepiece_parity_and_round_trip():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    ours, theirs = pieces.Coder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(8)
    odd = ["", " ", "  ", "a", " a", "a ", "  a  b   ", "▁x", "日本語 текст", "😀 é", " \n ", "<s> </s> <unk> <0x41>", LONG]
    odd += ["".join(rng.choice(" ab\n1éß.😀") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for t, (raw, _) in zip(odd, ours.encode(odd)):
        ids = np.frombuffer(raw, np.uint32).tolist()
        assert ids == theirs.encode(t), t
        assert ours.decode(ids) == theirs.decode(ids)
        if "▁" not in t:
            assert ours.decode(ids) == t


def test_unigram_model_is_rebuilt():
    """A small unigram message written by hand: pieces with scores, byte fallback, dummy prefix."""
    import struct

    def field(n, value):
        if isinstance(value, bytes):
            return bytes([n << 3 | 2]) + bytes([len(value)]) + value
        return bytes([n << 3 | 5]) + struct.pack("<f", value) if isinstance(value, float) else bytes([n << 3]) + bytes([value])

    def piece(text, score, kind):
        return field(1, field(1, text.encode()) + field(2, score) + field(3, kind))

    raw = piece("<unk>", 0.0, 2) + b"".join(piece(f"<0x{i:02X}>", 0.0, 6) for i in range(256))
    raw += b"".join(piece(p, s, 1) for p, s in (("▁", -2.0), ("▁ab", -1.0), ("c", -3.0), ("a", -4.0), ("b", -4.0)))
    spec = field(3, 1) + bytes([35 << 3 & 0x7F | 0x80, 35 << 3 >> 7]) + b"\x01"
    raw += bytes([2 << 3 | 2, len(spec)]) + spec
    m = pieces.Model.parse(raw)
    assert m.kind == pieces.UNIGRAM and m.byte_fallback and m.dummy_prefix
    t = m.tokenizer()
    assert [m.pieces[i] for i in t.encode("▁abc").ids] == ["▁ab", "c"]
    assert [m.pieces[i] for i in t.encode("▁é").ids] == ["▁", "<0xC3>", "<0xA9>"]


def test_coding_of_awkward_rows(spark):
    path = P.path("piece_bpe_32k.model")
    coded = pieces.encode(texts(spark), path)
    rows = coded.collect()
    assert all(r.exact and r.repaired == 0 for r in rows) and [r.ids for r in rows if r.doc_id in (2, 3)] == [[], []]
    back = pieces.decode(coded, path).collect()
    assert {r.text for r in back if r.doc_id == 4} == {LONG}
    assert pieces.encode(nothing(spark), path).count() == 0
