"""Toxicity by compression distance between two zstandard dictionaries of words.

The ordinary dictionary holds the commonest words of ordinary text; the toxic one holds these and what the library's
trainer makes of the words that a log-odds test finds to be toxic. So it is a compression distance over selected words:
dictionaries trained on all words of either class tell the classes far worse (README).

A text is cut into windows of 32 words, each word written as a code of 16 bytes (the hash of its lower-case form
without outer punctuation), so that a whole known word is one match and an unknown one is incompressible. Each window
is compressed with either dictionary; how much shorter the toxic one makes it is the window's gain. The greatest gain,
the sum of those above a threshold and the number of windows give one calibrated probability. The dictionaries come
from one part of the labelled sample, the threshold and calibration from the other.

Nulls and empty texts have one empty window, so a defined score. Repeated rows get equal scores; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame

from .common import scan
from .quality import _logistic

WINDOW, WIDTH, LEVEL = 32, 16, 3
_OUTER = ".,;:!?#$%&*|\"'()[]{}<>-_"


class _Codes(dict):
    def __missing__(self, word: str) -> bytes:
        w = word.lower().strip(_OUTER)
        code = xxhash.xxh3_128_digest(w.encode("utf-8", "replace")) if w else b""
        if len(self) > 100_000:
            self.clear()
        self[word] = code
        return code


_codes = _Codes()


def encode(text: str | None) -> bytes:
    return b"".join(map(_codes.__getitem__, (text or "").split()))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: float = 2.0
    join: np.ndarray | None = None

    def __post_init__(self):
        self._pair = None

    def __getstate__(self):
        return {**self.__dict__, "_pair": None}

    def compressors(self):
        if self._pair is None:
            made = []
            for content in (self.ordinary, self.toxic):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
            self._pair = made
        return self._pair

    def gains(self, text: str | None) -> list[int]:
        a, b = self.compressors()
        data, size = encode(text), WINDOW * WIDTH
        return [len(a.compress(w)) - len(b.compress(w)) for i in range(0, max(1, len(data)), size) for w in [data[i : i + size]]]

    def features(self, text: str | None) -> list[float]:
        g = self.gains(text)
        over = sum(x for x in g if x > self.threshold)
        return [min(max(g), 40) / 10, math.log1p(max(over, 0)), math.log1p(max(over, 0)) * math.log(len(g) + 1), math.log(len(g) + 1)]

    def score(self, texts) -> list[float]:
        x = np.array([self.features(t) for t in texts]).reshape(-1, 4)
        return (1 / (1 + np.exp(-np.clip(x @ self.join[:-1] + self.join[-1], -30, 30)))).tolist()


def train(samples: list[tuple[str, int]], common: int = 600, least: int = 4, contrast: float = 2.2) -> Model:
    """Words that stand `contrast` nats more often (by documents) in toxic than in ordinary texts, and in `least` toxic
    ones, make the toxic samples; the ordinary dictionary has the most common other words."""
    fit, rest = [x for i, x in enumerate(samples) if i % 3], [x for i, x in enumerate(samples) if i % 3 == 0]
    seen, n = {0: Counter(), 1: Counter()}, Counter(y for _, y in fit)
    coded = [([c for w in (t or "").split() if (c := _codes[w])], y) for t, y in fit]
    for codes, y in coded:
        seen[y].update(set(codes))
    lift = lambda c: math.log((seen[1][c] + 0.5) / (n[1] + 1)) - math.log((seen[0][c] + 0.5) / (n[0] + 1))
    marks = {c for c, k in seen[1].items() if k >= least and lift(c) > contrast}
    ordinary = b"".join(c for c, _ in sorted(seen[0].items(), key=lambda x: (-x[1], x[0]))[:common][::-1] if c not in marks)
    spans = [b"".join(c for c in codes if c in marks) for codes, y in coded if y]
    try:
        learnt = zstandard.train_dictionary(max(1024, 2 * WIDTH * len(marks)), [s for s in spans if s], k=2 * WIDTH, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples for the trainer
        learnt = b""
    toxic = b"".join(sorted((c for c in marks if c not in learnt), key=lambda c: (seen[1][c], c)))
    model = Model(ordinary or b"\0" * WIDTH, (ordinary or b"\0" * WIDTH) + learnt + toxic)
    y = np.array([y for _, y in rest], float)
    if not marks or len(set(y.tolist())) < 2:
        share = (sum(y for _, y in samples) + 1) / (len(samples) + 2)
        model.join = np.array([0, 0, 0, 0, math.log(share / (1 - share))])
        return model
    clean = [max(model.gains(t)) for t, label in rest if not label]
    model.threshold = float(np.clip(np.quantile(clean, 0.8), 2, 6))
    model.join = _logistic(np.array([model.features(t) for t, _ in rest]), y)
    return model


def score_toxicity(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and `score`, the probability that it is toxic."""
    return scan(documents, [id_col, text_col], f"`{id_col}` {dict(documents.dtypes)[id_col]}, score double", lambda keys, texts: (keys, model.score(texts)))
