"""Quality classifier: a byte-level convolutional network in numpy.

Filters run over every byte of a text. A chunk is 512 bytes, a new one begins every 256, and the last ends with the
text; each filter's largest response in a chunk gives that chunk's logit, and the mean, least and greatest logit of
all chunks give one probability. Only bytes are inputs.

Nulls and empty texts are scored as one chunk of zero bytes. Repeated rows get equal scores; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import scan

CHUNK, STEP = 512, 256
#: Bytes that are convolved at once; a multiple of STEP.
SPAN = 16_384


def _logistic(x, y, l2=1e-3, steps=60):
    """Weights and bias by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), l2 * len(x) * np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + keep, x.T @ (p - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Network:
    tables: np.ndarray  # width x 256 x filters: the filters over one-hot bytes
    bias: np.ndarray
    out: np.ndarray  # filters + 1: chunk logit
    join: np.ndarray | None = None  # 4: from mean, least and greatest chunk logit to the text's logit

    def peaks(self, raw: bytes) -> np.ndarray:
        """Each filter's largest response in each chunk."""
        width, _, filters = self.tables.shape
        data = np.frombuffer(raw, np.uint8)
        n = max(len(data), 1)
        blocks = []
        for at in range(0, n, SPAN):
            part = data[at : at + SPAN + width - 1]
            here = min(SPAN, n - at)
            if len(part) < here + width - 1:
                part = np.concatenate([part, np.zeros(here + width - 1 - len(part), np.uint8)])
            sums = self.tables[0].take(part[:here], axis=0)
            for k in range(1, width):
                sums += self.tables[k].take(part[k : k + here], axis=0)
            blocks.append(np.maximum.reduceat(sums, np.arange(0, here, STEP), axis=0))
        top = np.concatenate(blocks)
        return np.maximum(top[:-1], top[1:]) if len(top) > 1 else top

    def logits(self, raw: bytes) -> np.ndarray:
        return np.maximum(self.peaks(raw) + self.bias, 0) @ self.out[:-1] + self.out[-1]

    def summary(self, raw: bytes) -> list[float]:
        x = self.logits(raw)
        return [float(x.mean()), float(x.min()), float(x.max())]

    def score(self, raws: list[bytes]) -> np.ndarray:
        x = np.array([self.summary(r) for r in raws]).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(x @ self.join[:-1] + self.join[-1], -30, 30)))


def train(samples: list[tuple[str, int]], filters: int = 16, width: int = 4, epochs: int = 14, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on random chunks of three quarters of the samples, then the joining weights on whole texts of the rest."""
    rng = np.random.default_rng(seed)
    data = [((t or "").encode("utf-8", "replace"), y) for t, y in samples]
    fit, rest = [x for i, x in enumerate(data) if i % 4], [x for i, x in enumerate(data) if i % 4 == 0]
    if len({y for _, y in fit}) < 2 or len({y for _, y in rest}) < 2:
        share = (sum(y for _, y in data) + 1) / (len(data) + 2)
        net = Network(np.zeros((width, 256, filters), np.float32), np.zeros(filters, np.float32), np.zeros(filters + 1, np.float32))
        net.join = np.array([0, 0, 0, np.log(share / (1 - share))])
        return net
    params = {
        "t": rng.normal(0, 0.1, (width, 256, filters)).astype(np.float32),
        "b": np.zeros(filters, np.float32),
        "o": np.append(rng.normal(0, 0.3, filters), 0).astype(np.float32),
    }
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    labels = np.array([y for _, y in fit])
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(fit))
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            x = np.zeros((len(ids), CHUNK + width - 1), np.uint8)
            for r, i in enumerate(ids):
                raw = fit[i][0]
                a = int(rng.integers(0, max(1, len(raw) - CHUNK + 1)))
                part = np.frombuffer(raw[a : a + CHUNK + width - 1], np.uint8)
                x[r, : len(part)] = part
            sums = params["t"][0].take(x[:, :CHUNK], axis=0)
            for k in range(1, width):
                sums += params["t"][k].take(x[:, k : k + CHUNK], axis=0)
            where = sums.argmax(1)  # batch x filters
            top = np.take_along_axis(sums, where[:, None], 1)[:, 0] + params["b"]
            act = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ params["o"][:-1] + params["o"][-1], -30, 30)))
            d = (p - labels[ids]) * weight[ids] / len(ids)
            da = np.outer(d, params["o"][:-1]) * (top > 0)
            grads = {"t": np.zeros_like(params["t"]), "b": da.sum(0), "o": np.append(act.T @ d, d.sum())}
            rows, cols = np.arange(len(ids))[:, None], np.arange(filters)[None]
            for k in range(width):
                np.add.at(grads["t"][k], (x[rows, where + k], np.broadcast_to(cols, where.shape)), da)
            step += 1
            for k, g in grads.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net = Network(params["t"], params["b"], params["o"])
    net.join = _logistic(np.array([net.summary(raw) for raw, _ in rest]), np.array([y for _, y in rest], float))
    return net


def score_quality(documents: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and `score`, the probability of label 1."""

    def rows(keys, texts):
        return keys, net.score([(t or "").encode("utf-8", "replace") for t in texts]).tolist()

    return scan(documents, [id_col, text_col], f"`{id_col}` {dict(documents.dtypes)[id_col]}, score double", rows)
