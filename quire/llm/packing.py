"""Packing of tokenised texts into sequences: vector bin packing by the dot-product heuristic.

A text is cut only where it fills whole sequences; what is left is one piece shorter than a sequence. Pieces are
dealt by hash into groups whose expected size is bounded, and each group is packed on its own: the next piece of
a sequence is the one whose demand (tokens, one segment, loss-bearing tokens) has the largest dot product with
the room that is left, among those that fit in every dimension.

Nulls and empty texts are one piece that holds only the end id. Repeated rows are packed once each; ids that are
null are packed like any other. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scan

END_ID = 1
SEQUENCE, SEGMENTS = 2048, 256
#: Expected pieces of a group; texts whose new words are learnt together.
GROUP, STEP = 2048, 512

#: Characters on which the tokenizer's and Python's ideas of white space may differ; a text with one is encoded whole.
_ODD = re.compile("[\x1c-\x1f\x85\u1680\u180e\u200b\u2060\ufeff\x00]")
#: Characters that normalisation may change, or that are digits to the one and letters to the other.
_FAR = re.compile("[²³¹¼½¾\u0250-\U0010ffff]")
#: Fixed value: what the tokenizer never reads across, in lower-case text.
_RUN = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class Words(dict):
    """The ids, as bytes, of each run of letters, digit or run of other characters in lower case, between which the
    tokenizer never reads; and of words with characters beyond the Latin letters, as they stand."""

    #: Most runs that are remembered; when there are more, the first ones stay, which are the most common.
    MOST = 400_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.lean = Tokenizer.from_file(path)
        self.lean.normalizer = normalizers.Sequence([])
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # A special token that stands in a text is one token.
        special = [re.escape(t.content) for t in self.full.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([_ODD.pattern, *special]), re.I)
        self.ends = np.zeros(self.full.get_vocab_size(), bool)
        for token, i in self.full.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def whole(self, text: str) -> bytes:
        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def learn(self, runs: set[str]) -> None:
        """Encode many runs at once, as the words of one text."""
        plain = []
        for x in runs:
            if _FAR.search(x):
                self[x] = self.whole(x)
            else:
                plain.append(x)
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            ids = np.asarray(self.lean.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(ends) != len(part):  # not one end for each run: take the plain way
                self.update((x, self.whole(x)) for x in part)
            else:
                raw = ids.tobytes()
                self.update((x, raw[a:b]) for x, a, b in zip(part, [0, *ends], ends))

    @staticmethod
    def runs(text: str) -> list[str]:
        low = text.lower()
        if not _FAR.search(low):
            return _RUN.findall(low)
        out = []
        for w in text.split():
            if _FAR.search(low := w.lower()):
                out.append(w if _FAR.search(w) else low)
            else:
                out += _RUN.findall(low)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self) > self.MOST:
            early = list(islice(self.items(), self.MOST // 2))
            self.clear()
            self.update(early)
        split = [None if t and self.odd.search(t) else self.runs(t or "") for t in texts]
        if unseen := set(chain.from_iterable(x for x in split if x)).difference(self):
            self.learn(unseen)
        get = self.__getitem__
        return [b"".join(map(get, runs)) if runs is not None else self.whole(t) for runs, t in zip(split, texts)]


_words: dict[str, Words] = {}


def words_of(path: str) -> Words:
    if path not in _words:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _words[path] = Words(path)
    return _words[path]


def pieces(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE) -> DataFrame:
    """Per text: its ids (with END_ID after them) counted and cut; each piece has start, length and the checksum of its ids."""

    def rows(keys, texts):
        coder, end = words_of(tokenizer), np.uint32(END_ID).tobytes()
        totals, cut = [], []
        for at in range(0, len(texts), STEP):
            for ids in coder.encode(texts[at : at + STEP]):
                ids = memoryview(ids + end)
                totals.append(len(ids) // 4)
                cut.append([{"start": a // 4, "length": len(x) // 4, "ids_crc32": zlib.crc32(x)} for a in range(0, len(ids), 4 * length) for x in [ids[a : a + 4 * length]]])
        return keys, totals, cut

    kind = dict(documents.dtypes)[id_col]
    out = scan(documents, [id_col, text_col], f"`{id_col}` {kind}, doc_tokens bigint, cut array<struct<start:bigint,length:bigint,ids_crc32:bigint>>", rows)
    return out.select(id_col, "doc_tokens", F.inline("cut"))


def fill(demand: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The bin of each row of `demand`; `room` is the capacity of a bin in each dimension. Rows must each fit a bin.

    Demands are scaled by capacity, so that no dimension counts more for its unit. Equal rows are placed in order.
    """
    kinds, kind_of = np.unique(demand, axis=0, return_inverse=True)
    kind_of = kind_of.reshape(-1)
    order = np.argsort(kind_of, kind="stable")
    left = np.bincount(kind_of, minlength=len(kinds))
    first = np.concatenate(([0], np.cumsum(left)[:-1])) if len(kinds) else left
    used = np.zeros(len(kinds), np.int64)
    bins, scaled = np.empty(len(demand), np.int64), kinds / room
    current, todo = -1, len(demand)
    free = np.zeros(len(room))
    while todo:
        fits = (left > 0) & (kinds <= free).all(1) if current >= 0 else np.zeros(len(kinds), bool)
        if not fits.any():
            current, free = current + 1, room.astype(float).copy()
            fits = left > 0
        score = np.where(fits, scaled @ (free / room), -1.0)
        k = int(score.argmax())
        bins[order[first[k] + used[k]]] = current
        used[k] += 1
        left[k] -= 1
        todo -= 1
        free -= kinds[k]
    return bins


def pack(cut: DataFrame, id_col: str = "doc_id", length: int = SEQUENCE, segments: int = SEGMENTS, loss_tokens: int | None = None, loss_col: str | None = None, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to pieces (columns id_col, start, length, ...).

    `segments` and `loss_tokens` (default: `length`) limit the pieces and the loss-bearing tokens of a sequence;
    `loss_col` holds a piece's loss-bearing tokens, all of them where it is None. A piece beyond any limit on its own
    raises an error.
    """
    loss = F.col(loss_col) if loss_col else F.col("length")
    n = max(1, -(-cut.count() // group))
    room = np.array([length, segments, loss_tokens or length])
    dealt = cut.withColumn("_loss", loss.cast("long")).withColumn("_group", F.pmod(F.xxhash64(F.col(id_col), F.col("start")), F.lit(n)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([id_col, "start", "ids_crc32"] if "ids_crc32" in pdf else [id_col, "start"], kind="stable", ignore_index=True)
        # Pieces that fill a sequence need no choice.
        full = (pdf["length"] == length).to_numpy()
        demand = np.stack([pdf["length"].to_numpy(), np.ones(len(pdf), np.int64), pdf["_loss"].to_numpy()], axis=1)
        if (demand > room).any():
            raise ValueError(f"a piece exceeds the limits {room.tolist()}")
        placed = np.empty(len(pdf), np.int64)
        placed[~full] = fill(demand[~full], room)
        placed[full] = np.arange(full.sum()) + (placed[~full].max() + 1 if not full.all() else 0)
        pdf["sequence_id"] = (pdf["_group"].iloc[0].astype("int64") << 32) + placed
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf.drop(columns=["_loss", "_group"])

    names = [f"`{c}` {t}" for c, t in cut.dtypes]
    return dealt.groupBy("_group").applyInPandas(one, ", ".join([*names, "sequence_id bigint", "offset bigint"]))
