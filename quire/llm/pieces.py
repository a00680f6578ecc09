"""SentencePiece encoding and decoding through the tokenizers library.

The model file (a protobuf message) is parsed here; normaliser, metaspace marker, unigram scores or merge ranks, and
byte fallback are rebuilt as a tokenizer of that library. Texts are split where no piece of the vocabulary can reach
across (before a metaspace that follows another character), so each distinct word is encoded once in a worker, many
at a time on the library's threads. Every such word is also encoded by the SentencePiece library; where the two
differ, its ids are taken and the row's `repaired` counts it.

Nulls and empty texts have no ids and decode to the empty text. A text is whole, whatever its length. Repeated rows
repeat; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .common import scan

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
SPACE = "▁"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 0x7F) << shift
        at += 1
        if data[at - 1] < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message; values are ints or bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                n, at = _varint(data, at)
            elif kind in (1, 5):
                n = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind}")
            value, at = data[at : at + n], at + n
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    unk_id: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                m.pieces.append(piece.get(1, b"").decode())
                m.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                m.types.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                m.kind, m.byte_fallback, m.unk_id = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), spec.get(40, 0)
            elif number == 3:
                spec = dict(_fields(value))
                m.charsmap, m.dummy_prefix, m.trim_spaces = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        return m

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces whose join is a piece, by the join's score, best first."""
        known = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (NORMAL, USER_DEFINED, UNUSED)}
        found = []
        for p, i in known.items():
            for cut in range(1, len(p)):
                if p[:cut] in known and p[cut:] in known:
                    found.append((-self.scores[i], i, known[p[:cut]], known[p[cut:]], p[:cut], p[cut:]))
        return [x[4:] for x in sorted(found)]

    def tokenizer(self):
        """The model alone, over text that is normalised and marked."""
        from tokenizers import Tokenizer, models

        if self.kind == UNIGRAM:
            return Tokenizer(models.Unigram(list(zip(self.pieces, self.scores)), self.unk_id, self.byte_fallback))
        if self.kind == BPE:
            vocab = {p: i for i, p in enumerate(self.pieces)}
            return Tokenizer(models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unk_id], fuse_unk=True, byte_fallback=self.byte_fallback))
        raise ValueError(f"model type {self.kind}")

    def splits(self) -> bool:
        """Whether no piece holds a metaspace after another character."""
        return not any(SPACE in p.lstrip(SPACE) for p, t in zip(self.pieces, self.types) if t in (NORMAL, USER_DEFINED))


class Coder(dict):
    """word -> (ids as bytes, 1 if the libraries differed)."""

    MOST = 500_000

    def __init__(self, path: str):
        import sentencepiece
        from tokenizers import normalizers, pre_tokenizers

        with open(path, "rb") as f:
            raw = f.read()
        self.model = Model.parse(raw)
        self.charsmap = normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None
        self.backend = self.model.tokenizer()
        self.other = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.whole = not self.model.splits()
        self.lean, self.begins = None, np.array([p.startswith(SPACE) for p in self.model.pieces])
        if self.model.dummy_prefix and not (self.charsmap or self.model.trim_spaces or self.whole):
            self.lean = self.model.tokenizer()
            self.lean.pre_tokenizer = pre_tokenizers.Metaspace(SPACE, prepend_scheme="never", split=True)
        # Each piece's bytes, the metaspace as a blank.
        self.surface = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, t in zip(self.model.pieces, self.model.types)]

    def normalise(self, text: str) -> str:
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if self.model.trim_spaces:
            text = " ".join(x for x in text.split(" ") if x)
        return text

    def words(self, text: str | None) -> list[str]:
        text = self.normalise(text or "")
        if not text:
            return []
        if self.model.dummy_prefix:
            text = " " + text
        if self.whole or SPACE in text:
            return [text.replace(" ", SPACE)]
        # Each word has the blanks before it; blanks at the end are a word of their own.
        out, blanks = [], 0
        for w in text.split(" "):
            if w:
                out.append(SPACE * blanks + w)
                blanks = 1
            else:
                blanks += 1
        # split() gives one empty string before a leading blank, and one more than the blanks at the end.
        if text[-1] == " ":
            out.append(SPACE * (blanks - 1))
        return out

    def _apart(self, word: str) -> tuple[list[int], int]:
        """One word on its own. The other library adds its own prefix, so it gets the word without the first metaspace."""
        ids = self.backend.encode(word, add_special_tokens=False).ids
        if self.model.dummy_prefix and not (word[0] == SPACE and len(word) > 1):
            return ids, 0
        want = self.other.encode((word[1:] if self.model.dummy_prefix else word).replace(SPACE, " "))
        return (want, 1) if want != ids else (ids, 0)

    def learn(self, words: set[str]) -> None:
        plain = [w for w in words if w[0] == SPACE and w.count(SPACE) == 1 and len(w) > 1] if self.lean else []
        for at in range(0, len(plain), 20_000):
            # Many words as one text for either library; a piece that begins with the metaspace begins a word.
            part = plain[at : at + 20_000]
            step = [part[i : i + 2_000] for i in range(0, len(part), 2_000)]
            ids = [np.asarray(x.ids, np.uint32) for x in self.lean.encode_batch_fast(["".join(x) for x in step], add_special_tokens=False)]
            want = self.other.encode(["".join(x)[1:].replace(SPACE, " ") for x in step], num_threads=1)
            for group, x, y in zip(step, ids, want):
                cuts = np.flatnonzero(self.begins[x])
                if len(cuts) == len(group) and np.array_equal(x, np.asarray(y, np.uint32)):
                    self.update((w, (i.tobytes(), 0)) for w, i in zip(group, np.split(x, cuts[1:])))
        for w in words:
            if w not in self:
                ids, differ = self._apart(w)
                self[w] = np.asarray(ids, np.uint32).tobytes(), differ

    def encode(self, texts) -> list[tuple[bytes, int]]:
        if len(self) > self.MOST:  # the words met first are the most common
            early = list(islice(self.items(), self.MOST // 3))
            self.clear()
            self.update(early)
        split = [self.words(t) for t in texts]
        unseen = set().union(*split) - self.keys()
        if unseen:
            self.learn(unseen)
        got = [[self[w] for w in words] for words in split]
        return [(b"".join(ids for ids, _ in x), sum(d for _, d in x)) for x in got]

    def decode(self, ids) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


_coders: dict[str, Coder] = {}


def coder(path: str, threads: int | None = None) -> Coder:
    """The worker's coder. Threads are the library's for the whole process, so the first use fixes them."""
    if path not in _coders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        if threads:
            os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ.setdefault("RAYON_NUM_THREADS", os.environ.get("OMP_NUM_THREADS", "1"))
        _coders[path] = Coder(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return _coders[path]


def encode(documents: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", threads: int | None = None) -> DataFrame:
    """Id, `ids` (array), `repaired` (words on which the libraries differ) and `exact` (decoding gives the normalised text back).

    Batches of words are encoded on `threads` threads, by default as many as a task has cores (spark.task.cpus)."""

    def rows(keys, texts):
        c = coder(model, threads)
        ids, repaired, exact = [], [], []
        for at in range(0, len(texts), 128):
            part = texts[at : at + 128]
            for t, (raw, n) in zip(part, c.encode(part)):
                x = np.frombuffer(raw, np.uint32)
                ids.append(x.astype(np.int32))
                repaired.append(n)
                exact.append(c.decode(x.tolist()) == c.normalise(t or ""))
        return keys, ids, repaired, exact

    return scan(documents, [id_col, text_col], f"`{id_col}` {dict(documents.dtypes)[id_col]}, ids array<int>, repaired bigint, exact boolean", rows)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Id and `text`; null ids decode to the empty text."""
    return scan(encoded, [id_col, ids_col], f"`{id_col}` {dict(encoded.dtypes)[id_col]}, text string", lambda keys, ids: (keys, [coder(model).decode(x or []) for x in ids]))
