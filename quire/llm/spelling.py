"""Spelling variants grouped by reduced-alphabet generation.

Words are runs of Latin letters, counted over all documents. Each letter is hashed to one of a few symbols, which makes a
reduced word of each word. Two words within one edit have reduced words within one edit, so every word generates the
full one-edit neighbourhood of its reduced word, itself included (as numbers: a polynomial hash is changed by each edit
in one step), and Spark joins that with the reduced vocabulary. A table of bits of fixed size, read in the generating
task, stops most of the neighbours that no word has; the join decides. Pairs are then verified on the original words. A
word's form is its commonest near word, if that is common enough; forms are followed to the root.

Every run whose hash with its document's id is divisible by `every` is counted with one letter taken out: planted slips.

Null and empty texts have no words; a null id is hashed as an empty text. Repeated rows count again. Words of any length
are handled: what a word generates grows with its length only. Ties between equally common near words go to the smallest
in code-point order. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, settle

#: Symbols of the reduced alphabet.
SYMBOLS = 8
#: Words counted in a task before their counts are handed on.
HELD = 200_000
#: Places of letters handled in one step of the generation.
CELLS = 1 << 18

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Every letter of a word is one byte in Latin-1.
_SYMBOL = np.array([zlib.crc32(bytes([c])) % SYMBOLS + 1 for c in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def slip(doc_id, word: str, every: int) -> str:
    """The lower-cased run as it is counted in that document."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, every: int = 31) -> DataFrame:
    """(word, n): the words of at least `least` letters and how often they occur."""
    run = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")

    def made(total):
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def batches(it):
        total = Counter()
        for batch in it:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                for w, n in Counter(run.findall(t.as_py() or "")).items():
                    w = slip(i, w.lower() if w.isascii() else w.translate(_LOWER), every)
                    if len(w) >= least:
                        total[w] += n
                if len(total) > HELD:
                    yield made(total)
                    total.clear()
        yield made(total)

    return documents.select(id_col, text_col).mapInArrow(batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _powers(n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, np.uint64(_BASE))
    out[0] = 1
    return np.multiply.accumulate(out)


def _by_length(words: list[str]):
    """(places, symbols as a matrix) of the words of each length, in portions of bounded size."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(part):
            long = int(lengths[part[0]])
            step = max(1, CELLS // max(1, long))
            for at in range(0, len(part), step):
                some = part[at : at + step]
                letters = np.frombuffer("".join(words[i] for i in some).encode("latin-1"), np.uint8).reshape(len(some), long)
                yield some, _SYMBOL[letters]


def keys(words: list[str]) -> np.ndarray:
    """The hash of each word's reduced word."""
    out = np.zeros(len(words), np.uint64)
    for some, symbols in _by_length(words):
        out[some] = symbols @ _powers(symbols.shape[1])
    return out


class Bits:
    """Which hashes the reduced vocabulary may have: one bit for each, in a table of fixed size."""

    BITS = 26

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def place(hashes: np.ndarray) -> np.ndarray:
        return (hashes * _MIX) >> np.uint64(64 - Bits.BITS)

    @classmethod
    def of(cls, places: DataFrame) -> Bits:
        """From (place); the driver sees at most 2^20 numbers."""
        marks = places.groupBy(F.expr("cast(place div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("m")).toArrow()
        words = np.zeros(1 << (cls.BITS - 6), np.int64)
        words[marks["w"].to_numpy()] = marks["m"].to_numpy()
        return cls(words.view(np.uint64))

    def __getitem__(self, hashes: np.ndarray) -> np.ndarray:
        at = self.place(hashes)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def neighbourhood(symbols: np.ndarray):
    """Hashes of every string within one edit of the reduced words (a row each), as matrices of one row for each word."""
    long = symbols.shape[1]
    power = _powers(long + 2)
    head = np.zeros((len(symbols), long + 1), np.uint64)
    np.cumsum(symbols * power[:long], axis=1, out=head[:, 1:])
    whole = head[:, -1:]
    yield head[:, :-1] + (whole - head[:, 1:]) * _BACK
    for q in range(1, SYMBOLS + 1):
        yield whole + (np.uint64(q) - symbols) * power[:long]
        yield head + np.uint64(q) * power[: long + 1] + (whole - head) * power[1]


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other, other_n): both ways, the pairs of words of (word, n) that differ by exactly one edit."""
    spark = words.sparkSession

    def with_key(it):
        for batch in it:
            key = keys(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64)), pa.array(Bits.place(key).astype(np.int64))], names=["word", "n", "key", "place"])

    reduced = words.select("word", "n").mapInArrow(with_key, "word string, n long, key long, place long")
    held = spark.sparkContext.broadcast(Bits.of(reduced.select("place")))

    def generate(it):
        known = held.value
        for batch in it:
            for some, symbols in _by_length(batch.column(0).to_pylist()):
                rows, found = [], []
                for hashes in neighbourhood(symbols):
                    r, c = np.nonzero(known[hashes])
                    rows.append(r)
                    found.append(hashes[r, c])
                met = np.unique(np.rec.fromarrays([np.concatenate(rows), np.concatenate(found)], names="row,key"))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some[met["row"]])), pa.array(met["key"].view(np.int64))], names=["word", "key"])

    made = words.select("word").mapInArrow(generate, "word string, key long")
    pairs = made.join(reduced.select("key", F.col("word").alias("other"), F.col("n").alias("other_n")), "key")
    return pairs.filter((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)).select("word", "other", "other_n")


def group_variants(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = 7, least_n: int = 2, times: int = 10, every: int = 31) -> DataFrame:
    """One row per word of at least `least` letters and `least_n` occurrences: word, n, n_near (its near words), form
    (its commonest near word, if that occurs at least `times` as often), form_n and root."""
    words = settle(count_words(documents, id_col, text_col, least, every).filter(F.col("n") >= least_n))
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    common = -F.col("best.less") >= times * F.col("n")
    held = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("best.other")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n")
    )
    held = settle(held)
    forms = settle(held.filter("form is not null").select("word", F.col("form").alias("root")))
    # Each step of forms is at least `times` as common, so chains are short; each round doubles what a root has passed.
    while True:
        to = forms.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = settle(forms.join(to, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        drop_settled(forms)
        forms = moved
        if not moved.filter("moved").limit(1).count():
            break
    drop_settled(words)
    return held.join(forms.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
