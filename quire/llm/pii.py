"""Personal data: patterns for the plain kinds, and bootstrapped contextual extraction for the others.

The plain kinds (email, ip, card, phone) are found by pattern and check. They are the seeds of the second part: the two
words before a seed are a lexical pattern, a token with digits in the same place is an instance. Spark scores the graph
of patterns and instances in rounds: a pattern is as good as the share of its instances that are held to be
identifiers, an instance as good as its patterns together make it. A pattern must also stand before identifiers most of
the times that its words occur anywhere in the corpus. Instances of patterns that keep a high score are the new spans,
of kind "context".

Nulls and empty texts give no spans. Offsets are code points, ends exclusive. Repeated rows repeat in the result and
count as often in the graph's occurrences, though once among a pattern's distinct instances; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Screen, scan, settle

KINDS = ("email", "ip", "card", "phone", "context")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9/_.#-]*[A-Za-z0-9]")
_WORD = re.compile(r"[^\W\d_]+")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping matches, looked for at each @ rather than at each letter."""
    past, at = 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > past and not _NOT_LOCAL.match(text, start - 1):
                start -= 1
            if start < at:
                past = m.end()
                yield "email", start, past
                at = text.find("@", past)
                continue
        at = text.find("@", at + 1)


def _addresses(text: str):
    """Leftmost non-overlapping matches of _IP whose parts are at most 255. A match begins with a run of digits, and if
    the run's first digit begins none, no other digit of it does; so each run is tried once."""
    past = 0
    for run in _DIGITS.finditer(text):
        if run.start() >= past and text[run.end() : run.end() + 1] == "." and (m := _IP.match(text, run.start())):
            past = m.end()
            # int() of a long run would raise: only its last three digits may be other than 0.
            if all(int(p[-3:]) <= 255 and not p[:-3].strip("0") for p in m[0].split(".")):
                yield "ip", m.start(), past


def find(text: str | None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the plain kinds, by kind, then start."""
    if not text:
        return []
    out = list(_emails(text))
    out += _addresses(text)
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []
    return out


class _Words:
    """The two words before a place in its line, lower-cased, whatever their length; each line is read once."""

    def __init__(self, text: str):
        self.text, self.lines = text, {}
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def before(self, start: int) -> str | None:
        n = bisect_left(self.breaks, start)
        if n not in self.lines:
            floor = self.breaks[n - 1] + 1 if n else 0
            self.lines[n] = [m.span() for m in _WORD.finditer(self.text, floor, self.breaks[n] if n < len(self.breaks) else len(self.text))]
        words = self.lines[n]
        n = bisect_left(words, (start,))  # words that begin before the place; the last may reach beyond it
        return " ".join(self.text[a : min(b, start)] for a, b in words[n - 2 : n]).lower() if n >= 2 else None


def _instances(text: str, spans) -> list[tuple[str, str, int, int, bool]]:
    """(pattern, instance, start, end, seed): the seeds, and tokens with at least four digits that no seed covers."""
    words = _Words(text)
    out = [(p, text[a:b].lower(), a, b, True) for _, a, b in spans if (p := words.before(a))]
    covered = sorted((a, b) for _, a, b in spans)
    reach = list(accumulate((b for _, b in covered), max))

    def meets(start: int, end: int) -> bool:
        n = bisect_left(covered, (end,))  # spans that begin before the end
        return n > 0 and reach[n - 1] > start

    past = 0
    for run in _DIGITS.finditer(text):
        if run.start() < past:
            continue
        lo = run.start()
        while lo > past and (text[lo - 1].isalnum() or text[lo - 1] in "/_.#-") and text[lo - 1].isascii():
            lo -= 1
        if not (m := _TOKEN.search(text, lo)) or m.start() > run.start():
            continue
        past = m.end()
        if sum(c.isdigit() for c in m[0]) >= 4 and not meets(m.start(), m.end()) and (p := words.before(m.start())):
            out.append((p, m[0].lower(), m.start(), m.end(), False))
    return out


def scan_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, least_seeds: int = 5, confident: float = 0.8) -> DataFrame:
    """One row per input row: its id and `found`, an array of (kind, start, end, value)."""
    kind = dict(documents.dtypes)[id_col]
    span = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"

    def rows(ids, texts):
        found, tokens = [], []
        for t in texts:
            spans = find(t)
            found.append([{"kind": k, "start": a, "end": b, "value": t[a:b]} for k, a, b in spans])
            tokens.append([{"pattern": p, "instance": v, "start": a, "end": b, "seed": s} for p, v, a, b, s in _instances(t, spans)] if t else [])
        return ids, found, tokens

    seen = "tokens array<struct<pattern:string,instance:string,start:bigint,end:bigint,seed:boolean>>"
    rows_ = scan(documents, [id_col, text_col], f"`{id_col}` {kind}, found {span}, {seen}", rows)
    base = settle(rows_.withColumn("_row", F.monotonically_increasing_id()))
    good = extract_patterns(documents, base, text_col, rounds, least_seeds, confident)
    if good is None:
        return base.select(id_col, "found")
    tokens = base.select("_row", F.inline("tokens")).filter("not seed").join(good.select("pattern"), "pattern")
    context = tokens.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(F.lit("context").alias("kind"), "start", "end", F.col("instance").alias("value")))).alias("more"))
    return base.join(context, "_row", "left").select(id_col, F.concat("found", F.coalesce("more", F.array().cast(span))).alias("found"))


def extract_patterns(documents: DataFrame, base: DataFrame, text_col: str, rounds: int, least_seeds: int, confident: float) -> DataFrame | None:
    """(pattern, score) of the patterns that discover identifiers, or None where no pattern has the seeds for it."""
    edges = base.select(F.inline("tokens")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    seeds = edges.groupBy("pattern").agg(F.count_if("seed").alias("seeds")).filter(F.col("seeds") >= least_seeds)
    edges = settle(edges.join(seeds, "pattern"))
    score = edges.withColumn("held", F.col("seed").cast("double"))
    for _ in range(rounds):
        patterns = score.groupBy("pattern").agg((F.sum("held") / (F.count("*") + 1)).alias("score"))
        # An instance is believed as far as its patterns do not all fail it; seeds stay certain.
        doubt = edges.join(patterns, "pattern").groupBy("instance").agg(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))).alias("doubt"), F.max("seed").alias("sure"))
        belief = doubt.select("instance", F.when(F.col("sure"), 1.0).otherwise(1 - F.exp("doubt")).alias("belief"))
        strong = F.when(F.col("belief") >= confident, F.col("belief")).otherwise(0.0)
        score = settle(edges.join(belief, "instance").select("pattern", "instance", "n", strong.alias("held")))
    patterns = score.groupBy("pattern").agg((F.sum("held") / (F.count("*") + 1)).alias("score"), F.sum("n").alias("hits")).filter(F.col("score") >= confident)
    patterns = settle(patterns)
    # How often the words of a pattern stand anywhere: texts are screened by a bit table of fixed size, then counted exactly.
    screen = Screen.of(patterns, "pattern")
    if not screen:
        return None
    held = documents.sparkSession.sparkContext.broadcast(screen)

    def occurrences(it):
        known = held.value
        for batch in it:
            count = Counter()
            for t in batch.column(0).to_pylist():
                for line in (t or "").split("\n"):
                    w = _WORD.findall(line.lower())
                    count.update(pair for pair in map(" ".join, zip(w, w[1:])) if known[pair])
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["pattern", "total"])

    total = documents.select(text_col).mapInArrow(occurrences, "pattern string, total long").groupBy("pattern").agg(F.sum("total").alias("total"))
    return patterns.join(total, "pattern").filter(F.col("hits") >= 0.5 * F.col("total")).select("pattern", "score")
