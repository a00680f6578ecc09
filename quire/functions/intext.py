"""In-text citations as print writes them: (see Smith et al. 2018a, 2018b; Lee and Wu 2020) or Fitch's (2000) model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import c, normalise_key

#: Words that may open a citation and name nobody.
OPENERS = ("adapted from", "summarised in", "reviewed in", "from", "see", "e.g.", "cf.", "source", "in")
#: Lower-case words that stand within a name.
PARTICLES = ("de", "del", "den", "der", "da", "di", "la", "le", "van", "von", "&", "and", "et al", "et al.")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

_YEAR = r"\b(?:19|20)[0-9]{2}[a-z]?\b"
_YEARS = rf"{_YEAR}(?:, *{_YEAR})*"
_CAPITAL = r"\p{Lu}[\p{L}’'-]*+"
_WORD = "(?:" + "|".join([_CAPITAL, *(p.replace(".", r"\.") for p in sorted(PARTICLES, key=len, reverse=True))]) + ")"
_NAME = rf"{_WORD}(?: {_WORD})*+"
# The name right before a bracket: one or two capitalised words. Every part is possessive, so a long text takes linear time.
_BEFORE = rf"{_CAPITAL}(?: (?:&|and) {_CAPITAL})?(?: et al\.?)?"
_BRACKET = rf"(?:(?<![\p{{L}}’'-]){_BEFORE}\s*+)?(?:\[[^()\[\]]*+\]|\([^()\[\]]*+\))"
_OPENER = r"^(?i:see table [0-9]+ in|" + "|".join(o.replace(".", r"\.") for o in OPENERS) + ")(?: *:)? +"


def _key(name: Column) -> Column:
    """A name as lists are searched by it: folded words; "et al.", "and" and, beside longer words, initials left out."""
    bare = F.regexp_replace(F.regexp_replace(name, _OPENER, ""), r"(?i)\b(?:et|el|at) al\b\.?", " ")
    words = F.filter(F.split(normalise_key(F.regexp_replace(bare, r"’s?$|'s?$", "")), " "), lambda w: (w != "") & (w != "and"))
    whole = F.filter(words, lambda w: F.length(w) > 1)
    return F.array_join(F.when(F.size(words) > 1, whole).otherwise(words), " ")


def _pieces(inner: Column) -> Column:
    """[(name or null, years)] of what a bracket holds. Semicolons part citations; within them, what stands before each run
    of years is a new name if it opens the citation or is nothing but a capitalised name, else the name before goes on."""

    def one(piece):
        heads = F.transform(F.split(piece, _YEARS), lambda h: F.regexp_replace(F.trim(h), "^[, ]+|[, ]+$", ""))
        pairs = F.arrays_zip(heads.alias("head"), F.regexp_extract_all(piece, F.lit(_YEARS), 0).alias("years"))
        new = lambda h, i: (h != "") & ((i == 0) | h.rlike(rf"^{_NAME}$"))
        entries = F.transform(pairs, lambda e, i: F.struct(F.when(new(e["head"], i), e["head"]).alias("name"), e["years"].alias("years")))
        return F.filter(entries, lambda e: e["years"].isNotNull() | e["name"].isNotNull())

    return F.flatten(F.transform(F.split(inner, ";"), one))


def citation_parts(df: DataFrame, text: str = "text") -> DataFrame:
    """df's other columns with (bracket, entry, at, name, year): the citations in a text's round and square brackets, a row for each
    year. bracket counts the text's brackets from 1, entry what a bracket's years part and at the years of an entry, both from
    1; name is a key of folded words.

    A year without a name takes the one before it in its bracket. A bracket of years alone takes the capitalised name
    right before it, as in Fitch's (2000), and is no citation after anything else; neither is a month with its year. Whether a
    list has such an entry is asked later (resolve_citations). Brackets within brackets are read on their own. Null and plain
    texts have no citations. Columns of the given names are replaced.

    Texts are read in place; what is shuffled are the dated brackets' entries, so that names can be carried along a bracket.
    """
    keep = [F.col(n) for n in df.columns if n not in (text, "bracket", "entry", "at", "name", "year")]
    # A text is read once; its brackets are taken apart on their own.
    found = df.filter(F.col(text).rlike(_YEAR)).select(*keep, F.posexplode(F.regexp_extract_all(text, F.lit(_BRACKET), 0)).alias("_at", "_b"))
    opens = F.regexp_instr("_b", F.lit(r"[(\[]"))
    inner = F.trim(F.substring("_b", opens + 1, F.length("_b") - opens - 1))
    dated = "^(?i:" + "|".join(MONTHS) + ") (?:19|20)[0-9]{2}$"
    held = found.filter(F.col("_b").rlike(_YEAR)).select(*keep, (F.col("_at") + 1).alias("bracket"), F.trim(F.substring("_b", F.lit(1), opens - 1)).alias("_before"), inner.alias("_inner"))
    held = held.filter(F.col("_inner").rlike(_YEAR) & ~F.col("_inner").rlike(dated))
    # Rows that are alike in all of these hold the same citations, so it does not matter that they share a window.
    row = [*keep, "bracket", "_first", "_digest"]
    first = F.when(F.col("_inner").rlike(f"^{_YEARS}$") & (F.col("_before") != ""), F.col("_before")).alias("_first")
    # Told before the explosion, or each entry would digest its whole bracket.
    told = held.select(*keep, "bracket", first, F.md5("_inner").alias("_digest"), _pieces(F.col("_inner")).alias("_pieces"))
    told = told.select(*row, F.posexplode("_pieces").alias("_p", "_e"))
    last = F.last("_e.name", ignorenulls=True).over(Window.partitionBy(*row).orderBy("_p"))
    told = told.select(*keep, "bracket", "_p", F.coalesce(last, "_first").alias("_name"), F.col("_e.years").alias("_years"))
    keyed = told.filter("_years is not null and _name is not null").select(*keep, "bracket", "_p", _key(F.col("_name")).alias("name"), F.lower("_years").alias("_years")).filter("name <> ''")
    years = keyed.select(*keep, "bracket", (F.col("_p") + 1).alias("entry"), "name", F.posexplode(F.regexp_extract_all("_years", F.lit(_YEAR), 0)).alias("_y", "year"))
    return years.select(*keep, "bracket", "entry", (F.col("_y") + 1).alias("at"), "name", "year")
