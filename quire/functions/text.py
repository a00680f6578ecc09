"""Scalar functions on text, numbers and colours: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plain letters and the accented ones that fold to them.
FOLDS = {"a": "àáâãäåāăą", "c": "çćč", "d": "ď", "e": "èéêëēęě", "g": "ğ", "i": "ìíîïī", "l": "ł", "n": "ñńň", "o": "òóôõöøōő", "r": "ř", "s": "śşšß", "t": "ť", "u": "ùúûüūůű", "y": "ýÿ", "z": "žźż"}
ACCENTED = "".join(FOLDS.values())
PLAIN = "".join(letter * len(forms) for letter, forms in FOLDS.items())
#: Words that say nothing in a title.
STOPWORDS = ("a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def deterministic_id(kind: str, key, namespace: str = "quire") -> Column:
    """A UUID (version 5 layout) that the namespace, the kind and the key alone decide."""
    h = F.sha2(F.concat(F.lit(f"{namespace}:{kind}:"), c(key).cast("string")), 256)
    variant = F.lower(F.conv((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8).cast("string"), 10, 16))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def fold_accents(text) -> Column:
    return F.translate(F.lower(c(text)), ACCENTED, PLAIN)


def fold_word(word: Column) -> Column:
    """fold_accents() of a lower-case word: what holds nothing but ASCII stays as it is, without a look at each letter."""
    return F.when(F.octet_length(word) > F.length(word), F.translate(word, ACCENTED, PLAIN)).otherwise(word)


def slugify(text, most: int = 64) -> Column:
    """Letters and digits with single hyphens, at most `most` long, cut at the last hyphen before that."""
    s = F.regexp_replace(F.regexp_replace(fold_accents(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.substring(s, 1, most)
    return F.when(F.length(s) <= most, s).when(F.instr(cut, "-") > 0, F.regexp_replace(cut, "-[^-]*$", "")).otherwise(cut)


def audit_words(text) -> Column:
    """Words for a count: letters and digits part company, punctuation stands alone."""
    parted = F.regexp_replace(F.lower(c(text)), r"([^\p{L}\p{N}\s])", " $1 ")
    parted = F.regexp_replace(parted, r"(\p{L})(\p{N})", "$1 $2")
    parted = F.regexp_replace(parted, r"(\p{N})(\p{L})", "$1 $2")
    return F.filter(F.split(parted, r"\s+"), lambda w: w != "")


def normalise_key(text) -> Column:
    """Folded words of letters and digits, one blank between them."""
    return F.trim(F.regexp_replace(fold_accents(text), "[^a-z0-9]+", " "))


def stem_title(word: Column) -> Column:
    """A light stem: plural and participle endings of longer words go."""
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    long = F.when(F.endswith(word, F.lit("ing")), cut(3)).when(F.endswith(word, F.lit("ed")) | F.endswith(word, F.lit("es")), cut(2)).when(F.endswith(word, F.lit("s")), cut(1)).otherwise(word)
    return F.when(F.length(word) > 5, long).when((F.length(word) > 3) & F.endswith(word, F.lit("s")), cut(1)).otherwise(word)


def title_tokens(text, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    words = F.filter(F.split(normalise_key(text), " "), lambda w: (w != "") & ~w.isin(list(stopwords)))
    return F.array_distinct(F.transform(words, stem_title))


def containment(a, b) -> Column:
    """Shared elements over the smaller set's size."""
    least = F.least(F.size(c(a)), F.size(c(b)))
    return F.when(least > 0, F.size(F.array_intersect(c(a), c(b))) / least).otherwise(0.0)


def jaccard(a, b) -> Column:
    union = F.size(F.array_union(c(a), c(b)))
    return F.when(union > 0, F.size(F.array_intersect(c(a), c(b))) / union).otherwise(0.0)


def initials_of(text, skip: tuple[str, ...] = STOPWORDS) -> Column:
    words = F.filter(F.split(normalise_key(text), " "), lambda w: (w != "") & ~w.isin(list(skip)))
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def author_year_keys(text) -> Column:
    """Keys of the in-text forms: "smith 2019" of (Smith, 2019) and Smith et al. 2019, "smith jones 2019" of Smith and
    Jones (2019); several years after one name, as in "Smith 2018a, 2018b", give a key each. A month is no name."""
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    name = rf"((?!(?:{months})\b)[A-Z][\p{{L}}'’-]+(?: (?:and|&) [A-Z][\p{{L}}'’-]+| et al\.?)?)"
    pattern = name + r",? \(?((?:19|20)[0-9]{2}[a-z]?(?![0-9])(?:[,;] (?:19|20)[0-9]{2}[a-z]?(?![0-9]))*)\)?"
    author = F.regexp_extract_all(c(text), F.lit(pattern), 1)
    year = F.regexp_extract_all(c(text), F.lit(pattern), 2)
    key = lambda a: normalise_key(F.regexp_replace(F.regexp_replace(a, " et al.*$", ""), " (?:and|&) ", " "))
    return F.flatten(F.zip_with(author, year, lambda a, y: F.transform(F.split(y, "[,;] "), lambda one: F.concat_ws(" ", key(a), one))))


def reference_key(citation) -> Column:
    """First author and year of a reference list entry."""
    author = normalise_key(F.regexp_extract(c(citation), r"^\s*([\p{L}'-]+)", 1))
    return F.concat_ws(" ", author, F.regexp_extract(c(citation), r"((?:19|20)[0-9]{2}[a-z]?)", 1))


def expand_markers(text, most: int = 20) -> Column:
    """"4-6,9" as 4, 5, 6, 9; a span over more than `most` numbers gives its ends."""
    parts = F.filter(F.split(F.regexp_replace(c(text), "[–—]", "-"), ","), lambda p: p.rlike(r"^\s*[0-9]{1,6}(\s*-\s*[0-9]{1,6})?\s*$"))

    def one(p):
        lo = F.trim(F.split(p, "-")[0]).cast("int")
        hi = F.when(F.instr(p, "-") > 0, F.trim(F.element_at(F.split(p, "-"), -1)).cast("int")).otherwise(lo)
        return F.when((hi >= lo) & (hi - lo < most), F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array(lo, hi))

    return F.flatten(F.transform(parts, one))


def address_key(url) -> Column:
    """A web address without scheme, www., closing slashes, query and case of the host."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c(url)), "^(?i:https?)://", ""), "^(?i:www)\\.", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "[?#].*$", ""), "/+$", "")
    host = F.lower(F.substring_index(bare, "/", 1))
    return F.concat(host, F.substring(bare, F.length(host) + 1, F.length(bare)))


def same_address(a, b) -> Column:
    """Equal keys, or one the other's beginning at a slash."""
    x, y = address_key(a), address_key(b)
    return (x == y) | F.startswith(x, F.concat(y, F.lit("/"))) | F.startswith(y, F.concat(x, F.lit("/")))


def edition_of(text) -> Column:
    """The number of "2nd edition", letter-spaced forms too; null without one."""
    close = F.regexp_replace(F.lower(c(text)), r"(?<=\b[a-z0-9]) (?=[a-z0-9]\b)", "")
    found = F.regexp_extract(close, r"([0-9]{1,2}) ?(?:st|nd|rd|th) ?edition", 1)
    return F.when(found != "", found.cast("int"))


def publication_date(text, file_name=None) -> Column:
    """The last "published in Month YYYY" of a text as its first day, or a YYYY-MM in the file name."""
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    every = F.regexp_extract_all(c(text), F.lit(f"(?i:published in) ((?:{months}) (?:19|20)[0-9]{{2}})"), 1)
    said = F.when(F.size(every) > 0, F.to_date(F.concat(F.lit("1 "), F.get(every, F.size(every) - 1)), "d MMMM yyyy"))
    if file_name is None:
        return said
    stamp = F.regexp_extract(c(file_name), "((?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2]))", 1)
    return F.coalesce(said, F.when(stamp != "", F.to_date(F.concat(stamp, F.lit("-01")))))


def page_span(low, high) -> Column:
    return F.when(c(low) == c(high), c(low).cast("string")).otherwise(F.concat_ws("-", c(low), c(high)))


def step_of_address(address) -> Column:
    """The n of an address that begins with step-n; null otherwise."""
    found = F.regexp_extract(c(address), "^step-([0-9]+)(?:$|[-/])", 1)
    return F.when(found != "", found.cast("int"))


def _channel(hex_colour, at: int) -> Column:
    return F.conv(F.substring(F.regexp_replace(c(hex_colour), "^#", ""), at, 2), 16, 10).cast("double") / 255.0


def colour_family(hex_colour) -> Column:
    """grey, red, yellow, green, blue or purple, by hue; grey where the channels hardly differ."""
    r, g, b = (_channel(hex_colour, i) for i in (1, 3, 5))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    hue = F.when(top == r, F.pmod((g - b) / d, F.lit(6.0))).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60
    bands = F.when(hue < 30, "red").when(hue < 75, "yellow").when(hue < 165, "green").when(hue < 255, "blue").when(hue < 330, "purple").otherwise("red")
    return F.when(d < 0.08, "grey").otherwise(bands)


def contrast(one, other) -> Column:
    """WCAG contrast ratio of two colours."""

    def light(colour):
        lin = [F.when(x <= 0.03928, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, 2.4)) for x in (_channel(colour, i) for i in (1, 3, 5))]
        return 0.2126 * lin[0] + 0.7152 * lin[1] + 0.0722 * lin[2]

    a, b = light(one), light(other)
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def statement_coverage(statement_words, body_words, same_step: Column, share: float = 0.6) -> Column:
    """Whether a body says a statement: enough of its words over three letters, all of them across steps."""
    long = F.array_distinct(F.filter(c(statement_words), lambda w: F.length(w) > 3))
    part = F.when(F.size(long) > 0, F.size(F.array_intersect(long, c(body_words))) / F.size(long)).otherwise(0.0)
    return part >= F.when(same_step, share).otherwise(1.0)


def clean_url(url) -> Column:
    """The trimmed address where it is http or https and at most 2,000 long; null otherwise."""
    u = F.trim(c(url))
    return F.when(u.rlike(r"^(?i:https?)://[^\s/]+") & (F.length(u) <= 2000), u)


def clean_citation(text, most: int = 2000) -> Column:
    t = F.trim(F.regexp_replace(c(text), r"\s+", " "))
    return F.when((t != "") & (F.length(t) <= most), t)


def sentence_window(text, at: Column, before: int = 180, after: int = 80) -> Column:
    """What stands around a place (from 1), with an ellipsis where it is cut."""
    t, lo = c(text), F.greatest(F.lit(1), at - before)
    hi = F.least(F.length(t), at + after - 1)
    return F.concat(F.when(lo > 1, "…").otherwise(""), F.substring(t, lo, hi - lo + 1), F.when(hi < F.length(t), "…").otherwise(""))


def pathway_slug(file_name) -> Column:
    """A file name's slug without ending, edition, date and leading number."""
    s = F.regexp_replace(F.lower(c(file_name)), r"\.[a-z0-9]+$", "")
    s = F.regexp_replace(s, r"[-_ ]?\(?[0-9]{1,2}(?:st|nd|rd|th)[-_ ]edition\)?|[-_ ]?(?:19|20)[0-9]{2}(?:-[0-9]{2}){0,2}", "")
    return slugify(F.regexp_replace(s, r"^[0-9]+[-_ ]+", ""))


def reference_address(citation) -> Column:
    """(before, address, after) of a citation that prints <address>; a scheme is added; nulls without one."""
    t, pattern = c(citation), r"^(.*?)<((?:https?://)?[^<>\s]+\.[^<>\s]+)>(.*)$"
    found = F.regexp_extract(t, pattern, 2)
    address = F.when(found == "", None).when(found.rlike("^https?://"), found).otherwise(F.concat(F.lit("https://"), found))
    return F.struct(F.regexp_extract(t, pattern, 1).alias("before"), address.alias("address"), F.regexp_extract(t, pattern, 3).alias("after"))


def opens_entry(line, titles: tuple[str, ...] = ("dr", "prof", "professor", "mr", "mrs", "ms", "associate professor")) -> Column:
    """Whether a line starts the entry of a person: an honorific, then a capital."""
    return c(line).rlike(r"^\s*(?:(?i:" + "|".join(titles) + r")\.?)\s+\p{Lu}")


def document_name(kind, audience, title) -> Column:
    subject = F.concat(F.upper(F.substring(c(title), 1, 1)), F.substring(c(title), 2, F.length(c(title))))
    return F.when(c(kind) == "core", F.concat(F.lit("Principles: "), subject)).when(c(audience) == "consumer", F.concat(F.lit("Guide to "), c(title))).otherwise(subject)


def section_label(step, title) -> Column:
    return F.when(c(step).isNotNull(), F.concat(F.lit("Step "), c(step).cast("string"), F.lit(": "), c(title))).otherwise(c(title))


def first_note_line(notes) -> Column:
    return F.get(F.filter(F.split(c(notes), "\n"), lambda x: F.trim(x) != ""), F.lit(0))


def relative_age(at, now) -> Column:
    """just now, n min, n h, yesterday, n days (under 14), or the date."""
    minutes = F.round((F.unix_timestamp(c(now)) - F.unix_timestamp(c(at))) / 60).cast("long")
    days = F.floor(minutes / 1440)
    return (
        F.when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h"))).when(days < 2, "yesterday")
        .when(days < 14, F.concat(days.cast("string"), F.lit(" days"))).otherwise(F.date_format(c(at), "yyyy-MM-dd"))
    )


def body_as(fmt: str, markdown="markdown", html="html", json="body_json") -> Column:
    """The one stored form that is asked for, so that the scan reads no other."""
    return {"markdown": c(markdown), "html": c(html), "json": c(json)}[fmt].alias("body")
