"""Main text of web pages by the maximum-scoring subsequence.

A page is read as a line of tokens: words, which score positive, and tags, which score negative. One linear scan finds
the run of tokens with the greatest sum. The weights are fitted to labelled pages, those whose own markup names exactly
one main element: a structured perceptron compares the best run with the labelled one and moves the weights of words,
linked words, tags and class names until they agree; words stay positive and tags negative. The main element's own tags
are no features, and menus and footers are tags like others there, so the weights also say where pages without such
names have their text. Tags that no labelled page has keep a small weight, those of lists and links a larger one.

Menus, sidebars, forms, adverts, notices, reader comments and the like are no words wherever they stand: by their
element, role, class name or by being hidden; and where a page names its one main element, neither is what is outside
of it. They score nothing and are no part of the text. A header inside the main element counts with its headings only.

Character references are decoded; white space inside a block becomes one space; blocks are joined in page order by one
space. Nulls and empty pages give an empty text. Pages of any length and nesting are read in linear time. Repeated rows
get equal texts; an empty table gives an empty table; other columns are ignored. Broken markup is read as browsers do
where it matters here: unclosed elements end with their parents, raw text ends at its end tag only.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scan

#: Most labelled pages that weights are fitted on, and the most characters of each.
FIT_PAGES, FIT_CHARS = 400, 100_000
ROUNDS = 8
#: What words score at least, and tags at most.
LEAST_WORD, MOST_TAG = 0.5, -0.01
#: Weights before fitting.
PRIOR = {"word": 1.0, "linked": 0.5}
TAG = -0.02
TAGS = {"<a>": -1.0, "<ul>": -0.3, "<li>": -0.3, "<nav>": -1.0, "<footer>": -1.0, "<form>": -1.0, "<option>": -1.0, "<aside>": -1.0}

# Elements of HTML by their part in a page.
RAW = set("script style title textarea xmp iframe noembed noframes".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
MAIN = {"article", "main"}
#: Elements, roles and words of class names whose content is no part of the main text.
APART = set("aside audio button canvas datalist dialog footer form head map math menu nav noscript object search select svg template video".split())
APART_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
APART_WORDS = set(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies discussion disqus "
    "dropdown footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo "
    "promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
NEGATED = {"has", "no", "with", "without", "not"}
#: Elements that an opening one ends: (what it ends, what it does not look beyond).
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _markup(page: str):
    """(text, None) and (end tag?, name, attributes) of a page in order, comments left out."""
    at, shown, quotes = 0, 0, True
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4 if not page.startswith("<!-->", at) else at + 2)
            end = len(page) if end < 0 else end + 3
            token = None
        elif page[at + 1 : at + 2] in ("!", "?") or page[at + 1 : at + 2] == "/" and not page[at + 2 : at + 3].isalpha():
            end = page.find(">", at)
            end = len(page) if end < 0 else end + 1
            token = None
        elif head := _NAME.match(page, at):
            # A quote that is never closed: from there on tags end at the next >.
            m = _TAG.match(page, at) if quotes else None
            if m:
                end, token = m.end(), (m[1], m[2].lower(), m[3])
            else:
                quotes = False
                end = page.find(">", at)
                end = len(page) if end < 0 else end + 1
                token = (head[1], head[2].lower(), page[head.end() : end - 1])
        else:
            at += 1
            continue
        if at > shown:
            yield page[shown:at], None, None
        if token:
            yield token
        shown = at = end
        if token and not token[0] and token[1] in RAW:
            close = re.compile(f"</{token[1]}(?=[\\s/>])", re.I).search(page, at)
            shown = at = close.start() if close else len(page)
    if shown < len(page):
        yield page[shown:], None, None


def _names(attributes: str) -> tuple[list[str], bool]:
    """Words of class and id, and whether the attributes set the element apart."""
    words, apart = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for token in value.split():
                parts = [p.lower() for p in _PARTS.findall(token)]
                words += parts
                if parts and not NEGATED & set(parts[:-1]) and (parts[0] in APART_WORDS or parts[-1] in APART_WORDS):
                    apart = True
        elif name == "role":
            apart |= value.strip().lower() in APART_ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            apart = True
    return words, apart


class Page:
    """The tokens of a page: kinds (a feature and how often, or None for text set apart) and the text of each.

    items: (feature, count, text, block, set apart? (2: by attributes), number of the main element around it or -1)
    """

    def __init__(self, page: str | None):
        self.items, self.mains = [], 0
        self._open, self._count = [], Counter()
        self._apart = self._named = self._header = self._heading = self._main = 0
        self._number, block, linked = -1, 0, False
        for first, name, attributes in _markup(page or ""):
            if name is None:
                text = html.unescape(first)
                apart = self._far() or self._header > 0 and self._heading == 0
                self.items.append(("linked" if linked else "word", len(text.split()), text, block, apart, self._number))
                continue
            apart = self._far()
            if name in BLOCK:
                block += 1
            if first:
                if self._count[name]:
                    self._pop(name)
                linked = linked and name != "a"
                self._tag(name, block, apart)
                continue
            if name in BLOCK and self._count["p"] and name != "br":
                self._pop("p")
            if name in ENDS:
                self._end(*ENDS[name])
            words, set_apart = _names(attributes) if attributes else ((), False)
            set_apart = set_apart and name not in ("html", "body", *MAIN)
            apart = 2 if set_apart else max(self._far(), name in APART)
            self._tag(name, block, apart)
            for w in set(words):
                self.items.append(("." + w, 1, None, block, apart, self._number))
            if name == "a":
                linked = True
            if name not in VOID and name not in RAW and (name in BLOCK or name in APART or set_apart):
                self._push(name, 2 if set_apart else int(name in APART))

    def _far(self) -> int:
        return 2 if self._named else int(self._apart > 0)

    def _tag(self, name, block, apart):
        if name not in MAIN:
            self.items.append((f"<{name}>", 1, None, block, apart, self._number))

    def _push(self, name: str, apart: int):
        inner = name in MAIN and self._main > 0
        # An article in an article is a comment on it; a main element around one article leaves the name to that.
        if name == "article" and any(o[0] == "article" for o in self._open[-64:]) and inner:
            apart = 2
        number = self._number
        if name in MAIN and not inner and not self._apart:
            self._number, self.mains = self.mains, self.mains + 1
        header = name == "header" and self._main > 0
        if name == "header" and not header:
            apart = apart or 1
        self._open.append((name, apart, header, number))
        self._count[name] += 1
        self._apart += apart > 0
        self._named += apart == 2
        self._header += header
        self._heading += name in HEADING
        self._main += name in MAIN

    def _drop(self):
        name, apart, header, self._number = self._open.pop()
        self._count[name] -= 1
        self._apart -= apart > 0
        self._named -= apart == 2
        self._header -= header
        self._heading -= name in HEADING
        self._main -= name in MAIN

    def _pop(self, name: str):
        while self._open[-1][0] != name:
            self._drop()
        self._drop()

    def _end(self, ended: set[str], border: set[str]):
        """Ends the innermost of the elements `ended`, if none of `border` is inside of it."""
        if any(self._count[n] for n in ended):
            for name, *_ in reversed(self._open):
                if name in ended:
                    return self._pop(name)
                if name in border:
                    return None
        return None


def best_run(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the run with the greatest sum: the first of those, and of these the longest; (0, 0) if none is positive."""
    best, run, low, start = 0.0, (0, 0), 0.0, 0
    for i, total in enumerate(accumulate(scores)):
        if total - low > best or total - low == best and run[0] == start and best > 0:
            best, run = total - low, (start, i + 1)
        if total < low:
            low, start = total, i + 1
    return run


def _before(feature: str) -> float:
    return PRIOR.get(feature) or TAGS.get(feature, TAG)


def _weigh(weights: dict[str, float], feature: str) -> float:
    return weights.get(feature, _before(feature))


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of a page."""
    read = Page(page)
    items = read.items
    inside = read.mains == 1 and any(n for f, n, t, _, apart, main in items if t is not None and main == 0 and not apart)
    out = [apart > 0 or inside and main != 0 for *_, apart, main in items]
    start, end = best_run([0.0 if o else n * _weigh(weights, f) for (f, n, *_), o in zip(items, out)])
    blocks, last = [], None
    for (_, _, text, block, _, _), o in zip(items[start:end], out[start:end]):
        if text is not None and not o:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(text)
    return " ".join(" ".join("".join(b) for b in blocks).split())


def labelled(page: str | None) -> tuple[list[tuple[str, int]], int, int] | None:
    """Tokens (feature, count) of a page with exactly one main element, and where that begins and ends; else None. What
    attributes set apart is left out."""
    read = Page(page)
    items = [x for x in read.items if x[4] != 2]
    held = [i for i, x in enumerate(items) if x[5] == 0]
    if read.mains != 1 or not any(items[i][2] is not None and items[i][1] for i in held):
        return None
    return [(f, n) for f, n, *_ in items], held[0], held[-1] + 1


def fit(pages: list[tuple[list[tuple[str, int]], int, int]]) -> dict[str, float]:
    """Weights whose best runs are the labelled ones, averaged over the rounds of a structured perceptron."""
    weights = dict(PRIOR)
    total, steps = defaultdict(float), 0
    for _ in range(ROUNDS):
        wrong = 0
        for tokens, start, end in pages:
            s, e = best_run([n * _weigh(weights, f) for f, n in tokens])
            move = Counter()
            for i in [*range(min(s, start), max(s, start)), *range(min(e, end), max(e, end))] if s < end and start < e else [*range(s, e), *range(start, end)]:
                f, n = tokens[i]
                move[f] += n if start <= i < end else -n
            size = sum(map(abs, move.values()))
            wrong += size > 0
            for f, n in move.items():
                w = _weigh(weights, f) + n / size
                weights[f] = max(LEAST_WORD, w) if f in PRIOR else min(MOST_TAG, w)
        steps += 1
        for f, w in weights.items():
            total[f] += w - _before(f)
        if not wrong:
            break
    return {f: _before(f) + w / steps for f, w in total.items()}


def fitted(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights from at most FIT_PAGES pages with one main element, those whose hash is least."""
    named = F.lower(html_col).rlike("<(article|main)[\\s>]") & (F.length(html_col) <= FIT_CHARS)
    some = pages.filter(named).select(F.xxhash64(html_col).alias("h"), html_col).orderBy("h", html_col).limit(FIT_PAGES)
    return fit([x for r in some.toLocalIterator() if (x := labelled(r[html_col]))])


def main_text(pages: DataFrame, weights: dict[str, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text and n_chars."""
    kinds = dict(pages.dtypes)

    def rows(ids, urls, held):
        text = [extract(p, weights) for p in held]
        return ids, urls, text, list(map(len, text))

    schema = f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long"
    return scan(pages, [id_col, url_col, html_col], schema, rows)
