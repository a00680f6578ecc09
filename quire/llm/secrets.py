"""Secret scans: an Aho-Corasick pass finds keywords, anchored patterns run only at those hits, and
token kinds that embed a checksum must pass it.

Nulls and empty texts give no spans. Offsets are code points, ends exclusive. Texts of any length are read
whole; each row is on its own, so repeated rows repeat and an empty table gives an empty table. Columns other
than the two named ones are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame

from .common import scan

#: Kinds in the order in which equal starts are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "age", "xprv")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of the class that is long enough
_GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z_])")
_NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z_])")
_AGE = re.compile(r"AGE-SECRET-KEY-1([02-9AC-HJ-NP-Z]{58})(?![0-9A-Z])")
_XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def _crc62(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of the thirty before them, in base 62."""
    n, out = zlib.crc32(m[1].encode()), ""
    while n:
        n, digit = divmod(n, 62)
        out = _BASE62[digit] + out
    return out.rjust(6, "0") == m[2]


def _base58check(m: re.Match) -> bool:
    n = 0
    for c in m[0]:
        n = n * 58 + _BASE58.index(c)
    if n.bit_length() > 82 * 8:
        return False
    raw = n.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _bech32(m: re.Match) -> bool:
    prefix = "age-secret-key-"
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [_BECH32.index(c) for c in m[1].lower()]
    check = 1
    for v in values:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= g if top >> i & 1 else 0
    return check == 1


#: keyword -> (kind, pattern anchored at the keyword, what a match must satisfy)
_AT = {w: ("assign", _ASSIGN, lambda m: len(m[2]) >= 6) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")}
_AT |= {"akia": ("access", _ACCESS, lambda m: m.end() - m.start() >= 20)}
_AT |= {f"gh{c}_": ("github", _GITHUB, _crc62) for c in "pousr"} | {"npm_": ("npm", _NPM, _crc62)}
_AT |= {"age-secret-key-1": ("age", _AGE, _bech32), "xprv": ("xprv", _XPRV, _base58check)}

_automaton = None


def _keywords() -> ahocorasick.Automaton:
    global _automaton
    if _automaton is None:
        _automaton = ahocorasick.Automaton()
        for word in _AT:
            _automaton.add_word(word, word)
        _automaton.make_automaton()
    return _automaton


def find(text: str | None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) by start, then kind as listed in KINDS."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # only the dotted capital I grows; its place in the text must stay
        low = text.replace("İ", "ı").lower()
    hits = sorted((end - len(word) + 1, word) for end, word in _keywords().iter(low))
    out, past = [(("hex"), m.start(), m.end()) for m in _HEX.finditer(text)], {}
    for start, word in hits:
        kind, pattern, good = _AT[word]
        # What a failing match covers is passed over, as by a scan from the left.
        if start >= past.get(kind, 0) and (m := pattern.match(text, start)):
            past[kind] = m.end()
            if good(m):
                out.append((kind, start, m.end()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and `found`, an array of (kind, start, end, value)."""

    def rows(ids, texts):
        return ids, [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for k, a, b in find(t)] for t in texts]

    kind = dict(documents.dtypes)[id_col]
    return scan(documents, [id_col, text_col], f"`{id_col}` {kind}, found array<struct<kind:string,start:bigint,end:bigint,value:string>>", rows)
