"""Phonetic codes of tokens.  Codes are computed once per distinct token in Arrow batches and joined back."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOWELS = "AEIOUY"


class _Word:
    """A padded upper-case word with the tests the coding rules are written in."""

    def __init__(self, text: str, published: bool = True):
        bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).upper()
        self.n = len(bare)
        self.published = published
        # rules that ask for a blank mean the end of a word; in the older coding only a blank inside the text is one
        pad = " " if published else "-"
        self.s = pad * 2 + bare + pad * 6
        self.slavic = any(x in bare for x in ("W", "K", "CZ", "WITZ"))

    def at(self, i: int, size: int, *options: str) -> bool:
        return self.s[i + 2 : i + 2 + size] in options if i + 2 >= 0 else False

    def ch(self, i: int) -> str:
        return self.s[i + 2]

    def vowel(self, i: int) -> bool:
        return self.ch(i) in _VOWELS and self.ch(i) != " "


Rule = tuple[str, str, int]


def _skip(w: _Word, i: int, size: int = 1) -> int:
    """Letters to pass: a doubled letter counts once."""
    return size + (w.ch(i + size) == w.ch(i))


def _c(w: _Word, i: int) -> Rule:
    if i > 1 and not w.vowel(i - 2) and w.at(i - 1, 3, "ACH") and w.ch(i + 2) != "I" and (w.ch(i + 2) != "E" or w.at(i - 2, 6, "BACHER", "MACHER")):
        return "K", "K", 2
    if i == 0 and w.at(0, 6, "CAESAR"):
        return "S", "S", 2
    if w.at(i, 4, "CHIA"):
        return "K", "K", 2
    if w.at(i, 2, "CH"):
        if i > 0 and w.at(i, 4, "CHAE"):
            return "K", "X", 2
        greek = i == 0 and (w.at(1, 5, "HARAC", "HARIS") or w.at(1, 3, "HOR", "HYM", "HIA", "HEM")) and not w.at(0, 5, "CHORE")
        germanic = w.at(0, 4, "VAN ", "VON ") or w.at(0, 3, "SCH") or w.at(i - 2, 6, "ORCHES", "ARCHIT", "ORCHID") or w.ch(i + 2) in "TS"
        hard = (w.at(i - 1, 1, "A", "O", "U", "E") or i == 0) and w.ch(i + 2) in "LRNMBHFVW "
        if greek or germanic or hard:
            return "K", "K", 2
        if i > 0:
            return ("K", "K", 2) if w.at(0, 2, "MC") else ("X", "K", 2)
        return "X", "X", 2
    if w.at(i, 2, "CZ") and not w.at(i - 2, 4, "WICZ"):
        return "S", "X", 2
    if w.at(i + 1, 3, "CIA"):
        return "X", "X", 3
    if w.at(i, 2, "CC") and not (i == 1 and w.ch(0) == "M"):
        if w.ch(i + 2) in "IEH" and not w.at(i + 2, 2, "HU"):
            hard = (i == 1 and w.ch(0) == "A") or w.at(i - 1, 5, "UCCEE", "UCCES")
            return ("KS", "KS", 3) if hard else ("X", "X", 3)
        return "K", "K", 2
    if w.at(i, 2, "CK", "CG", "CQ"):
        return "K", "K", 2
    if w.at(i, 2, "CI", "CE", "CY"):
        return ("S", "X", 2) if w.at(i, 3, "CIO", "CIE", "CIA") else ("S", "S", 2)
    if w.at(i + 1, 2, " C", " Q", " G"):
        return "K", "K", 3
    return "K", "K", 2 if w.ch(i + 1) in "CKQ" and not w.at(i + 1, 2, "CE", "CI") else 1


def _g(w: _Word, i: int) -> Rule:
    nxt = w.ch(i + 1)
    if nxt == "H":
        if i > 0 and not w.vowel(i - 1):
            return "K", "K", 2
        if i == 0:
            return ("J", "J", 2) if w.ch(2) == "I" else ("K", "K", 2)
        if i < 3 and not w.published:
            return "", "", 1
        silent = (i > 1 and w.at(i - 2, 1, "B", "H", "D")) or (i > 2 and w.at(i - 3, 1, "B", "H", "D")) or (i > 3 and w.at(i - 4, 1, "B", "H"))
        if silent:
            return "", "", 2
        if i > 2 and w.ch(i - 1) == "U" and w.at(i - 3, 1, "C", "G", "L", "R", "T"):
            return "F", "F", 2
        return ("K", "K", 2) if i > 0 and w.ch(i - 1) != "I" else ("", "", 2)
    if nxt == "N":
        if i == 1 and w.vowel(0) and not w.slavic:
            return "KN", "N", 2
        if not w.at(i + 2, 2, "EY") and w.ch(i + 1) != "Y" and not w.slavic:
            return "N", "KN", 2
        return "KN", "KN", 2
    if w.at(i + 1, 2, "LI") and not w.slavic:
        return "KL", "L", 2
    if i == 0 and (nxt == "Y" or w.at(1, 2, "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")):
        return "K", "J", 2
    if (w.at(i + 1, 2, "ER") or nxt == "Y") and not w.at(0, 6, "DANGER", "RANGER", "MANGER") and not w.at(i - 1, 1, "E", "I") and not w.at(i - 1, 3, "RGY", "OGY"):
        return "K", "J", 2
    if nxt in "EIY" or w.at(i - 1, 4, "AGGI", "OGGI"):
        if w.at(0, 4, "VAN ", "VON ") or w.at(0, 3, "SCH") or w.at(i + 1, 2, "ET"):
            return "K", "K", 2
        return ("J", "J", 2) if w.at(i + 1, 4, "IER ") else ("J", "K", 2)
    return "K", "K", _skip(w, i)


def _j(w: _Word, i: int) -> Rule:
    if w.at(i, 4, "JOSE") or w.at(0, 4, "SAN "):
        if (i == 0 and w.ch(i + 4) == " ") or w.at(0, 4, "SAN "):
            return "H", "H", 1
        return "J", "H", 1
    step = _skip(w, i)
    if i == 0:
        return "J", "A", step
    if w.vowel(i - 1) and not w.slavic and w.ch(i + 1) in "AO":
        return "J", "H", step
    if i == w.n - 1:
        return "J", "", step
    if w.ch(i + 1) not in "LTKSNMBZ" and w.ch(i - 1) not in "SKL":
        return "J", "J", step
    return "", "", step


def _s(w: _Word, i: int) -> Rule:
    nxt = w.ch(i + 1)
    if w.at(i - 1, 3, "ISL", "YSL"):
        return "", "", 1
    if i == 0 and w.at(0, 5, "SUGAR"):
        return "X", "S", 1
    if nxt == "H":
        return ("S", "S", 2) if w.at(i + 1, 4, "HEIM", "HOEK", "HOLM", "HOLZ") else ("X", "X", 2)
    if w.at(i, 3, "SIO", "SIA"):
        return ("S", "S", 3) if w.slavic else ("S", "X", 3)
    if (i == 0 and nxt in "MNLW") or nxt == "Z":
        return "S", "X", 2 if nxt == "Z" else 1
    if nxt == "C":
        third = w.ch(i + 2)
        if third == "H":
            if w.at(i + 3, 2, "OO", "ER", "EN", "UY", "ED", "EM"):
                return ("X", "SK", 3) if w.at(i + 3, 2, "ER", "EN") else ("SK", "SK", 3)
            if i == 0 and not w.vowel(3) and w.ch(3) != "W":
                return "X", "S", 3
            return "X", "X", 3
        return ("S", "S", 3) if third in "IEY" else ("SK", "SK", 3)
    if i == w.n - 1 and w.at(i - 2, 2, "AI", "OI"):
        return "", "S", 1
    return "S", "S", 2 if nxt in "SZ" else 1


def _t(w: _Word, i: int) -> Rule:
    if w.at(i, 4, "TION") or w.at(i, 3, "TIA", "TCH"):
        return "X", "X", 3
    if w.at(i, 2, "TH") or w.at(i, 3, "TTH"):
        if w.at(i + 2, 2, "OM", "AM") or w.at(0, 4, "VAN ", "VON ") or w.at(0, 3, "SCH"):
            return "T", "T", 2
        return "0", "T", 2
    return "T", "T", 2 if w.ch(i + 1) in "TD" else 1


def _w(w: _Word, i: int) -> Rule:
    if w.at(i, 2, "WR"):
        return "R", "R", 2
    if i == 0 and (w.vowel(1) or w.ch(1) == "H"):
        return ("A", "F", 1) if w.vowel(1) else ("A", "A", 1)
    if (i == w.n - 1 and w.vowel(i - 1)) or w.at(i - 1, 5, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or w.at(0, 3, "SCH"):
        return "", "F", 1
    if w.at(i, 4, "WICZ", "WITZ"):
        return "TS", "FX", 4
    return "", "", 1


def _l(w: _Word, i: int) -> Rule:
    if w.ch(i + 1) != "L":
        return "L", "L", 1
    spanish = (i == w.n - 3 and w.at(i - 1, 4, "ILLO", "ILLA", "ALLE")) or ((w.at(w.n - 2, 2, "AS", "OS") or w.at(w.n - 1, 1, "A", "O")) and w.at(i - 1, 4, "ALLE"))
    return ("L", "", 2) if spanish else ("L", "L", 2)


def _d(w: _Word, i: int) -> Rule:
    if w.at(i, 2, "DG"):
        return ("J", "J", 3) if w.ch(i + 2) in "IEY" else ("TK", "TK", 2)
    return "T", "T", 2 if w.at(i, 2, "DT", "DD") else 1


def _m(w: _Word, i: int) -> Rule:
    silent_b = w.published and w.at(i - 1, 3, "UMB") and (i + 1 == w.n - 1 or w.at(i + 2, 2, "ER"))
    return "M", "M", 2 if silent_b or w.ch(i + 1) == "M" else 1


def _r(w: _Word, i: int) -> Rule:
    french = i == w.n - 1 and not w.slavic and w.at(i - 2, 2, "IE") and not w.at(i - 4, 2, "ME", "MA")
    return "" if french else "R", "R", _skip(w, i)


def _z(w: _Word, i: int) -> Rule:
    if w.ch(i + 1) == "H":
        return "J", "J", 2
    foreign = w.at(i + 1, 2, "ZO", "ZI", "ZA") or (w.slavic and i > 0 and w.ch(i - 1) != "T")
    return "S", "TS" if foreign else "S", _skip(w, i)


def _h(w: _Word, i: int) -> Rule:
    return ("H", "H", 2) if (i == 0 or w.vowel(i - 1)) and w.vowel(i + 1) else ("", "", 1)


def _x(w: _Word, i: int) -> Rule:
    if i == 0:
        return "S", "S", 1
    silent = i == w.n - 1 and (w.at(i - 3, 3, "IAU", "EAU") or w.at(i - 2, 2, "AU", "OU"))
    code = "" if silent else "KS"
    return code, code, 2 if w.ch(i + 1) in "CX" else 1


def _p(w: _Word, i: int) -> Rule:
    if w.ch(i + 1) == "H":
        return "F", "F", 2
    return "P", "P", 2 if w.ch(i + 1) in "PB" else 1


def _plain(code: str) -> Callable[[_Word, int], Rule]:
    return lambda w, i: (code, code, _skip(w, i))


_RULES: dict[str, Callable[[_Word, int], Rule]] = {
    "B": _plain("P"), "C": _c, "D": _d, "F": _plain("F"), "G": _g, "H": _h, "J": _j, "K": _plain("K"), "L": _l, "M": _m, "N": _plain("N"), "P": _p,
    "Q": _plain("K"), "R": _r, "S": _s, "T": _t, "V": _plain("F"), "W": _w, "X": _x, "Z": _z,
}


@lru_cache(1 << 16)
def double_metaphone(token: str, published: bool = False) -> tuple[str, str]:
    """``(primary, secondary)`` codes without a length limit; the secondary is empty where it equals the primary.

    The rules are those of L. Philips, "The double metaphone search algorithm" (C/C++ Users Journal, 2000).  By default
    three of them are coded as in the older library whose blocks are to be kept: the end of a word is no blank ("Koch",
    "Jose"), GH after a vowel within the first three letters is silent ("Taghizadeh"), and B after UM is sounded
    ("Dumb"); ``published`` follows the published rules there too.
    """
    w = _Word(token, published)
    one = two = ""
    i = 1 if w.at(0, 2, "GN", "KN", "PN", "WR", "PS") else 0
    while i < w.n:
        ch = w.ch(i)
        if ch in _VOWELS:
            a, b, step = ("A", "A", 1) if i == 0 else ("", "", 1)
        elif ch in _RULES:
            a, b, step = _RULES[ch](w, i)
        else:
            a, b, step = "", "", 1
        one += a
        two += b
        i += step
    return one, "" if one == two else two


def soundex5(token: str) -> str:
    """Soundex with the letter and four digits."""
    codes = {c: d for cs, d in (("BFPV", "1"), ("CGJKQSXZ", "2"), ("DT", "3"), ("L", "4"), ("MN", "5"), ("R", "6")) for c in cs}
    t = "".join(c for c in unicodedata.normalize("NFD", token).upper() if "A" <= c <= "Z")
    if not t:
        return ""
    out, last = t[0], codes.get(t[0], "")
    for c in t[1:]:
        d = codes.get(c, "")
        if d and d != last:
            out += d
        if c not in "HW":
            last = d
    return (out + "0000")[:5]


def nysiis(token: str) -> str:
    """New York State code by the published rules, without a length limit."""
    t = "".join(c for c in unicodedata.normalize("NFD", token).upper() if "A" <= c <= "Z")
    if not t:
        return ""
    for a, b in (("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS")):
        if t.startswith(a):
            t = b + t[len(a) :]
            break
    t = re.sub("(?:EE|IE)$", "Y", t)
    t = re.sub("(?:DT|RT|RD|NT|ND)$", "D", t)
    out, i = t[0], 1
    while i < len(t):
        prev, c, nxt = t[i - 1], t[i], t[i + 1 : i + 2]
        if t[i : i + 2] == "EV":
            new, step = "AF", 2
        elif c in "AEIOU":
            new, step = "A", 1
        elif t[i : i + 3] == "SCH":
            new, step = "SSS", 3
        elif t[i : i + 2] == "PH":
            new, step = "FF", 2
        elif t[i : i + 2] == "KN":
            new, step = "N", 2
        elif c in "QZMK":
            new, step = {"Q": "G", "Z": "S", "M": "N", "K": "C"}[c], 1
        elif c == "H" and (prev not in "AEIOU" or nxt not in tuple("AEIOU")):
            new, step = prev if prev not in "AEIOU" else "A", 1
        elif c == "W" and prev in "AEIOU":
            new, step = "A", 1
        else:
            new, step = c, 1
        t = t[:i] + new + t[i + step :]
        for k in new:
            if k != out[-1]:
                out += k
        i += len(new)
    if len(out) > 1 and out[-1] == "S":
        out = out[:-1]
    if out.endswith("AY"):
        out = out[:-2] + "Y"
    if len(out) > 1 and out[-1] == "A":
        out = out[:-1]
    return out


ENCODERS: dict[str, Callable[[str], str]] = {"double_metaphone": lambda t: double_metaphone(t)[0], "double_metaphone_published": lambda t: double_metaphone(t, True)[0], "nysiis": nysiis, "soundex": soundex5}


def encode_tokens(tokens: DataFrame, column: str, algorithm: str = "double_metaphone") -> DataFrame:
    """``(column, code)`` of each distinct non-null token."""
    if algorithm not in ENCODERS:
        raise ValueError(f"unknown phonetic algorithm {algorithm!r}")
    encode = ENCODERS[algorithm]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({column: pdf[column], "code": [encode(t) for t in pdf[column]]})

    return tokens.select(column).where(F.col(column).isNotNull()).distinct().mapInPandas(run, f"`{column}` string, code string")
