"""Restoring text that was decoded with the wrong character encoding.

A noisy channel over bytes.  A damaged span is turned back into the bytes it was read from under every
``(read as, written as)`` channel; bytes that were lost (U+FFFD) or have vanished become wildcards of the lattice.  The
lattice is decoded with an exact Viterbi search over pairs of last letters, under a letter model with back-off that is
mixed, word by word, with the corpus frequency of the word; both are counted over *all* names in tables of fixed size,
so their broadcast has a proven bound.  Words of the corpus that fit a lost or short place compete by their exact
frequency in a shuffle join afterwards.

Defined results: a null name stays null and is not damaged; an empty name is not damaged; repeated rows give repeated
results in :func:`restore_names` (its input is deduplicated by value first, so equal names are decoded once).
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, groupby, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entiforge.plans.lineage import cut

LM_BITS = 20
LM_SIZE = 1 << LM_BITS

# The code pages whose mix-ups are modelled, each as (page the bytes were read with, page they were
# written with, log prior of the mix-up).
CHANNELS = [
    ("cp1252", "utf-8", -1.0),
    ("latin-1", "utf-8", -1.0),
    ("cp1250", "utf-8", -1.5),
    ("cp1251", "utf-8", -1.5),
    ("mac_roman", "utf-8", -1.5),
    ("cp437", "utf-8", -1.5),
    ("cp850", "utf-8", -2.0),
    ("cp866", "utf-8", -2.0),
    ("koi8_r", "utf-8", -2.0),
    ("cp866", "cp1251", -4.0),
    ("cp1252", "cp1251", -4.0),
    ("latin-1", "cp1251", -4.0),
    ("cp1251", "koi8_r", -4.0),
    ("koi8_r", "cp1251", -4.0),
    ("cp1251", "cp866", -4.0),
    ("cp1252", "koi8_r", -4.0),
    ("mac_roman", "cp1252", -6.0),
    ("cp437", "cp1252", -6.0),
    ("cp850", "cp1252", -6.0),
]

LOST = "�"
# Log prior of a mix-up after which bytes vanished, and the mark of its channel path.
VANISHED = -3.0
#: Log odds above which a name counts as damaged.
LEAST_ODDS = 3.0
SHORT = "~"


@lru_cache(None)
def _byte_map(page: str) -> dict[str, int]:
    """Character -> byte of a single-byte page; undefined bytes read as the C1 control of the same number."""
    out: dict[str, int] = {}
    for b in range(256):
        try:
            ch = bytes([b]).decode(page)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ch, b)
    return out


@lru_cache(None)
def _letter_of_byte(page: str) -> list[str]:
    """Letters a lost byte of ``page`` can have been (wildcard arcs of the lattice)."""
    out = []
    for b in range(0x80, 0x100):
        try:
            ch = bytes([b]).decode(page)
        except UnicodeDecodeError:
            continue
        if ch.isalpha():
            out.append(ch)
    return out


# Letters that a wildcard may stand for: those of the pages for Latin scripts.
@lru_cache(None)
def wildcard_letters() -> str:
    return "".join(sorted({c for p in ("cp1252", "cp1250", "iso8859_9", "iso8859_16") for c in _letter_of_byte(p)} - set("ªºµƒ")))


def _slots(key: str) -> tuple[int, int]:
    """Both places of a key: what is read is the smaller count (a count-min sketch), so chance meetings are rare."""
    raw = key.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) & (LM_SIZE - 1), (zlib.crc32(raw, 0x5BD1E995) * 40_503 >> 7) & (LM_SIZE - 1)


#: Kinds of counts: letter in its context of two and of one, letter, and the contexts as such.
TRI, PAIR, ONE, CONTEXT2, CONTEXT1 = "tpocd"


def letter_keys(word: str) -> Iterator[tuple]:
    """What a word adds to the model: each letter with its contexts, and the contexts alone."""
    a = b = "\x02"
    for c in [*word, "\x03"]:
        yield from ((TRI, a, b, c), (PAIR, b, c), (ONE, c), (CONTEXT2, a, b), (CONTEXT1, b))
        a, b = b, c


def slot_counts(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """``(letters, words)``: what the words, with their numbers, add to both tables; keys met often are hashed once."""
    keys: Counter = Counter()
    for w, n in words.items():
        for k in letter_keys(w):
            keys[k] += n
    out = []
    for table in ({"".join(k): n for k, n in keys.items()}, {"w" + w: n for w, n in words.items()}):
        at = np.array([s for k in table for s in _slots(k)], dtype="int64")
        out.append(np.bincount(at, weights=np.repeat(np.array(list(table.values()), dtype="float64"), 2), minlength=LM_SIZE))
    return out[0], out[1]


class CharModel:
    """``P(letter | two letters before)`` backed off to one letter, to none and to a floor, mixed word by word with the
    corpus frequency of the whole word.  Both tables have a fixed ``LM_SIZE`` entries (4 MB each)."""

    def __init__(self, letters: np.ndarray, words: np.ndarray):
        self.letters, self.words = letters.astype("float32"), words.astype("float32")
        self.total = max(float(letters.sum()) / 10, 1.0)
        self.n_words = max(float(words.sum()) / 2, 1.0)
        self.known: dict[str, float] = {}
        self.counts: dict[tuple, float] = {}
        self.seen: set[str] = set()
        self.less: dict[tuple, int] = {}
        self.own: set[tuple[str, str]] = set()
        self.arcs: dict[tuple[str, str, str], float] = {}

    def count(self, key: tuple) -> float:
        got = self.counts.get(key)
        if got is None:
            x, y = _slots("".join(key))
            got = float(min(self.letters[x], self.letters[y]))
            if len(self.counts) < 500_000:
                self.counts[key] = got
        return got

    def count_less(self, key: tuple) -> float:
        return max(self.count(key) - self.less.get(key, 0), 0.0)

    def arc(self, a: str, b: str, c: str) -> float:
        own = (b, c) in self.own
        got = None if own else self.arcs.get((a, b, c))
        if got is None:
            n = self.count_less if own else self.count
            one = (n((ONE, c)) + 0.01) / (self.total + 0.01 * 100_000)
            two = (n((PAIR, b, c)) + 2 * one) / (n((CONTEXT1, b)) + 2)
            three = (n((TRI, a, b, c)) + 2 * two) / (n((CONTEXT2, a, b)) + 2)
            got = math.log(min(three, 1.0))
            if not own and len(self.arcs) < 500_000:
                self.arcs[a, b, c] = got
        return got

    def mixed(self, word: str, spelled: float) -> float:
        """Log probability of a word spelled with ``spelled`` by its letters: half of it by its corpus frequency."""
        own = max(float(min(self.words[i] for i in _slots("w" + word))) - (word in self.seen), 0.0) / self.n_words
        return math.log(0.5 * own + 0.5 * math.exp(max(spelled, -600.0)) + 1e-300)

    def look_at(self, text: str) -> None:
        """Leaves out what ``text`` itself has added to the counts: a garbled word is no evidence for itself."""
        words = _words(text)
        self.seen = set(words)
        self.less = Counter(k for w in words for k in letter_keys(w))
        self.own = {(k[1], k[2]) for k in self.less if k[0] == PAIR and (k[1] >= "\x80" or k[2] >= "\x80")}

    def score(self, word: str) -> float:
        got = self.known.get(word) if word not in self.seen else None
        if got is None:
            a = b = "\x02"
            spelled = 0.0
            for c in [*word, "\x03"]:
                spelled += self.arc(a, b, c)
                a, b = b, c
            got = self.mixed(word, spelled)
            if len(self.known) < 200_000 and word not in self.seen:
                self.known[word] = got
        return got


def _fold(text: str) -> str:
    """Form in which words are counted and scored: composed, lower case."""
    return unicodedata.normalize("NFC", text).lower()


def _words(text: str) -> list[str]:
    return [w for w in _fold(text).replace(",", " ").split(" ") if w]


#: Signs of a damaged span: what no spelling of a name holds.
@lru_cache(1 << 14)
def _odd(ch: str) -> bool:
    if "\uff01" <= ch <= "\uff5e" or ch == "\u212a":
        return False
    cat = unicodedata.category(ch)
    return ch == LOST or cat[0] in "SC" and ch not in "​‌‍‎‏⁠⁣﻿­" or cat in ("No", "Pi", "Pf", "Ps", "Pe", "Po", "Lm") and ch not in ",.'-’·()&/" or cat == "Lo" or ch in "ƒ"


def _decode_once(text: str, read: str, written: str) -> str | None:
    """``text`` encoded with ``read`` and decoded with ``written``; only maximal non-ASCII spans are touched (an
    undamaged span stays, as when two sources were joined), None where no span can be decoded."""
    table, out, done, at = _byte_map(read), [], False, 0
    for run in _RUNS.finditer(text):
        for part in _encodable(run.group(), table):
            got = ""
            if isinstance(part, bytes):
                try:
                    got = part.decode(written)
                except UnicodeDecodeError:
                    part = "".join(_char_map(read)[b] for b in part)
            if got and all(_plausible(c) for c in got):
                done = True
            elif got:
                part, got = "".join(_char_map(read)[b] for b in part), ""
            out.append((run.start(), run.end(), got or part))
    if not done:
        return None
    text_out, last = [], None
    for start, end, piece in out:
        if start != last:
            text_out.append(text[at:start])
            last, at = start, end
        text_out.append(piece)
    return "".join(text_out) + text[at:]


_RUNS = re.compile("[^\x00-\x7f\ufffd]+")

# Bytes that vanish after decoding: undefined ones, C1 controls, the no-break space and the soft hyphen.
@lru_cache(None)
def _dropped(page: str) -> frozenset[int]:
    return frozenset(b for b, c in _char_map(page).items() if "\x80" <= c <= "\xa0" or c == "\xad")


@lru_cache(None)
def _sequence_length(lead: int) -> int:
    return 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE1 <= lead <= 0xEF else 0


@lru_cache(None)
def _leads(page: str) -> frozenset[str]:
    """Characters that lead bytes of UTF-8 sequences are shown as."""
    return frozenset(c for c, b in _byte_map(page).items() if _sequence_length(b))


@lru_cache(4096)
def _completions(page: str, left: bytes) -> tuple[str, ...]:
    """Letters (and marks of names) whose UTF-8 bytes are ``left`` once those that vanish under ``page`` are gone, at
    least one; a control that vanishes is the empty text."""
    n = _sequence_length(left[0]) if left else 0
    if len(left) >= n or _char_map(page)[left[0]] >= "\u0250":  # a Cyrillic letter alone is a look-alike
        return ()
    out = set()
    for at in combinations(range(1, n), len(left) - 1):
        slots = [[left[1 + at.index(k)]] if k in at else [b for b in _dropped(page) if b < 0xC0] for k in range(1, n)]
        for rest in product(*slots):
            try:
                c = bytes([left[0], *rest]).decode()
            except UnicodeDecodeError:
                continue
            if c.isalpha() and (c < "\u0250" or "\u0370" <= c < "\u0530" or "\u1e00" <= c < "\u1f00") or c in "’‐‑–":
                out.add(c)
            elif "\x80" <= c <= "\xa0":
                out.add("")
    return tuple(sorted(out))


@lru_cache(4096)
def _lead(ch: str) -> bool:
    """A character that may be all that is left of a UTF-8 sequence."""
    return any(written == "utf-8" and ch in _byte_map(read) and _completions(read, bytes([_byte_map(read)[ch]])) for read, written, _ in CHANNELS)


_ALONE = re.compile("[^\x00-\x7f](?=[\x00-\x7f\ufffd]|$)")


def _decode_short(text: str, read: str, model: CharModel) -> str | None:
    """``text`` decoded as UTF-8 where bytes of a sequence have vanished or are U+FFFD: each such sequence may be every
    letter with the bytes left, and the model chooses.  None where no sequence is short."""
    if _leads(read).isdisjoint(text):
        return None
    table, slots, short, i = _byte_map(read), [], False, 0
    around = [c for c in text if c.isalpha() and c < "\x80"]
    capitals = bool(around) and all(c.isupper() for c in around)
    while i < len(text):
        n = _sequence_length(table.get(text[i], 0)) if text[i] >= "\x80" else 0
        k = i + 1
        while n and k < min(i + n, len(text)) and 0x80 <= table.get(text[k], 0) < 0xC0:
            k += 1
        raw = bytes(table[c] for c in text[i:k]) if n else b""
        if n and k == i + n:
            got = raw.decode(errors="ignore")
            slots.append([got] if got and _plausible(got) else [text[i:k]])
        elif fits := _completions(read, raw):
            upper = capitals or i == 0 or text[i - 1] in " ,.-'"
            cased = lambda c: c.isupper() == upper if c.isalpha() else c != "" or i > 0 and text[i - 1] >= "\x80"  # noqa: B023, E731
            fits = [c for c in fits if cased(c)]
            if n == 2 and text[k : k + 1] == " ":  # the no-break space as a blank
                whole = (raw + b"\xa0").decode()
                fits = [f"{c} " for c in fits or [text[i:k]]] + [c for c in [whole] if c.isalpha() and cased(c)]
                k += 1
            while k < len(text) and k < i + n and text[k] == LOST:
                k += 1
            slots.append(fits or [text[i:k]])
            short = short or slots[-1] != [text[i:k]]
        else:
            slots.append([text[i:k]])
        i = k
    return _best_path(slots, model) if short else None


def _best_path(slots: list[list[str]], model: CharModel) -> str:
    """The most probable text with one of its options in each slot: one best path per pair of last letters, however
    many; where a word ends its letters' probability is mixed with the frequency of the word."""
    start = ("\x02", "\x02")
    # state -> (score of the words before, score of the letters of this word, the text, where this word begins)
    paths: dict[tuple[str, str], tuple[float, float, str, int]] = {start: (0.0, 0.0, "", 0)}

    def ended(state: tuple[str, str], before: float, spelled: float, text: str, at: int) -> float:
        return before if state == start else before + model.mixed(_fold(text[at:]), spelled + model.arc(*state, "\x03"))

    for options in slots:
        nxt: dict[tuple[str, str], tuple[float, float, str, int]] = {}
        for state, (before, spelled, done, at) in paths.items():
            for option in options:
                s, b, w, text, first = state, before, spelled, done, at
                for c in option:
                    if c in " ,":
                        b, w, s = ended(s, b, w, text, first), 0.0, start
                        text += c
                        first = len(text)
                    else:
                        low = c.lower()[:1]
                        w += model.arc(*s, low)
                        s = (s[1], low)
                        text += c
                if s not in nxt or b + w > nxt[s][0] + nxt[s][1]:
                    nxt[s] = (b, w, text, first)
        paths = nxt
    return max((ended(s, *p), p[2]) for s, p in paths.items())[1]


def fill_lost(text: str, model: CharModel) -> str:
    """``text`` with each U+FFFD as a wildcard byte of the lattice: any letter of the pages for Latin scripts."""
    around = [c for c in text if c.isalpha() and c < "\x80"]
    capitals = bool(around) and all(c.isupper() for c in around)
    slots = []
    for k, ch in enumerate(text):
        upper = capitals or k == 0 or not text[k - 1].isalpha() and text[k - 1] != LOST
        slots.append([c for c in wildcard_letters() if c.isupper() == upper] if ch == LOST else [ch])
    return _best_path(slots, model)


@lru_cache(None)
def _char_map(page: str) -> dict[int, str]:
    return {b: c for c, b in _byte_map(page).items()}


def _encodable(run: str, table: dict[str, int]) -> list[bytes | str]:
    """``run`` as bytes where the page has its characters, the other characters as they are."""
    try:
        return [bytes([table[c] for c in run])]
    except KeyError:
        return [bytes(table[c] for c in p) if p[0] in table else p for p in ("".join(g) for _, g in groupby(run, table.__contains__))]


@lru_cache(4096)
def _plausible(ch: str) -> bool:
    """Latin, Greek and Cyrillic letters, and whatever a further mix-up may still turn into such letters."""
    return ch < "\u0530" or "\u1e00" <= ch <= "\u2bff" or ch == LOST


@lru_cache(65536)
def _isolated(text: str) -> bool:
    """True for a Latin name whose non-ASCII letters stand alone between ASCII letters and are the minority of each
    word: no channel can have made it (UTF-8 leaves runs of two or more, a Cyrillic page leaves whole words) unless
    bytes vanished (:func:`_decode_short`)."""
    run = 0
    for c in text:
        if c < "\x80":
            run = 0
            continue
        run += 1
        if run > 1 or _odd(c) or not "\xc0" <= c < "\u0250":
            return False
    for w in re.split("[ ,.'-]+", text):
        if w and 2 * sum(c >= "\x80" for c in w) >= len(w):
            return False
    return True


def _settled(text: str) -> bool:
    """No character is left that only damaged text holds."""
    return not any(_odd(c) for c in text if c >= "\x80")


def _mixed(text: str) -> int:
    """Number of words whose letters come from more than one script, or whose case flips inside the word."""
    bad = 0
    for w in text.replace(",", " ").replace("-", " ").replace("'", " ").split(" "):
        letters = [c for c in w if c.isalpha()]
        if any(p.islower() and q.isupper() for p, q in zip(letters, letters[1:])):
            bad += 1
        if len({("C" if "Ѐ" <= c < "԰" else "L") for c in letters}) > 1:
            bad += 1
    return bad


def hypotheses(text: str, model: CharModel, depth: int = 2) -> list[tuple[float, str, str]]:
    """``(log prior, restored text, channel path)`` of every chain of at most ``depth`` mix-ups."""
    out: list[tuple[float, str, str]] = []
    front = [(0.0, text, "")]
    for _ in range(depth):
        nxt = []
        for prior, t, path in front:
            for read, written, lp in CHANNELS:
                # one page for another leaves blanks and hidden characters alone, and whole words of one script
                if written != "utf-8" and (path.endswith(SHORT) or any(c >= "\x80" and unicodedata.category(c) in ("Zs", "Cf") for c in t)):
                    continue
                got = _decode_once(t, read, written)
                step = f"{path}>{read}:{written}" if path else f"{read}:{written}"
                if got is not None and got != t and (written == "utf-8" or not _mixed(got) and all(c < "\x80" or c.isalpha() for c in got)):
                    nxt.append((prior + lp, got, step))
                got = _decode_short(t, read, model) if written == "utf-8" else None
                if got is not None and got != t:
                    nxt.append((prior + lp + VANISHED, got, step + SHORT))
        best: dict[str, tuple[float, str, str]] = {}
        for h in nxt:
            if h[1] not in best or h[0] > best[h[1]][0]:
                best[h[1]] = h
        out.extend(best.values())
        # a further mix-up is only possible from a text that still shows damage
        # (only UTF-8 is met twice over), or the leading bytes of two-byte letters
        front = [h for h in best.values() if h[2].rstrip(SHORT).endswith("utf-8") and (any(c in "ÂÃÄÅÐÑ" for c in h[1]) or not _settled(h[1]))]
        if not front:
            break
    return out


def short_sequences(text: str, model: CharModel) -> list[tuple[float, str, str]]:
    """As :func:`hypotheses`, of a name that only a mix-up with vanished bytes can have made."""
    found = ((lp + VANISHED, _decode_short(text, read, model), f"{read}:{written}{SHORT}") for read, written, lp in CHANNELS if written == "utf-8")
    return [(prior, t, path) for prior, t, path in found if t is not None and t != text]


def _short_words(text: str, shown: str) -> list[tuple[int, str, str, str]]:
    """``(position, part, expression, shown part)`` of the words and separators of ``text``; where sequences are short
    the part has U+FFFD for each and the expression is that of the words they can have been, else it is empty."""
    out = []
    parts, seen = re.split("(?<=[ ,])|(?=[ ,])", text), re.split("(?<=[ ,])|(?=[ ,])", shown)
    if len(parts) != len(seen):  # a blank was half of a letter
        return out
    for k, part in enumerate(parts):
        rx, hole = "", ""
        for i, c in enumerate(part):
            fits = set()
            if c >= "\x80" and (i + 1 == len(part) or part[i + 1] < "\x80"):
                fits = {f.lower() for read, written, _ in CHANNELS if written == "utf-8" and c in _byte_map(read) for f in _completions(read, bytes([_byte_map(read)[c]])) if f.isalpha()}
            fits = {f for f in fits if len(f) == 1}
            rx += "[" + "".join(sorted(fits)) + "]" if fits else re.escape(c.lower())
            hole += LOST if fits else c
        alone = LOST in hole and len(part) > 2
        out.append((k, hole if alone else part, f"^{rx}$" if alone else "", seen[k]))
    return out


def decide(text: str, model: CharModel) -> tuple[bool, str, str, float, str, str, str]:
    """``(damaged, best text, channel path, log odds, text with its lost characters or "", text with its short
    sequences or "", channel path of these)`` of one name."""
    isolated = not text.isascii() and _isolated(text)
    if text.isascii() or isolated and not any(_lead(m.group()) for m in _ALONE.finditer(text)):
        return False, text, "", 0.0, "", "", ""
    lost = LOST in text
    model.look_at(text)

    def value(t: str) -> float:
        ws = _words(t.replace(LOST, ""))
        per = sum(model.score(w) for w in ws)
        odd = sum(_odd(c) for c in t if c >= "\x80" and c != LOST)
        return per - 8.0 * odd - 6.0 * _mixed(t)

    own = value(text)
    best = whole = (own, text, "")
    for prior, t, path in short_sequences(text, model) if isolated else hypotheses(text, model):
        v = value(t) + prior
        if v > best[0]:
            best = (v, t, path)
        if v > whole[0] and not path.endswith(SHORT):
            whole = (v, t, path)
    gain = best[0] - own
    restored = best[1]
    pattern = restored if LOST in restored else ""
    if pattern:
        restored = fill_lost(restored, model)
    damaged = lost or (best[2] != "" and gain > LEAST_ODDS) or not _settled(text)
    # what is left of short sequences in the best text without them: the corpus may know the words
    short = whole[1] if LOST not in whole[1] and (isolated or damaged) and any(_lead(m.group()) for m in _ALONE.finditer(whole[1])) else ""
    hint = (best[2] or "latin-1:utf-8").replace(SHORT, "") if short else ""
    return damaged, restored if damaged else text, best[2].replace(SHORT, "") if damaged else "", gain, pattern, short, hint


def char_model(names: DataFrame, column: str) -> CharModel:
    """Counts over all distinct values of ``column``; each task adds its own tables up first, and the sums have at most
    ``2 * LM_SIZE`` rows of two numbers, however large the corpus."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        held = np.zeros(2 * LM_SIZE)
        for pdf in batches:
            words.update(w for t in pdf[column] for w in _words(t))
            if len(words) > 200_000:
                held += np.concatenate(slot_counts(words))
                words = Counter()
        held += np.concatenate(slot_counts(words))
        at = np.flatnonzero(held)
        yield pd.DataFrame({"slot": at, "n": held[at].astype("int64")})

    table = names.mapInPandas(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(2 * LM_SIZE)
    counts[table["slot"].to_numpy(dtype="int64")] = table["n"].to_numpy()
    return CharModel(counts[:LM_SIZE], counts[LM_SIZE:])


def _mask(column):
    """Key under which a damaged word and its original meet: every non-ASCII character is one blank."""
    return F.regexp_replace(F.lower(column), "[^\\x00-\\x7f]", "?")


def restore_names(rows: DataFrame, column: str = "author_name", names_per_task: int = 2_000) -> DataFrame:
    """``(column, damaged, restored, channel)`` for each distinct non-null value of ``column``.

    ``restored`` is the value itself where it is not damaged.  Where bytes were lost, the words of the corpus that fit
    the damaged word letter by letter compete by frequency; with none, the best Viterbi filling stays.  So do the words
    that a short sequence can have been, against the word as it stands.
    """
    spark = rows.sparkSession
    names = cut(rows.select(column).where(F.col(column).isNotNull()).distinct(), "names")
    foreign = names.where(F.col(column).rlike("[^\\x00-\\x7f]"))
    counted = char_model(names, column)
    model = spark.sparkContext.broadcast((counted.letters, counted.words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = CharModel(*model.value)
        for pdf in batches:
            got = [decide(t, m) for t in pdf[column]]
            yield pd.DataFrame({
                column: pdf[column],
                "damaged": [g[0] for g in got],
                "restored": [g[1] for g in got],
                "channel": [g[2] for g in got],
                "pattern": [g[4] for g in got],
                "short": [g[5] for g in got],
                "hint": [g[6] for g in got],
            })

    # the decoder is CPU-bound and its rows are small: tasks by number of names, for by bytes they would be one task
    tasks = max(1, -(-foreign.count() // names_per_task))
    decoded = cut(foreign.repartition(tasks, column).mapInPandas(run, f"`{column}` string, damaged boolean, restored string, channel string, pattern string, short string, hint string"), "decoded")
    # words of undamaged names, with their frequency over the distinct names
    sound = names.join(decoded.where("damaged").select(column), column, "left_anti")
    words = sound.select(F.explode(F.array_distinct(F.split(F.lower(column), "[ ,]+"))).alias("word")).where("word rlike '[^\\\\x00-\\\\x7f]'")
    freq = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("mask", _mask(F.col("word")))
    lost = decoded.where(F.col("pattern") != "").select(column, F.posexplode(F.split("pattern", "(?<=[ ,])|(?=[ ,])")).alias("pos", "part"))
    holes = lost.where(F.col("part").contains(LOST)).withColumn("mask", _mask(F.col("part")))
    fits = holes.join(freq, "mask").where(F.expr("forall(transform(sequence(1, length(part)), i -> substring(part, i, 1) = '�' OR lower(substring(part, i, 1)) = substring(word, i, 1)), x -> x)"))
    best = fits.groupBy(column, "pos").agg(F.max_by("word", F.struct("n", "word")).alias("word"))
    upper = F.regexp_replace("part", "[^\\p{L}]", "")
    cased = F.when((F.length(upper) > 1) & (upper == F.upper(upper)), F.upper("word")).when(F.col("part").rlike("^(\\p{Ll}|�\\p{Lu})"), F.col("word")).otherwise(F.initcap(F.regexp_replace("word", "([-'])", "$1 ")))
    cased = F.regexp_replace(cased, "([-']) ", "$1")
    filled = (
        lost.join(best, [column, "pos"], "left")
        .withColumn("out", F.when(F.col("word").isNotNull(), cased).otherwise(F.col("part")))
        .groupBy(column)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"]), "").alias("filled"))
    )
    known = decoded.join(filled, column, "left").withColumn("restored", F.when(F.col("filled").isNotNull() & ~F.col("filled").contains(LOST), F.col("filled")).otherwise(F.col("restored")))

    # short sequences: words of the corpus that they can have been and that more names hold than the word as it stands
    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(n, *w) for n, bad, t, r in zip(pdf[column], pdf["damaged"], pdf["short"], pdf["restored"]) for w in _short_words(t, r if bad else t)]
            yield pd.DataFrame(got, columns=[column, "pos", "part", "rx", "shown"])

    bits = cut(decoded.where("short <> ''").select(column, "damaged", "short", "restored").mapInPandas(words_of, f"`{column}` string, pos int, part string, rx string, shown string"), "short")
    twins = bits.where("rx <> ''").withColumn("mask", _mask(F.col("part"))).join(freq, "mask").where("word rlike rx").groupBy(column, "pos").agg(F.max("n").alias("n"), F.max_by("word", F.struct("n", "word")).alias("word"))
    own = decoded.where("short <> ''").select(column, F.posexplode(F.split("short", "(?<=[ ,])|(?=[ ,])")).alias("pos", "own"))
    held = own.join(freq.select(F.col("word").alias("own_word"), F.col("n").alias("own_n")), F.lower("own") == F.col("own_word"), "left").select(column, "pos", "own_n")
    better = twins.join(held, [column, "pos"], "left").where("n > coalesce(own_n, 0)").select(column, "pos", "word")
    letters = F.expr(
        "array_join(transform(sequence(1, length(part)), i -> CASE WHEN substring(part, i, 1) <> '�' THEN substring(part, i, 1)"
        " WHEN i = 1 OR substring(part, i - 1, 1) IN ('-', '.', char(39)) OR part = upper(part) AND length(part) > 1 THEN upper(substring(word, i, 1)) ELSE substring(word, i, 1) END), '')"
    )
    mended = (
        bits.join(better, [column, "pos"], "left")
        .withColumn("out", F.when(F.col("word").isNotNull(), letters).otherwise(F.col("shown")))
        .groupBy(column)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"]), "").alias("mended"), F.count("word").alias("n"))
        .where("n > 0")
    )
    settled = known.join(mended.select(column, "mended"), column, "left").select(
        column,
        (F.col("damaged") | F.col("mended").isNotNull()).alias("damaged"),
        F.coalesce("mended", "restored").alias("restored"),
        F.when(F.col("mended").isNotNull() & (F.col("channel") == ""), F.col("hint")).otherwise(F.col("channel")).alias("channel"),
    )
    plain = names.where(~F.col(column).rlike("[^\\x00-\\x7f]")).select(column, F.lit(False).alias("damaged"), F.col(column).alias("restored"), F.lit("").alias("channel"))
    return settled.select(column, "damaged", "restored", "channel").unionByName(plain)


def garbled_rows(rows: DataFrame, id_col: str, column: str = "author_name") -> DataFrame:
    """``(id, column, restored, channel)`` of each row (once an id) whose value is wholly or partly garbled."""
    bad = restore_names(rows, column).where("damaged").select(column, "restored", "channel")
    return rows.select(id_col, column).distinct().join(bad, column).select(id_col, column, "restored", "channel")
