"""Scores for abusive, hateful or sexual content by non-negative positive-unlabelled learning.

Statements are scored, not whole texts: a text is cut into sentences, long sentences into overlapping windows of
words, and a text's score is that of its worst window.  A linear classifier over hashed words, word pairs and letter
n-grams is trained in numpy with the non-negative PU risk ``prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))``:
positives are the windows of the confirmed posts that carry the verdict (chosen by a classifier that has not seen the
post) and the windows of any document on which all cross-validated classifiers agree or that a decision list over words,
word pairs and hidden letters, counted in the whole corpus in each turn, finds; unlabelled are windows drawn from
all documents by strata of their margins, and those of the posts judged harmless.  No word is known beforehand: all
weights, and the words that disguises (stars, digits for letters, swapped or spaced letters) are undone to, come from
the judged posts and the corpus.

The class prior and the limit of a statement come from margins held out by cross-validation over posts and from counts
of the margins of *all* documents; the start of the limit is the best-bin rule, the score limit with the smallest ratio
of the share of unlabelled documents above it to the share of held-out positives above it; documents are scored by the
emptiest place between that and where harmless text begins.

Training is bounded by ``max_reviewed``, ``unlabelled_docs`` (the start) and ``PER_BIN`` windows of each stratum of the
margins; the strata are drawn from all windows of all documents in each turn, and their draws are weighted by the
strata's sizes.  Every document is scored whole, in its partition, with the weights (``2^16`` numbers a model)
broadcast.  Rates per source are one small aggregate.

Defined results: null and empty texts score 0; repeated documents are scored alike; texts of any length are scored
window by window; without confirmed posts every score is 0.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entiforge.llm.visual import LOOK_ALIKE
from entiforge.operators.sampling import smallest_hashes
from entiforge.plans.lineage import cut, release

HASH_BITS = 16
DIM = (1 << HASH_BITS) + 1
WINDOW, STRIDE = 10, 5
SHORTEST = 4
NGRAMS = (4, 5)
NGRAM_WEIGHT = 0.5
#: Weight of a window of a judged harmless post among the unlabelled ones: such posts were judged for being doubtful.
HARMLESS_WEIGHT = 20.0
#: Weight of the ridge against the class prior.
RIDGE = 5e-4
#: Bins of the margin in the distributed count of unlabelled windows.
BINS = np.linspace(-20, 20, 401)
#: Bins in a stratum of windows, and how many distinct windows of each are drawn for training.
STRATUM, PER_BIN = 2, 400
#: Size of the table that tells how usual a word pair is.
USUAL_BITS = 20

_PLAIN = str.maketrans({alike: form.lower() for form, alikes in LOOK_ALIKE.items() for alike in alikes if form.isalpha()})
# Digits and signs typed for letters.
_LEET = str.maketrans("0134578@$", "oieastbas")
_HIDDEN = re.compile("[­​-‏⁠-⁤﻿]")
_SPACED = re.compile(r"(?<![^\W\d_])[^\W\d_](?:[ .\-_*][^\W\d_]){2,}(?![^\W\d_])")
_REPEAT = re.compile(r"([a-z])\1{2,}")
_TOKEN = re.compile(r"[a-z0-9@$*\x01]*[a-z][a-z0-9@$*\x01]*")
_SENTENCE = re.compile(r"[\r\n]+|(?<=[.!?])\s+")
#: Stands in a word where hidden characters or gaps between its letters were taken out.
MARK = "\x01"


def sentences(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text or "") if s and not s.isspace()]


@lru_cache(1 << 16)
def _token(tok: str) -> str:
    if MARK in tok:
        plain = tok.replace(MARK, "")
        return _token(plain) + MARK * (MARK in tok.strip(MARK))
    if tok.isalpha() or "*" in tok:
        return tok
    return tok.translate(_LEET)


def sentence_words(sentence: str) -> list[str]:
    """Words in one plain form: hidden characters, look-alikes, accents, case, spaced letters and runs of one letter
    are undone, digits inside words are read as letters.  Words whose letters were hidden or spaced end in a mark."""
    s = sentence.replace(MARK, " ")
    if not s.isascii():
        s = _HIDDEN.sub(MARK, unicodedata.normalize("NFKC", s)).translate(_PLAIN)
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    s = _SPACED.sub(lambda m: m.group(0)[0] + MARK + m.group(0)[2::2], s.lower())
    return [_token(t) for t in _TOKEN.findall(_REPEAT.sub(r"\1", s))]


def windows(words: list[str]) -> list[list[str]]:
    if len(words) <= WINDOW + STRIDE // 2:
        return [words] if words else []
    return [words[at : at + WINDOW] for at in range(0, len(words) - STRIDE, STRIDE)]


def _scale(words: list[str]) -> float:
    """Long windows hold more chance words, very short ones next to no evidence."""
    return max(len(words), SHORTEST) ** -0.5


def _slot(text: str) -> int:
    return zlib.crc32(text.encode()) & (DIM - 2)


@lru_cache(1 << 17)
def word_slots(word: str) -> tuple[tuple[int, float], ...]:
    """Features of one word: itself and its letter n-grams, whose weights add up to ``NGRAM_WEIGHT`` squared."""
    padded = f"<{word}>"
    grams = [padded[i : i + n] for n in NGRAMS for i in range(len(padded) - n + 1)] if len(word) > 3 else []
    part = NGRAM_WEIGHT / max(len(grams), 1) ** 0.5
    return ((_slot("w " + word), 1.0), *((_slot("g " + g), part) for g in grams))


WRITTEN = (b"m hidden", b"m stars")


def written(tok: str) -> list[bytes]:
    """How a word is written: with hidden or spaced letters, with stars for letters."""
    return [w for w, so in zip(WRITTEN, (tok.endswith(MARK), "*" in tok.rstrip(MARK).strip("*"))) if so]


def disguises(tok: str) -> tuple[tuple[int, float], ...]:
    """Features of how a word is written."""
    return tuple((zlib.crc32(m) & (DIM - 2), 1.0) for m in written(tok))


@dataclass
class Model:
    """Weights, the limit of a statement's margin, the class prior, and the words that disguises are undone to."""

    weights: np.ndarray
    limit: float = 0.0
    prior: float = 0.0
    telling: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.swapped = {}
        for w in sorted(self.telling, key=lambda x: self.telling[x]):
            for i in range(len(w) - 1):
                t = w[:i] + w[i + 1] + w[i] + w[i + 2 :]
                if t not in self.telling:
                    self.swapped[t] = w
        self.cache: dict[str, tuple[str, float]] = {}

    def undisguise(self, tok: str) -> str:
        tok = tok.rstrip(MARK)
        if tok in self.telling:
            return tok
        if "*" in tok:
            fits = [w for w in self.telling if len(w) == len(tok) and all(a in ("*", b) for a, b in zip(tok, w))]
            return max(fits, key=lambda w: (self.telling[w], w), default=tok.replace("*", ""))
        if tok in self.swapped:
            return self.swapped[tok]
        return tok[1:] if tok[1:] in self.telling else tok

    def word(self, tok: str) -> tuple[str, float]:
        got = self.cache.get(tok)
        if got is None:
            w = self.undisguise(tok)
            got = w, float(sum(self.weights[s] * v for s, v in (*word_slots(w), *disguises(tok))))
            if len(self.cache) < 1 << 18:
                self.cache[tok] = got
        return got

    def margin(self, words: list[str]) -> float:
        """Margin of one window."""
        total, last = 0.0, "<"
        for tok in words:
            w, g = self.word(tok)
            total += g + self.pair(last, w)
            last = w
        return float(self.weights[-1]) + total * _scale(words)

    def pair(self, a: str, b: str) -> float:
        return float(self.weights[_slot(f"p {a} {b}")])


class _Windows:
    """Windows as counts of features, with the two products the training needs; words are expanded to their letter
    n-grams once per distinct word."""

    def __init__(self, rows: list[list[str]], model: Model, weights: np.ndarray | None = None):
        self.n = len(rows)
        self.share = (np.ones(self.n) if weights is None else weights) / max(self.n if weights is None else weights.sum(), 1)
        vocabulary: dict[tuple, int] = {}
        pairs: dict[str, int] = {}
        at_w, at_p, row, scale = [], [], [], []
        for k, words in enumerate(rows):
            last = "<"
            for tok in words:
                w = model.undisguise(tok)
                at_w.append(vocabulary.setdefault((w, disguises(tok)), len(vocabulary)))
                at_p.append(pairs.setdefault(f"{last} {w}", len(pairs)))
                last = w
            row += [k] * len(words)
            scale.append(_scale(words))
        self.row, self.at_w, self.at_p, self.scale = np.array(row, dtype="int64"), np.array(at_w, dtype="int64"), np.array(at_p, dtype="int64"), np.array(scale)
        self.vocabulary, self.n_words, self.n_pairs = vocabulary, len(vocabulary), len(pairs)
        self.pair_slot = np.array([_slot("p " + p) for p in pairs], dtype="int64")
        slots = [(k, s, v) for (w, how), k in vocabulary.items() for s, v in (*word_slots(w), *how)]
        self.of, self.slot, self.x = (np.array([t[i] for t in slots], dtype=d) for i, d in ((0, "int64"), (1, "int64"), (2, "float64")))

    def dot(self, w: np.ndarray) -> np.ndarray:
        if not self.n_words:
            return np.full(self.n, w[-1])
        g = np.bincount(self.of, weights=w[self.slot] * self.x, minlength=self.n_words)
        return w[-1] + self.scale * np.bincount(self.row, weights=g[self.at_w] + w[self.pair_slot][self.at_p], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(DIM)
        if self.n_words:
            each = (g * self.scale)[self.row]
            of_word = np.bincount(self.at_w, weights=each, minlength=self.n_words)
            out += np.bincount(self.slot, weights=of_word[self.of] * self.x, minlength=DIM)
            out += np.bincount(self.pair_slot, weights=np.bincount(self.at_p, weights=each, minlength=self.n_pairs), minlength=DIM)
        out[-1] = g.sum()
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def nnpu_fit(positive: _Windows, unlabelled: _Windows, prior: float, rounds: int = 80, rate: float = 0.05, ridge: float = 1e-6, start: np.ndarray | None = None) -> np.ndarray:
    """Weights minimising the non-negative PU risk under the logistic loss.  Where the estimated risk of the negatives
    falls below zero, the step follows that part alone, backwards, as in the published algorithm."""
    w = np.zeros(DIM) if start is None else start.copy()
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(DIM), np.zeros(DIM)
    for t in range(1, rounds + 1):
        zp, zu = positive.dot(w), unlabelled.dot(w)
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = unlabelled.share @ np.logaddexp(0, zu) - prior * (positive.share @ np.logaddexp(0, zp))
        of_negative = unlabelled.back(su * unlabelled.share) - prior * positive.back(sp * positive.share)
        g = prior * positive.back((sp - 1) * positive.share) + of_negative if negative >= 0 else -of_negative
        g[:-1] += ridge * w[:-1]
        g[-1] = 0.0
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def bin_counts(margins: np.ndarray) -> np.ndarray:
    """How many margins lie in each bin; the outer bins hold what lies beyond."""
    return np.histogram(np.clip(margins, BINS[0], BINS[-1]), BINS)[0]


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> tuple[float, int]:
    """``(share of positives among the unlabelled, bin)`` by the best-bin rule: the least upper bound, over bins, of the
    ratio of both shares from that bin on.  ``unlabelled`` are counts a bin, ``positive`` held-out margins."""
    above_p = np.cumsum(bin_counts(positive)[::-1])[::-1] / len(positive)
    above_u = np.cumsum(unlabelled[::-1])[::-1] / max(unlabelled.sum(), 1)
    slack = np.sqrt(np.log(4 / delta) / 2 / max(unlabelled.sum(), 1)) + np.sqrt(np.log(4 / delta) / 2 / len(positive))
    bound = np.where(above_p > 0, (above_u + (1 + gamma) * slack) / np.maximum(above_p, 1e-9), np.inf)
    at = int(np.argmin(bound))
    return float(above_u[at] / above_p[at]), at


@dataclass
class Fitted:
    """A model with the held-out margins of the judged posts, from which the limit is set (:func:`statement_limit`),
    and the documents it was trained on with the table of their windows."""

    model: Model
    positive: np.ndarray
    harmless: np.ndarray
    documents: DataFrame | None = None
    table: DataFrame | None = None


def cut_up(text: str | None) -> list[list[str]]:
    return [w for s in sentences(text) for w in windows(sentence_words(s))]


def pair_hashes(words: list[str]) -> list[int]:
    return [zlib.crc32(f"p {a} {b}".encode()) for a, b in zip(["<", *words], words)]


def usual_pairs(rows: list[list[str]]) -> np.ndarray:
    """How usual word pairs are in drawn text: logarithms of their counts, hashed."""
    n = np.zeros(1 << USUAL_BITS)
    for w in rows:
        for h in set(pair_hashes(w)):
            n[h & (len(n) - 1)] += 1
    return np.log1p(n).astype("float32")


def usual(words: list[str], table: np.ndarray) -> float:
    return float(np.mean([table[h & (len(table) - 1)] for h in pair_hashes(words)]))


class Scorer:
    """Margins of many windows (words joined by blanks) under models with the same telling words, without a loop over
    windows: words and pairs are looked up once per distinct one."""

    def __init__(self, weights: np.ndarray, telling: dict[str, float], usual: np.ndarray | None = None):
        self.weights, self.usual, self.base = weights, usual, Model(weights[:, -1], telling=telling)
        self.known: dict[str, tuple[str, np.ndarray]] = {}

    def word(self, tok: str) -> tuple[str, np.ndarray]:
        got = self.known.get(tok)
        if got is None:
            w = self.base.undisguise(tok)
            got = w, sum(self.weights[s] * v for s, v in (*word_slots(w), *disguises(tok)))
            if len(self.known) < 1 << 16:
                self.known[tok] = got
        return got

    def __call__(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Margins, one column a model, and how usual the pairs of each window are."""
        vocabulary: dict[str, int] = {}
        at, size = [], np.zeros(len(rows), dtype="int64")
        for k, r in enumerate(rows):
            words = r.split(" ")
            size[k] = len(words)
            at += [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        n = len(vocabulary) + 1
        found = [self.word(t) for t in vocabulary]
        names = [w for w, _ in found] + ["<"]
        at, row = np.array(at, dtype="int64"), np.repeat(np.arange(len(rows)), size)
        last = np.r_[n - 1, at[:-1]]
        last[np.r_[0, np.cumsum(size)[:-1]]] = n - 1
        pairs, which = np.unique(last * n + at, return_inverse=True)
        hashes = np.array([zlib.crc32(f"p {names[k // n]} {names[k % n]}".encode()) for k in pairs.tolist()], dtype="int64")
        self.last = list(vocabulary), names, at, row, hashes, which
        of_word, of_pair = np.array([g for _, g in found]), self.weights[hashes & (DIM - 2)]
        scale = np.maximum(size, SHORTEST) ** -0.5
        z = np.stack([self.weights[-1, m] + scale * np.bincount(row, weights=of_word[at, m] + of_pair[which, m], minlength=len(rows)) for m in range(self.weights.shape[1])], axis=1)
        if self.usual is None:
            return z, np.zeros(len(rows))
        return z, np.bincount(row, weights=self.usual[hashes & (len(self.usual) - 1)][which], minlength=len(rows)) / size


    def places(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(window, place in the sorted hashes)`` of each occurrence of a feature in the windows scored last."""
        tokens, names, at, row, hashes, which = self.last
        out = []
        of_word = np.array([zlib.crc32(f"w {w}".encode()) for w in names[:-1]], dtype="int64")
        for of, index, rows in ((of_word, at, row), (hashes, which, row)):
            k = np.searchsorted(features, of)
            known = (k < len(features)) & (features[np.minimum(k, len(features) - 1)] == of)
            here = known[index]
            out.append((rows[here], k[index][here]))
        marked = [(i, zlib.crc32(m)) for i, t in enumerate(tokens) for m in written(t)]
        for i, h in marked:
            k = int(np.searchsorted(features, h))
            if k < len(features) and features[k] == h:
                rows = row[at == i]
                out.append((rows, np.full(len(rows), k)))
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


@dataclass
class Company:
    """Features (hashes of words, word pairs and ways of writing) of known statements, and in how many windows of the
    corpus each occurs, by strata of the least margin under all models."""

    features: np.ndarray
    telling: np.ndarray
    held: np.ndarray | None = None

    def keep(self, limit: float, least: int = 5, share: float = 0.5) -> np.ndarray:
        """A decision list: the features most windows with which lie above the limit."""
        above = self.held[:, bin_of(np.array([limit]))[0] // STRATUM + 1 :].sum(axis=1)
        return self.features[(above >= least) & (above > share * self.held.sum(axis=1))]


def feature_hashes(words: list[str], model: Model) -> set[int]:
    w = [model.undisguise(t) for t in words]
    return {zlib.crc32(f"w {x}".encode()) for x in w} | set(pair_hashes(w)) | {zlib.crc32(m) for t in words for m in written(t)}


def supported(rows: list, weight: dict[str, float], sure: set[str], telling: set[int], model: Model, share: float = 0.25) -> set[str]:
    """Those of the windows that hold a telling feature and are of a kind with statements.

    One feature may occur by chance in harmless windows of one kind, which then nearly all hold the same.  So a window
    counts if it shares a word pair with windows of which half hold something besides the feature that most of them
    hold, and not all the same, and if a ``share`` of the windows drawn with the pair hold some or are ``sure``; or if
    its letters are hidden, which no kind of windows explains, or it reads like such a window.
    """

    def differ(sets: list[frozenset]) -> bool:
        most = max(Counter(f for x in sets for f in x).items(), key=lambda t: (t[1], t[0]))[0]
        rest = [x - {most} for x in sets if len(x) > (most in x)]
        return 2 * len(rest) >= len(sets) and any(rest[0].isdisjoint(x) for x in rest[1:])

    marks = set(map(zlib.crc32, WRITTEN)) & telling
    held = {w: feature_hashes(w.split(" "), model) for w in {r.window for r in rows} | set(weight)}
    pairs = {w: set(pair_hashes([model.undisguise(t) for t in w.split(" ")])) - telling for w in held}
    seen, some, kinds = Counter(), Counter(), defaultdict(list)
    for w, n in weight.items():
        for g in pairs[w]:
            seen[g] += n
            some[g] += n * (w in sure or not telling.isdisjoint(held[w]))
    found = {r.window: frozenset(held[r.window] & telling) for r in rows}
    for w, with_ in found.items():
        if with_:
            for g in pairs[w]:
                kinds[g].append(with_)
    open_ = {g for g, sets in kinds.items() if some[g] >= share * seen[g] and differ(sets)}
    read = {w: tuple(model.undisguise(t) for t in w.split(" ")) for w in found}
    hidden = {read[w] for w, with_ in found.items() if with_ & marks}
    return {w for w, with_ in found.items() if read[w] in hidden or with_ and not open_.isdisjoint(pairs[w])}


def bin_of(z: np.ndarray) -> np.ndarray:
    return np.clip(((z - BINS[0]) / (BINS[1] - BINS[0])).astype("int64"), 0, len(BINS) - 2)


def window_table(documents: DataFrame) -> DataFrame:
    """``(doc_id, windows)``: the windows of each document, words joined by blanks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[str]] = {}
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                rows: list[str] = []
                for s in sentences(text):
                    got = known.get(s)
                    if got is None:
                        got = [" ".join(w) for w in windows(sentence_words(s))]
                        if len(known) < 1 << 15:
                            known[s] = got
                    rows += got
                out.append(rows)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "windows": out})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, windows array<string>")


def _slices(batches: Iterator[pd.DataFrame], docs: int = 1000) -> Iterator[tuple[pd.DataFrame, list[str], np.ndarray]]:
    """Documents, their windows, and the place of each window's document."""
    for pdf in batches:
        for i in range(0, len(pdf), docs):
            part = pdf.iloc[i : i + docs]
            yield part, [w for ws in part["windows"] for w in ws], np.repeat(np.arange(len(part)), [len(ws) for ws in part["windows"]])


class _Drawn:
    """Distinct windows with the smallest hashes in each bin."""

    def __init__(self, limit: int):
        self.limit, self.bins = limit, {}

    def add(self, at: int, window: str, low: float) -> None:
        held = self.bins.setdefault(at, {})
        held[window] = (zlib.crc32(window.encode()), low)
        if len(held) > 4 * self.limit:
            self.prune(at)

    def prune(self, at: int) -> None:
        self.bins[at] = dict(sorted(self.bins[at].items(), key=lambda t: (t[1][0], t[0]))[: self.limit])

    def rows(self, kind: str) -> list[tuple]:
        for at in self.bins:
            self.prune(at)
        return [(kind, at, h, w, low, 0) for at, held in self.bins.items() for w, (h, low) in held.items()]


def survey(table: DataFrame, models: list[Model], pairs: np.ndarray, guard: float, floor: float, company: Company | None = None) -> tuple[np.ndarray, np.ndarray, list, list]:
    """One pass over the windows of all documents: ``(documents a bin by their worst window, windows a bin, drawn
    windows of every bin, drawn windows that may be statements)``.

    Bins are of the last model's margin; the draw of each stratum (:data:`PER_BIN` distinct windows with the smallest
    hashes) stands for all windows of its bins, so windows near the limit are seen however rare they are.  What may be
    a statement lies above ``floor`` under every model and is no more usual than ``guard``; it is drawn by bins of its
    least margin.  Windows that hold a telling feature of the ``company`` are drawn the same way, whatever their margin
    (rows of kind ``kin`` among the last ones), and its features are counted.
    """
    company = company or Company(np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64"))
    features, telling = company.features, company.telling
    shared = table.sparkSession.sparkContext.broadcast((np.stack([m.weights for m in models], axis=1), models[-1].telling, pairs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = Scorer(*shared.value)
        in_docs, in_windows = np.zeros(len(BINS) - 1, dtype="int64"), np.zeros(len(BINS) - 1, dtype="int64")
        any_, sure, kin = _Drawn(PER_BIN), _Drawn(PER_BIN), _Drawn(PER_BIN)
        held = np.zeros((len(features), len(BINS) // STRATUM + 1), dtype="int32")
        bound: dict[int, int] = {}
        for part, rows, of in _slices(batches):
            if not rows:
                continue
            zs, common = score(rows)
            z, least = zs[:, -1], zs.min(axis=1)
            low = np.where(common <= guard, least, -np.inf)
            worst = np.full(len(part), -np.inf)
            np.maximum.at(worst, of, z)
            in_docs += np.bincount(bin_of(worst[np.isfinite(worst)]), minlength=len(BINS) - 1)
            at = bin_of(z)
            in_windows += np.bincount(at, minlength=len(BINS) - 1)
            hashes = np.array([zlib.crc32(r.encode()) for r in rows], dtype="int64")
            for b in np.unique(at // STRATUM).tolist():
                # only hashes below the largest one kept so far can enter
                here = np.flatnonzero((at // STRATUM == b) & (hashes <= bound.get(b, 1 << 32)))
                for k in here[np.argsort(hashes[here], kind="stable")][: 4 * PER_BIN].tolist():
                    any_.add(b, rows[k], float(low[k]))
                if len(any_.bins.get(b, ())) >= PER_BIN:
                    any_.prune(b)
                    bound[b] = max(h for h, _ in any_.bins[b].values())
            for k in np.flatnonzero(low > floor).tolist():
                sure.add(int(bin_of(low[k : k + 1])[0]) // STRATUM, rows[k], float(low[k]))
            if len(features):
                row, place = score.places(features)
                np.add.at(held, (place, bin_of(least)[row] // STRATUM), 1)
            if len(telling):
                for k in np.unique(score.places(telling)[0]).tolist():
                    kin.add(int(at[k]) // STRATUM, rows[k], float(low[k]))
        out = [*any_.rows("any"), *sure.rows("sure"), *kin.rows("kin")]
        out += [("held", int(b), int(k), None, None, int(held[k, b])) for k, b in zip(*np.nonzero(held))]
        for kind, counts in (("docs", in_docs), ("windows", in_windows)):
            out += [(kind, int(b), 0, None, None, int(counts[b])) for b in np.flatnonzero(counts)]
        yield pd.DataFrame(out, columns=["kind", "bin", "h", "window", "low", "n"])

    got = cut(table.mapInPandas(run, "kind string, bin int, h bigint, window string, low double, n bigint"), "survey")
    counts = {"docs": np.zeros(len(BINS) - 1), "windows": np.zeros(len(BINS) - 1), "held": np.zeros((len(features), len(BINS) // STRATUM + 1))}
    for r in got.where("window IS NULL").groupBy("kind", "bin", "h").agg(F.sum("n").alias("n")).collect():  # one row a bin, or a stratum of a feature
        counts[r.kind][(r.h, r.bin) if r.kind == "held" else r.bin] = r.n
    # a task gives at most PER_BIN rows of a stratum
    order = Window.partitionBy("kind", "bin").orderBy("h", "window")
    drawn = got.where("window IS NOT NULL").dropDuplicates(["kind", "window"]).withColumn("k", F.row_number().over(order)).where(F.col("k") <= PER_BIN)
    rows = sorted(drawn.select("kind", "bin", "h", "window", "low").collect(), key=lambda r: (r.bin, r.h, r.window))
    release(got)
    company.held = counts["held"]
    return counts["docs"], counts["windows"], [r for r in rows if r.kind == "any"], [r for r in rows if r.kind in ("sure", "kin")]


def train(toxic_posts: list[str], clean_posts: list[str], unlabelled_texts: list[str], table: DataFrame, turns: int = 4, folds: int = 4, clear: float = 0.5) -> Fitted:
    """Classifier from confirmed posts, drawn text and passes over all windows of the corpus.

    Each turn trains ``folds`` models without a part of the posts and one with all.  The window of a post that carries
    the verdict is chosen by the model that has not seen the post; where that finds none, it is the one with the least
    usual word pairs.  Windows of any document that lie ``clear`` above the limit under every model, and are no more
    usual than the chosen ones, join the positives with at most the weight of the posts, so statements unlike the posts
    are reached through those already found.  So do windows that a decision list finds whatever their margin: it holds
    the words, pairs and ways of writing, none of them in a judged harmless post, most windows with which already lie
    that far above the limit (:class:`Company`, :func:`supported`).  It reaches kinds of statements that no post shows
    through what they share with known ones.  Posts that stay behind weigh more in the next turn.
    """
    posts = [p for p in map(cut_up, toxic_posts) if p]
    clean = [p for p in map(cut_up, clean_posts) if p]
    rows = [w for t in unlabelled_texts for w in cut_up(t)]
    if not posts or not rows:
        return Fitted(Model(np.r_[np.zeros(DIM - 1), -30.0]), np.zeros(0), np.zeros(0))
    pairs = usual_pairs(rows)

    def fits(chosen: list[list[list[str]]], hard: np.ndarray, more: list[list[str]], others: list[list[str]], weight: np.ndarray, telling: dict[str, float], prior: float) -> list[Model]:
        harmless = HARMLESS_WEIGHT * max(1.0, weight.sum() / 60_000)
        out = []
        for f in range(folds + 1):  # the last model leaves nothing out
            m = Model(np.zeros(DIM), telling=telling)
            own = [(w, hard[i]) for i, p in enumerate(chosen) if f == folds or i % folds != f for w in p]
            joined = [w for w in more if f == folds or zlib.crc32(" ".join(w).encode()) % folds != f]
            share = np.array([h for _, h in own])
            positive = _Windows([w for w, _ in own] + joined, m, np.r_[share, np.full(len(joined), min(1.0, share.sum() / max(len(joined), 1)))])
            judged = [w for i, p in enumerate(clean) if f == folds or i % folds != f for w in p]
            unlabelled = _Windows(others + judged, m, np.r_[weight, np.full(len(judged), harmless)])
            out.append(Model(nnpu_fit(positive, unlabelled, prior, ridge=RIDGE * prior), prior=prior, telling=telling))
        return out

    harmless_features = np.array(sorted({h for p in clean for w in p for h in feature_hashes(w, Model(np.zeros(DIM), telling={}))}), dtype="int64")
    telling_features, known = np.zeros(0, dtype="int64"), []
    held_out = lambda models, of: np.array([max(map(models[i % folds].margin, p)) for i, p in enumerate(of)])
    hard = np.ones(len(posts))
    start = [w for w in rows if zlib.crc32(" ".join(w).encode()) % 4 == 0] or rows
    models = fits(posts, hard, [], start, np.ones(len(start)), {}, 0.003)
    for turn in range(turns):
        held, harmless = held_out(models, posts), held_out(models, clean)
        above = harmless.max(initial=-np.inf)
        chosen = [max(p, key=models[i % folds].margin) if held[i] > above else min(p, key=lambda w: usual(w, pairs)) for i, p in enumerate(posts)]
        if turn:
            z = np.array([models[-1].margin(w) for w in chosen])
            hard = np.clip(hard * np.exp(np.clip((np.median(z) - z - 1) / 2, 0, 1)), 1, 8)
        guard = float(np.quantile([usual(w, pairs) for w in chosen], 0.95))
        often = Counter(h for w in [*chosen, *known] for h in feature_hashes(w, models[-1]))
        company = Company(np.setdiff1d([h for h, n in often.items() if n > 1], harmless_features).astype("int64"), telling_features)
        in_docs, in_windows, drawn, sure = survey(table, models, pairs, guard, float(max(above, BINS[0])), company)
        limit = statement_limit(Fitted(models[-1], held, harmless), in_docs)
        top = max(above, limit + clear) if turn else np.inf  # the first models are too coarse to trust
        telling_features = company.keep(top) if turn else telling_features
        telling_set = set(telling_features.tolist())
        size, stands_for = Counter(r.bin for r in drawn), np.bincount(np.arange(len(BINS) - 1) // STRATUM, weights=in_windows)
        joins = {r.window for r in sure if r.low > top}
        joins |= supported([r for r in [*drawn, *sure] if r.window not in joins], {r.window: stands_for[r.bin] / size[r.bin] for r in drawn}, joins, telling_set, models[-1])
        known = [w.split(" ") for w in sorted(joins)]
        kept = [r for r in drawn if not (r.low > top or r.window in joins)]
        prior = float(np.clip(in_windows[bin_of(np.array([limit]))[0] :].sum() / max(in_windows.sum(), 1), 1e-4, 0.05))
        held_words = Counter(t for w in [*chosen, *known] for t in {models[-1].undisguise(t) for t in w} if len(t) > 3 and t.isalpha())
        telling = {t: g for t, n in held_words.items() if n > 1 and (g := models[-1].word(t)[1]) > 1.0}
        models = fits([[w] for w in chosen], hard, known, [r.window.split(" ") for r in kept], np.array([stands_for[r.bin] / size[r.bin] for r in kept]), telling, prior)
    return Fitted(models[-1], held_out(models, posts), held_out(models, clean))


def statement_limit(fitted: Fitted, counts: np.ndarray, steep: float = 4.0, valley: bool = False) -> float:
    """Margin from which a window counts as a statement, from the worst margins of all documents, counted in bins.

    Down from the best bin, documents thin out to a few a bin while they hold statements, and their number rises
    steeply where harmless text begins: the limit is the lower edge of the last bin with at most ``steep`` times the
    mean number of those above it, and never below the margin that nine in ten held-out harmless posts stay under.  With
    ``valley``, it is the emptiest place from there up to the best bin.
    """
    if not len(fitted.positive):
        return 0.0
    _, at = best_bin(fitted.positive, counts)
    best = at
    low = BINS[0] if not len(fitted.harmless) else float(np.quantile(fitted.harmless, 0.9))
    # two neighbouring bins at a time, for few documents scatter
    while at > 1 and BINS[at - 1] >= low:
        passed = counts[at : int(np.searchsorted(BINS, np.median(fitted.positive)))]
        if counts[at - 2 : at].sum() / 2 > steep * max(passed.mean() if len(passed) else 0.0, 1.0):
            break
        at -= 1
    if valley:
        # the emptiest place between, over five bins
        near = np.convolve(counts, np.ones(5), "same")[at : best + 1]
        at += int(np.argmin(near))
    filled = np.flatnonzero(counts[at:])
    # where no document lies between harmless and other ones, the middle of the gap
    return float((BINS[at] + BINS[at + filled[0]]) / 2) if len(filled) else float(BINS[at])


def fit(reviewed: DataFrame, documents: DataFrame, max_reviewed: int = 20_000, unlabelled_docs: int = 4_000) -> Fitted:
    """Trains on at most ``max_reviewed`` judged posts, the windows of ``unlabelled_docs`` documents to start with, and
    draws from every stratum of all windows; what reaches the driver is bounded by these numbers alone."""
    judged = reviewed.where("post_text IS NOT NULL AND verdict IS NOT NULL").select("sample_id", "post_text", F.lower(F.trim("verdict")).alias("v"))
    judged = smallest_hashes(judged, judged.count(), ["sample_id"], max_reviewed).collect()
    texts = documents.where("text IS NOT NULL").select("doc_id", "text")
    # counting all rows reads no text; that some are null is within the fourfold margin
    drawn = smallest_hashes(texts, documents.count(), ["doc_id"], unlabelled_docs).collect()
    table = cut(window_table(documents), "windows")
    fitted = train([r.post_text for r in judged if r.v != "none"], [r.post_text for r in judged if r.v == "none"], [r.text for r in drawn], table)
    fitted.documents, fitted.table = documents, table
    return fitted


def document_margins(table: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, n_windows, worst, telling)``: number of windows, the highest margin (null without windows) and all
    margins above the prior odds of each document."""
    shared = table.sparkSession.sparkContext.broadcast((model.weights[:, None], model.telling))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, floor = Scorer(*shared.value), float(shared.value[0][-1, 0])
        for part, rows, of in _slices(batches):
            z = score(rows)[0][:, 0] if rows else np.zeros(0)
            worst, count = np.full(len(part), -np.inf), np.bincount(of, minlength=len(part))
            np.maximum.at(worst, of, z)
            above: list[list[float]] = [[] for _ in range(len(part))]
            for k in np.flatnonzero(z > floor).tolist():
                above[of[k]].append(float(z[k]))
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_windows": count, "worst": pd.Series(np.where(count > 0, worst, np.nan)), "telling": above})

    return table.mapInPandas(run, "doc_id bigint, n_windows int, worst double, telling array<double>").withColumn("worst", F.nanvl("worst", F.lit(None).cast("double")))


def score_documents(documents: DataFrame, fitted: Fitted) -> DataFrame:
    """``(doc_id, score, n_windows, toxic_windows)`` of every document; ``score`` is above 0.5 where its worst window
    is a statement, and 0 without any window.  The limit comes from the margins of all documents."""
    table = fitted.table if fitted.documents is documents else window_table(documents)
    margins = cut(document_margins(table, fitted.model), "margins")
    width = float(BINS[1] - BINS[0])
    slot = F.least(F.greatest(F.floor((F.col("worst") - float(BINS[0])) / width), F.lit(0)), F.lit(len(BINS) - 2))
    counts = np.zeros(len(BINS) - 1)
    for r in margins.where("worst IS NOT NULL").groupBy(slot.cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n")).toLocalIterator():  # one row a bin
        counts[r.b] = r.n
    limit = statement_limit(fitted, counts, valley=True)
    odds = F.col("worst") - limit
    trained = F.lit(bool(len(fitted.positive)))
    return margins.select(
        "doc_id",
        F.when(trained & odds.isNotNull(), 1 / (1 + F.exp(-odds))).otherwise(0.0).alias("score"),
        "n_windows",
        F.when(trained, F.size(F.filter("telling", lambda z: z > limit))).otherwise(0).alias("toxic_windows"),
    )


def source_rates(documents: DataFrame, scored: DataFrame) -> DataFrame:
    """``(source, n_docs, toxic_docs, toxic_rate, mean_score)``: one small aggregate, a null source is a group."""
    j = documents.select("doc_id", "source").join(scored, "doc_id")
    return j.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum((F.col("toxic_windows") > 0).cast("bigint")).alias("toxic_docs"),
        F.avg((F.col("toxic_windows") > 0).cast("double")).alias("toxic_rate"),
        F.avg("score").alias("mean_score"),
    )
