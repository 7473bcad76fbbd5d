"""Evaluation texts that leaked into a training corpus, and their removal.

A generalised suffix automaton is built over the normalised words of the test items and sent to the tasks; every
document is streamed through it once, and the length of the longest match is tracked word by word.  Where the match
holds a pair of words by which an item is nominated, the item becomes a candidate; it is confirmed by chaining the
runs it shares with the document in the item's order.  Spans above the limits of length or coverage are cut out.

No leak is lost by the nomination: passages of runs of two words and more that hold the share ``s`` of an item's ``n``
words hold at least ``ceil(s * n / 2)`` of its neighbouring pairs (a run of ``r`` words has ``r - 1 >= r / 2``).  So a
document that misses the rarest ``m`` of the item's ``d`` distinct pairs, with ``m = d - needed + 1``, cannot hold
enough of them: only these rarest pairs nominate, which spares the common ones (see :func:`nominating_pairs`).

Scale: the automaton grows with the items only.  Item tables above ``shard_words`` words are cut into shards, and the
corpus is streamed once a shard, so no task ever holds more.  The corpus is neither shuffled nor collected.

Defined results: null or empty documents and items give nothing; items of one word match it; repeated items are each
reported; a document is reported once an item; whole texts of any length are streamed.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# an element of markup: a name, then attributes with values only, so that "a <b and c> d" stays text
_TAG = r"</?[A-Za-z][A-Za-z0-9-]*(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))*\s*/?>"
_INVISIBLE = "­​-‏⁠-⁤﻿"
_PLAIN_WORD = re.compile(r"[^\W_]+")
_PIECE = re.compile(rf"(?P<tag>{_TAG})|(?P<word>(?:[^\W_]|[{_INVISIBLE}̀-ͯ]|&#?\w{{2,8}};)+)")
_HIDDEN = re.compile(f"[{_INVISIBLE}]")


def placed_words(text: str | None) -> list[tuple[str, int, int]]:
    """``(word, start, end)`` of each word of ``text``: without case, punctuation, spacing, markup, invisible
    characters and the accents' way of storage; the places are those of the text as it is."""
    if not text:
        return []
    if text.isascii() and "<" not in text and "&" not in text:
        return [(m.group(), m.start(), m.end()) for m in _PLAIN_WORD.finditer(text.lower())]
    out = []
    for m in _PIECE.finditer(text):
        piece = m.group("word")
        if piece is None:
            continue
        if not piece.isascii() or "&" in piece:
            piece = _HIDDEN.sub("", unicodedata.normalize("NFKC", html.unescape(piece)))
        out += [(w, m.start(), m.end()) for w in _PLAIN_WORD.findall(piece.lower())]
    return out


def words(text: str | None) -> list[str]:
    if text and text.isascii() and "<" not in text and "&" not in text:
        return _PLAIN_WORD.findall(text.lower())
    return [w for w, _, _ in placed_words(text)]


def nominating_pairs(items: list[tuple[int, list[str]]], share: float) -> dict[tuple[str, str], list[int]]:
    """``pair of words -> items`` it nominates: of each item the rarest pairs, as many as a document that holds
    ``share`` of the item's words cannot all miss."""
    pairs = {key: Counter(zip(ws, ws[1:])) for key, ws in items}
    seen = Counter(p for c in pairs.values() for p in c)
    out: dict[tuple[str, str], list[int]] = defaultdict(list)
    for key, ws in items:
        needed = math.ceil(share * len(ws) / 2)
        held = 0
        # the commonest pairs may all be held without the needed number being reached
        for p in sorted(pairs[key], key=lambda p: (-seen[p], p)):
            held += pairs[key][p]
            if held >= needed:
                out[p].append(key)
    return dict(out)


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences; each state knows the items nominated by the last two words of
    what it has read."""

    def __init__(self, items: list[tuple[int, list[str]]], share: float = 0.5):
        self.words = dict(items)
        self.step: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for _, ws in items:
            last = 0
            for w in ws:
                last = self._add(last, w)
        nominated = nominating_pairs(items, share)
        self.single: dict[str, list[int]] = defaultdict(list)
        for key, ws in items:
            if len(ws) == 1:
                self.single[ws[0]].append(key)
        self.nominees: dict[int, list[int]] = {}
        for (a, b), keys in nominated.items():
            self.nominees[self.step[self.step[0][a]][b]] = keys
        # every longer match ends in a pair: the state of that pair is the last ancestor that is longer than one word
        self.pair_state = [0] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if self.length[v] >= 2:
                up = self.link[v]
                self.pair_state[v] = v if self.length[up] < 2 else self.pair_state[up]

    def _state(self, length: int) -> int:
        self.step.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, w: str, q: int) -> int:
        c = self._state(self.length[p] + 1)
        self.step[c] = dict(self.step[q])
        self.link[c] = self.link[q]
        self.link[q] = c
        while p != -1 and self.step[p].get(w) == q:
            self.step[p][w] = c
            p = self.link[p]
        return c

    def _add(self, last: int, w: str) -> int:
        known = self.step[last].get(w)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, w, known)
        cur = self._state(self.length[last] + 1)
        p = last
        while p != -1 and w not in self.step[p]:
            self.step[p][w] = cur
            p = self.link[p]
        if p != -1:
            q = self.step[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return cur

    def matches(self, ws: list[str]) -> Iterator[tuple[int, int, int]]:
        """``(position, length, state)`` of the longest match that ends at each word, where there is one."""
        step, link, length = self.step, self.link, self.length
        root = step[0]
        v = n = 0
        for i, w in enumerate(ws):
            nxt = step[v].get(w)
            if nxt is None:
                if w not in root:
                    v = n = 0
                    continue
                while w not in step[v]:
                    v = link[v]
                n = length[v]
                nxt = step[v][w]
            v = nxt
            n += 1
            yield i, n, v

    def candidates(self, ws: list[str]) -> tuple[set[int], int]:
        """Items nominated by ``ws``, and the longest match in words."""
        found: set[int] = set()
        longest = 0
        pair_state, nominees, single = self.pair_state, self.nominees, self.single
        for i, n, v in self.matches(ws):
            if n >= 2:
                longest = max(longest, n)
                keys = nominees.get(pair_state[v])
                if keys is not None:
                    found.update(keys)
            if single:
                found.update(single.get(ws[i], ()))
        return found, longest


class _Highest:
    """Fenwick tree: the best (value, what) among positions below a limit."""

    def __init__(self, n: int):
        self.best: list[tuple[int, int]] = [(0, -1)] * (n + 1)

    def raise_to(self, at: int, value: tuple[int, int]) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at] = value
            at += at & -at

    def below(self, at: int) -> tuple[int, int]:
        top = (0, -1)
        while at > 0:
            top = max(top, self.best[at])
            at -= at & -at
        return top


def passages(text: list[str], item: list[str], text_at: dict[str, list[int]] | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """``(runs, words of the item held)``: the chain of common runs ``(text place, item place, words)`` that rises in
    both sequences and holds most of the item.

    Runs have two words or more, so that single words in common by chance do not count (nor does a word alone between
    two changed ones).  A matched pair of neighbouring words either goes on with its run or starts behind the best
    chain that ends before it, so the search takes one Fenwick step a common pair - never the square of the runs.
    """
    if len(item) == 1:
        at = next((i for i, w in enumerate(text) if w == item[0]), None)
        return ([], 0) if at is None else ([(at, 0, 1)], 1)
    at: dict[tuple[str, str], list[int]] = defaultdict(list)
    for j in range(len(item) - 1):
        at[item[j], item[j + 1]].append(j)
    held = set(item)
    # best chain whose last word is (i, j): value, where its run began, the link to the chain before
    links: list[tuple[int, int, int, int]] = []  # text place, item place, words, link before
    tree = _Highest(len(item))
    waiting: dict[int, list[tuple[int, tuple[int, int]]]] = defaultdict(list)
    last: dict[int, tuple[int, int]] = {}
    top = (0, -1)
    previous = -2
    places = sorted({p for w in held for q in text_at.get(w, ()) for p in (q - 1, q)}) if text_at is not None else range(len(text) - 1)
    for i in places:
        if i < 0 or i + 1 >= len(text):
            continue
        if i != previous + 1:
            last = {}
        # chains that end before place i may be gone on with from here
        for p in sorted(k for k in waiting if k < i):
            for j, value in waiting.pop(p):
                tree.raise_to(j, value)
        now: dict[int, tuple[int, int]] = {}
        for j in at.get((text[i], text[i + 1]), ()):
            before = tree.below(j)
            fresh = (before[0] + 2, -1)
            run = last.get(j - 1)
            if run is not None and run[0] + 1 >= fresh[0]:
                i0, j0, n, link = links[run[1]]
                links.append((i0, j0, n + 1, link))
                value = (run[0] + 1, len(links) - 1)
            else:
                links.append((i, j, 2, before[1]))
                value = (fresh[0], len(links) - 1)
            now[j] = value
            waiting[i + 1].append((j + 1, value))
            top = max(top, value)
        last, previous = now, i
    runs = []
    k = top[1]
    while k >= 0:
        i, j, n, k = links[k]
        runs.append((i, j, n))
    runs.reverse()
    return runs, max(top[0], 0)


def _spans(ws: list[tuple[str, int, int]], runs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Character spans of the runs; runs with a single word between them are one span."""
    out: list[list[int]] = []
    end = -9
    for i, _, n in runs:
        if out and i - end <= 2:
            out[-1][1] = ws[i + n - 1][2]
        else:
            out.append([ws[i][1], ws[i + n - 1][2]])
        end = i + n - 1
    return [(a, b) for a, b in out]


_LEAK = "doc_id bigint, item_id bigint, shared_words int, item_words int, longest_run int, spans array<struct<start:int,end:int>>"


def leaked_items(documents: DataFrame, items: DataFrame, min_share: float = 0.5, shard_words: int = 2_000_000) -> DataFrame:
    """``(doc_id, item_id, shared_words, item_words, longest_run, spans)`` of each document that holds at least
    ``min_share`` of an item's words in passages in the item's order; ``spans`` are character places of the passages.

    ``documents`` needs ``doc_id, text``, ``items`` ``item_id, item_text``.  Items come to the driver shard by shard
    (they are the query set; a shard is the unit sent to the tasks).
    """
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text").where(F.length("text") > 0)
    out: DataFrame | None = None
    for shard in _shards(items, shard_words):
        automaton = spark.sparkContext.broadcast(SuffixAutomaton(shard, min_share))

        def scan(batches: Iterator[pd.DataFrame], automaton=automaton) -> Iterator[pd.DataFrame]:
            sam = automaton.value
            for pdf in batches:
                rows = []
                for doc, text in zip(pdf["doc_id"], pdf["text"]):
                    ws = words(text)
                    keys, _ = sam.candidates(ws)
                    if not keys:
                        continue
                    text_at: dict[str, list[int]] = defaultdict(list)
                    for i, w in enumerate(ws):
                        text_at[w].append(i)
                    placed = None
                    for key in sorted(keys):
                        item = sam.words[key]
                        if len(item) > 1 and sum(w in text_at for w in item) < min_share * len(item):
                            continue
                        runs, shared = passages(ws, item, text_at)
                        if shared >= min_share * len(item):
                            placed = placed or placed_words(text)
                            spans = [{"start": a, "end": b} for a, b in _spans(placed, runs)]
                            rows.append((doc, key, shared, len(item), max(n for _, _, n in runs), spans))
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "shared_words", "item_words", "longest_run", "spans"])

        got = texts.mapInPandas(scan, _LEAK)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], _LEAK)


def _shards(items: DataFrame, shard_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Items with words, in lists of about ``shard_words`` words."""
    shard: list[tuple[int, list[str]]] = []
    room = shard_words
    for r in items.select("item_id", "item_text").where("item_text IS NOT NULL").toLocalIterator():
        ws = words(r.item_text)
        if not ws:
            continue
        if len(ws) > room and shard:
            yield shard
            shard, room = [], shard_words
        shard.append((r.item_id, ws))
        room -= len(ws)
    if shard:
        yield shard


def remove_leaks(documents: DataFrame, leaks: DataFrame, min_run: int = 8, min_share: float = 0.5, max_removed: float = 0.5) -> DataFrame:
    """``(doc_id, clean_text, removed_chars, removed_spans, dropped)`` of each document with leaks.

    Spans of a leak are cut out when its longest run has ``min_run`` words or it covers ``min_share`` of the item; a
    document that loses more than ``max_removed`` of its characters is ``dropped`` (its ``clean_text`` is null), for
    what is left of it is no text.  Documents without leaks are not touched and not listed.
    """
    over = leaks.where((F.col("longest_run") >= min_run) | (F.col("shared_words") >= F.col("item_words") * min_share))
    spans = over.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, found in zip(pdf["doc_id"], pdf["text"], pdf["spans"]):
                kept, at, removed, count = [], 0, 0, 0
                for s in found:
                    start, end = max(int(s["start"]), at), int(s["end"])
                    if end <= at:
                        continue
                    count += int(s["start"]) >= at
                    kept.append(text[at:start])
                    removed += end - start
                    at = end
                kept.append(text[at:])
                gone = removed > max_removed * len(text)
                rows.append((doc, None if gone else "".join(kept), removed, count, gone))
            yield pd.DataFrame(rows, columns=["doc_id", "clean_text", "removed_chars", "removed_spans", "dropped"])

    joined = documents.select("doc_id", "text").join(spans, "doc_id")
    return joined.mapInPandas(run, "doc_id bigint, clean_text string, removed_chars bigint, removed_spans int, dropped boolean")
