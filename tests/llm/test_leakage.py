import random

import pytest

from entiforge.llm import leakage as lk


def common(a, b, n):
    return {tuple(a[i : i + n]) for i in range(len(a) - n + 1)} & {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}


def test_automaton_against_brute_force():
    rnd = random.Random(6)
    for _ in range(30):
        items = [(k, [rnd.choice("abcd") for _ in range(rnd.randint(1, 14))]) for k in range(5)]
        sam = lk.SuffixAutomaton(items)
        text = [rnd.choice("abcde") for _ in range(60)]
        got = {i: n for i, n, _ in sam.matches(text)}
        for i in range(len(text)):
            best = max((n for _, ws in items for n in range(1, len(ws) + 1) if n <= i + 1 and tuple(text[i - n + 1 : i + 1]) in common(ws, ws, n)), default=0)
            assert got.get(i, 0) == best
        assert max(got.values(), default=0) >= sam.candidates(text)[1]


def slow_share(text, item):
    """Most words of the item in rising runs of two words and more, by trying all ends."""
    n, m = len(text), len(item)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            top = max(best[i - 1][j], best[i][j - 1])
            k = 0
            while k < min(i, j) and text[i - 1 - k] == item[j - 1 - k]:
                k += 1
                if k >= 2:
                    top = max(top, best[i - k][j - k] + k)
            best[i][j] = top
    return best[n][m]


def test_no_leak_is_lost_by_nomination():
    rnd = random.Random(7)
    hits = 0
    for _ in range(150):
        vocab = "abcdefgh"[: rnd.randint(3, 8)]
        items = [(k, [rnd.choice(vocab) for _ in range(rnd.randint(2, 14))]) for k in range(4)]
        sam = lk.SuffixAutomaton(items, 0.5)
        text = [w if rnd.random() < 0.8 else "x" for w in rnd.choice(items)[1]] + [rnd.choice(vocab) for _ in range(20)]
        keys, _ = sam.candidates(text)
        for key, item in items:
            slow = slow_share(text, item)
            runs, held = lk.passages(text, item)
            assert held == slow == sum(n for _, _, n in runs)
            assert all(text[i : i + n] == item[j : j + n] for i, j, n in runs)
            assert all(a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1] for a, b in zip(runs, runs[1:]))
            if slow >= 0.5 * len(item):
                hits += 1
                assert key in keys
    assert hits > 100


def test_words():
    assert lk.words("if a <b and c> d or i<5") == ["if", "a", "b", "and", "c", "d", "or", "i", "5"]
    assert lk.words("f&uuml;r u\u0308ber <a href='x y'>l\u00e4nger</a>") == ["für", "über", "länger"]
    text = "Ein <b>W\u00f6rt</b> &amp; zwei"
    assert [text[a:b] for _, a, b in lk.placed_words(text)] == ["Ein", "W\u00f6rt", "zwei"]
    assert lk.words("> A <b>b</b>&nbsp;C-d​e, 12!") == ["a", "b", "c", "de", "12"]
    assert lk.words(None) == lk.words("") == []


def test_passages():
    item = [f"w{i}" for i in range(60)]
    held = lambda text: lk.passages(text, item)[1]
    assert held(item) == 60 and held([]) == 0 and lk.passages(item, [])[1] == 0
    assert held([w if i % 3 else "x" for i, w in enumerate(item)]) == 40
    assert held([w if i % 4 else "x" for i, w in enumerate(item)]) == 45
    assert held(["x", *item[:29], "y"]) == 29 and held(["x", *item[:31], "y"]) == 31
    assert held(item[30:] + item[:30]) == 30
    shuffled = item[:]
    random.Random(1).shuffle(shuffled)
    assert held(shuffled) < 10


def test_one_word_item():
    assert lk.passages(["a", "b"], ["b"]) == ([(1, 0, 1)], 1) and lk.passages(["a"], ["b"])[1] == 0


@pytest.mark.parametrize("shard", [2_000_000, 60])
def test_leaks(spark, shard):
    rnd = random.Random(2)
    vocab = [f"word{i}" for i in range(400)]
    items = {k: [rnd.choice(vocab) for _ in range(30)] for k in range(8)}
    items[8] = items[0]
    noise = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    changed = [w if i % 6 else "other" for i, w in enumerate(items[1])]
    docs = {
        1: noise(40) + "\n> " + " ".join(items[0]).upper().replace(" ", ", ") + "\n" + noise(20), 2: " ".join(changed), 3: " ".join(items[2][:8]), 4: noise(5000) + " " + " ".join(items[3][8:]),
        5: None, 6: "", 7: " ".join(sorted(items[4])), 8: " ".join(f"<i>{w}</i>" for w in items[5]), 9: noise(60),
        10: " ".join(w if i % 3 else "other" for i, w in enumerate(items[6])), 11: " ".join(items[7][:14]), 12: " ".join(items[7][:16]) + " tail" * 40,
        13: " ".join(w if i % 4 else "other" for i, w in enumerate(items[6])),
    }
    d = spark.createDataFrame([(k, v, 1) for k, v in docs.items()], "doc_id bigint, text string, item_id bigint")
    i = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] + [(50, None), (51, "")], "item_id bigint, item_text string")
    got = lk.leaked_items(d, i, shard_words=shard)
    rows = {(r.doc_id, r.item_id): r for r in got.collect()}
    assert set(rows) == {(1, 0), (1, 8), (2, 1), (4, 3), (8, 5), (10, 6), (12, 7), (13, 6)}
    assert rows[12, 7].shared_words == 16 and rows[10, 6].shared_words == 20
    clean = {r.doc_id: r for r in lk.remove_leaks(d, got, max_removed=0.9).collect()}
    assert set(clean) == {1, 2, 4, 8, 10, 12, 13} and clean[12].clean_text == " tail" * 40 and clean[2].dropped
    assert clean[1].removed_spans == 1 and clean[1].clean_text.count("word") == 60 and "WORD" not in clean[1].clean_text
    assert lk.remove_leaks(d, got, max_removed=0.5).where("doc_id = 12 AND NOT dropped").count() == 1
    assert lk.leaked_items(d.where("doc_id < 0"), i).count() == 0
    assert lk.leaked_items(d, i.where("item_id < 0")).count() == 0
