import itertools
import random

import pytest

from entiforge.llm import splits as sl


def test_closest_subset_against_brute_force():
    rnd = random.Random(4)
    for _ in range(60):
        items = [rnd.randint(1, 9) for _ in range(9)]
        sizes = sorted({(s, items.count(s)) for s in items})
        target = rnd.randint(1, sum(items))
        got = sl.closest_subset(sizes, target)
        assert all(k <= items.count(s) for s, k in got.items())
        best = min(abs(target - sum(c)) for r in range(10) for c in itertools.combinations(items, r))
        assert abs(target - sum(s * k for s, k in got.items())) == best
    assert sl.closest_subset([], 5) == {} and sl.closest_subset([(3, 1)], 0) == {}


@pytest.mark.parametrize("scale", [1, 50])
def test_totals(scale, monkeypatch):
    monkeypatch.setattr(sl, "MAX_UNITS", 1 << 12)
    sizes = [(1, 1500 * scale), (2, 200 * scale), (7, 30), (900, 3), (4000, 1)]
    total = sum(s * n for s, n in sizes)
    plan = sl.choose_totals(sizes, {"train": 0.8, "validation": 0.1, "test": 0.1})
    used = {}
    for counts in plan.values():
        for s, n in counts.items():
            used[s] = used.get(s, 0) + n
    assert used == dict(sizes)
    for part in ("validation", "test"):
        assert abs(sum(s * n for s, n in plan[part].items()) - 0.1 * total) <= 1


def tables(spark, rows):
    r = spark.createDataFrame([(i,) for i, _, _ in rows] + [(1,)], "record bigint")
    b = spark.createDataFrame([(i, b) for i, b, _ in rows if b != "absent"], "record bigint, block string")
    a = spark.createDataFrame([(i, a) for i, _, a in rows if a is not None] * 2, "record bigint, author bigint")
    return r, b, a


def test_splits_against_brute_force(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice([None, "absent", *[f"b{k}" for k in range(150)]]), rnd.choice([-1, -1, None, *range(120)])) for i in range(1, 900)]
    r, b, a = tables(spark, rows)
    got = {x.record: (x.group_key, x.split) for x in sl.split_records(r, b, a).collect()}
    assert set(got) == {i for i, _, _ in rows}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, blk, aut in rows:
        for tie in ([f"B{blk}"] if blk not in (None, "absent") else []) + ([f"A{aut}"] if aut is not None and aut >= 0 else []):
            parent[find(f"R{i}")] = find(tie)
    groups = {}
    for i, _, _ in rows:
        groups.setdefault(find(f"R{i}"), set()).add(got[i])
    assert all(len(v) == 1 for v in groups.values()) and len({next(iter(v))[0] for v in groups.values()}) == len(groups)
    lead = {x.block: x.group_block for x in sl.block_groups(b, a).collect()}
    for x, y in itertools.combinations([f"b{k}" for k in range(150)], 2):
        if f"B{x}" in parent and f"B{y}" in parent:
            assert (find(f"B{x}") == find(f"B{y}")) == (lead.get(x, x) == lead.get(y, y))


def test_edges(spark):
    r, b, a = tables(spark, [(1, None, -1), (2, "absent", None)])
    assert {x.split for x in sl.split_records(r, b, a).collect()} <= {"train", "validation", "test"}
    assert sl.split_records(r.where("record > 9"), b, a).count() == 0
    with pytest.raises(ValueError):
        sl.split_records(r, b, a, {"train": 0.5, "test": 0.4})


def test_coarse_totals_lack_less_than_the_smallest_group_left(monkeypatch):
    rnd = random.Random(9)
    monkeypatch.setattr(sl, "MAX_UNITS", 1000)
    for _ in range(40):
        sizes = sorted({rnd.randint(1, 400): rnd.randint(1, 300) for _ in range(rnd.randint(2, 40))}.items())
        total = sum(s * n for s, n in sizes)
        plan = sl.choose_totals(sizes, {"train": 0.8, "validation": 0.1, "test": 0.1})
        for s, n in sizes:
            assert sum(p.get(s, 0) for p in plan.values()) == n and all(p.get(s, 0) >= 0 for p in plan.values())
        for k, split in enumerate(sorted(plan, key=lambda p: {"train": 2, "validation": 0, "test": 1}[p])[:2]):
            held = sum(s * n for s, n in plan[split].items())
            rest = [s for s, n in sizes if n > sum(plan[x].get(s, 0) for x in ("validation", "test")[: k + 1])]
            assert int(0.1 * total) - min(rest, default=total) < held <= int(0.1 * total)


def test_hot_block_and_hot_null_author(spark):
    rows = [(i, "hot" if i % 2 else None, 7 if i == 1 or i == 2 else None) for i in range(1, 3000)]
    r, b, a = tables(spark, rows)
    got = {x.record: x.group_key for x in sl.split_records(r, b, a).collect()}
    assert len(got) == 2999 and {got[i] for i in range(1, 3000, 2)} == {"b:hot"} == {got[2]} and len({got[i] for i in range(4, 3000, 2)}) == 1498


def test_record_in_two_blocks(spark):
    b = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (3, "x"), (4, "z")], "record bigint, block string")
    a = spark.createDataFrame([(4, 1)], "record bigint, author bigint")
    got = {x.record: x.group_key for x in sl.record_groups(b.select("record"), b, a).collect()}
    assert got == {1: "b:x", 2: "b:x", 3: "b:x", 4: "b:z"}


def test_totals_do_not_depend_on_the_limit(monkeypatch):
    rnd = random.Random(12)
    parts = {"train": 0.8, "validation": 0.1, "test": 0.1}
    for _ in range(30):
        sizes = sorted({rnd.randint(1, 60): rnd.randint(1, 9) for _ in range(rnd.randint(1, 12))}.items())
        monkeypatch.setattr(sl, "MAX_UNITS", 1 << 20)
        plan = sl.choose_totals(sizes, parts)
        for units in (0, 7, 50):
            monkeypatch.setattr(sl, "MAX_UNITS", units or 1)
            assert sl.choose_totals(sizes, parts) == plan
