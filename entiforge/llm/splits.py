"""Train, validation and test splits that keep related records together.

Blocks and authors tie records to each other.  Tied blocks are found with hooking and shortcutting over parent arrays
(:mod:`entiforge.operators.components`) on the distinct (block, block) edges that authors make; records without any
tie are groups of their own.  The numbers of groups of each size - at most ``sqrt(2 * rows)`` distinct sizes - are all
the driver sees: subset-sum bitsets over these multiplicities choose the split totals that come closest to the
proportions, and groups of one size are dealt out by their rank.

Defined results: null blocks, labels below 0 and rows absent from either table tie nothing; repeated rows count once;
an empty table gives an empty result; the same input gives the same splits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entiforge.operators.components import connected_components
from entiforge.operators.hotkeys import hot_keys, rank_within, salted
from entiforge.plans.lineage import cut

#: Up to this target every bitset is kept to read a subset back; above, some are kept and those between made again.  This
#: bounds memory alone: the subsets are the same.
MAX_UNITS = 1 << 20


def block_groups(blocks: DataFrame, authors: DataFrame, by_record: bool = False) -> DataFrame:
    """``(block, group_block)`` for each block that shares an author with another one, directly or through a chain;
    ``group_block`` is the smallest key of the group.  ``blocks(record, block)``, ``authors(record, author)``.  With
    ``by_record`` a record that stands in several blocks ties them too."""
    known = authors.where("author >= 0").select("record", "author")
    placed = blocks.where("block IS NOT NULL")
    ties = placed.join(known, "record").select("author", "block").distinct()
    first = ties.groupBy("author").agg(F.min("block").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = ties.join(first, "author").where("block <> lead").select(F.col("lead").alias("src"), F.col("block").alias("dst"))
    if by_record:
        edges = edges.unionByName(placed.groupBy("record").agg(F.min("block").alias("src"), F.max("block").alias("dst")).where("src <> dst").select("src", "dst"))
        between = placed.join(placed.groupBy("record").agg(F.min("block").alias("src"), F.count(F.lit(1)).alias("n")).where("n > 2"), "record").where("block <> src")
        edges = edges.unionByName(between.select("src", F.col("block").alias("dst")))
    return connected_components(edges).select(F.col("vertex").alias("block"), F.col("component").alias("group_block"))


def record_groups(records: DataFrame, blocks: DataFrame, authors: DataFrame) -> DataFrame:
    """``(record, group_key)`` for each distinct record of ``records(record)``.

    Groups are settled on distinct blocks and authors; records meet them in joins that spread hot blocks and groups,
    and records without a block or author (the majority) take part in no join on it.
    """
    groups = block_groups(blocks, authors, by_record=True)
    r = records.select("record").distinct()
    b = blocks.where("block IS NOT NULL").groupBy("record").agg(F.min("block").alias("block"))
    a = authors.where("author >= 0").groupBy("record").agg(F.min("author").alias("author"))
    wide = cut(r.join(b, "record", "left").join(a, "record", "left"), "wide")
    of_block = cut(wide.where("block IS NOT NULL").select("block").distinct().join(groups, "block", "left").select("block", F.coalesce("group_block", "block").alias("own")), "of_block")
    in_block = cut(salted(wide.where("block IS NOT NULL"), of_block, "block", hot_keys(wide.select("block"), "block")), "in_block")
    # an author's block group: any block of theirs leads to it
    of_author = in_block.where("author IS NOT NULL").groupBy("author").agg(F.min("own").alias("author_block"))
    loose = wide.where("block IS NULL")
    known = loose.where("author IS NOT NULL")
    led = salted(known, known.select("author").distinct().join(of_author, "author", "left"), "author", hot_keys(known, "author"))
    key = lambda kind, value: F.concat(F.lit(f"{kind}:"), F.col(value).cast("string")).alias("group_key")
    return (
        in_block.select("record", key("b", "own"))
        .unionByName(led.select("record", F.coalesce(key("b", "author_block"), key("a", "author")).alias("group_key")))
        .unionByName(loose.where("author IS NULL").select("record", key("r", "record")))
    )


def closest_subset(sizes: list[tuple[int, int]], target: int, over: bool = True) -> dict[int, int]:
    """``size -> how many groups`` of the subset whose total comes closest to ``target``, from below only without
    ``over``; ``sizes`` has (size, number).

    Numbers are cut into powers of two, so each size adds ``log`` shifts of one big-integer bitset.  To read the subset
    back, bitsets are kept (all, or one in ``sqrt(steps)`` for large targets, see :data:`MAX_UNITS`).
    """
    if target <= 0 or not sizes:
        return {}
    steps: list[tuple[int, int]] = []
    for size, number in sorted(sizes, reverse=True):
        number = min(number, target // size + 1)
        k = 1
        while number > 0:
            take = min(k, number)
            steps.append((size, take))
            number -= take
            k *= 2
    limit = (1 << (2 * target + 2)) - 1
    every = 1 if target <= MAX_UNITS else max(1, math.isqrt(len(steps)))

    def reach(full: int, part: list[tuple[int, int]]) -> Iterator[int]:
        """Totals within reach before each step of ``part``, and after the last."""
        yield full
        for size, take in part:
            full = (full | full << (size * take)) & limit
            yield full

    kept, full = [], 1
    for at in range(0, len(steps), every):
        kept.append(full)
        for full in reach(full, steps[at : at + every]):
            pass
    low = full & ((1 << (target + 1)) - 1)
    below = low.bit_length() - 1
    above = full >> (target + 1)
    best = below
    if above and over:
        up = target + 1 + ((above & -above).bit_length() - 1)
        if up - target < target - below:
            best = up
    chosen: dict[int, int] = {}
    for k in reversed(range(len(kept))):
        part = steps[k * every : (k + 1) * every]
        for (size, take), before in zip(reversed(part), reversed(list(reach(kept[k], part))[:-1])):
            if not before >> best & 1:
                chosen[size] = chosen.get(size, 0) + take
                best -= size * take
    return chosen


def choose_totals(sizes: list[tuple[int, int]], proportions: dict[str, float]) -> dict[str, dict[int, int]]:
    """``split -> size -> how many groups``: the smaller splits are filled first, what is left goes to the largest.

    One rule at any number of rows: split by split, no choice of groups comes closer to the share from below; only where
    every group is larger than the share may a split take more.
    """
    total = sum(s * n for s, n in sizes)
    left = dict(sizes)
    out: dict[str, dict[int, int]] = {}
    order = sorted(proportions, key=lambda p: proportions[p])
    for split in order[:-1]:
        groups, want = sorted((s, n) for s, n in left.items() if n), int(proportions[split] * total)
        picked = closest_subset(groups, want, over=False) or closest_subset(groups, want)
        for s, k in picked.items():
            left[s] -= k
        out[split] = picked
    out[order[-1]] = {s: n for s, n in left.items() if n}
    return out


def split_records(records: DataFrame, blocks: DataFrame, authors: DataFrame, proportions: dict[str, float] | None = None) -> DataFrame:
    """``(record, group_key, split)`` for each distinct record."""
    proportions = proportions or {"train": 0.8, "validation": 0.1, "test": 0.1}
    if abs(sum(proportions.values()) - 1) > 1e-9 or min(proportions.values()) < 0:
        raise ValueError("proportions must be at least 0 and add up to 1")
    spark = records.sparkSession
    members = cut(record_groups(records, blocks, authors), "members")
    groups = members.groupBy("group_key").agg(F.count(F.lit(1)).alias("size")).withColumn("deal", F.xxhash64("group_key"))
    ranked = cut(rank_within(groups, "size", ["deal", "group_key"], out="rank"), "ranked")
    sizes = [(int(r["size"]), int(r.n)) for r in ranked.groupBy("size").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()]
    plan = choose_totals(sizes, proportions)
    rows, at = [], {s: 0 for s, _ in sizes}
    for split, counts in plan.items():
        for s, n in counts.items():
            rows.append((s, at[s], at[s] + n, split))
            at[s] += n
    # one row per (size, split): bounded by the distinct sizes, that is by the square root of the rows
    cuts = spark.createDataFrame(rows or [(0, 0, 0, "")], "size bigint, from_rank bigint, to_rank bigint, split string")
    dealt = ranked.join(F.broadcast(cuts), "size").where("rank > from_rank AND rank <= to_rank").select("group_key", "split")
    return salted(members, cut(dealt, "dealt"), "group_key", hot_keys(members, "group_key")).select("record", "group_key", "split")
