"""Seeded sampling of labelled pairs within blocks.

The pairs of a block are as many as its rows squared, so they are neither listed to be counted nor to be drawn from:
rows that agree in block, label and name form a cell, and cells alone say how many pairs there are of each category and
which pair has which number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entiforge.operators.hotkeys import rank_within
from entiforge.operators.pairs import block_pairs
from entiforge.plans.lineage import cut


def smallest_hashes(df: DataFrame, rows: int, keys: list[str], limit: int, seed: int = 1) -> DataFrame:
    """``limit`` rows of ``df`` with the smallest keyed hashes (all, where there are fewer).

    A top-k keeps ``limit`` rows of every task; so of many ``rows`` only those below a hash bound that leaves about
    four times the limit are looked at, and what reaches one place stays within that however many tasks there are.
    ``rows`` is the number of rows or an estimate not above it.
    """
    h = F.xxhash64(*keys, F.lit(seed))
    if rows > 4 * limit:
        bound = int((4 * limit / rows) * 2**62)
        df = df.where(F.pmod(h, F.lit(2**62)) < bound)
    return df.orderBy(F.pmod(h, F.lit(2**62)), *keys).limit(limit)


def categorize(pairs: DataFrame, truth: DataFrame, row_id: str = "signature_id", label: str = "label", name: str = "author_name") -> DataFrame:
    """``pairs(l_id, r_id)`` with ``target`` (0 same author, 1 different) and ``category``: d/s (different or same)
    a(uthor) d/s n(ame)."""
    side = truth.select(row_id, label, name)
    left = side.select(F.col(row_id).alias("l_id"), F.col(label).alias("__ll"), F.col(name).alias("__ln"))
    right = side.select(F.col(row_id).alias("r_id"), F.col(label).alias("__rl"), F.col(name).alias("__rn"))
    j = pairs.join(left, "l_id").join(right, "r_id")
    return _marked(j, "__ll", "__rl", "__ln", "__rn").drop("__ll", "__rl", "__ln", "__rn")


def _marked(pairs: DataFrame, l_label: str, r_label: str, l_name: str, r_name: str) -> DataFrame:
    same_author, same_name = F.col(l_label) == F.col(r_label), F.col(l_name).eqNullSafe(F.col(r_name))
    return pairs.withColumn("target", F.when(same_author, 0).otherwise(1)).withColumn("category", _category(same_author, same_name))


def categorized_block_pairs(known: DataFrame, block: str = "block", row_id: str = "signature_id", label: str = "label", name: str = "author_name") -> DataFrame:
    """``(l_id, r_id, target, category)`` of all pairs of labelled rows within a block; label and name travel with the
    rows, so nothing is joined back to the pairs."""
    p = block_pairs(known, block, row_id, [label, name])
    m = _marked(p, f"l_{label}", f"r_{label}", f"l_{name}", f"r_{name}")
    return m.select(F.col(f"l_{row_id}").alias("l_id"), F.col(f"r_{row_id}").alias("r_id"), "target", "category")


CATEGORIES = ("dasn", "sasn", "sadn", "dadn")


def _cell_rows(known: DataFrame, block: str, row_id: str, label: str, name: str) -> DataFrame:
    """``(b, l, n, id)`` of the rows in a block.  Equal texts in ``l`` and ``n`` stand for one author and one name: null
    names are equal, and a null label is an author of its own."""
    text = lambda c: F.concat(F.lit("="), F.col(c).cast("string"))
    l, n = F.coalesce(text(label), F.concat(F.lit("?"), F.col(row_id).cast("string"))), F.coalesce(text(name), F.lit(""))
    return known.where(F.col(block).isNotNull()).select(F.col(block).alias("b"), l.alias("l"), n.alias("n"), F.col(row_id).alias("id"))


def _category(same_author: Column, same_name: Column) -> Column:
    return F.concat(F.when(same_author, "sa").otherwise("da"), F.when(same_name, "sn").otherwise("dn"))


def block_pair_counts(known: DataFrame, block: str = "block", row_id: str = "signature_id", label: str = "label", name: str = "author_name") -> DataFrame:
    """``(category, target, n_pairs)`` of :func:`categorized_block_pairs`, categories without pairs left out, in time
    linear in the rows: from the numbers of rows by block, and by block with label, name or both.  Rows of one id are
    no pair; only ids repeated within a block are paired, to be taken off again."""
    rows = cut(_cell_rows(known, block, row_id, label, name), "rows")
    cells = cut(rows.groupBy("b", "l", "n").agg(F.count(F.lit(1)).alias("k")), "cells")

    def pairs(*by: str) -> DataFrame:
        return cells.groupBy(*by).agg(F.sum("k").alias("k")).agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1)), F.lit(0)).alias("of_" + "".join(by)))

    ids = rows.groupBy("b", "id", "l", "n").agg(F.count(F.lit(1)).alias("k"))
    often = cut(ids.join(rows.groupBy("b", "id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"), ["b", "id"]), "repeated")
    twin = often.select("b", "id", F.col("l").alias("l2"), F.col("n").alias("n2"), F.col("k").alias("k2"))
    same = often.join(twin, ["b", "id"]).select(_category(F.col("l") == F.col("l2"), F.col("n") == F.col("n2")).alias("c"), (F.col("k") * (F.col("k2") - F.when((F.col("l") == F.col("l2")) & (F.col("n") == F.col("n2")), 1).otherwise(0))).alias("k"))
    off = same.agg(*[F.coalesce(F.sum(F.when(F.col("c") == c, F.col("k"))), F.lit(0)).alias(c) for c in CATEGORIES])
    t = pairs("b").crossJoin(pairs("b", "l")).crossJoin(pairs("b", "n")).crossJoin(pairs("b", "l", "n")).crossJoin(off)  # one row each
    ordered = {"dasn": F.expr("of_bn - of_bln"), "sasn": F.col("of_bln"), "sadn": F.expr("of_bl - of_bln"), "dadn": F.expr("of_b - of_bl - of_bn + of_bln")}
    of = [F.struct(F.lit(c).alias("category"), F.lit(int(c[0] == "d")).alias("target"), ((ordered[c] - F.col(c)) / 2).cast("bigint").alias("n_pairs")) for c in CATEGORIES]
    return t.select(F.explode(F.array(*of)).alias("x")).select("x.*").where("n_pairs > 0")


def _hits(first: np.ndarray, size: int, p: float, h: int) -> list[int]:
    """Places in ``range(size)``, each taken with probability ``p``; the first one is given."""
    if p >= 1:
        return list(range(size))
    rng, at, out = np.random.default_rng(h), int(first), []
    while at < size:
        out.append(at)
        at += int(rng.geometric(p))
    return out


def _thinned(share: dict[str, float]):
    """Numbers of ordered pairs, ``(c, b, l, n, i, o)``: row ``i`` of the cell with the ``o``-th row it can pair with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for c, p in share.items():
                size, h = (pdf["k"] * pdf[c]).to_numpy(), pdf[f"h_{c}"].to_numpy()
                # the gap before the first pair taken, from the cell's own hash: most cells give none
                gap = np.zeros(len(size)) if p >= 1 else np.floor(np.log((h + 0.5) / 2**53) / np.log1p(-p))
                for at in np.flatnonzero(gap < size).tolist():
                    w = int(pdf[c].iloc[at])
                    for t in _hits(gap[at], int(size[at]), p, int(h[at])):
                        out.append((c, pdf["b"].iloc[at], pdf["l"].iloc[at], pdf["n"].iloc[at], t // w, t % w))
            yield pd.DataFrame(out, columns=["c", "b", "l", "n", "i", "o"])

    return run


def _partners(key: tuple, cells: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
    """The cell and the place in it of the ``o``-th row that each row drawn in this block can pair with."""
    cells = cells.sort_values(["l", "n"], kind="stable")
    ls, ns, k = cells["l"].to_numpy(), cells["n"].to_numpy(), cells["k"].to_numpy()
    start = np.cumsum(k) - k
    by_label, by_name = pd.Series(range(len(k))).groupby(ls).indices, pd.Series(range(len(k))).groupby(ns).indices
    out = []
    for c, l, n, i, o in draws[["c", "l", "n", "i", "o"]].itertuples(index=False):
        of_l, of_n = by_label[l], by_name[n]
        own = np.intersect1d(of_l, of_n)
        if c == "sasn":
            cell, j = int(own[0]), o + (o >= i)
        elif c == "dadn":
            gone = np.union1d(of_l, of_n)
            before = np.cumsum(k[gone]) - k[gone]
            at = o + int(k[gone[: np.searchsorted(start[gone] - before, o, "right")]].sum())
            cell = int(np.searchsorted(start, at, "right")) - 1
            j = at - int(start[cell])
        else:
            left = np.setdiff1d(of_l if c == "sadn" else of_n, own)
            ends = np.cumsum(k[left])
            at = int(np.searchsorted(ends, o, "right"))
            cell, j = int(left[at]), o - int(ends[at] - k[left[at]])
        out.append((c, l, n, i, ls[cell], ns[cell], j))
    return pd.DataFrame(out, columns=["c", "l", "n", "i", "l2", "n2", "j"]).assign(b=key[0])


def drawn_block_pairs(known: DataFrame, quotas: dict[tuple[str, ...], int], seed: int = 1, block: str = "block", row_id: str = "signature_id", label: str = "label", name: str = "author_name") -> DataFrame:
    """A uniform sample of :func:`categorized_block_pairs`, without listing these: of each group of categories at least
    its quota, or all pairs where there are fewer.

    A cell knows how many ordered pairs begin in it; each of them is taken with one probability, drawn as gaps between
    those taken, so cells without any cost one logarithm.  An unordered pair has two chances, and all pairs of a group
    have the same.  Only for the pairs taken are the partners' cells looked up in the block, and rows by their rank in
    the cell.  Repeated rows count once.
    """
    rows = cut(_cell_rows(known, block, row_id, label, name), "rows")
    cells = rows.groupBy("b", "l", "n").agg(F.count(F.lit(1)).alias("k"))
    cells = cut(cells, "cells")
    of = lambda *by: cells.groupBy(*by).agg(F.sum("k").alias("of_" + "".join(by)))
    wide = cells.join(of("b", "l"), ["b", "l"]).join(of("b", "n"), ["b", "n"]).join(of("b"), "b")
    wide = wide.select("b", "l", "n", "k", F.expr("of_bn - k").alias("dasn"), F.expr("k - 1").alias("sasn"), F.expr("of_bl - k").alias("sadn"), F.expr("of_b - of_bl - of_bn + k").alias("dadn"))
    wide = cut(wide.select("*", *[F.pmod(F.xxhash64("b", "l", "n", F.lit(c), F.lit(seed)), F.lit(2**53)).alias(f"h_{c}") for c in CATEGORIES]), "partners")
    total = wide.agg(*[F.coalesce(F.sum(F.col("k") * F.col(c)), F.lit(0)).alias(c) for c in CATEGORIES]).first()
    share = {c: min(1.0, (4 * q + 64) / max(sum(total[x] for x in group), 1)) for group, q in quotas.items() for c in group}
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    while True:
        draws = cut(wide.mapInPandas(_thinned(share), f"c string, b {types['b']}, l string, n string, i bigint, o bigint"), "draws")
        here = cells.join(draws.select("b").distinct(), "b", "left_semi")
        met = cut(here.groupBy("b").cogroup(draws.groupBy("b")).applyInPandas(_partners, f"c string, l string, n string, i bigint, l2 string, n2 string, j bigint, b {types['b']}"), "met")
        wanted = met.select("b", "l", "n").union(met.select("b", "l2", "n2")).distinct()
        cell = F.to_json(F.struct(F.col("b").cast("string"), "l", "n"))
        ranked = rank_within(rows.join(wanted, ["b", "l", "n"], "left_semi").withColumn("cell", cell), "cell", ["id"], out="rank")
        ranked = cut(ranked.select("b", "l", "n", "id", (F.col("rank") - 1).alias("i")), "ranked")
        second = ranked.select("b", F.col("l").alias("l2"), F.col("n").alias("n2"), F.col("i").alias("j"), F.col("id").alias("id2"))
        pairs = met.join(ranked, ["b", "l", "n", "i"]).join(second, ["b", "l2", "n2", "j"]).where("id <> id2")
        pairs = pairs.select(F.least("id", "id2").alias("l_id"), F.greatest("id", "id2").alias("r_id"), F.when(F.col("c").startswith("s"), 0).otherwise(1).alias("target"), F.col("c").alias("category")).distinct()
        pairs = cut(pairs, "drawn")
        got = {r["category"]: r["n"] for r in pairs.groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
        short = [g for g, q in quotas.items() if sum(got.get(c, 0) for c in g) < q and share[g[0]] < 1]
        if not short:
            return pairs
        share |= {c: min(1.0, 2 * share[c]) for g in short for c in g}


def sample_block_pairs(known: DataFrame, size: int, balanced: bool = True, seed: int = 1) -> DataFrame:
    """:func:`sample_balanced` or :func:`sample_unbalanced` of all pairs within blocks, drawn without listing them."""
    if balanced:
        return sample_balanced(drawn_block_pairs(known, {(c,): size // 4 for c in CATEGORIES}, seed), size, seed)
    return sample_unbalanced(drawn_block_pairs(known, {("sasn", "sadn"): size // 2, ("dasn", "dadn"): size // 2}, seed), size, seed)


def sample_balanced(pairs: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """``size // 4`` pairs of each category; a category with fewer is repeated as often as needed, an empty one gives
    none.  Rows are drawn by :func:`smallest_hashes`: nothing is sorted as a whole."""
    quota = size // 4
    pairs = cut(pairs, "pairs")  # read once for the counts and once a category
    counts = {r["category"]: int(r["n"]) for r in pairs.groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
    out = None
    for category in ("dasn", "sasn", "sadn", "dadn"):
        n = counts.get(category, 0)
        copies = -(-quota // n) if n else 0
        part = pairs.where(F.col("category") == category).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(max(copies, 1)))))
        drawn = smallest_hashes(part, n * max(copies, 1), ["l_id", "r_id", "copy"], quota, seed)
        out = drawn if out is None else out.unionByName(drawn)
    return out


def sample_unbalanced(pairs: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """Half positives (same author), half negatives, of what there is."""
    pairs = cut(pairs, "pairs")
    counts = {r["target"]: int(r["n"]) for r in pairs.groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    out = None
    for target in (0, 1):
        drawn = smallest_hashes(pairs.where(F.col("target") == target), counts.get(target, 0), ["l_id", "r_id"], size // 2, seed)
        out = drawn if out is None else out.unionByName(drawn)
    return out


def sample_without_blocking(truth: DataFrame, size: int, row_id: str = "signature_id", label: str = "label", seed: int = 1) -> DataFrame:
    """``(l_id, r_id, target)``: half negatives met at random, half positives from one cluster, all distinct.

    Rows meet by seeded random keys drawn in several rounds - an equi-join, never a cross join - and positives by
    pairing neighbours in a seeded order within clusters.
    """
    rounds = 8
    rows = truth.select(row_id, label).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    n = truth.agg(F.count(F.lit(1)).alias("n")).scalar()
    slot = F.pmod(F.xxhash64(row_id, "round", F.lit(seed)), F.greatest(n / 2, F.lit(1)).cast("bigint"))
    met = rows.withColumn("slot", slot)
    a = met.select("round", "slot", F.col(row_id).alias("l_id"), F.col(label).alias("la"))
    b = met.select("round", "slot", F.col(row_id).alias("r_id"), F.col(label).alias("lb"))
    negatives = a.join(b, ["round", "slot"]).where("l_id < r_id AND la <> lb").select("l_id", "r_id").distinct().withColumn("target", F.lit(1))
    # neighbours in a seeded order: rank joined to rank + 1 and so on, so a cluster of n rows gives at most n pairs a round
    order = truth.select(row_id, label).withColumn("draw", F.xxhash64(row_id, F.lit(seed + 1)))
    ranked = cut(rank_within(order, label, ["draw", row_id], out="rank").select(F.col(label).alias("c"), F.col(row_id).alias("id"), "rank"), "ranked")
    a = ranked.select("c", F.col("id").alias("x"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda k: F.col("rank") + k)).alias("rank"))
    positives = a.join(ranked, ["c", "rank"]).select(F.least("x", "id").alias("l_id"), F.greatest("x", "id").alias("r_id")).distinct().withColumn("target", F.lit(0))
    return sample_unbalanced(negatives.unionByName(positives), size, seed)
