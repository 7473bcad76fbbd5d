"""Per-key work when a few keys hold most rows.

Heavy hitters are found with a mergeable frequent-items sketch: each partition keeps ``m`` counters, the summaries add
up, and what the sketch may have lost of a key is at most ``rows / (m + 1)``.  So the candidates are a proven superset
of the keys above the share, and at most ``2 / share`` of them are left to be counted exactly and broadcast.
Everything else of a keyed computation runs as an ordinary shuffle; the two parts are united.

Defined results: null keys are never heavy and never dropped from the totals; an empty table has no heavy keys; ties
and repeated rows are counted as they are; further columns are carried through, helper columns have names starting
with ``__`` which an input must not use.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entiforge.plans.lineage import cut


def _summaries(counters: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}
        rows = 0
        for pdf in batches:
            rows += len(pdf)
            for k, n in pdf["k"].value_counts(dropna=True).items():
                held[k] = held.get(k, 0) + int(n)
            if len(held) > counters:
                # subtracting the (m+1)-th largest count keeps the error of each merge within rows / (m + 1)
                floor = sorted(held.values(), reverse=True)[counters]
                held = {k: n - floor for k, n in held.items() if n > floor}
        yield pd.DataFrame({"k": [*held, None], "n": [*held.values(), rows]})

    return run


def heavy_hitters(df: DataFrame, key: str | Column, share: float, over: int = 1) -> DataFrame:
    """``(hot_key, n, total)``: each non-null value in more than ``share`` of all rows of ``df``.

    ``over`` divides the share for the candidates' sketch only; the result is exact in any case.
    """
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    counters = math.ceil(4 * over / share)
    keys = df.select((F.col(key) if isinstance(key, str) else key).cast("string").alias("k"))
    # written once: at most ``counters + 1`` rows a task, read for the total and for the candidates
    sketch = cut(keys.mapInPandas(_summaries(counters), "k string, n bigint").groupBy("k").agg(F.sum("n").alias("n")), "sketch")
    total = sketch.where(F.col("k").isNull()).select(F.col("n").alias("total"))
    bound = share - 1 / (counters + 1)
    candidates = sketch.where(F.col("k").isNotNull()).withColumn("total", total.scalar()).where(F.col("n") > F.col("total") * bound).select("k", "total")
    # at most 1 / bound (< 2 / share) rows: the broadcast cannot grow with the data
    counted = keys.join(F.broadcast(candidates), "k").groupBy("k", "total").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > F.col("total") * share).select(F.col("k").alias("hot_key"), "n", "total")


def split_heavy(df: DataFrame, key: str, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(heavy rows, remaining rows with those of null key, heavy keys)`` of ``df``."""
    hot = cut(heavy_hitters(df, key, share).select(F.col("hot_key").alias("__hot")), "hot")
    marked = df.join(F.broadcast(hot), df[key].cast("string") == F.col("__hot"), "left")
    return marked.where(F.col("__hot").isNotNull()).drop("__hot"), marked.where(F.col("__hot").isNull()).drop("__hot"), hot


def skew_join(left: DataFrame, right: DataFrame, key: str, share: float = 0.01, salts: int = 32, right_unique: bool = True) -> DataFrame:
    """Inner equi-join on ``key`` that carries no heavy key of ``left`` in one task.

    With ``right_unique`` (one row of ``right`` per key) the rows for heavy keys are at most ``1 / share`` and are
    broadcast; else they are copied ``salts`` times and the heavy rows of ``left`` spread over the copies.  The other
    keys are shuffled; the two results are united.
    """
    heavy, rest, hot = split_heavy(left, key, share)
    mine = right.join(F.broadcast(hot), right[key].cast("string") == F.col("__hot")).drop("__hot")
    if right_unique:
        joined = heavy.join(F.broadcast(mine), key)
    else:
        copies = mine.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        # a hash of the row: a retried task salts its rows alike
        spread = heavy.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
        joined = spread.join(copies, [key, "__salt"]).drop("__salt")
    return joined.unionByName(rest.join(right, key))


def hot_keys(df: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """``(__hot)``: the heavy keys of ``df`` as text, found once for any number of :func:`salted` joins."""
    return cut(heavy_hitters(df, key, share).select(F.col("hot_key").alias("__hot")), "hot")


def salted(many: DataFrame, few: DataFrame, key: str, hot: DataFrame, salts: int = 32) -> DataFrame:
    """Inner equi-join on ``key`` as one shuffle join: rows of ``many`` with a heavy key are spread by a hash of the row
    over ``salts`` copies of the matching rows of ``few``; other keys have one copy and one place."""
    mark = lambda df: df.join(F.broadcast(hot), df[key].cast("string") == F.col("__hot"), "left")
    spread = mark(many).withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*many.columns), F.lit(salts)).cast("int")).otherwise(0)).drop("__hot")
    places = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = mark(few).withColumn("__salt", F.explode(places)).drop("__hot")
    return spread.join(copies, [key, "__salt"]).drop("__salt")


def key_profile(df: DataFrame, key: str, item: str, share: float = 0.01, salts: int = 64) -> DataFrame:
    """Per key: ``n_rows``, ``n_items`` (distinct non-null items), ``top_item`` and ``top_rows`` (most frequent item,
    smallest on ties; null and 0 where the key has none).

    Heavy keys: rows are first counted by ``(key, item)`` - partial counts leave each task as one row an item - then
    merged in ``salts`` slices an item hash apart, and only ``salts`` rows a key meet in the last step.  The remaining
    keys are grouped directly.
    """
    heavy, rest, _ = split_heavy(df.select(key, item), key, share)

    def counts(part: DataFrame) -> DataFrame:
        return part.groupBy(key, item).agg(F.count(F.lit(1)).alias("__n"))

    best = F.struct((-F.col("__n")).alias("neg"), F.col(item).alias("item"))

    def slices(part: DataFrame, *by: Column) -> DataFrame:
        return part.groupBy(key, *by).agg(F.sum("__n").alias("__rows"), F.count(item).alias("__items"), F.min(F.when(F.col(item).isNotNull(), best)).alias("__best"))

    merged = slices(counts(heavy), F.pmod(F.xxhash64(item), F.lit(salts)).alias("__slice")).groupBy(key).agg(F.sum("__rows").alias("__rows"), F.sum("__items").alias("__items"), F.min("__best").alias("__best"))
    both = merged.unionByName(slices(counts(rest)))
    return both.select(
        key,
        F.col("__rows").cast("bigint").alias("n_rows"),
        F.col("__items").cast("bigint").alias("n_items"),
        F.col("__best.item").alias("top_item"),
        F.coalesce(-F.col("__best.neg"), F.lit(0)).cast("bigint").alias("top_rows"),
    )


def rank_within(df: DataFrame, key: str, order: list[str], partitions: int | None = None, out: str = "rank_in_key") -> DataFrame:
    """``df`` with the 1-based position of each row within its key, by ``order`` - without a window, so a key may span
    any number of tasks.

    Rows are range-partitioned by key and order; each task numbers its own rows, and only one row per (task, key at
    its edge) is summed to give the offsets.  ``order`` must make rows distinct for a reproducible result; equal rows
    get different positions.  Null keys form a group of their own.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    schema = T.StructType([*df.schema.fields, T.StructField("__pid", T.IntegerType()), T.StructField("__pos", T.LongType())])

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid, last, seen = TaskContext.get().partitionId(), object(), 0
        for pdf in batches:
            if not len(pdf):
                continue
            k = pdf[key]
            change = (k != k.shift()) & ~(k.isna() & k.shift().isna())
            change.iloc[0] = not (k.iloc[0] == last or (pd.isna(k.iloc[0]) and seen and pd.isna(last)))
            group = change.cumsum()
            pos = pdf.groupby(group).cumcount() + 1
            if not change.iloc[0]:
                pos = pos + (group == group.iloc[0]) * seen
            last, seen = k.iloc[-1], int(pos.iloc[-1])
            yield pdf.assign(__pid=pid, __pos=pos.astype("int64"))

    numbered = cut(ranged.mapInPandas(number, schema), "rank")
    per = numbered.groupBy("__pid", key).agg(F.max("__pos").alias("__c"))
    # at most one row a task and key at its edge: tasks are summed in order once a key
    inner = per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__pid", "__c"))).alias("__parts")).where(F.size("__parts") > 1)
    running = F.aggregate("__parts", F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["__c"])))
    offsets = inner.select(F.col(key).alias("__k"), F.arrays_zip(F.col("__parts.__pid").alias("pid"), running.alias("off")).alias("z")).select("__k", F.explode("z").alias("z"))
    offsets = offsets.where(F.col("z.pid").isNotNull()).select("__k", F.col("z.pid").alias("__p"), F.col("z.off").alias("__off"))
    joined = numbered.join(F.broadcast(offsets), (numbered["__pid"] == offsets["__p"]) & numbered[key].eqNullSafe(offsets["__k"]), "left")
    return joined.select(*df.columns, (F.col("__pos") + F.coalesce("__off", F.lit(0))).cast("bigint").alias(out))
