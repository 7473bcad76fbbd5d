"""Blocking keys: which rows are compared at all.

Defined results: a null name has a null key under every scheme but ``single``; repeated rows get the same key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entiforge.functions.names import block_last_name_first_initial, given_name_initial, tokenize_name
from entiforge.functions.phonetic import encode_tokens
from entiforge.operators.components import connected_components
from entiforge.operators.hotkeys import hot_keys, salted
from entiforge.plans.lineage import cut


def with_block(df: DataFrame, scheme: str | Callable[[DataFrame], DataFrame] | Column, name: str = "author_name", row_id: str = "row_id", threshold: int | None = 1000, algorithm: str = "double_metaphone") -> DataFrame:
    """``df`` with a ``block`` column: ``"single"``, ``"last_name_first_initial"``, ``"phonetic"``, a column
    (precomputed keys) or a function from DataFrame to DataFrame."""
    if isinstance(scheme, Column):
        return df.withColumn("block", scheme)
    if callable(scheme):
        return scheme(df)
    if scheme == "single":
        return df.withColumn("block", F.lit("0"))
    if scheme == "last_name_first_initial":
        return df.withColumn("block", block_last_name_first_initial(F.col(name)))
    if scheme == "phonetic":
        return block_phonetic(df, name, row_id, threshold, algorithm)
    raise ValueError(f"unknown blocking {scheme!r}")


def split_blocks(df: DataFrame, threshold: int, name: str = "author_name") -> DataFrame:
    """Appends the given-name initial to the key of each block with more than ``threshold`` rows.

    The oversized keys are found by a count and joined back with hot blocks spread, not by a window: a window would
    sort each block in one task, and it is the large ones that matter.
    """
    df = cut(df, "blocked")  # read twice below: what is behind it runs once
    large = df.groupBy("block").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > threshold).select("block")
    whole = df.select("block").distinct().join(large.withColumn("__large", F.lit(True)), "block", "left").where("block IS NOT NULL")
    marked = salted(df.where("block IS NOT NULL"), whole, "block", hot_keys(df, "block"))
    done = marked.withColumn("block", F.when(F.col("__large"), F.concat("block", given_name_initial(F.col(name)))).otherwise(F.col("block")))
    return done.select(*df.columns).unionByName(df.where("block IS NULL"))


def phonetic_tokens(df: DataFrame, name: str, algorithm: str = "double_metaphone") -> DataFrame:
    """``(name, s, g)``: phonetic surname and given tokens of each distinct name.  Encoders run once per distinct
    token; codes come back by a join on the token."""
    names = df.select(name).where(F.col(name).isNotNull()).distinct().withColumn("__t", tokenize_name(F.col(name)))
    long = names.select(name, F.posexplode("__t.surnames").alias("pos", "token"), F.lit(0).alias("part")).unionByName(names.select(name, F.posexplode("__t.given").alias("pos", "token"), F.lit(1).alias("part")))
    long = cut(long, "tokens")
    codes = encode_tokens(long, "token", algorithm)
    coded = long.join(codes, "token")

    def of(part: int) -> Column:
        return F.transform(F.filter(F.array_sort(F.collect_list(F.struct("part", "pos", "code"))), lambda x: x["part"] == part), lambda x: x["code"])

    return coded.groupBy(name).agg(of(0).alias("s"), of(1).alias("g"))


def suffix_compatible(prefix: Column, given: Column) -> Column:
    """True when the two token lists agree from the end until one is used up."""
    k = F.least(F.size(prefix), F.size(given))
    return F.slice(prefix, F.size(prefix) - k + 1, k) == F.slice(given, F.size(given) - k + 1, k)


def _creators(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which surname tuple first opens which block, within one component of the token graph, in row order."""
    made: dict[str, tuple[str, int]] = {}
    for s, at in pdf.sort_values("first_row")[["s", "first_row"]].itertuples(index=False):
        s0, sn = s[0], s[-1]
        if s0 not in made and sn not in made:
            made[sn] = ("\x1f".join(s), int(at))
    return pd.DataFrame([(b, c, at) for b, (c, at) in made.items()], columns=["made_block", "creator", "made_at"])


def block_phonetic(df: DataFrame, name: str = "author_name", row_id: str = "row_id", threshold: int | None = 1000, algorithm: str = "double_metaphone") -> DataFrame:
    """Phonetic surname blocks in closed form.

    Single surnames open the blocks ``B0``; a compound surname joins the block of its last part if some of the parts
    before it agree from the right with a given name there, else the block of its first part, else the block its last
    part was opened under.  Only tuples with neither end in ``B0`` depend on the order of rows: they are grouped by
    connected components of their end tokens, so each group stays small.
    """
    if threshold is not None and threshold <= 0:
        raise ValueError("threshold must be positive")
    tokens = cut(phonetic_tokens(df, name, algorithm), "phonetic")
    hot = hot_keys(df.select(name), name)
    first_of = cut(df.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(row_id).alias("first_row")), "first_of")
    single = tokens.where(F.size("s") == 1)
    content = single.select(F.col("s")[0].alias("token"), "g").distinct()
    b0 = content.select("token").distinct()
    multi = tokens.where(F.size("s") > 1).select("s").distinct().withColumn("s0", F.col("s")[0]).withColumn("sn", F.element_at("s", -1))
    prefixes = multi.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda k: F.slice("s", 1, k))))
    # candidates meet on the last token of prefix and given name; an empty given list agrees with everything
    keyed = content.withColumn("last", F.element_at("g", -1))
    hit = prefixes.withColumn("last", F.element_at("prefix", -1)).join(keyed, (F.col("sn") == keyed["token"]) & (F.col("prefix")[F.size("prefix") - 1] == keyed["last"])).where(suffix_compatible(F.col("prefix"), F.col("g"))).select("s").distinct()
    multi = multi.join(hit.withColumn("matches", F.lit(True)), "s", "left")
    multi = multi.join(b0.select(F.col("token").alias("s0"), F.lit(True).alias("first_known")), "s0", "left").join(b0.select(F.col("token").alias("sn"), F.lit(True).alias("last_known")), "sn", "left")
    multi = cut(multi, "multi")
    first_rows = tokens.where(F.size("s") > 1).join(first_of, name).groupBy("s").agg(F.min("first_row").alias("first_row"))
    orphans = cut(multi.where("first_known IS NULL AND last_known IS NULL").join(first_rows, "s").select("s", "s0", "sn", "first_row"), "orphans")
    groups = connected_components(orphans.select(F.col("s0").alias("src"), F.col("sn").alias("dst")))
    made = orphans.join(groups, orphans["sn"] == groups["vertex"]).groupBy("component").applyInPandas(_creators, "made_block string, creator string, made_at bigint")
    made = cut(made, "made")
    decided = multi.join(made.select(F.col("made_block").alias("s0"), F.col("made_at").alias("s0_at")), "s0", "left").join(made.select(F.col("made_block").alias("sn"), "creator"), "sn", "left")
    decided = decided.select("s", "s0", "sn", "matches", "first_known", "creator", "s0_at", "last_known")
    # settled on distinct names; rows meet their name once, hot names spread
    named = cut(tokens.join(decided, "s", "left").drop("g"), "named")
    rows = salted(df.where(F.col(name).isNotNull()), df.select(name).distinct().where(F.col(name).isNotNull()).join(named, name, "left"), name, hot)
    blocked = rows.withColumn(
        "block",
        F.when(F.size("s") == 1, F.col("s")[0])
        .when(F.col("matches"), F.col("sn"))
        .when(F.col("first_known"), F.col("s0"))
        .when(F.col("creator") == F.array_join("s", "\x1f"), F.col("sn"))
        .when(F.col("s0_at") < F.col(row_id), F.col("s0"))
        .otherwise(F.col("sn")),
    ).select(*df.columns, "block")
    blocked = blocked.unionByName(df.where(F.col(name).isNull()).withColumn("block", F.lit(None).cast("string")))
    return split_blocks(blocked, threshold, name) if threshold else blocked
