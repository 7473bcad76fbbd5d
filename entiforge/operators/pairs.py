"""Pairs of rows and what is computed on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_pairs(df: DataFrame, block: str, row_id: str, columns: list[str]) -> DataFrame:
    """Unordered pairs of rows of one block: ``l_<id>, r_<id>`` (l < r), the block, and both rows' ``columns``.

    An equi-join on the block with a range residual, so AQE can split a skewed block's rows over several tasks.  Null
    blocks pair with nothing.
    """
    left = df.select(F.col(block), F.col(row_id).alias(f"l_{row_id}"), *[F.col(c).alias(f"l_{c}") for c in columns])
    right = df.select(F.col(block), F.col(row_id).alias(f"r_{row_id}"), *[F.col(c).alias(f"r_{c}") for c in columns])
    return left.join(right, block).where(F.col(f"l_{row_id}") < F.col(f"r_{row_id}"))


def pair_apply(pairs: DataFrame, sides: list[tuple[str, list[str]]], transform: Callable[[DataFrame], DataFrame], key: list[str], out: list[str], distinct: bool = True) -> DataFrame:
    """Transforms the elements of pairs once each and joins the results back to both sides.

    ``sides`` gives each side's prefix; the side's element columns are ``prefix + k`` for ``k`` in ``key`` (the
    identity) - the element table holds the distinct elements of both sides, or every occurrence where a transform is
    to be fitted on occurrences.
    """
    elements: DataFrame | None = None
    for prefix, extra in sides:
        part = pairs.select(*[F.col(prefix + c).alias(c) for c in [*key, *extra]])
        elements = part if elements is None else elements.unionByName(part)
    done = transform(elements.dropDuplicates(key) if distinct else elements).select(*key, *out).dropDuplicates(key)
    result = pairs
    for prefix, _ in sides:
        side = done.select(*[F.col(c).alias(prefix + c) for c in [*key, *out]])
        result = result.join(side, [prefix + c for c in key], "left")
    return result


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0)))


def jaccard_sets(a: Column, b: Column) -> Column:
    """Jaccard similarity of token sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(a.isNull() | b.isNull(), None).when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def jaccard_vectors(a: Column, b: Column) -> Column:
    """Jaccard similarity of the positive places of two vectors."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: ((x > 0) & (y > 0)).cast("int")), F.lit(0), lambda s, x: s + x)
    any_ = F.aggregate(F.zip_with(a, b, lambda x, y: ((x > 0) | (y > 0)).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(any_ == 0, 0.0).otherwise(both / F.nullif(any_, F.lit(0)))


def absolute_difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def element_product(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def threshold(x: Column, t: float) -> Column:
    """1.0 where ``x`` lies above ``t``, else 0.0; NaN is not above anything."""
    return F.when(x.isNull(), None).otherwise((~F.isnan(x) & (x > t)).cast("double"))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def func_transformer(col: Column, func: Callable[[Column], Column], dtype: str | None = None) -> Column:
    """Element-wise function over an array column, with the result type given (else that of the function)."""
    out = F.transform(col, func)
    return out.cast(f"array<{dtype}>") if dtype else out


def reshape(col: Column, rows: int, cols: int, order: str = "C") -> Column:
    """An array of arrays as ``rows`` arrays of ``cols`` values, read by rows (``C``) or by columns (``F``)."""
    if order == "F":
        width = F.size(F.get(col, F.lit(0)))
        read = F.flatten(F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.transform(col, lambda r: F.get(r, j))))
        return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda j: F.get(read, j * rows + i)))
    read = F.flatten(col)
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(read, i * cols + 1, cols))
