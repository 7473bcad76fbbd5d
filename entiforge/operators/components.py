"""Connected components by hooking and shortcutting over parent arrays kept in joined tables.

Each round every vertex hooks onto its smallest neighbour, parent chains are shortcut by joining the parent table with
itself, and the edges are contracted onto the roots; edges inside a root disappear, so the edge table shrinks by a
factor each round.  Nothing is collected: the driver only learns whether edges are left.

Defined results: edges with a null end are ignored, loops make single vertices, repeated edges count once, an empty
edge table gives an empty result.  The label of a component is its smallest vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entiforge.operators.hotkeys import hot_keys, salted
from entiforge.plans.lineage import cut, release

#: Edges above which joins on roots are spread; the result is the same.
SPREAD_ABOVE = 500_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", jumps: int = 2, max_rounds: int = 50) -> DataFrame:
    """``(vertex, component)`` for each vertex of ``edges``; ``component`` is the smallest vertex reached."""
    # kept once: the plan behind the edges would else run again for the vertices
    e = cut(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct(), "ties")
    vertices = e.select(F.col("a").alias("vertex")).union(e.select("b")).distinct()
    live = e.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    parents: DataFrame | None = None
    # a large component ends in one root that most edges share: where that could fill a task, joins on it are spread
    join = lambda many, few, key: salted(many, few, key, hot_keys(many.select(key), key)) if rows > SPREAD_ABOVE else many.join(few, key)
    for _ in range(max_rounds):
        rows = live.count()
        if not rows:
            break
        # hook: the smallest of a vertex and its neighbours
        hook = live.select(F.col("b").alias("v"), F.col("a").alias("p")).union(live.select("a", "a")).groupBy("v").agg(F.min("p").alias("p"))
        hook = cut(hook, "hook")
        for _ in range(jumps):
            # pointer doubling: one join, then the table is kept, so no plan grows with the jumps
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            further = cut(join(hook, up, "p").select("v", F.col("pp").alias("p")), "hook")
            release(hook)
            hook = further
        left = hook.select(F.col("v").alias("a"), F.col("p").alias("ra"))
        right = hook.select(F.col("v").alias("b"), F.col("p").alias("rb"))
        contracted = join(join(live, left, "a"), right, "b").where(F.col("ra") != F.col("rb"))
        contracted = cut(contracted.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        release(live)
        live = contracted
        if parents is None:
            parents = hook
        else:
            moved = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            whole = parents.select("p").distinct().join(moved, "p", "left").select("p", F.coalesce("pp", "p").alias("pp"))
            further = cut(join(parents, whole, "p").select("v", F.col("pp").alias("p")), "parents")
            release(parents, hook)
            parents = further
    else:
        raise RuntimeError("components did not settle")
    if parents is None:
        return vertices.select("vertex", F.col("vertex").alias("component"))
    return vertices.join(parents.select(F.col("v").alias("vertex"), "p"), "vertex", "left").select("vertex", F.coalesce("p", "vertex").alias("component"))
