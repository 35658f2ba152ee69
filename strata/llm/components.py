"""Connected components of a table of links, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``comp``, the smallest node it is connected to, for every end of a link.

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots by
    doubling, and contracts the links to links between roots. A round at least halves the
    nodes that still have links. Every table is written, so no lineage grows.
    """
    edges = stored(links.select("a", "b").filter("a <> b").distinct(), "links")
    forest = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
            doubled = stored(hooks.join(up, "comp").select("node", F.col("above").alias("comp"), (F.col("above") != F.col("comp")).alias("moved")), "hooks")
            hooks = doubled.drop("moved")
            if doubled.filter("moved").isEmpty():
                break
        roots = hooks.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        if forest is None:
            forest = hooks
        else:
            forest = stored(forest.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "forest")
        ends = {side: hooks.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_root")) for side in "ab"}
        contracted = edges.join(ends["a"], "a").join(ends["b"], "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        edges = stored(contracted.filter("a <> b").distinct(), "links")
    return forest if forest is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
