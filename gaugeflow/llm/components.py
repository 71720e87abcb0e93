"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._common import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node on an edge (u, v), root being the smallest node reachable.

    Large-star and small-star steps (Kiveris et al. 2014) in turn, each one aggregation and one join, until the edges
    form stars. Hubs are split by the skew join of adaptive execution. Tables of each round go to the shared folder.
    Repeated edges count once; a node that has no edge but to itself has no row; no edges give an empty result.
    """
    e = written(edges.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), "edges")
    total = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    held = total(e)
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("u", "v", "m")
        new = written(small.selectExpr("explode(array(struct(v AS a, m AS b), struct(u AS a, m AS b))) AS p").selectExpr("p.a AS u", "p.b AS v").where("u <> v").distinct(), "edges")
        e, before, held = new, held, total(new)
        if held == before:
            return e.selectExpr("u AS node", "v AS root")
    raise RuntimeError("components did not settle")
