"""Connected components of an edge list by contraction, on DataFrames only.

Each round hooks every node to its smallest neighbour, jumps pointers once, and keeps the edges between different roots;
the graph shrinks by at least half each round. Stars with millions of leaves are met by partial aggregation (min).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.stage import release, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node id of each node's component, for edges (u, v); nodes without edges are absent.
    The result is staged."""
    edges = staged(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("p"))
        jump = hook.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        hook = staged(hook.join(jump, "p").select("node", F.col("pp").alias("p")), "hooks")
        rounds.append(hook)
        a, b = hook.select(F.col("node").alias("u"), F.col("p").alias("pu")), hook.select(F.col("node").alias("v"), F.col("p").alias("pv"))
        step = edges.join(a, "u").join(b, "v").where("pu <> pv")
        before, edges = edges, staged(step.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        release(before)
    out = rounds[0] if rounds else edges.select(F.col("u").alias("node"), F.col("v").alias("p"))
    for r in rounds[1:]:
        out = out.join(r.select(F.col("node").alias("p"), F.col("p").alias("q")), "p", "left").select("node", F.coalesce("q", "p").alias("p"))
    # roots are the smallest of their component already, as hooks only go down
    out = staged(out.select("node", F.col("p").alias("component")), "components")
    release(edges, *rounds)
    return out
