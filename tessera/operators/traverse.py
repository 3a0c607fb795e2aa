"""Graph walks: a frontier loop over an edge DataFrame with a visited set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as S

from tessera.errors import ValidationError
from tessera.sources.stage import cut, release, staged

CHECKPOINT_EVERY = 4


def traverse(starts: DataFrame, edges: DataFrame, direction: str = "down", max_depth: int = -1, include_start: bool = False, path: bool = False) -> DataFrame:
    """Every node reached from the starts, once, with its smallest depth; with path=True also with the smallest of the
    shortest paths to it, as an array from its start on.

    starts: column node. edges: columns src, dst; 'down' follows src to dst and 'up' dst to src. The starts count as
    visited, so a cycle doesn't give them again. max_depth -1: no bound. The different edges are staged once, dealt by their
    source; lineage is cut by reliable checkpoints.
    """
    if direction not in ("up", "down"):
        raise ValidationError("direction is 'up' or 'down'")
    if direction == "up":
        edges = edges.select(S.col("dst").alias("src"), S.col("src").alias("dst"))
    edges = staged(edges.where("src is not null and dst is not null").select("src", "dst").distinct().repartition("src"), "graph")
    visited = starts.where("node is not null").select("node").distinct().withColumn("depth", S.lit(0))
    if path:
        visited = visited.withColumn("path", S.array("node"))
    frontier, depth = cut(visited), 0
    visited = frontier
    while depth != max_depth:
        depth += 1
        met = frontier.join(edges, S.col("node") == S.col("src"))
        if path:
            found = met.groupBy(S.col("dst").alias("node")).agg(S.min(S.concat("path", S.array("dst"))).alias("path"))
        else:
            found = met.select(S.col("dst").alias("node")).distinct()
        frontier = cut(found.join(visited, "node", "left_anti").withColumn("depth", S.lit(depth)).select(*visited.columns))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        if depth % CHECKPOINT_EVERY == 0:
            visited = cut(visited)
    visited = cut(visited)
    release(edges)
    return visited if include_start else visited.where("depth > 0")
