"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrill.llm.workspace import Workspace


def components(ws: Workspace, edges: DataFrame, tag: str) -> DataFrame:
    """(id, component): the smallest id reachable, for every end of an edge.

    ``edges`` has long columns ``a`` and ``b``.  Every round takes the smallest label
    among the neighbours and then jumps to the label's own label, so a chain of d
    links needs O(log d) rounds; a hub is pre-aggregated on the map side.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = ws.table(both.filter("a <> b").distinct(), f"{tag}-links")
    labels = ws.table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), f"{tag}-0")
    done = 0
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("near"))
        hooked = labels.join(seen, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("up"))
        moved = hooked.join(jump, "c", "left").select("id", F.least("c", F.coalesce("up", "c")).alias("component"), "old")
        moved = ws.table(moved, f"{tag}-{done + 1}")
        changed = moved.filter("component <> old").limit(1).count()
        ws.drop(f"{tag}-{done}")
        labels = moved.select("id", "component")
        done += 1
        if not changed:
            ws.drop(f"{tag}-links")
            return labels
