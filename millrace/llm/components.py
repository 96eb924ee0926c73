"""Connected components of a graph that may be of any size, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(v, label) for each vertex of edges (a, b): the smallest vertex that it is linked with, itself included.

    In each round a vertex takes the least label among its neighbours, then the label of its label, so
    paths halve. Minima combine on the map side, so hubs cost one row per task. Each round is a table in
    the shared folder; the last two are kept until the next.
    """
    both = ws.table(
        edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}_both"
    )
    labels = ws.table(
        both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}_0"
    )
    turn = 0
    while True:
        turn += 1
        heard = (
            both.join(labels.select(F.col("v").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("v"))
            .agg(F.min("label").alias("heard"))
        )
        moved = labels.join(heard, "v", "left").select(
            "v", F.col("label").alias("was"), F.least("label", F.coalesce("heard", "label")).alias("to")
        )
        moved = ws.table(moved, f"{name}_{turn}_moved")
        jumped = moved.join(moved.select(F.col("v").alias("to"), F.col("to").alias("far")), "to", "left").select(
            "v", "was", F.least("to", F.coalesce("far", "to")).alias("label")
        )
        jumped = ws.table(jumped, f"{name}_{turn}")
        changed = jumped.where("label <> was").limit(1).count()
        ws.drop(f"{name}_{turn}_moved")
        ws.drop(f"{name}_{turn - 1}")
        labels = jumped.select("v", "label")
        if not changed:
            ws.drop(f"{name}_both")
            return labels
