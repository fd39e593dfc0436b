"""Connected components of a link table in Spark rounds, nothing whole on the driver or in one task.

Each round gives every node the least label among its own and its neighbours', then lets labels jump
along themselves (label of the label), so the number of rounds follows the logarithm of a component's
diameter. Aggregations combine before they shuffle, and each round's labels are written to the shared
folder, so lost executors cost one round at most. An empty link table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove


def components(links: DataFrame, name: str = "components", max_rounds: int = 60, kept: list[str] | None = None) -> DataFrame:
    """(node, root): the least node of each linked node's component. links: (a, b) of one ordered type. kept: gets the path of the table returned."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    paths: list[str] = []
    edges = materialise(both.distinct(), f"{name}-edges", paths)
    labels = materialise(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), f"{name}-0", paths)
    for k in range(1, max_rounds + 1):
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("root").alias("m"))
        better = labels.join(near, labels.node == near.a).select("node", F.least("root", "m").alias("root"), F.col("root").alias("was"))
        better = materialise(better, f"{name}-{k}a", paths)
        up = better.select(F.col("node").alias("up"), F.col("root").alias("top"))
        jumped = better.join(up, better.root == up.up, "left").select("node", F.least("root", F.coalesce("top", "root")).alias("root"), "was")
        done = materialise(jumped, f"{name}-{k}b", paths)
        labels = done.select("node", "root")
        settled = done.filter("root <> was").isEmpty()
        # what later rounds read: the edges and the last labels
        first_stale = 1 if not settled else 0
        remove(links.sparkSession, paths[first_stale:-1])
        paths = [*paths[:first_stale], paths[-1]]
        if settled:
            if kept is not None:
                kept.append(paths[-1])
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
