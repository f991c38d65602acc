"""Connected components of an edge table by least-label hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyflow.session import materialise, shared_dir


def _roots(hooks: DataFrame, path: str) -> DataFrame:
    """(old, new) with every chain of hooks followed to its end, by doubling: as many joins as the longest chain's logarithm.

    new is less than old everywhere, so chains end.
    """
    step = 0
    hooks = materialise(hooks, f"{path}_0")
    while True:
        onward = hooks.select(F.col("old").alias("new"), F.col("new").alias("next"))
        far = hooks.join(onward, "new", "left").select("old", F.coalesce("next", "new").alias("new"), F.col("next").isNotNull().alias("moved"))
        step += 1
        far = materialise(far, f"{path}_{step}")
        if far.where("moved").isEmpty():
            return hooks
        hooks = far.select("old", "new")


def components(edges: DataFrame, path: str | None = None) -> DataFrame:
    """(node, component): the least node reachable over edges (a, b), for every node of an edge between two nodes.

    Each round hooks every label with a smaller one beside it to the least such label, follows the hooks to
    their ends and contracts the edges. A label that nothing is hooked to finds a smaller label beside it in the
    next round, so at least half of the labels with an open edge go in any two rounds: the rounds grow with the
    logarithm of the number of nodes, whatever the shape of the graph and the order of its ids. Edges that have become loops
    go, so the work shrinks. Labels live in the shared folder; the driver sees only whether any are left.
    """
    path = path or shared_dir(edges.sparkSession)
    open_edges = materialise(edges.select("a", "b").where("a <> b").distinct(), f"{path}/edges0")
    nodes = open_edges.select(F.col("a").alias("node")).union(open_edges.select("b")).distinct()
    label = nodes.select("node", F.col("node").alias("component"))
    k = 0
    while not open_edges.isEmpty():
        least = open_edges.select(F.greatest("a", "b").alias("old"), F.least("a", "b").alias("new")).groupBy("old").agg(F.min("new").alias("new"))
        root = _roots(least, f"{path}/hooks{k}")
        label = label.join(root, label.component == root.old, "left").select("node", F.coalesce("new", "component").alias("component"))
        label = materialise(label, f"{path}/label{k}")
        k += 1
        for end in ("a", "b"):
            open_edges = open_edges.join(root.withColumnRenamed("old", end), end, "left").select(F.coalesce("new", end).alias(end), "b" if end == "a" else "a")
        open_edges = materialise(open_edges.where("a <> b").distinct(), f"{path}/edges{k}")
    return label
