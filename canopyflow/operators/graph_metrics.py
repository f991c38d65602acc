"""Diameters and strong components of a graph, and its summary.

Weak components of up to `small` nodes are solved in one group each, a bounded one; larger ones by rounds of joins over all of
them at once, whose state is written below the shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyflow.operators.components import components
from canopyflow.session import materialise, shared_dir

SMALL = 2048


# ---- one component in NumPy ---------------------------------------------------------------------


def _neighbours(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(a, kind="stable")
    return b[order], np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))])


def _distances(to: np.ndarray, at: np.ndarray, source: int) -> np.ndarray:
    far = np.full(len(at) - 1, -1)
    front, d = np.array([source]), 0
    far[source] = 0
    while len(front):
        d += 1
        near = np.unique(np.concatenate([to[at[v] : at[v + 1]] for v in front.tolist()]))
        front = near[far[near] < 0]
        far[front] = d
    return far


def diameter(a: np.ndarray, b: np.ndarray) -> int:
    """The greatest distance in one connected undirected graph of edges a - b: searches from the node that may be furthest out
    and from the one that may be most central, in turn, narrow all eccentricities until their bounds meet."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = len(names)
    a, b = ends[: len(a)], ends[len(a) :]
    to, at = _neighbours(np.concatenate([a, b]), np.concatenate([b, a]), n)
    low, high, outer = np.zeros(n, np.int64), np.full(n, n, np.int64), True
    while low.max() < min(high.max(), 2 * high.min()):
        unsettled = np.flatnonzero(low < high)
        v = unsettled[high[unsettled].argmax()] if outer else unsettled[low[unsettled].argmin()]
        d = _distances(to, at, int(v))
        low, high = np.maximum(low, np.maximum(d.max() - d, d)), np.minimum(high, d.max() + d)
        outer = not outer
    return int(low.max())


def strong(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its strong component) of directed edges a -> b, by the two-stack depth-first search."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = len(names)
    to, at = _neighbours(ends[: len(a)], ends[len(a) :], n)
    number, owner, seen = np.full(n, -1), np.full(n, -1), 0
    path: list[int] = []
    open_: list[int] = []
    for root in range(n):
        if number[root] >= 0:
            continue
        work = [(root, int(at[root]))]
        number[root] = seen = seen + 1
        path.append(root)
        open_.append(root)
        while work:
            v, k = work.pop()
            if k < at[v + 1]:
                work.append((v, k + 1))
                w = int(to[k])
                if number[w] < 0:
                    number[w] = seen = seen + 1
                    path.append(w)
                    open_.append(w)
                    work.append((w, int(at[w])))
                elif owner[w] < 0:
                    while number[open_[-1]] > number[w]:
                        open_.pop()
            elif open_[-1] == v:
                open_.pop()
                group = path[path.index(v) :] if path[-1] != v else [v]
                del path[len(path) - len(group) :]
                owner[group] = min(group)
    return names, names[owner]


# ---- all components -----------------------------------------------------------------------------


def _with_component(edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, component, size) without loops and repeats, and (component, size)."""
    label = components(edges, f"{path}/components")
    sizes = label.groupBy("component").agg(F.count("*").alias("size"))
    named = edges.select("a", "b").where("a <> b").distinct().join(label.withColumnRenamed("node", "a"), "a").join(sizes, "component")
    return materialise(named.select("a", "b", "component", "size"), f"{path}/named"), sizes


def diameters(edges: DataFrame, small: int = SMALL, path: str | None = None) -> DataFrame:
    """(component, size, diameter) of every weak component of edges (a, b) between two nodes, exact; component is its least node."""
    path = path or shared_dir(edges.sparkSession)
    named, sizes = _with_component(edges, path)
    kind = dict(named.dtypes)["component"]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"component": [rows["component"].iloc[0]], "diameter": [diameter(rows["a"].to_numpy(), rows["b"].to_numpy())]})

    few = named.where(F.col("size") <= small).select("component", "a", "b").groupBy("component").applyInPandas(one, f"component {kind}, diameter long")
    many = named.where(F.col("size") > small)
    found = few if many.isEmpty() else few.unionByName(_bounded_rounds(many, path))
    return sizes.join(found, "component").select("component", "size", "diameter")


def _levels(sources: DataFrame, ways: DataFrame, path: str) -> DataFrame:
    """(component, node, d): distances from one source a component (component, node) over ways (node, next) of both directions.

    A front meets only the two before it, so a level costs a join with the ways and two with small fronts.
    """
    front = materialise(sources.select("component", "node", F.lit(0).cast("long").alias("d")), f"{path}/0")
    before, k = front.limit(0), 0
    while not front.isEmpty():
        k += 1
        near = front.join(ways, "node").select("component", F.col("next").alias("node")).distinct()
        near = near.join(front.select("node"), "node", "left_anti").join(before.select("node"), "node", "left_anti")
        before, front = front, materialise(near.select("component", "node", F.lit(k).cast("long").alias("d")), f"{path}/{k}")
    return sources.sparkSession.read.schema(front.schema).parquet(*[f"{path}/{i}" for i in range(k + 1)])


def _bounded_rounds(named: DataFrame, path: str) -> DataFrame:
    """(component, diameter) as diameter() finds it, for all components together: a round searches from one node of each open one."""
    ways = named.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(named.select(F.col("b").alias("node"), F.col("a").alias("next")))
    ways = materialise(ways.distinct(), f"{path}/ways")
    nodes = named.select("component", "size", F.col("a").alias("node")).unionByName(named.select("component", "size", F.col("b").alias("node"))).distinct()
    state = materialise(nodes.select("component", "node", F.lit(0).cast("long").alias("low"), F.col("size").alias("high")), f"{path}/bounds0")
    done, k = None, 0
    while True:
        top = state.groupBy("component").agg(F.max("low").alias("most"), F.max("high").alias("widest"), F.min("high").alias("least"))
        settled = F.col("most") >= F.least("widest", 2 * F.col("least"))
        closed = materialise(top.select("component", F.col("most").alias("diameter"), settled.alias("settled")), f"{path}/closed{k}")
        new = closed.where("settled").select("component", "diameter")
        done = new if done is None else done.unionByName(new)
        if closed.where("not settled").isEmpty():
            return done
        state = state.join(closed.where("not settled").select("component"), "component", "left_semi")
        by = F.struct(-F.col("high"), "node") if k % 2 == 0 else F.struct("low", "node")
        sources = state.where("low < high").groupBy("component").agg(F.min(by).alias("s")).select("component", F.col("s.node").alias("node"))
        far = _levels(sources, ways, f"{path}/search{k}")
        reach = far.groupBy("component").agg(F.max("d").alias("e"))
        state = state.join(far.drop("component"), "node").join(reach, "component")
        low = F.greatest("low", F.col("e") - F.col("d"), "d")
        k += 1
        state = materialise(state.select("component", "node", low.alias("low"), F.least("high", F.col("e") + F.col("d")).alias("high")), f"{path}/bounds{k}")


def strong_components(edges: DataFrame, small: int = SMALL, path: str | None = None) -> DataFrame:
    """(node, component): the least node of the strong component of every node of directed edges (a, b)."""
    path = path or shared_dir(edges.sparkSession)
    named, _ = _with_component(edges, path)
    kind = dict(named.dtypes)["a"]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        node, component = strong(rows["a"].to_numpy(), rows["b"].to_numpy())
        return pd.DataFrame({"node": node, "component": component})

    few = named.where(F.col("size") <= small).select("component", "a", "b").groupBy("component").applyInPandas(one, f"node {kind}, component {kind}")
    many = named.where(F.col("size") > small).select("a", "b")
    return few if many.isEmpty() else few.unionByName(_coloured_rounds(many, path))


def _coloured_rounds(edges: DataFrame, path: str) -> DataFrame:
    """Strong components by joins: nodes without a way in or out go alone; then the greatest name that reaches a node colours it,
    and what reaches that name within its colour is its component."""
    spark, k = edges.sparkSession, 0
    every = materialise(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), f"{path}/nodes")
    left, cores = materialise(edges, f"{path}/left0"), []
    while True:
        while True:  # trim what lies on no circle
            k += 1
            kept = left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
            kept = materialise(kept.select("a", "b"), f"{path}/left{k}")
            same = kept.count() == left.count()
            left = kept
            if same:
                break
        if left.isEmpty():
            break
        colour = left.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("colour"), F.lit(True).alias("moved"))
        colour, step = materialise(colour, f"{path}/colour{k}_0"), 0
        while not (front := colour.where("moved")).isEmpty():
            step += 1
            more = left.join(front.select(F.col("node").alias("a"), F.col("colour").alias("c")), "a").groupBy(F.col("b").alias("node")).agg(F.max("c").alias("c"))
            met = colour.join(more, "node", "left").select("node", F.greatest("colour", F.coalesce("c", "colour")).alias("new"), "colour")
            colour = materialise(met.select("node", F.col("new").alias("colour"), (F.col("new") != F.col("colour")).alias("moved")), f"{path}/colour{k}_{step}")
        within = left.join(colour.select(F.col("node").alias("a"), F.col("colour").alias("ca")), "a").join(colour.select(F.col("node").alias("b"), "colour"), "b").where("ca = colour").select("a", "b", "colour")
        within = materialise(within, f"{path}/within{k}")
        reached = front = materialise(colour.where("node = colour").select("node", "colour"), f"{path}/reach{k}_0")
        step = 0
        while not front.isEmpty():
            step += 1
            near = within.join(front.select(F.col("node").alias("b")), "b").select(F.col("a").alias("node"), "colour").distinct().join(reached.select("node"), "node", "left_anti")
            front = materialise(near, f"{path}/reach{k}_{step}")
            reached = reached.unionByName(front)
        least = reached.groupBy("colour").agg(F.min("node").alias("component"))
        core = materialise(reached.join(least, "colour").select("node", "component"), f"{path}/core{k}")
        cores.append(f"{path}/core{k}")
        for end in ("a", "b"):
            left = left.join(core.select(F.col("node").alias(end)), end, "left_anti")
        left = materialise(left.select("a", "b"), f"{path}/left{k}_rest")
    if not cores:
        return every.select("node", F.col("node").alias("component"))
    found = spark.read.parquet(*cores)
    return every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def graph_summary(nodes: DataFrame, edges: DataFrame, small: int = SMALL, path: str | None = None) -> DataFrame:
    """One row: nodes, edges, mean degree, nodes without a way in or out, weak and strong components and their largest, diameters.

    nodes: (node); edges: (a, b) between them. A node without an edge is a component of its own with diameter 0.
    """
    path = path or shared_dir(nodes.sparkSession)
    wide = diameters(edges, small, f"{path}/weak")
    alone = nodes.select("node").distinct().join(edges.select(F.col("a").alias("node")).where("a <> b").union(edges.select("b").where("a <> b")).distinct(), "node", "left_anti")
    weak = materialise(wide.unionByName(alone.select(F.col("node").alias("component"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("diameter"))), f"{path}/diameters")
    firm = strong_components(edges, small, f"{path}/strong").groupBy("component").agg(F.count("*").alias("size"))
    firm = firm.unionByName(alone.select(F.col("node").alias("component"), F.lit(1).cast("long").alias("size")))
    ends = lambda c: nodes.select("node").distinct().join(edges.select(F.col(c).alias("node")).distinct(), "node", "left_anti").agg(F.count("*").alias(f"zero_{c}"))
    size = nodes.select("node").distinct().agg(F.count("*").alias("num_nodes"))
    out = size.join(F.broadcast(edges.agg(F.count("*").alias("num_edges")))).join(F.broadcast(ends("a"))).join(F.broadcast(ends("b")))  # one row each
    out = out.join(F.broadcast(weak.agg(F.count("*").alias("weak_components"), F.max("size").alias("largest_weak"), F.max("diameter").alias("max_diameter"), F.avg("diameter").alias("average_diameter"), F.median("diameter").alias("median_diameter"))))
    out = out.join(F.broadcast(firm.agg(F.count("*").alias("strong_components"), F.max("size").alias("largest_strong"))))
    return out.withColumn("average_degree", F.coalesce(F.col("num_edges") / F.nullif("num_nodes", F.lit(0)), F.lit(0.0))).withColumnsRenamed({"zero_a": "zero_out_degree", "zero_b": "zero_in_degree"})
