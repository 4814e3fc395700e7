"""Connected components by alternating large-star and small-star steps, and by contraction for large, dense graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrework.functions.storage import cut_lineage
from acrework.operators.joins import join_groups


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the least node of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node`` and ``component`` (the least node reachable) for every node of an undirected edge.

    Counts are combined before they are shuffled, and the joins are merged by hint (edges are many in few bytes, and would
    be broadcast), so the adaptive skew join splits a node with very many edges.  Each round is written to shared storage.  Edges with a null end and self-edges add nothing
    but their own node; a frame without edges gives no rows.  Nodes must be of an orderable type.
    """
    known = edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("u"), F.col(dst).alias("v"))
    alone = known.filter("u = v").select(F.col("u").alias("node"))
    now = cut_lineage(known.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "component-edges")
    mark = None
    while True:  # the steps needed grow with the logarithm of the node count
        now = cut_lineage(_small_star(_large_star(now)).filter("u <> v").distinct(), "component-edges")
        # a star forest is a fixed point of both steps, so an unchanged set of edges is the result
        seen = now.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = found.select(F.col("component").alias("node")).distinct().select("node", F.col("node").alias("component"))
    lone = alone.distinct().join(found.select("node").union(roots.select("node")).hint("merge"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.union(roots).union(lone)


def _contracted(edges: DataFrame, to: DataFrame, within: list[str], rows: int) -> DataFrame:
    """The edges between merged nodes; ``to`` has node, rep and ``_n``, the number of the node's edge ends."""
    for end in ("u", "v"):
        edges = join_groups(edges, to.select(*within, F.col("node").alias(end), F.col("rep").alias(f"_{end}"), "_n"), [*within, end], "_n", rows).drop(end)
    return edges.filter("_u <> _v").select(*within, F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v")).distinct()


def contracted_components(edges: DataFrame, src: str = "src", dst: str = "dst", within: Sequence[str] = ()) -> DataFrame:
    """``node`` and ``component`` (the least node reachable) for every node of an undirected edge.

    With ``within``, nodes are told apart by those columns too, and the result has them; they are never null.

    Each round every node is merged into one of its neighbourhood, in turn the least node and the one of the least hash
    of the round; hashes leave a constant share of the nodes at most, whatever the order of their names.  So tables shrink
    from round to round, and names are handed down once at the end.  Edges are counted before they are shuffled; nodes
    with very many edges and merged nodes of very many are joined by broadcast, there are few of them.  Edges with a
    null end add nothing and self-edges only their own node; a frame without edges gives no rows.  Nodes must be of an
    orderable type.
    """
    within, found, round_ = list(within), [], 0
    now = edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(*within, F.col(src).alias("u"), F.col(dst).alias("v"))
    now = cut_lineage(now, "component-edges")
    while (rows := now.count()) or round_ == 0:
        ends = now.union(now.select(*within, F.col("v").alias("u"), F.col("u").alias("v"))).groupBy(*within, "u")
        if round_ % 2 == 0:
            rep = ends.agg(F.min("v").alias("_m"), F.count("*").alias("_n")).withColumn("rep", F.least("u", "_m"))
        else:
            rank = lambda c: F.xxhash64(c, F.lit(round_))  # noqa: E731, B023
            rep = ends.agg(F.min_by("v", rank("v")).alias("_m"), F.count("*").alias("_n")).withColumn("rep", F.when(rank("u") < rank("_m"), F.col("u")).otherwise(F.col("_m")))
        found.append(cut_lineage(rep.select(*within, F.col("u").alias("node"), "rep", "_n"), "merged-nodes"))
        now = cut_lineage(_contracted(now, found[-1], within, rows), "component-edges")
        round_ += 1
    last = None  # node of a round, and what it is merged into in the end
    for i, to in reversed(list(enumerate(found))):
        rows = to.count()
        merged = to.groupBy(*within, "rep").agg(F.count("*").alias("_n"), F.min("node").alias("_least"))
        if last is not None:
            merged = merged.join(last.select(*within, F.col("node").alias("rep"), "last").hint("merge"), [*within, "rep"], "left")
            merged = merged.withColumn("last", F.coalesce("last", "rep"))
        else:
            merged = merged.withColumn("last", F.col("rep"))
        if i == 0:
            merged = cut_lineage(merged, "merged-nodes")
            names = cut_lineage(merged.groupBy(*within, "last").agg(F.min("_least").alias("component"), F.count("*").alias("_n")), "component-names")
            merged = join_groups(merged.withColumnRenamed("_n", "_nodes"), names, [*within, "last"], "_n", rows).select(*within, "rep", F.col("component").alias("last"), F.col("_nodes").alias("_n"))
        merged = cut_lineage(merged.select(*within, "rep", "last", "_n"), "merged-nodes")
        last = cut_lineage(join_groups(to.drop("_n"), merged, [*within, "rep"], "_n", rows).select(*within, "node", "last"), "merged-nodes")
    return last.withColumnRenamed("last", "component")
