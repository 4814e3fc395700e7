"""Graph operators on edge tables: shared-member components, bounded walks, closure, cycles, precedence, cost limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrework.functions.storage import cut_lineage
from acrework.operators.components import contracted_components
from acrework.operators.joins import DEALT_FROM, MANY, dealt_by, join_groups


def shared_member_components(membership: DataFrame, item: str, entity: str, keep_single: bool = False) -> DataFrame:
    """Components of items that share an entity: component (least item), and per component its size and linking entities.

    Each entity ties its items to the least of them (a star), so an entity with n items gives n - 1 edges.  All items of
    an entity lie in one component, so entities are counted once each, where their least item is.
    """
    known = cut_lineage(membership.filter(F.col(item).isNotNull() & F.col(entity).isNotNull()).select(item, entity).distinct(), "memberships")
    least = cut_lineage(known.groupBy(entity).agg(F.min(item).alias("_least"), F.count("*").alias("_n")), "entities")
    ties = join_groups(known, least, [entity], "_n", known.count())
    placed = contracted_components(ties.select(F.col(item).alias("src"), F.col("_least").alias("dst"))).withColumnRenamed("node", item)
    shared, nodes = dealt_by(["_least"], least.filter("_n > 1").select("_least"), placed.select(F.col(item).alias("_least"), "component"))
    linking = shared.join(nodes.hint("merge"), "_least").groupBy("component").agg(F.count("*").alias("linking"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("size"))
    found = cut_lineage(sizes.join(linking.hint("merge"), "component", "left").fillna(0, ["linking"]).withColumn("_n", F.col("size")), "component-sizes")
    out = join_groups(placed, found, ["component"], "_n", placed.count())
    return out if keep_single else out.filter("size > 1")


#: Rows up to which a table of exceptions is broadcast, and times that the names above names are followed at once.
FEW, JUMPS = 100_000, 2


def _category_trees(rows: DataFrame, category: str, item: str, identities: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components within categories as stored tables: items and values of the first identity, each with ``_top``, and the ``label`` of every ``_top``.

    Values of the first identity are named by their least item (a row without one by its own), and names are merged into
    the least that they reach over the next identity, and on up these trees; the tops of trees are contracted by the last
    names reached.  Items and values of the other identities under which more than one top still meets are found by
    their least and last, and all their ties are contracted.  So rows are dealt a fixed number of times, not in every round.
    """
    first, *rest = identities
    with_ = lambda df, column: df.filter(F.col(column).isNotNull())
    known = rows.filter(F.col(category).isNotNull() & F.col(item).isNotNull() & F.coalesce(*(F.when(F.col(c).isNotNull(), True) for c in identities)).isNotNull()).select(category, item, *identities)
    n = known.count()
    values = cut_lineage(with_(known, first).groupBy(category, first).agg(F.min(item).alias("_x"), F.count("*").alias("_n")), "entities")
    named = join_groups(with_(known, first), values, [category, first], "_n", n).select(category, item, *rest, "_x")
    named = cut_lineage(named.union(known.filter(F.col(first).isNull()).select(category, item, *rest, F.col(item).alias("_x"))), "memberships")
    over = rest[0] if rest else item
    least = cut_lineage(with_(named, over).groupBy(category, over).agg(F.min("_x").alias("_top"), F.count("*").alias("_n")), "entities")
    steps = join_groups(with_(named, over).select(category, over, "_x"), least, [category, over], "_n", n).select(category, "_x", "_top")
    steps = steps.union(named.filter(F.col(over).isNull()).select(category, "_x", F.col("_x").alias("_top")))
    trees = cut_lineage(steps.groupBy(category, "_x").agg(F.min("_top").alias("_top"), F.max("_top").alias("_also"), F.count("*").alias("_n")), "names")
    names = trees.count()

    def up(column: str, to: DataFrame) -> DataFrame:
        """The trees with the name that ``to`` (``_name``, ``_to``) gives for that in a column."""
        above = trees.groupBy(category, column).agg(F.count("*").alias("_below")).join(to.select(category, F.col("_name").alias(column), "_to").hint("merge"), [category, column])
        return join_groups(trees, cut_lineage(above, "names-above"), [category, column], "_below", names)

    for _ in range(JUMPS):
        trees = cut_lineage(up("_top", trees.select(category, F.col("_x").alias("_name"), F.col("_top").alias("_to"))).select(category, "_x", F.col("_to").alias("_top"), "_also", "_n"), "names")
    # most tops are also tied by the last name that one of their names reaches
    also = cut_lineage(up("_also", trees.select(category, F.col("_x").alias("_name"), F.col("_top").alias("_to"))).select(category, F.col("_top").alias("src"), F.col("_to").alias("dst")).distinct(), "name-ties")
    tops = contracted_components(also, within=[category]).select(category, F.col("node").alias("_name"), F.col("component").alias("_to"))
    trees = cut_lineage(up("_top", tops).select(category, "_x", F.col("_to").alias("_top"), "_n"), "names")
    placed = cut_lineage(join_groups(named, trees, [category, "_x"], "_n", n).select(category, item, *rest, "_top"), "memberships")
    items, ties = None, []
    for column in (item, *rest):
        ends = with_(placed, column).groupBy(category, column).agg(F.min("_top").alias("_top"), F.max("_top").alias("_last"), F.count("*").alias("_n"))
        if items is None:
            ends = cut_lineage(ends, "entities")
            items = ends.select(category, item, "_top")
        torn = cut_lineage(ends.filter("_top <> _last").select(category, column, F.col("_top").alias("dst"), "_n"), "torn-entities")
        if (m := torn.count()):
            own = with_(placed, column).select(category, column, "_top")
            met = own.join(F.broadcast(torn.drop("_n")), [category, column]) if m <= FEW else join_groups(own, torn, [category, column], "_n", n)
            ties.append(met.filter("_top <> dst").select(category, F.col("_top").alias("src"), "dst").distinct())
    labels = trees.select(category, "_top").distinct()
    if ties:
        found = contracted_components(reduce(DataFrame.union, ties), within=[category]).withColumnRenamed("node", "_top")
        labels = labels.join(found.hint("merge"), [category, "_top"], "left").select(category, "_top", F.coalesce("component", "_top").alias("label"))
    else:
        labels = labels.withColumn("label", F.col("_top"))
    return items, join_groups(values.drop("_n"), trees, [category, "_x"], "_n", values.count()).select(category, first, "_top"), cut_lineage(labels, "labels")


def category_components(rows: DataFrame, category: str, item: str, identities: list[str]) -> DataFrame:
    """Components of items within a category over several identity columns; adds ``label``, the least item."""
    items, _, labels = _category_trees(rows, category, item, identities)
    below = cut_lineage(items.groupBy(category, "_top").agg(F.count("*").alias("_n")).join(labels.hint("merge"), [category, "_top"]), "labels")
    placed = join_groups(items, below, [category, "_top"], "_n", items.count()).select(category, item, "label")
    a, b = dealt_by([category, item], rows.filter(F.col(category).isNotNull() & F.col(item).isNotNull()), placed)
    return a.join(b.hint("merge"), [category, item])


def category_sizes(rows: DataFrame, category: str, item: str, identities: list[str]) -> DataFrame:
    """The components of ``category_components``: ``label``, number of ``items`` and of ``values`` of the first identity.

    An item or a value lies in one component of its category, so that each is counted once, where it is stored.
    """
    items, values, labels = _category_trees(rows, category, item, identities)
    for name, df in (("items", items), ("values", values)):
        labels = labels.join(df.groupBy(category, "_top").agg(F.count("*").alias(name)).hint("merge"), [category, "_top"], "left")
    return labels.groupBy(category, "label").agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("items", "values")))


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Nodes within ``depth`` steps of the start nodes (column node), with the least number of steps."""
    reached = start.select("node").distinct().withColumn("steps", F.lit(0))
    frontier = reached
    for step in range(1, depth + 1):
        ahead = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = ahead.join(reached, "node", "left_anti").withColumn("steps", F.lit(step))
        reached = reached.unionByName(frontier)
    return reached


def _paths(first: DataFrame, then: DataFrame, rows: int) -> DataFrame:
    """Pairs (src, dst) of a pair of ``first`` and one of ``then`` behind it; ``rows`` is the number of both.

    Large joins are dealt by their rows; those with a node at which more than a million pairs of ``first`` end are left
    to Spark, which splits them.
    """
    a, b = first.select("src", F.col("dst").alias("_mid")), then.select(F.col("src").alias("_mid"), "dst")
    if rows > DEALT_FROM and a.groupBy("_mid").count().filter(F.col("count") > MANY).isEmpty():
        a, b = dealt_by(["_mid"], a, b, rows=rows)
    return a.join(b.hint("merge"), "_mid").select("src", "dst")


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) with a path of one edge or more.  Path lengths double, so few rounds reach any depth.

    A round goes on only from pairs whose shortest path has exactly the round's length, so a forest has no pair built twice.
    The result itself is large where many nodes reach many others; forests of bounded depth are what it is for.
    """
    known = step = cut_lineage(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "closure")
    n = m = known.count()
    while m:
        # pairs first met at twice the length; if there are none, there are none at any greater length
        ahead = cut_lineage(_paths(step, step, 2 * m), "closure-steps")
        a, b = dealt_by(["src", "dst"], ahead, known, rows=ahead.count() + n)
        step = cut_lineage(a.distinct().join(b.hint("merge"), ["src", "dst"], "left_anti"), "closure-steps")
        if not (m := step.count()):
            break
        beyond = cut_lineage(step.union(_paths(step, known, m + n)), "closure-steps")
        (every,) = dealt_by(["src", "dst"], known.union(beyond), rows=n + beyond.count())
        known = cut_lineage(every.distinct(), "closure")
        n = known.count()
    return known


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges whose ends both have edges in and out; what ends or begins a path lies on no cycle."""
    n = edges.count()
    while n:
        into, out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        fewer = cut_lineage(edges.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"), "trimmed-edges")
        m = fewer.count()
        edges = fewer
        if m == n:
            break
        n = m
    return edges, n


def _least_upstream(edges: DataFrame) -> DataFrame:
    """``node`` and ``colour``, the least node from which it can be reached (itself included); only changes travel on."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    now = changed = cut_lineage(nodes.withColumn("colour", F.col("node")), "colours")
    while True:
        offers = changed.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("offer"))
        changed = cut_lineage(now.join(offers, "node").filter("offer < colour").select("node", F.col("offer").alias("colour")), "recoloured")
        if changed.isEmpty():
            return now
        now = cut_lineage(now.join(changed.select("node"), "node", "left_anti").union(changed), "colours")


def strongly_connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``: a node of the set of nodes that all reach each other, the same for all of them.

    Every round trims what lies on no cycle, colours each node with the least one upstream, and walks back from each
    colour's own node inside its colour: what it meets is that node's component.  No table of a round is larger than the
    edges; a round takes as many steps as its longest shortest path.  Edges with a null end add nothing; self-edges only
    their node.
    """
    known = cut_lineage(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "directed-edges")
    nodes = known.select(F.col("src").alias("node")).union(known.select("dst")).distinct()
    live, found = known.filter("src <> dst"), None
    while True:
        live, n = _trimmed(live)
        if not n:
            break
        colours = _least_upstream(live)
        of = lambda end: colours.select(F.col("node").alias(end), F.col("colour").alias(f"_{end}"))
        inside = cut_lineage(live.join(of("src"), "src").join(of("dst"), "dst").filter("_src = _dst").select("src", "dst"), "inside-colours")
        reached = frontier = cut_lineage(colours.filter("node = colour").select("node", F.col("colour").alias("component")), "component-nodes")
        while True:
            back = inside.join(frontier, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), "component").distinct()
            frontier = cut_lineage(back.join(reached, "node", "left_anti"), "walked-back")
            if frontier.isEmpty():
                break
            reached = cut_lineage(reached.union(frontier), "component-nodes")
        found = reached if found is None else found.union(reached)
        gone = reached.select("node")
        live = cut_lineage(live.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "directed-edges")
    if found is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle, self-edges included."""
    placed = strongly_connected(edges)
    larger = placed.groupBy("component").agg(F.count("*").alias("_n")).filter("_n > 1").select("component")
    loops = edges.filter("src = dst").select(F.col("src").alias("node"))
    return placed.join(larger, "component", "left_semi").select("node").union(loops).distinct()


def in_force(applicable: DataFrame, stronger: DataFrame, subject: str, rule: str) -> DataFrame:
    """Applicable rules that no applicable stronger rule (src over dst, transitively) displaces; else the one that does."""
    order = closure(stronger)
    held = applicable.select(subject, rule).distinct()
    displaced = held.join(order, F.col(rule) == F.col("dst")).join(held.select(F.col(subject).alias("_s"), F.col(rule).alias("_r")), (F.col("_s") == F.col(subject)) & (F.col("_r") == F.col("src")))
    by = displaced.groupBy(subject, rule).agg(F.min("src").alias("displaced_by"))
    return held.join(by, [subject, rule], "left")


def reachable_within(edges: DataFrame, sources: DataFrame, limit: float, width: float | None = None) -> DataFrame:
    """Least cost from any source (column node) to each node within a limit; edges have src, dst, cost >= 0.

    Costs are settled in bands of ``width`` (an eighth of the limit), least first.  Inside a band edges are followed until
    no cost in it falls, and only the nodes that changed go on; then its nodes are settled and never looked at again,
    and what they offer beyond the band joins the open nodes.  Empty bands are skipped.  Edges with a null end or cost
    add nothing.
    """
    width = width or max(limit / 8, 1e-300)
    known = cut_lineage(edges.select("src", "dst", "cost").filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("cost") <= limit)), "cost-edges")
    light = known.filter(F.col("cost") <= width)
    none = sources.select("node").limit(0).withColumn("cost", F.lit(0.0))
    waiting, settled = cut_lineage(sources.select("node").filter("node IS NOT NULL").distinct().withColumn("cost", F.lit(0.0)), "reach-open"), none

    def offered(rows: DataFrame, along: DataFrame, kept: Column) -> DataFrame:
        ahead = rows.select("node", F.col("cost").alias("_c")).join(along, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("_c") + F.col("cost")).alias("cost"))
        return ahead.filter((F.col("cost") <= limit) & kept).groupBy("node").agg(F.min("cost").alias("cost"))

    while (least := waiting.agg(F.min("cost")).first()[0]) is not None:
        end = (least // width + 1) * width
        band = changed = waiting.filter(F.col("cost") < end)
        while True:
            mine = band.select("node", F.col("cost").alias("_known"))
            offers = offered(changed, light, F.col("cost") < end).join(settled, "node", "left_anti")
            changed = cut_lineage(offers.join(mine, "node", "left").filter("_known IS NULL OR cost < _known").drop("_known"), "reach-changed")
            if changed.isEmpty():
                break
            band = cut_lineage(band.join(changed.select("node"), "node", "left_anti").union(changed), "reach-band")
        settled = settled.union(band)
        beyond = offered(band, known, F.col("cost") >= end)
        later = waiting.filter(F.col("cost") >= end).union(beyond).groupBy("node").agg(F.min("cost").alias("cost"))
        waiting = cut_lineage(later.join(settled.select("node"), "node", "left_anti"), "reach-open")
    return settled


def references(edges: DataFrame, node: Column) -> DataFrame:
    """Outgoing and incoming edges of one node, with direction."""
    return edges.filter(F.col("src") == node).withColumn("direction", F.lit("out")).unionByName(edges.filter(F.col("dst") == node).withColumn("direction", F.lit("in")))


def compare_networks(before: DataFrame, after: DataFrame) -> DataFrame:
    """Node and edge counts of two edge sets and the reduction in percent."""
    def size(edges: DataFrame, name: str) -> DataFrame:
        nodes = edges.select("src").union(edges.select("dst")).distinct().agg(F.count("*").alias(f"nodes_{name}"))
        return nodes.crossJoin(edges.distinct().agg(F.count("*").alias(f"edges_{name}")))

    both = size(before, "before").crossJoin(size(after, "after"))
    cut = lambda w: 100 * (1 - F.col(f"{w}_after") / F.nullif(f"{w}_before", F.lit(0)))
    return both.withColumns({"node_cut": cut("nodes"), "edge_cut": cut("edges")})
