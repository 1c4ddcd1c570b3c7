"""Graph operators: closure, paths, flag propagation, components. Each round is one join; tables cut the lineage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T

from cairnmark.session import materialize


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], name: str = "round") -> DataFrame:
    """All rows that step reaches from start: the frontier is extended, less what is known, until nothing is new."""
    known = frontier = materialize(start.distinct(), name)
    rounds = 0
    while True:
        new = materialize(step(frontier).distinct().join(known, known.columns, "left_anti"), name)
        if new.isEmpty():
            return known
        known, frontier, rounds = known.unionByName(new), new, rounds + 1
        if rounds % 32 == 0:
            known = materialize(known, name)  # a plan of bounded size


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node) reachable from roots (node) over edges (src, dst), roots included; each once, however many paths lead there."""
    return fixpoint(roots.select("node"), lambda f: f.join(edges, f["node"] == edges["src"]).select(F.col("dst").alias("node")), "closure")


def paths_to(edges: DataFrame, targets: DataFrame, roots: DataFrame) -> DataFrame:
    """(target, root, steps): every path from a root (node, root) down labelled edges (src, dst, step) to a target (node).

    Paths are walked backwards; several steps of one parent, and several parents, give several paths (no distinct). They
    may be of any length; a cycle, which has no end of paths, fails once a path has more steps than there are nodes.
    """
    at = targets.select(F.col("node").alias("target"), "node", F.array().cast("array<string>").alias("steps"))
    kinds = [T.StructField("target", targets.schema["node"].dataType), roots.schema["root"], T.StructField("steps", T.ArrayType(T.StringType()))]
    out, depth, nodes = targets.sparkSession.createDataFrame([], T.StructType(kinds)), 0, None
    while True:
        at = materialize(at, "paths")
        if at.isEmpty():
            return out
        out = out.unionByName(at.join(roots, "node").select("target", "root", "steps"))
        if depth % 16 == 15:
            out = materialize(out, "found")  # a plan of bounded size
            nodes = nodes or edges.select("src").union(edges.select("dst")).distinct().count()
            if depth > nodes:
                raise ValueError("the edges have a cycle")
        at = at.join(edges, at["node"] == edges["dst"]).select("target", F.col("src").alias("node"), F.concat(F.array("step"), "steps").alias("steps"))
        depth += 1


def propagate_flags(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, flag): a node is flagged if it is in nodes (node, flag), or if any src of its edges (src, dst) is."""
    flagged = closure(edges, nodes.filter("flag").select("node"))
    return nodes.select("node").join(flagged.withColumn("f", F.lit(True)), "node", "left").select("node", F.coalesce("f", F.lit(False)).alias("flag"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that edges (a, b), either way, lead to, by contraction of the graph.

    Each round every node that still has an edge hooks on to its first neighbour, in an order by hash that is another
    one each round (summed up before the shuffle, so that hubs are cheap). Such hooks form trees, as only two nodes
    that hook on to each other make a cycle; trees are followed to their roots by pointer jumping, and edges are led to
    the roots. At most half of the nodes with edges are left after a round, whatever the shape of the graph, so rounds
    are logarithmic in the nodes; they run until no edge is left. A node whose only edge leads to itself is its own
    component.
    """
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b"))
    labels = materialize(ends.distinct().withColumn("root", F.col("node")), "labels")
    now, step = materialize(_undirected(edges), "edges"), 0
    while not now.isEmpty():
        both = now.union(now.select("b", "a"))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b", F.lit(step)).alias("h"), "b")).alias("f"))
        up = materialize(first.select("node", F.col("f.b").alias("up")), "hooks")
        # the first jump turns the two that hook on to each other into a root and a child
        above = F.when(F.col("top") == F.col("node"), F.least("node", "up")).otherwise(F.col("top"))
        while True:
            jump = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            new = materialize(up.join(jump, "up").select("node", F.col("up").alias("old"), above.alias("up")), "hooks")
            up, above = new.select("node", "up"), F.col("top")
            if new.filter("old <> up").isEmpty():
                break
        at = labels.join(up.withColumnRenamed("node", "root"), "root", "left")
        labels = materialize(at.select("node", F.coalesce("up", "root").alias("root")), "labels")
        led = now.join(up.toDF("a", "x"), "a").join(up.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        now, step = materialize(_undirected(led), "edges"), step + 1
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return materialize(labels.join(least, "root").select("node", "component"), "labels")


def _undirected(pairs: DataFrame) -> DataFrame:
    """Distinct edges (a, b) with a < b."""
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, scc): strongly connected components of edges (src, dst), named by their least node.

    Rounds of colouring: every node takes the greatest node that reaches it; of each colour, what reaches its root
    backwards within the colour is one component and leaves.
    """
    left = materialize(edges.select("src", "dst").distinct(), "scc")
    nodes = materialize(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct(), "scc")
    done = None
    while not nodes.isEmpty():
        colour = nodes.select("node", F.col("node").alias("c"))
        while True:
            colour = materialize(colour, "scc")
            came = left.join(colour, left["src"] == colour["node"]).groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("m"))
            new = materialize(colour.join(came, "node", "left").select("node", F.col("c").alias("old"), F.greatest("c", F.coalesce("m", "c")).alias("c")), "scc")
            colour = new.select("node", "c")
            if new.filter("old <> c").isEmpty():
                break
        inner = left.join(colour.select(F.col("node").alias("src"), F.col("c").alias("sc")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("dc")), "dst").filter("sc = dc")
        back = materialize(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "scc")
        hit = closure(back, colour.filter("node = c").select("node"))
        found = materialize(hit.join(colour, "node").select("node", "c"), "scc")
        done = found if done is None else done.unionByName(found)
        nodes = materialize(nodes.join(found, "node", "left_anti"), "scc")
        left = materialize(left.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi"), "scc")
    if done is None:
        return nodes.select("node", F.col("node").alias("scc"))
    least = done.groupBy("c").agg(F.min("node").alias("scc"))
    return done.join(least, "c").select("node", "scc")
