"""Connected components of a distributed edge list by repeated contraction onto the least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirador.llm.common import discard, materialize


def _falling(edges: DataFrame) -> DataFrame:
    """The distinct edges (src, dst) from the larger end to the smaller, without loops and nulls."""
    return edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (src, dst: long) that has an edge to another; root is the least node of the
    component.

    Each round every node that has a smaller neighbour points to the least, and the graph is contracted along these
    pointers. Node ids are hashes, so rounds are about the logarithm of the longest path. Loops and repeated
    edges do no harm; an empty edge list gives an empty result. State is kept in written tables, never on the driver.
    """
    graph, roots = materialize(_falling(edges), "edges"), None
    for _ in range(most_rounds):
        if graph.isEmpty():
            break
        to = materialize(graph.groupBy("src").agg(F.min("dst").alias("up")), "up")
        new = to.select(F.col("src").alias("node"), F.col("up").alias("root"))
        if roots is not None:  # a node that points on in this round has not done so before
            new = new.union(roots.join(to, roots.root == to.src, "left").select("node", F.coalesce("up", "root").alias("root")))
        new = materialize(new, "roots")
        a, b = to.select("src", F.col("up").alias("x")), to.select(F.col("src").alias("dst"), F.col("up").alias("y"))
        met = graph.join(a, "src").join(b, "dst", "left").select(F.col("x").alias("src"), F.coalesce("y", "dst").alias("dst"))
        smaller = materialize(_falling(met), "edges")
        discard(graph, to, *(() if roots is None else (roots,)))
        graph, roots = smaller, new
    else:
        raise RuntimeError("the components did not settle")
    if roots is None:
        return graph.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    discard(graph)
    return roots.union(roots.select("root", "root").distinct())
