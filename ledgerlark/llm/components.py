"""Connected components of links by alternating large and small stars."""

from pyspark.sql import functions as F

from ledgerlark.plans import lineage


def _state(edges):
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("sum")).first()
    return row["n"], row["sum"]


def components(links):
    """The smallest node of the component of every node in ``links`` (a, b): node, root.

    Each round hangs neighbours to the smallest one they know, so the depth of a
    component halves at least; a node's neighbours never meet in one row or task
    state, only their minimum does. Loops and null ends are ignored."""
    edges = links.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    edges = lineage.cut(edges.distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("least")).select("x", F.least("x", "least").alias("least"))
        large = both.join(least, "x").filter("y > x").select(F.col("least").alias("u"), F.col("y").alias("v")).distinct()
        roots = large.groupBy("v").agg(F.min("u").alias("root"))
        hung = large.join(roots, "v").select(F.col("root").alias("u"), F.col("u").alias("v")).filter("u <> v")
        edges = lineage.cut(hung.union(roots.select(F.col("root").alias("u"), "v")).distinct(), "edges")
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(edges.select("u", "u").distinct())
