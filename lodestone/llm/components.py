"""Connected components of an edge table, by repeated contraction.

Every round hooks each node to its least neighbour, rewrites the edges by
these parents and drops loops and repeats, so the edge table shrinks by a
constant factor; stars fold in one round. State is written to the shared
folder after each round. Nothing is collected but one emptiness flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, unique_join


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``edges(a long, b long)`` to ``(id long, root long)``.

    One row for each node that has an edge to another; ``root`` is the least
    id of its component. Loops and repeated edges don't matter; an empty
    table gives an empty one. A hub's edges are a hot key of the joins, so a
    node's degree goes with it and hubs are joined apart (``even_join``).
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = scratch.save(e, f"{name}-e0")
    roots, step = None, 0
    while n_edges := e.count():
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("deg")).select(F.col("a").alias("v"), F.least("a", "m").alias("p"), "deg")
        parent = scratch.save(parent, f"{name}-p{step}")
        nodes = 2 * n_edges  # at least
        # the parent's parent: a pointer jump, which halves long chains; a node has a child for each edge at most, and itself
        jump = parent.select(F.col("v").alias("p"), F.col("p").alias("top"), (F.col("deg") + 1).alias("w"))
        up = unique_join(parent.select("v", "p", "deg"), jump, "p", "w", 2 * nodes, nodes)
        up = scratch.save(up.select("v", "top", "deg"), f"{name}-u{step}")
        left = up.select(F.col("v").alias("a"), F.col("top").alias("pa"), F.col("deg").alias("da"))
        right = up.select(F.col("v").alias("b"), F.col("top").alias("pb"), F.col("deg").alias("db"))
        mapped = unique_join(unique_join(e, left, "a", "da", nodes, nodes).select("a", "b", "pa"), right, "b", "db", nodes, nodes)
        nxt = mapped.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).where("a <> b").distinct()
        nxt = scratch.save(nxt, f"{name}-e{step + 1}")
        if roots is None:
            new = up.select(F.col("v").alias("id"), F.col("top").alias("root"))
        else:
            size = roots.groupBy("root").agg(F.count("*").alias("w"))
            moved = scratch.save(up.select(F.col("v").alias("root"), "top").join(size, "root"), f"{name}-m{step}")
            new = unique_join(roots, moved, "root", "w", roots.count(), nodes, how="left").select("id", F.coalesce("top", "root").alias("root"))
        roots = scratch.save(new, f"{name}-r{step + 1}")
        scratch.drop(*(f"{name}-{t}{step}" for t in "epumr"))
        e, step = nxt, step + 1
    if roots is None:
        return edges.sparkSession.createDataFrame([], "id long, root long")
    return roots
