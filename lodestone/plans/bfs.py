"""Bounded breadth-first search over an edge table.

One job for each level: the level's distinct new nodes are the join of the
last level with the edges, less what was reached before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.work import Work


def levels(edges: DataFrame, seeds: DataFrame, max_depth: int, budget: int | None = None) -> DataFrame:
    """``edges(src, dst)``, ``seeds(node)`` to ``(node, depth)``.

    With ``budget``, at most that many nodes, by (depth, node). Levels are
    appended to one table, so a level's plan is the same at any depth.
    """
    work = Work(edges.sparkSession, "bfs")
    last = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    reached = work.append(last, "reached")
    for depth in range(1, max_depth + 1):
        last = reached.where(F.col("depth") == depth - 1)
        found = last.join(edges, last["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        new = work.save(found.join(reached.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "level")
        if new.isEmpty():
            break
        reached = work.append(new, "reached")
    return reached.orderBy("depth", "node").limit(budget) if budget is not None else reached
