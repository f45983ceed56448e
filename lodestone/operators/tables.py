"""Keys, set inserts, integrity, limits and latest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_A_TASK = 2_000


def dealt(rows: DataFrame, key: str, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """Rows by a unique key over as many tasks as there are ``rows_a_task``, for a step that takes long for a row.

    Tasks follow bytes otherwise: a file of a few megabytes is one task's, however many rows it has.
    """
    return rows.repartition(max(1, -(-rows.count() // rows_a_task)), key)


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def set_insert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The rows of ``new`` that a unique key would let in: first ones, not there yet."""
    return keep_first(new, keys, order).join(existing.select(*keys), list(keys), "left_anti")


def insert_report(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``new`` with ``inserted``: whether each row gets in."""
    w = W.partitionBy(*keys).orderBy(*order)
    there = existing.select(*keys).distinct().withColumn("_there", F.lit(True))
    ranked = new.withColumn("_rank", F.row_number().over(w)).join(there, list(keys), "left")
    return ranked.withColumn("inserted", (F.col("_rank") == 1) & F.col("_there").isNull()).drop("_rank", "_there")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose reference leads nowhere."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def latest(events: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Current state from appended transitions: the last row of each key."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(o) if isinstance(o, str) else o.desc() for o in order])
    return events.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def listing(rows: DataFrame, order: Sequence[Column | str], limit: int = 100, most: int = 500) -> DataFrame:
    """An ordered page of rows; the limit is held between 1 and ``most``."""
    return rows.orderBy(*order).limit(max(1, min(limit, most)))
