"""Rate limits as windows.

``slot_i = max(t_i, slot_{i-1} + interval_{i-1})`` has a closed form: with
``S_i`` the sum of the intervals before i, ``slot_i = S_i + max_{j<=i}(t_j -
S_j)``. Two running windows over one shuffle by origin give every slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def interval_us(per_second: Column, delay_ms: Column) -> Column:
    """Spacing of requests: by the rate (0.1 at least) or the robots delay."""
    by_rate = F.floor(1_000_000 / F.greatest(F.lit(0.1), per_second)).cast("long")
    return F.greatest(by_rate, delay_ms.cast("long") * 1000)


def slots(requests: DataFrame, origin: str, t_us: str, step_us: str, order: list[str]) -> DataFrame:
    """Requests with ``slot_us`` (when each may go) and ``wait_us``."""
    w = W.partitionBy(origin).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    spent = F.sum(step_us).over(upto) - F.col(step_us)
    rows = requests.withColumn("_spent", spent)
    slot = F.col("_spent") + F.max(F.col(t_us) - F.col("_spent")).over(upto)
    return rows.withColumn("slot_us", slot).withColumn("wait_us", F.col("slot_us") - F.col(t_us)).drop("_spent")
