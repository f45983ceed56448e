"""Stateful streams: the frontier's state machine, the limiter, set inserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.plans.work import Work

# The frontier's transitions.
TRANSITIONS = {
    ("PENDING", "FETCHING"), ("RETRY", "FETCHING"), ("FETCHING", "DONE"), ("FETCHING", "RETRY"), ("FETCHING", "SKIPPED"), ("FETCHING", "FAILED"),
}


def frontier_states(moves: DataFrame) -> DataFrame:
    """``moves(key, seq, to)`` to the state of each key after each batch.

    Moves come in ``seq`` order within a batch; one that the machine doesn't
    allow is counted and changes nothing. State: the current state, the
    attempts and the refused moves of a key, a few bytes each.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, attempts, refused = state.get if state.exists else ("PENDING", 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for to in rows["to"]:
            if (now, to) in TRANSITIONS:
                now, attempts = to, attempts + (to == "FETCHING")
            else:
                refused += 1
        state.update((now, attempts, refused))
        yield pd.DataFrame({"key": [key[0]], "status": [now], "attempts": [attempts], "refused": [refused], "seq": [int(rows["seq"].max())]})

    return moves.groupBy("key").applyInPandasWithState(
        step, "key long, status string, attempts int, refused int, seq long", "status string, attempts int, refused int", "update", GroupStateTimeout.NoTimeout
    )


def limiter_slots(requests: DataFrame) -> DataFrame:
    """``requests(origin, seq, t_us, step_us)`` to the slot of each request.

    State: the next free slot of an origin, one number. Requests must come in
    ``seq`` order from batch to batch; within a batch they are sorted here, so
    an origin's rows of one batch are held together: bound a batch by the
    source's options.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        slots = []
        for t, every in zip(rows["t_us"], rows["step_us"]):
            slot = int(t) if free is None else max(int(t), free)
            free = slot + int(every)
            slots.append(slot)
        state.update((free,))
        yield pd.DataFrame({"origin": key[0], "seq": rows["seq"], "slot_us": slots})

    return requests.groupBy("origin").applyInPandasWithState(step, "origin long, seq long, slot_us long", "free long", "append", GroupStateTimeout.NoTimeout)


def replay(rows: DataFrame, part: Column, parts: int, build: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """A table as a stream that arrives in parts; the built stream's rows.

    Part ``k`` (0 to ``parts - 1``, by the column ``part``) is written to the
    stream's folder, then the query runs over all that is there and stops. The
    next part starts it again from its checkpoint, so state, watermark and
    batch numbers are carried over as after a restart. Each batch is written
    under its number; one that is run again after a failure replaces itself.
    """
    spark = rows.sparkSession
    work = Work(spark, "stream")
    names = rows.columns
    rows = rows.withColumn("_part", part)
    schema = None

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work.root}/out/batch={number}")

    for k in range(parts):
        work.append(rows.where(F.col("_part") == k).select(*names), "in")
        stream = build(spark.readStream.schema(rows.select(*names).schema).parquet(f"{work.root}/in"))
        schema = stream.schema
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{work.root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return spark.read.schema(f"{kinds}, batch int").parquet(f"{work.root}/out")


def quarter(rows: DataFrame, by: Column) -> Column:
    """Number of the quarter, 0 to 3, of the range of a whole-number column."""
    lo, hi = rows.agg(F.min(by), F.max(by)).first()
    return F.floor(4.0 * (by - (lo or 0)) / ((hi or 0) - (lo or 0) + 1)).cast("int")


def first_seen(rows: DataFrame, keys: list[str], event_time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key, with state only as old as the watermark."""
    return rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, event_time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key; late rows beyond the watermark go."""
    return events.withWatermark(event_time, late).groupBy(F.window(event_time, width), key).agg(F.count("*").alias("n"))
