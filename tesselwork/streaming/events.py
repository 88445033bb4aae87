"""Streaming forms of the sequence operators. The reference engine has none; these are additions for event streams.

Each function takes a streaming (or static) DataFrame and returns one; state is bounded by a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by kind in tumbling windows; rows later than ``late`` are dropped with their state."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    by = timed.groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return by.select(F.col("w.start").alias("start"), kind, "n")


def session_counts(events: DataFrame, time: str, key: str, gap: str = "6 hours", late: str = "12 hours") -> DataFrame:
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    by = timed.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return by.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Repeats within the watermark go; one row of each key stays."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def running_islands(events: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Number the stretches of equal neighbouring values of each key as rows arrive.

    State of a key is its last value and run number. Rows of one micro-batch are taken in their order; a row that
    arrives in a later batch continues from there.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = []
        for v in rows[value]:
            if n == 0 or v != last:
                last, n = v, n + 1
            out.append(n)
        state.update((last, n))
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), value: rows[value].to_numpy(), "run": out})

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, `{value}` {kinds[value]}, run long"
    return events.groupBy(key).applyInPandasWithState(run, schema, f"last {kinds[value]}, n long", "append", "NoTimeout")
