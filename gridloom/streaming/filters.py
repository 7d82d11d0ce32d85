"""Exponential averages over an unbounded stream of prices: a constant-size state per instrument, and windowed means with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "inst long, ts timestamp, ema double, dema double, tema double"


def running_tema(prices: DataFrame, span: int = 21) -> DataFrame:
    """prices(inst long, ts timestamp, p double), streaming: the averages after each row. Rows of one batch are taken in the order of time; state is
    (e1, e2, e3) of the cascade, each seeded by its first value."""
    a = 2 / (span + 1)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        e = list(state.get) if state.exists else None
        pdf = pd.concat(list(batches)).dropna(subset=["p"]).sort_values("ts", kind="stable")
        rows = []
        for ts, p in zip(pdf["ts"], pdf["p"], strict=True):
            if e is None:
                e = [p, p, p]
            else:
                e[0] += a * (p - e[0])
                e[1] += a * (e[0] - e[1])
                e[2] += a * (e[1] - e[2])
            rows.append((key[0], ts, e[0], 2 * e[0] - e[1], 3 * e[0] - 3 * e[1] + e[2]))
        if e is not None:
            state.update(tuple(e))
        yield pd.DataFrame(rows, columns=["inst", "ts", "ema", "dema", "tema"])

    return prices.groupBy("inst").applyInPandasWithState(step, OUT, "e1 double, e2 double, e3 double", "append", GroupStateTimeout.NoTimeout)


def windowed_means(prices: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mean price of each instrument in tumbling windows; rows later than the watermark are dropped."""
    return prices.withWatermark("ts", late).groupBy(F.window("ts", window), "inst").agg(F.avg("p").alias("p"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "inst", "p", "n")
