"""Change points of a growing series: CUSUM state per key over an append-only stream."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def change_points(stream: DataFrame, key: str, order: str, value: str, mean: float, allowance: float, threshold: float) -> DataFrame:
    """(key, index, type, value) of hits as rows arrive; rows of a batch are in order of ``order``.

    Mean, allowance and threshold are given, since a stream has no last row to take them from. A
    key's state is three numbers. The first value of a key never hits, and a missing one resets
    both sums, as in the batch operator.
    """
    def run(at, frames, state: GroupState):
        i, up, down = state.get if state.exists else (0, 0.0, 0.0)
        hits = []
        rows = pd.concat(list(frames)).sort_values(order)
        for y in rows[value]:
            x = float(y) - mean if y is not None else math.nan
            up, down = (max(0.0, s) if s == s else 0.0 for s in (up + x - allowance, down - x - allowance))
            if i == 0:
                up = down = 0.0
            if up > threshold:
                hits.append((at[0], i, "up", float(y)))
                up = 0.0
            if down > threshold:
                hits.append((at[0], i, "down", float(y)))
                down = 0.0
            i += 1
        state.update((i, up, down))
        yield pd.DataFrame(hits, columns=["key", "index", "type", "value"])

    kind = dict(stream.dtypes)[key]
    out = f"key {kind}, index long, type string, value double"
    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(run, out, "i long, up double, down double", "append", GroupStateTimeout.NoTimeout).withColumnRenamed("key", key)
