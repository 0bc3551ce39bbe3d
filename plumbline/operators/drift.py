"""Distribution drift between windows, and change points of a series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.windows import consecutive


def mmd2(x: np.ndarray, y: np.ndarray) -> float:
    """Unbiased squared MMD under an RBF kernel whose width is the median heuristic; at least 0."""
    z = np.concatenate((x, y))
    square = (z * z).sum(1)
    d2 = np.maximum(square[:, None] + square[None, :] - 2 * z @ z.T, 0)
    upper = d2[np.triu_indices(len(z), 1)]
    gamma = 1.0 / (2 * max(float(np.median(upper)) if len(upper) else 0.0, 1e-8))
    k, n, m = np.exp(-gamma * d2), len(x), len(y)
    xx = (k[:n, :n].sum() - np.trace(k[:n, :n])) / (n * (n - 1) + 1e-8)
    yy = (k[n:, n:].sum() - np.trace(k[n:, n:])) / (m * (m - 1) + 1e-8)
    return max(0.0, float(xx + yy - 2 * k[:n, n:].mean()))


def series(windows: DataFrame, features: DataFrame) -> DataFrame:
    """(run_id, step, window_from, window_to, mmd2) between each window and the next one.

    ``windows`` is sampled before, so that a pair of windows is a bounded group."""
    rows = windows.select("run_id", "step", "feat_idx").join(features.select("run_id", "feat_idx", F.col("features").alias("v")), ["run_id", "feat_idx"])
    pairs = rows.select("run_id", "step", F.lit(0).alias("side"), "feat_idx", "v").union(rows.select("run_id", F.col("step") - 1, F.lit(1), "feat_idx", "v"))

    def run(at, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("feat_idx")
        x, y = (np.stack(g["v"][g["side"] == s].to_list()) if (g["side"] == s).any() else np.zeros((0, 0)) for s in (0, 1))
        value = mmd2(x, y) if len(x) and len(y) else None
        return pd.DataFrame({"run_id": [at[0]], "step": [at[1]], "mmd2": [value]})

    values = pairs.where("step >= 0").groupBy("run_id", "step").applyInPandas(run, "run_id string, step long, mmd2 double")
    return consecutive(windows).join(values, ["run_id", "step"])


def positive(x: Column) -> Column:
    """x above 0, else 0; a missing number counts as 0."""
    return F.when((x > 0) & ~F.isnan(x), x).otherwise(F.lit(0.0))


def cusum(values: Column, allowance: Column, threshold: Column) -> Column:
    """Hits (index, type) of a two-sided CUSUM over an array, from index 1 on; a sum above the
    threshold is a hit and returns to 0. A pure fold: one series is one row."""
    hit = "array<struct<index:int,type:string>>"
    state = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.array().cast(hit).alias("hits"))

    def step(s: Column, x: Column) -> Column:
        up, down = positive(s["up"] + x - allowance), positive(s["down"] - x - allowance)
        first = s["i"] == 0
        rise, fall = ~first & (up > threshold), ~first & (down > threshold)
        one = lambda kind: F.array(F.struct(s["i"].alias("index"), F.lit(kind).alias("type"))).cast(hit)
        hits = F.when(rise, F.concat(s["hits"], one("up"))).otherwise(s["hits"])
        hits = F.when(fall, F.concat(hits, one("down"))).otherwise(hits)
        return F.struct((s["i"] + 1).alias("i"), F.when(rise | first, 0.0).otherwise(up).alias("up"), F.when(fall | first, 0.0).otherwise(down).alias("down"), hits.alias("hits"))

    return F.aggregate(values, state, step, lambda s: s["hits"])


def spaced(hits: Column, gap: int) -> Column:
    """Hits of each type at least ``gap`` after the one kept before, the earliest first."""
    start = F.array().cast("array<struct<index:int,type:string>>")

    def keep(out: Column, x: Column) -> Column:
        far = (F.size(out) == 0) | (x["index"] - F.get(out, F.size(out) - 1)["index"] >= gap)
        return F.when(far, F.concat(out, F.array(x))).otherwise(out)

    of = lambda kind: F.filter(hits, lambda x: x["type"] == kind)
    return F.concat(F.aggregate(of("up"), start, keep), F.aggregate(of("down"), start, keep))


def change_points(values: DataFrame, key: str, order: str, value: str, k_std: float = 0.5, h_std: float = 5.0, gap: int = 3, least: int = 5) -> DataFrame:
    """(key, index, type, value) of each series' change points, after centring by its mean, with
    allowance and threshold in standard deviations (population; 1 where that is 0). ``value`` is
    the series' own; a gap of 0 keeps every hit."""
    listed = values.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce(value, F.lit(float("nan"))).alias("x")))), lambda s: s["x"]).alias("xs"), F.avg(F.nanvl(F.col(value), F.lit(None).cast("double"))).alias("mean"), F.stddev_pop(F.nanvl(F.col(value), F.lit(None).cast("double"))).alias("std"))
    listed = listed.where(F.size("xs") >= least).withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0))
    centred = F.transform("xs", lambda x: x - F.col("mean"))
    hits = cusum(centred, F.col("std") * k_std, F.col("std") * h_std)
    rows = listed.withColumn("h", F.explode(spaced(hits, gap) if gap > 0 else hits))
    return rows.select(key, "h.index", "h.type", F.get("xs", F.col("h.index")).alias("value"))
