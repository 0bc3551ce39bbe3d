"""Samples of a run's rows, by rank within the run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(df: DataFrame, k: int, seed: int = 42, key: str = "run_id", order: str = "feat_idx") -> DataFrame:
    """``k`` rows of each key (all of a smaller one), chosen by a hash of seed and order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(order).cast("string"))), order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def even_positions(n: Column, k: int) -> Column:
    """``k`` evenly spaced positions from 0 to n - 1 in doubles, truncated; all where n <= k."""
    m = F.least(n, F.lit(k)).cast("int")
    step = F.try_divide((n - 1).cast("double"), (m - 1).cast("double"))
    place = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.when(i == 0, F.lit(0)).when(i == m - 1, n - 1).otherwise(F.floor(i * step)).cast("long"))
    return F.when(n > 0, F.when(m == 1, F.array(F.lit(0).cast("long"))).otherwise(place)).otherwise(F.array().cast("array<bigint>"))


def even(df: DataFrame, k: int, key: str = "run_id", order: str = "feat_idx") -> DataFrame:
    """Evenly spaced rows of each key; ``order`` is dense from 0 within a key."""
    return evens(df, {"_in": k}, key, order).drop("_in")


def evens(df: DataFrame, wanted: dict[str, int], key: str = "run_id", order: str = "feat_idx") -> DataFrame:
    """Rows in any of several evenly spaced samples of each key, with a boolean column for each:
    name -> size. The table is read once for the keys' sizes, which are one narrow column, and once."""
    n = df.groupBy(key).agg(F.count("*").alias("_n"))
    def listed(name: str, k: int) -> Column:
        return F.transform(even_positions(F.col("_n"), k), lambda x: F.struct(x.alias(order), *[F.lit(name == other).alias(other) for other in wanted]))

    places = n.select(key, F.explode(F.concat(*[listed(name, k) for name, k in wanted.items()])).alias("_place")).select(key, "_place.*")
    return df.join(places.groupBy(key, order).agg(*[F.max(name).alias(name) for name in wanted]), [key, order])


def head(df: DataFrame, cap: int, *keys: str, order: str = "feat_idx") -> DataFrame:
    """The first ``cap`` rows in capture order for each value of ``keys``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def budget(total: int, cap: int, runs: int) -> int:
    """Rows that each of ``runs`` runs may give to a sample of ``total``."""
    return min(cap, max(1, total // max(1, runs)))
