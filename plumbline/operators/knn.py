"""Exact nearest neighbours in blocks, and graphs of them.

Rows are dealt over blocks by a hash; each pair of blocks is one task's work, a matrix product
whose candidates are measured again exactly. A task keeps the k best of its block for each query,
and a rank over these gives the k best of all. Nothing is broadcast, so no side has a size limit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
SLACK = 8


def nearest_of(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k rows nearest to each query, ties by id."""
    if queries.empty or rows.empty:
        return pd.DataFrame({"src": [], "dst": [], "dist": []})
    a, b = np.stack(queries["v_q"].to_numpy()), np.stack(rows["v_r"].to_numpy())
    take = min(len(b), k + SLACK)
    src, dst = queries["id_q"].to_numpy(), rows["id_r"].to_numpy()
    square = (b * b).sum(1)
    parts = []
    for lo in range(0, len(a), 512):
        q = a[lo : lo + 512]
        rough = square[None, :] - 2 * q @ b.T
        near = np.argpartition(rough, take - 1, 1)[:, :take] if take < len(b) else np.tile(np.arange(len(b)), (len(q), 1))
        exact = np.sqrt(((q[:, None, :] - b[near]) ** 2).sum(2))
        order = np.lexsort((dst[near], exact), axis=1)[:, :k]
        n = order.shape[1]
        parts.append(pd.DataFrame({"src": np.repeat(src[lo : lo + 512], n), "dst": np.take_along_axis(dst[near], order, 1).ravel(), "dist": np.take_along_axis(exact, order, 1).ravel()}))
    return pd.concat(parts)


def sizes_of(df: DataFrame, key: str | None) -> DataFrame:
    """(key, n): rows of each key, a local table with a row per key."""
    keys = [F.col(key).alias("key")] if key else [F.lit("").alias("key")]
    rows = df.groupBy(*keys).agg(F.count("*").alias("n")).collect()  # a row per key, as of a run
    return df.sparkSession.createDataFrame([tuple(r) for r in rows], "key string, n long")


def dealt(df: DataFrame, own: DataFrame, other: DataFrame, key: str | None, block: int, side: str) -> DataFrame:
    """(key, q, r, id, v) rows: each row once for every block of the other side. Columns are new
    ones, so that a table may be both sides. ``own`` and ``other`` have a row per key."""
    name = (F.col(key) if key else F.lit("")).alias(f"key_{side}")
    rows = df.select(name, F.col("id").alias(f"id_{side}"), F.col("v").alias(f"v_{side}"))
    blocks = own.toDF("of", "own").join(other.toDF("of_other", "other"), F.col("of").eqNullSafe(F.col("of_other")))
    blocks = blocks.select("of", F.ceil(F.col("own") / block).alias("own"), F.ceil(F.col("other") / block).alias("other"))
    held = F.pmod(F.xxhash64(f"id_{side}"), F.col("own")).cast("int")
    met = F.explode(F.sequence(F.lit(0), F.col("other").cast("int") - 1))
    out = rows.join(F.broadcast(blocks), F.col(f"key_{side}").eqNullSafe(F.col("of"))).select(f"key_{side}", held.alias("held"), met.alias("met"), f"id_{side}", f"v_{side}")
    first, second = ("held", "met") if side == "q" else ("met", "held")
    return out.select(f"key_{side}", F.col(first).alias(f"q_{side}"), F.col(second).alias(f"r_{side}"), f"id_{side}", f"v_{side}")


def knn(queries: DataFrame, rows: DataFrame, k: int, key: str | None = None, block: int = BLOCK) -> DataFrame:
    """(key, src, dst, dist, rank) of the ``k`` rows nearest to each query by Euclidean distance.

    Both sides have id (long), v (array<double>) and, if ``key`` is given, that column, within
    which neighbours are sought. Ties go to the lower id; a row is its own neighbour at 0. Where
    ``queries`` are ``rows``, they are counted once.
    """
    r = sizes_of(rows, key)
    q = r if queries is rows else sizes_of(queries, key)
    left, right = (dealt(df, own, other, key, block, side) for df, own, other, side in ((queries, q, r, "q"), (rows, r, q, "r")))
    # the bound group columns: a query's block against one of the rows
    groups = [[f"key_{s}", f"q_{s}", f"r_{s}"] for s in "qr"]

    def run(at, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = nearest_of(a, b, k)
        if key:
            out.insert(0, key, at[0])
        return out

    schema = (f"{key} string, " if key else "") + "src long, dst long, dist double"
    found = left.groupBy(*groups[0]).cogroup(right.groupBy(*groups[1])).applyInPandas(run, schema)
    rank = F.row_number().over(Window.partitionBy(*([key] if key else []), "src").orderBy("dist", "dst"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def edges(rows: DataFrame, k: int, key: str | None = None, include_self: bool = False, mutual: bool = False) -> DataFrame:
    """The kNN graph: the k neighbours of each row, of which one is itself and, unless asked for,
    left out; only those both ways where ``mutual``."""
    found = knn(rows, rows, k, key)
    if not include_self:
        found = found.where("src <> dst")
        # a row's own place may be taken by equal vectors; then the last neighbour goes
        keep = Window.partitionBy(*([key] if key else []), "src").orderBy("dist", "dst")
        found = found.withColumn("rank", F.row_number().over(keep)).where(F.col("rank") <= k - 1)
    if mutual:
        group = [key] if key else []
        back = found.select(*group, F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = found.join(back, [*group, "src", "dst"], "left_semi")
    return found
