"""k-medoids of bounded groups, one step of it as joins, and coverage of medoids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import vec

EPS = 1e-12


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        x, y = (v / (np.linalg.norm(v, axis=1, keepdims=True) + EPS) for v in (x, y))
        return 1 - np.clip(x @ y.T, -1, 1)
    if metric == "euclidean":
        return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)
    raise ValueError(f"unknown metric {metric!r}")


def spread(d: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k different points, the first at random, each further one with a chance in proportion to its
    distance from the nearest before; where all others are at none, the first that is left."""
    chosen = [int(rng.integers(len(d)))]
    near = d[chosen[0]].copy()
    while len(chosen) < k:
        near[chosen] = 0
        sums = np.cumsum(near)
        free = np.setdiff1d(np.arange(len(d)), chosen)[0]
        chosen.append(int(np.searchsorted(sums, rng.uniform(0, sums[-1]), "right")) if sums[-1] > 0 else int(free))
        near = np.minimum(near, d[chosen[-1]])
    return np.sort(chosen)


def cluster(x: np.ndarray, k: int, metric: str = "cosine", rounds: int = 20, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Medoids' positions, each point's medoid and its distance: of a local optimum of the sum of
    distances, or of what ``rounds`` reach. Distances are worked out once; a group is capped."""
    d = np.maximum(distances(x, x, metric), 0)
    np.fill_diagonal(d, 0)
    now = spread(d, min(k, len(x)), np.random.default_rng(seed))
    for _ in range(rounds):
        own = d[:, now].argmin(1)
        own[now] = np.arange(len(now))  # a medoid stays with itself where another is at no distance
        members = [np.flatnonzero(own == c) for c in range(len(now))]
        new = np.sort([m[d[np.ix_(m, m)].sum(1).argmin()] for m in members])
        if np.array_equal(new, now):
            break
        now = new
    own = d[:, now].argmin(1)
    own[now] = np.arange(len(now))
    return now, own, d[np.arange(len(x)), now[own]]


def k_medoids(rows: DataFrame, k: int, metric: str = "cosine", rounds: int = 20, seed: int = 42, least: int = 50) -> DataFrame:
    """(run_id, group, feat_idx, image_name, medoid_rank, dist, is_medoid) of each row of
    (run_id, group, feat_idx, image_name, v); groups of fewer than max(least, k) rows are left out.
    A group is capped before (``sampling.head``), so that it is one task's bounded work."""
    def run(at, g: pd.DataFrame) -> pd.DataFrame:
        if len(g) < max(least, k):
            return pd.DataFrame(columns=["run_id", "group", "feat_idx", "image_name", "medoid_rank", "dist", "is_medoid"])
        g = g.sort_values("feat_idx").reset_index(drop=True)
        chosen, own, d = cluster(np.stack(g["v"].to_list()), k, metric, rounds, seed)
        return g[["run_id", "group", "feat_idx", "image_name"]].assign(medoid_rank=own.astype("int64"), dist=d, is_medoid=np.isin(np.arange(len(g)), chosen))

    return rows.select("run_id", "group", "feat_idx", "image_name", "v").groupBy("run_id", "group").applyInPandas(run, "run_id string, group string, feat_idx long, image_name string, medoid_rank long, dist double, is_medoid boolean")


def assign(rows: DataFrame, medoids: DataFrame, metric: str = "cosine") -> DataFrame:
    """(run_id, group, feat_idx, medoid_rank, dist): the nearest medoid of the group, lowest rank
    on ties. ``medoids`` has (run_id, group, medoid_rank, m), a bounded number per group."""
    lists = medoids.groupBy("run_id", "group").agg(F.array_sort(F.collect_list(F.struct("medoid_rank", "m"))).alias("ms"))
    near = F.array_min(F.transform("ms", lambda s: F.struct(F.round(vec.metric(metric)(F.col("v"), s["m"]), 12).alias("dist"), s["medoid_rank"].alias("medoid_rank"))))
    return rows.join(lists, ["run_id", "group"]).withColumn("near", near).select("run_id", "group", "feat_idx", "near.medoid_rank", "near.dist")


def update(rows: DataFrame, assigned: DataFrame, metric: str = "cosine") -> DataFrame:
    """(run_id, group, medoid_rank, feat_idx): the member with the least sum of distances to all
    members of its cluster, the first one on ties. Groups are capped before."""
    own = rows.join(assigned.select("run_id", "group", "feat_idx", "medoid_rank"), ["run_id", "group", "feat_idx"])
    other = own.select("run_id", "group", "medoid_rank", F.col("v").alias("w"))
    sums = own.join(other, ["run_id", "group", "medoid_rank"]).groupBy("run_id", "group", "medoid_rank", "feat_idx").agg(F.round(F.sum(vec.metric(metric)(F.col("v"), F.col("w"))), 9).alias("total"))
    return sums.groupBy("run_id", "group", "medoid_rank").agg(F.min_by("feat_idx", F.struct("total", "feat_idx")).alias("feat_idx"))


def coverage(assigned: DataFrame, k: int) -> DataFrame:
    """Per (run_id, group): count, entropy, entropy_norm (0 for k = 1), gini, mean_within,
    median_within and medoid_counts of (run_id, group, medoid_rank, dist) rows."""
    sizes = assigned.groupBy("run_id", "group", "medoid_rank").agg(F.count("*").alias("c"))
    shares = sizes.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("run_id", "group")))
    shape = shares.groupBy("run_id", "group").agg(F.sum(-F.col("p") * F.log(F.col("p") + EPS)).alias("entropy"), (1 - F.sum(F.col("p") * F.col("p"))).alias("gini"), F.map_from_entries(F.collect_list(F.struct(F.col("medoid_rank").cast("long"), "c"))).alias("by"))
    within = assigned.groupBy("run_id", "group").agg(F.count("*").alias("count"), F.avg("dist").alias("mean_within"), F.median("dist").alias("median_within"))
    counts = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("by", i), F.lit(0).cast("long")))
    norm = F.lit(0.0) if k == 1 else F.col("entropy") / (F.log(F.lit(float(k))) + EPS)
    return within.join(shape, ["run_id", "group"]).select("run_id", "group", "count", "entropy", norm.alias("entropy_norm"), "gini", "mean_within", "median_within", counts.alias("medoid_counts"))
