"""The ten analyses as plans over a Bank. Each returns named DataFrames. What several of them are
built on (sampled and projected rows, neighbour edges, window series) is written once to the shared
folder, and so is what a basis is fitted on; the rest isn't computed yet."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.bank import Bank, align, unique, with_metadata
from plumbline.functions import text, vec
from plumbline.operators import drift as drift_ops
from plumbline.operators import graph, knn, medoids, pca, sampling, stability, windows
from plumbline.operators.tsne import tsne as tsne_map
from plumbline.scratch import written
from plumbline.sources import images


def projected(rows: DataFrame, sample: DataFrame, pca_dim: int) -> DataFrame:
    """``rows`` in the basis of ``sample``; centred only where that has no fewer dimensions."""
    return pca.project(rows, pca.fit(sample, pca_dim))


def by_run(rows: DataFrame, sample: DataFrame, pca_dim: int, normalise: bool = True) -> DataFrame:
    """``rows`` in each run's own basis, fitted on ``sample``, then as unit vectors. With no fewer
    dimensions than ``pca_dim`` a basis is the run's mean: a join."""
    dims = sample.select(F.size("features").alias("d")).limit(1).collect()
    if not dims or dims[0]["d"] <= pca_dim:
        means = sample.groupBy("run_id").agg(vec.mean_vector("features").alias("_mean"))
        out = rows.join(means, "run_id").withColumn("features", vec.minus(F.col("features"), F.col("_mean"))).drop("_mean")
    else:
        out = pca.project_by(rows, pca.fit_by(sample, "run_id", pca_dim), "run_id")
    return out.withColumn("features", vec.unit(F.col("features"))) if normalise else out


def geometry(bank: Bank, sample_per_run: int = 2000, seed: int = 42) -> DataFrame:
    """Row counts, norms and intrinsic dimension of each run."""
    sizes = bank.features.groupBy("run_id").agg(F.count("*").alias("num_rows"), F.max(F.size("features")).alias("feat_dim"))
    sample = sampling.uniform(bank.features, sample_per_run, seed)
    norms = sample.groupBy("run_id").agg(F.count("*").alias("sampled"), F.round(F.avg(vec.norm(F.col("features"))), 6).alias("mean_norm"), F.round(F.stddev_pop(vec.norm(F.col("features"))), 6).alias("std_norm"))
    return sizes.join(norms, "run_id").join(intrinsic(sample), "run_id")


def intrinsic(sample: DataFrame) -> DataFrame:
    """(run_id, pca_dim_90, pca_dim_95) of a bounded sample of each run."""
    def run(at, g):
        import numpy as np
        import pandas as pd

        a, b = pca.intrinsic_dimension(np.stack(g.sort_values("feat_idx")["features"].to_list()))
        return pd.DataFrame({"run_id": [at[0]], "pca_dim_90": [a], "pca_dim_95": [b]})

    return sample.select("run_id", "feat_idx", "features").groupBy("run_id").applyInPandas(run, "run_id string, pca_dim_90 long, pca_dim_95 long")


def dense(rows: DataFrame) -> DataFrame:
    """``rows`` with node_idx, their number in order of run and capture, from 0: a run's rows are
    numbered within the run and offset by the sizes of the runs before."""
    sizes = rows.groupBy("run_id").agg(F.count("*").alias("_n"))
    before = sizes.select("run_id", (F.sum("_n").over(Window.orderBy("run_id")) - F.col("_n")).alias("_before"))  # a row per run
    here = F.row_number().over(Window.partitionBy("run_id").orderBy("feat_idx")) - 1
    return rows.join(F.broadcast(before), "run_id").withColumn("node_idx", (F.col("_before") + here).cast("long")).drop("_before")


def purity(bank: Bank, sample_per_run: int = 2000, pca_dim: int = 50, ks: tuple[int, ...] = (5, 10), seed: int = 42) -> dict[str, DataFrame]:
    """Neighbour purity (the row itself counts), density and class distance of sampled rows of all
    runs together; their means by run; correlations of confidence with geometry."""
    rows = written(align(sampling.uniform(bank.features, sample_per_run, seed), bank.predictions), "sample")
    dims = rows.select(F.size("features").alias("d")).limit(1).collect()
    if dims and dims[0]["d"] > pca_dim:
        rows = projected(rows, rows, pca_dim)
    rows = written(dense(rows), "points")
    side = rows.select(F.col("node_idx").alias("id"), F.col("features").alias("v"))
    near = knn.knn(side, side, max(ks))
    labels = rows.select("node_idx", "pred1_label")
    same = near.join(labels.toDF("src", "own"), "src").join(labels.toDF("dst", "other"), "dst")
    match = (F.col("own") == F.col("other")).cast("double")
    density = F.coalesce(-F.avg(F.when(F.col("rank") > 1, F.col("dist"))), F.lit(0.0)).alias("local_density")
    shares = same.groupBy(F.col("src").alias("node_idx")).agg(*[F.avg(F.when(F.col("rank") <= k, match)).alias(f"purity_{k}") for k in ks], density)
    centres = rows.groupBy("pred1_label").agg(vec.mean_vector("features").alias("centre"))
    points = rows.join(centres, "pred1_label").join(shares, "node_idx")
    points = points.select("run_id", "image_name", "pred1_label", "pred1_conf", "local_density", F.sqrt(vec.squared_l2(F.col("features"), F.col("centre"))).alias("centroid_dist"), *[f"purity_{k}" for k in ks])
    points = written(points, "purity")
    columns = [*[f"purity_{k}" for k in ks], "local_density", "centroid_dist"]
    per_run = points.groupBy("run_id").agg(*[f(c).alias(f"{c}_{s}") for c in columns for s, f in (("mean", F.avg), ("std", F.stddev_samp))])
    found = correlations(points)
    r = found.first()  # one row, the same for all runs
    of_all = {f"corr_conf_{what}_{c}": value for what, x in (("local_density", r["density_r"]), ("centroid_dist", r["centroid_r"])) for c, value in (("r", x), ("p", pearson_p(x, r["n"])))}
    return {"points": points, "per_run": per_run.withColumns({c: F.lit(v).cast("double") for c, v in of_all.items()}), "correlations": found}


def correlation(x: str, y: Column | str) -> Column:
    """Pearson's r as an aggregate; null where a side is constant."""
    y = F.col(y) if isinstance(y, str) else y
    return F.try_divide(F.covar_pop(F.col(x), y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def correlations(points: DataFrame) -> DataFrame:
    """n and Pearson's r of confidence with density and with minus the centroid distance."""
    return points.agg(F.count("*").alias("n"), correlation("pred1_conf", "local_density").alias("density_r"), correlation("pred1_conf", -F.col("centroid_dist")).alias("centroid_r"))


def pearson_p(r: float | None, n: int) -> float | None:
    """Two-sided p-value of Pearson's r under Student's t with n - 2 degrees of freedom, by the
    continued fraction of the incomplete beta function."""
    if r is None or n < 2:
        return None
    if n == 2:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    a, b, x = (n - 2) / 2, 0.5, 1 - r * r
    if x > (a + 1) / (a + b + 2):
        return 1 - tail(b, a, 1 - x)
    return tail(a, b, x)


def tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b) by Lentz's method."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    value = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return min(1.0, front * value)


def class_graph(bank: Bank, k: int = 10, pca_dim: int = 50, max_points_per_run: int = 8000, include_self: bool = False, mutual_only: bool = False) -> dict[str, DataFrame]:
    """Neighbour-label metrics of evenly sampled rows within each run."""
    picked = written(sampling.evens(bank.features, {"to_fit": min(4000, max_points_per_run), "to_map": max_points_per_run}), "sample")
    rows = by_run(align(picked.where("to_map"), bank.predictions), picked.where("to_fit"), pca_dim)
    nodes = rows.select("run_id", F.col("feat_idx").alias("id"), "image_name", F.col("pred1_label").alias("label"), "pred1_conf", F.col("features").alias("v"))
    return graphs(nodes, k, "run_id", include_self, mutual_only)


def class_graph_global(bank: Bank, k: int = 10, pca_dim: int = 50, max_points_total: int = 20000, per_run_cap: int = 4000, include_self: bool = False, mutual_only: bool = False) -> dict[str, DataFrame]:
    """The same across all runs, each giving an equal number of rows."""
    runs = bank.features.select("run_id").distinct().count()
    rows = written(align(sampling.even(bank.features, sampling.budget(max_points_total, per_run_cap, runs)), bank.predictions), "sample")
    rows = dense(projected(rows, rows, pca_dim)).withColumn("features", vec.unit(F.col("features")))
    nodes = rows.select("run_id", F.col("node_idx").alias("id"), "image_name", F.col("pred1_label").alias("label"), "pred1_conf", F.col("features").alias("v"))
    return graphs(nodes, k, None, include_self, mutual_only)


def graphs(nodes: DataFrame, k: int, key: str | None, include_self: bool, mutual_only: bool) -> dict[str, DataFrame]:
    """Edges, node metrics, confusion and class summary of nodes (run_id, id, label, v, ...)."""
    nodes = written(nodes, "nodes")
    sides = nodes.select(*([key] if key else []), "id", "v")
    links = written(knn.edges(sides, k, key, include_self, mutual_only), "edges")
    named = nodes.drop("v")
    metrics = graph.node_metrics(named, links, key)
    return {"edges": links, "nodes": metrics.withColumn("mutual_only", F.lit(mutual_only)), "confusion": graph.confusion(named, links, key), "summary": graph.class_summary(metrics, key)}


def novelty(bank: Bank, top_n: int = 200, pca_dim: int = 50, reservoir_cap: int = 20000, knn_k: int = 10, w_centroid: float = 0.4, w_density: float = 0.4, w_margin: float = 0.2, bootstrap: int = 4000) -> DataFrame:
    """The ``top_n`` rows of each run by weighted outlier score: distance to the own class's
    centroid, mean distance to neighbours among the run's first rows, and ambiguity."""
    rows = written(by_run(align(bank.features, bank.predictions), written(sampling.even(bank.features, bootstrap), "sample"), pca_dim), "rows")
    centres = rows.groupBy("run_id", "pred1_label").agg(vec.mean_vector("features").alias("mean")).select("run_id", "pred1_label", vec.unit(F.col("mean")).alias("centre"))
    scored = rows.join(centres, ["run_id", "pred1_label"]).withColumn("centroid_dist", vec.cosine_distance(F.col("features"), F.col("centre"), True))
    if w_density:
        side = rows.select("run_id", F.col("feat_idx").alias("id"), F.col("features").alias("v"))
        near = knn.knn(side, side.where(F.col("id") < reservoir_cap), knn_k, "run_id")  # the reservoir is a parameter
        means = near.groupBy("run_id", F.col("src").alias("feat_idx")).agg(F.avg("dist").alias("knn_mean"))
        scored = scored.join(means, ["run_id", "feat_idx"], "left").withColumn("knn_mean", F.coalesce("knn_mean", F.lit(0.0)))
    else:
        scored = scored.withColumn("knn_mean", F.lit(0.0))
    scored = scored.withColumn("margin_penalty", 1 - vec.clip(F.col("pred1_conf") - F.col("pred2_conf"), 0.0, 1.0))
    scored = scored.withColumn("score", w_centroid * F.col("centroid_dist") + w_density * F.col("knn_mean") + w_margin * F.col("margin_penalty"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.round("score", 9).desc(), "feat_idx"))
    kept = scored.withColumn("_rank", rank).where(F.col("_rank") <= top_n)
    return kept.select("run_id", "feat_idx", "image_name", "pred1_label", "pred1_conf", "pred2_label", "pred2_conf", "centroid_dist", "knn_mean", "margin_penalty", "score")


def drift(bank: Bank, mode: str = "count", window_size: int = 1000, hop: int = 500, depth_bin_size: float = 5.0, sample_per_window: int = 400, pca_dim: int = 50, bootstrap_per_run: int = 2000, k_std: float = 0.5, h_std: float = 5.0, min_gap: int = 3) -> dict[str, DataFrame]:
    """Squared MMD between successive windows of each run, and change points of that series."""
    if mode not in ("count", "depth", "profile"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = bank.features.select("run_id", "feat_idx", "image_name")
    if mode == "count":
        found = windows.by_count(rows, window_size, hop)
    else:
        rows = with_metadata(rows, bank.metadata)
        found = windows.by_depth(rows, depth_bin_size) if mode == "depth" else windows.by_profile(rows)
    found = written(found, "windows")
    features = projected(bank.features, written(sampling.even(bank.features, bootstrap_per_run), "sample"), pca_dim)
    values = written(drift_ops.series(windows.sampled(found, sample_per_window), features), "series")
    points = drift_ops.change_points(values, "run_id", "step", "mmd2", k_std, h_std, min_gap).withColumn("mode", F.lit(mode))
    return {"windows": found, "series": values, "change_points": points}


def prototypes(bank: Bank, mode: str = "per_class", k: int = 10, pca_dim: int = 50, max_per_class: int = 4000, metric: str = "cosine", min_points_for_group: int = 50, max_iter: int = 20, seed: int = 42) -> dict[str, DataFrame]:
    """Medoids of each run's classes (or of each run) and how they cover them."""
    vec.metric(metric)
    if mode not in ("per_class", "per_run"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = align(bank.features, bank.predictions).withColumn("group", F.col("pred1_label") if mode == "per_class" else F.lit("all"))
    rows = written(sampling.head(rows, max_per_class, "run_id", "group").select("run_id", "feat_idx", "image_name", "group", "features"), "members")
    rows = by_run(rows, rows, pca_dim, normalise=False)
    found = written(medoids.k_medoids(rows.withColumnRenamed("features", "v"), k, metric, max_iter, seed, min_points_for_group), "assigned")
    return {"assigned": found, "prototypes": found.where("is_medoid").select("run_id", "group", "medoid_rank", F.col("feat_idx").alias("medoid_global_idx"), F.col("image_name").alias("medoid_name")), "coverage": medoids.coverage(found, k).withColumns({"k": F.lit(k), "metric": F.lit(metric), "pca_dim": F.lit(pca_dim), "mode": F.lit(mode)})}


def prototype_vectors(bank: Bank, protos: DataFrame, pca_dim: int = 50) -> DataFrame:
    """(run_id, class, medoid_rank, v): unit vectors of prototypes in the basis of all of them."""
    rows = written(protos.join(bank.features.select("run_id", F.col("feat_idx").alias("medoid_global_idx"), "features"), ["run_id", "medoid_global_idx"]), "medoids")
    rows = projected(rows.select("run_id", F.col("group").alias("class"), "medoid_rank", "features"), rows, pca_dim)
    return written(rows.select("run_id", "class", "medoid_rank", vec.unit(F.col("features")).alias("v")), "vectors")


def prototype_stability(bank: Bank, protos: DataFrame, coverage: DataFrame | None = None, pca_dim: int = 50) -> dict[str, DataFrame]:
    """Distances of a class's prototypes between runs, and their class summary."""
    counts = coverage.select("run_id", F.col("group").alias("class"), F.col("medoid_counts").alias("counts")) if coverage is not None else None
    found = stability.pairs(prototype_vectors(bank, protos, pca_dim), counts)
    return {"pairs": found, "class_summary": stability.class_summary(found), "runs": stability.runs_of(found)}


def prototype_global_stability(bank: Bank, protos: DataFrame, pca_dim: int = 50, min_per_class: int = 3, min_runs_for_sil: int = 2) -> DataFrame:
    """Compactness of each class's prototypes over all runs."""
    return stability.ordered(stability.global_summary(prototype_vectors(bank, protos, pca_dim), min_per_class, min_runs_for_sil))


def tsne(bank: Bank, sample_per_run: int = 2000, pca_dim: int = 50, perplexity: float = 30.0, learning_rate: float = 200.0, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """A two-dimensional map of sampled rows; a missing label stays null."""
    known = unique(bank.predictions.select("run_id", "image_name", "pred1_label"), "run_id", "image_name")
    rows = written(sampling.uniform(bank.features, sample_per_run, seed).join(known, ["run_id", "image_name"], "left"), "sample")
    dims = rows.select(F.size("features").alias("d")).limit(1).collect()
    if dims and dims[0]["d"] > pca_dim:
        rows = projected(rows, rows, pca_dim)
    return tsne_map(rows, perplexity, learning_rate, rounds, seed)


def contact_sheet(items: DataFrame, key: list[str], order: list, per_row: int = 8, width: int = 256, height: int = 256, caption: int = 24, title: int = 40, margin: int = 12) -> DataFrame:
    """Where each item's thumbnail goes: row and column, offsets in pixels and the sheet's size. The
    defaults are fixed values: the spacing of the analysed toolkit's sheets."""
    w = Window.partitionBy(*key)
    place = items.withColumn("position", F.row_number().over(w.orderBy(*order)).cast("long") - 1).withColumn("n", F.count("*").over(w))
    row, column, tall = F.floor(F.col("position") / per_row), F.col("position") % per_row, height + caption + margin
    return place.withColumns({
        "row": row, "column": column, "x": margin + column * (width + margin), "y": title + margin + row * tall,
        "sheet_width": F.lit(margin + per_row * (width + margin)).cast("long"), "sheet_height": title + margin + F.ceil(F.col("n") / per_row) * tall,
    })


def prototype_sheets(protos: DataFrame, index: DataFrame, **sizes: int) -> DataFrame:
    """The contact sheet of each run and group of prototypes: place, caption and file of each."""
    out = contact_sheet(protos, ["run_id", "group"], ["medoid_rank"], **sizes)
    words = F.concat(F.lit("#"), F.col("medoid_rank").cast("string"), F.lit("  "), text.basename(F.col("medoid_name")))
    out = out.withColumn("caption", text.shortened(words, 28, 25)).withColumnRenamed("medoid_name", "image_name")
    return images.resolved_by_run(out, index).select("run_id", "group", "image_name", "path", "caption", "row", "column", "x", "y", "sheet_width", "sheet_height")


def novelty_sheets(inbox: DataFrame, top_n: int = 200, **sizes: int) -> DataFrame:
    """The contact sheet of each run's inbox: the ``top_n`` of the highest score."""
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.round("score", 9).desc(), "feat_idx"))
    top = inbox.withColumn("_rank", rank).where(F.col("_rank") <= top_n).drop("_rank")
    out = contact_sheet(top, ["run_id"], [F.round("score", 9).desc(), "feat_idx"], caption=28, **sizes)
    words = F.format_string("#%d s=%.2f %s (%.2f-%.2f)", F.col("position") + 1, "score", "pred1_label", "pred1_conf", "pred2_conf")
    path = ["abs_path"] if "abs_path" in inbox.columns else []
    return out.select("run_id", "image_name", *path, text.shortened(words, 40, 37).alias("caption"), "row", "column", "x", "y", "sheet_width", "sheet_height")
