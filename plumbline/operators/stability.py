"""Stability of prototypes over runs: pairwise distances, class summaries, global compactness.

Prototypes are few per run and class, so pairs within a class are a bounded join.
Rows have run_id, class, medoid_rank and v, a unit vector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vec

EPS = 1e-12


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two arrays of counts, the shorter padded with 0; null where
    one has no counts."""
    n = F.greatest(F.size(p), F.size(q))
    wide = lambda x: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(x, i).cast("double"), F.lit(0.0)))
    share = lambda x: F.transform(x, lambda c: c / (vec.total(x) + EPS))
    a, b = share(wide(p)), share(wide(q))
    mid = F.zip_with(a, b, lambda x, y: (x + y) / 2)
    kl = lambda x: vec.total(F.zip_with(x, mid, lambda u, m: F.when(u > 0, u * (F.log(u + EPS) - F.log(m + EPS))).otherwise(0.0)))
    some = lambda x: vec.total(F.transform(x, lambda c: c.cast("double"))) > 0
    return F.when(some(p) & some(q), (kl(a) + kl(b)) / 2)


def pairs(protos: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(class, run_i, run_j, k_i, k_j, centroid_dist, mean_hausdorff, js_divergence) of each two
    runs with a class; ``counts`` (run_id, class, counts) may be missing."""
    sets = protos.groupBy("run_id", "class").agg(F.count("*").alias("k"), vec.mean_vector("v").alias("mean"), F.array_sort(F.collect_list(F.struct("medoid_rank", "v"))).alias("m"))
    sets = sets.select("run_id", "class", "k", vec.unit(F.col("mean")).alias("c"), F.transform("m", lambda s: s["v"]).alias("m"))
    if counts is not None:
        sets = sets.join(counts, ["run_id", "class"], "left")
    else:
        sets = sets.withColumn("counts", F.lit(None).cast("array<long>"))
    side = lambda s: sets.select("class", *[F.col(c).alias(f"{c}_{s}") for c in ("run_id", "k", "c", "m", "counts")])
    both = side("i").join(side("j"), "class").where("run_id_i < run_id_j")
    gap = lambda a, b: F.aggregate(F.transform(a, lambda x: F.array_min(F.transform(b, lambda y: vec.cosine_distance(x, y, True)))), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return both.select(
        "class", F.col("run_id_i").alias("run_i"), F.col("run_id_j").alias("run_j"), "k_i", "k_j",
        vec.cosine_distance(F.col("c_i"), F.col("c_j"), True).alias("centroid_dist"),
        ((gap(F.col("m_i"), F.col("m_j")) + gap(F.col("m_j"), F.col("m_i"))) / 2).alias("mean_hausdorff"),
        divergence(F.col("counts_i"), F.col("counts_j")).alias("js_divergence"),
    )


def runs_of(found: DataFrame) -> DataFrame:
    """(class, run_id) of all runs that take part in a class's pairs."""
    return found.select("class", F.col("run_i").alias("run_id")).union(found.select("class", "run_j")).distinct()


def class_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("class").agg(
        F.count("*").alias("n_pairs"), F.avg("centroid_dist").alias("mean_centroid_dist"), F.median("centroid_dist").alias("median_centroid_dist"),
        F.avg("mean_hausdorff").alias("mean_hausdorff"), F.median("mean_hausdorff").alias("median_hausdorff"), F.avg("js_divergence").alias("mean_js"),
    )


def silhouette(protos: DataFrame) -> DataFrame:
    """(class, silhouette): Euclidean silhouette of a class's prototypes by run; null where they
    are of one run, or each of its own. A prototype alone in its run counts 0."""
    a = protos.select("class", F.col("run_id").alias("r"), F.col("medoid_rank").alias("i"), F.col("v").alias("x"))
    b = protos.select("class", F.col("run_id").alias("s"), F.col("medoid_rank").alias("j"), F.col("v").alias("y"))
    d = a.join(b, "class").where("r <> s or i <> j").groupBy("class", "r", "i", "s").agg(F.avg(F.sqrt(vec.squared_l2(F.col("x"), F.col("y")))).alias("d"))
    own, other = F.max(F.when(F.col("r") == F.col("s"), F.col("d"))), F.min(F.when(F.col("r") != F.col("s"), F.col("d")))
    s = d.groupBy("class", "r", "i").agg(own.alias("a"), other.alias("b"))
    value = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    runs = protos.groupBy("class").agg(F.countDistinct("run_id").alias("n_runs"), F.count("*").alias("n"))
    mean = s.groupBy("class").agg(F.avg(value).alias("silhouette"))
    return mean.join(runs, "class").select("class", F.when((F.col("n_runs") >= 2) & (F.col("n_runs") < F.col("n")), F.col("silhouette")).alias("silhouette"))


def global_summary(protos: DataFrame, min_per_class: int = 3, min_runs: int = 2) -> DataFrame:
    """Per class: n_runs, n_prototypes, mean_to_centroid, variance, silhouette_by_run; metrics are
    null for a class of fewer than ``min_per_class`` prototypes."""
    base = protos.groupBy("class").agg(F.countDistinct("run_id").alias("n_runs"), F.count("*").alias("n_prototypes"), vec.mean_vector("v").alias("mean"))
    centre = base.select("class", vec.unit(F.col("mean")).alias("c"))
    to = protos.join(centre, "class").groupBy("class").agg(F.avg(vec.cosine_distance(F.col("v"), F.col("c"), True)).alias("mean_to_centroid"))
    spread = protos.select("class", F.posexplode("v").alias("d", "x")).groupBy("class", "d").agg(F.var_pop("x").alias("var")).groupBy("class").agg(F.avg("var").alias("variance"))
    out = base.drop("mean").join(to, "class").join(spread, "class").join(silhouette(protos), "class", "left")
    enough = F.col("n_prototypes") >= min_per_class
    return out.select(
        "class", "n_runs", "n_prototypes", F.when(enough, F.col("mean_to_centroid")).alias("mean_to_centroid"), F.when(enough, F.col("variance")).alias("variance"),
        F.when(enough & (F.col("n_runs") >= min_runs), F.col("silhouette")).alias("silhouette_by_run"),
    )


def ordered(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.col("silhouette_by_run").asc_nulls_last(), F.col("mean_to_centroid").asc_nulls_last(), "class")
