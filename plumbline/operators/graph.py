"""Labels of neighbours: node entropy and purity, class confusion, class summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def node_metrics(nodes: DataFrame, edges: DataFrame, key: str | None = "run_id") -> DataFrame:
    """``nodes`` (key, id, label, ...) with k_effective, entropy and purity of neighbours' labels;
    all 0 for a node without neighbours."""
    group = [key] if key else []
    labels = nodes.select(*group, F.col("id").alias("dst"), F.col("label").alias("near"))
    counts = edges.join(labels, [*group, "dst"]).groupBy(*group, "src", "near").agg(F.count("*").alias("c"))
    totals = counts.withColumn("n", F.sum("c").over(Window.partitionBy(*group, "src"))).withColumn("p", F.col("c") / F.col("n"))
    shape = totals.groupBy(*group, F.col("src").alias("id")).agg(F.first("n").alias("k_effective"), F.sum(-F.col("p") * F.log(F.col("p") + EPS)).alias("entropy"), (F.max("c") / F.first("n")).alias("purity"))
    out = nodes.join(shape, [*group, "id"], "left")
    return out.withColumns({"k_effective": F.coalesce("k_effective", F.lit(0)).cast("long"), "entropy": F.coalesce("entropy", F.lit(0.0)), "purity": F.coalesce("purity", F.lit(0.0))})


def confusion(nodes: DataFrame, edges: DataFrame, key: str | None = "run_id") -> DataFrame:
    """(key, label, near, share): for each pair of labels of a key, the share of a label's edges
    that end at the other one; 0 where it has none."""
    group = [key] if key else []
    at = lambda end, name: nodes.select(*group, F.col("id").alias(end), F.col("label").alias(name))
    counts = edges.join(at("src", "label"), [*group, "src"]).join(at("dst", "near"), [*group, "dst"]).groupBy(*group, "label", "near").agg(F.count("*").alias("c"))
    names = nodes.select(*group, "label").distinct()
    # labels of a key in an array, so that pairs need no join of rows
    both = names.groupBy(*group).agg(F.collect_set("label").alias("all")).select(*group, F.explode("all").alias("label"), "all").select(*group, "label", F.explode("all").alias("near"))
    dense = both.join(counts, [*group, "label", "near"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    share = F.coalesce(F.try_divide(F.col("c"), F.sum("c").over(Window.partitionBy(*group, "label"))), F.lit(0.0))
    return dense.select(*group, "label", "near", share.alias("share"))


def class_summary(metrics: DataFrame, key: str | None = "run_id") -> DataFrame:
    group = [key] if key else []
    return metrics.groupBy(*group, "label").agg(F.count("*").alias("n_nodes"), F.avg("entropy").alias("mean_entropy"), F.avg("purity").alias("mean_purity"))
