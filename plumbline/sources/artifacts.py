"""Sinks and readers of what the analyses return: CSV, JSON and Parquet."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INBOX = "run_id string, feat_idx long, image_name string, abs_path string, pred1_label string, pred1_conf double, pred2_conf double, score double"
PROTOTYPES = "run_id string, group string, medoid_rank long, medoid_global_idx long, medoid_name string"
COVERAGE = "run_id string, group string, count long, entropy double, entropy_norm double, gini double, mean_within double, median_within double, medoid_counts string, k int, metric string, pca_dim int, mode string"


def flat(df: DataFrame) -> DataFrame:
    """Arrays as comma-separated text, which CSV can hold."""
    return df.select(*[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, small: bool = False) -> None:
    """A result as CSV with a header: a folder of parts, of one part where the result is ``small``."""
    rows = flat(df)
    (rows.coalesce(1) if small else rows).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, small: bool = False) -> None:
    (df.coalesce(1) if small else df).write.mode("overwrite").json(path)


def published(command: str, part: str, df: DataFrame, k: int = 0) -> DataFrame:
    """A result under the column names of its artifact."""
    if command == "purity":
        return df.withColumnsRenamed({c: re.sub(r"^purity_(\d+)", r"purity@\1", c) for c in df.columns})
    if command == "tsne":
        return df.withColumnsRenamed({"x": "tsne_x", "y": "tsne_y"})
    if command.startswith("class_graph") and part == "nodes":
        return df.withColumnRenamed("id", "node_idx")
    if command.startswith("class_graph") and part == "confusion":
        return pivoted(df, [c for c in df.columns if c == "run_id"])
    if command == "prototypes" and part == "coverage":
        return df.select("*", *[F.get("medoid_counts", F.lit(i)).alias(f"medoid_{i}_count") for i in range(k)]).drop("medoid_counts")
    return df


def pivoted(confusion: DataFrame, key: list[str]) -> DataFrame:
    """A confusion in wide form: a row per label, a column per neighbour label."""
    return confusion.groupBy(*key, "label").pivot("near").agg(F.first("share"))


def existing(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_prototypes(spark: SparkSession, *paths: str) -> DataFrame:
    """Prototypes of any number of JSON files or folders; a missing one has none."""
    there = [p for p in paths if existing(spark, p)]
    return spark.read.schema(PROTOTYPES).json(there) if there else spark.createDataFrame([], PROTOTYPES)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns ``schema`` of a CSV folder by name; a missing column is null, a missing folder
    has no rows."""
    kinds = dict(c.split() for c in schema.split(", "))
    if not existing(spark, path):
        return spark.createDataFrame([], schema)
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[(F.col(f"`{c}`") if c in raw.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """Coverage rows of a CSV folder; a missing one has none. A medoid's count is a column."""
    if not existing(spark, path):
        return spark.createDataFrame([], COVERAGE).withColumn("medoid_counts", F.array().cast("array<bigint>"))
    names = spark.read.option("header", True).csv(path).columns
    counts = sorted((c for c in names if re.fullmatch(r"medoid_\d+_count", c)), key=lambda c: int(c.split("_")[1]))
    rows = read_csv(spark, path, COVERAGE + "".join(f", {c} long" for c in counts))
    listed = F.array(*[F.col(c) for c in counts]) if counts else F.transform(F.split("medoid_counts", ","), lambda x: x.cast("long"))
    return rows.withColumn("medoid_counts", listed).drop(*counts)
