"""The feature bank: vectors in capture order, predictions and acquisition metadata by run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text, vec

UNKNOWN = "unknown"
RUNS = 4


@dataclass(frozen=True)
class Bank:
    """features (run_id, feat_idx, image_name, features array<double>), predictions (run_id,
    image_name, pred{1,2,3}_label, pred{1,2,3}_conf) and metadata (run_id, image_name, depth,
    profile). ``feat_idx`` is the capture order within a run, dense from 0. A loaded bank also has
    the configuration of each run in cfg_* columns of its features, and places (run_id, input_path)."""

    features: DataFrame
    predictions: DataFrame
    metadata: DataFrame
    places: DataFrame | None = None

    def labelled(self) -> DataFrame:
        return align(self.features, self.predictions)


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with a row per key; reading a key that occurs twice is an error. The check is a part of
    the plan, dealt by the keys as a join on them is, so it costs that join no further shuffle."""
    rest = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.first(F.struct(*rest)).alias("_row"), F.count("*").alias("_n"))
    named = F.concat(F.lit("repeated key "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    return rows.withColumn("_row", F.when(F.col("_n") > 1, F.raise_error(named)).otherwise(F.col("_row"))).select(*keys, "_row.*")


def align(features: DataFrame, predictions: DataFrame) -> DataFrame:
    """A left lookup of predictions: one row per feature row, ``unknown`` and 0 where missing. A
    prediction key that occurs twice is an error."""
    out = features.join(unique(predictions, "run_id", "image_name"), ["run_id", "image_name"], "left")
    for k in (1, 2):
        if f"pred{k}_label" in predictions.columns:
            out = out.withColumn(f"pred{k}_label", F.coalesce(f"pred{k}_label", F.lit(UNKNOWN if k == 1 else "")))
            out = out.withColumn(f"pred{k}_conf", F.coalesce(f"pred{k}_conf", F.lit(0.0)))
    return out


def merged(bank: Bank, base: Column) -> DataFrame:
    """Features with their predictions, if any, and path: ``base`` joined with the image's name."""
    out = bank.features.join(unique(bank.predictions, "run_id", "image_name"), ["run_id", "image_name"], "left")
    return out.withColumn("path", text.resolved(base, F.col("image_name")))


def with_metadata(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """``rows`` (run_id, image_name, ...) that have metadata, with depth and profile. Names may have
    folders on either side: what is joined is the file's name, which image_name then is."""
    known = unique(metadata.select("run_id", text.basename(F.col("image_name")).alias("image_name"), "depth", "profile"), "run_id", "image_name")
    return rows.withColumn("image_name", text.basename(F.col("image_name"))).join(known, ["run_id", "image_name"])


def shape(features: DataFrame) -> DataFrame:
    """(run_id, num_rows, feat_dim, last_idx) of each run."""
    return features.groupBy("run_id").agg(F.count("*").alias("num_rows"), F.max(F.size("features")).cast("long").alias("feat_dim"), F.max("feat_idx").alias("last_idx"))


def chunks(features: DataFrame, size: int) -> DataFrame:
    """(run_id, chunk, idx_start, idx_end, n): the chunks of ``size`` rows of each run."""
    return features.groupBy("run_id", F.floor(F.col("feat_idx") / size).alias("chunk")).agg(F.min("feat_idx").alias("idx_start"), (F.max("feat_idx") + 1).alias("idx_end"), F.count("*").alias("n"))


def lookup(features: DataFrame, places: DataFrame) -> DataFrame:
    """Rows of each run at ``places`` (feat_idx, ...), once for each time a place is asked for."""
    return features.join(places, "feat_idx")


def fixture(spark: SparkSession, sf_dir: str) -> Bank:
    """A bank derived from the table ``embeddings``: four runs, some rows without prediction."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", vec.doubles("embedding").alias("features"))
    runs = F.concat(F.lit("run_"), (F.col("vec_id") % RUNS).cast("string"))
    names = F.concat(F.lit("img_"), F.col("vec_id").cast("string"), F.lit(".bmp"))
    order = F.floor(F.col("vec_id") / RUNS).cast("long")
    base = rows.select(runs.alias("run_id"), order.alias("feat_idx"), names.alias("image_name"), "features", "vec_id", "label")
    centres = rows.groupBy("label").agg(vec.mean_vector("features").alias("centre")).agg(F.sort_array(F.collect_list(F.struct("label", "centre"))).alias("centres"))
    near = F.transform("centres", lambda c: F.struct(((F.lit(2.0) - vec.cosine_distance(F.col("features"), c["centre"])) / 2).alias("conf"), c["label"].alias("of")))
    scored = base.where("vec_id % 29 <> 0").join(F.broadcast(centres)).select("run_id", "image_name", "label", near.alias("near"))  # one row: a vector per class
    own = F.filter("near", lambda x: x["of"] == F.col("label"))[0]
    other = F.array_max(F.transform(F.filter("near", lambda x: x["of"] != F.col("label")), lambda x: F.struct(x["conf"].alias("conf"), (-x["of"]).alias("minus"))))
    predictions = scored.select(
        "run_id", "image_name", F.concat(F.lit("class_"), F.col("label").cast("string")).alias("pred1_label"), own["conf"].alias("pred1_conf"),
        F.concat(F.lit("class_"), (-other["minus"]).cast("string")).alias("pred2_label"), other["conf"].alias("pred2_conf"),
    )
    metadata = base.select(
        "run_id", "image_name",
        F.when(F.col("feat_idx") % 17 != 0, F.col("feat_idx") * 0.8).alias("depth"),
        F.when(F.col("feat_idx") % 41 != 0, F.concat(F.lit("acq_"), F.floor(F.col("feat_idx") / 25).cast("string"))).alias("profile"),
    )
    return Bank(base.drop("vec_id", "label"), predictions, metadata)


#: The same views for DuckDB, as the start of a WITH list.
FIXTURE_SQL = """
raw AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
bank AS (SELECT 'run_' || (vec_id % 4) AS run_id, vec_id // 4 AS feat_idx, 'img_' || vec_id || '.bmp' AS image_name, v, vec_id, label FROM raw),
dims AS (SELECT unnest(range(1, 65)) AS i),
centre AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS m FROM raw, dims GROUP BY label, i) GROUP BY label),
near AS (SELECT b.run_id, b.image_name, b.label, c.label AS other, (1 + list_cosine_similarity(b.v, c.c)) / 2 AS conf FROM bank b, centre c WHERE b.vec_id % 29 <> 0),
best AS (SELECT *, row_number() OVER (PARTITION BY image_name ORDER BY conf DESC, other) AS r FROM near WHERE other <> label),
pred AS (SELECT o.run_id, o.image_name, 'class_' || o.label AS pred1_label, o.conf AS pred1_conf, 'class_' || b.other AS pred2_label, b.conf AS pred2_conf
         FROM near o JOIN best b ON o.image_name = b.image_name AND b.r = 1 WHERE o.other = o.label),
lab AS (SELECT b.run_id, b.feat_idx, b.image_name, b.v, coalesce(pred1_label, 'unknown') AS pred1_label, coalesce(pred1_conf, 0.0) AS pred1_conf,
        coalesce(pred2_label, '') AS pred2_label, coalesce(pred2_conf, 0.0) AS pred2_conf FROM bank b LEFT JOIN pred p ON b.image_name = p.image_name),
meta AS (SELECT run_id, image_name, CASE WHEN feat_idx % 17 <> 0 THEN feat_idx * CAST(0.8 AS DOUBLE) END AS depth, CASE WHEN feat_idx % 41 <> 0 THEN 'acq_' || (feat_idx // 25) END AS profile FROM bank)
"""
