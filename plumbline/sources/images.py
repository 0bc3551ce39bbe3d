"""Image files of a run and the cascade that resolves a name to one of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.sources.artifacts import existing

SUFFIXES = ("bmp", "jpg", "jpeg", "png", "tif", "tiff")


def image_index(spark: SparkSession, folder: str) -> DataFrame:
    """(path, rel, name, stem) of all images under ``folder``; keys are lower-cased."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    files = files.where(F.lower("path").rlike(rf"\.({'|'.join(SUFFIXES)})$"))
    return keyed(files, folder)


def run_images(spark: SparkSession, places: DataFrame) -> DataFrame:
    """(run_id, path, rel, name, stem) of all images under the ``places`` (run_id, input_path) that
    exist; folders that runs share are listed once."""
    there = [(r["run_id"], r["input_path"]) for r in places.where("input_path is not null").collect() if existing(spark, r["input_path"])]  # a row per run
    empty = spark.createDataFrame([], "run_id string, path string, rel string, name string, stem string")
    if not there:
        return empty
    parts = [image_index(spark, folder).select(F.explode(F.array(*[F.lit(run) for run, f in there if f == folder])).alias("run_id"), "path", "rel", "name", "stem") for folder in sorted({f for _, f in there})]
    return reduce(DataFrame.unionByName, parts)


def keyed(files: DataFrame, folder: str) -> DataFrame:
    root = folder.rstrip("/") + "/"
    rel = F.lower(F.substring_index("path", root, -1))
    return files.select("path", rel.alias("rel"), text.basename(rel).alias("name"), text.stem(rel).alias("stem"))


def last_by_name(index: DataFrame) -> DataFrame:
    """(run_id, name, path): the last path of each file name of a run."""
    return index.groupBy("run_id", "name").agg(F.max("path").alias("path"))


def with_paths(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``rows`` (run_id, image_name, ...) with abs_path: the image of that name, else empty."""
    known = last_by_name(index).select("run_id", F.col("name").alias("_name"), F.col("path").alias("abs_path"))
    out = rows.withColumn("_name", F.lower("image_name")).join(known, ["run_id", "_name"], "left").drop("_name")
    return out.withColumn("abs_path", F.coalesce("abs_path", F.lit("")))


def resolved(names: DataFrame, index: DataFrame, column: str = "image_name") -> DataFrame:
    """``names`` with path: the file at that relative path, else the first of that file name, else
    the one of that stem whose path holds most of the name's folders (the first of equals)."""
    rel = F.lower(F.regexp_replace(text.slashed(F.col(column)), "^[./]+", ""))
    keys = names.select(column).distinct().select(F.col(column).alias("_of"), rel.alias("_rel"))
    keys = keys.withColumn("_name", text.basename(F.col("_rel"))).withColumn("_stem", text.stem(F.col("_rel")))
    found = cascade(keys, index, ["_of"])
    return names.join(found, names[column] == found["_of"], "left").drop("_of")


def cascade(keys: DataFrame, index: DataFrame, of: list[str]) -> DataFrame:
    """(*of, path) of ``keys`` (*of, _rel, _name, _stem) among an index (path, rel, name, stem)."""
    by_rel = index.groupBy(F.col("rel").alias("_rel")).agg(F.min("path").alias("_p1"))
    by_name = index.groupBy(F.col("name").alias("_name")).agg(F.min("path").alias("_p2"))
    folders = F.filter(F.split("_rel", "/"), lambda x: (x != "") & ~F.contains(x, F.lit(".")))
    near = keys.join(index.select(F.col("stem").alias("_stem"), F.col("path").alias("_p3"), F.col("rel").alias("_at")), "_stem")
    near = near.withColumn("_score", F.size(F.filter(folders, lambda x: F.contains(F.col("_at"), x))))
    by_stem = near.groupBy(*of).agg(F.min_by("_p3", F.struct(-F.col("_score"), "_p3")).alias("_p3"))
    found = keys.join(by_rel, "_rel", "left").join(by_name, "_name", "left").join(by_stem, of, "left")
    return found.select(*of, F.coalesce("_p1", "_p2", "_p3").alias("path"))


def resolved_by_run(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``rows`` (run_id, image_name, ...) with path, resolved among the images of the row's run: the
    run's name is put in front of both, as a folder of its own."""
    own = lambda c: F.concat(F.lower("run_id"), F.lit("/"), c)
    keys = index.select("path", own(F.col("rel")).alias("rel"), own(F.col("name")).alias("name"), own(F.col("stem")).alias("stem"))
    rel = F.lower(F.regexp_replace(text.slashed(F.col("image_name")), "^[./]+", ""))
    names = rows.select("run_id", "image_name").distinct()
    names = names.withColumn("_rel", own(rel)).withColumn("_name", own(text.basename(rel))).withColumn("_stem", own(text.stem(rel)))
    return rows.join(cascade(names, keys, ["run_id", "image_name"]), ["run_id", "image_name"], "left")
