"""Run discovery, configurations, and tables of a run: features, predictions, metadata.

Files of all runs are read together, as many paths of one read: a plan doesn't grow with the number
of runs, and a row's run comes from the path of its file.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.bank import Bank
from plumbline.functions import text
from plumbline.sources.artifacts import existing

#: What makes a folder a run: column of the index and name of the file.
KINDS = (("features", r"^features_.*\.(h5|parquet)$"), ("preds", r"^predictions_with_top3_scores\.csv$"), ("model_cfg", r"^model_config\.yaml$"), ("run_cfg", r"^config\.yaml$"))
#: Headers of a predictions file by column.
HEADERS = {
    "image_name": "Image Name",
    "pred1_label": "Top-1 Predicted Label", "pred1_conf": "Top-1 Confidence Score",
    "pred2_label": "Top-2 Predicted Label", "pred2_conf": "Top-2 Confidence Score",
    "pred3_label": "Top-3 Predicted Label", "pred3_conf": "Top-3 Confidence Score",
}
#: Columns that name the image, by preference.
NAMES = ("img_file_name", "image_name", "file_name", "filename", "object_id", "img_name", "name")
#: Fields of a model configuration.
FIELDS = ("architecture_type", "gray", "use_norm", "loss", "dataset", "temp", "batch_size", "num_epoch")


def listing(spark: SparkSession, parent: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """(path, folder, name) of the files under ``parent``, without reading them."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    files = reader.load(parent if recursive else f"{parent.rstrip('/')}/*").select("path")
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"))


def run_index(spark: SparkSession, parent: str) -> DataFrame:
    """(run_id, run_dir, features, preds, model_cfg, run_cfg) of each folder directly under
    ``parent`` that holds all four files, the first name of each kind. None is an error."""
    files = listing(spark, parent)
    kind = F.lit(None).cast("string")
    for column, pattern in KINDS:
        kind = F.when(F.col("name").rlike(pattern), F.lit(column)).otherwise(kind)
    found = files.withColumn("kind", kind).where("kind is not null").groupBy("folder").pivot("kind", [k for k, _ in KINDS]).agg(F.min("path"))
    found = found.where(" and ".join(f"{k} is not null" for k, _ in KINDS))
    out = found.select(F.col("folder").alias("run_id"), F.regexp_replace("preds", "/[^/]*$", "").alias("run_dir"), *[k for k, _ in KINDS]).orderBy("run_id")
    if not out.limit(1).count():
        raise ValueError(f"no run under {parent}: a run's folder holds {', '.join(p for _, p in KINDS)}")
    return out


def relaxed_yaml(content: str) -> dict:
    """A YAML mapping; tags of Python objects are dropped where a safe load refuses them."""
    import yaml

    for attempt in (content, re.sub(r"!!python/[^\s]*", "", content)):
        try:
            found = yaml.safe_load(attempt)
            return found if isinstance(found, dict) else {}
        except yaml.YAMLError:
            continue
    raise ValueError(f"not a YAML mapping: {content[:80]!r}")


def wanted(config: dict, *names: str):
    """The first value that isn't empty, by name, whatever its case."""
    low = {str(k).lower(): v for k, v in config.items()}
    return next((low[n] for n in names if low.get(n) not in (None, "")), None)


def named(path: str | Column) -> Column:
    """A path without its scheme, by which the paths of two readers are compared."""
    column = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.regexp_replace(column, "%20", " "), "^file:/*", "/")


def name_of(path: str) -> str:
    """``named`` of a path that the driver holds."""
    return re.sub("^file:/*", "/", path.replace("%20", " "))


def configs(spark: SparkSession, index: DataFrame) -> DataFrame:
    """(run_id, input_path, cfg_*) of each run; one row per run. A broken file is an error."""
    runs = index.select("run_id", "model_cfg", "run_cfg").collect()  # a row per run
    files = [r[c] for r in runs for c in ("run_cfg", "model_cfg")]
    texts = {r[0]: r[1] for r in spark.read.text(files, wholetext=True).select(named("_metadata.file_path"), "value").collect()}  # two short files per run
    rows = []
    for r in runs:
        run, model = (relaxed_yaml(texts.get(name_of(r[c]), "")) for c in ("run_cfg", "model_cfg"))
        section = wanted(model, "training_contrastive") or {}
        rows.append((r["run_id"], wanted(run, "input_path", "input-dir", "data_path"), *[None if (v := wanted(section, f)) is None else str(v) for f in FIELDS]))
    return spark.createDataFrame(rows, "run_id string, input_path string, " + ", ".join(f"cfg_{f} string" for f in FIELDS))


def by_header(spark: SparkSession, paths: list[str], sep: str) -> list[tuple[list[str], DataFrame]]:
    """(columns, rows) of files with a header: those of one header are one read. Rows also have
    _file, its path, and _at, which rises with the place in it. Empty files are left out."""
    rows = spark.read.text(paths).select(named("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    first = rows.where("block = 0").groupBy("file").agg(F.min_by("value", "n").alias("header"))
    groups = first.groupBy("header").agg(F.collect_list("file").alias("files")).collect()  # a path per file
    out, given = [], {name_of(p): p for p in paths}
    for g in sorted(groups, key=lambda g: min(g["files"])):
        df = spark.read.option("header", True).option("sep", sep).csv([given[f] for f in sorted(g["files"])])
        place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
        out.append((df.columns, df.select("*", named("_metadata.file_path").alias("_file"), place.alias("_at"))))
    return out


def with_run(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` (_file, ...) with the run_id of ``files`` (run_id, _file), a row per file."""
    return rows.join(F.broadcast(files), "_file")


def predictions(spark: SparkSession, files: DataFrame, columns: tuple[str, ...] = tuple(HEADERS)) -> DataFrame:
    """The asked-for ``columns`` of the predictions CSVs ``files`` (run_id, path); names and labels
    are strings, and a confidence that isn't a number is null."""
    paths = [r["path"] for r in files.collect()]  # a row per run
    files = files.select("run_id", named("path").alias("_file"))
    parts = []
    for there, rows in by_header(spark, paths, ","):
        if missing := [HEADERS[c] for c in columns if HEADERS[c] not in there]:
            raise ValueError(f"no column {missing[0]!r} in a predictions file")
        kind = lambda c: F.col(f"`{HEADERS[c]}`").try_cast("double" if c.endswith("_conf") else "string").alias(c)
        parts.append(with_run(rows, files).select("run_id", *[kind(c) for c in columns]))
    return reduce(DataFrame.unionByName, parts)


def name_column(columns: list[str]) -> str | None:
    """The column that names the image: a known one, else the first with name or file in it."""
    low = {c.lower(): c for c in reversed(columns)}
    return next((low[n] for n in NAMES if n in low), None) or next((c for c in columns if "name" in c.lower() or "file" in c.lower()), None)


def metadata(spark: SparkSession, folders: DataFrame, depth: str = "object_depth_min", profile: str = "acq_id", aliases: tuple[str, ...] = ("object_depth", "object_depth_max")) -> DataFrame:
    """(run_id, image_name, depth, profile) of all TSV files of the ``folders`` (run_id, path); the
    last row of an image stays.

    Files are in order of name, rows in order of place. A folder that doesn't exist has none, and a
    file that has no name column, or can't be read as one, is left out; a missing depth or profile
    column is null, and so is a depth that isn't a number.
    """
    schema = "run_id string, image_name string, depth double, profile string"
    there = [(r["run_id"], r["path"]) for r in folders.collect() if existing(spark, r["path"])]  # a row per run
    if not there:
        return spark.createDataFrame([], schema)
    places = spark.createDataFrame(there, "run_id string, folder string")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tsv").load(sorted({p for _, p in there})).select("path", named("path").alias("_file"))
    folder = lambda c: F.regexp_replace(named(c), "/+$", "")
    files = found.join(F.broadcast(places), F.regexp_replace("_file", "/[^/]*$", "") == folder("folder")).select("run_id", "_file", "path").collect()  # a row per file
    paths = sorted({r["path"] for r in files})
    files = spark.createDataFrame([(r["run_id"], r["_file"]) for r in files], "run_id string, _file string")
    parts = []
    for columns, rows in by_header(spark, paths, "\t") if paths else []:
        name = name_column(columns)
        if not name:
            continue
        deep = next((c for c in (depth, *aliases) if c in columns), None)
        pick = lambda c: F.col(f"`{c}`") if c else F.lit(None).cast("string")
        parts.append(with_run(rows, files).select("run_id", text.basename(pick(name)).alias("image_name"), text.number(pick(deep)).alias("depth"), pick(profile if profile in columns else None).alias("profile"), text.basename(F.col("_file")).alias("_name"), "_at"))
    return last_rows(reduce(DataFrame.unionByName, parts), "_name", "_at").select("run_id", "image_name", "depth", "profile") if parts else spark.createDataFrame([], schema)


def last_rows(rows: DataFrame, *order: str) -> DataFrame:
    """The last row of each image of a run in the order of columns."""
    rank = F.row_number().over(Window.partitionBy("run_id", "image_name").orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def hdf5(spark: SparkSession, path: str, run_id: str, chunk: int = 4096) -> DataFrame:
    """(run_id, feat_idx, image_name, features) of an HDF5 bank, a partition per chunk of rows.
    Needs h5py on driver and executors."""
    import h5py

    with h5py.File(path, "r") as f:
        n = f["features"].shape[0]
    ranges = spark.range(0, n, chunk, max(1, -(-n // chunk)))

    def read(batches):
        import h5py
        import pyarrow as pa

        with h5py.File(path, "r") as f:
            for batch in batches:
                for lo in batch.column(0).to_pylist():
                    x, names = f["features"][lo : lo + chunk], f["image_names"][lo : lo + chunk]
                    names = [v.decode() if isinstance(v, bytes) else str(v) for v in names]
                    yield pa.RecordBatch.from_arrays([pa.array([run_id] * len(x)), pa.array(range(lo, lo + len(x)), pa.int64()), pa.array(names), pa.array(list(x.astype(float)), pa.list_(pa.float64()))], names=["run_id", "feat_idx", "image_name", "features"])

    return ranges.mapInArrow(read, "run_id string, feat_idx long, image_name string, features array<double>")


def features(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The vectors of ``files`` (run_id, path): Parquet (feat_idx, image_name, features), all in one
    read, or HDF5, one read each."""
    given = [(r["run_id"], r["path"]) for r in files.collect()]  # a row per run
    parts = [hdf5(spark, re.sub("^file:/*", "/", path), run) for run, path in given if path.endswith(".h5")]
    if flat := [path for _, path in given if not path.endswith(".h5")]:
        rows = spark.read.parquet(*flat).select(named("_metadata.file_path").alias("_file"), F.col("feat_idx").cast("long").alias("feat_idx"), F.col("image_name").cast("string").alias("image_name"), F.col("features").cast("array<double>").alias("features"))
        # a run's Parquet file may be a folder of parts
        known = files.select("run_id", named("path").alias("_of"))
        own = F.regexp_extract("_file", r"^(.*/features_[^/]*\.parquet)(/.*)?$", 1)
        parts.append(rows.join(F.broadcast(known), own == F.col("_of")).select("run_id", "feat_idx", "image_name", "features"))
    return reduce(DataFrame.unionByName, parts)


def load(spark: SparkSession, parent: str, with_metadata: bool = True) -> Bank:
    """The bank of all runs under ``parent``; features also have the cfg_* columns of their run."""
    index = run_index(spark, parent).collect()  # a row per run
    index = spark.createDataFrame([tuple(r) for r in index], "run_id string, run_dir string, " + ", ".join(f"{k} string" for k, _ in KINDS))
    known = configs(spark, index)
    paths = lambda c: index.select("run_id", F.col(c).alias("path"))
    places = known.where("input_path is not null").select("run_id", F.col("input_path").alias("path")) if with_metadata else known.limit(0).select("run_id", F.col("input_path").alias("path"))
    rows = features(spark, paths("features")).join(F.broadcast(known.drop("input_path")), "run_id")  # a row per run
    return Bank(rows, predictions(spark, paths("preds")), metadata(spark, places), known.select("run_id", "input_path"))
