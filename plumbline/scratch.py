"""Tables between the steps of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``. Where that is unset, a folder of the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A new path of the shared folder, deleted by ``clean``."""
    new = f"{root(spark)}/plumbline-{name}-{uuid.uuid4().hex}"
    _written.append((spark, new))
    return new


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written as a Parquet table in the shared folder, and read again.

    It cuts the lineage: a lost executor costs no more than the tasks that read the table, and
    what is built on it is not worked out again.
    """
    spark = df.sparkSession
    place = path(spark, name)
    df.write.option("compression", compression).parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def delete(spark: SparkSession, place: str) -> None:
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(place)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def clean(spark: SparkSession | None = None) -> None:
    """Deletes all tables written so far; frames that read them can't be used any more.

    A session that has ended deletes nothing itself: a running one stands in, and without any a
    path of the local file system is deleted as such. One that can't be deleted keeps no other.
    """
    live = spark or SparkSession.getActiveSession()
    for made_by, place in _written:
        user = live or made_by
        try:
            if user.sparkContext._jsc is not None:
                delete(user, place)
            elif place.startswith(("/", "file:")):
                shutil.rmtree(place.removeprefix("file:"), ignore_errors=True)
            else:
                print(f"left behind: {place}", file=sys.stderr)
        except Exception as error:
            print(f"left behind: {place} ({error})", file=sys.stderr)
    _written.clear()


atexit.register(clean)
