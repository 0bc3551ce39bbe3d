"""Session helpers shared by the operators: tables between steps and Arrow batch size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.scratch import path as scratch_path
from plumbline.scratch import written

__all__ = ["ARROW_ROWS", "FILES", "FILE_ROWS", "SHARE", "gathered", "met", "partitions", "scratch_path", "small_batches", "text_of", "written"]

#: Rows of an Arrow batch sent to a Python worker. Texts may be long, so a batch holds few.
ARROW_ROWS = 256
#: Least rows of a key that ``met`` splits; keys of less than a partition's share never are.
SHARE = 1000
#: Short rows in a file of a gathered table, and the files that are never gathered further.
FILE_ROWS, FILES = 100_000, 12


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds what a reader of Parquet and a Python worker hold at once: ``rows`` rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))


def text_of(column: Column | str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, at most ``rows`` short rows that cost little to work out, in fewer tasks and so in fewer files.

    Each file costs more than its bytes: without its native library Hadoop's local file system starts
    a process for each permission it sets, and until that process has its own program it counts as a
    second executor to whoever sums memory. Tasks grow with the rows, so none is large at any size.
    """
    return df.coalesce(max(FILES, -(-rows // FILE_ROWS)))


def met(rows: DataFrame, keys: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to the distinct ``keys``, of which n counts the rows that have them.

    A key with more than a partition's share of these rows is split into keys of that share, to
    which ``by`` deals its rows. There are fewer such keys than partitions, so a broadcast of them
    is small at any size of the input.
    """
    parts = partitions(rows)
    share = F.lit(max(SHARE, -(-(keys.agg(F.sum("n")).first()[0] or 0) // parts)))
    split = F.ceil(F.col("n") / share)
    hot = F.broadcast(keys.where(F.col("n") > share).select(*on, split.alias("splits")))
    dealt = rows.join(hot, on, "left").withColumn("split", F.coalesce(F.pmod(F.xxhash64(by), F.col("splits")), F.lit(0).cast("long"))).drop("splits")
    return dealt.join(keys.withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), split - 1))).drop("n"), [*on, "split"], how).drop("split")
