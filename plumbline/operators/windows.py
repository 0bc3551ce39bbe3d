"""Windows over a run's capture order: by count, by depth bin and by profile.

All give (run_id, step, window, pos, n, feat_idx): windows of a run are numbered from 0 by ``step``
and ``pos`` numbers the ``n`` rows of a window in capture order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.sampling import even_positions


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (run_id, step, window, feat_idx) with pos and n."""
    w = Window.partitionBy("run_id", "step")
    out = rows.withColumn("pos", F.row_number().over(w.orderBy("feat_idx")).cast("long") - 1).withColumn("n", F.count("*").over(w))
    return out.select("run_id", "step", "window", "pos", "n", "feat_idx")


def by_count(rows: DataFrame, size: int, hop: int) -> DataFrame:
    """Full windows of ``size`` rows every ``hop``; none if ``size`` is 1 or less."""
    if size <= 1:
        return rows.select("run_id", F.lit(0).cast("long").alias("step"), F.lit("").alias("window"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), "feat_idx").where("false")
    n = rows.groupBy("run_id").agg(F.count("*").alias("_n"))
    all_ = rows.select("run_id", "feat_idx").join(n, "run_id").where(F.col("_n") >= size)
    first = F.greatest(F.lit(0), F.ceil((F.col("feat_idx") - (size - 1)) / hop))
    last = F.least(F.floor(F.col("feat_idx") / hop), F.floor((F.col("_n") - size) / hop))
    out = all_.where(first <= last).withColumn("step", F.explode(F.sequence(first, last))).withColumn("pos", F.col("feat_idx") - F.col("step") * hop)
    return out.select("run_id", "step", F.concat(F.col("step") * hop, F.lit("-"), F.col("step") * hop + size).alias("window"), "pos", F.lit(size).cast("long").alias("n"), "feat_idx")


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``placed`` rows of windows that ``by`` orders within a run and ``name`` names: windows are
    numbered among themselves, a row each, and never by sorting a whole run."""
    found = rows.select("run_id", by, name).distinct()
    steps = found.select("run_id", by, F.col(name).alias("window"), (F.row_number().over(Window.partitionBy("run_id").orderBy(by)).cast("long") - 1).alias("step"))
    return placed(rows.join(steps, ["run_id", by]).select("run_id", "step", "window", "feat_idx"))


def by_depth(rows: DataFrame, size: float) -> DataFrame:
    """Bins of ``size`` from the run's least depth, named by their middle; null depths are out."""
    known = rows.where("depth is not null")
    known = known.join(known.groupBy("run_id").agg(F.min("depth").alias("_low")), "run_id")
    known = known.withColumn("_bin", F.floor((F.col("depth") - F.col("_low")) / size))
    return numbered(known.withColumn("_name", F.round(F.col("_low") + (F.col("_bin") + 0.5) * size, 6).cast("string")), "_bin", "_name")


def by_profile(rows: DataFrame) -> DataFrame:
    """A window per profile in order of first occurrence; rows without profile are one window."""
    known = rows.withColumn("_none", F.col("profile").isNull()).withColumn("_name", F.coalesce("profile", F.lit("None")))
    first = known.groupBy("run_id", "_none", "_name").agg(F.min("feat_idx").alias("_first"))
    return numbered(known.join(first, ["run_id", "_none", "_name"]), "_first", "_name")


def sampled(windows: DataFrame, k: int) -> DataFrame:
    """Evenly spaced rows of windows that hold more than ``k``."""
    keep = (F.col("n") <= k) | F.array_contains(even_positions(F.col("n"), k), F.col("pos"))
    return windows.where(keep)


def consecutive(windows: DataFrame) -> DataFrame:
    """(run_id, step, window_from, window_to) of each window and the next."""
    names = windows.select("run_id", "step", "window").distinct()
    nxt = F.lead("window").over(Window.partitionBy("run_id").orderBy("step"))
    return names.select("run_id", "step", F.col("window").alias("window_from"), nxt.alias("window_to")).where("window_to is not null")
