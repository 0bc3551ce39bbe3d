"""Mixing sources to target weights by systematic sampling.

Within a source a document's expected copies are what is still wanted of the source over what is
still left of it. Prefix sums of expected copies, in order of falling size, start at one random
offset for the source; a document is taken once per integer boundary that its step crosses.

The few large documents that could carry the sample off its target come first, each with the rate
that the ones before it leave. The many others share one rate, so a prefix sum is a rank times that
rate. Ranks come from a range partitioning on (source, size, hash of the id): rows are counted
within a partition and offset by the counts of the partitions before, so a source of any size is
spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import _runtime as R

SEED = 20240311
#: A document is large that has more than 1/200 of its source's target and 1/1000 of its source:
#: no source has more than 1000 of them.
LARGE_TARGET, LARGE_SOURCE = 200, 1000


def words(text: Column) -> Column:
    """Number of words that end at ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size) with target: words that the mix wants of the source.

    Sources in order of code point, null last, weigh ``weights``, repeating. They share ``share``
    of all words; a target stops at ``cap`` times its source's size, and what is above is shared
    again by weight. Sources in order of cap over weight are filled one after another: one is
    capped if an equal share of what remains would exceed its cap. One row per source is sorted.
    """
    name = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    out = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(name) - 1) % len(weights) + 1).cast("int")))
    out = out.withColumn("cap", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("cap") / F.col("weight"))
    out = out.withColumn("all", F.sum("source_size").over(whole) * F.lit(float(share)))
    rest = (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    out = out.withColumn("full", rest >= F.col("ratio"))
    out = out.withColumn("level", F.try_divide(F.col("all") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole), F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.greatest(F.lit(0.0), F.col("level") * F.col("weight"))))
    return out.select("source", "source_size", target.alias("target"))


def crossings(before: Column, after: Column) -> Column:
    """Integers in the step of a prefix sum."""
    return (F.floor(after) - F.floor(before)).cast("long")


def copies_of_large(large: DataFrame, cap: float) -> DataFrame:
    """(of, at, taken, big): for each source of ``large``, its rows in order with their copies.

    ``at`` is the offset and all expected copies up to the last one, ``taken`` the words so far
    and ``big`` the words of all large ones. A source has LARGE_SOURCE rows at most.
    """
    item = F.struct((-F.col("size")).alias("order"), "shuffled", "doc_id", "mark", "ordinal", "size")
    lists = large.groupBy("source").agg(F.first("offset").alias("offset"), F.first("target").alias("target"), F.first("source_size").alias("source_size"), F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.col("offset").alias("at"), F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("passed"), F.array().cast("array<bigint>").alias("copies"))

    def step(s: Column, x: Column) -> Column:
        rate = F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), (F.col("target") - s["taken"]) / (F.col("source_size") - s["passed"])))
        n = crossings(s["at"], s["at"] + rate)
        return F.struct((s["at"] + rate).alias("at"), (s["taken"] + n * x["size"]).alias("taken"), (s["passed"] + x["size"]).alias("passed"), F.concat(s["copies"], F.array(n)).alias("copies"))

    out = lists.withColumn("s", F.aggregate("items", start, step))
    return out.select(F.col("source").alias("of"), F.col("s.at").alias("at"), F.col("s.taken").alias("taken"), F.col("s.passed").alias("big"), F.arrays_zip("items", F.col("s.copies").alias("copies")).alias("rows"))


def identified(documents: DataFrame) -> DataFrame:
    """(doc_id, source, mark, ordinal, row): ``mark`` is a hash of the text, ``ordinal`` numbers rows
    that are equal in all three, and ``row`` holds all columns."""
    out = documents.select("doc_id", "source", F.xxhash64("text").alias("mark"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    key = ["doc_id", "source", "mark"]
    if not out.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return out.withColumn("ordinal", F.lit(1))
    return out.withColumn("ordinal", F.row_number().over(Window.partitionBy(*key).orderBy("mark")))


def plan(documents: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, cap: float = 3.0, seed: int = SEED) -> DataFrame:
    """A row per row of ``documents``: doc_id, source, mark, ordinal, size, source_size, target, copies.

    ``size`` is the text's words; ``copies`` is 0 to ``ceil(cap)``. ``mark`` is a hash of the text,
    and ``ordinal`` numbers rows of equal doc_id, source and mark; it is 1 where none are. A null
    text has size 0, a null source is a source of its own, and rows without doc_id take part. A
    source without words has target 0 and no copies. An empty table gives an empty plan. Other
    columns are ignored.
    """
    return planned(identified(documents.select("doc_id", "source", "text")), weights, share, cap, seed)


def planned(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, cap: float = 3.0, seed: int = SEED) -> DataFrame:
    """``plan`` of ``identified`` rows."""
    spark = rows.sparkSession
    sized = rows.select("doc_id", "source", "mark", "ordinal", words(F.col("row.text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "mark").alias("shuffled"))
    sized = R.written(sized, "sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("")), F.col("source").isNull()), F.lit(1 << 20)) / F.lit(float(1 << 20))
    bound = F.greatest(F.col("target") / LARGE_TARGET, F.col("source_size") / LARGE_SOURCE)
    sources = R.written(sources.select(F.col("source").alias("of"), "source_size", "target", draw.alias("offset"), bound.alias("bound")), "targets")
    same = F.col("source").eqNullSafe(F.col("of"))
    large = copies_of_large(sized.join(sources, same).where("size > bound"), cap)
    large = R.written(large, "large")
    left = sources.join(large.select(F.col("of").alias("source"), "at", "taken", "big"), same, "left").drop("source")
    words_left = F.col("source_size") - F.coalesce("big", F.lit(0))
    rate = F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("target") - F.coalesce("taken", F.lit(0)), words_left), F.lit(0.0))))
    left = R.written(left.select("of", "source_size", "target", "bound", F.coalesce("at", "offset").alias("at"), rate.alias("rate")), "rates")

    small = sized.join(left, same).where("size <= bound").drop("of", "bound")
    order = [F.col("source"), F.col("size").desc(), F.col("shuffled"), F.col("doc_id"), F.col("mark"), F.col("ordinal")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = R.written(small.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    counts = small.groupBy("part", "source").agg(F.count("*").alias("n"))
    counts = counts.select(F.col("part").alias("in"), F.col("source").alias("of"), (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("before"))
    here = F.row_number().over(Window.partitionBy("part", "source").orderBy(*order[1:]))
    small = small.withColumn("here", here).join(counts, (F.col("part") == F.col("in")) & same)
    rank = F.col("before") + F.col("here")
    small = small.withColumn("copies", crossings(F.col("at") + (rank - 1) * F.col("rate"), F.col("at") + rank * F.col("rate")))

    found = large.select(F.col("of").alias("source"), F.explode("rows").alias("r")).select("source", "r.items.doc_id", "r.items.mark", "r.items.ordinal", "r.items.size", "r.copies")
    found = found.join(sources.select("of", "source_size", "target"), same)
    columns = ["doc_id", "source", "mark", "ordinal", "size", "source_size", "target", "copies"]
    return small.select(*columns).union(found.select(*columns))


def mixed(documents: DataFrame, **parameters) -> DataFrame:
    """``documents`` with each row as often as the plan takes it; its columns have any names and
    stay as they are."""
    numbered = identified(documents)
    rows = R.written(planned(numbered, **parameters).where("copies > 0"), "plan")
    taken = rows.select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("mark").alias("m"), F.col("ordinal").alias("o"), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("mark") == F.col("m")) & (F.col("ordinal") == F.col("o"))
    # texts are always sorted to the plan: a broadcast while the plan is small would be another plan
    kept = numbered.join(taken.hint("merge"), same)
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op1_mix(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    rows = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
