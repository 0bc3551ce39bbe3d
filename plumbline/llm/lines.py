"""Line dedup: later copies of repeated line runs are deleted. DataFrame functions throughout.

The corpus is one sequence of lines with words: documents in order, a gap of one place after each.
Distributed prefix doubling orders its suffixes. A round pairs the rank of the 2**k lines at each
place with that of the 2**k lines behind them, keeps pairs that occur twice or more, and ranks
those by a range partitioning and a sort, so that ranks rise as the suffixes do. Places of equal
rank are an interval of the suffix array whose longest common prefix is 2**k lines or more; its
least place is the first copy and the others are later ones. A place in no interval has its final
order among the repeated and leaves. Rounds end when no interval is left, so the last interval
of each place tells the longest run, to a power of two, that it shares with an earlier place. The
starts of a maximal repeated run and the ends of its last intervals cover it as a whole.

A run counts if it has ``min_words`` words. Later copies in intervals that have them are deleted as
they are. What is left are runs of fewer than 2 * ``min_words`` lines at their edges: a line is in
one that counts and occurs earlier if and only if it is in a least counting window (one that no
line can leave at its open end) that does. Such a window of n lines is the overlap of two
intervals, those of its first and of its last 2**k lines, 2**k <= n.

Ranks that very many places share are split: places meet them in as many keys as needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import _runtime as R

MIN_WORDS = 10
WORD = r"[^\x20\x09-\x0D]+"
#: A document's place in the order: rows without an id first, then by id, repeated ids by text.
PLACE = ["known", "doc", "copy"]


def numbered(documents: DataFrame) -> DataFrame:
    """(known, doc, copy, row) of each row, all of its columns in the struct ``row``.

    ``copy`` tells rows of one id apart, in order of text: they are ranked by a range partitioning
    that includes the text, so an id, or no id, may be that of very many rows.
    """
    out = documents.select(F.col("doc_id").isNotNull().cast("int").alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    if not out.groupBy("known", "doc").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return out.select("known", "doc", F.lit(0).cast("long").alias("copy"), "row")
    order = ["known", "doc", "row.text"]
    out = out.repartitionByRange(R.partitions(out), *order).sortWithinPartitions(*order)
    return R.written(out.select("known", "doc", F.monotonically_increasing_id().alias("copy"), "row"), "numbered")


def based(lines: DataFrame) -> DataFrame:
    """(known, doc, copy, base) of each document: its first place in the sequence of all lines."""
    sizes = lines.groupBy(*PLACE).agg((F.max("i") + 2).cast("long").alias("n"))
    rows = R.written(sizes.repartitionByRange(R.partitions(lines), *PLACE).withColumn("part", F.spark_partition_id()), "documents")
    parts = rows.groupBy("part").agg(F.sum("n").alias("n"))  # a row per partition
    before = F.broadcast(parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")))
    here = F.sum("n").over(Window.partitionBy("part").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return R.written(rows.withColumn("here", here).join(before, "part").select(*PLACE, (F.col("before") + F.col("here")).alias("base")), "bases")


def places(documents: DataFrame, min_words: int) -> DataFrame:
    """A row per line with words: its document, i (among such lines), line, a and b (its id), w (its
    words), and its least windows forward (ahead lines, up to line ahead_end) and backward (back,
    back_start)."""
    rows = F.transform(F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n"), lambda x, n: F.struct(n.alias("line"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    rows = F.filter(rows, lambda x: x["w"] > 0)
    docs = documents.select(*PLACE, rows.alias("rows"))

    def least(lines: Column) -> Column:
        """How many of the first lines have the words, 0 if all haven't."""
        state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("w"))
        step = lambda s, x: F.when(s["w"] >= min_words, s).otherwise(F.struct((s["n"] + 1).alias("n"), (s["w"] + x["w"]).alias("w")))
        return F.aggregate(lines, state, step, lambda s: F.when(s["w"] >= min_words, s["n"]).otherwise(0))

    def place(x: Column, i: Column) -> Column:
        ahead = least(F.slice("rows", i + 1, F.lit(min_words)))
        first = F.greatest(i - min_words + 1, F.lit(0))
        back = least(F.reverse(F.slice("rows", first + 1, i - first + 1)))
        return F.struct(i.alias("i"), x["line"].alias("line"), x["a"].alias("a"), x["b"].alias("b"), x["w"].alias("w"), ahead.alias("ahead"), back.alias("back"))

    listed = docs.select(*PLACE, "rows", F.explode(F.transform("rows", place)).alias("p"))
    end = F.get(F.col("rows"), F.col("p.i") + F.col("p.ahead") - 1)["line"]
    start = F.get(F.col("rows"), F.col("p.i") - F.col("p.back") + 1)["line"]
    return listed.select(*PLACE, "p.*", F.when(F.col("p.ahead") > 0, end).alias("ahead_end"), F.when(F.col("p.back") > 0, start).alias("back_start"))


def ranked(keys: DataFrame, *order: str) -> DataFrame:
    """``keys`` with rank, which rises with ``order``; keys are distinct."""
    rows = keys.repartitionByRange(R.partitions(keys), *order).sortWithinPartitions(*order)
    return R.written(rows.withColumn("place", F.monotonically_increasing_id()), "ranks")


def repeated(lines: DataFrame, bases: DataFrame) -> DataFrame:
    """Lines that occur twice or more: p (their place), base, rank and the columns of ``lines``."""
    names = ranked(lines.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1"), "a", "b")
    rows = R.met(lines, names, ["a", "b"], "doc").join(bases, PLACE)
    return R.written(rows.select((F.col("base") + F.col("i")).alias("p"), "base", F.col("place").alias("rank"), "w", "line", "ahead", "ahead_end", "back", "back_start"), "repeated")


def doubled(lines: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Intervals of the suffix array of ``repeated`` lines.

    First (k, p, rank) for each repeated run of 2**k lines at place p, 2**k at most ``min_words``.
    Second (base, p, n, start, end) for each place whose last interval with an earlier place has
    ``min_words`` words: the n lines from p, lines start to end of a document.
    """
    now = lines.select("p", "base", "rank", F.col("w").cast("long").alias("words"), F.col("line").alias("start"), F.col("line").alias("end"), F.lit(False).alias("later"))
    levels, runs, k = now.select(F.lit(0).alias("k"), "p", "rank"), None, 0
    while True:
        behind = now.select((F.col("p") - (1 << k)).alias("p"), F.col("rank").alias("next"), F.col("words").alias("more"), F.col("end").alias("last"))
        pairs = R.written(now.join(behind, "p", "left"), "pairs")
        names = pairs.where("next is not null").groupBy("rank", "next").agg(F.count("*").alias("n"), F.min("p").alias("first")).where("n > 1")
        both = R.met(pairs, ranked(names, "rank", "next"), ["rank", "next"], "p", "left")
        after = R.written(both.withColumn("again", F.coalesce(F.col("p") > F.col("first"), F.lit(False))), "intervals")
        ended = after.where(F.col("later") & ~F.col("again") & (F.col("words") >= min_words)).select("base", "p", F.lit(1 << k).alias("n"), "start", "end")
        runs = ended if runs is None else runs.unionByName(ended)
        now = after.where("place is not null").select("p", "base", F.col("place").alias("rank"), (F.col("words") + F.col("more")).alias("words"), "start", F.col("last").alias("end"), F.col("again").alias("later"))
        k += 1
        if now.limit(1).count() == 0:
            return levels, runs
        if 1 << k <= min_words:
            levels = levels.unionByName(now.select(F.lit(k).alias("k"), "p", "rank"))


def later_runs(lines: DataFrame, bases: DataFrame, min_words: int) -> DataFrame:
    """(base, start, end) lines of counting runs that occur earlier; end is included."""
    rows = repeated(lines, bases)
    levels, runs = doubled(rows, min_words)
    runs = R.written(runs, "runs")
    ahead = rows.where("ahead > 0").select("base", "p", F.col("ahead").alias("n"), F.col("line").alias("start"), F.col("ahead_end").alias("end"))
    back = rows.where("back > 0").select("base", (F.col("p") - F.col("back") + 1).alias("p"), F.col("back").alias("n"), F.col("back_start").alias("start"), F.col("line").alias("end"))
    # a window inside a run found above is deleted with it, and is no first copy
    inside = runs.select("p", F.col("n").alias("reach"))
    windows = ahead.union(back).dropDuplicates(["p", "n"]).join(inside, "p", "left").where("reach is null or reach < n").drop("reach")
    windows = windows.withColumn("k", F.floor(F.log2(F.col("n").cast("double")) + 1e-9).cast("int"))
    windows = windows.join(levels.select("p", "k", F.col("rank").alias("head")), ["p", "k"])
    windows = windows.withColumn("q", (F.col("p") + F.col("n") - F.pow(F.lit(2), F.col("k"))).cast("long"))
    windows = windows.join(levels.select(F.col("p").alias("q"), "k", F.col("rank").alias("tail")), ["q", "k"])
    windows = R.written(windows.select("base", "p", F.col("n").alias("length"), "head", "tail", "start", "end"), "windows")
    on = ["length", "head", "tail"]
    firsts = R.written(windows.groupBy(*on).agg(F.count("*").alias("n"), F.min("p").alias("first")).where("n > 1"), "firsts")
    short = R.met(windows, firsts, on, "p").where(F.col("p") > F.col("first"))
    return runs.select("base", "start", "end").union(short.select("base", "start", "end"))


def merged(spans: DataFrame) -> DataFrame:
    """(base, runs) with the union of a document's runs as spans (start, end excluded)."""
    order = Window.partitionBy("base").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.groupBy("base", "start").agg(F.max("end").alias("end"))
    marked = spans.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    whole = marked.groupBy("base", "run").agg(F.min("start").alias("start"), (F.max("end") + 1).alias("end"))
    return whole.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def deduplicate_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``documents`` without later copies of repeated line runs; adds n_lines, n_deleted and runs.

    Lines are parts between line feeds. A run of successive lines, those without words left out,
    counts if it has ``min_words`` words or more; where one occurs again, later in order of doc_id
    and line, the later lines with words are deleted. ``runs`` lists the deleted spans of lines,
    and lines without words inside them stay. Columns of these names are replaced; others may have
    any name and stay.

    A null text is an empty text of one line, and stays null. Rows without doc_id come before all
    others; rows of one doc_id are in order of text, so of repeated rows the first one stays.
    """
    keyed = numbered(documents.drop("n_lines", "n_deleted", "runs"))
    lines = R.written(places(keyed, min_words), "lines")
    bases = based(lines)
    found = R.written(merged(later_runs(lines, bases, min_words)).join(bases, "base").drop("base"), "spans")
    out = keyed.join(found.hint("merge"), PLACE, "left")  # the same plan at every size
    rows = F.split("row.text", "\n")
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = out.select("row", F.coalesce("runs", none).alias("runs"))
    kept = F.filter(rows, lambda x, n: ~F.exists("runs", lambda s: (s["start"] <= n) & (n < s["end"])) | (F.regexp_count(x, F.lit(WORD)) == 0))
    out = out.withColumn("n_lines", F.coalesce(F.size(rows), F.lit(1)).cast("long")).withColumn("kept", F.when(F.size("runs") == 0, rows).otherwise(kept))
    out = out.withColumn("n_deleted", F.when(F.col("row.text").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")).cast("long"))
    out = out.withColumn("text", F.when(F.col("n_deleted") == 0, F.col("row.text")).otherwise(F.array_join("kept", "\n")))
    return out.select(F.col("row").withField("text", F.col("text")).alias("row"), "n_lines", "n_deleted", "runs").select("row.*", "n_lines", "n_deleted", "runs")


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without later copies of repeated line runs, as digests of what is left."""
    out = deduplicate_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_deleted", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


#: From the definition: pairs of equal lines, their runs along diagonals, and lines of later runs.
OP6_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS line FROM docs),
w AS (SELECT *, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS n FROM raw),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i FROM w WHERE n > 0),
p AS (SELECT b.doc_id, b.i, b.n, a.doc_id AS d, b.i - a.i AS diagonal FROM l a JOIN l b ON a.s = b.s AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.i < b.i)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d, diagonal ORDER BY i) AS run FROM p),
t AS (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id, d, diagonal, run) AS total FROM g),
gone AS (SELECT DISTINCT doc_id, i FROM t WHERE total >= 10),
k AS (SELECT w.doc_id, w.line, w.s, gone.i IS NOT NULL AS deleted
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id AND w.line = l.line LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i),
o AS (SELECT doc_id, count(*) AS n_lines, CAST(sum(deleted::INT) AS BIGINT) AS n_deleted,
      coalesce(string_agg(s, chr(10) ORDER BY line) FILTER (WHERE NOT deleted), '') AS t FROM k GROUP BY doc_id)
SELECT doc_id, n_lines, n_deleted, length(t) AS n_chars, sha256(t) AS text_sha256 FROM o
"""
