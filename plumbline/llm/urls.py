"""URL filters: listed rules first, association rules of URL tokens for the rest.

The listed rules label the URLs that they fit. FP-growth mines token combinations of labelled URLs
together with their verdicts; rules are pruned by confidence and support, and a rule goes if one
with fewer tokens and no less confidence says the same. A URL is matched through an inverted
index: a rule is listed under its rarest token alone, and its other tokens are looked up in the
URL's token set. URLs with equal sets of indexed tokens are matched once.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import _runtime as R

#: (verdict, host and path prefix).
LISTED = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
)
#: Least share of labelled URLs that a rule holds for, and least number: below that every URL's
#: token set is itself frequent and there are as many combinations as subsets.
SUPPORT, LEAST, CONFIDENCE = 0.004, 8, 0.9
VERDICT = "verdict="


def lower(text: Column) -> Column:
    """A-Z as a-z, other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Scheme, host and path of a URL; empty where there is no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.when(at > 0, lower(F.substring(url, F.lit(1), at - 1))).otherwise(F.lit("")), lower(host), path


def listed(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + rest))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def tokens(scheme: Column, host: Column, path: Column, url: Column) -> Column:
    """The distinct tokens of a URL, in order; none of an empty host."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != "")
    found = F.concat(
        F.array(F.concat(F.lit("scheme="), scheme), F.concat(F.lit("top="), F.element_at(labels, -1)), F.concat(F.lit("depth="), F.size(segments).cast("string"))),
        F.when(n > 1, F.array(F.concat(F.lit("site="), F.element_at(labels, -2), F.lit("."), F.element_at(labels, -1)))).otherwise(F.array().cast("array<string>")),
        F.when(n > 2, F.transform(F.slice(labels, 1, F.greatest(n - 2, F.lit(1))), lambda x: F.concat(F.lit("label="), x))).otherwise(F.array().cast("array<string>")),
        F.transform(F.slice(segments, 1, 1), lambda x: F.concat(F.lit("first="), x)),
        F.transform(F.slice(segments, 2, 1), lambda x: F.concat(F.lit("second^"), F.substring(x, 1, 1))),
        F.transform(F.slice(segments, 2, F.greatest(F.size(segments), F.lit(1))), lambda x, i: F.concat(F.lit("part"), (i + 2).cast("string"), F.lit("="), x)),
        F.transform(query, lambda x: F.concat(F.lit("key="), F.split(x, "=")[0])),
        F.transform(F.filter(query, lambda x: F.contains(x, F.lit("="))), lambda x: F.concat(F.lit("query="), x)),
        F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(found)))


def parsed(pages: DataFrame, rules=LISTED) -> DataFrame:
    """(page_id, host, path, rule, listed, tokens) of each page."""
    url = F.coalesce(F.col("url"), F.lit(""))
    scheme, host, path = parts(url)
    rows = pages.select("page_id", url.alias("url"), scheme.alias("scheme"), host.alias("host"), path.alias("path"))
    name, verdict = listed(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("listed"), tokens(F.col("scheme"), F.col("host"), F.col("path"), F.col("url")).alias("tokens"))


def mine(rows: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Association rules of ``rows`` (tokens, verdict): id, tokens, says, confidence, support.

    Tokens below the support can be in no rule, so they are left out before sets are built.
    """
    known = rows.where("verdict is not null").select("tokens", "verdict")
    n = known.count()
    empty = rows.sparkSession.createDataFrame([], "id long, tokens array<string>, says string, confidence double, support double")
    if not n:
        return empty
    support = max(support, LEAST / n)
    if support > 1:
        return empty
    keyed = known.withColumn("row", F.monotonically_increasing_id())
    keyed = R.written(keyed, "labelled")
    listed = keyed.select("row", F.explode(F.array_distinct("tokens")).alias("token"))
    # tokens of the same rows stand for each other: one of them is mined, and rules are spelt out for all
    alike = listed.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("h"), F.bit_xor(F.xxhash64(F.lit("again"), "row")).alias("g"))
    alike = alike.where(F.col("n") >= support * n).groupBy("n", "h", "g").agg(F.array_sort(F.collect_list("token")).alias("members"))
    alike = R.written(alike.select(F.col("members")[0].alias("token"), "members"), "alike")
    items = listed.join(alike, "token").groupBy("row").agg(F.array_sort(F.collect_list("token")).alias("items"))
    items = keyed.join(items, "row").select(F.concat(F.col("items"), F.array(F.concat(F.lit(VERDICT), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    says = F.col("consequent")[0]
    found = model.associationRules.where(F.startswith(says, F.lit(VERDICT)) & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit(VERDICT))))
    found = R.written(found.select(F.array_sort("antecedent").alias("tokens"), F.substring(says, len(VERDICT) + 1, 99).alias("says"), F.round("confidence", 9).alias("confidence"), F.round("support", 9).alias("support")), "rules")
    # a rule goes if one that is kept has some of its tokens alone: shorter rules first, and each is looked up by its first token
    lengths = sorted(r["k"] for r in found.select(F.size("tokens").alias("k")).distinct().collect())
    kept = found.where("false")
    for k in lengths:
        here = found.where(F.size("tokens") == k)
        short = kept.select(F.col("tokens")[0].alias("token"), F.col("tokens").alias("fewer"), F.col("says").alias("also"), F.col("confidence").alias("sure"))
        pairs = here.select(F.explode("tokens").alias("token"), "tokens", "says", "confidence").join(short, "token")
        worse = pairs.where((F.col("says") == F.col("also")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("fewer", "tokens")) == 0)).select("tokens", "says").distinct()
        kept = R.written(kept.unionByName(here.join(worse, ["tokens", "says"], "left_anti")), "kept")
    spelt = kept.select("*", F.explode("tokens").alias("token")).join(alike, "token").groupBy("tokens", "says", "confidence", "support").agg(F.collect_list("members").alias("choices"))
    none = F.array(F.array().cast("array<string>"))
    every = F.aggregate("choices", none, lambda sets, m: F.flatten(F.transform(sets, lambda a: F.transform(m, lambda x: F.concat(a, F.array(x))))))
    kept = spelt.select(F.explode(every).alias("tokens"), "says", "confidence", "support").withColumn("tokens", F.array_sort("tokens"))
    return R.written(kept.select(F.xxhash64("tokens", "says").alias("id"), "tokens", "says", "confidence", "support"), "rules")


def match(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(set, says, mined) for each distinct set of indexed tokens among ``rows`` (set): the surest
    fitting rule, then that of most support, fewest tokens, least id."""
    postings = rules.withColumn("token", F.explode("tokens"))
    share = postings.groupBy("token").agg(F.max("support").alias("common"))
    first = Window.partitionBy("id").orderBy("common", "token")
    postings = postings.join(share, "token").withColumn("n", F.row_number().over(first)).where("n = 1").select("token", "id", F.col("tokens").alias("needed"), "says", "confidence", "support")
    sets = rows.select("set").distinct()
    hits = sets.select("set", F.explode("set").alias("token")).join(postings, "token").where(F.size(F.array_except("needed", "set")) == 0)
    rank = F.struct("confidence", "support", (-F.size("needed")).alias("short"), (-F.col("id")).alias("least"))
    return hits.groupBy("set").agg(F.max_by("says", rank).alias("says"), F.max_by("needed", rank).alias("mined"))


def judge(pages: DataFrame, rules=LISTED, default: str = "allow", support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """A row per row of ``pages``: page_id, host, path, rule, verdict, mined.

    ``rule`` is the longest listed rule that fits (null if none) and gives the verdict; else the
    surest mined rule does (its tokens are ``mined``); else the verdict is ``default``. A null URL,
    or one without ``://``, has an empty host and path and no tokens. Repeated pages are each
    judged, and each counts in mining. An empty table mines no rules. Other columns are ignored.
    """
    rows = R.written(parsed(pages, rules), "pages")
    found = mine(rows.select("tokens", F.col("listed").alias("verdict")), support, confidence)
    words = found.select(F.explode("tokens").alias("token")).distinct()
    if found.limit(1).count() == 0:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("listed", F.lit(default)).alias("verdict"), F.lit(None).cast("array<string>").alias("mined"))
    # token sets first, so that each distinct set looks up the vocabulary and the index once
    sets = rows.select("tokens").distinct()
    known = sets.select("tokens", F.explode("tokens").alias("token")).join(words, "token").groupBy("tokens").agg(F.array_sort(F.collect_set("token")).alias("set"))
    known = R.written(known, "sets")
    verdicts = known.join(match(known, found), "set").select(F.col("tokens"), "says", "mined")
    out = rows.join(R.written(verdicts, "verdicts"), "tokens", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", "says", F.lit(default)).alias("verdict"), "mined")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all pages."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
