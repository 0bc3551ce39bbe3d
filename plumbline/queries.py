"""Queries over the fixture bank and their DuckDB forms.

Each name has a function of (spark, sf_dir). SQL holds the equivalent DuckDB statement where the
result doesn't depend on iteration or a seeded generator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline import bank as banks
from plumbline.functions import text, vec
from plumbline.operators import drift, graph, knn, medoids, sampling, stability, windows
from plumbline.plans import analyses
from plumbline.sources import runs

FLAGSHIP = "novelty_centroid_topn"
QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Parameters that suit the fixtures: no fewer components than dimensions, windows of 25 rows.
DIM, K, SIZE, HOP, DEPTH = 64, 3, 25, 10, 10.0


def query(sql: str | None = None, views: str = ""):
    """Registers a function under its name, with SQL that follows the fixture's views."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = ("WITH RECURSIVE " + banks.FIXTURE_SQL + views + sql) if views is not None else sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def load(spark: SparkSession, sf_dir: str) -> banks.Bank:
    return banks.fixture(spark, sf_dir)


# scans, scalars and joins


@query("SELECT run_id, count(*) AS num_rows, max(len(v)) AS feat_dim, max(feat_idx) AS last_idx FROM bank GROUP BY run_id")
def bank_shape(spark, sf_dir):
    return banks.shape(load(spark, sf_dir).features)


@query("SELECT run_id, feat_idx // 64 AS chunk, min(feat_idx) AS idx_start, max(feat_idx) + 1 AS idx_end, count(*) AS n FROM bank GROUP BY 1, 2")
def feature_chunks(spark, sf_dir):
    return banks.chunks(load(spark, sf_dir).features, 64)


@query("SELECT run_id, feat_idx, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm FROM bank")
def vector_norms(spark, sf_dir):
    return load(spark, sf_dir).features.select("run_id", "feat_idx", F.round(vec.norm(F.col("features")), 6).alias("norm"))


UNIFORM = "SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY md5('42:' || feat_idx), feat_idx) AS r FROM lab"


@query(f"SELECT run_id, feat_idx, image_name FROM ({UNIFORM}) WHERE r <= 40")
def sample_uniform(spark, sf_dir):
    return sampling.uniform(load(spark, sf_dir).features, 40).select("run_id", "feat_idx", "image_name")


EVEN = """, size_ AS (SELECT run_id, count(*) AS n FROM bank GROUP BY run_id),
even AS (SELECT DISTINCT run_id, CASE WHEN i = 0 THEN 0 WHEN i = least(n, {k}) - 1 THEN n - 1 ELSE CAST(floor(i * ((n - 1)::DOUBLE / (least(n, {k}) - 1)::DOUBLE)) AS BIGINT) END AS feat_idx
         FROM size_, range(0, {k}) t(i) WHERE i < n)
"""


@query("SELECT run_id, feat_idx FROM even", EVEN.format(k=37))
def sample_even(spark, sf_dir):
    return sampling.even(load(spark, sf_dir).features, 37).select("run_id", "feat_idx")


@query("SELECT run_id, pred1_label, feat_idx FROM (SELECT *, row_number() OVER (PARTITION BY run_id, pred1_label ORDER BY feat_idx) AS r FROM lab) WHERE r <= 5")
def class_head_cap(spark, sf_dir):
    return sampling.head(load(spark, sf_dir).labelled(), 5, "run_id", "pred1_label").select("run_id", "pred1_label", "feat_idx")


@query("SELECT run_id, feat_idx FROM bank WHERE feat_idx < 30")
def run_head_cap(spark, sf_dir):
    return sampling.head(load(spark, sf_dir).features, 30, "run_id").select("run_id", "feat_idx")


@query("SELECT run_id, feat_idx, image_name, pred1_label, round(pred1_conf, 6) AS pred1_conf, pred2_label, round(pred2_conf, 6) AS pred2_conf FROM lab")
def align_predictions(spark, sf_dir):
    b = load(spark, sf_dir)
    out = banks.align(b.features, b.predictions)
    return rounded(out.select("run_id", "feat_idx", "image_name", "pred1_label", "pred1_conf", "pred2_label", "pred2_conf"), "pred1_conf", "pred2_conf")


@query("""SELECT b.run_id, b.feat_idx, b.image_name, p.pred1_label, 'base/' || b.run_id || '/' || replace(replace('output\\' || b.image_name, '\\', '/'), 'output/', '') AS path, 'contrastive' AS cfg_loss
FROM bank b LEFT JOIN pred p ON b.run_id = p.run_id AND b.image_name = p.image_name""")
def merged_run(spark, sf_dir):
    b = load(spark, sf_dir)
    configured = b.features.withColumns({"cfg_loss": F.lit("contrastive"), "image_name": F.concat(F.lit("output\\"), F.col("image_name"))})
    labels = b.predictions.withColumn("image_name", F.concat(F.lit("output\\"), F.col("image_name")))
    out = banks.merged(banks.Bank(configured, labels, b.metadata), F.concat(F.lit("base/"), F.col("run_id")))
    return out.select("run_id", "feat_idx", text.basename(F.col("image_name")).alias("image_name"), "pred1_label", "path", "cfg_loss")


@query("""SELECT run_id, o AS ord, feat_idx, image_name FROM bank JOIN (VALUES (0, 7), (1, 3), (2, 7), (3, 0)) t(o, i) ON feat_idx = i""")
def positional_lookup(spark, sf_dir):
    wanted = spark.createDataFrame([(0, 7), (1, 3), (2, 7), (3, 0)], "ord int, feat_idx long")
    return banks.lookup(load(spark, sf_dir).features, wanted).select("run_id", "ord", "feat_idx", "image_name")


@query("""SELECT run_id, image_name, depth, profile FROM (SELECT *, row_number() OVER (PARTITION BY run_id, image_name ORDER BY part DESC) AS r FROM (
SELECT run_id, image_name, depth, profile, 0 AS part FROM meta UNION ALL SELECT run_id, image_name, depth + 1, 'again', 1 FROM meta WHERE depth > 50)) WHERE r = 1""")
def metadata_dedupe_last(spark, sf_dir):
    m = load(spark, sf_dir).metadata
    both = m.withColumn("part", F.lit(0)).unionByName(m.where("depth > 50").select("run_id", "image_name", (F.col("depth") + 1).alias("depth"), F.lit("again").alias("profile"), F.lit(1).alias("part")))
    return runs.last_rows(both, "part").select("run_id", "image_name", "depth", "profile")


@query("SELECT b.run_id, b.feat_idx, m.depth, m.profile FROM bank b JOIN meta m ON b.run_id = m.run_id AND b.image_name = m.image_name WHERE m.depth IS NOT NULL")
def metadata_join(spark, sf_dir):
    b = load(spark, sf_dir)
    foldered = b.metadata.withColumn("image_name", F.concat(F.lit("a\\b/"), F.col("image_name")))
    return banks.with_metadata(b.features, foldered).where("depth is not null").select("run_id", "feat_idx", "depth", "profile")


@query(r"""SELECT page_id, regexp_extract(replace(url, '\', '/'), '[^/]*$') AS name, TRY_CAST(regexp_extract(replace(url, '\', '/'), '[^/]*$') AS DOUBLE) AS number FROM pages""", None)
def name_normalize(spark, sf_dir):
    name = text.basename(F.col("url"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", name.alias("name"), text.number(name).alias("number"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '_', 'g'), '[\x00-\x1F]', '_', 'g'), '[ \t]+', '_', 'g'), '_+', '_', 'g'), '^[._ ]+|[._ ]+$', '', 'g') AS s FROM pages)
SELECT page_id, CASE WHEN s = '' THEN 'unnamed' WHEN length(s) > 24 THEN regexp_replace(substr(s, 1, 24), '[._ ]+$', '') ELSE s END AS slug FROM a""", None)
def safe_slug(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.slug(F.col("url"), 24, ascii_only=True).alias("slug"))


# neighbours


NEAR = """, pair AS (SELECT a.run_id, a.feat_idx AS src, b.feat_idx AS dst, list_distance(a.v, b.v) AS dist FROM bank a JOIN bank b ON a.run_id = b.run_id),
near_all AS (SELECT *, row_number() OVER (PARTITION BY run_id, src ORDER BY dist, dst) AS rank FROM pair),
edge AS (SELECT run_id, src, dst, dist, row_number() OVER (PARTITION BY run_id, src ORDER BY dist, dst) AS rank FROM near_all WHERE rank <= 10 AND src <> dst QUALIFY row_number() OVER (PARTITION BY run_id, src ORDER BY dist, dst) <= 9)
"""


def run_sides(b: banks.Bank) -> DataFrame:
    return b.features.select("run_id", F.col("feat_idx").alias("id"), F.col("features").alias("v"))


@query("SELECT run_id, src, dst, round(dist, 6) AS dist, rank FROM edge", NEAR)
def knn_edges(spark, sf_dir):
    return rounded(knn.edges(run_sides(load(spark, sf_dir)), 10, "run_id").withColumn("rank", F.col("rank").cast("long")), "dist")


@query("SELECT e.run_id, e.src, e.dst FROM edge e JOIN edge f ON e.run_id = f.run_id AND e.src = f.dst AND e.dst = f.src", NEAR)
def mutual_edges(spark, sf_dir):
    return knn.edges(run_sides(load(spark, sf_dir)), 10, "run_id", mutual=True).select("run_id", "src", "dst")


PURITY = f""", smp AS (SELECT *, row_number() OVER (ORDER BY run_id, feat_idx) AS id FROM ({UNIFORM}) WHERE r <= 2000),
pr AS (SELECT a.id AS src, b.id AS dst, list_distance(a.v, b.v) AS dist, a.pred1_label = b.pred1_label AS same FROM smp a, smp b),
rk AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM pr QUALIFY rank <= 10),
sh AS (SELECT src, avg(same::INT) FILTER (WHERE rank <= 5) AS purity_5, avg(same::INT) AS purity_10, -avg(dist) FILTER (WHERE rank > 1) AS local_density FROM rk GROUP BY src),
ct AS (SELECT pred1_label, list(m ORDER BY i) AS c FROM (SELECT pred1_label, i, avg(v[i]) AS m FROM smp, dims GROUP BY ALL) GROUP BY pred1_label),
pt AS (SELECT run_id, image_name, s.pred1_label, pred1_conf, local_density, list_distance(v, c) AS centroid_dist, purity_5, purity_10 FROM smp s JOIN sh ON id = src JOIN ct ON s.pred1_label = ct.pred1_label)
"""
PURE = ("pred1_conf", "local_density", "centroid_dist", "purity_5", "purity_10")


def purity(spark, sf_dir):
    return analyses.purity(load(spark, sf_dir), pca_dim=DIM)


@query("SELECT run_id, image_name, pred1_label, " + ", ".join(f"round({c}, 6) AS {c}" for c in PURE) + " FROM pt", PURITY)
def purity_points(spark, sf_dir):
    return rounded(purity(spark, sf_dir)["points"], *PURE)


@query("SELECT run_id, " + ", ".join(f"round({f}({c}), 6) AS {c}_{s}" for c in PURE[1:] for f, s in (("avg", "mean"), ("stddev_samp", "std"))) + ", (SELECT round(corr(pred1_conf, local_density), 6) FROM pt) AS corr_conf_local_density_r, (SELECT round(corr(pred1_conf, -centroid_dist), 6) FROM pt) AS corr_conf_centroid_dist_r FROM pt GROUP BY run_id", PURITY)
def purity_per_run(spark, sf_dir):
    out = purity(spark, sf_dir)["per_run"].drop("corr_conf_local_density_p", "corr_conf_centroid_dist_p")  # outside SQL: conf_geometry_p_values
    return rounded(out, *[c for c in out.columns if c != "run_id"])


@query("SELECT count(*) AS n, round(corr(pred1_conf, local_density), 6) AS density_r, round(corr(pred1_conf, -centroid_dist), 6) AS centroid_r FROM pt", PURITY)
def conf_geometry_corr(spark, sf_dir):
    return rounded(purity(spark, sf_dir)["correlations"], "density_r", "centroid_r")


@query()
def conf_geometry_p_values(spark, sf_dir):
    r = purity(spark, sf_dir)["correlations"].first()  # one row
    return spark.createDataFrame([(r["n"], analyses.pearson_p(r["density_r"], r["n"]), analyses.pearson_p(r["centroid_r"], r["n"]))], "n long, density_p double, centroid_p double")


# class graph


GRAPH = """, mean_ AS (SELECT run_id, list(m ORDER BY i) AS c FROM (SELECT run_id, i, avg(v[i]) AS m FROM bank, dims GROUP BY run_id, i) GROUP BY run_id),
cen AS (SELECT l.*, list_transform(list_zip(l.v, m.c), lambda t: t[1] - t[2]) AS w FROM lab l JOIN mean_ m ON l.run_id = m.run_id),
uni AS (SELECT run_id, feat_idx AS id, image_name, pred1_label AS label, pred1_conf, list_transform(w, lambda x: x / greatest(sqrt(list_sum(list_transform(w, lambda y: y * y))), 1e-12)) AS v FROM cen),
"""
GLOBAL = """, tot AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(v[i]) AS m FROM bank, dims GROUP BY i)),
cen AS (SELECT l.*, list_transform(list_zip(l.v, m.c), lambda t: t[1] - t[2]) AS w FROM lab l, tot m),
uni AS (SELECT 'all' AS run_id, run_id AS run, row_number() OVER (ORDER BY run_id, feat_idx) - 1 AS id, image_name, pred1_label AS label, pred1_conf, list_transform(w, lambda x: x / greatest(sqrt(list_sum(list_transform(w, lambda y: y * y))), 1e-12)) AS v FROM cen),
"""
LINKS = """r1 AS (SELECT a.run_id, a.id AS src, b.id AS dst, list_distance(a.v, b.v) AS dist, a.label AS own, b.label AS near FROM uni a JOIN uni b ON a.run_id = b.run_id),
r2 AS (SELECT *, row_number() OVER (PARTITION BY run_id, src ORDER BY dist, dst) AS rank FROM r1 QUALIFY rank <= 10),
lk AS (SELECT * FROM r2 WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY run_id, src ORDER BY dist, dst) <= 9),
"""
MUTUAL = "le AS (SELECT a.* FROM lk a JOIN lk b ON a.run_id = b.run_id AND a.src = b.dst AND a.dst = b.src),\n"
ALL = "le AS (SELECT * FROM lk),\n"
METRICS = """cnt AS (SELECT run_id, src, near, count(*) AS c FROM le GROUP BY run_id, src, near),
shp AS (SELECT run_id, src, CAST(sum(c) AS BIGINT) AS k_effective, sum(-(c / n) * ln(c / n + 1e-12)) AS entropy, max(c) / sum(c) AS purity FROM (SELECT *, sum(c) OVER (PARTITION BY run_id, src) AS n FROM cnt) GROUP BY run_id, src),
nod AS (SELECT u.*, coalesce(k_effective, 0) AS k_effective, coalesce(entropy, 0.0) AS entropy, coalesce(purity, 0.0) AS purity FROM uni u LEFT JOIN shp s ON u.run_id = s.run_id AND u.id = s.src),
cls AS (SELECT DISTINCT run_id, label FROM uni),
cel AS (SELECT run_id, own, near, count(*) AS c FROM le GROUP BY ALL),
con AS (SELECT a.run_id, a.label, b.label AS near, coalesce(c, 0) AS c FROM cls a JOIN cls b ON a.run_id = b.run_id LEFT JOIN cel ON cel.run_id = a.run_id AND own = a.label AND cel.near = b.label)
"""


def graphs(spark, sf_dir, mutual: bool = False, whole: bool = False):
    f = analyses.class_graph_global if whole else analyses.class_graph
    return f(load(spark, sf_dir), pca_dim=DIM, mutual_only=mutual)


def graph_queries(name: str, mutual: bool, whole: bool) -> None:
    views = (GLOBAL if whole else GRAPH) + LINKS + (MUTUAL if mutual else ALL) + METRICS
    run = "run AS run_id" if whole else "run_id"
    key = "" if whole else "run_id, "

    def nodes(spark, sf_dir):
        out = graphs(spark, sf_dir, mutual, whole)["nodes"]
        return rounded(out.select("run_id", "id", "image_name", "label", "entropy", "purity", "k_effective", "mutual_only"), "entropy", "purity")

    def confusion(spark, sf_dir):
        return rounded(graphs(spark, sf_dir, mutual, whole)["confusion"], "share")

    def summary(spark, sf_dir):
        return rounded(graphs(spark, sf_dir, mutual, whole)["summary"], "mean_entropy", "mean_purity")

    for what, f, sql in (
        ("nodes", nodes, f"SELECT {run}, id, image_name, label, round(entropy, 6) AS entropy, round(purity, 6) AS purity, k_effective, {str(mutual).lower()} AS mutual_only FROM nod"),
        ("confusion", confusion, f"SELECT {key}label, near, round(coalesce(c / nullif(sum(c) OVER (PARTITION BY run_id, label), 0), 0.0), 6) AS share FROM con"),
        ("summary", summary, f"SELECT {key}label, count(*) AS n_nodes, round(avg(entropy), 6) AS mean_entropy, round(avg(purity), 6) AS mean_purity FROM nod GROUP BY ALL"),
    ):
        f.__name__ = f"{name}_{what}"
        query(sql, views)(f)


for _mutual in (False, True):
    for _whole in (False, True):
        graph_queries("class_graph" + "_global" * _whole + "_mutual" * _mutual, _mutual, _whole)


# novelty


NOVEL = GRAPH + """uni2 AS (SELECT u.*, l.pred2_label, l.pred2_conf FROM uni u JOIN lab l ON u.run_id = l.run_id AND u.id = l.feat_idx),
c1 AS (SELECT run_id, label, list(m ORDER BY i) AS c FROM (SELECT run_id, label, i, avg(v[i]) AS m FROM uni, dims GROUP BY run_id, label, i) GROUP BY run_id, label),
cd AS (SELECT u.*, 1 - greatest(-1, least(1, list_inner_product(u.v, c) / greatest(sqrt(list_inner_product(c, c)), 1e-12))) AS centroid_dist, 1 - greatest(0, least(1, pred1_conf - pred2_conf)) AS margin_penalty FROM uni2 u JOIN c1 ON u.run_id = c1.run_id AND u.label = c1.label),
kn AS (SELECT run_id, src, avg(dist) AS knn_mean FROM (SELECT a.run_id, a.id AS src, list_distance(a.v, b.v) AS dist FROM uni a JOIN uni b ON a.run_id = b.run_id AND b.id < {cap} QUALIFY row_number() OVER (PARTITION BY a.run_id, a.id ORDER BY dist, b.id) <= 10) GROUP BY run_id, src),
sc AS (SELECT cd.*, {knn} AS knn_mean, {w1} * centroid_dist + {w2} * {knn} + {w3} * margin_penalty AS score FROM cd JOIN kn ON cd.run_id = kn.run_id AND cd.id = kn.src),
top AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(score, 9) DESC, id) AS place FROM sc QUALIFY place <= 20)
"""
NOVEL_COLUMNS = ("pred1_conf", "pred2_conf", "centroid_dist", "knn_mean", "margin_penalty", "score")
NOVEL_SELECT = "SELECT run_id, id AS feat_idx, image_name, label AS pred1_label, pred2_label, " + ", ".join(f"round({c}, 6) AS {c}" for c in NOVEL_COLUMNS) + " FROM top"


@query(NOVEL_SELECT, NOVEL.format(cap=20000, knn="0.0", w1=0.7, w2=0.0, w3=0.3))
def novelty_centroid_topn(spark, sf_dir):
    return rounded(analyses.novelty(load(spark, sf_dir), top_n=20, pca_dim=DIM, w_centroid=0.7, w_density=0.0, w_margin=0.3), *NOVEL_COLUMNS)


@query(NOVEL_SELECT, NOVEL.format(cap=20000, knn="kn.knn_mean", w1=0.4, w2=0.4, w3=0.2))
def novelty_inbox(spark, sf_dir):
    return rounded(analyses.novelty(load(spark, sf_dir), top_n=20, pca_dim=DIM), *NOVEL_COLUMNS)


# windows and drift


WIN = """, nn AS (SELECT run_id, count(*) AS n FROM bank GROUP BY run_id),
cw AS (SELECT b.run_id, w AS step, (w * 10) || '-' || (w * 10 + 25) AS "window", b.feat_idx - w * 10 AS pos, b.feat_idx FROM bank b JOIN nn ON b.run_id = nn.run_id, range(0, 100000) t(w) WHERE w * 10 <= n - 25 AND w * 10 <= b.feat_idx AND b.feat_idx < w * 10 + 25),
lowest AS (SELECT run_id, min(depth) AS low FROM meta GROUP BY run_id),
dm AS (SELECT b.run_id, b.feat_idx, CAST(floor((depth - low) / CAST(10 AS DOUBLE)) AS BIGINT) AS bin, low FROM bank b JOIN meta m ON b.image_name = m.image_name JOIN lowest l ON l.run_id = b.run_id WHERE depth IS NOT NULL),
dw AS (SELECT run_id, dense_rank() OVER (PARTITION BY run_id ORDER BY bin) - 1 AS step, CAST(round(low + (bin + CAST(0.5 AS DOUBLE)) * CAST(10 AS DOUBLE), 6) AS VARCHAR) AS "window", row_number() OVER (PARTITION BY run_id, bin ORDER BY feat_idx) - 1 AS pos, feat_idx FROM dm),
pm AS (SELECT b.run_id, b.feat_idx, profile, min(b.feat_idx) OVER (PARTITION BY b.run_id, profile) AS first FROM bank b JOIN meta m ON b.image_name = m.image_name),
pw AS (SELECT run_id, dense_rank() OVER (PARTITION BY run_id ORDER BY first) - 1 AS step, coalesce(profile, 'None') AS "window", row_number() OVER (PARTITION BY run_id, first ORDER BY feat_idx) - 1 AS pos, feat_idx FROM pm)
"""
WINDOWS = {"count": "cw", "depth": "dw", "profile": "pw"}
#: Squared MMD in SQL: the median of pooled squared distances gives the kernel's width.
MMD = """, wn AS (SELECT w.run_id, w.step, w."window", w.feat_idx, b.v FROM {w} w JOIN bank b ON w.run_id = b.run_id AND w.feat_idx = b.feat_idx),
sd AS (SELECT run_id, step, 0 AS side, feat_idx, v FROM wn UNION ALL SELECT run_id, step - 1, 1, feat_idx, v FROM wn WHERE step > 0),
ok AS (SELECT run_id, step FROM sd GROUP BY ALL HAVING count(DISTINCT side) = 2),
dd AS (SELECT a.run_id, a.step, a.side AS s, b.side AS t, a.feat_idx AS i, b.feat_idx AS j, list_distance(a.v, b.v) ** 2 AS d2 FROM sd a JOIN sd b ON a.run_id = b.run_id AND a.step = b.step JOIN ok ON ok.run_id = a.run_id AND ok.step = a.step),
gm AS (SELECT run_id, step, 1 / (2 * greatest(median(d2), 1e-8)) AS g FROM dd WHERE s < t OR (s = t AND i < j) GROUP BY run_id, step),
ks AS (SELECT d.run_id, d.step, sum(exp(-g * d2)) FILTER (WHERE s = 0 AND t = 0 AND i <> j) AS xx, sum(exp(-g * d2)) FILTER (WHERE s = 1 AND t = 1 AND i <> j) AS yy, avg(exp(-g * d2)) FILTER (WHERE s = 0 AND t = 1) AS xy,
  count(DISTINCT i) FILTER (WHERE s = 0) AS n, count(DISTINCT i) FILTER (WHERE s = 1) AS m FROM dd d JOIN gm ON d.run_id = gm.run_id AND d.step = gm.step GROUP BY d.run_id, d.step),
nm AS (SELECT DISTINCT run_id, step, "window" FROM wn)
"""
MMD_SELECT = """SELECT k.run_id, k.step, a."window" AS window_from, b."window" AS window_to, round(greatest(0, coalesce(xx, 0) / (n * (n - 1) + 1e-8) + coalesce(yy, 0) / (m * (m - 1) + 1e-8) - 2 * xy), 6) AS mmd2
FROM ks k JOIN nm a ON a.run_id = k.run_id AND a.step = k.step JOIN nm b ON b.run_id = k.run_id AND b.step = k.step + 1"""


def drifts(spark, sf_dir, mode):
    return analyses.drift(load(spark, sf_dir), mode, SIZE, HOP, DEPTH, pca_dim=DIM, sample_per_window=1000)


def window_queries(mode: str) -> None:
    def rows(spark, sf_dir):
        return drifts(spark, sf_dir, mode)["windows"].select("run_id", "step", "window", "pos", "feat_idx")

    def series(spark, sf_dir):
        return rounded(drifts(spark, sf_dir, mode)["series"], "mmd2")

    rows.__name__, series.__name__ = f"{mode}_windows", f"drift_mmd_{mode}"
    query(f'SELECT run_id, step, "window", pos, feat_idx FROM {WINDOWS[mode]}', WIN)(rows)
    query(MMD_SELECT, WIN + MMD.format(w=WINDOWS[mode]))(series)


for _mode in WINDOWS:
    window_queries(_mode)


#: Ten evenly spaced rows of a window of 25.
TEN = "SELECT * FROM cw WHERE pos IN (SELECT CAST(CASE WHEN i = 9 THEN 24 ELSE floor(i * (CAST(24 AS DOUBLE) / CAST(9 AS DOUBLE))) END AS BIGINT) FROM range(0, 10) t(i))"


@query(MMD_SELECT, WIN + MMD.format(w=f"({TEN})"))
def drift_mmd_sampled(spark, sf_dir):
    return rounded(analyses.drift(load(spark, sf_dir), "count", SIZE, HOP, pca_dim=DIM, sample_per_window=10)["series"], "mmd2")


#: Change points of the series of squared MMD: sums as in CUSUM below, hits of a type 3 steps apart.
CHANGES = f""", se AS ({MMD_SELECT.replace("round(greatest(0, ", "(greatest(0, ").replace(", 6) AS mmd2", ") AS mmd2")}),
st AS (SELECT run_id, avg(mmd2) AS mu, CASE WHEN stddev_pop(mmd2) > 0 THEN stddev_pop(mmd2) ELSE 1 END AS sd FROM se GROUP BY run_id HAVING count(*) >= 5),
sr AS (SELECT e.run_id, row_number() OVER (PARTITION BY e.run_id ORDER BY step) - 1 AS i, mmd2 AS y, mmd2 - mu AS x, 0.25 * sd AS k, 0.75 * sd AS h FROM se e JOIN st ON e.run_id = st.run_id),
cs AS (
  SELECT run_id, i, y, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, false AS rise, false AS fall FROM sr WHERE i = 0
  UNION ALL
  SELECT run_id, i, y, CASE WHEN u > h THEN 0 ELSE u END, CASE WHEN d > h THEN 0 ELSE d END, u > h, d > h
  FROM (SELECT s.run_id, s.i, s.y, s.h, greatest(0, c.up + s.x - s.k) AS u, greatest(0, c.dn - s.x - s.k) AS d FROM cs c JOIN sr s ON s.run_id = c.run_id AND s.i = c.i + 1)),
nb AS (SELECT *, row_number() OVER (PARTITION BY run_id, type ORDER BY i) AS r FROM (SELECT run_id, i, 'up' AS type, y FROM cs WHERE rise UNION ALL SELECT run_id, i, 'down', y FROM cs WHERE fall)),
kp AS (
  SELECT run_id, type, r, i, y, i AS last, true AS kept FROM nb WHERE r = 1
  UNION ALL
  SELECT n.run_id, n.type, n.r, n.i, n.y, CASE WHEN n.i - k.last >= 3 THEN n.i ELSE k.last END, n.i - k.last >= 3 FROM kp k JOIN nb n ON n.run_id = k.run_id AND n.type = k.type AND n.r = k.r + 1)
"""


@query("SELECT run_id, CAST(i AS INT) AS \"index\", type, round(y, 6) AS value, 'count' AS mode FROM kp WHERE kept", WIN.replace("25", "10") + MMD.format(w="cw") + CHANGES)
def drift_change_points(spark, sf_dir):
    return rounded(analyses.drift(load(spark, sf_dir), "count", 10, HOP, pca_dim=DIM, k_std=0.25, h_std=0.75)["change_points"], "value")  # windows that share no rows


CUSUM = r"""
WITH RECURSIVE st AS (SELECT user_id, avg(value) AS mu, CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1 END AS sd, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 5),
sr AS (SELECT e.user_id, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) - 1 AS i, value AS y, value - mu AS x, 0.5 * sd AS k, 1.5 * sd AS h FROM events e JOIN st ON e.user_id = st.user_id),
cs AS (
  SELECT user_id, i, y, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, false AS rise, false AS fall FROM sr WHERE i = 0
  UNION ALL
  SELECT user_id, i, y, CASE WHEN u > h THEN 0 ELSE u END, CASE WHEN d > h THEN 0 ELSE d END, u > h, d > h
  FROM (SELECT s.user_id, s.i, s.y, s.h, greatest(0, c.up + s.x - s.k) AS u, greatest(0, c.dn - s.x - s.k) AS d FROM cs c JOIN sr s ON s.user_id = c.user_id AND s.i = c.i + 1)),
ht AS (SELECT user_id, i, 'up' AS type, y FROM cs WHERE rise UNION ALL SELECT user_id, i, 'down', y FROM cs WHERE fall)
"""
CUSUM_SELECT = "SELECT user_id, CAST(i AS INT) AS \"index\", type, round(y, 6) AS value FROM ht"
SPACED = CUSUM + r""", nb AS (SELECT *, row_number() OVER (PARTITION BY user_id, type ORDER BY i) AS r FROM ht),
kp AS (
  SELECT user_id, type, r, i, y, i AS last, true AS kept FROM nb WHERE r = 1
  UNION ALL
  SELECT n.user_id, n.type, n.r, n.i, n.y, CASE WHEN n.i - k.last >= 8 THEN n.i ELSE k.last END, n.i - k.last >= 8 FROM kp k JOIN nb n ON n.user_id = k.user_id AND n.type = k.type AND n.r = k.r + 1)
SELECT user_id, CAST(i AS INT) AS "index", type, round(y, 6) AS value FROM kp WHERE kept"""


def hits(spark, sf_dir, gap):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.struct("ts", "event_id").alias("at"), "value")
    return rounded(drift.change_points(rows, "user_id", "at", "value", 0.5, 1.5, gap), "value")


@query(CUSUM + CUSUM_SELECT, None)
def cusum_changepoints(spark, sf_dir):
    return hits(spark, sf_dir, 0)


@query(SPACED, None)
def cusum_deduped(spark, sf_dir):
    return hits(spark, sf_dir, 8)


# prototypes


PROTO = """, pg AS (SELECT run_id, feat_idx, image_name, pred1_label AS grp, v, row_number() OVER (PARTITION BY run_id, pred1_label ORDER BY feat_idx) - 1 AS medoid_rank FROM lab),
md AS MATERIALIZED (SELECT run_id, grp, medoid_rank, v AS m, feat_idx FROM pg WHERE medoid_rank < 3),
ad AS (SELECT p.run_id, p.grp, p.feat_idx, m.medoid_rank, round(1 - greatest(-1, least(1, list_inner_product(p.v, m.m) / ((sqrt(list_inner_product(p.v, p.v)) + 1e-12) * (sqrt(list_inner_product(m.m, m.m)) + 1e-12)))), 12) AS dist FROM pg p JOIN md m ON p.run_id = m.run_id AND p.grp = m.grp),
asg AS (SELECT * FROM ad QUALIFY row_number() OVER (PARTITION BY run_id, grp, feat_idx ORDER BY dist, medoid_rank) = 1),
cov AS (SELECT run_id, grp, medoid_rank, count(*) AS c FROM asg GROUP BY ALL)
"""


def fixed(spark, sf_dir):
    """Rows by class, and the first K of each as stand-ins for medoids."""
    rows = load(spark, sf_dir).labelled().select("run_id", "feat_idx", "image_name", F.col("pred1_label").alias("group"), F.col("features").alias("v"))
    w = Window.partitionBy("run_id", "group").orderBy("feat_idx")
    chosen = rows.withColumn("medoid_rank", F.row_number().over(w).cast("long") - 1).where(F.col("medoid_rank") < K)
    return rows, chosen.select("run_id", "group", "medoid_rank", F.col("v").alias("m"), "feat_idx", "image_name")


@query('SELECT run_id, grp AS "group", feat_idx, medoid_rank, round(dist, 6) AS dist FROM asg', PROTO)
def medoid_assign(spark, sf_dir):
    rows, chosen = fixed(spark, sf_dir)
    return rounded(medoids.assign(rows, chosen), "dist")


@query("""SELECT run_id, grp AS "group", medoid_rank, feat_idx FROM (
SELECT a.run_id, a.grp, a.medoid_rank, a.feat_idx, round(sum(1 - greatest(-1, least(1, list_inner_product(p.v, q.v) / ((sqrt(list_inner_product(p.v, p.v)) + 1e-12) * (sqrt(list_inner_product(q.v, q.v)) + 1e-12))))), 9) AS total
FROM asg a JOIN pg p ON a.run_id = p.run_id AND a.feat_idx = p.feat_idx JOIN asg b ON a.run_id = b.run_id AND a.grp = b.grp AND a.medoid_rank = b.medoid_rank JOIN pg q ON b.run_id = q.run_id AND b.feat_idx = q.feat_idx
GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY run_id, grp, medoid_rank ORDER BY total, feat_idx) = 1""", PROTO)
def medoid_update_step(spark, sf_dir):
    rows, chosen = fixed(spark, sf_dir)
    return medoids.update(rows, medoids.assign(rows, chosen))


COVER = ("entropy", "entropy_norm", "gini", "mean_within", "median_within")


@query("""SELECT w.run_id, w.grp AS "group", w.count, round(entropy, 6) AS entropy, round(entropy / (ln(3) + 1e-12), 6) AS entropy_norm, round(gini, 6) AS gini, round(mean_within, 6) AS mean_within, round(median_within, 6) AS median_within, c0, c1, c2
FROM (SELECT run_id, grp, count(*) AS count, avg(dist) AS mean_within, median(dist) AS median_within FROM asg GROUP BY ALL) w
JOIN (SELECT run_id, grp, sum(-p * ln(p + 1e-12)) AS entropy, 1 - sum(p * p) AS gini, CAST(coalesce(sum(c) FILTER (WHERE medoid_rank = 0), 0) AS BIGINT) AS c0, CAST(coalesce(sum(c) FILTER (WHERE medoid_rank = 1), 0) AS BIGINT) AS c1, CAST(coalesce(sum(c) FILTER (WHERE medoid_rank = 2), 0) AS BIGINT) AS c2
      FROM (SELECT *, c / sum(c) OVER (PARTITION BY run_id, grp) AS p FROM cov) GROUP BY ALL) s ON w.run_id = s.run_id AND w.grp = s.grp""", PROTO)
def coverage_metrics(spark, sf_dir):
    rows, chosen = fixed(spark, sf_dir)
    out = rounded(medoids.coverage(medoids.assign(rows, chosen), K), *COVER)
    return out.select("run_id", "group", "count", *COVER, *[F.get("medoid_counts", F.lit(i)).alias(f"c{i}") for i in range(K)])


def clustered(spark, sf_dir):
    return analyses.prototypes(load(spark, sf_dir), k=K, pca_dim=DIM, min_points_for_group=5)


@query()
def k_medoids(spark, sf_dir):
    return rounded(clustered(spark, sf_dir)["assigned"], "dist")


@query()
def prototypes(spark, sf_dir):
    return clustered(spark, sf_dir)["prototypes"]


@query()
def prototype_coverage(spark, sf_dir):
    return rounded(clustered(spark, sf_dir)["coverage"], *COVER)


# stability


STABLE = PROTO + """, mm AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(md.m[i]) AS m FROM md, dims GROUP BY i)),
mz AS (SELECT run_id, grp, medoid_rank, list_transform(list_zip(m, c), lambda t: t[1] - t[2]) AS w FROM md, mm),
mu AS (SELECT run_id, grp, medoid_rank, list_transform(w, lambda x: x / greatest(sqrt(list_sum(list_transform(w, lambda y: y * y))), 1e-12)) AS z FROM mz),
mc AS (SELECT run_id, grp, list(x ORDER BY i) AS w, max(k) AS k FROM (SELECT run_id, grp, i, avg(z[i]) AS x, count(*) AS k FROM mu, dims GROUP BY run_id, grp, i) GROUP BY run_id, grp),
mcu AS (SELECT run_id, grp, k, list_transform(w, lambda x: x / greatest(sqrt(list_sum(list_transform(w, lambda y: y * y))), 1e-12)) AS c FROM mc),
xd AS (SELECT a.grp, a.run_id AS ri, b.run_id AS rj, a.medoid_rank AS i, b.medoid_rank AS j, 1 - greatest(-1, least(1, list_inner_product(a.z, b.z))) AS d FROM mu a JOIN mu b ON a.grp = b.grp AND a.run_id < b.run_id),
ha AS (SELECT grp, ri, rj, avg(d) AS h FROM (SELECT grp, ri, rj, i, min(d) AS d FROM xd GROUP BY ALL) GROUP BY ALL),
hb AS (SELECT grp, ri, rj, avg(d) AS h FROM (SELECT grp, ri, rj, j, min(d) AS d FROM xd GROUP BY ALL) GROUP BY ALL),
cv AS (SELECT r.run_id, r.grp, k AS medoid_rank, coalesce(c, 0) / (sum(coalesce(c, 0)) OVER (PARTITION BY r.run_id, r.grp) + 1e-12) AS p FROM (SELECT DISTINCT run_id, grp FROM cov) r CROSS JOIN range(0, 3) t(k) LEFT JOIN cov ON cov.run_id = r.run_id AND cov.grp = r.grp AND cov.medoid_rank = k),
js AS (SELECT a.grp, a.run_id AS ri, b.run_id AS rj, 0.5 * sum(CASE WHEN a.p > 0 THEN a.p * (ln(a.p + 1e-12) - ln((a.p + b.p) / 2 + 1e-12)) ELSE 0 END) + 0.5 * sum(CASE WHEN b.p > 0 THEN b.p * (ln(b.p + 1e-12) - ln((a.p + b.p) / 2 + 1e-12)) ELSE 0 END) AS v
       FROM cv a JOIN cv b ON a.grp = b.grp AND a.medoid_rank = b.medoid_rank AND a.run_id < b.run_id GROUP BY a.grp, a.run_id, b.run_id),
pp AS (SELECT a.grp AS class, a.run_id AS run_i, b.run_id AS run_j, a.k AS k_i, b.k AS k_j, 1 - greatest(-1, least(1, list_inner_product(a.c, b.c))) AS centroid_dist, (ha.h + hb.h) / 2 AS mean_hausdorff, js.v AS js_divergence
  FROM mcu a JOIN mcu b ON a.grp = b.grp AND a.run_id < b.run_id JOIN ha ON ha.grp = a.grp AND ha.ri = a.run_id AND ha.rj = b.run_id JOIN hb ON hb.grp = a.grp AND hb.ri = a.run_id AND hb.rj = b.run_id JOIN js ON js.grp = a.grp AND js.ri = a.run_id AND js.rj = b.run_id)
"""
PAIRS = ("centroid_dist", "mean_hausdorff", "js_divergence")


def stable(spark, sf_dir):
    rows, chosen = fixed(spark, sf_dir)
    protos = chosen.select("run_id", "group", "medoid_rank", F.col("feat_idx").alias("medoid_global_idx"), F.col("image_name").alias("medoid_name"))
    cover = medoids.coverage(medoids.assign(rows, chosen), K)
    return load(spark, sf_dir), protos, cover


@query("SELECT class, run_i, run_j, k_i, k_j, " + ", ".join(f"round({c}, 6) AS {c}" for c in PAIRS) + " FROM pp", STABLE)
def proto_pairs(spark, sf_dir):
    return rounded(analyses.prototype_stability(*stable(spark, sf_dir), pca_dim=DIM)["pairs"], *PAIRS)


@query("SELECT class, run_i AS run_id FROM pp UNION SELECT class, run_j FROM pp", STABLE)
def proto_runs(spark, sf_dir):
    return analyses.prototype_stability(*stable(spark, sf_dir), pca_dim=DIM)["runs"]


@query("""SELECT class, count(*) AS n_pairs, round(avg(centroid_dist), 6) AS mean_centroid_dist, round(median(centroid_dist), 6) AS median_centroid_dist, round(avg(mean_hausdorff), 6) AS mean_hausdorff,
round(median(mean_hausdorff), 6) AS median_hausdorff, round(avg(js_divergence), 6) AS mean_js FROM pp GROUP BY class""", STABLE)
def proto_class_summary(spark, sf_dir):
    out = analyses.prototype_stability(*stable(spark, sf_dir), pca_dim=DIM)["class_summary"]
    return rounded(out, *[c for c in out.columns if c not in ("class", "n_pairs")])


@query("""SELECT b.class, n_runs, n_prototypes, round(CASE WHEN n_prototypes >= 3 THEN mean_to_centroid END, 6) AS mean_to_centroid, round(CASE WHEN n_prototypes >= 3 THEN variance END, 6) AS variance,
round(CASE WHEN n_prototypes >= 3 AND n_runs >= 2 AND n_runs < n_prototypes THEN s END, 6) AS silhouette_by_run
FROM (SELECT grp AS class, count(DISTINCT run_id) AS n_runs, count(*) AS n_prototypes FROM mu GROUP BY grp) b
JOIN (SELECT m.grp AS class, avg(1 - greatest(-1, least(1, list_inner_product(z, c)))) AS mean_to_centroid FROM mu m JOIN gcu ON gcu.grp = m.grp GROUP BY m.grp) t ON t.class = b.class
JOIN (SELECT grp AS class, avg(v) AS variance FROM (SELECT grp, i, var_pop(z[i]) AS v FROM mu, dims GROUP BY grp, i) GROUP BY grp) v ON v.class = b.class
LEFT JOIN (SELECT class, avg(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END) AS s FROM sl GROUP BY class) s ON s.class = b.class""", STABLE + """,
gc AS (SELECT grp, list(x ORDER BY i) AS w FROM (SELECT grp, i, avg(z[i]) AS x FROM mu, dims GROUP BY grp, i) GROUP BY grp),
gcu AS (SELECT grp, list_transform(w, lambda x: x / greatest(sqrt(list_sum(list_transform(w, lambda y: y * y))), 1e-12)) AS c FROM gc),
sdist AS (SELECT a.grp AS class, a.run_id AS r, a.medoid_rank AS i, b.run_id AS s, avg(list_distance(a.z, b.z)) AS d FROM mu a JOIN mu b ON a.grp = b.grp AND (a.run_id <> b.run_id OR a.medoid_rank <> b.medoid_rank) GROUP BY ALL),
sl AS (SELECT class, r, i, max(d) FILTER (WHERE r = s) AS a, min(d) FILTER (WHERE r <> s) AS b FROM sdist GROUP BY ALL)
""")
def proto_global_summary(spark, sf_dir):
    b, protos, _ = stable(spark, sf_dir)
    return rounded(analyses.prototype_global_stability(b, protos, DIM), "mean_to_centroid", "variance", "silhouette_by_run")


# geometry, maps, manifests


@query(f"SELECT run_id, count(*) AS sampled, round(avg(sqrt(list_inner_product(v, v))), 6) AS mean_norm, round(stddev_pop(sqrt(list_inner_product(v, v))), 6) AS std_norm FROM ({UNIFORM}) WHERE r <= 2000 GROUP BY run_id")
def geometry_norms(spark, sf_dir):
    return analyses.geometry(load(spark, sf_dir)).select("run_id", "sampled", "mean_norm", "std_norm")


@query()
def geometry_summary(spark, sf_dir):
    return analyses.geometry(load(spark, sf_dir), 2000)


@query()
def intrinsic_dim(spark, sf_dir):
    return analyses.intrinsic(sampling.uniform(load(spark, sf_dir).features, 2000))


@query()
def pca_project(spark, sf_dir):
    b = load(spark, sf_dir)
    out = analyses.projected(b.features, sampling.even(b.features, 2000), 8)
    return out.select("run_id", "feat_idx", F.transform("features", lambda x: F.round(x, 5)).alias("features"))


@query()
def novelty_inbox_pca(spark, sf_dir):
    return rounded(analyses.novelty(load(spark, sf_dir), top_n=20, pca_dim=16), *NOVEL_COLUMNS, digits=5)


@query()
def tsne_map(spark, sf_dir):
    out = analyses.tsne(load(spark, sf_dir), pca_dim=16)
    return rounded(out, "x", "y", digits=3)


PLACE = """CAST(p // 8 AS BIGINT) AS "row", p % 8 AS "column", 12 + (p % 8) * 268 AS x, 52 + (p // 8) * {tall} AS y, CAST(2156 AS BIGINT) AS sheet_width, CAST(52 + ceil(n / 8.0) * {tall} AS BIGINT) AS sheet_height"""


@query("""SELECT run_id, "group", image_name, caption, """ + PLACE.format(tall=292) + """ FROM (
SELECT run_id, pred1_label AS "group", image_name, row_number() OVER (PARTITION BY run_id, pred1_label ORDER BY feat_idx) - 1 AS p, count(*) OVER (PARTITION BY run_id, pred1_label) AS n,
CASE WHEN length(pred1_label || ' medoid of ' || run_id || ' ' || image_name) > 28 THEN substr(pred1_label || ' medoid of ' || run_id || ' ' || image_name, 1, 25) || '…' ELSE pred1_label || ' medoid of ' || run_id || ' ' || image_name END AS caption FROM lab)""")
def montage_manifest(spark, sf_dir):
    caption = F.concat("pred1_label", F.lit(" medoid of "), "run_id", F.lit(" "), "image_name")
    items = load(spark, sf_dir).labelled().select("run_id", F.col("pred1_label").alias("group"), "feat_idx", "image_name", text.shortened(caption, 28, 25).alias("caption"))
    out = analyses.contact_sheet(items, ["run_id", "group"], ["feat_idx"])
    return out.select("run_id", "group", "image_name", "caption", "row", "column", "x", "y", "sheet_width", "sheet_height")


@query("SELECT run_id, image_name, caption, " + PLACE.format(tall=296) + """ FROM (SELECT run_id, image_name, place - 1 AS p, count(*) OVER (PARTITION BY run_id) AS n,
printf('#%d s=%.2f %s (%.2f-%.2f)', place, score, label, pred1_conf, pred2_conf) AS caption FROM top)""", NOVEL.format(cap=20000, knn="kn.knn_mean", w1=0.4, w2=0.4, w3=0.2))
def novelty_manifest(spark, sf_dir):
    return analyses.novelty_sheets(analyses.novelty(load(spark, sf_dir), top_n=20, pca_dim=DIM), 20)
