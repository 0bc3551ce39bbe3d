import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.bank import align, fixture, unique
from plumbline.functions import text, vec
from plumbline.operators import drift, graph, knn, medoids, pca, sampling, stability, tsne, windows
from plumbline.plans import analyses


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(values):
    return F.array(*[F.lit(float(v)) for v in values])


@pytest.mark.parametrize(("n", "k"), [(8001, 999), (10, 3), (5, 9), (7, 1), (0, 3), (1, 1), (2, 2)])
def test_even_positions(spark, n, k):
    want = [] if n == 0 else np.linspace(0, n - 1, num=min(k, n), dtype=np.int64).tolist()
    assert one(spark, sampling.even_positions(F.lit(n).cast("long"), k)) == want


def test_budget():
    assert (sampling.budget(20000, 4000, 4), sampling.budget(20000, 4000, 10), sampling.budget(3, 9, 5)) == (4000, 2000, 1)


def test_vectors(spark):
    assert one(spark, vec.unit(lit([0, 0]))) == [0, 0]
    assert one(spark, vec.cosine_distance(lit([0, 0]), lit([1, 0]))) == 1
    assert one(spark, vec.squared_l2(lit([1, 2]), lit([4, 6]))) == 25
    with pytest.raises(ValueError, match="unknown metric"):
        vec.metric("manhattan")


@pytest.mark.parametrize(("name", "want"), [(None, "unnamed"), ("CON", "_CON"), ("a<b>:c", "a_b_c"), ("  x..", "x"), ("y" * 200, "y" * 120), ("ﬁne  name", "fine_name"), ("con.txt", "con.txt")])
def test_slug(spark, name, want):
    assert one(spark, text.slug(F.lit(name).cast("string"))) == want


def test_names(spark):
    assert one(spark, text.basename(F.lit("a\\b/c.png"))) == "c.png"
    assert one(spark, text.resolved(F.lit("base"), F.lit("output\\x/output/y.bmp"))) == "base/x/y.bmp"
    assert one(spark, text.number(F.lit("x"))) is None
    assert one(spark, text.shortened(F.lit("z" * 30), 28, 25)) == "z" * 25 + "…"


def rows(spark, points, key="r"):
    return spark.createDataFrame([(key, i, [float(x) for x in p]) for i, p in enumerate(points)], "run_id string, id long, v array<double>")


def test_knn_blocks_agree(spark):
    points = np.random.default_rng(0).normal(size=(60, 5))
    df = rows(spark, points)
    whole, dealt = (sorted((r.src, r.dst, r["rank"], round(r.dist, 9)) for r in knn.knn(df, df, 4, "run_id", block=b).collect()) for b in (1000, 7))
    assert whole == dealt
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    assert {(s, t) for s, t, _, _ in whole} == {(i, int(j)) for i in range(60) for j in np.argsort(d[i])[:4]}


def test_graph_of_equal_vectors_and_no_edges(spark):
    df = rows(spark, [[0, 0]] * 4)
    links = knn.edges(df, 3, "run_id").collect()
    assert all(r.src != r.dst for r in links)
    assert {s: sum(r.src == s for r in links) for s in range(4)} == dict.fromkeys(range(4), 2)
    nodes = spark.createDataFrame([("r", 0, "a"), ("r", 1, "b")], "run_id string, id long, label string")
    none = spark.createDataFrame([], "run_id string, src long, dst long")
    assert [(r.k_effective, r.entropy, r.purity) for r in graph.node_metrics(nodes, none).collect()] == [(0, 0, 0)] * 2
    assert {(r.label, r.near): r.share for r in graph.confusion(nodes, none).collect()} == {(a, b): 0 for a in "ab" for b in "ab"}


def captured(spark, depths, profiles=None):
    return spark.createDataFrame([("r", i, d, p) for i, (d, p) in enumerate(zip(depths, profiles or [None] * len(depths), strict=True))], "run_id string, feat_idx long, depth double, profile string")


@pytest.mark.parametrize(("n", "size", "hop", "want"), [(3, 5, 1, 0), (5, 1, 1, 0), (5, 5, 2, 1), (10, 4, 3, 3)])
def test_count_windows(spark, n, size, hop, want):
    out = windows.by_count(captured(spark, [0.0] * n), size, hop)
    assert out.select("step").distinct().count() == want
    assert out.count() == want * size


def test_depth_and_profile_windows(spark):
    out = windows.by_depth(captured(spark, [100.0, 104.0, 107.0, 110.0, None]), 5.0).orderBy("feat_idx").collect()
    assert [(r.step, r.window) for r in out] == [(0, "102.5"), (0, "102.5"), (1, "107.5"), (2, "112.5")]
    out = windows.by_profile(captured(spark, [0.0] * 5, ["b", None, "a", None, "b"])).orderBy("feat_idx").collect()
    assert [(r.step, r.window, r.pos) for r in out] == [(0, "b", 0), (1, "None", 0), (2, "a", 0), (1, "None", 1), (0, "b", 1)]
    assert windows.sampled(windows.by_count(captured(spark, [0.0] * 10), 10, 1), 3).count() == 3


def cusum_of(xs, k, h):
    up = down = 0.0
    out = []
    for i, x in enumerate(xs):
        if i == 0:
            continue
        up, down = (max(0.0, s) if s == s else 0.0 for s in (up + x - k, down - x - k))
        if up > h:
            out.append((i, "up"))
            up = 0.0
        if down > h:
            out.append((i, "down"))
            down = 0.0
    return out


def test_cusum(spark):
    rng = np.random.default_rng(3)
    xs = np.concatenate((rng.normal(0, 1, 30), rng.normal(4, 1, 10), [math.nan], rng.normal(-4, 1, 20)))
    got = one(spark, drift.cusum(lit(xs), F.lit(0.5), F.lit(4.0)))
    assert [(r["index"], r["type"]) for r in got] == cusum_of(xs, 0.5, 4.0)
    assert {r["type"] for r in got} == {"up", "down"}
    kept = one(spark, drift.spaced(drift.cusum(lit(xs), F.lit(0.5), F.lit(4.0)), 5))
    for kind in ("up", "down"):
        at = [r["index"] for r in kept if r["type"] == kind]
        assert all(b - a >= 5 for a, b in zip(at, at[1:], strict=False))
    short = spark.createDataFrame([("a", i, float(i)) for i in range(4)], "k string, o int, v double")
    assert drift.change_points(short, "k", "o", "v").count() == 0


def test_mmd():
    x = np.random.default_rng(1).normal(size=(40, 3))
    assert drift.mmd2(x, x) == 0
    assert drift.mmd2(x, x + 3) > 0.3
    assert drift.mmd2(x[:1], x[1:2]) >= 0


def test_pca(spark):
    x = np.random.default_rng(2).normal(size=(200, 6)) * [5, 3, 1, 1, 0.5, 0.1]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    basis = pca.fit(df, 3)
    assert np.allclose(basis.components @ basis.components.T, np.eye(3))
    assert (np.diff(basis.variances) <= 0).all()
    got = np.array([r.features for r in pca.project(df, basis).orderBy("id").collect()])
    assert np.allclose(got, (x - x.mean(0)) @ basis.components.T)
    assert pca.fit(df, 6).components is None
    assert pca.intrinsic_dimension(x)[0] <= pca.intrinsic_dimension(x)[1] <= 6
    assert pca.intrinsic_dimension(x[:1]) == [0, 0]
    with pytest.raises(ValueError, match="no vectors"):
        pca.fit(df.where("false"), 3)


def test_pca_by_key(spark, small):
    b = fixture(spark, small)
    bases = pca.fit_by(b.features, "run_id", 5)
    got = pca.project_by(b.features, bases, "run_id", limit=3000)
    assert got.count() == b.features.count()
    own = pca.project(b.features.where("run_id = 'run_2'"), pca.fit(b.features.where("run_id = 'run_2'"), 5))
    a, c = (np.array([r.features for r in d.where("run_id = 'run_2'").orderBy("feat_idx").collect()]) for d in (got, own))
    assert np.allclose(a, c)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_k_medoids(metric):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.1, size=(20, 4)) for c in ([5, 0, 0, 0], [0, 5, 0, 0], [0, 0, 5, 0])])
    chosen, own, d = medoids.cluster(x, 3, metric)
    assert len(set(chosen)) == 3
    assert np.array_equal(own, medoids.distances(x, x[chosen], metric).argmin(1))
    assert sorted(np.bincount(own)) == [20, 20, 20]
    again = medoids.cluster(x, 3, metric)
    assert all(np.array_equal(a, b) for a, b in zip((chosen, own, d), again, strict=True))
    assert len(medoids.cluster(np.zeros((4, 2)), 3, metric)[0]) == 3
    assert len(medoids.cluster(x[:2], 9, metric)[0]) == 2


def test_coverage(spark):
    df = spark.createDataFrame([("r", "g", 0, 0.1), ("r", "g", 0, 0.3), ("r", "g", 2, 0.2)], "run_id string, `group` string, medoid_rank long, dist double")
    r = medoids.coverage(df, 3).first()
    assert r.medoid_counts == [2, 0, 1]
    assert math.isclose(r.gini, 1 - 5 / 9)
    assert math.isclose(r.median_within, 0.2)
    assert medoids.coverage(df, 1).first().entropy_norm == 0


def test_divergence(spark):
    assert abs(one(spark, stability.divergence(lit([1, 2]), lit([1, 2])))) < 1e-9
    assert math.isclose(one(spark, stability.divergence(lit([1]), lit([0, 1]))), math.log(2), abs_tol=1e-9)
    assert one(spark, stability.divergence(lit([0]), lit([1]))) is None


def test_silhouette_undefined(spark):
    proto = lambda runs: spark.createDataFrame([(r, "c", i, [float(i), 1.0]) for i, r in enumerate(runs)], "run_id string, class string, medoid_rank long, v array<double>")
    assert stability.silhouette(proto("aaa")).first().silhouette is None
    assert stability.silhouette(proto("abc")).first().silhouette is None
    assert stability.silhouette(proto("aabb")).first().silhouette > 0
    r = stability.global_summary(proto("ab")).first()
    assert (r.n_prototypes, r.mean_to_centroid, r.variance, r.silhouette_by_run) == (2, None, None, None)


def test_tsne():
    x = np.concatenate([np.random.default_rng(5).normal(c, 0.1, size=(15, 4)) for c in (0, 5)])
    y = tsne.embed(x, 5, rounds=300)
    assert y.shape == (30, 2)
    assert np.isfinite(y).all()
    assert np.array_equal(y, tsne.embed(x, 5, rounds=300))
    assert np.linalg.norm(y[:15].mean(0) - y[15:].mean(0)) > y[:15].std()
    assert tsne.embed(x[:2]).shape == (2, 2)


@pytest.mark.parametrize("scale", [1e-8, 1e-4, 0.1, 1, 5, 20])
def test_tsne_forces_on_the_grid(scale):
    """Maps as they are in the first rounds and in the last, with a far row, against plain sums."""
    g = np.random.default_rng(3)
    y = np.concatenate([g.normal(size=(40, 2)), g.normal(3, 0.2, size=(40, 2)), [[5, -6]] * 2, [[-9, 9]]]) * scale
    apart = y[:, None] - y[None]
    w = 1 / (1 + (apart**2).sum(2)) * (1 - np.eye(len(y)))
    want, total = ((w * w)[:, :, None] * apart).sum(1), w.sum()
    for way, near in ((tsne.by_pairs, 1e-6), (tsne.by_grid, 2e-3), (tsne.repulsion, 2e-3)):
        force, summed = way(y)
        assert np.linalg.norm(force - want) < near * np.linalg.norm(want)
        assert math.isclose(summed, total, rel_tol=1e-4)


def test_tsne_attraction():
    g = np.random.default_rng(4)
    y, x = g.normal(size=(300, 2)), g.normal(size=(300, 5))
    i, j, p = tsne.affinities(x, 9)
    dense = np.zeros((300, 300))
    dense[i, j] = p
    apart = y[:, None] - y[None]
    want = ((dense / (1 + (apart**2).sum(2)))[:, :, None] * apart).sum(1)
    assert np.allclose(tsne.attraction(y, i, j, p), want, rtol=1e-9, atol=1e-15)


def test_tsne_of_many_rows_sums_no_pairs(monkeypatch):
    """8000 rows, the sample of four runs, are laid on the grid in each round; rows that are too far
    apart for one, or few, are summed by pairs."""
    ways, by_pairs, by_grid = [], tsne.by_pairs, tsne.by_grid
    monkeypatch.setattr(tsne, "by_pairs", lambda y: ways.append("pairs") or by_pairs(y))
    monkeypatch.setattr(tsne, "by_grid", lambda y: ways.append("grid") or by_grid(y))
    x = np.random.default_rng(6).normal(size=(8000, 4))
    y = tsne.embed(x, rounds=3)
    assert y.shape == (8000, 2) and np.isfinite(y).all()
    assert ways == ["grid"] * 3
    tsne.repulsion(np.concatenate([x[:2000, :2], [[1e9, -1e9]]]))
    tsne.repulsion(x[:300, :2] * 20)
    assert ways[3:] == ["pairs"] * 2


def test_tsne_map_is_as_good_by_either_way(monkeypatch):
    x = np.concatenate([np.random.default_rng(7).normal(c, 1, size=(200, 8)) for c in (0, 2, 4)])
    i, j, p = tsne.affinities(x, 30)

    def loss(y):
        w = 1 / (1 + ((y[i] - y[j]) ** 2).sum(1))
        return (p * np.log(p * tsne.by_pairs(y)[1] / w)).sum()

    monkeypatch.setattr(tsne, "repulsion", tsne.by_pairs)
    pairs = loss(tsne.embed(x, rounds=400))
    monkeypatch.setattr(tsne, "repulsion", tsne.by_grid)
    assert loss(tsne.embed(x, rounds=400)) < pairs + 0.1  # other seeds change either by 0.02 (standard deviation)


def test_pearson_p():
    assert math.isclose(analyses.pearson_p(0.5, 20), 0.0247, abs_tol=1e-3)
    assert math.isclose(analyses.pearson_p(0.0, 20), 1.0, abs_tol=1e-9)
    assert (analyses.pearson_p(None, 9), analyses.pearson_p(0.3, 2), analyses.pearson_p(1.0, 9)) == (None, 1.0, 0.0)


def test_constant_correlation(spark):
    df = spark.createDataFrame([(1.0, float(i), 0.0) for i in range(3)], "pred1_conf double, local_density double, centroid_dist double")
    assert analyses.correlations(df).first().density_r is None


def test_alignment(spark, small):
    b = fixture(spark, small)
    with pytest.raises(Exception, match="repeated key"):
        unique(b.predictions.union(b.predictions), "run_id", "image_name").collect()
    out = align(b.features, b.predictions)
    assert out.count() == b.features.count()
    assert out.where("pred1_label = 'unknown' and pred1_conf = 0").count() == 18


def test_partitions_do_not_matter(spark, small):
    b = fixture(spark, small)
    views = [type(b)(b.features.repartition(n), b.predictions.repartition(n), b.metadata) for n in (1, 7)]
    got = [sorted(map(tuple, analyses.novelty(v, top_n=5, pca_dim=64, reservoir_cap=50).select("run_id", "feat_idx", F.round("score", 9)).collect())) for v in views]
    assert got[0] == got[1]
