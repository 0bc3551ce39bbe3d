"""Queries that take their operators' own sample sizes, against brute force."""

import numpy as np
import pytest

from plumbline import queries
from plumbline.bank import align, fixture


@pytest.fixture(scope="module")
def bank(spark, small):
    b = fixture(spark, small)
    return align(b.features, b.predictions).toPandas().sort_values(["run_id", "feat_idx"]).reset_index(drop=True)


def test_purity_sees_every_row(spark, small, bank):
    v = np.stack(bank.features.to_list())
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    near = np.argsort(d, axis=1, kind="stable")[:, :10]
    label = bank.pred1_label.to_numpy()
    same = label[near] == label[:, None]
    centre = {c: v[label == c].mean(0) for c in set(label)}
    want = {"local_density": -np.take_along_axis(d, near, 1)[:, 1:].mean(1), "centroid_dist": [np.linalg.norm(x - centre[c]) for x, c in zip(v, label, strict=True)], "purity_5": same[:, :5].mean(1), "purity_10": same.mean(1)}
    got = queries.purity_points(spark, small).toPandas().merge(bank[["run_id", "image_name", "feat_idx"]]).sort_values(["run_id", "feat_idx"])
    assert len(got) == len(bank) > 240
    for c, w in want.items():
        assert np.allclose(got[c], w, atol=2e-6), c
    r = queries.conf_geometry_corr(spark, small).first()
    assert r.n == len(bank)
    assert np.isclose(r.density_r, np.corrcoef(bank.pred1_conf, want["local_density"])[0, 1], atol=2e-6)
    assert queries.conf_geometry_p_values(spark, small).first().n == len(bank)
    for row in queries.purity_per_run(spark, small).collect():
        assert np.isclose(row.purity_10_mean, want["purity_10"][(bank.run_id == row.run_id).to_numpy()].mean(), atol=2e-6)


def test_novelty_sees_every_row(spark, small, bank):
    got = queries.novelty_inbox(spark, small).toPandas()
    for run, g in bank.groupby("run_id"):
        assert len(g) > 100
        v = np.stack(g.features.to_list())
        v -= v.mean(0)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        knn = np.sort(np.linalg.norm(v[:, None] - v[None], axis=2), axis=1)[:, :10].mean(1)
        centre = {c: v[(g.pred1_label == c).to_numpy()].mean(0) for c in set(g.pred1_label)}
        off = np.array([1 - x @ centre[c] / np.linalg.norm(centre[c]) for x, c in zip(v, g.pred1_label, strict=True)])
        score = 0.4 * off + 0.4 * knn + 0.2 * (1 - np.clip(g.pred1_conf - g.pred2_conf, 0, 1).to_numpy())
        top = np.lexsort((g.feat_idx, -score.round(9)))[:20]
        own = got[got.run_id == run].sort_values(["score", "feat_idx"], ascending=[False, True])
        assert set(own.feat_idx) == set(g.feat_idx.to_numpy()[top])
        assert np.allclose(np.sort(own.knn_mean), np.sort(knn[top]), atol=2e-6)
    sheet = queries.novelty_manifest(spark, small).toPandas()
    assert set(zip(sheet.run_id, sheet.image_name, strict=True)) == set(zip(got.run_id, got.image_name, strict=True))


def test_tsne_map_takes_the_defaults(monkeypatch):
    given = {}
    monkeypatch.setattr(queries, "load", lambda spark, sf_dir: None)
    monkeypatch.setattr(queries.analyses, "tsne", lambda bank, **options: given.update(options))
    monkeypatch.setattr(queries, "rounded", lambda df, *names, **options: df)
    queries.tsne_map(None, None)
    assert "sample_per_run" not in given
    assert "rounds" not in given


def by_run(bank):
    for run, g in bank.groupby("run_id"):
        yield run, g.reset_index(drop=True), np.stack(g.features.to_list())


def principal(x, k):
    """Mean and components, each with its largest loading positive."""
    mean = x.mean(0)
    _, _, rows = np.linalg.svd(x - mean, full_matrices=False)
    rows = rows * np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(1)])[:, None]
    return mean, rows[:k]


def test_geometry_and_intrinsic_dimension(spark, small, bank):
    summary = {r.run_id: r for r in queries.geometry_summary(spark, small).collect()}
    dims = {r.run_id: r for r in queries.intrinsic_dim(spark, small).collect()}
    assert set(summary) == set(dims) == set(bank.run_id)
    for run, _, x in by_run(bank):
        share = np.cumsum(np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2)
        want = [int(np.searchsorted(share / share[-1], s - 1e-12) + 1) for s in (0.9, 0.95)]
        assert [dims[run].pca_dim_90, dims[run].pca_dim_95] == [summary[run].pca_dim_90, summary[run].pca_dim_95] == want
        length = np.linalg.norm(x, axis=1)
        assert (summary[run].num_rows, summary[run].feat_dim, summary[run].sampled) == (len(x), x.shape[1], len(x))
        assert np.allclose([summary[run].mean_norm, summary[run].std_norm], [length.mean(), length.std()], atol=2e-6)


def test_projection(spark, small, bank):
    got = queries.pca_project(spark, small).toPandas().sort_values(["run_id", "feat_idx"])
    x = np.stack(bank.features.to_list())
    mean, rows = principal(x, 8)
    assert np.allclose(np.stack(got.features.to_list()), (x - mean) @ rows.T, atol=2e-5)


def test_novelty_in_projected_spaces(spark, small, bank):
    got = queries.novelty_inbox_pca(spark, small).toPandas()
    for run, g, x in by_run(bank):
        mean, rows = principal(x, 16)
        v = (x - mean) @ rows.T
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        knn = np.sort(np.linalg.norm(v[:, None] - v[None], axis=2), axis=1)[:, :10].mean(1)
        centre = {c: v[(g.pred1_label == c).to_numpy()].mean(0) for c in set(g.pred1_label)}
        off = np.array([1 - y @ centre[c] / np.linalg.norm(centre[c]) for y, c in zip(v, g.pred1_label, strict=True)])
        score = 0.4 * off + 0.4 * knn + 0.2 * (1 - np.clip(g.pred1_conf - g.pred2_conf, 0, 1).to_numpy())
        top = np.lexsort((g.feat_idx, -score.round(9)))[:20]
        own = got[got.run_id == run]
        assert set(own.feat_idx) == set(g.feat_idx.to_numpy()[top])
        assert np.allclose(np.sort(own.score), np.sort(score[top]), atol=2e-5)


def test_medoids_prototypes_and_coverage(spark, small, bank):
    assigned = queries.k_medoids(spark, small).toPandas()
    protos = queries.prototypes(spark, small).toPandas()
    cover = queries.prototype_coverage(spark, small).toPandas().set_index(["run_id", "group"])
    seen = 0
    for run, g, x in by_run(bank):
        for label, members in g.groupby("pred1_label").groups.items():
            own = assigned[(assigned.run_id == run) & (assigned.group == label)].sort_values("feat_idx")
            if len(members) < 5:
                assert own.empty
                continue
            seen += 1
            assert own.feat_idx.to_list() == g.feat_idx[members].to_list()
            y = x[members] - np.concatenate([x[m] for c, m in g.groupby("pred1_label").groups.items()]).mean(0)
            y /= np.linalg.norm(y, axis=1, keepdims=True)
            d = 1 - y @ y.T
            at = np.flatnonzero(own.is_medoid)
            assert np.allclose(own.dist, d[:, at].min(1), atol=2e-6)
            rank = own.medoid_rank.to_numpy()
            assert np.allclose(d[np.arange(len(d)), at[rank]], d[:, at].min(1), atol=1e-9)
            for c, m in enumerate(at):  # no other member of a cluster is nearer to all of it
                inside = np.flatnonzero(rank == c)
                assert d[m, inside].sum() <= d[np.ix_(inside, inside)].sum(1).min() + 1e-9
            chosen = protos[(protos.run_id == run) & (protos.group == label)].sort_values("medoid_rank")
            assert chosen.medoid_global_idx.to_list() == own.feat_idx.to_numpy()[at].tolist()
            share = np.bincount(rank, minlength=3) / len(d)
            row = cover.loc[(run, label)]
            assert row["count"] == len(d)
            assert list(row.medoid_counts) == np.bincount(rank, minlength=3).tolist()
            assert np.isclose(row.gini, 1 - (share**2).sum(), atol=2e-6)
            assert np.isclose(row.entropy, -(share * np.log(share + 1e-12)).sum(), atol=2e-6)
            assert np.isclose(row.mean_within, d[:, at].min(1).mean(), atol=2e-6)
    assert seen > 3


def test_p_values(spark, small, bank):
    r = queries.conf_geometry_corr(spark, small).first()
    got = queries.conf_geometry_p_values(spark, small).first()
    n = len(bank)
    for c, p in ((r.density_r, got.density_p), (r.centroid_r, got.centroid_p)):
        t, k = abs(c) * ((n - 2) / (1 - c * c)) ** 0.5, n - 2
        x = np.linspace(0, t, 400001)
        area = np.trapezoid((1 + x * x / k) ** (-(k + 1) / 2), x)
        whole = np.linspace(0, 400, 4000001)
        assert np.isclose(p, 1 - area / np.trapezoid((1 + whole * whole / k) ** (-(k + 1) / 2), whole), atol=1e-4)


def test_tsne_map_keeps_neighbours(spark, small, bank, monkeypatch):
    """Fewer rounds than registered: near points of the map are near in the projected space."""
    whole = queries.analyses.tsne
    monkeypatch.setattr(queries.analyses, "tsne", lambda bank, **options: whole(bank, rounds=300, **options))
    got = queries.tsne_map(spark, small).toPandas().merge(bank[["run_id", "image_name", "features"]])
    assert len(got) == len(bank)
    x = np.stack(got.features.to_list())
    mean, rows = principal(x, 16)

    def nearest(y):
        d = ((y[:, None] - y[None]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        return d.argsort(1)[:, :10]

    kept = np.mean([len(set(a) & set(b)) for a, b in zip(nearest(got[["x", "y"]].to_numpy()), nearest((x - mean) @ rows.T), strict=True)])
    assert kept > 3 * 10 * 10 / len(x)  # thrice what chance keeps


def test_change_points_have_hits(spark):
    assert queries.drift_change_points(spark, "/root/testdata/sf0.01").count() > 0


def test_repeated_prediction_keys_are_an_error(spark, small):
    b = fixture(spark, small)
    twice = b.predictions.union(b.predictions.limit(1))
    with pytest.raises(Exception, match="repeated key"):
        align(b.features, twice).collect()


def test_class_graph_reads_the_bank_once(spark, small):
    """Rows and edges are written once: what is left is a plan over these two tables."""
    from plumbline.plans import analyses

    plan = analyses.class_graph(fixture(spark, small))["nodes"]._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("FileScan") < 6
    assert initial.count("Exchange") < 20
