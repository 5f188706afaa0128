import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelake.basis import MonomialBasis
from curvelake.frames import Curves, Irregular
from curvelake.meta import GridMeta
from curvelake.operators import classification as cl
from curvelake.operators import clustering as ct
from curvelake.operators import depth as dp
from curvelake.operators import features as ft
from curvelake.operators import inference as nf
from curvelake.operators import metrics as mt
from curvelake.operators import ranks
from curvelake.operators import reduction as rd
from curvelake.operators import registration as rg
from curvelake.operators import regression as rr
from curvelake.operators import scoring as sc
from curvelake.operators import smoothing as sm
from curvelake.operators import stats as st
from curvelake.sources import generators as gn

FOUR = [[1, 1, 2, 3, 2.5, 2], [0.5, 0.5, 1, 2, 1.5, 1], [-1, -1, -0.5, 1, 1, 0.5], [-0.5, -0.5, -0.5, -1, -1, -1]]
T = GridMeta.of([0.0, 2, 4, 6, 8, 10])


@pytest.fixture(scope="module")
def four(spark):
    return Curves.from_literals(spark, FOUR, T)


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(0)
    x = np.linspace(0, 1, 8)
    rows = [(int(i), (rng.standard_normal(8) * 0.3 + (i % 2) * (1 + x)).tolist(), int(i % 2), float(i % 2) + 0.1 * float(rng.standard_normal())) for i in range(60)]
    return Curves(spark.createDataFrame(rows, "id bigint, data array<double>, label int, y double"), GridMeta.of(x))


def by_id(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_depths_of_four_curves(four):
    assert np.round(by_id(dp.integrated_depth(four), "depth"), 1).tolist() == [0.5, 0.8, 0.9, 0.9]
    assert np.round(by_id(dp.modified_band_depth(four), "depth"), 1).tolist() == [0.5, 0.8, 0.7, 0.7]
    assert np.round(by_id(dp.band_depth(four), "depth"), 4).tolist() == [0.5, 0.8333, 0.5, 0.5]
    box = dp.envelope(four, dp.integrated_depth(four)).orderBy("pos").collect()
    assert [r["low"] for r in box] == [-1, -1, -0.5, -1, -1, -1] and [r["high"] for r in box] == [-0.5, -0.5, -0.5, 1, 1, 0.5]
    assert by_id(dp.boxplot_outliers(four, dp.integrated_depth(four)), "is_outlier") == [True, True, False, False]
    assert dp.depth_median(four, dp.integrated_depth(four)).df.first()["id"] == 2


def test_equal_curves(spark):
    five = Curves.from_literals(spark, [[1, 2, 3, 4]] * 5, GridMeta.regular(4))
    assert by_id(dp.integrated_depth(five), "depth") == pytest.approx([0.5] * 5)
    assert by_id(dp.modified_band_depth(five), "depth") == pytest.approx([1.0] * 5)


def test_outliergram_finds_the_crossing_curve(spark):
    rows = [[k] * 6 for k in (0, 1, 2, 3)] + [[9, 9, 9, -1, -1, -1]] + [[k] * 6 for k in (4, 5, 6, 7, 8)]
    got = by_id(dp.outliergram(Curves.from_literals(spark, rows, T)), "is_outlier")
    assert got == [i == 4 for i in range(10)]


def test_directional_outlyingness(spark):
    c = Curves.from_literals(spark, [[0.3, 0.4, 0.5, 0.6], [0.5, 0.6, 0.7, 0.7], [0.2, 0.3, 0.4, 0.5]], GridMeta.of([2.0, 4, 6, 8]))
    got = dp.directional_outlyingness(c)
    assert by_id(got, "mean_outlyingness") == pytest.approx([0, 0.5, -0.5], abs=1e-9) and by_id(got, "variation") == pytest.approx([0, 0, 0], abs=1e-9)


def test_both_ways_of_counting_agree(spark, groups):
    cells = groups.long().select("id", "pos", F.round("v", 1).alias("v"), (F.col("id") % 3 != 0).cast("int").alias("ref"))
    a = {(r["id"], r["pos"]): (r["below"], r["upto"], r["n"]) for r in ranks.rank_counts(cells, 60).collect()}
    b = {(r["id"], r["pos"]): (r["below"], r["upto"], r["n"]) for r in ranks.rank_counts(cells, 60, window_rows=0).collect()}
    assert a == b


def test_norms(spark):
    c = Curves.from_literals(spark, [[2, 3, 4, 5, 6], [1, 4, 9, 16, 25]], GridMeta.of([1.0, 2, 3, 4, 5]))
    assert by_id(mt.lp_norm(c, 1), "norm") == pytest.approx([16, 41.33333333])
    assert by_id(mt.lp_norm(c, 2), "norm") == pytest.approx([8.326664, 25.006666])
    assert by_id(mt.lp_norm(c, float("inf")), "norm") == [6, 25]
    with pytest.raises(ValueError):
        mt.lp_norm(c, 0.5)
    assert by_id(mt.lp_distance(c, c), "distance") == [0, 0]
    assert by_id(mt.angular_distance(c, c * -1), "distance") == pytest.approx([1, 1])
    assert by_id(mt.fisher_rao_distance(c, c + 3), "distance") == pytest.approx([0, 0], abs=1e-9)


def test_neighbours_against_all_pairs(groups):
    x = np.stack([r["data"] for r in groups.df.orderBy("id").collect()])
    d = mt.block_distances(x, x, groups.weights(), "l2")
    np.fill_diagonal(d, np.inf)
    got = {(r["query"], r["rank"]): r["neighbour"] for r in mt.k_neighbours(groups, groups, 4).collect()}
    for i in range(60):
        assert [got[(i, k)] for k in range(1, 5)] == np.argsort(d[i], kind="stable")[:4].tolist()
    assert mt.radius_neighbours(groups, groups, 0.3).count() == int((np.round(d, 10) <= 0.3).sum())
    for metric in ("l1", "linf", "angular", "lp"):
        assert mt.k_neighbours(groups, groups, 2, metric, p=3).count() == 120


def test_blocks_of_queries_give_the_same(groups, monkeypatch):
    whole = {tuple(r) for r in mt.k_neighbours(groups, groups, 2).collect()}
    monkeypatch.setattr(mt, "BLOCK_BYTES", 1000)
    assert {tuple(r) for r in mt.k_neighbours(groups, groups, 2).collect()} == whole


def test_statistics(groups):
    x = np.stack([r["data"] for r in groups.df.orderBy("id").collect()])
    n, mean, scatter = st.moments(groups)
    assert n == 60 and np.allclose(mean, x.mean(0)) and np.allclose(scatter / 60, np.cov(x.T, bias=True))
    got = st.pointwise_var(groups, 1).orderBy("pos").collect()
    assert np.allclose([r["value"] for r in got], x.var(0, ddof=1))
    total = {(r["id"], r["pos"]): r["value"] for r in st.cumulative_sum(groups).collect()}
    assert total[(59, 3)] == pytest.approx(x[:, 3].sum()) and total[(7, 0)] == pytest.approx(x[:8, 0].sum())
    m = st.geometric_median(groups)
    w = groups.weights()
    cost = lambda c: np.sqrt(((x - c) ** 2) @ w).sum()
    assert cost(m) <= cost(mean) + 1e-9


def test_scores(spark):
    meta = GridMeta.of([0.0, 1.0, 2.0])
    y = Curves.from_literals(spark, [[1, 2, 3], [4, 5, 6]], meta)
    p = Curves.from_literals(spark, [[1, 2, 3], [4, 6, 5]], meta)
    assert sc.pointwise_error(y, p, "absolute").first()[0] == pytest.approx((0 * 1 + 0.5 * 4 + 0.5) / 6)
    assert sc.pointwise_error(y, p, raw=True).orderBy("pos").collect()[1]["score"] == 0.5
    assert sc.r2(y, y).first()[0] == 1.0 and sc.explained_variance(y, y).first()[0] == 1.0
    with pytest.raises(Exception):
        sc.pointwise_error(y * -1, p, "squared_log").collect()
    i = Irregular(y.to_irregular().df)
    assert sc.irregular_error(i, i).first()[0] == 0
    df = spark.createDataFrame([(1, 1), (0, 1)], "a int, b int")
    assert sc.accuracy(df, "a", "b").first()[0] == 0.5


def test_features(spark):
    c = Curves.from_literals(spark, [[-1, 1, 0, 0, 2, -1], [1, 0, 1, 1, 1, 1], [0] * 6], GridMeta.regular(6))
    assert by_id(ft.crossings(c), "crossings") == [2, 0, 0]
    assert by_id(ft.crossings(c, direction="up"), "crossings") == [1, 0, 0]
    assert by_id(ft.occupation(c, [(0, 1)]), "occupation")[0] == pytest.approx([0.6])
    x = np.linspace(0, 1, 6)
    line = Curves.from_literals(spark, [x], GridMeta.of(x))
    assert by_id(ft.average_value(line), "value") == pytest.approx([0.5])
    assert by_id(ft.moment(line, 2), "value") == pytest.approx([1 / 3])
    assert by_id(ft.central_moment(line, 2), "value") == pytest.approx([1 / 12])
    assert by_id(ft.local_averages(line, 2), "averages")[0] == pytest.approx([0.25, 0.75])
    with pytest.raises(ValueError):
        ft.occupation(c, [(1, 0)])


def test_smoothers(spark):
    x = np.linspace(0, 1, 9)
    c = Curves.from_literals(spark, [2 * x + 1], GridMeta.of(x))
    for s in (sm.LocalLinear(0.3), sm.PenalisedBasis(MonomialBasis((0.0, 1.0), 3), 0.0)):
        assert np.allclose(sm.smooth(c, s).df.first()["data"], 2 * x + 1)
    for s in (sm.NadarayaWatson(), sm.KNeighbours(), sm.NadarayaWatson(0.2, "epanechnikov")):
        assert np.allclose(s.hat(x).sum(1), 1)
    y = Curves.from_literals(spark, [x**2, np.sin(5 * x)], GridMeta.of(x))
    s = sm.NadarayaWatson(0.2)
    h = s.hat(x)
    off = np.stack([x**2, np.sin(5 * x)])
    off = off - off @ h.T
    assert sm.gcv_score(y, s) == pytest.approx(-(off**2).mean() * (1 - np.diag(h).mean()) ** -2)
    assert sm.leave_one_out_score(y, s) == pytest.approx(-((off / (1 - np.diag(h))) ** 2).mean())
    best, scores = sm.parameter_search(y, {b: sm.NadarayaWatson(b) for b in (0.1, 0.2, 0.5)})
    assert scores[0.2] == pytest.approx(sm.gcv_score(y, s)) and best == 0.1


def test_components(groups):
    x = np.stack([r["data"] for r in groups.df.orderBy("id").collect()])
    pcs = rd.fpca(groups, 2)
    w = groups.weights()
    assert np.allclose(pcs.components @ (w[:, None] * pcs.components.T), np.eye(2), atol=1e-9)
    scores = np.array(by_id(pcs.transform(groups), "scores"))
    assert np.allclose(scores.var(0, ddof=1), pcs.variances) and np.allclose(scores, (x - x.mean(0)) * w @ pcs.components.T)
    full = rd.fpca(groups, 8)
    back = np.array(by_id(full.inverse_transform(full.transform(groups)).df, "data"))
    assert np.allclose(back, x)
    with pytest.raises(AttributeError):
        rd.fpca(groups, 9)
    pls = np.array(by_id(rd.fpls(groups, ["y"], 2).predict(groups), "predicted")).ravel()
    y = np.array(by_id(groups.df, "y"))
    assert np.corrcoef(pls, y)[0, 1] > 0.95
    assert len(set(rd.rkhs_selection(groups, "label", 3))) == 3
    assert rd.maxima_hunting(groups, "label") and rd.recursive_maxima_hunting(groups, "label", 3) and len(rd.minimum_redundancy(groups, "label", 2)) == 2
    assert rd.diffusion_map(groups, lambda d: np.exp(-d * d)).count() == 60


def test_regressions(groups):
    y = np.array(by_id(groups.df, "y"))
    x = np.stack(by_id(groups.df, "data"))
    basis = MonomialBasis((0.0, 1.0), 2)
    model = rr.linear_regression(groups, "y", basis)
    z = np.column_stack([np.ones(60), (x * groups.weights()) @ basis(groups.meta.points)])
    want = z @ np.linalg.lstsq(z, y, rcond=None)[0]
    assert np.allclose(by_id(model.predict(groups), "predicted"), want)
    for got in (rr.fpca_regression(groups, "y", 2)[1](groups), rr.fpls_regression(groups, "y", 2)[1](groups), rr.knn_regress(groups, groups, "y"), rr.kernel_regression(groups, groups, "y", 0.2), rr.radius_regress(groups, groups, "y", 0.6)):
        p = np.array([np.nan if v is None else v for v in by_id(got, "predicted")], float)
        assert np.corrcoef(p[~np.isnan(p)], y[~np.isnan(p)])[0, 1] > 0.9
    coef = rr.function_on_scalar(groups, ["y"])
    assert np.allclose(coef[0] + coef[1] * y.mean(), x.mean(0))
    assert rr.knn_regress_curves(groups, groups, groups, 3).df.count() == 60
    surface = rr.historical_regression(groups, groups, 3)
    assert np.isfinite(surface).all() and abs(surface[-1, 0]) < 1e-12


def test_classifiers_separate_two_groups(groups):
    truth = np.array(by_id(groups.df, "label"))
    for got in (
        cl.knn_classify(groups, groups, "label"), cl.radius_classify(groups, groups, "label", 0.6, outlier_label=0), cl.nearest_centroid(groups, groups, "label"), cl.dtm_classify(groups, groups, "label", 0.2),
        cl.maximum_depth(groups, groups, "label"), cl.ddg_classify(groups, groups, "label"), cl.dd_classify(groups, groups, "label"), cl.quadratic_discriminant(groups, groups, "label", 0.05), cl.logistic(groups, groups, "label", 2),
    ):
        assert np.mean(np.array(by_id(got, "predicted")) == truth) > 0.85
    shares = cl.vote_shares(mt.k_neighbours(groups, groups, 5, carry=["label"]), "label", "distance").groupBy("id").agg(F.sum("share").alias("s"))
    assert by_id(shares, "s") == pytest.approx([1.0] * 60)


def test_clusters_separate_two_groups(groups):
    truth = np.array(by_id(groups.df, "label"))
    same = lambda c: max(np.mean(np.array(c) == truth), np.mean(np.array(c) != truth))
    labels, centres, inertia = ct.k_means(groups, 2)
    assert same(by_id(labels, "cluster")) > 0.95 and centres.shape == (2, 8) and inertia > 0
    m, _ = ct.fuzzy_c_means(groups, 2)
    assert same([int(r[0] < r[1]) for r in by_id(m, "membership")]) > 0.95
    assert same(by_id(ct.agglomerate(groups, 2, "complete"), "cluster")) > 0.8
    with pytest.raises(ValueError):
        ct.k_means(groups, 1)


def test_inference(spark):
    one = np.ones(50)
    w = np.full(50, 0)
    del w
    weights = Curves.from_literals(spark, [one], GridMeta.regular(50)).weights()
    assert nf.v_statistic([one, 2 * one, 3 * one], [1, 2, 3], weights) == pytest.approx(7)
    assert nf.v_asymptotic([one, 2 * one, 3 * one], [1, 2, 3], weights) == pytest.approx(0.909512, abs=1e-5)
    meta = GridMeta.of([0.0, 1.0, 2.0])
    a = Curves.from_literals(spark, [[1, 1, 1], [1, 1, 1]], meta)
    assert nf.hotelling_t2(a, Curves.from_literals(spark, [[1, 1, 1], [2, 2, 2]], meta)) == pytest.approx(1)
    assert nf.hotelling_test(a, Curves.from_literals(spark, [[3, 3, 3], [2, 2, 2]], meta)) == (pytest.approx(9), 0)


def test_anova_sees_a_difference(groups):
    statistic, p = nf.oneway_anova(groups, "label", 100)
    assert statistic == pytest.approx(nf.group_statistic(groups, "label").first()[0]) and p < 0.05


def test_registration(spark):
    x = np.linspace(0, 1, 60)
    bump = lambda c: np.exp(-((x - c) ** 2) / 0.01)
    c = Curves(spark.createDataFrame([(0, bump(0.45).tolist(), 0.45), (1, bump(0.55).tolist(), 0.55)], "id bigint, data array<double>, peak double"), GridMeta.of(x))
    moved = np.array(by_id(rg.landmark_shift(c, "peak", extrapolation="bounds").df, "data"))
    assert np.abs(moved[0] - moved[1]).max() < 0.05
    deltas = by_id(rg.least_squares_shift(c, 10, 1e-4), "delta")
    assert deltas[1] - deltas[0] == pytest.approx(0.1, abs=0.01)
    marks = c.with_df(c.df.withColumn("marks", F.array("peak")))
    aligned = np.array(by_id(rg.landmark_registration(marks, "marks").df, "data"))
    assert abs(int(aligned[0].argmax()) - int(aligned[1].argmax())) <= 1
    elastic = np.array(by_id(rg.elastic_registration(c, bump(0.5)).df, "data"))
    assert np.abs(elastic[0] - bump(0.5)).max() < 0.25 and np.abs(elastic[1] - bump(0.5)).max() < 0.25
    warp = gn.warpings(spark, 3, 50)
    there = warp.compose(rg.invert_warping(warp))
    assert np.allclose(np.array(by_id(there.df, "data")), np.linspace(0, 1, 50), atol=0.02)
    parts = rg.amplitude_phase(c, c)
    assert parts["ratio"] == 1 and parts["phase"] == pytest.approx(0)
    assert rg.least_squares_score(c, c) == pytest.approx(0) and rg.sobolev_score(c, c) == pytest.approx(0) and rg.pairwise_correlation(c, c) == pytest.approx(1)


def test_generators_are_seeded(spark):
    a, b = (gn.gaussian_process(spark, 5, 20, seed=3).df.orderBy("id").collect() for _ in range(2))
    assert a == b
    flat = gn.sde_paths(spark, 2, 1.0, drift=2.0, diffusion=0.0, n_points=11)
    assert np.allclose(by_id(flat.df, "data")[0], 1 + 2 * np.linspace(0, 1, 11))
    with pytest.raises(ValueError):
        gn.sde_paths(spark, 1, 0.0, method="milstein")
    s = gn.irregular_sample(gn.multimodal(spark, 3, 2), 5)
    assert s.df.groupBy("id").count().agg(F.max("count")).first()[0] == 5
    assert gn.sinusoids(spark, 4).df.count() == 4 and gn.modes(spark, 2, 3).count() == 2
