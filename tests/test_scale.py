"""Ways of the operators that larger sets take, on small fixtures."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelake.frames import Curves, Irregular
from curvelake.meta import GridMeta
from curvelake.operators import clustering as ct
from curvelake.operators import depth as dp
from curvelake.operators import metrics as mt
from curvelake.operators import reduction as rd
from curvelake.operators import registration as rg
from curvelake.operators.ranks import first_rows, quantiles, running_total
from curvelake.operators.regression import kernel_regression
from curvelake.operators.stats import cumulative_sum, moments


@pytest.fixture(scope="module")
def curves(spark):
    rng = np.random.default_rng(0)
    return Curves.from_literals(spark, rng.normal(size=(300, 5)).round(1), GridMeta.regular(5)), np.random.default_rng(0).normal(size=(300, 5)).round(1)


def test_first_rows_of_any_number(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 4, 500)
    df = spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(v)], "id bigint, depth double").repartition(7)
    want = [int(i) for i in np.lexsort((np.arange(500), -v))]
    for k in (0, 1, 3, 249, 499, 500, 900):
        for few in (0, 10_000):
            got = {r["id"] for r in first_rows(df, [F.col("depth").desc(), F.col("id")], k, few).collect()}
            assert got == set(want[:k])


def test_quantiles_over_ranges(curves):
    c, x = curves
    cells = c.long()
    for rows in (10, 10**9):
        got = {r["pos"]: r["q"] for r in quantiles(cells, [0.0, 0.25, 0.5, 1.0], rows).collect()}
        assert all(np.allclose(got[p], np.quantile(x[:, p], [0, 0.25, 0.5, 1])) for p in range(5))


def test_running_totals(curves):
    c, x = curves
    got = {(r["id"], r["pos"]): r["value"] for r in cumulative_sum(c).collect()}
    sums = x.cumsum(0)
    assert len(got) == 1500 and all(abs(got[(i, p)] - sums[i, p]) < 1e-9 for i in range(300) for p in range(5))
    whole = running_total(c.long(), "pos", "id", "v").where("id = 0 and pos = 2").first()["whole"]
    assert abs(whole - x[:, 2].sum()) < 1e-9


def test_outlyingness_over_ranges(curves):
    c, _ = curves
    a, b = ({(r["id"], r["pos"]): r["outlyingness"] for r in dp.stahel_donoho(c, n).collect()} for n in (10**9, 10))
    assert a == pytest.approx(b)


def test_blocks_of_queries_and_rows(curves, monkeypatch):
    c, x = curves
    labelled = c.with_df(c.df.withColumn("y", F.col("id") % 7))
    some = labelled.where("id % 3 = 0")
    whole = sorted(map(tuple, mt.k_neighbours(some, labelled, 4, carry=["y"]).collect()))
    fit = {r["id"]: r["predicted"] for r in kernel_regression(some, labelled, "y", 0.3).collect()}
    monkeypatch.setattr(mt, "BLOCK_BYTES", 1500)
    assert sorted(map(tuple, mt.k_neighbours(some, labelled, 4, carry=["y"]).collect())) == whole
    assert {r["id"]: r["predicted"] for r in kernel_regression(some, labelled, "y", 0.3).collect()} == pytest.approx(fit)


def test_moments_of_many_parts(spark, curves):
    c, x = curves
    n, mean, scatter = moments(c.with_df(c.df.repartition(40)))
    assert n == 300 and np.allclose(mean, x.mean(0)) and np.allclose(scatter / n, np.cov(x.T, bias=True))


def test_several_coordinates_and_arguments(spark):
    t = np.linspace(0, 1, 6)
    two = np.stack([np.c_[t**2, 1 - t].ravel(), np.c_[3 * t, t**3].ravel()])
    c = Curves.from_literals(spark, two, GridMeta.of(t, codomain=2))
    at = np.array([0.1, 0.55, 0.9])
    got = np.array([r["data"] for r in c.evaluate(at, degree=3).df.orderBy("id").collect()])
    assert np.allclose(got, [np.c_[at**2, 1 - at].ravel(), np.c_[3 * at, at**3].ravel()])
    out = np.array([r["data"] for r in c.evaluate([-0.5, 0.5, 2.0], "zeros", degree=3).df.orderBy("id").collect()])
    assert np.allclose(out[:, [0, 1, 4, 5]], 0) and np.allclose(out[0, 2:4], [0.25, 0.5])
    s = np.linspace(0, 2, 5)
    surface = (t[:, None] ** 2 * s[None] + s[None] ** 3).reshape(1, -1)
    f = Curves.from_literals(spark, surface, GridMeta.of((t, s)))
    a, b = np.array([0.15, 0.8]), np.array([0.3, 1.1, 1.9])
    got = f.evaluate_grid((a, b), degree=(2, 3)).df.first()["data"]
    assert np.allclose(got, (a[:, None] ** 2 * b[None] + b[None] ** 3).ravel())
    held = f.evaluate_grid(([0.0, 5.0], [0.0, 2.0]), "bounds", degree=(2, 3)).df.first()["data"]
    assert np.allclose(held, [0, 8, 0, 10])
    with pytest.raises(ValueError):
        f.evaluate_grid((a,))


def test_irregular_curves_move_and_become_curves(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 2.0, 3.0), (2, 1.0, 5.0), (2, 2.0, None), (1, 2.0, 2.5)], "id bigint, t double, v double")
    i = Irregular(df)
    c = i.to_curves()
    assert c.meta.axes == ((0.0, 1.0, 2.0),)
    assert {r["id"]: r["data"] for r in c.df.collect()} == {1: [1.0, None, 2.5], 2: [None, 5.0, None]}
    assert sorted(r["t"] for r in i.shift(0.5).df.where("id = 1").collect()) == [-0.5, 1.5, 1.5]
    assert sorted(r["t"] for r in i.compose(lambda t: F.sqrt(t)).df.where("id = 2").collect()) == pytest.approx([1.0, 2**0.5])
    with pytest.raises(ValueError):
        i.to_curves(most_points=2)


def test_registrations_are_undone(spark):
    from curvelake.operators.registration import undo_shift, undo_warping

    t = np.linspace(0, 1, 201)
    meta = GridMeta.of(t)
    f = np.stack([np.sin(3 * t), t**2])
    warp = Curves.from_literals(spark, np.stack([t**1.5, t**0.8]), meta)
    curves = Curves.from_literals(spark, f, meta)
    back = np.array([r["data"] for r in undo_warping(curves.compose(warp), warp).df.orderBy("id").collect()])
    assert np.abs(back - f).max() < 0.01
    deltas = spark.createDataFrame([(0, 0.1), (1, 0.05)], "id bigint, delta double")
    moved = curves.with_df(curves.df.join(deltas, "id")).shift(F.col("delta"), "bounds")
    back = np.array([r["data"] for r in undo_shift(moved.with_df(moved.df.drop("delta")), deltas, "bounds").df.orderBy("id").collect()])
    assert np.abs(back - f)[:, 25:].max() < 0.01


def test_terms_have_penalties_of_their_own(spark):
    from curvelake.basis import MonomialBasis
    from curvelake.operators.regression import Term, linear_regression_terms

    rng = np.random.default_rng(7)
    t = np.linspace(0, 1, 21)
    a, b = rng.normal(size=(200, 4)) @ np.stack([t**k for k in range(4)]), rng.normal(size=(200, 4)) @ np.stack([t**k for k in range(4)])
    meta = GridMeta.of(t)
    s = rng.normal(size=200)
    left, right = Curves.from_literals(spark, a, meta), Curves.from_literals(spark, b, meta)
    y = 2 + 0.5 * s + left.weights() @ (a * (1 + t)).T - left.weights() @ (b * t**2).T
    extra = spark.createDataFrame([(i, float(y[i]), float(s[i])) for i in range(200)], "id bigint, y double, s double")
    left = left.with_df(left.df.join(extra, "id"))
    basis = MonomialBasis((0.0, 1.0), 3)
    c, scalars, functions, predict = linear_regression_terms([Term(left, basis), Term(right, basis)], "y", ["s"])
    assert abs(c - 2) < 1e-6 and abs(scalars["s"] - 0.5) < 1e-6 and np.allclose(functions[0], [1, 1, 0], atol=1e-5) and np.allclose(functions[1], [0, 0, -1], atol=1e-5)
    assert max(abs(r["predicted"] - y[r["id"]]) for r in predict([left, right]).collect()) < 1e-6
    stiff = linear_regression_terms([Term(left, basis, 1e9), Term(right, basis)], "y", ["s"])[2]
    assert abs(stiff[0][2]) < 1e-4 < abs(stiff[1][2])


def test_elastic_distances_and_means(spark):
    from curvelake.operators.registration import amplitude_distance, warping_mean

    t = np.linspace(0, 1, 101)
    meta = GridMeta.of(t)
    f = np.sin(2 * np.pi * t)
    a = Curves.from_literals(spark, np.stack([f, f]), meta)
    b = Curves.from_literals(spark, np.stack([np.interp(t**1.3, t, f), 2 * f]), meta)
    got = {r["id"]: r["distance"] for r in amplitude_distance(a, b).collect()}
    assert got[0] < 0.3 * got[1]
    mean = warping_mean(Curves.from_literals(spark, np.stack([t**1.5, t**1.5]), meta))
    assert np.abs(mean - t**1.5).max() < 0.01
    both = warping_mean(Curves.from_literals(spark, np.stack([t + 0.1 * np.sin(np.pi * t), t - 0.1 * np.sin(np.pi * t)]), meta))
    assert np.abs(both - t).max() < 0.02


def test_recursive_maxima_with_corrections_and_stops(spark):
    from curvelake.operators import reduction as rd

    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 300)
    x = np.cumsum(rng.normal(0, 0.15, (300, 30)), axis=1)
    x[:, 8:] += 0.9 * y[:, None]
    curves = Curves.from_literals(spark, x, GridMeta.regular(30))
    curves = curves.with_df(curves.df.join(spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "id bigint, y int"), "id"))
    for correction in (rd.uniform_correction, rd.sample_correction, rd.gaussian_correction(np.cov(x.T))):
        got = rd.recursive_maxima_hunting(curves, "y", 2, correction=correction)
        assert 8 <= got[0] <= 20 and len(set(got)) == len(got)
    assert len(rd.recursive_maxima_hunting(curves, "y", 1, stop=rd.independence_stop(300))) == 1
    noise = curves.with_df(spark.createDataFrame([(i, int(v), rng.normal(size=5).tolist()) for i, v in enumerate(y)], "id bigint, y int, data array<double>"), axes=((0.0, 1.0, 2.0, 3.0, 4.0),), domain=((0.0, 4.0),))
    assert rd.recursive_maxima_hunting(noise, "y", 3, stop=rd.independence_stop(300, 1e-6)) == []


def test_independence_statistic_equals_its_definition():
    from curvelake.operators.reduction import independence_statistic

    rng = np.random.default_rng(9)
    x, y = rng.normal(size=40).round(1), rng.normal(size=40)
    a, b = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    centred = lambda d: d - d.mean(0) - d.mean(1)[:, None] + d.mean()
    assert independence_statistic(x, y) == pytest.approx((centred(a) * centred(b)).mean() / (a.mean() * b.mean()))


def test_many_curves_are_aligned_at_once():
    t = np.linspace(0, 1, 12)
    f, goal = np.random.default_rng(3).normal(size=(5000, 12)), np.sin(6 * t)
    began = time.process_time()
    got = rg.align_rows(f, goal, t)
    assert time.process_time() - began < 20  # one curve after another took 20 ms each
    assert all(np.array_equal(got[i], rg.align_to_template(f[i], goal, t)) for i in (0, 1, 4999))
    assert (np.diff(got, axis=1) >= 0).all() and np.allclose(got[:, [0, -1]], [0, 1])


def test_band_depth_of_many_curves(spark):
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=(60, 3)), rng.integers(0, 3, (60, 4)).astype(float), rng.integers(0, 2, (50, 20)).astype(float).cumsum(0)):
        n = len(x)
        c = Curves.from_literals(spark, x, GridMeta.regular(x.shape[1]))
        low, high = np.minimum(x[:, None], x[None]), np.maximum(x[:, None], x[None])
        want = [float(((low <= r) & (r <= high)).all(-1)[np.triu_indices(n, 1)].mean()) for r in x]
        for size in (10**6, 20 * x.shape[1] * 8):  # one block, and pairs of blocks
            assert [r["depth"] for r in dp.band_depth(c, block_bytes=size).orderBy("id").collect()] == pytest.approx(want)
    many = np.random.default_rng(5).normal(size=(10_500, 6))
    got = dp.band_depth(Curves.from_literals(spark, many[:40], GridMeta.regular(6)), Curves.from_literals(spark, many, GridMeta.regular(6)))
    assert got.count() == 40


def test_agglomeration_of_many_curves(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(60, 3)), rng.normal(size=(60, 3)) * 0.3 + 5 * rng.integers(0, 3, (60, 1))])
    full = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for linkage, joined in (("average", np.mean), ("single", np.min), ("complete", np.max)):
        groups = {i: [i] for i in range(len(x))}
        while len(groups) > 5:
            _, i, j = min((joined(full[np.ix_(a, b)]), i, j) for i, a in groups.items() for j, b in groups.items() if i < j)
            groups[i] += groups.pop(j)
        want = sorted(sorted(g) for g in groups.values())
        for room in (10**8, 8 * len(x) ** 2 // 30):  # without and with kept sums
            got = ct.merged(x, 5, linkage, room)
            assert sorted(np.flatnonzero(got == m).tolist() for m in np.unique(got)) == want
    many = np.random.default_rng(8).normal(size=(3100, 2)).round(3) + 40 * (np.arange(3100) % 3)[:, None]
    labels = ct.agglomerate(Curves.from_literals(spark, many, GridMeta.regular(2)), 3).collect()
    assert {(r["id"] % 3, r["cluster"]) for r in labels} == {(0, 0), (1, 1), (2, 2)} and len(labels) == 3100


def test_diffusion_map_from_blocks(spark):
    x = np.random.default_rng(9).normal(size=(150, 4)).round(2) * [3, 2, 1, 1]
    c = Curves.from_literals(spark, x, GridMeta.regular(4))
    for alpha, scale, kernel in ((0.0, "median", lambda v: np.exp(-(v**2))), (0.5, 2.0, lambda v: 1 / (1 + v))):
        whole, parts = (
            np.array([r["embedding"] for r in rd.diffusion_map(c, kernel, 2, alpha, 1, scale, rows).orderBy("id").collect()])
            for rows in (1000, 10)
        )
        assert np.abs(whole - parts).max() < 1e-8 * np.abs(whole).max()
    d = np.sqrt((((x[:, None] - x[None]) ** 2) @ c.weights()))
    pairs = rd._Distances(spark, x * np.sqrt(c.weights()), 3000)
    for bins, most in ((4096, 10**6), (16, 100), (2, 1)):
        assert pairs.median(bins, most) == pytest.approx(np.median(d[d > 0]), rel=1e-12)
