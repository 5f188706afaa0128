import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelake.basis import BSplineBasis, MonomialBasis
from curvelake.frames import Curves, Irregular
from curvelake.functions import covariances as cv
from curvelake.meta import GridMeta
from curvelake.operators import covariance_fit as cf
from curvelake.operators import linear as ln
from curvelake.operators.metrics import srsf
from curvelake.operators.mixed_effects import fit_mixed_effects
from curvelake.sources import files
from curvelake.sources import generators as gn


def rows(curves):
    return {r["id"]: r["data"] for r in curves.df.collect()}


def test_linear_operators(spark):
    x = np.linspace(0, 1, 21)
    c = Curves.from_literals(spark, [x**2, np.ones(21)], GridMeta.of(x))
    assert np.allclose(rows(ln.differential_operator(c, [1.0, 0.0, lambda t: t]))[0], x**2 + 2 * x, atol=1e-8)
    assert np.allclose(rows(ln.integral_transform(c, lambda s, t: s * 0 + t, [0.0, 2.0]))[0], [0, 2 / 3])
    assert ln.grid_penalty(x, [0, 0, 1]).shape == (21, 21)
    with pytest.raises(ValueError):
        ln.differential_operator_matrix(x, [])
    back = ln.slope_root_inverse(srsf(c), 0.0)
    assert np.allclose(rows(back)[0], x**2, atol=1e-3)


def test_surfaces(spark):
    a, b = np.linspace(0, 1, 5), np.linspace(0, 2, 4)
    meta = GridMeta.of((a, b))
    v = (a[:, None] * 3 + b[None] * 2).ravel()
    c = Curves.from_literals(spark, [v], meta)
    assert np.allclose(rows(ln.partial_derivative(c, 0))[0], 3) and np.allclose(rows(ln.partial_derivative(c, 1))[0], 2)
    assert np.allclose(rows(ln.evaluate_surface(c, [[0.3, 0.7], [1, 2]]))[0], [0.9 + 1.4, 7])
    assert {r["id"]: r["integral"] for r in c.integrate().collect()}[0] == pytest.approx(2 * 1.5 + 2 * 2)


def test_mixed_effects_recover_smooth_curves(spark):
    rng = np.random.default_rng(0)
    data, truth = [], {}
    for i in range(60):
        c = np.array([1.0, 2.0]) + rng.normal(0, 0.5, 2)
        truth[i] = c
        data += [(i, float(t), float(c[0] + c[1] * t + 0.05 * rng.standard_normal())) for t in rng.uniform(0, 1, 6)]
    data.append((99, 0.5, None))
    model = fit_mixed_effects(Irregular.from_frame(spark.createDataFrame(data, "id bigint, t double, v double"), "id", "t", "v"), MonomialBasis((0.0, 1.0), 2))
    assert np.abs(model.beta - np.mean(list(truth.values()), 0)).max() < 0.1 and model.noise == pytest.approx(0.0025, rel=0.5)
    got = {r["id"]: r["coef"] for r in model.transform(Irregular(spark.createDataFrame(data, "id bigint, t double, v double"))).df.collect()}
    assert np.mean([np.abs(got[i] - truth[i]).max() for i in truth]) < 0.1 and np.allclose(got[99], model.beta)


def test_covariance_parameters(spark):
    c = gn.gaussian_process(spark, 400, 20, cov=cv.Exponential(2.0, 0.3), seed=5)
    p, m = cf.fit_covariance(c, lambda v, s: cv.Exponential(v, s), (1.0, 1.0))
    assert p[0] == pytest.approx(2, rel=0.3) and p[1] == pytest.approx(0.3, rel=0.3) and m.shape == (20, 20)


def test_irregular_and_basis_arithmetic(spark):
    i = Irregular(spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, None), (2, 0.0, 0.0)], "id bigint, t double, v double"))
    v = lambda x: sorted((r["id"], r["t"], r["v"]) for r in x.df.collect() if r["v"] is not None)
    assert v(i + 1) == [(1, 0.0, 3.0), (2, 0.0, 1.0)] and v(1 / i) == [(1, 0.0, 0.5)] and v(-i)[0] == (1, 0.0, -2.0) and v(i - i) == [(1, 0.0, 0.0), (2, 0.0, 0.0)]
    assert i.hull() == (0.0, 1.0) and i.ranges().count() == 2
    x = np.linspace(0, 1, 30)
    b = Curves.from_literals(spark, [x, x**2], GridMeta.of(x)).to_basis(BSplineBasis((0.0, 1.0), 5))
    assert np.allclose(rows((-b / 2).to_grid([0.5]))[0], [-0.25])
    assert b.coefficient_covariance().shape == (5, 5) and b.mean().count() == 5


def test_files(spark, tmp_path):
    c = gn.gaussian_process(spark, 5, 10)
    files.write(c, str(tmp_path / "a"))
    again = files.read(spark, str(tmp_path / "a"))
    assert again.equals(c)
    wide = c.df.select("id", *[F.get("data", F.lit(k)).alias(f"c{k}") for k in range(10)])
    wide.write.csv(str(tmp_path / "b"), header=True)
    got = files.read_wide(spark, str(tmp_path / "b"), [f"c{k}" for k in range(10)], c.meta, "id", "csv", header=True)
    assert got.df.count() == 5
    r = files.ragged(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0, 3.0]), (3, None)], "k bigint, x array<double>"), "k", "x")
    assert rows(r) == {1: [1.0, 0.0, 0.0], 2: [1.0, 2.0, 3.0]}
