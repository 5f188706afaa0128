import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from curvelake import numerics as nm
from curvelake.basis import BSplineBasis, ConstantBasis, CustomBasis, FiniteElementBasis, FourierBasis, MonomialBasis, TensorBasis, VectorBasis
from curvelake.functions import covariances as cv
from curvelake.meta import GridMeta

grids = st.lists(st.floats(0.05, 2), min_size=3, max_size=12).map(lambda g: np.cumsum(g))


@settings(max_examples=40, deadline=None)
@given(grids)
def test_simpson_is_exact_for_parabolas(x):
    assert np.isclose(nm.simpson_weights(x) @ x**2, (x[-1] ** 3 - x[0] ** 3) / 3)


def test_simpson_of_one_and_two_points():
    assert nm.simpson_weights([3.0]).tolist() == [0.0]
    assert nm.simpson_weights([1.0, 3.0]).tolist() == [1.0, 1.0]


@settings(max_examples=30, deadline=None)
@given(grids)
def test_differences_are_exact_for_parabolas(x):
    assert np.allclose(nm.difference_matrix(x) @ x**2, 2 * x, atol=1e-6)
    if len(x) > 3:
        assert np.allclose(nm.difference_matrix(x, 2) @ x**2, 2, atol=1e-5)


@pytest.mark.parametrize("degree", [1, 2, 3, 4, 5])
def test_splines_interpolate_and_reproduce_polynomials(degree):
    x = np.array([0, 0.3, 0.5, 1.1, 1.4, 2.0, 2.2, 3.0])
    assert np.allclose(nm.spline_matrix(x, x, degree), np.eye(len(x)), atol=1e-9)
    t = np.linspace(0, 3, 17)
    assert np.allclose(nm.spline_matrix(x, t, degree) @ x**degree, t**degree, atol=1e-6)


def test_linear_interpolation_of_squares():
    x = np.arange(10.0)
    m = nm.linear_matrix(x, [0.5, 1.5, 2.5, 5.3])
    assert np.allclose(m @ x**2, [0.5, 2.5, 6.5, 28.3])
    assert np.allclose(m @ (x**2)[::-1], [72.5, 56.5, 42.5, 13.9])


def test_pchip_is_monotone_and_interpolates():
    x, y = np.array([0, 1, 2, 4, 5.0]), np.array([0, 0, 1, 1, 3.0])
    t = np.linspace(0, 5, 101)
    assert np.all(np.diff(nm.pchip(x, y, t)) >= -1e-12)
    assert np.allclose(nm.pchip(x, y, x), y)


def test_bases():
    t = np.linspace(0, 1, 11)
    assert np.allclose(BSplineBasis((0, 1), 6)(t).sum(1), 1)
    assert np.allclose(FourierBasis((0, 1), 5).gram(), np.eye(5), atol=1e-8)
    assert FourierBasis((0, 1), 4).n_basis == 5
    assert np.allclose(MonomialBasis((0, 1), 3).gram(), [[1 / (i + j + 1) for j in range(3)] for i in range(3)])
    assert ConstantBasis((0, 2)).gram() == pytest.approx(2)
    assert np.allclose(MonomialBasis((0, 1), 3).penalty(1), [[0, 0, 0], [0, 1, 1], [0, 1, 4 / 3]])
    basis, m = BSplineBasis((0, 1), 6).derivative()
    c = np.random.default_rng(0).standard_normal(6)
    assert np.allclose(basis(t) @ (m @ c), BSplineBasis((0, 1), 6)(t, 1) @ c, atol=1e-7)
    assert TensorBasis((MonomialBasis((0, 1), 2), MonomialBasis((0, 1), 3))).gram().shape == (6, 6)
    assert VectorBasis((ConstantBasis(), MonomialBasis((0, 1), 2)))(t).shape == (11, 3, 2)
    mesh = FiniteElementBasis(((0, 0), (1, 0), (0, 1)), ((0, 1, 2),))
    assert np.allclose(mesh([[0.2, 0.3]]), [[0.5, 0.2, 0.3]])
    with pytest.raises(ValueError):
        CustomBasis(points=(0.0, 1.0, 2.0), rows=((1.0, 1.0, 1.0), (2.0, 2.0, 2.0)))
    with pytest.raises(ValueError):
        BSplineBasis((0, 1), 2)


def test_covariances():
    x = np.array([0.0, 0.5, 1.0])
    assert np.allclose(cv.Brownian()(x), np.minimum(x[:, None], x[None]))
    for nu, same in ((0.5, cv.Exponential()), (float("inf"), cv.Gaussian())):
        assert np.allclose(cv.Matern(nu=nu)(x), same(x))
    assert np.allclose(cv.Matern(nu=1.5000001)(x), cv.Matern(nu=1.5)(x), atol=1e-4)
    assert np.allclose(cv.WhiteNoise(2)(x), 2 * np.eye(3))
    assert np.allclose(cv.Linear()(x), np.outer(x, x)) and np.allclose(cv.Polynomial()(x), np.outer(x, x) ** 2)


def test_meta_refuses_bad_grids():
    for bad in ([1.0, 1.0], [2.0, 1.0], []):
        with pytest.raises((ValueError, IndexError)):
            GridMeta.of(bad)
    with pytest.raises(ValueError):
        GridMeta.of([0.0, 1.0], (0.2, 1.0))
