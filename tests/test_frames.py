import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelake.basis import BSplineBasis, FourierBasis, MonomialBasis
from curvelake.frames import Curves, Irregular
from curvelake.meta import GridMeta
from curvelake.operators.missing import fill_missing


def rows(curves):
    return {r["id"]: r["data"] for r in curves.df.collect()}


@pytest.fixture(scope="module")
def squares(spark):
    x = np.arange(10.0)
    return Curves.from_literals(spark, [x**2, (x**2)[::-1]], GridMeta.of(x))


def test_evaluation_and_extrapolation(squares):
    assert np.allclose(rows(squares.evaluate([0.5, 1.5, 2.5]))[1], [72.5, 56.5, 42.5])
    assert np.allclose(rows(squares.evaluate([-1.0, 10.0], "bounds"))[0], [0, 81])
    assert np.allclose(rows(squares.evaluate([-1.0, 10.0], "periodic"))[0], [64, 1])
    assert rows(squares.evaluate([-1.0, 2.0], "nan"))[0] == [None, 4.0]
    assert rows(squares.evaluate([-1.0, 2.0], 7.0))[0] == [7.0, 4.0]
    with pytest.raises(ValueError):
        squares.evaluate([-1.0], "exception")


def test_arithmetic_and_missing(spark):
    meta = GridMeta.of([0.0, 1.0, 2.0])
    a = Curves.from_literals(spark, [[1, 2, None], [4, 0, 1]], meta)
    assert rows(a + a)[0] == [2.0, 4.0, None]
    assert rows(1 / a)[1] == [0.25, None, 1.0]
    assert rows(2 - a)[1] == [-2.0, 2.0, 1.0]
    assert rows(a.round())[1] == [4.0, 0.0, 1.0]
    assert rows(a * F.col("id"))[1] == [4.0, 0.0, 1.0]
    assert {r["id"]: r["integral"] for r in a.integrate().collect()}[0] is None
    other = Curves.from_literals(spark, [[1, 2, 3]], GridMeta.of([0.0, 1.0, 3.0]))
    with pytest.raises(ValueError):
        a + other


def test_structure(spark, squares):
    assert len(rows(squares.restrict(2, 5))[0]) == 4
    assert np.allclose(rows(squares.restrict(2.5, 5, True))[0], [6.5, 9, 16, 25])
    both = squares.stack_coordinates(squares * 2)
    assert both.meta.codomain == 2 and rows(both.coordinate(1))[0] == [2 * float(i * i) for i in range(10)]
    assert squares.equals(squares) and not squares.equals(squares + 1)
    assert {r["id"]: r["equal"] for r in squares.same_as(squares).collect()} == {0: True, 1: True}
    assert squares.concatenate(squares).df.count() == 4
    back = Curves.from_long(squares.long(), squares.meta)
    assert rows(back) == rows(squares)
    taken = squares.take(spark.createDataFrame([(0,), (0,), (9,)], "id bigint"))
    assert taken.df.count() == 3 and {r["id"]: r["missing"] for r in taken.isna().collect()} == {0: False, 9: True}


def test_rows_of_other_lengths_and_nulls_are_left_out(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (None, [1.0, 2.0]), (4, [float("nan"), 1.0])], "k bigint, x array<double>")
    c = Curves.from_arrays(df, "k", "x", GridMeta.of([0.0, 1.0]))
    assert rows(c) == {1: [1.0, 2.0], 4: [None, 1.0]}
    empty = Curves.from_arrays(df.where("k > 99"), "k", "x", GridMeta.of([0.0, 1.0]))
    assert empty.integrate().count() == 0 and empty.evaluate([0.5]).df.count() == 0


def test_shift_and_compose(spark, squares):
    assert np.allclose(rows(squares.shift(0.5))[0][:3], [0.5, 2.5, 6.5])
    each = squares.shift(F.col("id") * 0.5)
    assert np.allclose(rows(each)[1][:2], [72.5, 56.5])
    inner = Curves.from_literals(spark, [[0.5, 1.5], [0.5, 2.5]], GridMeta.of([0.0, 1.0]))
    assert np.allclose(rows(squares.compose(inner))[1], [72.5, 42.5])


def test_derivative_and_basis(spark):
    x = np.linspace(0, 1, 30)
    c = Curves.from_literals(spark, [x**2, np.ones(30)], GridMeta.of(x))
    assert np.allclose(rows(c.derivative())[0], 2 * x)
    b = c.to_basis(MonomialBasis((0.0, 1.0), 3))
    coef = {r["id"]: r["coef"] for r in b.df.collect()}
    assert np.allclose(coef[0], [0, 0, 1], atol=1e-9)
    assert {r["id"]: r["integral"] for r in b.integrate().collect()}[0] == pytest.approx(1 / 3)
    assert np.allclose(rows(b.derivative().to_grid([0.0, 0.5]))[0], [0, 1], atol=1e-8)
    assert {r["id"]: r["inner"] for r in b.inner_product(b).collect()}[0] == pytest.approx(1 / 5)
    assert np.allclose(rows(c.to_basis(BSplineBasis((0.0, 1.0), 6)).to_basis(BSplineBasis((0.0, 1.0), 6)).to_grid([0.3]))[0], [0.09])
    with pytest.raises(ValueError):
        b + c.to_basis(MonomialBasis((0.0, 1.0), 2))


def test_fill_missing(spark):
    meta = GridMeta.of([0.0, 1.0, 2.0, 4.0, 5.0])
    c = Curves.from_literals(spark, [[None, 1, None, 4, None], [None] * 5, [1, 2, 3, 4, 5], [None, None, 7, None, None]], meta)
    got = rows(fill_missing(c))
    assert got[0] == [1.0, 1.0, 2.0, 4.0, 4.0] and got[1] == [None] * 5 and got[2] == [1.0, 2.0, 3.0, 4.0, 5.0] and got[3] == [7.0] * 5


def test_irregular(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 1.0), (1, 2.0, 4.0), (1, 3.0, 9.0), (2, 0.0, 5.0), (2, 2.0, 1.0), (3, 1.0, None), (None, 1.0, 1.0)], "id bigint, t double, v double")
    i = Irregular.from_frame(df, "id", "t", "v")
    area = {r["id"]: r["integral"] for r in i.integrate().collect()}
    assert area[1] == pytest.approx(9) and area[2] == pytest.approx(6)
    assert {r["id"]: r["integral"] for r in i.trapezoid().collect()}[1] == pytest.approx(9.5)
    at = {(r["id"], r["t"]): r["v"] for r in i.evaluate([0.5, 2.5]).collect()}
    assert at[(1, 0.5)] == 0.5 and at[(2, 0.5)] == 4.0 and at[(2, 2.5)] is None
    assert {r["id"]: r["missing"] for r in i.isna().collect()} == {1: False, 2: False, 3: True}
    assert i.to_grid().count() == 3 * 4
    only = Irregular(i.df.where("id < 3"))
    assert sorted((r["t"], r["value"]) for r in only.sum().collect()) == [(0.0, 5.0), (2.0, 5.0)]
    coef = {r["id"]: r["coef"] for r in only.to_basis(MonomialBasis((0.0, 3.0), 3)).df.collect()}
    assert np.allclose(coef[1], [0, 0, 1], atol=1e-8)
    assert FourierBasis((0.0, 3.0), 3).columns(F.col("t"))
