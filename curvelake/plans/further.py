"""More queries over the data folder's tables, with the SQL they must equal: arithmetic, bases, kernels, covariances, scores."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake import numerics as nm
from curvelake.basis import BSplineBasis, ConstantBasis, FourierBasis, GridBasis, MonomialBasis, TensorBasis, VectorBasis
from curvelake.frames import Curves
from curvelake.functions import covariances as cv
from curvelake.meta import GridMeta
from curvelake.operators import classification as cl
from curvelake.operators import features as ft
from curvelake.operators import inference as nf
from curvelake.operators import linear as ln
from curvelake.operators import reduction as rd
from curvelake.operators import regression as rr
from curvelake.operators import registration as rg
from curvelake.operators import scoring as sc
from curvelake.operators import smoothing as sm
from curvelake.plans.queries import E, I, O, S, U, WE, WS, _matrix, _r, _values
from curvelake.sources.tables import E_GRID, S_GRID, customer_orders, embeddings, supplier_months, user_hours, user_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return put


def _side_by_side(keys: list[str], **frames) -> DataFrame:
    """Frames with ``v`` by the same keys, as columns."""
    out = None
    for name, (df, digits) in frames.items():
        one = df.select(*keys, _r("v", digits).alias(name))
        out = one if out is None else out.join(one, keys)
    return out


# -- arithmetic of the three encodings ------------------------------------------------------------
@query(f"""with {E} select a.id, a.pos, round(a.v + b.v, 6) as added, round(a.v - b.v, 6) as less, round(a.v * b.v, 6) as times, round(a.v / (b.v + 3), 6) as parts, round(-a.v, 6) as negative,
    round(2 - a.v, 6) as other_less, round(1 / (a.v + 3), 6) as inverse, round(1 + a.v, 6) as other_added, round(2 * a.v, 6) as doubled from e a join e b on a.id = b.id and b.pos = 63 - a.pos""")
def arithmetic_curves(spark, d):
    e = embeddings(spark, d)
    b = e.with_df(e.df.withColumn("data", F.reverse("data")))
    made = {"added": e + b, "less": e - b, "times": e * b, "parts": e / (b + 3), "negative": -e, "other_less": 2 - e, "inverse": 1 / (e + 3), "other_added": 1 + e, "doubled": 2 * e}
    return _side_by_side(["id", "pos"], **{k: (c.long(), 6) for k, c in made.items()})


@query(f"with {S} select id, pos, round(sqrt(v), 4) as root, round(log10(v + 1), 6) as tens, round(log2(v + 1), 6) as twos, round(ln(v + 1), 6) as natural, round(round_even(v, 0), 0) as whole from s")
def arithmetic_functions(spark, d):
    s = supplier_months(spark, d)
    made = {"root": (s.sqrt(), 4), "tens": ((s + 1).log10(), 6), "twos": ((s + 1).log2(), 6), "natural": ((s + 1).log(), 6), "whole": (s.round(), 0)}
    return _side_by_side(["id", "pos"], **{k: (c.long(), n) for k, (c, n) in made.items()})


@query(f"""with {O} select id, t, round(v + t, 4) as added, round(v - t, 4) as less, round(v * t / 1000, 7) as times, round(v / (t + 1), 4) as parts, round(-v, 4) as negative, round(10 - v, 4) as other_less,
    round(1e6 / v, 5) as inverse, round(round_even(v, -1), 0) as tens from o""")
def arithmetic_irregular(spark, d):
    o = customer_orders(spark, d)
    t = o.map(lambda v: F.col("t"))
    made = {"added": (o + t, 4), "less": (o - t, 4), "times": (o * t / 1000, 7), "parts": (o / (t + 1), 4), "negative": (-o, 4), "other_less": (10 - o, 4), "inverse": (1e6 / o, 5), "tens": (o.round(-1), 0)}
    return _side_by_side(["id", "t"], **{k: (c.df, n) for k, (c, n) in made.items()})


_WAVES = FourierBasis((0.0, 1.0), 7)
_COEF = f"{_matrix(_WAVES.fit_matrix(E_GRID.points))}, c as (select id, i as k, sum(v * c) as c from e join m using (pos) group by id, i)"


@query(f"""with {E}, {_COEF}, b as (select id, i as k, sum(v * c) as c from (select id, 63 - pos as pos, v from e) join m using (pos) group by id, i)
    select id, k, round(c.c + b.c, 6) as added, round(c.c - b.c, 6) as less, round(3 * c.c, 6) as times, round(c.c / 4, 6) as parts, round(-c.c, 6) as negative from c join b using (id, k)""")
def arithmetic_basis(spark, d):
    e = embeddings(spark, d)
    a, b = e.to_basis(_WAVES), e.with_df(e.df.withColumn("data", F.reverse("data"))).to_basis(_WAVES)
    flat = lambda c: c.df.select("id", F.posexplode("coef").alias("k", "v"))
    return _side_by_side(["id", "k"], **{n: (flat(c), 6) for n, c in {"added": a + b, "less": a - b, "times": a * 3, "parts": a / 4, "negative": -a}.items()})


@query(f"with {E}, {_COEF} select k, round(sum(c), 5) as total, round(avg(c), 6) as mean from c group by k")
def basis_statistics(spark, d):
    c = embeddings(spark, d).to_basis(_WAVES)
    return c.sum().select("k", _r("value", 5).alias("total")).join(c.mean().select("k", _r("value").alias("mean")), "k")


@query(f"with {E}, {_COEF} select a.k as i, b.k as j, round(covar_pop(a.c, b.c), 6) as value from c a join c b using (id) group by 1, 2")
def basis_covariance(spark, d):
    m = embeddings(spark, d).to_basis(_WAVES).coefficient_covariance()
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(7) for j in range(7)], "i int, j int, value double").select("i", "j", _r("value").alias("value"))


@query(f"""with {E}, {_COEF}, b as (select id, i as k, sum(v * c) as c from (select id, 63 - pos as pos, v from e) join m using (pos) group by id, i)
    select id, round(sum(c.c * b.c), 6) as inner from c join b using (id, k) group by id""")
def basis_inner(spark, d):
    e = embeddings(spark, d)
    b = e.with_df(e.df.withColumn("data", F.reverse("data"))).to_basis(_WAVES)
    return e.to_basis(_WAVES).inner_product(b).select("id", _r("inner").alias("inner"))


_SPLINES = BSplineBasis((0.0, 1.0), 10)
_SLOPES = _SPLINES(np.linspace(0, 1, 21), 1) @ _SPLINES.fit_matrix(E_GRID.points)


@query(f"with {E}, {_matrix(_SLOPES)} select id, i as pos, round(sum(v * c), 4) as v from e join m using (pos) group by id, i")
def basis_derivative(spark, d):
    c = embeddings(spark, d).to_basis(_SPLINES).derivative().to_grid(np.linspace(0, 1, 21))
    return c.long().select("id", "pos", _r("v", 4).alias("v"))


@query(f"with {E}, {_COEF} select id, k, round(c, 5) as coef from c")
def basis_to_basis(spark, d):
    wide = FourierBasis((0.0, 1.0), 11)
    back = embeddings(spark, d).to_basis(_WAVES).to_basis(wide).to_basis(_WAVES)
    return back.df.select("id", F.posexplode("coef").alias("k", "c")).select("id", "k", _r("c", 5).alias("coef"))


@query(f"with {E}, {_COEF} select id, count(*) filter (where k < 3) as parts, round(sum(c) filter (where k < 3), 5) as total from c group by id")
def basis_coefficients(spark, d):
    c = embeddings(spark, d).to_basis(_WAVES)
    return c.concatenate(c.where("id < 0")).coefficients(3).select("id", F.size("coef").alias("parts"), _r(F.aggregate("coef", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


_MOVED = _SPLINES.fit_matrix(np.linspace(0, 1, 501)) @ _SPLINES(np.clip(np.linspace(0, 1, 501) + 0.2, 0, 1)) @ _SPLINES.fit_matrix(E_GRID.points)


@query(f"with {E}, {_matrix(_MOVED)} select id, i as k, round(sum(v * c), 5) as coef from e join m using (pos) group by id, i")
def basis_shift(spark, d):
    c = embeddings(spark, d).to_basis(_SPLINES).shift(0.2)
    return c.df.select("id", F.posexplode("coef").alias("k", "c")).select("id", "k", _r("c", 5).alias("coef"))


@query("""with n as (select unnest(range(4)) as i), m as (select a.i, b.i as j from n a cross join n b)
    select 'monomial' as name, i, j, round(1.0 / (i + j + 1), 8) as gram, round(case when i >= 1 and j >= 1 then i * j / (i + j - 1.0) else 0 end, 6) as first, round(case when i >= 2 and j >= 2 then i * (i - 1) * j * (j - 1) / (i + j - 3.0) else 0 end, 5) as second from m
    union all select 'fourier', i, j, case when i = j then 1.0 else 0.0 end, case when i = j and i > 0 then round(power(2 * pi() * ((i + 1) // 2), 2), 6) else 0.0 end, case when i = j and i > 0 then round(power(2 * pi() * ((i + 1) // 2), 4), 5) else 0.0 end from (select a.i, b.i as j from (select unnest(range(5)) as i) a cross join (select unnest(range(5)) as i) b)
    union all select 'constant', 0, 0, 1.0, 0.0, 0.0""")
def basis_penalties(spark, d):
    rows = []
    for name, b in (("monomial", MonomialBasis((0.0, 1.0), 4)), ("fourier", FourierBasis((0.0, 1.0), 5)), ("constant", ConstantBasis((0.0, 1.0)))):
        parts = b.gram(), b.penalty(1), b.penalty(2)
        rows += [(name, i, j, *[float(p[i, j]) for p in parts]) for i in range(b.n_basis) for j in range(b.n_basis)]
    df = spark.createDataFrame(rows, "name string, i int, j int, gram double, first double, second double")
    return df.select("name", "i", "j", *[(_r(c, n) + 0.0).alias(c) for c, n in (("gram", 8), ("first", 6), ("second", 5))])


@query("""with n as (select unnest(range(6)) as k), m as (select a.k as i, b.k as j from n a cross join n b)
    select 'tensor' as name, i, j, round(1.0 / (i // 2 + j // 2 + 1) * (1.0 / (i % 2 + j % 2 + 1)), 8) as gram from m
    union all select 'vector', i, j, round(case when i < 3 and j < 3 then 1.0 / (i + j + 1) when i >= 3 and j >= 3 then 1.0 / (i - 3 + j - 3 + 1) else 0.0 end, 8) from m""")
def basis_products(spark, d):
    line, cube = MonomialBasis((0.0, 1.0), 2), MonomialBasis((0.0, 1.0), 3)
    rows = [(name, i, j, float(g[i, j])) for name, g in (("tensor", TensorBasis((cube, line)).gram()), ("vector", VectorBasis((cube, cube)).gram())) for i in range(6) for j in range(6)]
    return spark.createDataFrame(rows, "name string, i int, j int, gram double").select("name", "i", "j", _r("gram", 8).alias("gram"))


# -- slicing, comparing, joining sets -------------------------------------------------------------
@query(f"with {E} select id, pos, round(v, 6) as v from e where id % 2 = 0 union all select id, pos, round(2 * v, 6) from e where id % 2 = 1")
def sets_concatenated(spark, d):
    e = embeddings(spark, d)
    return e.where("id % 2 = 0").concatenate(e.where("id % 2 = 1") * 2).long().select("id", "pos", _r("v").alias("v"))


@query(f"with {E} select id, count(*) filter (where a <> v) = 0 as equal from (select id, v, lag(v, 0) over (partition by id order by pos) + (case when id % 3 = 0 then 1 else 0 end) as a from e) group by id")
def sets_compared(spark, d):
    e = embeddings(spark, d)
    other = e.with_df(e.df.withColumn("data", F.transform("data", lambda x: F.when(F.col("id") % 3 == 0, x + 1).otherwise(x))))
    return e.same_as(other)


@query(f"with {E} select id, pos, round(v, 6) as first, round(v * v, 6) as second from e")
def coordinates_split(spark, d):
    e = embeddings(spark, d)
    both = e.stack_coordinates(e * e)
    return _side_by_side(["id", "pos"], first=(both.coordinate(0).long(), 6), second=(both.coordinate(1).long(), 6))


_AT = np.array([0.11, 0.42, 0.73])
_CUBIC = nm.spline_matrix(E_GRID.points, _AT, 3)


@query(f"""with {E}, {_matrix(_CUBIC)} select id, i as pos, 0 as coordinate, round(sum(v * c), 6) as v from e join m using (pos) group by id, i
    union all select id, i, 1, round(sum((v * v + 1) * c), 6) from e join m using (pos) group by id, i""")
def evaluate_coordinates(spark, d):
    e = embeddings(spark, d)
    cells = e.stack_coordinates(e * e + 1).evaluate(_AT, degree=3).long()
    return cells.select("id", (F.col("pos") / 2).cast("int").alias("pos"), (F.col("pos") % 2).alias("coordinate"), _r("v").alias("v"))


_EIGHT = GridMeta.of((np.arange(8.0), np.arange(8.0)))
_NEW = (np.array([0.5, 3.25, 6.9]), np.array([1.2, 5.5]))
_SURFACE = np.kron(nm.spline_matrix(np.arange(8.0), _NEW[0], 3), nm.spline_matrix(np.arange(8.0), _NEW[1], 1))


@query(f"with {E}, {_matrix(_SURFACE)} select id, i as pos, round(sum(v * c), 6) as v from e join m using (pos) group by id, i")
def evaluate_surface(spark, d):
    surfaces = Curves(embeddings(spark, d).df.select("id", "data"), _EIGHT)
    return surfaces.evaluate_grid(_NEW, degree=(3, 1)).long().select("id", "pos", _r("v").alias("v"))


_VOLUME = np.kron(nm.simpson_weights(np.arange(8.0)), nm.simpson_weights(np.arange(8.0)))


@query(f"with {E}, w(pos, w) as (select * from {_values(range(64), _VOLUME)}) select id, round(sum(v * w), 5) as integral from e join w using (pos) group by id")
def integral_surface(spark, d):
    return Curves(embeddings(spark, d).df.select("id", "data"), _EIGHT).integrate().select("id", _r("integral", 5).alias("integral"))


@query(f"""with {U}, n as (select id, count(v) as n from u group by id) select u.id, u.pos as t, round(v, 4) as v from u join n using (id) where n >= 20 and pos in (select pos from u join n using (id) where n >= 20 and v is not null)""")
def irregular_to_curves(spark, d):
    u = user_hours(spark, d)
    full = u.where(F.size(F.filter("data", lambda x: x.isNotNull())) >= 20).to_irregular()
    return full.to_grid().select("id", F.col("t").cast("int").alias("t"), _r("v", 4).alias("v"))


@query(f"with {O} select id, round(t - 0.5, 6) as t, round(v, 4) as v from o where id % 2 = 0 union all select id, round(t, 6), round(v, 4) from o where id % 2 = 1")
def irregular_moved(spark, d):
    o = customer_orders(spark, d)
    made = o.where("id % 2 = 0").shift(0.5).concatenate(o.where("id % 2 = 1"))
    return made.df.select("id", _r("t").alias("t"), _r("v", 4).alias("v"))


@query(f"with {U}, n as (select count(*) as n from (select id from u group by id having count(v) = 24)) select cast(u.pos as double) as t, round(var_pop(v), 4) as value from u where id in (select id from u group by id having count(v) = 24) group by pos")
def irregular_variance(spark, d):
    u = user_hours(spark, d)
    return u.where(F.forall("data", lambda x: x.isNotNull())).to_irregular().var().select("t", _r("value", 4).alias("value"))


@query(f"with {I} select id, count(v) = 0 as missing from i group by id")
def irregular_missing(spark, d):
    return user_stream(spark, d).isna()


_SIMPSON = """p as (select id, t, v, row_number() over w - 1 as k, count(*) over (partition by id) as n, lead(t, 1) over w as t1, lead(t, 2) over w as t2, lead(v, 1) over w as v1, lead(v, 2) over w as v2 from i window w as (partition by id order by t)),
    h as (select *, t1 - t as a, t2 - t1 as b from p),
    q as (select id, case when n = 2 and k = 0 then a * (v + v1) / 2 when n < 3 then 0 else
        case when k % 2 = 0 and k + 2 < (case when n % 2 = 1 then n else n - 1 end) then (a + b) / 6 * (v * (2 - b / a) + v1 * (a + b) * (a + b) / (a * b) + v2 * (2 - a / b)) else 0 end
        + case when n % 2 = 0 and k = n - 3 then v2 * (2 * b * b + 3 * a * b) / (6 * (a + b)) + v1 * (b * b + 3 * a * b) / (6 * a) - v * b * b * b / (6 * a * (a + b)) else 0 end end as part from h)"""


@query(f"with {I}, {_SIMPSON} select id, round(sum(part), 3) as integral from q group by id having count(part) > 0")
def irregular_simpson(spark, d):
    return user_stream(spark, d).integrate().where("integral is not null").select("id", _r("integral", 3).alias("integral"))


# -- kernels, covariances, smoothing scores -------------------------------------------------------
_KERNELS = {
    "normal": "exp(-u * u / 2)", "cosine": "case when u <= 1 then cos(pi() / 2 * u) else 0 end", "epanechnikov": "case when u <= 1 then 1 - u * u else 0 end",
    "tri_weight": "case when u <= 1 then power(1 - u * u, 3) else 0 end", "quartic": "case when u <= 1 then power(1 - u * u, 2) else 0 end", "uniform": "case when u <= 1 then 1.0 else 0.0 end",
}


@query(f"with {S}, g as (select a.i, b.i as pos, abs(a.i - b.i) / 2.5 as u from (select unnest(range(12)) as i) a cross join (select unnest(range(12)) as i) b), k as ("
    + " union all ".join(f"select '{n}' as kernel, i, pos, {f} as w from g" for n, f in _KERNELS.items())
    + ") select kernel, id, i as pos, round(sum(w * v) / sum(w), 3) as v from s join k using (pos) group by 1, 2, 3")
def smooth_kernels(spark, d):
    s = supplier_months(spark, d)
    parts = [sm.smooth(s, sm.NadarayaWatson(2.5, k)).long().select(F.lit(k).alias("kernel"), "id", "pos", _r("v", 3).alias("v")) for k in _KERNELS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_COVS = {
    "brownian": (cv.Brownian(2.0), "2 * least(x, y)"), "linear": (cv.Linear(2.0, 0.5), "2 * (x * y + 0.5)"), "polynomial": (cv.Polynomial(1.5, 0.5, 2.0, 3.0), "1.5 * power(2 * x * y + 0.5, 3)"),
    "gaussian": (cv.Gaussian(2.0, 0.3), "2 * exp(-(x - y) * (x - y) / 0.18)"), "exponential": (cv.Exponential(2.0, 0.3), "2 * exp(-abs(x - y) / 0.3)"),
    "white_noise": (cv.WhiteNoise(2.0), "case when i = j then 2.0 else 0.0 end"),
    "matern_three_halves": (cv.Matern(2.0, 0.3, 1.5), "2 * (1 + sqrt(3) * abs(x - y) / 0.3) * exp(-sqrt(3) * abs(x - y) / 0.3)"),
    "matern_five_halves": (cv.Matern(2.0, 0.3, 2.5), "2 * (1 + sqrt(5) * abs(x - y) / 0.3 + 5 * (x - y) * (x - y) / 0.27) * exp(-sqrt(5) * abs(x - y) / 0.3)"),
}


@query("with g as (select a.i, b.i as j, a.i / 10.0 as x, b.i / 10.0 as y from (select unnest(range(11)) as i) a cross join (select unnest(range(11)) as i) b) "
    + " union all ".join(f"select '{n}' as name, i, j, round({f}, 7) as value from g" for n, (_, f) in _COVS.items()))
def covariance_functions(spark, d):
    x = np.arange(11) / 10
    rows = [(n, i, j, float(m[i, j])) for n, (c, _) in _COVS.items() for m in (c(x),) for i in range(11) for j in range(11)]
    return spark.createDataFrame(rows, "name string, i int, j int, value double").select("name", "i", "j", _r("value", 7).alias("value"))


_BLEND = nm.linear_matrix(S_GRID.points, [1.5, 6.25, 11.0])


@query(f"with {S}, {_matrix(_BLEND)}, c as (select a.pos as p, b.pos as q, covar_pop(a.v, b.v) as c from s a join s b using (id) group by 1, 2) select a.i, b.i as j, round(sum(a.c * b.c * c.c) / 1e6, 2) as value from c join m a on a.pos = c.p join m b on b.pos = c.q group by 1, 2")
def covariance_empirical(spark, d):
    from curvelake.operators.stats import covariance

    k = cv.Empirical(tuple(S_GRID.points), covariance(supplier_months(spark, d)))([1.5, 6.25, 11.0])
    return spark.createDataFrame([(i, j, float(k[i, j]) / 1e6) for i in range(3) for j in range(3)], "i int, j int, value double").select("i", "j", _r("value", 2).alias("value"))


_HAT = sm.NadarayaWatson(1.5).hat(S_GRID.points)


@query(f"""with {S}, {_matrix(np.eye(12) - _HAT)}, h(pos, h) as (select * from {_values(range(12), np.diag(_HAT))}), r as (select id, i, sum(v * c) as e from s join m using (pos) group by 1, 2), t as (select avg(h) as t from h),
    z as (select avg(e * e) as z, avg(power(e / (1 - h), 2)) as loo from r join h on h.pos = r.i)
    select round(-loo / 1e6, 3) as leave_one_out, round(-z * exp(2 * t) / 1e6, 3) as akaike, round(-z * (1 + t) / (1 - t) / 1e6, 3) as finite_prediction_error, round(-z * (1 + 2 * t) / 1e6, 3) as shibata, round(-z / (1 - 2 * t) / 1e6, 3) as rice from z, t""")
def smooth_scores(spark, d):
    s, k = supplier_months(spark, d), sm.NadarayaWatson(1.5)
    got = [sm.leave_one_out_score(s, k), *[sm.gcv_score(s, k, n) for n in ("akaike", "finite_prediction_error", "shibata", "rice")]]
    names = ["leave_one_out", "akaike", "finite_prediction_error", "shibata", "rice"]
    return spark.createDataFrame([[float(x) / 1e6 for x in got]], ", ".join(f"{n} double" for n in names)).select(*[_r(n, 3).alias(n) for n in names])


# -- scores ---------------------------------------------------------------------------------------
@query(f"with {S}, {WS}, m as (select pos, avg(v) as m from s group by pos), z as (select pos, avg(power(ln(1 + v) - ln(1 + m), 2)) as z from s join m using (pos) group by pos) select round(sum(z * w) / 11, 6) as score from z join w using (pos)")
def scores_logarithmic(spark, d):
    s = supplier_months(spark, d)
    mean = [r["v"] for r in s.long().groupBy("pos").agg(F.avg("v").alias("v")).orderBy("pos").collect()]
    pred = s.with_df(s.df.withColumn("data", F.array(*[F.lit(v) for v in mean])))
    return sc.pointwise_error(s, pred, "squared_log").select(_r("score").alias("score"))


_IRR = """p as (select id, t, e, lead(t) over w as t1, lead(e) over w as e1 from x window w as (partition by id order by t)),
    q as (select id, sum((t1 - t) * (e + e1) / 2) as area, max(t) - min(t) as span, avg(e) as flat from p group by id) select round(avg(case when span > 0 then area / span else flat end), 5) as score from q"""


@query(" union all ".join(f"select '{k}' as kind, score from (with {I}, x as (select id, t, {f} as e from i) , {_IRR})" for k, f in {
    "squared": "power(v - abs(v) * 1.5, 2)", "absolute": "abs(v - abs(v) * 1.5)", "percentage": "abs(v - abs(v) * 1.5) / greatest(abs(v), 2.220446049250313e-16)", "squared_log": "power(ln(1 + abs(v)) - ln(1 + abs(v) * 1.5), 2)"}.items()))
def scores_irregular(spark, d):
    i = user_stream(spark, d)
    size = i.map(F.abs)
    pred = size * 1.5
    made = None
    for kind in ("squared", "absolute", "percentage", "squared_log"):
        one = sc.irregular_error(size if kind == "squared_log" else i, pred, kind).select(F.lit(kind).alias("kind"), _r("score", 5).alias("score"))
        made = one if made is None else made.unionByName(one)
    return made


_FINE = np.linspace(0, 1, 201)


@query(f"""with {E}, {_matrix(_WAVES(_FINE) @ _WAVES.fit_matrix(E_GRID.points))}, w(pos, w) as (select * from {_values(range(201), nm.simpson_weights(_FINE))}), f as (select id, i as pos, sum(v * c) as v from e join m using (pos) group by 1, 2),
    k as (select pos, avg(v) as m from f group by pos), z as (select pos, avg(abs(v - m)) as mae, avg(power(v - m, 2)) as mse, 1 - avg(power(v - m, 2)) / var_pop(v) as r2, 1 - (avg(power(v - m, 2)) - power(avg(v - m), 2)) / var_pop(v) as ev, avg(abs(v - m) / greatest(abs(v), 2.220446049250313e-16)) as mape from f join k using (pos) group by pos)
    select round(sum(mae * w), 6) as absolute, round(sum(mse * w), 6) as squared, round(sum(r2 * w), 6) as r2, round(sum(ev * w), 6) as explained, round(sum(mape * w) / 10, 2) as percentage from z join w using (pos)""")
def scores_basis(spark, d):
    c = embeddings(spark, d).to_basis(_WAVES)
    mean = [r["value"] for r in c.mean().orderBy("k").collect()]
    pred = type(c)(c.df.withColumn("coef", F.array(*[F.lit(v) for v in mean])), _WAVES)
    got = {k: sc.basis_score(c, pred, k, 201).first()["score"] for k in ("absolute", "squared", "r2", "explained", "percentage")}
    got["percentage"] /= 10
    return spark.createDataFrame([tuple(map(float, got.values()))], ", ".join(f"{k} double" for k in got)).select(*[_r(k, 2 if k == "percentage" else 6).alias(k) for k in got])


@query(f"""with {E}, {WE}, m as (select label, pos, avg(v) as m from e group by 1, 2), dd as (select e.id, any_value(e.label) as label, m.label as p, round(sqrt(sum((v - m) * (v - m) * w)), 10) as d from e join m using (pos) join w using (pos) group by 1, m.label),
    b as (select id, any_value(label) as label, arg_min(p, (d, p)) as p from dd group by id) select round(avg(case when label = p then 1.0 else 0.0 end), 6) as accuracy, round(1 - sum(power(label - p, 2)) / (var_pop(label) * count(*)), 6) as r2 from b""")
def scores_labels(spark, d):
    e = embeddings(spark, d)
    both = e.df.select("id", "label").join(cl.nearest_centroid(e, e, "label"), "id")
    return sc.accuracy(both, "label", "predicted").crossJoin(sc.scalar_r2(both, "label", "predicted")).select(_r("accuracy").alias("accuracy"), _r("r2").alias("r2"))


# -- registration ---------------------------------------------------------------------------------
@query(f"""with {S}, p as (select id, arg_max(pos, (v, -pos)) + 1.0 as peak from s group by id), c as (select avg(peak) as c from p), pts as (select p.id, g.pos, least(greatest(g.pos + 1 + peak - c, 1), 12) as x from p, c, (select unnest(range(12)) as pos) g),
    k as (select id, pos, x, least(cast(floor(x) as int), 11) as lo from pts) select k.id, k.pos, round(a.v + (b.v - a.v) * (x - lo), 5) as v from k join s a on a.id = k.id and a.pos = lo - 1 join s b on b.id = k.id and b.pos = lo""")
def landmark_shifted(spark, d):
    s = supplier_months(spark, d)
    peak = F.array_position("data", F.array_max("data")).cast("double")
    return rg.landmark_shift(s.with_df(s.df.withColumn("peak", peak)), "peak", extrapolation="bounds").long().select("id", "pos", _r("v", 5).alias("v"))


@query(f"""with {S}, {WS}, n as (select count(distinct id) as n from s), lo as (select id, pos, v, cast(floor(least(pos + 1.3, 12)) as int) as k, least(pos + 1.3, 12) as x from s),
    y as (select a.id, a.pos, b.v + (c.v - b.v) * (x - least(k, 11)) as v from lo a join s b on b.id = a.id and b.pos = least(k, 11) - 1 join s c on c.id = a.id and c.pos = least(k, 11)),
    tx as (select sum(v * v * w) as t from s join w using (pos)), ty as (select sum(v * v * w) as t from y join w using (pos)), mx as (select pos, avg(v) as m from s group by pos), my as (select pos, avg(v) as m, var_pop(v) as s from y group by pos),
    z as (select tx.t / ty.t as ratio, tx.t / ty.t * (select sum(s * w) from my join w using (pos)) as amplitude, tx.t / ty.t * (select sum(m * m * w) from my join w using (pos)) - (select sum(m * m * w) from mx join w using (pos)) as phase from tx, ty),
    ls as (select avg(b / a) as q from (select id, sum(power(s.v - mx.m, 2) * w) as a from s join mx using (pos) join w using (pos) group by id) join (select id, sum(power(y.v - my.m, 2) * w) as b from y join my using (pos) join w using (pos) group by id) using (id))
    select round(ratio, 6) as ratio, round(amplitude / 1e6, 2) as amplitude, round(phase / 1e6, 2) as phase, round(phase / (phase + amplitude), 6) as r2, round(1 - q, 6) as least_squares from z, ls""")
def registration_parts(spark, d):
    s = supplier_months(spark, d)
    moved = s.shift(0.3, "bounds")
    got = rg.amplitude_phase(s, moved) | {"least_squares": rg.least_squares_score(s, moved)}
    df = spark.createDataFrame([tuple(float(got[k]) for k in ("ratio", "amplitude", "phase", "r2", "least_squares"))], "ratio double, amplitude double, phase double, r2 double, least_squares double")
    return df.select(_r("ratio").alias("ratio"), *[_r(F.col(k) / 1e6, 2).alias(k) for k in ("amplitude", "phase")], _r("r2").alias("r2"), _r("least_squares").alias("least_squares"))


@query("""with p as (select user_id as id, 1.0 + user_id % 3 as k from (select distinct user_id from events)), g as (select p.id, q.pos, power(q.pos / 20.0, k) as y from p cross join (select unnest(range(21)) as pos) q) select id, pos, round(10 + 5 * y, 6) as v from g""")
def warping_normalised(spark, d):
    from curvelake.session import table

    ids = table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    grid = np.linspace(0, 1, 21)
    w = Curves(ids.withColumn("data", F.transform(F.array(*[F.lit(float(t)) for t in grid]), lambda t: F.pow(t, 1.0 + F.col("id") % 3))), GridMeta.of(grid))
    return rg.normalise_warping(w, 10.0, 15.0).long().select("id", "pos", _r("v").alias("v"))


# -- features, regression, inference, classification ----------------------------------------------
@query(f"with {E}, {WE}, a as (select label, pos, avg(v) as m from e where label < 3 group by 1, 2), x as (select e.id, a.label, sqrt(sum(power(v - m, 2) * w)) as d from e join a using (pos) join w using (pos) group by 1, a.label) select id, round(max(d) filter (where label = 0), 6) as distance_0, round(max(d) filter (where label = 1), 6) as distance_1, round(max(d) filter (where label = 2), 6) as distance_2 from x group by id")
def features_per_class(spark, d):
    from curvelake.operators.metrics import distances_to
    from curvelake.operators.stats import moments

    e = embeddings(spark, d)
    few = e.with_df(e.df.withColumn("class", F.when(F.col("label") < 3, F.col("label"))))
    made = ft.per_class(few, "class", lambda own, all_: distances_to(all_, moments(own)[1], "distance").select("id", "distance"))
    return made.select("id", *[_r(f"distance_{k}").alias(f"distance_{k}") for k in range(3)])


@query(f"with {E}, x as (select id, list(round(v, 6) order by pos) as l from e where pos in (0, 21, 42, 63) group by id) select id, l[1] as a, l[2] as b, l[3] as c, l[4] as d from x")
def features_evaluated(spark, d):
    v = ft.values_at(embeddings(spark, d), [0.0, 1 / 3, 2 / 3, 1.0])
    return v.select("id", *[_r(F.get("values", F.lit(i))).alias(n) for i, n in enumerate("abcd")])


@query(f"with {E}, {WE}, x as (select id, any_value(label) as y, sum(v * w) as z from e join w using (pos) group by id), k as (select regr_slope(y, z) as b, regr_intercept(y, z) as a from x) select id, round(a + b * z, 6) as predicted from x, k")
def regress_linear_constant(spark, d):
    e = embeddings(spark, d)
    return rr.linear_regression(e, "label", ConstantBasis((0.0, 1.0))).predict(e).select("id", _r("predicted").alias("predicted"))


@query(f"with {E}, k as (select pos, regr_slope(v, label) as b, regr_intercept(v, label) as a from e group by pos) select 0 as term, pos, round(a, 6) as value from k union all select 1, pos, round(b, 6) from k")
def regress_function_on_scalar(spark, d):
    c = rr.function_on_scalar(embeddings(spark, d), ["label"])
    return spark.createDataFrame([(i, j, float(c[i, j])) for i in range(2) for j in range(64)], "term int, pos int, value double").select("term", "pos", _r("value").alias("value"))


@query(f"""with {E}, {WE}, n as (select label, count(distinct id) as n from e group by 1), m as (select label, pos, avg(v) as m from e group by 1, 2)
    select round(sum(power(a.m - b.m * sqrt(na.n * 1.0 / nb.n), 2) * w), 6) as statistic from m a join m b on a.pos = b.pos and a.label < b.label join n na on na.label = a.label join n nb on nb.label = b.label join w on w.pos = a.pos""")
def anova_asymptotic(spark, d):
    e = embeddings(spark, d)
    rows = {r["label"]: (r["n"], r["m"]) for r in e.df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.get("data", F.lit(i))) for i in range(64)]).alias("m")).orderBy("label").collect()}
    got = nf.v_asymptotic([np.array(m) for _, m in rows.values()], [n for n, _ in rows.values()], e.weights())
    return spark.createDataFrame([(float(got),)], "statistic double").select(_r("statistic").alias("statistic"))


@query(f"""with {E}, {WE}, n as (select label, count(distinct id) as n from e group by 1), c as (select id, label, pos, v, rank() over (partition by label, pos order by v) - 1 as b, rank() over (partition by label, pos order by v desc) - 1 as a, n.n from e join n using (label)),
    dp as (select id, label, any_value(n) as n, round(sum((1 - (b * (b - 1) / 2.0 + a * (a - 1) / 2.0) / (n * (n - 1) / 2.0)) * w), 10) as depth from c join w using (pos) group by 1, 2),
    keep as (select id, label from (select *, row_number() over (partition by label order by depth desc, id) as r from dp) where r <= n - cast(floor(n * 0.2) as bigint)), t as (select e.label, pos, avg(v) as m from e join keep using (id) group by 1, 2),
    dd as (select e.id, t.label, round(sqrt(sum(power(v - m, 2) * w)), 10) as d from e join t using (pos) join w using (pos) group by 1, 2) select id, arg_min(label, (d, label)) as predicted, round(min(d), 6) as distance from dd group by id""")
def classify_trimmed(spark, d):
    e = embeddings(spark, d)
    return cl.dtm_classify(e, e, "label", 0.2).select("id", "predicted", _r("distance").alias("distance"))


@query(f"with {E} select id, pos, round(v, 6) as v from e")
def operator_identity(spark, d):
    return ln.matrix_operator(embeddings(spark, d), ln.identity_matrix(64)).long().select("id", "pos", _r("v").alias("v"))


@query(f"""with {E}, {WE}, x as (select id, any_value(label) as y, sum(v * w) as a, sum(v * v * w) as b from e join w using (pos) group by id),
    k as (select covar_pop(a, y) as ay, covar_pop(b, y) as yb, var_pop(a) as aa, var_pop(b) as bb, covar_pop(a, b) as ab, avg(a) as ma, avg(b) as mb, avg(y) as my from x),
    c as (select *, (ay * bb - yb * ab) / (aa * bb - ab * ab) as p, (yb * aa - ay * ab) / (aa * bb - ab * ab) as q from k)
    select id, round(my + p * (a - ma) + q * (b - mb), 6) as predicted from x, c""")
def regress_two_functions(spark, d):
    e = embeddings(spark, d)
    square = Curves((e * e).df.select("id", "data"), e.meta)
    flat = ConstantBasis((0.0, 1.0))
    predict = rr.linear_regression_terms([rr.Term(e, flat), rr.Term(square, flat)], "label")[3]
    return predict([e, square]).select("id", _r("predicted").alias("predicted"))


@query(f"""with {E}, {WE}, x as (select id, sum(v * w) as z from e join w using (pos) group by id), {_matrix(_WAVES.fit_matrix(E_GRID.points))},
    y as (select id, i as k, sum(v * c) as c from (select id, pos, v * v as v from e) join m using (pos) group by 1, 2), r as (select k, regr_slope(c, z) as b, regr_intercept(c, z) as a from y join x using (id) group by k), b(i, k, f) as (select * from {_values(*[a.ravel() for a in np.indices((64, 7))], _WAVES(E_GRID.points).ravel())})
    select id, i as pos, round(sum((a + r.b * z) * f), 6) as v from x cross join r join b using (k) group by 1, 2""")
def regress_function_on_function(spark, d):
    e = embeddings(spark, d)
    predict = rr.function_on_function(e * e, e, ConstantBasis((0.0, 1.0)), _WAVES)[2]
    return predict(e).long().select("id", "pos", _r("v").alias("v"))


@query(f"""with {S}, {WS}, c as (select dense_rank() over (order by id) - 1 as k, pos, v as c from s where id in (select id from s group by id order by id limit 3))
    select s.id, cast(k as int) as cluster, round(sqrt(sum(power(v - c, 2) * w)), 4) as distance from s join c using (pos) join w using (pos) group by 1, 2""")
def cluster_distances(spark, d):
    from curvelake.operators.clustering import centre_distances

    s = supplier_months(spark, d)
    init = np.array([r["data"] for r in s.df.orderBy("id").limit(3).collect()])
    return centre_distances(s, init).select("id", F.posexplode("distances").alias("cluster", "x")).select("id", "cluster", _r("x", 4).alias("distance"))


def _largest(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.abs(rows).max(1)


@query(f"""with {E}, q as (select * from e where id % 20 = 0), dd as (select q.id as query, e.id as neighbour, round(max(abs(q.v - e.v)), 10) as d from q join e on q.pos = e.pos where q.id <> e.id group by 1, 2),
    k as (select *, row_number() over (partition by query order by d, neighbour) as rank from dd) select query, neighbour, rank, round(d, 6) as distance from k where rank <= 5""")
def neighbours_own_norm(spark, d):
    from curvelake.operators import metrics as mt

    e = embeddings(spark, d)
    return mt.k_neighbours(e.where("id % 20 = 0"), e, 5, mt.norm_induced(_largest)).select("query", "neighbour", "rank", _r("distance").alias("distance"))


@query(f"""with {E}, {WE}, f as (select id, pos, sign(v) * sqrt(abs(v)) as v from e), q as (select * from f where id % 20 = 0), dd as (select q.id as query, f.id as neighbour, round(sqrt(sum(power(q.v - f.v, 2) * w)), 10) as d from q join f on q.pos = f.pos join w on w.pos = q.pos where q.id <> f.id group by 1, 2),
    k as (select *, row_number() over (partition by query order by d, neighbour) as rank from dd) select query, neighbour, rank, round(d, 6) as distance from k where rank <= 5""")
def neighbours_transformed(spark, d):
    from curvelake.operators import metrics as mt

    e = embeddings(spark, d)
    metric = mt.transformed(lambda x: np.sign(x) * np.sqrt(np.abs(x)))
    return mt.k_neighbours(e.where("id % 20 = 0"), e, 5, metric).select("query", "neighbour", "rank", _r("distance").alias("distance"))


_FEW = tuple(np.linspace(0, 1, 6))


@query("""with n as (select unnest(range(6)) as k), m as (select a.k as i, b.k as j from n a cross join n b)
    select i, j, round(case when i = j then case when i in (0, 5) then 0.2 / 3 else 0.4 / 3 end when abs(i - j) = 1 then 0.2 / 6 else 0 end, 9) as gram from m""")
def basis_grid(spark, d):
    g = GridBasis(points=_FEW).gram()
    return spark.createDataFrame([(i, j, float(g[i, j])) for i in range(6) for j in range(6)], "i int, j int, gram double").select("i", "j", (_r("gram", 9) + 0.0).alias("gram"))


@query(f"""with {E}, {_COEF}, k as (select a.k as p, b.k as q, covar_pop(a.c, b.c) as c from c a join c b using (id) group by 1, 2), b(i, k, f) as (select * from {_values(*[a.ravel() for a in np.indices((4, 7))], _WAVES(np.array([0.1, 0.35, 0.6, 0.85])).ravel())})
    select x.i, y.i as j, round(sum(x.f * y.f * k.c), 6) as value from k join b x on x.k = k.p join b y on y.k = k.q group by 1, 2""")
def covariance_basis(spark, d):
    k = cv.EmpiricalBasis(_WAVES, embeddings(spark, d).to_basis(_WAVES).coefficient_covariance())(np.array([0.1, 0.35, 0.6, 0.85]))
    return spark.createDataFrame([(i, j, float(k[i, j])) for i in range(4) for j in range(4)], "i int, j int, value double").select("i", "j", _r("value").alias("value"))


@query(f"with {E}, {_matrix(nm.weighted_lstsq(_SPLINES(E_GRID.points), np.eye(64), None, 1e-3 * _SPLINES.penalty(2)))} select method, id, i as k, round(sum(v * c), 5) as coef from e join m using (pos) cross join (select unnest(['qr', 'svd']) as method) group by 1, 2, 3")
def basis_solvers(spark, d):
    e, parts = embeddings(spark, d), None
    for method in ("qr", "svd"):
        matrix = nm.weighted_lstsq(_SPLINES(E_GRID.points), np.eye(64), None, 1e-3 * _SPLINES.penalty(2), method)
        one = ln.matrix_operator(e, matrix, np.arange(10) / 10).long().select(F.lit(method).alias("method"), "id", F.col("pos").alias("k"), _r("v", 5).alias("coef"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


# -- reduction, discrimination, tests -------------------------------------------------------------
@query(f"with {E} select id, pos, round(v, 6) as v from e")
def components_inverse(spark, d):
    e = embeddings(spark, d)
    whole = rd.fpca(e, min(64, e.df.count()))
    return whole.inverse_transform(whole.transform(e)).long().select("id", "pos", _r("v").alias("v"))


@query(f"with {E}, {WE}, x as (select pos, var_samp(v) as s from e group by pos) select round(sum(s * w), 6) as variance from x join w using (pos)")
def components_variance(spark, d):
    e = embeddings(spark, d)
    return spark.createDataFrame([(float(rd.fpca(e, min(64, e.df.count())).variances.sum()),)], "variance double").select(_r("variance").alias("variance"))


@query(f"""with {E}, {WE}, m as (select pos, avg(v) as m from e group by pos), y as (select avg(label) as my from (select distinct id, label from e)), b as (select pos, sqrt(greatest(any_value(w), 0)) as root, sum((v - m) * (label - my)) * sqrt(greatest(any_value(w), 0)) as b from e join m using (pos) join w using (pos), y group by pos),
    u as (select pos, root, b / sqrt(sum(b * b) over ()) as u, sqrt(sum(b * b) over ()) as size from b), z as (select id, sum(root * (v - m) * u) as z, any_value(size) as size from e join m using (pos) join u using (pos) group by id)
    select id, round(my + z * size / sum(z * z) over (), 6) as predicted from z, y""")
def components_least_squares_first(spark, d):
    e = embeddings(spark, d)
    made = rd.fpls(e, ["label"], 1).predict(e)
    value = [c for c in made.columns if c != "id"][0]
    x = F.get(value, F.lit(0)) if dict(made.dtypes)[value].startswith("array") else F.col(value)
    return made.select("id", _r(x).alias("predicted"))


@query(f"""with {E}, n as (select label, count(distinct id) as n from e group by 1), m as (select label, pos, avg(v) as m from e group by 1, 2), t as (select count(distinct id) as t from e),
    s as (select e.id, m.label, round(ln(any_value(n.n) * 1.0 / any_value(t)) - 50 * sum(power(v - m, 2)), 8) as s from e join m using (pos) join n on n.label = m.label, t group by 1, m.label) select id, arg_min(label, (-s, label)) as predicted from s group by id""")
def classify_quadratic_known(spark, d):
    e = embeddings(spark, d)
    return cl.quadratic_discriminant(e, e, "label", covariance=lambda c: 0.01 * np.eye(len(c)))


@query(f"""with {E}, x as (select id, label >= 5 as side, max(v) filter (where pos = 0) as a, max(v) filter (where pos = 1) as b from e group by 1, 2), g as (select side, count(*) as n, avg(a) as a, avg(b) as b, var_pop(a) * count(*) as aa, var_pop(b) * count(*) as bb, covar_pop(a, b) * count(*) as ab from x group by side),
    p as (select sum(n) as n, sum(aa) / (sum(n) - 2) as aa, sum(bb) / (sum(n) - 2) as bb, sum(ab) / (sum(n) - 2) as ab, max(n) filter (where side) * max(n) filter (where not side) as k, max(a) filter (where side) - max(a) filter (where not side) as da, max(b) filter (where side) - max(b) filter (where not side) as db from g)
    select round(k * 1.0 / n * (da * da * bb - 2 * da * db * ab + db * db * aa) / (aa * bb - ab * ab), 5) as t2 from p""")
def hotelling_two_points(spark, d):
    e = embeddings(spark, d).restrict(0.0, 1.5 / 63)
    return spark.createDataFrame([(float(nf.hotelling_t2(e.where("label < 5"), e.where("label >= 5"))),)], "t2 double").select(_r("t2", 5).alias("t2"))


@query(f"""with {E}, p as (select a.pos, a.id as i, b.id as j, abs(a.v - b.v) as x, abs(a.label - b.label) * 1.0 as y from e a join e b using (pos) where a.id <> b.id), n as (select count(distinct id) as n from e),
    r as (select pos, i, sum(x) as rx, sum(y) as ry from p group by 1, 2), t as (select pos, sum(rx) as tx, sum(ry) as ty from r group by pos),
    u as (select p.pos, x - a.rx / (n - 2) - b.rx / (n - 2) + tx / ((n - 1) * (n - 2)) as x, y - a.ry / (n - 2) - b.ry / (n - 2) + ty / ((n - 1) * (n - 2)) as y from p join r a on a.pos = p.pos and a.i = p.i join r b on b.pos = p.pos and b.i = p.j join t on t.pos = p.pos, n),
    d as (select pos, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) as dependence from u group by pos) select pos, dependence from d""")
def dependence_by_point(spark, d):
    got = rd.dependence(embeddings(spark, d), "label")
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(got)], "pos int, dependence double").select("pos", _r("dependence").alias("dependence"))


@query(ORACLE["dependence_by_point"].replace(" select pos, dependence from d", """, near as (select pos, dependence as x, max(dependence) over w as top, min(dependence) over w as low from d window w as (order by pos rows between 1 preceding and 1 following))
    select cast(row_number() over (order by -x, pos) - 1 as int) as rank, pos from near where x >= top and x > low order by 1 limit 5"""))
def selection_maxima(spark, d):
    return spark.createDataFrame([(i, p) for i, p in enumerate(rd.maxima_hunting(embeddings(spark, d), "label", max_points=5))], "rank int, pos int")
