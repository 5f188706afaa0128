"""One query for each family of operators over the data folder's tables, with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake import numerics as nm
from curvelake.basis import BSplineBasis, FourierBasis, MonomialBasis
from curvelake.frames import Curves
from curvelake.functions import covariances as cv
from curvelake.operators import classification as cl
from curvelake.operators import clustering as ct
from curvelake.operators import depth as dp
from curvelake.operators import features as ft
from curvelake.operators import inference as nf
from curvelake.operators import metrics as mt
from curvelake.operators import missing as ms
from curvelake.operators import reduction as rd
from curvelake.operators import registration as rg
from curvelake.operators import regression as rr
from curvelake.operators import scoring as sc
from curvelake.operators import smoothing as sm
from curvelake.operators import stats as st
from curvelake.sources import generators as gn
from curvelake.sources.tables import E_GRID, S_GRID, customer_orders, embeddings, station_days, supplier_months, user_hours, user_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _values(*columns) -> str:
    return "(values " + ", ".join("(" + ", ".join(repr(float(v)) if isinstance(v, (float, np.floating)) else str(int(v)) for v in row) + ")" for row in zip(*columns)) + ")"


def _w(meta, name: str = "w") -> str:
    w = nm.simpson_weights(meta.points)
    return f"{name}(pos, t, w) as (select * from {_values(range(len(w)), meta.points, w)})"


def _matrix(m: np.ndarray, name: str = "m") -> str:
    i, j = np.nonzero(m)
    return f"{name}(i, pos, c) as (select * from {_values(i, j, m[i, j])})"


E = "e as (select vec_id as id, label, generate_subscripts(embedding, 1) - 1 as pos, cast(unnest(embedding) as double) as v from embeddings)"
S = """s as (select a.id, p.pos, coalesce(v, 0.0) as v from (select distinct l_suppkey as id from lineitem) a
       cross join (select unnest(range(12)) as pos) p
       left join (select l_suppkey as id, month(l_shipdate) - 1 as pos, round(sum(l_extendedprice), 2) as v from lineitem group by 1, 2) x on x.id = a.id and x.pos = p.pos)"""
U = """u as (select a.id, p.pos, v from (select distinct user_id as id from events) a cross join (select unnest(range(24)) as pos) p
       left join (select user_id as id, hour(ts) as pos, round(avg(value), 6) as v from events group by 1, 2) x on x.id = a.id and x.pos = p.pos)"""
I = "i as (select user_id as id, date_diff('microsecond', timestamp '2024-01-01', ts) / 86400e6 as t, avg(value) as v from events group by 1, 2)"  # noqa: E741
O = "o as (select o_custkey as id, cast(date_diff('day', date '1990-01-01', cast(o_orderdate as date)) as double) as t, round(avg(o_totalprice), 4) as v from orders group by 1, 2)"  # noqa: E741
WE, WS = _w(E_GRID), _w(S_GRID)
MBD = """cells as (select id, pos, v, rank() over (partition by pos order by v) - 1 as below, rank() over (partition by pos order by v desc) - 1 as above, count(*) over (partition by pos) as n from e),
    mbd as (select id, sum((1 - (below * (below - 1) / 2.0 + above * (above - 1) / 2.0) / (n * (n - 1) / 2.0)) * w) as depth from cells join w using (pos) group by id)"""


def _r(c, digits: int = 6):
    return F.round(c, digits)


# -- depth and outliers ---------------------------------------------------------------------------
@query(f"with {E}, {WE}, {MBD} select id, round(depth, 6) as depth from mbd")
def depth_modified_band(spark, d):
    return dp.modified_band_depth(embeddings(spark, d)).select("id", _r("depth").alias("depth"))


@query(f"""with {E}, {WE}, c as (select id, pos, count(*) over (partition by pos order by v range between unbounded preceding and current row) as upto, count(*) over (partition by pos) as n from e)
    select id, round(sum((1 - abs(0.5 - upto / n)) * w), 6) as depth from c join w using (pos) group by id""")
def depth_integrated(spark, d):
    return dp.integrated_depth(embeddings(spark, d)).select("id", _r("depth").alias("depth"))


@query(f"""with {E}, {WE}, c as (select id, pos, rank() over (partition by pos order by v) as r, count(*) over (partition by pos) as n from e)
    select id, round(sum((n - r) / n * w), 6) as mei from c join w using (pos) group by id""")
def epigraph_index(spark, d):
    return dp.modified_epigraph_index(embeddings(spark, d)).select("id", _r("mei").alias("mei"))


@query(f"""with {S}, {WS}, m as (select pos, median(v) as m from s group by pos), o as (select id, pos, abs(v - m) as off from s join m using (pos)),
    k as (select pos, median(off) as mad from o group by pos)
    select id, round(sum(1 / (1 + case when off = 0 then 0 else off / mad end) * w / 11), 6) as depth from o join k using (pos) join w using (pos) group by id""")
def depth_projection(spark, d):
    return dp.projection_depth(supplier_months(spark, d)).select("id", _r("depth").alias("depth"))


@query(f"""with {E}, {WE}, m as (select pos, avg(v) as m from e group by pos)
    select id, round(1 / (1 + sqrt(sum((v - m) * (v - m) * w))), 6) as depth from e join m using (pos) join w using (pos) group by id""")
def depth_distance(spark, d):
    return dp.distance_depth(embeddings(spark, d)).select("id", _r("depth").alias("depth"))


@query(f"""with {E}, {WE}, {MBD}, r as (select id from mbd order by round(depth, 10) desc, id limit (select cast(ceil(count(*) * 0.5) as bigint) from mbd)),
    box as (select pos, min(v) as lo, max(v) as hi from e join r using (id) group by pos)
    select id, bool_or(v < lo - 1.5 * (hi - lo) or v > hi + 1.5 * (hi - lo)) as is_outlier from e join box using (pos) group by id""")
def outliers_boxplot(spark, d):
    return dp.boxplot_outliers(embeddings(spark, d))


@query(f"""with {E}, {WE}, {MBD}, r as (select id from mbd order by round(depth, 10) desc, id limit (select cast(ceil(count(*) * 0.5) as bigint) from mbd))
    select pos, round(min(v), 6) as low, round(max(v), 6) as high from e join r using (id) group by pos""")
def envelope_central(spark, d):
    return dp.envelope(embeddings(spark, d)).select("pos", _r("low").alias("low"), _r("high").alias("high"))


@query(f"""with {E}, {WE}, {MBD}, x as (select id, sum((n - below - 1) / n * w) as mei, max(n) as n from cells join w using (pos) group by id),
    y as (select id, depth as mbd, mei, -2.0 / (n * (n - 1)) + 2.0 * (n + 1) / (n - 1) * mei - 2.0 / (n * (n - 1)) * n * n * mei * mei - depth as distance from mbd join x using (id)),
    q as (select quantile_cont(distance, 0.25) as a, quantile_cont(distance, 0.75) as b from y)
    select id, round(mbd, 6) as mbd, round(mei, 6) as mei, round(distance, 6) as distance, distance > b + 1.5 * (b - a) as is_outlier from y, q""")
def outliers_outliergram(spark, d):
    return dp.outliergram(embeddings(spark, d)).select("id", *[_r(c).alias(c) for c in ("mbd", "mei", "distance")], "is_outlier")


@query(f"""with {S}, {WS}, c as (select id, pos, v, rank() over (partition by pos order by v) - 1 as b, rank() over (partition by pos order by v desc) - 1 as a, count(*) over (partition by pos) as n from s),
    dd as (select id, pos, v, 1 - (b * (b - 1) / 2.0 + a * (a - 1) / 2.0) / (n * (n - 1) / 2.0) as depth from c),
    z as (select pos, arg_min(v, (-round(depth, 10), id)) as z from dd group by pos),
    o as (select id, pos, (1 / depth - 1) * sign(v - z) as o from dd join z using (pos)),
    t as (select id, sum(o * w / 11) as mo, sum(o * o * w / 11) as sq from o join w using (pos) group by id)
    select id, round(mo, 6) as mean_outlyingness, round(sq - mo * mo, 5) as variation from t""")
def outlyingness_directional(spark, d):
    return dp.directional_outlyingness(supplier_months(spark, d)).select("id", _r("mean_outlyingness").alias("mean_outlyingness"), _r("variation", 5).alias("variation"))


@query()
def outliers_ms_plot(spark, d):
    return dp.ms_plot_outliers(supplier_months(spark, d))


@query()
def depth_band(spark, d):
    return dp.band_depth(supplier_months(spark, d))


@query(f"with {E}, {WE}, {MBD}, r as (select id from mbd order by round(depth, 10) desc, id limit 1) select e.id, pos, round(v, 6) as v from e join r using (id)")
def median_by_depth(spark, d):
    return dp.depth_median(embeddings(spark, d)).long().select("id", "pos", _r("v").alias("v"))


@query(f"""with {E}, {WE}, {MBD}, r as (select id from mbd order by round(depth, 10) desc, id limit (select count(*) - cast(floor(count(*) * 0.1) as bigint) from mbd))
    select pos, round(avg(v), 6) as value from e join r using (id) group by pos""")
def mean_trimmed(spark, d):
    return dp.trimmed_mean(embeddings(spark, d), 0.1).select("pos", _r("value").alias("value"))


# -- statistics -----------------------------------------------------------------------------------
@query(f"with {S} select pos, round(avg(v), 2) as mean, round(var_pop(v) / 1e6, 2) as variance, round(stddev_samp(v), 2) as deviation, round(sum(v), 0) as total from s group by pos")
def pointwise_statistics(spark, d):
    return st.pointwise(supplier_months(spark, d), mean=_r(F.avg("v"), 2), variance=_r(F.var_pop("v") / 1e6, 2), deviation=_r(F.stddev_samp("v"), 2), total=_r(F.sum("v"), 0)).drop("t")


@query(f"with {S} select pos, round(exp(avg(ln(case when v > 0 then v end))), 2) as value from s group by pos having min(v) > 0")
def mean_geometric(spark, d):
    return st.geometric_mean(supplier_months(spark, d)).where("value > 0").select("pos", _r("value", 2).alias("value"))


@query(f"with {U} select pos, case when count(v) = count(*) then round(sum(v) / count(*), 4) end as strict, round(coalesce(sum(v), 0) / count(*), 4) as skipping from u group by pos")
def means_with_gaps(spark, d):
    u = user_hours(spark, d)
    a = st.pointwise_mean(u).select("pos", _r("value", 4).alias("strict"))
    return a.join(st.pointwise_mean(u, skipna=True).select("pos", _r("value", 4).alias("skipping")), "pos")


@query("""with x as (select id, w, generate_subscripts(data, 1) - 1 as pos, unnest(data) as v from (select vec_id as id, label + 1.0 as w, embedding as data from embeddings))
    select pos, round(sum(v * w) / sum(w), 6) as value from x group by pos""")
def mean_weighted(spark, d):
    e = embeddings(spark, d)
    return st.weighted_mean(e.with_df(e.df.withColumn("w", F.col("label") + 1.0)), "w").select("pos", _r("value").alias("value"))


@query(f"with {S} select a.pos as s, b.pos as t, round(covar_pop(a.v, b.v) / 1e6, 2) as value from s a join s b using (id) group by 1, 2")
def covariance_surface(spark, d):
    return st.covariance_frame(supplier_months(spark, d)).select("s", "t", _r(F.col("value") / 1e6, 2).alias("value"))


@query(f"with {S} select id, pos, round(sum(v) over (partition by pos order by id) / 1e3, 2) as value from s")
def cumulative_over_curves(spark, d):
    return st.cumulative_sum(supplier_months(spark, d)).select("id", "pos", _r(F.col("value") / 1e3, 2).alias("value"))


@query()
def median_geometric(spark, d):
    m = st.geometric_median(embeddings(spark, d))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(m)], "pos int, value double")


# -- calculus, evaluation, arithmetic -----------------------------------------------------------
@query(f"with {E}, {WE} select id, round(sum(v * w), 6) as integral, round(sum(v * v * w), 6) as square from e join w using (pos) group by id")
def integral_simpson(spark, d):
    e = embeddings(spark, d)
    return e.integrate().join((e * e).integrate().withColumnRenamed("integral", "square"), "id").select("id", _r("integral").alias("integral"), _r("square").alias("square"))


_D1 = nm.difference_matrix(S_GRID.points)


@query(f"with {S}, {_matrix(_D1)} select id, i as pos, round(sum(v * c), 3) as v from s join m using (pos) group by id, i")
def derivative_first(spark, d):
    return supplier_months(spark, d).derivative().long().select("id", "pos", _r("v", 3).alias("v"))


_SUB = np.linspace(0, 1, 101)


@query(f"with {E}, {_matrix(nm.linear_matrix(E_GRID.points, _SUB))} select id, i as pos, round(sum(v * c), 6) as v from e join m using (pos) group by id, i")
def evaluate_linear(spark, d):
    return embeddings(spark, d).evaluate(_SUB).long().select("id", "pos", _r("v").alias("v"))


_CUBE = np.linspace(0.01, 0.99, 33)


@query(f"with {E}, {_matrix(nm.spline_matrix(E_GRID.points, _CUBE, 3))} select id, i as pos, round(sum(v * c), 6) as v from e join m using (pos) group by id, i")
def evaluate_cubic(spark, d):
    return embeddings(spark, d).evaluate(_CUBE, degree=3).long().select("id", "pos", _r("v").alias("v"))


_OUT = np.array([-0.75, -0.1, 0.2, 0.9, 1.3, 2.05])
_PER = np.where((_OUT < 0) | (_OUT > 1), np.mod(_OUT, 1.0), _OUT)


@query(f"with {E}, {_matrix(nm.linear_matrix(E_GRID.points, _PER))} select id, i as pos, round(sum(v * c), 6) as v from e join m using (pos) group by id, i")
def extrapolate_periodic(spark, d):
    return embeddings(spark, d).evaluate(_OUT, "periodic").long().select("id", "pos", _r("v").alias("v"))


@query(f"with {E}, {_matrix(nm.linear_matrix(E_GRID.points, np.clip(_OUT, 0, 1)))} select id, i as pos, round(sum(v * c), 6) as v from e join m using (pos) group by id, i")
def extrapolate_bounds(spark, d):
    return embeddings(spark, d).evaluate(_OUT, "bounds").long().select("id", "pos", _r("v").alias("v"))


@query(f"with {E}, {_matrix(nm.linear_matrix(E_GRID.points, _OUT))} select id, i as pos, case when i in (2, 3) then round(sum(v * c), 6) else 0.0 end as v from e join m using (pos) group by id, i")
def extrapolate_zeros(spark, d):
    return embeddings(spark, d).evaluate(_OUT, "zeros").long().select("id", "pos", _r("v").alias("v"))


@query(f"with {S}, {_matrix(nm.linear_matrix(S_GRID.points, np.clip(S_GRID.points + 0.4, 1, 12)))} select id, i as pos, round(sum(v * c), 3) as v from s join m using (pos) group by id, i")
def shift_shared(spark, d):
    return supplier_months(spark, d).shift(0.4, "bounds").long().select("id", "pos", _r("v", 3).alias("v"))


@query(f"""with {S}, pts as (select id, p.pos, least(greatest(p.pos + 1 + (id % 5) / 10.0, 1), 12) as x from (select distinct id from s) a cross join (select unnest(range(12)) as pos) p),
    k as (select id, pos, x, least(cast(floor(x) as int), 11) as lo from pts)
    select k.id, k.pos, round(a.v + (b.v - a.v) * (x - lo), 3) as v from k join s a on a.id = k.id and a.pos = lo - 1 join s b on b.id = k.id and b.pos = lo""")
def shift_each(spark, d):
    s = supplier_months(spark, d)
    return s.shift((F.col("id") % 5) / 10.0, "bounds").long().select("id", "pos", _r("v", 3).alias("v"))


@query(f"with {E} select id, pos - 16 as pos, round(v, 6) as v from e where pos / 63.0 between 0.25 and 0.75")
def restrict_domain(spark, d):
    return embeddings(spark, d).restrict(0.25, 0.75).long().select("id", "pos", _r("v").alias("v"))


@query(f"""with {U}, k as (select id, pos, v, last_value(case when v is not null then (pos, v) end ignore nulls) over (partition by id order by pos) as l,
    last_value(case when v is not null then (pos, v) end ignore nulls) over (partition by id order by pos desc) as r from u)
    select id, pos, round(case when l is null then r[2] when r is null or r[1] = l[1] then l[2] else l[2] + (r[2] - l[2]) * (pos - l[1]) / (r[1] - l[1]) end, 9) as v from k""")
def fill_missing_cells(spark, d):
    return ms.fill_missing(user_hours(spark, d)).long().select("id", "pos", _r("v", 9).alias("v"))


@query(f"with {E} select id, pos, round(exp(v), 6) as e, round(abs(v), 6) as a, round(2 * v - 1, 6) as l from e")
def arithmetic_pointwise(spark, d):
    e = embeddings(spark, d)
    a = e.exp().long().select("id", "pos", _r("v").alias("e"))
    b = e.absolute().long().select("id", "pos", _r("v").alias("a"))
    c = (e * 2 - 1).long().select("id", "pos", _r("v").alias("l"))
    return a.join(b, ["id", "pos"]).join(c, ["id", "pos"])


@query(f"""with {S}, {_matrix(_D1)}, g as (select id, i as pos, sum(v * c) as v from s join m using (pos) group by id, i) select id, pos, round(sign(v) * sqrt(abs(v)), 3) as v from g""")
def slope_root(spark, d):
    return mt.srsf(supplier_months(spark, d)).long().select("id", "pos", _r("v", 3).alias("v"))


# -- norms, distances, neighbours ---------------------------------------------------------------
@query(f"with {E}, {WE} select id, round(sum(abs(v) * w), 6) as l1, round(sqrt(sum(v * v * w)), 6) as l2, round(max(abs(v)), 6) as sup from e join w using (pos) group by id")
def norms_lp(spark, d):
    e = embeddings(spark, d)
    w = e.weights()
    return e.df.select("id", *[_r(mt.lp_norm_column(F.col("data"), w, p)).alias(n) for n, p in (("l1", 1), ("l2", 2), ("sup", float("inf")))])


_PAIRS = f"""with {E}, {WE}, q as (select * from e where id % 20 = 0),
    dd as (select q.id as query, e.id as neighbour, any_value(e.label) as label, round(sqrt(sum((q.v - e.v) * (q.v - e.v) * w)), 10) as d from q join e on q.pos = e.pos join w on w.pos = q.pos where q.id <> e.id group by 1, 2),
    k as (select *, row_number() over (partition by query order by d, neighbour) as rank from dd)"""


def _queries(e: Curves) -> Curves:
    return e.where(F.col("id") % 20 == 0)


@query(_PAIRS + " select query, neighbour, rank, round(d, 6) as distance from k where rank <= 5")
def neighbours_nearest(spark, d):
    e = embeddings(spark, d)
    return mt.k_neighbours(_queries(e), e, 5).select("query", "neighbour", "rank", _r("distance").alias("distance"))


@query(_PAIRS + " select query, neighbour, round(d, 6) as distance from k where d <= 0.15")
def neighbours_radius(spark, d):
    e = embeddings(spark, d)
    return mt.radius_neighbours(_queries(e), e, 0.15).select("query", "neighbour", _r("distance").alias("distance"))


@query(_PAIRS + ", votes as (select query as id, label, count(*) as n from k where rank <= 5 group by 1, 2) select id, arg_min(label, (-n, label)) as predicted from votes group by id")
def classify_neighbours(spark, d):
    e = embeddings(spark, d)
    return cl.knn_classify(_queries(e), e, "label", 5)


@query(_PAIRS + " select query as id, round(avg(label), 6) as predicted from k where rank <= 5 group by 1")
def regress_neighbours(spark, d):
    e = embeddings(spark, d)
    return rr.knn_regress(_queries(e), e, "label", 5).select("id", _r("predicted").alias("predicted"))


@query(f"""with {E}, {WE}, q as (select * from e where id % 20 = 0),
    dd as (select q.id as id, e.id as j, any_value(e.label) as label, sqrt(sum((q.v - e.v) * (q.v - e.v) * w)) as d from q join e on q.pos = e.pos join w on w.pos = q.pos group by 1, 2)
    select id, round(sum(exp(-d * d / 0.08) * label) / sum(exp(-d * d / 0.08)), 6) as predicted from dd group by id""")
def regress_kernel(spark, d):
    e = embeddings(spark, d)
    return rr.kernel_regression(_queries(e), e, "label", 0.2).select("id", _r("predicted").alias("predicted"))


@query(f"""with {E}, {WE}, q as (select * from e where id % 20 = 0)
    select q.id as query, e.id as row, round(sum(q.v * e.v * w), 6) as inner from q join e on q.pos = e.pos join w on w.pos = q.pos group by 1, 2""")
def inner_products(spark, d):
    e = embeddings(spark, d)
    return mt.gram(_queries(e), e).select("query", "row", _r("inner").alias("inner"))


@query(f"""with {E}, {WE}, x as (select a.id, sum(a.v * b.v * w) as ab, sum(a.v * a.v * w) as aa, sum(b.v * b.v * w) as bb from e a join e b on a.id = b.id and b.pos = 63 - a.pos join w on w.pos = a.pos group by 1)
    select id, round(ab / sqrt(aa * bb), 6) as cosine, round(acos(ab / sqrt(aa * bb)) / pi(), 6) as angle from x""")
def similarity_cosine(spark, d):
    e = embeddings(spark, d)
    back = e.with_df(e.df.withColumn("data", F.reverse("data")))
    a = mt.cosine_similarity(e, back).select("id", _r("cosine").alias("cosine"))
    return a.join(mt.angular_distance(e, back).select("id", _r("distance").alias("angle")), "id")


@query()
def outliers_local_factor(spark, d):
    e = embeddings(spark, d)
    return dp.local_outlier_factor(_queries(e), e, 10)


# -- classification, clustering, scores, tests --------------------------------------------------
@query(f"""with {E}, {WE}, m as (select label, pos, avg(v) as m from e group by 1, 2), dd as (select e.id, m.label, round(sqrt(sum((v - m) * (v - m) * w)), 10) as d from e join m using (pos) join w using (pos) group by 1, 2)
    select id, arg_min(label, (d, label)) as predicted, round(min(d), 6) as distance from dd group by id""")
def classify_centroid(spark, d):
    e = embeddings(spark, d)
    return cl.nearest_centroid(e, e, "label").select("id", "predicted", _r("distance").alias("distance"))


@query(f"""with {E}, {WE}, x as (select a.id, b.label as class, a.pos, a.v, count(*) filter (where b.v < a.v) as lo, count(*) filter (where b.v > a.v) as hi, count(*) as n from e a join e b on a.pos = b.pos where a.id % 20 = 0 group by 1, 2, 3, 4),
    y as (select id, class, sum((1 - (lo * (lo - 1) / 2.0 + hi * (hi - 1) / 2.0) / (n * (n - 1) / 2.0)) * w) as depth from x join w using (pos) group by 1, 2)
    select id, arg_min(class, (-round(depth, 10), class)) as predicted from y group by id""")
def classify_depth(spark, d):
    e = embeddings(spark, d)
    return cl.maximum_depth(_queries(e), e, "label")


@query()
def classify_quadratic(spark, d):
    e = embeddings(spark, d)
    return cl.quadratic_discriminant(e, e, "label", 0.01)


@query()
def classify_logistic(spark, d):
    e = embeddings(spark, d)
    two = e.with_df(e.df.withColumn("y", (F.col("label") >= 5).cast("int")))
    return cl.logistic(two, two, "y", 2)


@query(f"""with {S}, {WS}, c as (select dense_rank() over (order by id) - 1 as k, pos, v as c from s where id in (select id from s group by id order by id limit 3)), dd as (select s.id, k, round(sqrt(sum((v - c) * (v - c) * w)), 4) as d from s join c using (pos) join w using (pos) group by 1, 2),
    a as (select id, arg_min(k, (d, k)) as k from dd group by id) select k as cluster, pos, round(avg(v), 0) as value from s join a using (id) group by 1, 2""")
def cluster_step(spark, d):
    s = supplier_months(spark, d)
    init = np.array([r["data"] for r in s.df.orderBy("id").limit(3).collect()])
    labels = cl.nearest_of(s, [0, 1, 2], init, 2, 4)
    return s.df.join(labels, "id").select(F.col("predicted").alias("cluster"), F.posexplode("data").alias("pos", "v")).groupBy("cluster", "pos").agg(_r(F.avg("v"), 0).alias("value"))


@query()
def cluster_means(spark, d):
    return ct.k_means(embeddings(spark, d), 5)[0]


@query()
def cluster_fuzzy(spark, d):
    return ct.fuzzy_c_means(supplier_months(spark, d), 3)[0]


@query()
def cluster_hierarchy(spark, d):
    return ct.agglomerate(supplier_months(spark, d), 4)


@query(f"""with {E}, {WE}, {_matrix(nm.linear_matrix(E_GRID.points, E_GRID.points))}, m2 as (select pos, avg(v) as m from e group by pos),
    z as (select pos, avg(abs(v - m)) as mae, avg((v - m) * (v - m)) as mse, 1 - avg((v - m) * (v - m)) / var_pop(v) as r2 from e join m2 using (pos) group by pos)
    select round(sum(mae * w), 6) as mae, round(sum(mse * w), 6) as mse, round(sum(sqrt(mse) * w), 6) as rmse, round(sum(r2 * w), 6) as r2 from z join w using (pos)""")
def scores_functional(spark, d):
    e = embeddings(spark, d)
    mean = [r["v"] for r in e.long().groupBy("pos").agg(F.avg("v").alias("v")).orderBy("pos").collect()]
    pred = e.with_df(e.df.withColumn("data", F.array(*[F.lit(v) for v in mean])))
    one = lambda df, n: df.select(_r("score").alias(n))
    return (
        one(sc.pointwise_error(e, pred, "absolute"), "mae").crossJoin(one(sc.pointwise_error(e, pred), "mse"))
        .crossJoin(one(sc.pointwise_error(e, pred, root=True), "rmse")).crossJoin(one(sc.r2(e, pred), "r2"))
    )


@query(f"""with {E}, {WE}, n as (select label, count(distinct id) as n from e group by 1), m as (select label, pos, avg(v) as m from e group by 1, 2)
    select round(sum(n * (a.m - b.m) * (a.m - b.m) * w), 6) as statistic from m a join m b on a.pos = b.pos and a.label < b.label join n on n.label = a.label join w on w.pos = a.pos""")
def anova_statistic(spark, d):
    return nf.group_statistic(embeddings(spark, d), "label").select(_r("statistic").alias("statistic"))


@query()
def anova_test(spark, d):
    statistic, p = nf.oneway_anova(embeddings(spark, d), "label")
    return spark.createDataFrame([(statistic, p)], "statistic double, p_value double")


@query()
def hotelling_statistic(spark, d):
    e = embeddings(spark, d)
    return spark.createDataFrame([(nf.hotelling_t2(e.where("label < 5"), e.where("label >= 5")),)], "t2 double")


# -- features -------------------------------------------------------------------------------------
@query(f"with {E}, {WE} select id, round(sum(v * w), 6) as m1, round(sum(v * v * w), 6) as m2, round(sum(v * v * v * w), 6) as m3 from e join w using (pos) group by id")
def feature_moments(spark, d):
    e = embeddings(spark, d)
    return ft.feature_union(*[ft.moment(e, k).select("id", _r("value").alias(f"m{k}")) for k in (1, 2, 3)])


@query(f"""with {E}, s0 as (select id, pos, v from e where sign(v) <> 0), s1 as (select id, sign(v) as a, lag(sign(v)) over (partition by id order by pos) as b from s0)
    select id, count(*) filter (where a <> b) as crossings from s1 group by id""")
def feature_crossings(spark, d):
    return ft.crossings(embeddings(spark, d)).select("id", F.col("crossings").cast("bigint").alias("crossings"))


@query(f"with {E} select id, round(sum(case when v between -0.1 and 0.1 and pos > 0 then 1.0 / 63 else 0 end), 6) as inside from e group by id")
def feature_occupation(spark, d):
    return ft.occupation(embeddings(spark, d), [(-0.1, 0.1)]).select("id", _r(F.get("occupation", F.lit(0))).alias("inside"))


_HALF = [ft._sub_weights(Curves(None, E_GRID), a, b)[0] / 0.5 for a, b in ((0, 0.5), (0.5, 1.0))]


@query(f"with {E}, {_matrix(np.array(_HALF))} select id, i as part, round(sum(v * c), 6) as average from e join m using (pos) group by 1, 2")
def feature_local_averages(spark, d):
    return ft.local_averages(embeddings(spark, d), 2).select("id", F.posexplode("averages").alias("part", "x")).select("id", "part", _r("x").alias("average"))


# -- smoothing, bases, reduction, regression ----------------------------------------------------
@query(f"with {S}, {_matrix(sm.NadarayaWatson(1.5).hat(S_GRID.points))} select id, i as pos, round(sum(v * c), 3) as v from s join m using (pos) group by id, i")
def smooth_kernel(spark, d):
    return sm.smooth(supplier_months(spark, d), sm.NadarayaWatson(1.5)).long().select("id", "pos", _r("v", 3).alias("v"))


@query(f"with {S}, {_matrix(sm.LocalLinear(2.0).hat(S_GRID.points))} select id, i as pos, round(sum(v * c), 3) as v from s join m using (pos) group by id, i")
def smooth_local_linear(spark, d):
    return sm.smooth(supplier_months(spark, d), sm.LocalLinear(2.0)).long().select("id", "pos", _r("v", 3).alias("v"))


@query(f"with {S}, {_matrix(sm.KNeighbours(3).hat(S_GRID.points))} select id, i as pos, round(sum(v * c), 3) as v from s join m using (pos) group by id, i")
def smooth_neighbours(spark, d):
    return sm.smooth(supplier_months(spark, d), sm.KNeighbours(3)).long().select("id", "pos", _r("v", 3).alias("v"))


_SPLINES = BSplineBasis((0.0, 1.0), 10)


@query(f"with {E}, {_matrix(sm.PenalisedBasis(_SPLINES, 1e-4).coefficients(E_GRID.points))} select id, i as k, round(sum(v * c), 5) as coef from e join m using (pos) group by id, i")
def basis_penalised(spark, d):
    return sm.smooth_to_basis(embeddings(spark, d), sm.PenalisedBasis(_SPLINES, 1e-4)).df.select("id", F.posexplode("coef").alias("k", "c")).select("id", "k", _r("c", 5).alias("coef"))


_WAVES = FourierBasis((0.0, 1.0), 7)


@query(f"""with {E}, {_matrix(_WAVES.fit_matrix(E_GRID.points))}, b(k, x) as (select * from {_values(range(7), _WAVES.integrals())}),
    c as (select id, i as k, sum(v * c) as c from e join m using (pos) group by id, i) select id, round(sum(c * x), 6) as integral from c join b using (k) group by id""")
def basis_integral(spark, d):
    return embeddings(spark, d).to_basis(_WAVES).integrate().select("id", _r("integral").alias("integral"))


@query(f"""with {S}, {_matrix(np.eye(12) - sm.NadarayaWatson(1.5).hat(S_GRID.points))}, r as (select id, i, sum(v * c) as e from s join m using (pos) group by 1, 2)
    select round(-avg(e * e) * {float(sm.PENALTIES["gcv"](sm.NadarayaWatson(1.5).hat(S_GRID.points)))!r} / 1e6, 4) as score from r""")
def smooth_validation(spark, d):
    v = sm.gcv_score(supplier_months(spark, d), sm.NadarayaWatson(1.5))
    return spark.createDataFrame([(float(v) / 1e6,)], "score double").select(_r("score", 4).alias("score"))


@query()
def components_principal(spark, d):
    e = embeddings(spark, d)
    return rd.fpca(e, 3).transform(e)


@query()
def components_least_squares(spark, d):
    e = embeddings(spark, d)
    return rd.fpls(e, ["label"], 2).predict(e)


@query()
def map_diffusion(spark, d):
    return rd.diffusion_map(supplier_months(spark, d), lambda x: np.exp(-(x**2)), scale="median")


@query()
def selection_kernel_space(spark, d):
    e = embeddings(spark, d)
    two = e.with_df(e.df.withColumn("y", (F.col("label") >= 5).cast("int")))
    return spark.createDataFrame([(i, p) for i, p in enumerate(rd.rkhs_selection(two, "y", 3))], "rank int, pos int")


@query()
def regress_linear(spark, d):
    e = embeddings(spark, d)
    return rr.linear_regression(e, "label", MonomialBasis((0.0, 1.0), 3)).predict(e)


@query()
def regress_components(spark, d):
    e = embeddings(spark, d)
    return rr.fpca_regression(e, "label", 4)[1](e)


@query()
def regress_historical(spark, d):
    s = supplier_months(spark, d)
    b = rr.historical_regression(s.derivative(), s, 3)
    return spark.createDataFrame([(int(i), int(j), float(b[i, j])) for i in range(12) for j in range(12)], "s int, t int, value double")


# -- registration ---------------------------------------------------------------------------------
@query(f"""with {S}, p as (select id, arg_max(pos, (v, -pos)) + 1.0 as peak from s group by id), c as (select avg(peak) as c from p) select id, round(peak - c, 6) as delta from p, c""")
def landmark_deltas(spark, d):
    s = supplier_months(spark, d)
    peak = F.array_position("data", F.array_max("data")).cast("double")
    return rg.landmark_deltas(s.with_df(s.df.withColumn("peak", peak)), "peak").select("id", _r("delta").alias("delta"))


@query()
def shift_least_squares(spark, d):
    return rg.least_squares_shift(supplier_months(spark, d), 100)


@query()
def register_elastic(spark, d):
    return rg.elastic_registration(supplier_months(spark, d)).df


@query()
def register_scores(spark, d):
    s = supplier_months(spark, d)
    moved = s.shift(0.3, "bounds")
    parts = rg.amplitude_phase(s, moved) | {"least_squares": rg.least_squares_score(s, moved), "sobolev": rg.sobolev_score(s, moved), "correlation": rg.pairwise_correlation(s, moved)}
    return spark.createDataFrame([(k, float(v)) for k, v in parts.items()], "name string, value double")


# -- irregular curves -----------------------------------------------------------------------------
@query(f"with {I}, p as (select id, t, v, lead(t) over w as t1, lead(v) over w as v1 from i window w as (partition by id order by t)) select id, round(coalesce(sum((t1 - t) * (v + v1) / 2), 0), 4) as integral from p group by id")
def irregular_trapezoid(spark, d):
    return user_stream(spark, d).trapezoid().select("id", _r("integral", 4).alias("integral"))


@query(f"with {O} select id, t, round(v, 2) as v from o where t between 1000 and 2000")
def irregular_restrict(spark, d):
    return customer_orders(spark, d).restrict(1000, 2000).df.select("id", "t", _r("v", 2).alias("v"))


@query(f"""with {I}, q as (select id, x.t from (select distinct id from i) cross join (select unnest([5.0, 10.0, 15.0, 20.0, 25.0]) as t) x),
    l as (select q.id, q.t, i.t as t0, i.v as v0 from q asof left join i on q.id = i.id and q.t >= i.t), r as (select q.id, q.t, i.t as t1, i.v as v1 from q asof left join i on q.id = i.id and q.t <= i.t)
    select l.id, l.t, round(case when t0 = l.t then v0 else v0 + (v1 - v0) * (l.t - t0) / (t1 - t0) end, 4) as v from l join r on l.id = r.id and l.t = r.t""")
def irregular_evaluate(spark, d):
    return user_stream(spark, d).evaluate([5.0, 10.0, 15.0, 20.0, 25.0]).select("id", "t", _r("v", 4).alias("v"))


@query()
def irregular_to_basis(spark, d):
    return user_stream(spark, d).to_basis(FourierBasis((0.0, 31.0), 5)).df


@query("select count(*) as curves, count(*) filter (where n = 0) as missing from (select id, len(list_filter(data_matrix, lambda x: x is not null and not isnan(x))) as n from station_days where len(data_matrix) = 24)")
def missing_curves(spark, d):
    return station_days(spark, d).isna().agg(F.count(F.lit(1)).alias("curves"), F.count_if("missing").alias("missing"))


# -- generators and covariances -----------------------------------------------------------------
@query()
def made_gaussian(spark, d):
    return gn.gaussian_process(spark, 200, 50, cov=cv.Exponential(1.0, 0.3)).df


@query()
def made_paths(spark, d):
    return gn.sde_paths(spark, 100, 0.0, drift=lambda t, x: -x, diffusion=0.5).df


@query()
def made_sinusoids(spark, d):
    return gn.sinusoids(spark, 100).df


@query()
def made_warpings(spark, d):
    return gn.warpings(spark, 50).df


@query()
def sampled_irregular(spark, d):
    return gn.irregular_sample(embeddings(spark, d), 10).df


# -- further operators ----------------------------------------------------------------------------
_BANDS = f"""with {S}, x as (select id, list(v order by pos) as v from s group by id), n as (select count(*) as n from x),
    p as (select a.id as i, b.id as j, list_transform(list_zip(a.v, b.v), lambda z: least(z[1], z[2])) as lo, list_transform(list_zip(a.v, b.v), lambda z: greatest(z[1], z[2])) as hi from x a join x b on a.id < b.id),
    h as (select x.id, count(*) filter (where list_bool_and(list_transform(list_zip(x.v, p.lo, p.hi), lambda z: z[1] >= z[2] and z[1] <= z[3]))) as c from x cross join p group by 1)
    select id, round(c / (n * (n - 1) / 2), 6) as depth from h, n"""
QUERIES["depth_band"] = lambda spark, d: dp.band_depth(supplier_months(spark, d)).select("id", _r("depth").alias("depth"))
ORACLE["depth_band"] = _BANDS


@query(_PAIRS + f""", g as (select query as j, max(d) as kd from (select dd.*, row_number() over (partition by query order by d, neighbour) as rank from
        (select a.id as query, b.id as neighbour, round(sqrt(sum((a.v - b.v) * (a.v - b.v) * w)), 10) as d from e a join e b on a.pos = b.pos join w on w.pos = a.pos where a.id <> b.id group by 1, 2) dd) where rank <= 10 group by 1),
    r as (select query as j, neighbour as m, d from (select dd.*, row_number() over (partition by query order by d, neighbour) as rank from
        (select a.id as query, b.id as neighbour, round(sqrt(sum((a.v - b.v) * (a.v - b.v) * w)), 10) as d from e a join e b on a.pos = b.pos join w on w.pos = a.pos where a.id <> b.id group by 1, 2) dd) where rank <= 10),
    lrd as (select r.j, 1 / (avg(greatest(r.d, g.kd)) + 1e-10) as lrd from r join g on g.j = r.m group by 1)
    select r.j as id, round(avg(o.lrd) / max(m.lrd), 6) as lof from r join lrd o on o.j = r.m join lrd m on m.j = r.j where r.j % 20 = 0 group by 1""")
def outliers_local_factor(spark, d):  # noqa: F811
    e = embeddings(spark, d)
    return dp.local_outlier_factor(_queries(e), e, 10).select("id", _r("lof").alias("lof"))


@query(_PAIRS + """, near as (select * from dd where d <= 0.15), votes as (select query as id, label, count(*) as n from near group by 1, 2), best as (select id, arg_min(label, (-n, label)) as predicted from votes group by id)
    select i.id, coalesce(predicted, -1) as predicted from (select distinct id from q) i left join best using (id)""")
def classify_radius(spark, d):
    e = embeddings(spark, d)
    return cl.radius_classify(_queries(e), e, "label", 0.15, outlier_label=-1)


@query(_PAIRS + """, near as (select query as id, avg(label) as predicted from dd where d <= 0.15 group by 1) select i.id, round(predicted, 6) as predicted from (select distinct id from q) i left join near using (id)""")
def regress_radius(spark, d):
    e = embeddings(spark, d)
    return rr.radius_regress(_queries(e), e, "label", 0.15).select("id", _r("predicted").alias("predicted"))


@query(_PAIRS + " select query as id, round(sum(label / d) / sum(1 / d), 6) as predicted from k where rank <= 5 group by 1")
def regress_neighbours_weighted(spark, d):
    e = embeddings(spark, d)
    return rr.knn_regress(_queries(e), e, "label", 5, weights="distance").select("id", _r("predicted").alias("predicted"))


@query(_PAIRS + " select query, e.pos, round(avg(e.v), 6) as v from k join e on e.id = k.neighbour where rank <= 3 group by 1, 2")
def regress_neighbours_curves(spark, d):
    e = embeddings(spark, d)
    return rr.knn_regress_curves(_queries(e), e, e, 3).long().select(F.col("id").alias("query"), "pos", _r("v").alias("v"))


@query(f"""with {E}, {WE}, x as (select a.id, a.pos, a.v - b.v as d from e a join e b on a.id = b.id and b.pos = 63 - a.pos)
    select id, round(sum(abs(d) * w), 6) as l1, round(sqrt(sum(d * d * w)), 6) as l2, round(max(abs(d)), 6) as sup, round(cbrt(sum(abs(d * d * d) * w)), 6) as l3 from x join w using (pos) group by id""")
def distances_lp(spark, d):
    e = embeddings(spark, d)
    off = e - e.with_df(e.df.withColumn("data", F.reverse("data")))
    w = e.weights()
    return off.df.select("id", *[_r(mt.lp_norm_column(F.col("data"), w, p)).alias(n) for n, p in (("l1", 1), ("l2", 2), ("sup", float("inf")), ("l3", 3))])


@query(f"""with {E}, {_matrix(nm.difference_matrix(E_GRID.points))}, {WE}, g as (select id, i as pos, sum(v * c) as v from e join m using (pos) group by 1, 2), q as (select id, pos, sign(v) * sqrt(abs(v)) as v from g),
    back as (select id, 63 - pos as pos, v from e), g2 as (select id, i as pos, sum(v * c) as v from back join m using (pos) group by 1, 2), q2 as (select id, pos, sign(v) * sqrt(abs(v)) as v from g2)
    select a.id, round(sqrt(sum((a.v - b.v) * (a.v - b.v) * w)), 5) as distance from q a join q2 b on a.id = b.id and a.pos = b.pos join w on w.pos = a.pos group by 1""")
def distances_fisher_rao(spark, d):
    e = embeddings(spark, d)
    return mt.fisher_rao_distance(e, e.with_df(e.df.withColumn("data", F.reverse("data")))).select("id", _r("distance", 5).alias("distance"))


@query(f"with {E}, {WE}, a as (select id, sum(v * w) as m from e join w using (pos) group by id) select id, round(sum((v - m) * (v - m) * w), 6) as c2, round(sum(exp(v) * w), 6) as ex from e join w using (pos) join a using (id) group by id")
def feature_expectations(spark, d):
    e = embeddings(spark, d)
    return ft.central_moment(e, 2).select("id", _r("value").alias("c2")).join(ft.average_value(e, F.exp).select("id", _r("value").alias("ex")), "id")


@query(f"with {E}, s0 as (select id, pos, v - 0.05 as v from e where v <> 0.05), s1 as (select id, sign(v) as a, lag(sign(v)) over (partition by id order by pos) as b from s0) select id, count(*) filter (where b < 0 and a > 0) as crossings from s1 group by id")
def feature_crossings_up(spark, d):
    return ft.crossings(embeddings(spark, d), 0.05, "up").select("id", F.col("crossings").cast("bigint").alias("crossings"))


_KERN = np.array([[np.exp(-abs(s - t)) for s in E_GRID.points] for t in np.linspace(0, 1, 5)]) * nm.simpson_weights(E_GRID.points)[None]


@query(f"with {E}, {_matrix(_KERN)} select id, i as pos, round(sum(v * c), 6) as v from e join m using (pos) group by 1, 2")
def operator_integral(spark, d):
    from curvelake.operators.linear import integral_transform

    return integral_transform(embeddings(spark, d), lambda s, t: np.exp(-np.abs(s - t)), np.linspace(0, 1, 5)).long().select("id", "pos", _r("v").alias("v"))


_LDO = np.diag(S_GRID.points) + 2 * nm.difference_matrix(S_GRID.points, 2)


@query(f"with {S}, {_matrix(_LDO)} select id, i as pos, round(sum(v * c), 2) as v from s join m using (pos) group by 1, 2")
def operator_differential(spark, d):
    from curvelake.operators.linear import differential_operator

    return differential_operator(supplier_months(spark, d), [lambda t: t, 0.0, 2.0]).long().select("id", "pos", _r("v", 2).alias("v"))


@query(f"""with {E}, {WE}, m as (select pos, avg(v) as m, var_pop(v) as vv from e group by pos), z as (select pos, avg(abs(v - m) / greatest(abs(v), 2.220446049250313e-16)) as ape, 1 - (avg((v - m) * (v - m)) - avg(v - m) * avg(v - m)) / any_value(vv) as ev from e join m using (pos) group by pos)
    select pos, round(ape, 4) as percentage, round(ev, 6) as explained from z""")
def scores_raw(spark, d):
    e = embeddings(spark, d)
    mean = [r["v"] for r in e.long().groupBy("pos").agg(F.avg("v").alias("v")).orderBy("pos").collect()]
    pred = e.with_df(e.df.withColumn("data", F.array(*[F.lit(v) for v in mean])))
    a = sc.pointwise_error(e, pred, "percentage", raw=True).select("pos", _r("score", 4).alias("percentage"))
    return a.join(sc.explained_variance(e, pred, raw=True).select("pos", _r("score").alias("explained")), "pos")


@query(f"""with {S}, {WS}, c as (select dense_rank() over (order by id) - 1 as k, pos, v as c from s where id in (select id from s group by id order by id limit 3)),
    dd as (select s.id, k, sqrt(sum((v - c) * (v - c) * w)) as d from s join c using (pos) join w using (pos) group by 1, 2), z as (select id, min(d) as z from dd group by id),
    u as (select id, k, case when z = 0 then case when d = 0 then 1.0 else 0.0 end else pow(d, -2) end as u from dd join z using (id))
    select id, k, round(u / sum(u) over (partition by id), 6) as membership from u""")
def cluster_membership(spark, d):
    s = supplier_months(spark, d)
    init = np.array([r["data"] for r in s.df.orderBy("id").limit(3).collect()])
    return ct.memberships(s, init).select("id", F.posexplode("membership").alias("k", "m")).select("id", "k", _r("m").alias("membership"))


@query(f"with {E}, {_matrix(_WAVES(np.linspace(0, 1, 9)) @ _WAVES.fit_matrix(E_GRID.points))} select id, i as pos, round(sum(v * c), 6) as v from e join m using (pos) group by 1, 2")
def basis_values(spark, d):
    return embeddings(spark, d).to_basis(_WAVES).to_grid(np.linspace(0, 1, 9)).long().select("id", "pos", _r("v").alias("v"))


@query(f"with {I} select id, round(min(t), 6) as low, round(max(t), 6) as high, count(*) as n from i group by id")
def irregular_ranges(spark, d):
    i = user_stream(spark, d)
    return i.ranges().join(i.df.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id").select("id", _r("low").alias("low"), _r("high").alias("high"), "n")


@query(f"with {U}, k as (select id from u group by id having count(v) = 24) select cast(pos as double) as t, round(sum(v), 3) as value from u join k using (id) group by pos")
def irregular_common(spark, d):
    u = user_hours(spark, d)
    return u.where(F.forall("data", lambda x: x.isNotNull())).to_irregular().sum().select("t", _r("value", 3).alias("value"))


@query(f"with {O} select id, t, round(2 * v - ln(v), 2) as v from o")
def irregular_arithmetic(spark, d):
    o = customer_orders(spark, d)
    return (2 * o - o.map(F.ln)).df.select("id", "t", _r("v", 2).alias("v"))


@query(f"with {U}, k as (select id, count(v) as n from u group by id) select u.id, pos, round(v, 4) as v from u join k using (id) where v is not null and n >= 20")
def irregular_from_grid(spark, d):
    u = user_hours(spark, d)
    full = u.where(F.size(F.filter("data", lambda x: x.isNotNull())) >= 20)
    return full.to_irregular().df.select("id", F.col("t").cast("int").alias("pos"), _r("v", 4).alias("v"))


@query("""with r as (select user_id as id, ts, value from events where value is not null), w as (select id, time_bucket(interval '1 day', ts) as s, least(3, cast(floor(date_diff('microsecond', time_bucket(interval '1 day', ts), ts) * 4 / 86400e6) as int)) as pos, value from r)
    select id, s as window_start, pos, round(avg(value), 4) as v from w group by 1, 2, 3""")
def stream_windows(spark, d):
    from curvelake.session import table
    from curvelake.streaming.windows import windowed_curves

    made = windowed_curves(table(spark, d, "events"), "user_id", "ts", "value", "1 day", 4)
    cells = made.select("id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.posexplode("data").alias("pos", "v"))
    return cells.where("v is not null").select("id", "window_start", "pos", _r("v", 4).alias("v"))


@query()
def mixed_effects(spark, d):
    from curvelake.operators.mixed_effects import fit_mixed_effects

    i = user_stream(spark, d)
    return fit_mixed_effects(i, FourierBasis((0.0, 31.0), 3)).transform(i).df


@query()
def covariance_parameters(spark, d):
    from curvelake.operators.covariance_fit import fit_covariance

    p, _ = fit_covariance(embeddings(spark, d), lambda v, s: cv.Exponential(v, s), (0.1, 0.1))
    return spark.createDataFrame([p], "variance double, length_scale double, noise double")
