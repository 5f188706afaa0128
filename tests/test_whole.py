"""Results over all rows, where a bound or a few rounds once stood in."""

import datetime as dt
import os
import warnings

import numpy as np
import pytest

import __spark_entry__ as entry
from curvelake.core.spikes import implausible_cells
from curvelake.frames import Curves
from curvelake.meta import GridMeta
from curvelake.numerics import Unfinished
from curvelake.operators import clustering as ct
from curvelake.operators import inference as nf
from curvelake.operators import reduction as rd
from curvelake.operators import registration as rg
from curvelake.operators import stats as st
from curvelake.sources.tables import embeddings, supplier_months


def _history(spark, x):
    rows = [(k, 1, dt.date(2024, 1, 1) + dt.timedelta(days=k), r.tolist(), dt.datetime(2025, 1, 1)) for k, r in enumerate(x.reshape(-1, 24))]
    curves = spark.createDataFrame(rows, "id bigint, source_id bigint, obs_date date, data_matrix array<double>, received_at timestamp")
    return curves, spark.createDataFrame([(1, "temperature")], "source_id bigint, coordinate string")


def _weather(days):
    t = np.arange(days * 24)
    return np.round(15 + 4 * np.sin(2 * np.pi * t / 24) + 0.3 * np.random.default_rng(5).standard_normal(len(t)), 1)


def test_a_block_with_many_spikes(spark):
    x, rng = _weather(128), np.random.default_rng(6)
    at = rng.permutation(len(x) // 4 - 1)[:100] * 4 + 1
    x[at] += rng.uniform(20, 25, len(at))
    got = {(r["id"] * 24 + r["pos"], r["reason"]) for r in implausible_cells(*_history(spark, x)).collect()}
    assert got == {(int(i), "spike") for i in at}


def test_a_block_with_many_frozen_runs(spark):
    x = _weather(128)
    at = [d * 24 + k for d in range(0, 100, 2) for k in range(2, 14)]
    x[at] = np.repeat(x[at[::12]], 12)
    got = {r["id"] * 24 + r["pos"] for r in implausible_cells(*_history(spark, x)).collect() if r["reason"] == "frozen"}
    assert set(at) <= got and len(got) <= len(at) + 50


def _distances_correlated(x, y):
    """Brute force over the matrices of all pairs."""
    n, out = len(x), []
    for v in (x, y):
        d = np.abs(v[:, None] - v[None])
        u = d - d.sum(0) / (n - 2) - d.sum(1)[:, None] / (n - 2) + d.sum() / ((n - 1) * (n - 2))
        np.fill_diagonal(u, 0)
        out.append(u)
    a, b = out
    low = np.sqrt((a * a).sum() * (b * b).sum())
    return (a * b).sum() / low if low > 1e-12 else 0.0


def _information(x, y, k=3):
    """Brute force over all pairs, on values without ties."""
    x, total = x / x.std(), 0.0
    for c in np.unique(y):
        own = x[y == c]
        radius = np.nextafter(np.sort(np.abs(own[:, None] - own[None]), 1)[:, k], 0)
        m = (np.abs(own[:, None] - x[None]) <= radius[:, None]).sum(1)
        total += (rd._digamma(k) - rd._digamma(m)).sum() + len(own) * rd._digamma(len(own))
    return total / len(x) + rd._digamma(len(x))


@pytest.mark.parametrize("n", [4, 5, 37, 256])
def test_measures_of_dependence_equal_brute_force(n):
    rng = np.random.default_rng(n)
    x, y = rng.standard_normal(n), rng.integers(0, 4, n).astype(float)
    y[:2] = 0, 1
    for a, b in ((x, y), (x, x**2), (1e3 + np.round(x, 1), y)):
        assert rd.distance_correlation(a, b) == pytest.approx(_distances_correlated(a, b), abs=1e-9)
    assert rd.distance_correlation(np.full(n, 0.1), y) == 0
    if n > 30:
        assert rd.mutual_information(x + y, y) == pytest.approx(_information(x + y, y), abs=1e-3)
        assert rd.mutual_information((x + y)[::-1], y[::-1]) == rd.mutual_information(x + y, y)


def test_dependence_is_of_all_curves(spark):
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((1200, 3)), rng.integers(0, 3, 1200)
    x[:, 1] += y
    frame = spark.createDataFrame([(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, y))], "id bigint, data array<double>, label int")
    want = [_distances_correlated(x[:, k], y.astype(float)) for k in range(3)]
    assert rd.dependence(Curves(frame, GridMeta.regular(3)), "label") == pytest.approx(want, abs=1e-9)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the test data is not here")
def test_selection_maxima_is_of_all_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    x, y = np.stack(rows["embedding"]), rows["label"].to_numpy(float)
    d = [_distances_correlated(c, y) for c in x.T.astype(float)]
    top = [i for i in range(64) if d[i] == max(d[max(0, i - 1) : i + 2])]
    got = entry.queries()["selection_maxima"](spark, "/root/testdata/sf0.01").orderBy("rank").collect()
    assert [r["pos"] for r in got] == sorted(top, key=lambda i: -d[i])[:5]


def _two_groups(spark, scale):
    rng = np.random.default_rng(8)
    x = scale * (rng.standard_normal((40, 6)) + 4 * (np.arange(40) % 2)[:, None] + np.linspace(0, 1, 6))
    return x, Curves(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, data array<double>"), GridMeta.regular(6))


@pytest.mark.parametrize("scale", [1e-9, 1e7])
def test_rounds_end_alike_at_every_scale(spark, scale):
    (x, c), (_, plain) = _two_groups(spark, scale), _two_groups(spark, 1.0)
    assert ct.fuzzy_c_means(c, 2)[1] / scale == pytest.approx(ct.fuzzy_c_means(plain, 2)[1], abs=1e-6)
    _, centres, _ = ct.k_means(c, 2, init=x[[0, 2]])
    assert centres / scale == pytest.approx(ct.lloyd_step(c, centres)[1] / scale, abs=1e-9)
    if scale == 1e-9:
        assert st.geometric_median(c) / scale == pytest.approx(st.geometric_median(plain), abs=1e-6)


def test_unfinished_rounds_are_reported(spark):
    _, c = _two_groups(spark, 1.0)
    for run in (lambda: ct.fuzzy_c_means(c, 2, max_iter=1), lambda: ct.k_means(c, 2, max_iter=1), lambda: st.geometric_median(c, max_iter=1), lambda: rg.least_squares_shift(c, 1, 1e-9)):
        with pytest.warns(Unfinished):
            run()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the test data is not here")
@pytest.mark.parametrize("name", ["cluster_fuzzy", "cluster_means", "mixed_effects", "median_geometric", "shift_least_squares", "anova_test"])
def test_queries_finish_their_rounds(spark, name):
    d = "/root/testdata/sf0.01"
    with warnings.catch_warnings():
        warnings.simplefilter("error", Unfinished)
        got = entry.queries()[name](spark, d).collect()
    if name == "cluster_fuzzy":
        s = supplier_months(spark, d)
        rows = s.df.orderBy("id").collect()
        x, w, c = np.stack([r["data"] for r in rows]), s.weights(), ct.starting_centres(s, 3)
        for _ in range(200):
            u = 1 / np.maximum(((x[:, None] - c[None]) ** 2) @ w, 1e-9)
            u /= u.sum(1, keepdims=True)
            c = (u**2).T @ x / (u**2).sum(0)[:, None]
        member = {r["id"]: r["membership"] for r in got}
        assert np.array([member[r["id"]] for r in rows]) == pytest.approx(u, abs=1e-3)
    if name == "cluster_means":
        e = embeddings(spark, d)
        label = {r["id"]: r["cluster"] for r in got}
        rows = [(np.array(r["data"], float), label[r["id"]]) for r in e.df.collect()]
        x, at = np.stack([r[0] for r in rows]), np.array([r[1] for r in rows])
        c = np.stack([x[at == k].mean(0) for k in range(5)])
        assert (((x[:, None] - c[None]) ** 2 @ e.weights()).argmin(1) == at).all()
    if name == "anova_test":
        assert tuple(got[0]) == nf.oneway_anova(embeddings(spark, d), "label", 2000)


def test_elastic_mean_is_the_default_template(spark, monkeypatch):
    t = np.linspace(0, 1, 40)
    bump = lambda c: np.exp(-((t - c) ** 2) / 0.01)
    frame = spark.createDataFrame([(k, bump(c).tolist()) for k, c in enumerate((0.4, 0.5, 0.6))], "id bigint, data array<double>")
    curves = Curves(frame, GridMeta.of(t))
    plain, mean = st.moments(curves)[1], rg.karcher_mean(curves)
    assert mean.max() > 0.9 > plain.max() and abs(t[mean.argmax()] - 0.5) < 0.06
    aligned = [np.array(r["data"]) for r in rg.elastic_registration(curves).df.collect()]
    assert max(np.abs(a - mean).max() for a in aligned) < 0.25
    asked = []
    monkeypatch.setattr(rg, "karcher_mean", lambda c, *a, **k: asked.append(c) or st.moments(c)[1])
    entry.queries()["register_elastic"](spark, "/root/testdata/sf0.001")
    assert len(asked) == 1
