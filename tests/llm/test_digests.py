import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelake.llm.digests import DigestSettings, build_digests, certified, cluster, certified_curves, curve_cells, curve_digests, curves_of, estimates, grid_points, merge_digests, quantile

KEYS = ["grouping"]


def percentiles(values, settings=None):
    merged = merge_digests(build_digests(values, KEYS, settings=settings), KEYS, settings)
    return certified(values, estimates(merged, KEYS), KEYS)


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(0)
    rows = [("normal", float(v), int(k % 7)) for k, v in enumerate(rng.normal(size=6000))] + [("heavy", float(v), 1) for v in rng.standard_cauchy(3000)]
    rows += [("same", 4.0, k % 3) for k in range(500)] + [("one", -2.5, 0), (None, 1.0, 0), ("none", None, 0), ("none", float("nan"), 0), ("one", float("inf"), 0)]
    return spark.createDataFrame(rows, "grouping string, value double, means int").repartition(6)


def test_rank_errors_are_small_and_exact(values):
    got = percentiles(values).collect()
    x = {g: np.array([r["value"] for r in values.where(F.col("grouping").eqNullSafe(g)).collect() if r["value"] is not None and np.isfinite(r["value"])]) for g in ("normal", "heavy", "same", "one", None)}
    assert len(got) == 5 * 7
    for r in got:
        own = x[r["grouping"]]
        assert r["n"] == len(own) and r["rank_below"] == (own < r["value"]).sum() and r["rank_upto"] == (own <= r["value"]).sum()
        assert r["rank_error"] <= 0.004
    assert {r["value"] for r in got if r["grouping"] == "same"} == {4.0} and {r["value"] for r in got if r["grouping"] == "one"} == {-2.5}


def test_parts_combine(values):
    days = build_digests(values.withColumnRenamed("means", "day"), [*KEYS, "day"])
    tiny = DigestSettings(fan_in=2, group_buffer=100, task_buffer=500)
    a = {(r["grouping"], r["percentile"]): r["rank_error"] for r in percentiles(values, tiny).collect()}
    assert len(a) == 35 and max(a.values()) <= 0.008
    whole = estimates(merge_digests(days.drop("day"), KEYS), KEYS)
    assert max(r["rank_error"] for r in certified(values, whole, KEYS).collect()) <= 0.008


def test_cluster_keeps_weight_and_extremes():
    v = np.random.default_rng(1).normal(size=10_000)
    m, w = cluster(v, np.ones(len(v)), 200)
    assert w.sum() == 10_000 and m[0] == v.min() and m[-1] == v.max() and len(m) < 250
    assert abs(quantile(m, w, 0.5) - np.median(v)) < 0.02
    assert quantile(np.array([1.0]), np.array([1.0]), 0.3) == 1.0


def test_empty(spark):
    assert percentiles(spark.createDataFrame([], "grouping string, value double")).count() == 0


def test_cells_of_both_tables(spark):
    days = spark.createDataFrame([(1, 7, 3, [1.0, None, float("nan")]), (2, 8, None, None)], "id bigint, source_id bigint, station_id int, data_matrix array<double>").withColumn("obs_date", F.lit("2024-01-01").cast("date"))
    spectra = spark.createDataFrame([(1, [5.0, 6.0, 7.0, 8.0])], "id bigint, data_matrix array<double>").withColumn("measured_at", F.lit("2024-01-01").cast("timestamp"))
    sources = spark.createDataFrame([(7, "nox")], "source_id bigint, coordinate string")
    meta = spark.createDataFrame([("station_days", ["reading"], [0.5, 1.5, 2.5]), ("spectra", ["absorbance"], [850.0, 852.0, 854.0])], "dataset string, coordinate_names array<string>, grid_points array<double>")
    points = grid_points(meta)
    curves = curves_of(days, spectra, sources, points)
    got = sorted((r["dataset"], r["grouping"], r["key"], r["value"]) for r in curve_cells(curves, points).collect())
    assert ("station_days", "coordinate", "nox", 1.0) in got and ("station_days", "station", "3", 1.0) in got and ("station_days", "occupied", "all", 0.5) in got
    assert sum(g[0] == "spectra" and g[1] == "coordinate" for g in got) == 4 and sum(g[0] == "spectra" and g[1] == "grid_point" for g in got) == 3
    keys = ["dataset", "grouping", "key"]
    cells = curve_cells(curves, points)
    want = sorted(map(tuple, certified(cells, estimates(merge_digests(build_digests(cells, keys), keys), keys), keys).collect()))
    for by_part in (False, True):
        own = curve_digests(curves, points, by_part).drop("date")
        found = estimates(merge_digests(own, keys), keys)
        assert sorted(map(tuple, certified_curves(curves, points, found).collect())) == want
        assert sorted(map(tuple, certified_curves(curves, points, found, settings=DigestSettings(most_broadcast=1)).collect())) == want


def test_curves_without_cells_or_meta(spark):
    days = spark.createDataFrame([(1, 7, None, [1.0, 2.0]), (2, None, 3, []), (3, 7, 3, None)], "id bigint, source_id bigint, station_id int, data_matrix array<double>").withColumn("obs_date", F.lit(None).cast("date"))
    spectra = spark.createDataFrame([], "id bigint, data_matrix array<double>, measured_at timestamp")
    sources = spark.createDataFrame([], "source_id bigint, coordinate string")
    meta = grid_points(spark.createDataFrame([], "dataset string, coordinate_names array<string>, grid_points array<double>"))
    curves = curves_of(days, spectra, sources, meta)
    keys = ["dataset", "grouping", "key"]
    got = certified_curves(curves, meta, estimates(merge_digests(curve_digests(curves, meta), keys), keys)).collect()
    assert {(r["dataset"], r["grouping"], r["key"], r["n"]) for r in got} == {("station_days", "coordinate", None, 2)}


def test_repeated_values_are_hit(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 2, 20_000).round(0)
    got = percentiles(spark.createDataFrame([("ties", float(v)) for v in x], "grouping string, value double").repartition(5)).collect()
    assert all(r["value"] in x and r["rank_error"] <= 0.0001 and r["rank_below"] == (x < r["value"]).sum() and r["rank_upto"] == (x <= r["value"]).sum() for r in got)
