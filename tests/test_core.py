import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelake.core.regular import SeasonSettings, regular_grid, usable_readings
from curvelake.core.spikes import ChartSettings, implausible_cells

DAYS = "id bigint, source_id bigint, station_id int, obs_date date, data_matrix array<double>, received_at timestamp, coordinate string, day int, cells string"
SOURCES = "source_id bigint, coordinate string, block int"


def day(i, source, date, cells, received=0):
    at = dt.datetime(2024, 2, 1) + dt.timedelta(hours=received)
    return (i, source, 1, None if date is None else dt.date(2024, 1, 1) + dt.timedelta(days=date), cells, at, "clash", -1, "clash")


def series(seed, days, base=15.0, noise=0.3):
    rng = np.random.default_rng(seed)
    t = np.arange(days * 24)
    return np.round(base + 4 * np.sin(2 * np.pi * t / 24) + noise * rng.standard_normal(days * 24), 1).reshape(days, 24)


@pytest.fixture(scope="module")
def station(spark):
    x = series(0, 30)
    clean = x.copy()
    x[5, 10] += 25
    x[9, 3:5] -= 20
    x[12, 20:] = x[12, 20]
    x[13, :8] = x[12, 20]
    x[20, 7] = -999.0
    rows = [[None if v is None else float(v) for v in r] for r in x]
    rows[15][4], rows[15][5] = None, float("nan")
    data = [day(k + 1, 1, k, r) for k, r in enumerate(rows)]
    data += [day(101, 1, 5, clean[5].tolist(), received=9)]  # mended later
    data += [day(102, 1, 9, rows[9], received=9)]  # delivered again
    data += [day(103, 1, 40, None), day(104, 1, 41, []), day(105, None, 3, [1.0] * 24), day(106, 1, None, rows[3]), day(107, 9, 2, [-5.0, -4.0] * 12), day(108, 2, 3, [None] * 24)]
    sources = spark.createDataFrame([(1, "temperature", 7), (1, "temperature", 7), (2, "humidity", 7), (3, None, 7)], SOURCES)
    return spark.createDataFrame(data, DAYS), sources


EXPECTED = {(6, 10), (10, 3), (10, 4), (102, 3), (102, 4), (21, 7)} | {(13, p) for p in range(20, 24)} | {(14, p) for p in range(8)}


def test_spikes_frozen_and_impossible(station):
    got = {(r["id"], r["pos"]): r["reason"] for r in implausible_cells(*station).collect()}
    assert set(got) == EXPECTED
    assert got[(6, 10)] == "spike" and got[(21, 7)] == "impossible" and got[(13, 23)] == "frozen"


def test_a_long_history_is_judged_the_same_in_blocks(spark, station):
    curves, sources = station
    got = {(r["id"], r["pos"]) for r in implausible_cells(curves, sources, ChartSettings(block_days=15)).collect()}
    assert EXPECTED - got == set() and len(got - EXPECTED) <= 1


def test_lasting_level_changes_and_rest_at_limits_are_no_cases(spark):
    x = series(1, 30)
    x[15:] += 20
    wet = np.clip(series(2, 30, 97, 1.0), 0, 100)
    wet[10] = 100
    rows = [day(k, 1, k, r.tolist()) for k, r in enumerate(x)] + [day(100 + k, 2, k, r.tolist()) for k, r in enumerate(wet)]
    sources = spark.createDataFrame([(1, "temperature", 0), (2, "humidity", 0)], SOURCES)
    assert implausible_cells(spark.createDataFrame(rows, DAYS), sources).count() == 0


@pytest.mark.parametrize("planted", [0, 40, 60, 61, 120, 500])
def test_any_number_of_spikes_and_frozen_runs(spark, planted):
    x = series(4, 128).ravel()
    at = 2 + np.arange(planted) * (len(x) - 4) // max(planted, 1)
    x[at] += 40
    rows = [day(k + 1, 1, k, r.tolist()) for k, r in enumerate(x.reshape(-1, 24))]
    y = series(5, 128).reshape(-1)
    runs = np.arange(min(planted, 120)) * (len(y) // 120) + 5
    for a in runs:
        y[a : a + 12] = y[a]
    rows += [day(1000 + k, 2, k, r.tolist()) for k, r in enumerate(y.reshape(-1, 24))]
    sources = spark.createDataFrame([(1, "temperature", 7), (2, "temperature", 7)], SOURCES)
    table = spark.createDataFrame(rows, DAYS)
    got = [{(r["id"], r["pos"]) for r in implausible_cells(table, sources, ChartSettings(block_days=n)).collect()} for n in (16, 64, 1000)]
    want = {(1 + i // 24, i % 24) for i in at.tolist()}
    assert got[0] == got[1] == got[2]
    assert {c for c in got[0] if c[0] < 1000} == want
    held = {(1000 + i // 24, i % 24) for a in runs.tolist() for i in range(a, a + 12)}
    beyond = {c for c in got[0] if c[0] >= 1000} - held
    assert held <= got[0] and all(24 * (d - 1000) + p - 1 in (runs + 11) or 24 * (d - 1000) + p + 1 in runs for d, p in beyond)  # a neighbour may happen to be equal


def test_a_segment_of_many_deliveries_is_spread(station, spark):
    curves, sources = station
    many = curves.unionByName(spark.range(60).selectExpr("1000 + id as id").crossJoin(curves.where("id = 101").drop("id")).select(curves.columns))
    want = {(r["id"], r["pos"]) for r in implausible_cells(many, sources).collect()}
    got = [(r["id"], r["pos"]) for r in implausible_cells(many, sources, ChartSettings(most_deliveries=7)).collect()]
    assert set(got) == want == EXPECTED and len(got) == len(want)


def test_empty_tables_give_empty_results(spark):
    none, sources = spark.createDataFrame([], DAYS), spark.createDataFrame([], SOURCES)
    assert implausible_cells(none, sources).count() == 0
    assert regular_grid(spark.createDataFrame([], READ), spark.createDataFrame([], IRREGULAR)).count() == 0
    one = spark.createDataFrame([day(1, 5, 1, [float("inf"), 1.0])], DAYS)
    assert [tuple(r) for r in implausible_cells(one, sources).collect()] == [(1, 0, "impossible")]


READ = "reading_id bigint, source_id bigint, args double, vals double, slot string, value string, model int"
IRREGULAR = "source_id bigint, encoding string, step_min int, missing_code double, active_from bigint, active_to bigint, coef string, block int"


@pytest.fixture(scope="module")
def readings(spark):
    rng = np.random.default_rng(3)
    rows, truth = [], {}
    for slot in range(10, 610):
        t = slot * 10 + 5.0
        v = 10 + 0.001 * t + 3 * math.cos(2 * math.pi * t / 1440) + math.sin(2 * math.pi * t / 720)
        truth[slot] = v
        if 200 <= slot < 260 or slot in (10, 609):
            continue
        rows.append((slot, 1, t + float(rng.uniform(-4, 4)), v, "x", "x", 1))
    rows += [(5000, 1, 2105.0, -9999.0, "x", "x", 1), (5001, 1, 2205.0, None, "x", "x", 1), (5002, 1, 2305.0, float("nan"), "x", "x", 1), (5003, 1, 2405.0, float("inf"), "x", "x", 1), (5004, 1, None, 1.0, "x", "x", 1), (5005, 1, float("nan"), 1.0, "x", "x", 1), (5006, 1, 9e9, 1.0, "x", "x", 1), (5007, 8, 100.0, 1.0, "x", "x", 1), (5008, None, 100.0, 1.0, "x", "x", 1)]
    rows += [rows[0], rows[0]]
    sources = [(1, "irregular", 10, -9999.0, 100, 6100, "x", 1), (1, "irregular", 10, -9999.0, 100, 6100, "x", 1), (2, "irregular", 60, None, 0, 120, "x", 1), (3, "grid", 60, None, 0, 120, "x", 1), (4, "irregular", None, None, 0, 10, "x", 1), (5, "irregular", 10, None, 50, 50, "x", 1), (None, "irregular", 10, None, 0, 10, "x", 1)]
    return spark.createDataFrame(rows, READ), spark.createDataFrame(sources, IRREGULAR), truth


@pytest.mark.parametrize("size", [4096, 64])
def test_gaps_are_found_and_filled(readings, size):
    table, sources, truth = readings
    got = {(r["source_id"], r["slot"]): r for r in regular_grid(table, sources, SeasonSettings(block_slots=size)).collect()}
    assert {s for s, _ in got} == {1, 2} and len(got) == 602
    assert {k for k, r in got.items() if r["is_missing"]} == {(1, s) for s in [10, 609, *range(200, 260)]} | {(2, 0), (2, 1)}
    assert got[(2, 0)]["value"] is None
    assert max(abs(got[(1, s)]["value"] - truth[s]) for s in range(200, 260)) < 0.05
    assert got[(1, 11)]["n_readings"] == 3 and got[(1, 11)]["at"] == 110


def test_bridges_meet_both_ends(spark):
    rows = [(i, 1, t, v, "x", "x", 1) for i, (t, v) in enumerate([(5.0, 1.0), (15.0, 2.0), (45.0, 8.0)])]
    sources = [(1, "irregular", 10, None, 0, 60, "x", 1)]
    got = {r["slot"]: r["value"] for r in regular_grid(spark.createDataFrame(rows, READ), spark.createDataFrame(sources, IRREGULAR)).collect()}
    assert got == pytest.approx({0: 1, 1: 2, 2: 4, 3: 6, 4: 8, 5: 8})


def test_usable_readings_of_ties(readings):
    table, sources, _ = readings
    n = usable_readings(table, sources.where("source_id = 1").dropDuplicates()).groupBy("slot").agg(F.count("value").alias("n"))
    assert n.where("slot = 11").first()["n"] == 3
