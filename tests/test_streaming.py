import datetime as dt

from curvelake.meta import GridMeta
from curvelake.operators.missing import fill_missing
from curvelake.streaming.windows import on_closed_curves, session_statistics, windowed_curves

SCHEMA = "k bigint, ts timestamp, x double, id string"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_windows_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rows = [(1, at(5), 1.0, "c"), (1, at(7), 3.0, "c"), (1, at(35), 5.0, "c"), (2, at(61), 9.0, "c"), (1, at(4), None, "c"), (None, at(4), 1.0, "c"), (2, at(400), 1.0, "c")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(source)
    static = windowed_curves(spark.read.parquet(source), "k", "ts", "x", "1 hour", 4)
    want = {(r["id"], r["window_start"]): r["data"] for r in static.collect()}
    assert want[(1, at(0))] == [2.0, None, 5.0, None]
    seen = {}

    def work(curves, number):
        for r in fill_missing(curves).df.collect():
            seen[(r["id"], r["window_start"])] = r["data"]

    stream = windowed_curves(spark.readStream.schema(SCHEMA).parquet(source), "k", "ts", "x", "1 hour", 4)
    q = on_closed_curves(stream, GridMeta.regular(4), work).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert seen[(1, at(0))] == [2.0, 3.5, 5.0, 5.0] and set(seen) <= set(want)


def test_sessions(spark):
    rows = [(1, at(0), 1.0, "c"), (1, at(5), 3.0, "c"), (1, at(60), 7.0, "c")]
    got = session_statistics(spark.createDataFrame(rows, SCHEMA), "k", "ts", "x", "10 minutes").orderBy("session_start").collect()
    assert [(r["n"], r["mean"]) for r in got] == [(2, 2.0), (1, 7.0)]
