"""Implausible readings in gridded measurements (problem 1).

Every source gets a robust exponentially weighted control chart over its own history. What is
charted is the logarithm of the hourly moves, in units of the source's usual move, so that one
limit serves quiet and restless sources. A suspected move is clipped to the control limit before it
updates mean and scale, so a spike neither widens the limits nor drags the level; of what the chart
lets pass the source's mean and scale are pooled. A run-length counter charts how often the source
repeats a reading.

* ``impossible`` - outside the physical limits of the coordinate;
* ``spike`` - one or two readings that leave the readings on both sides by more than the chart's
  limit at that date and by more than the source's pooled limit;
* ``frozen`` - a run of equal readings longer than the repeat rate of the source allows, not at a
  natural limit of the quantity.

The chart is built from one delivery a date (the last received). Every delivery is judged by its own
cells between the charted readings before and after its date, so an unchanged repeat gives the same
cells and a mended one none.

Histories are charted in segments of the calendar, each with some days before and after it; their
sums make the limits of the source, so a source may be any share of the rows. All segments of an
Arrow batch are charted at once, step by step over columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.session import checkpoint

#: Physical limits of an hourly reading, by coordinate.
PHYSICAL_LIMITS = {
    "temperature": (-90.0, 60.0),
    "humidity": (0.0, 100.0),
    "wind_speed": (0.0, 115.0),
    "precipitation": (0.0, 400.0),
    "nox": (0.0, 10000.0),
    "pressure": (500.0, 1100.0),
}
#: Where a quantity may rest for long.
NATURAL_LIMITS = {
    "humidity": (0.0, 100.0),
    "wind_speed": (0.0,),
    "precipitation": (0.0,),
    "nox": (0.0,),
}


@dataclass(frozen=True)
class ChartSettings:
    """What the charts take as given."""

    #: weight of a new move in the chart's mean and scale
    weight: float = 0.03
    #: a move further from the mean than this many scales is suspected, and clipped to that
    control_limit: float = 2.5
    #: moves to and from a reading further out than this, by the medians, are not charted at all
    first_limit: float = 3.0
    #: a spike's limit is the pooled mean and this many scales times sqrt(ln n) after n moves, for the
    #: largest of more moves lies further out
    spike_limit: float = 1.32
    #: least scale of the logarithms, for readings of few different sizes
    least_scale: float = 0.4
    #: added to moves before the logarithm, in usual moves
    offset: float = 0.5
    #: a run is frozen where the source would hold so many as long by chance at most
    chance: float = 0.01
    shortest_frozen: int = 6
    #: a run of so many readings is frozen whatever the source repeats
    longest_repeat: int = 72
    #: readings further apart than this many steps are no neighbours; of further than this, no move
    reach: int = 30
    move_reach: int = 3
    #: days of a segment, and those before and after it that are charted with it
    block_days: int = 64
    halo_days: int = 4
    #: deliveries of a segment in one task; more are spread over several, each with the charted ones
    most_deliveries: int = 20_000
    cells: int = 24
    limits: dict = field(default_factory=lambda: dict(PHYSICAL_LIMITS))
    natural: dict = field(default_factory=lambda: dict(NATURAL_LIMITS))


_OUT = pa.schema([
    ("source_key", pa.int64()), ("moves", pa.int64()), ("total", pa.float64()), ("squares", pa.float64()), ("units", pa.float64()), ("runs", pa.int64()), ("repeats", pa.int64()),
    ("id", pa.int64()), ("pos", pa.int32()), ("size", pa.float64()), ("run", pa.int64()), ("impossible", pa.bool_()),
])
_OUT_SQL = (
    "source_key bigint, moves bigint, total double, squares double, units double, runs bigint, repeats bigint, "
    "id bigint, pos int, size double, run bigint, impossible boolean"
)
#: readings before and after a delivery that its cells are judged between
_SIDE = 3


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Where a new value of any of the keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _medians(values: np.ndarray, group: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The upper median of each group's values; groups lie together and none is empty."""
    order = np.argsort(values)
    local = group[order] - group[0]
    if len(local) and group[-1] - group[0] < 65_536:
        local = local.astype(np.uint16)  # sorted by digits
    return values[order[np.argsort(local, kind="stable")][starts + sizes // 2]]


def _chart(y: np.ndarray, group: np.ndarray, s: ChartSettings) -> tuple[np.ndarray, ...]:
    """Mean and scale before every value, the clipped values, and the last state of each group (in order)."""
    starts = _edges(group)
    sizes = np.diff(np.r_[starts, len(y)])
    middle = _medians(y, group, starts, sizes)
    off = np.abs(y - np.repeat(middle, sizes))
    scale = np.maximum(s.least_scale, 1.4826 * _medians(off, group, starts, sizes))
    order = np.argsort(-sizes, kind="stable")  # the longest first: those still running are the first ones
    first, live = starts[order], sizes[order]
    mean, var = middle[order].copy(), scale[order] ** 2
    before, spread, clipped = np.empty(len(y)), np.empty(len(y)), np.empty(len(y))
    k, least = len(order), s.least_scale**2
    for t in range(int(live[0]) if len(live) else 0):
        while live[k - 1] <= t:
            k -= 1
        at, m, v = first[:k] + t, mean[:k], var[:k]
        sd = np.sqrt(v)
        before[at], spread[at] = m, sd
        d = y[at] - m
        limit = s.control_limit * sd
        np.minimum(np.maximum(d, -limit, out=d), limit, out=d)
        clipped[at] = m + d
        m += s.weight * d
        v += s.weight * (d * d - v)
        np.maximum(v, least, out=v)
    last_mean, last_scale = np.empty(len(order)), np.empty(len(order))
    last_mean[order], last_scale[order] = mean, np.sqrt(var)
    return before, spread, clipped, last_mean, last_scale


def _apart(size: np.ndarray, move: np.ndarray, leaves: np.ndarray, group: np.ndarray, s: ChartSettings) -> np.ndarray:
    """Moves to and from readings that leave both sides by more than the chart's first limit, from medians alone."""
    out = np.zeros(len(size), bool)
    at = np.flatnonzero(move)
    if not len(at):
        return out
    g = group[at]
    starts = _edges(g)
    sizes = np.diff(np.r_[starts, len(at)])
    unit, middle, scale = (np.full(group[-1] + 1, np.nan) for _ in range(3))
    unit[g[starts]] = _medians(size[at], g, starts, sizes)
    y = np.log(size[at] / unit[g] + s.offset)
    middle[g[starts]] = _medians(y, g, starts, sizes)
    scale[g[starts]] = np.maximum(s.least_scale, 1.4826 * _medians(np.abs(y - middle[g]), g, starts, sizes))
    far = np.log(leaves / unit[group] + s.offset) > middle[group] + s.first_limit * scale[group]
    out[at] = far[at] | far[at - 1]
    return out


def _counters(x: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run-length counters: equal readings up to each one, and from each one on."""
    n = len(x)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = joined & np.r_[False, x[1:] == x[:-1]]
    begin = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    more = np.r_[same[1:], False]
    end = np.minimum.accumulate(np.where(more, n, np.arange(n))[::-1])[::-1]
    return np.arange(n) - begin + 1, end - np.arange(n) + 1


def _departures(x: np.ndarray, hour: np.ndarray, part: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """By how much each reading, and each pair that begins with it, leaves the readings on both sides (0: not at all)."""
    n = len(x)
    near = np.zeros(n + 1, bool)  # near[i]: i - 1 and i are neighbours
    near[1:n] = (part[1:] == part[:-1]) & (hour[1:] - hour[:-1] <= reach)

    def at(a: np.ndarray, k: int) -> np.ndarray:
        """The readings k places on; what lies beyond either end is not used."""
        out = np.zeros_like(a)
        if k > 0:
            out[:-k] = a[k:]
        else:
            out[-k:] = a[:k]
        return out

    left, right = near[:n], near[1:]
    two_on = right & np.r_[near[2:], False][:n] & (at(hour, 2) - hour <= reach)
    two_back = left & np.r_[False, near[: n - 1]] & (hour - at(hour, -2) <= reach)
    a = np.where(left, at(x, -1), np.where(two_on, at(x, 1), np.nan))  # at an end of the record two readings on one side count
    b = np.where(right, at(x, 1), np.where(two_back, at(x, -1), np.nan))
    a = np.where(left | ~two_on, a, at(x, 1))
    b = np.where(~left & two_on, at(x, 2), np.where(~right & two_back, at(x, -2), b))
    one = np.maximum(x - np.maximum(a, b), np.minimum(a, b) - x)
    one = np.where((left | two_on) & (right | two_back), one, 0)
    after = np.r_[near[2:], False][:n]
    high, low = np.maximum(at(x, -1), at(x, 2)), np.minimum(at(x, -1), at(x, 2))
    pair = np.maximum(np.minimum(x, at(x, 1)) - high, low - np.maximum(x, at(x, 1)))
    pair = np.where(left & right & after, pair, 0)
    return np.nan_to_num(np.maximum(one, 0)), np.maximum(pair, 0)


def _spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices lo..hi-1 of all rows one after another, and the row of each."""
    size = np.maximum(hi - lo, 0)
    row = np.repeat(np.arange(len(lo)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[row], row


def _judged(t: pa.Table, s: ChartSettings) -> pa.Table:
    """Segments' sums and suspected cells of whole groups; rows stand in the order of ``implausible_cells``."""
    num = lambda name, none: t.column(name).combine_chunks().fill_null(none).to_numpy(zero_copy_only=False)
    source, segment = num("source_key", 0), num("at", 0)
    group_start = _edges(source, segment, num("salt", 0))
    group = np.cumsum(np.isin(np.arange(t.num_rows), group_start)) - 1
    coordinate = np.full(len(group_start), None, object)
    heads = np.flatnonzero(num("head", False))
    coordinate[group[heads]] = np.array(t.column("coordinate").combine_chunks().take(pa.array(heads)).to_pylist(), object)
    rows = np.flatnonzero(~num("head", False))
    if not len(rows):
        return _OUT.empty_table()
    low, high = (np.array([s.limits.get(c, (-math.inf, math.inf))[k] for c in coordinate]) for k in (0, 1))
    lists = t.column("cells").combine_chunks().take(pa.array(rows))
    length = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)  # null cells become NaN
    ids, day, own, group = num("id", 0)[rows], num("day", 0)[rows].astype(np.int64), num("own", False)[rows], group[rows]
    which = np.repeat(np.arange(len(rows)), length)
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    g = group[which]
    usable = np.isfinite(flat) & (flat >= low[g]) & (flat <= high[g])
    bad = ~usable & ~np.isnan(flat) & own[which]

    # the charted readings: of each date the last delivery
    charted = np.r_[(group[1:] != group[:-1]) | (day[1:] != day[:-1]), True]
    take = usable & charted[which]
    x, hour, xg, xday = flat[take], day[which[take]] * s.cells + pos[take], g[take], day[which[take]]
    own_day = np.abs(np.floor_divide(xday, s.block_days) - segment[group_start][xg]) == 0
    joined = np.r_[False, (xg[1:] == xg[:-1]) & (np.diff(hour) <= s.reach)] if len(x) else np.zeros(0, bool)
    back, on = _counters(x, joined)

    size = np.abs(np.diff(x, prepend=np.nan)) if len(x) else x
    move = np.zeros(len(x), bool)
    move[1:] = (xg[1:] == xg[:-1]) & (np.diff(hour) <= s.move_reach) & (size[1:] > 0)
    one, pair = _departures(x, hour, xg, s.reach)
    leaves = np.maximum(one, np.maximum(pair, np.r_[0, pair[:-1]] if len(pair) else pair))
    move &= ~_apart(size, move, leaves, xg, s)
    moved = np.flatnonzero(move)
    groups = len(group_start)
    unit, mean, scale = np.full(groups, np.nan), np.full(groups, np.nan), np.full(groups, np.nan)
    state_mean, state_scale = np.zeros(0), np.zeros(0)
    clipped = np.zeros(0)
    mg = xg[moved]
    if len(moved):
        first = _edges(mg)
        unit[mg[first]] = _medians(size[moved], mg, first, np.diff(np.r_[first, len(mg)]))
        y = np.log(size[moved] / unit[mg] + s.offset)
        state_mean, state_scale, clipped, last_mean, last_scale = _chart(y, mg, s)
        mean[mg[first]], scale[mg[first]] = last_mean, last_scale
    pooled = own_day[moved]
    sums = lambda w: np.bincount(mg[pooled], w[pooled], groups)
    n_moves = np.bincount(mg[pooled], minlength=groups)

    # repeat rates: runs that begin on the segment's own days, but for those at a natural limit
    rests = np.zeros(len(x), bool)
    for name, values in s.natural.items():
        of = coordinate[xg] == name if len(x) else np.zeros(0, bool)
        if of.any():
            rests |= of & np.isin(x, values)
    begins = (back == 1) & own_day & ~rests
    n_runs, n_repeats = np.bincount(xg[begins], minlength=groups), np.bincount(xg[begins & (on > 1)], minlength=groups)

    # the chart's state at the date of every own delivery: before the first move of the day, or after the last of the segment
    key, stride = xg * 2**32 + (xday + 2**31), 2**32
    at_day = group * stride + (day + 2**31)
    start = np.searchsorted(key, at_day, "left")
    done = np.cumsum(move)
    n_before = np.where(start > 0, done[np.maximum(start - 1, 0)] if len(done) else 0, 0)
    at = np.minimum(n_before, max(len(moved) - 1, 0))
    same = (n_before < len(moved)) & ((mg[at] if len(moved) else np.zeros(len(at), int)) == group)
    row_mean = np.where(same, state_mean[at] if len(moved) else 0, mean[group])
    row_scale = np.where(same, state_scale[at] if len(moved) else 0, scale[group])

    # a charted delivery stands in the chart itself; others are put between the charted readings before and after their date
    seen = own[which[np.flatnonzero(take)]]
    mine = np.flatnonzero(own & ~charted)
    stop = np.searchsorted(key, at_day[mine], "right")
    edge = np.searchsorted(xg, np.arange(groups + 1))
    b_at, b_row = _spans(np.maximum(start[mine] - _SIDE, edge[group[mine]]), start[mine])
    a_at, a_row = _spans(stop, np.minimum(stop + _SIDE, edge[group[mine] + 1]))
    row_of = np.full(len(rows), -1)
    row_of[mine] = np.arange(len(mine))
    c_at = np.flatnonzero(usable & (row_of >= 0)[which])
    c_row = row_of[which[c_at]]
    part = np.r_[b_row, c_row, a_row]
    order = np.argsort(part, kind="stable")
    part = part[order]
    value = np.r_[x[b_at], flat[c_at], x[a_at]][order]
    when = np.r_[hour[b_at], day[which[c_at]] * s.cells + pos[c_at], hour[a_at]][order]
    cell = np.r_[np.full(len(b_at), -1), c_at, np.full(len(a_at), -1)][order]
    one, pair = _departures(value, when, part, s.reach)
    put = np.maximum(one, np.maximum(pair, np.r_[0, pair[:-1]] if len(pair) else pair))
    linked = np.r_[False, (part[1:] == part[:-1]) & (np.diff(when) <= s.reach)] if len(part) else np.zeros(0, bool)
    up, down = _counters(value, linked)
    # at the ends of a delivery's stretch the run goes on in the charted readings
    at_x = np.r_[b_at, np.full(len(c_at), -1), a_at][order]
    outer = at_x >= 0
    total = up + down - 1
    if len(value):
        more_back = np.where(outer, back[np.maximum(at_x, 0)] - up if len(back) else 0, 0)
        more_on = np.where(outer, on[np.maximum(at_x, 0)] - down if len(on) else 0, 0)
        total = total + np.maximum(more_back[np.arange(len(value)) - up + 1], 0) + np.maximum(more_on[np.arange(len(value)) + down - 1], 0)
    inner = cell >= 0
    cell = np.r_[np.flatnonzero(take)[seen], cell[inner]]
    leaves = np.r_[leaves[seen], put[inner]]
    total = np.r_[(back + on - 1)[seen], total[inner]]
    value = np.r_[x[seen], value[inner]]
    row = which[cell]
    pg = group[row]
    with np.errstate(invalid="ignore", divide="ignore"):
        suspected = np.log(leaves / unit[pg] + s.offset) > row_mean[row] + s.control_limit * row_scale[row]
    suspected &= leaves > 0
    frozen = total >= s.shortest_frozen
    for name, values in s.natural.items():
        of = coordinate[pg] == name if len(pg) else np.zeros(0, bool)
        if of.any():
            frozen &= ~(of & np.isin(value, values))

    hit = np.flatnonzero(suspected | frozen)
    found = np.r_[cell[hit], np.flatnonzero(bad)]
    k = len(found)
    said = np.r_[np.where(suspected[hit], leaves[hit], np.nan), np.full(k - len(hit), np.nan)]
    runs = np.r_[np.where(frozen[hit], total[hit], 0), np.zeros(k - len(hit), np.int64)].astype(np.int64)
    pool = np.flatnonzero(((n_moves > 0) | (n_runs > 0)) & (num("salt", 0)[group_start] == 0))  # every salt has the charted readings
    blank = lambda n, kind: pa.nulls(n, kind)
    stats = pa.table([
        pa.array(source[group_start][pool]), pa.array(n_moves[pool]), pa.array(sums(clipped)[pool]), pa.array(sums(clipped**2)[pool]),
        pa.array(np.nan_to_num(n_moves * np.log(np.where(np.isnan(unit), 1, unit)))[pool]), pa.array(n_runs[pool]), pa.array(n_repeats[pool]),
        *[blank(len(pool), f.type) for f in list(_OUT)[7:]],
    ], schema=_OUT)
    cells = pa.table([
        pa.array(source[group_start][g[found]]), *[blank(k, f.type) for f in list(_OUT)[1:7]],
        pa.array(ids[which[found]]), pa.array(pos[found].astype(np.int32)), pa.array(said, from_pandas=True), pa.array(runs), pa.array(np.arange(k) >= len(hit)),
    ], schema=_OUT)
    return pa.concat_tables([stats, cells])


def _whole_groups(batches: Iterator[pa.RecordBatch], s: ChartSettings, rows: int = 65_536) -> Iterator[pa.RecordBatch]:
    """Judge the batches' rows, some tens of thousands at a time, never parting a group."""
    held: list = []
    count = 0
    for b in batches:
        held.append(b)
        count += b.num_rows
        if count < rows:
            continue
        t = pa.Table.from_batches(held)
        keys = [t.column(k).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for k in ("source_key", "at", "salt")]
        cut = int(_edges(*keys)[-1])
        if cut:
            yield from _judged(t.slice(0, cut), s).to_batches()
            held, count = t.slice(cut).to_batches(), t.num_rows - cut
    if count:
        yield from _judged(pa.Table.from_batches(held), s).to_batches()


def _beyond(x: Column, coordinate: Column, limits: dict) -> Column:
    low, high = F.lit(-math.inf), F.lit(math.inf)
    for name, (a, b) in limits.items():
        low, high = F.when(coordinate == name, F.lit(a)).otherwise(low), F.when(coordinate == name, F.lit(b)).otherwise(high)
    return x.isNotNull() & ~F.isnan(x) & ((F.abs(x) == math.inf) | (x < low) | (x > high))


def implausible_cells(curves: DataFrame, sources: DataFrame, settings: ChartSettings | None = None) -> DataFrame:
    """``(id, pos, reason)``: one row per implausible cell of ``curves``.

    ``curves``: ``id, source_id, obs_date, data_matrix, received_at``; ``sources``: ``source_id,
    coordinate``. Other columns are ignored, whatever their names. A source missing from
    ``sources`` or with a null or unknown coordinate has no physical limits. Curves with a null
    source or date have no history and are judged by the physical limits alone. Null and NaN cells
    are no cases; null and empty arrays give no rows; repeated rows give their cells each time.
    An empty table gives an empty result. A source without any move has no spikes.

    A task charts some segments of ``block_days`` days. A segment of more than ``most_deliveries``
    deliveries is the work of several tasks, each with the charted delivery of every date.
    """
    s = settings or ChartSettings()
    kinds = sources.where("source_id is not null").groupBy(F.col("source_id").cast("long").alias("source_key")).agg(F.max("coordinate").alias("coordinate"))
    flat = curves.select(
        F.col("id").cast("long").alias("id"), F.col("source_id").cast("long").alias("source_key"), F.unix_date("obs_date").alias("day"),
        F.col("data_matrix").cast("array<double>").alias("cells"), F.col("received_at").cast("timestamp").alias("received"),
    )
    dated = "source_key is not null and day is not null"
    segment = lambda shift: F.floor((F.col("day") + F.lit(shift)) / s.block_days).cast("int")
    placed = (
        flat.where(dated).withColumn("segment", segment(0))
        .withColumn("at", F.explode(F.array_distinct(F.array("segment", segment(s.halo_days), segment(-s.halo_days)))))
        .select("source_key", "at", "id", "day", "cells", "received", (F.col("at") == F.col("segment")).alias("own"))
    )
    groups = placed.groupBy("source_key", "at").agg(F.count(F.lit(1)).alias("n")).withColumn("salts", F.ceil(F.col("n") / s.most_deliveries).cast("int"))
    hot = checkpoint(groups.where("salts > 1").select("source_key", "at", "salts"))
    if hot.limit(1).count():
        # deliveries spread over the salts; the charted ones go to all, as context
        spread = placed.join(hot, ["source_key", "at"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        last = (
            spread.where("salts > 1").groupBy("source_key", "at", "day", "salts")
            .agg(F.max(F.struct("received", "id", "cells")).alias("r")).select("source_key", "at", "r.id", "day", "r.cells", "r.received", F.lit(False).alias("own"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        )
        placed = spread.withColumn("salt", F.pmod(F.xxhash64("id", "received"), F.col("salts")).cast("int")).drop("salts").unionByName(last)
    else:
        placed = placed.withColumn("salt", F.lit(0))
    heads = (
        groups.join(kinds, "source_key", "left")
        .select("source_key", "at", F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("day"), F.lit(None).cast("array<double>").alias("cells"), F.lit(None).cast("timestamp").alias("received"), F.lit(False).alias("own"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "coordinate", F.lit(True).alias("head"))
    )
    stream = placed.withColumn("coordinate", F.lit(None).cast("string")).withColumn("head", F.lit(False)).unionByName(heads)
    judged = checkpoint(
        stream.repartition("source_key", "at", "salt").sortWithinPartitions("source_key", "at", "salt", F.desc("head"), "day", "received", "id").drop("received")
        .mapInArrow(lambda it: _whole_groups(it, s), _OUT_SQL)
    )
    sums = judged.where("moves is not null").groupBy("source_key").agg(*[F.sum(c).alias(c) for c in ("moves", "total", "squares", "units", "runs", "repeats")])
    mean, unit = F.col("total") / F.col("moves"), F.exp(F.col("units") / F.col("moves"))
    scale = F.greatest(F.lit(s.least_scale), F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("moves") - mean * mean)))
    far = F.when(F.col("moves") > 0, unit * (F.exp(mean + s.spike_limit * F.sqrt(F.ln(F.greatest(F.lit(3), F.col("moves")))) * scale) - s.offset))
    rate = F.least(F.lit(0.99), F.greatest(F.col("repeats"), F.lit(1)) / F.greatest(F.col("runs"), F.lit(2)))
    long = F.least(F.lit(float(s.longest_repeat)), F.greatest(F.lit(float(s.shortest_frozen)), 1 + F.ln(F.greatest(F.col("runs"), F.lit(1)) / s.chance) / -F.ln(rate)))
    limits = sums.select("source_key", far.alias("spike_from"), long.alias("frozen_from"))
    suspects = judged.where("id is not null or pos is not null")
    reason = (
        F.when(F.col("impossible"), F.lit("impossible")).when(F.col("run") >= F.col("frozen_from"), F.lit("frozen"))
        .when(F.col("size") >= F.col("spike_from"), F.lit("spike"))
    )
    cases = suspects.join(limits, "source_key", "left").select("id", "pos", reason.alias("reason")).where("reason is not null")

    def plain(rows: DataFrame, coordinate: Column) -> DataFrame:
        out = rows.select("id", coordinate.alias("coordinate"), F.posexplode("cells").alias("pos", "x"))
        return out.where(_beyond(F.col("x"), F.col("coordinate"), s.limits)).select("id", "pos", F.lit("impossible").alias("reason"))

    # asked of the columns as they are, so that files without nulls need not be read
    cells = F.col("data_matrix").cast("array<double>").alias("cells")
    undated = curves.where("source_id is not null and obs_date is null").select(F.col("id").cast("long").alias("id"), cells, F.col("source_id").cast("long").alias("source_key")).join(kinds, "source_key", "left")
    nowhere = curves.where("source_id is null").select(F.col("id").cast("long").alias("id"), cells)
    return cases.unionByName(plain(undated, F.col("coordinate"))).unionByName(plain(nowhere, F.lit(None).cast("string")))
