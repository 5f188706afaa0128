"""Percentiles of very large numeric columns (problem 2): merging centroid digests.

A digest holds centroids of sorted values whose sizes are bounded by a function of the quantile: small
at both ends, larger in the middle (unit steps of delta / 2 pi * asin(2 q - 1)). Digests of parts - tasks,
files, dates - are merged by sorting their centroids together and clustering them again, in rounds of
bounded fan-in. Estimates are then certified by a second pass that counts, for every group, the values
below and up to each estimate: the reported rank error is exact.

Curves stay whole on their way: a task takes the cells of a batch apart by coordinate, station and grid
point in memory, so a cell is sent once, not once a group, and a group of any size is the work of all
tasks. What leaves a task is a digest, or a few counts, a group.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.session import checkpoint

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
CURVE_KEYS = ["dataset", "grouping", "key"]


@dataclass(frozen=True)
class DigestSettings:
    delta: float = 400.0
    #: values of one group, and of all groups, that a task buffers before it makes centroids of them
    group_buffer: int = 65_536
    task_buffer: int = 2_000_000
    #: digests that are merged at once
    fan_in: int = 64
    #: groups whose estimates are sent to all tasks for a counting pass; more groups take more passes
    most_broadcast: int = 100_000


def cluster(values: np.ndarray, weights: np.ndarray | None, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """Centroids (means ascending, weights) of weighted values under the size function; without weights each is 1."""
    n = len(values)
    if not n:
        return values, np.zeros(0)
    if weights is None:
        values, weights = np.sort(values), np.ones(n)
    else:
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
    upto = np.cumsum(weights)
    steps = np.arange(1, int(delta / 2) + 1) * (2 * np.pi / delta)
    # a step of the size function begins at these quantiles; the extremes stay by themselves
    begin = np.searchsorted(upto - weights, (1 - np.cos(steps)) / 2 * upto[-1] * (1 - 1e-12))
    edge = np.unique(np.r_[0, min(1, n - 1), begin[begin < n], n - 1])
    total = np.add.reduceat(weights, edge)
    return np.add.reduceat(values * weights, edge) / total, total


def quantile(means: np.ndarray, weights: np.ndarray, q: float) -> float:
    """Interpolated between the middles of the centroids; a centroid of one value is that value."""
    middle = np.cumsum(weights) - weights / 2 - 0.5
    return float(np.interp(q * (weights.sum() - 1), middle, means))


class _Digester:
    """The digests of one task, by key; values wait in bounded buffers."""

    def __init__(self, keys: list[str], s: DigestSettings):
        self.keys, self.s, self.part = keys, s, TaskContext.get().partitionId()
        self.waiting, self.size, self.held, self.centroids = defaultdict(list), defaultdict(int), 0, {}

    def add(self, key: tuple, values: np.ndarray) -> None:
        self.waiting[key].append(values)
        self.size[key] += len(values)
        self.held += len(values)
        if self.size[key] > self.s.group_buffer:
            self._squeeze(key)

    def add_weighted(self, key: tuple, values: np.ndarray, weights: np.ndarray) -> None:
        if key in self.centroids:
            values, weights = np.r_[self.centroids[key][0], values], np.r_[self.centroids[key][1], weights]
        self.centroids[key] = cluster(values, weights, self.s.delta)

    def _squeeze(self, key: tuple) -> None:
        v = np.concatenate(self.waiting.pop(key))
        self.held -= self.size.pop(key)
        made = cluster(v, None, self.s.delta)
        if key in self.centroids:
            self.add_weighted(key, *made)
        else:
            self.centroids[key] = made

    def full(self) -> bool:
        return self.held > self.s.task_buffer or (len(self.centroids) + len(self.waiting)) * self.s.delta > self.s.task_buffer

    def emit(self) -> Iterator[pa.RecordBatch]:
        for key in list(self.waiting):
            self._squeeze(key)
        if self.centroids:
            names, made = list(zip(*self.centroids)), list(self.centroids.values())
            doubles = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(n, pa.string()) for n in names], pa.array([self.part] * len(made), pa.int32()), pa.array([m for m, _ in made], doubles), pa.array([w for _, w in made], doubles)],
                names=[*self.keys, "part", "means", "weights"],
            )
            self.centroids.clear()


class _Counter:
    """Values below and up to each estimate, and the nearest values on both sides with their counts, by key, of one task."""

    def __init__(self, keys: list[str], estimates: dict, percentiles: int):
        self.keys, self.estimates, self.counts, self.k = keys, {x: np.asarray(e, float) for x, e in estimates.items()}, {}, percentiles

    def add(self, key: tuple, values: np.ndarray) -> None:
        if key in self.estimates:
            self._count(key, np.sort(values), None)

    def add_weighted(self, key: tuple, values: np.ndarray, weights: np.ndarray) -> None:
        if key in self.estimates:
            order = np.argsort(values, kind="stable")
            self._count(key, values[order], np.r_[0, np.cumsum(weights[order])])

    def _count(self, key: tuple, v: np.ndarray, upto: np.ndarray | None) -> None:
        rank = (lambda i: i) if upto is None else (lambda i: upto[i])
        e = self.estimates[key]
        left, right = np.searchsorted(v, e, "left"), np.searchsorted(v, e, "right")
        ends = np.r_[-np.inf, v, np.inf]
        low, high = ends[left], ends[right + 1]
        n_low = np.where(left > 0, rank(left) - rank(np.searchsorted(v, low, "left")), 0)
        n_high = np.where(right < len(v), rank(np.searchsorted(v, high, "right")) - rank(right), 0)
        new = np.array([rank(left), rank(right), low, n_low, high, n_high], float)
        old = self.counts.get(key)
        if old is None:
            self.counts[key] = new
            return
        old[:2] += new[:2]
        for at, further in ((2, np.greater), (4, np.less)):
            better = further(new[at], old[at])
            old[at + 1] = np.where(better, new[at + 1], old[at + 1] + np.where(new[at] == old[at], new[at + 1], 0))
            old[at] = np.where(better, new[at], old[at])

    def full(self) -> bool:
        return False

    def emit(self) -> Iterator[pa.RecordBatch]:
        if self.counts:
            names, made = list(zip(*self.counts)), list(self.counts.values())
            kinds = [pa.list_(pa.float64() if k in (2, 4) else pa.int64()) for k in range(6)]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(n, pa.string()) for n in names], *[pa.array([c[k] if k in (2, 4) else np.rint(c[k]).astype(np.int64) for c in made], kinds[k]) for k in range(6)]], names=[*self.keys, *_COUNTS],
            )
            self.counts.clear()


_COUNTS = ("below", "upto", "low", "n_low", "high", "n_high")


def _split(codes: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The values of every code (0 and up; others are left out)."""
    kept = codes >= 0
    if not kept.all():
        codes, values = codes[kept], values[kept]
    if not len(codes):
        return
    small = codes.astype(np.uint16) if codes.max() < 65_536 else codes  # sorted by digits
    order = np.argsort(small, kind="stable")
    codes, values = codes[order], values[order]
    edge = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    for a, b in zip(edge, [*edge[1:], len(codes)]):
        yield int(codes[a]), values[a:b]


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """Codes and names of a string column; null is a name of its own."""
    d = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def _of_values(t: pa.Table, keys: list[str], into: _Digester | _Counter) -> None:
    """Hand the values of a table of keys and values to a collector."""
    v = t.column("value").combine_chunks().to_numpy(zero_copy_only=False).astype(float)
    code, names = np.zeros(len(v), np.int64), [()]
    for k in keys:
        own, said = _codes(t.column(k))
        both, code = np.unique(code * len(said) + own, return_inverse=True)
        names = [(*names[x // len(said)], said[x % len(said)]) for x in both.tolist()]
    for c, mine in _split(np.where(np.isfinite(v), code, -1), v):
        into.add(names[c], mine)


def _of_curves(t: pa.Table, meta: dict, by_part: bool, into: _Digester | _Counter) -> None:
    """Hand the cells of a table of curves to a collector, once for each of their groups."""
    of_dataset, datasets = _codes(t.column("dataset"))
    for n, dataset in enumerate(datasets):
        own = t.filter(pa.array(of_dataset == n))
        name, points, labels = meta.get(dataset, (None, np.zeros(0), []))
        lists = own.column("cells").combine_chunks()
        length = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        v = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
        row = np.repeat(np.arange(len(length)), length)
        pos = np.arange(len(v)) - np.repeat(np.cumsum(length) - length, length)
        good = np.isfinite(v)
        v, row, pos = v[good], row[good], pos[good]
        on = np.r_[np.isfinite(points), False]  # beyond the grid, and at a missing point, there is none
        pos = np.minimum(pos, len(points))
        pos = np.where(on[pos], pos, -1)
        part, parts = _codes(own.column("part")) if by_part else (np.zeros(len(length), np.int64), [None])
        tail = lambda p: (parts[p],) if by_part else ()

        def group(grouping: str, code: np.ndarray, said: list) -> None:
            code = np.where(code >= 0, code * len(parts) + part[row], -1)  # noqa: B023
            for c, mine in _split(code, v):  # noqa: B023
                into.add((dataset, grouping, said[c // len(parts)], *tail(c % len(parts))), mine)  # noqa: B023

        code, said = _codes(own.column("coordinate"))
        group("coordinate", code[row], said)
        code, said = _codes(own.column("station"))
        group("station", np.where(np.array([x is not None for x in said], bool)[code], code, -1)[row], said)
        group("grid_point", pos, labels)
        if len(points):
            there = pos >= 0
            many = np.bincount(pos[there] * len(parts) + part[row[there]], minlength=len(points) * len(parts)).reshape(len(points), len(parts))
            for p in range(len(parts)):
                seen = np.flatnonzero(many[:, p])
                if len(seen):
                    into.add_weighted((dataset, "occupied", "all", *tail(p)), points[seen], many[seen, p].astype(float))


def _collect(hand: Callable, make: Callable, rows: int = 32_768) -> Callable:
    """A task's work: tables of some tens of thousands of rows are handed to a collector, which says what it has at the end."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into, held, n = make(), [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= rows:
                hand(pa.Table.from_batches(held), into)
                held, n = [], 0
                if into.full():
                    yield from into.emit()
        if n:
            hand(pa.Table.from_batches(held), into)
        yield from into.emit()

    return work


def _digest_kind(keys: list[str]) -> str:
    return ", ".join(f"{k} string" for k in keys) + ", part int, means array<double>, weights array<double>"


def _strings(values: DataFrame, keys: list[str], value_column: str) -> DataFrame:
    return values.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(value_column).cast("double").alias("value"))


def build_digests(values: DataFrame, keys: list[str], value_column: str = "value", settings: DigestSettings | None = None) -> DataFrame:
    """``(*keys, part, means, weights)``: for each group the digests of its parts; the keys are strings.

    Null, NaN and infinite values are ignored; a group of such values alone has no digest.
    """
    s = settings or DigestSettings()
    return _strings(values, keys, value_column).mapInArrow(_collect(lambda t, into: _of_values(t, keys, into), lambda: _Digester(keys, s)), _digest_kind(keys))


def merge_digests(digests: DataFrame, keys: list[str], settings: DigestSettings | None = None) -> DataFrame:
    """``(*keys, part, means, weights)`` with one digest a group, part 0. Groups are compared null-safely."""
    s = settings or DigestSettings()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [cluster(np.concatenate(list(m)), np.concatenate(list(w)), s.delta) for m, w in zip(b["many_means"], b["many_weights"])]
            yield b[[*keys, "part"]].assign(means=[x[0] for x in made], weights=[x[1] for x in made])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in digests.select(*keys).schema)
    digests = checkpoint(digests.select(*keys, "part", "means", "weights"))
    while True:
        most = digests.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        groups = max(1, -(-most // s.fan_in))
        spread = F.pmod(F.xxhash64("part", "means"), F.lit(groups)).cast("int")
        digests = (
            digests.withColumn("part", spread).groupBy(*keys, "part")
            .agg(F.collect_list("means").alias("many_means"), F.collect_list("weights").alias("many_weights"))
            .mapInPandas(merge, f"{kind}, part int, means array<double>, weights array<double>")
        )
        digests = checkpoint(digests)
        if groups == 1:
            return digests


def estimates(merged: DataFrame, keys: list[str], percentiles: tuple = PERCENTILES) -> DataFrame:
    """``(*keys, n, estimates array<double>)`` of merged digests."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[keys].assign(
                n=[int(round(w.sum())) for w in b["weights"]],
                estimates=[[quantile(m, w, q) for q in percentiles] for m, w in zip(b["means"], b["weights"])],
            )

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in merged.select(*keys).schema)
    return merged.mapInPandas(solve, f"{kind}, n bigint, estimates array<double>")


def _certificates(counted: DataFrame, keys: list[str], percentiles: tuple) -> DataFrame:
    """``counted (*keys, n, k, estimate, below, upto, low, n_low, high, n_high)`` as certified rows.

    Of the estimate and the two values next to it, the one nearest to the wanted rank stands.
    """
    wanted = F.get(F.array(*[F.lit(float(q)) for q in percentiles]), F.col("k")) * (F.col("n") - 1)
    # an estimate between two values has no rank of its own: it stands between rank_below - 1 and rank_below
    inside = F.col("below") < F.col("upto")
    choices = [
        (F.lit(0), F.col("estimate"), F.col("below"), F.col("upto"), F.when(inside, F.col("below")).otherwise(F.col("below") - 1), F.when(inside, F.col("upto") - 1).otherwise(F.col("below"))),
        (F.lit(1), F.col("low"), F.col("below") - F.col("n_low"), F.col("below"), F.col("below") - F.col("n_low"), F.col("below") - 1),
        (F.lit(2), F.col("high"), F.col("upto"), F.col("upto") + F.col("n_high"), F.col("upto"), F.col("upto") + F.col("n_high") - 1),
    ]
    error = lambda first, last: F.greatest(F.lit(0.0), first - wanted, wanted - last) / F.col("n")
    each = F.array(*[F.struct(error(first, last).alias("rank_error"), turn.alias("turn"), value.alias("value"), below.alias("rank_below"), upto.alias("rank_upto")) for turn, value, below, upto, first, last in choices])
    best = F.array_min(F.filter(each, lambda x: F.abs(x["value"]) < float("inf")))
    named = counted.select(*keys, F.get(F.array(*[F.lit(float(q)) for q in percentiles]), F.col("k")).alias("percentile"), "n", best.alias("b"))
    return named.select(*keys, "percentile", "n", "b.value", "b.rank_below", "b.rank_upto", "b.rank_error")


def _certify(found: DataFrame, keys: list[str], percentiles: tuple, s: DigestSettings, count: Callable[[dict], DataFrame]) -> DataFrame:
    """Count against the estimates of ``found``, sent to all tasks, in as many passes as their number needs."""
    found = checkpoint(found)
    passes = max(1, -(-found.count() // s.most_broadcast))
    turn = F.pmod(F.xxhash64(*keys), F.lit(passes))
    parts = None
    for k in range(passes):
        known = {tuple(r[x] for x in keys): r["estimates"] for r in found.where(turn == k).select(*keys, "estimates").collect()}
        one = count(known)
        parts = one if parts is None else parts.unionByName(one)
    parts = checkpoint(parts)
    flat = parts.select(*keys, F.posexplode(F.arrays_zip(*_COUNTS)).alias("k", "c")).select(*keys, "k", "c.*")
    sums = flat.groupBy(*keys, "k").agg(F.sum("below").alias("below"), F.sum("upto").alias("upto"))
    for side, best in (("low", F.max), ("high", F.min)):
        same = flat.groupBy(*keys, "k", side).agg(F.sum(f"n_{side}").alias("n"))
        ends = same.groupBy(*keys, "k").agg((F.max_by if best is F.max else F.min_by)(F.struct(F.col(side), "n"), side).alias("e"))
        ends = ends.select(*[F.col(x).alias(f"_{x}") for x in (*keys, "k")], F.col(f"e.{side}").alias(side), F.col("e.n").alias(f"n_{side}"))
        sums = _null_safe(sums, ends, [*keys, "k"])
    named = found.select(*[F.col(x).alias(f"_{x}") for x in keys], "n", F.posexplode("estimates").alias("_k", "estimate"))
    return _certificates(_null_safe(sums, named, [*keys, "k"]), keys, percentiles)


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    on = F.lit(True)
    for x in keys:
        on = on & F.col(x).eqNullSafe(F.col(f"_{x}"))
    return left.join(right, on).drop(*[f"_{x}" for x in keys])  # a row a group and percentile on either side


def _counts_kind(keys: list[str]) -> str:
    return ", ".join(f"{x} string" for x in keys) + ", below array<bigint>, upto array<bigint>, low array<double>, n_low array<bigint>, high array<double>, n_high array<bigint>"


def certified(values: DataFrame, found: DataFrame, keys: list[str], value_column: str = "value", percentiles: tuple = PERCENTILES, settings: DigestSettings | None = None) -> DataFrame:
    """``(*keys, percentile, n, value, rank_below, rank_upto, rank_error)``: the counting pass.

    ``value`` is the estimate, or the value of the group next to it if that is nearer to the wanted rank, which is
    ``percentile * (n - 1)``. ``rank_below`` and ``rank_upto`` count the group's values less than, and not above,
    it. ``rank_error`` is how far, as a share of n, the wanted rank lies outside the ranks
    ``rank_below .. rank_upto - 1`` that the value takes (0 if inside; an estimate between two values takes
    the place between them).
    """
    s, k = settings or DigestSettings(), len(percentiles)
    rows = _strings(values, keys, value_column)

    def count(known: dict) -> DataFrame:
        return rows.mapInArrow(_collect(lambda t, into: _of_values(t, keys, into), lambda: _Counter(keys, known, k)), _counts_kind(keys))

    return _certify(found, keys, percentiles, s, count)


def grid_points(grid_meta: DataFrame) -> dict:
    """Name of the coordinate, grid points and their labels by dataset; a row a dataset, so it is fetched."""
    points = grid_meta.where("dataset is not null").groupBy("dataset").agg(F.min(F.struct("coordinate_names", "grid_points")).alias("m"))
    points = points.select("dataset", F.get("m.coordinate_names", F.lit(0)).alias("name"), F.coalesce("m.grid_points", F.array().cast("array<double>")).alias("points"))
    return {
        r["dataset"]: (r["name"], np.array([np.nan if x is None else x for x in r["points"]], float), r["labels"])
        for r in points.select("*", F.transform("points", lambda x: x.cast("string")).alias("labels")).collect()
    }


def curves_of(station_days: DataFrame, spectra: DataFrame, sources: DataFrame, meta: dict) -> DataFrame:
    """``(dataset, coordinate, station, part, cells)``: the curves of both tables with what they are grouped by.

    ``part`` is the ``obs_date`` (of spectra the date of ``measured_at``).
    """
    kinds = sources.groupBy("source_id").agg(F.max("coordinate").alias("coordinate"))
    days = station_days.select("source_id", F.col("station_id").cast("string").alias("station"), F.col("obs_date").cast("string").alias("part"), F.col("data_matrix").cast("array<double>").alias("cells")).join(kinds, "source_id", "left")
    days = days.select(F.lit("station_days").alias("dataset"), "coordinate", "station", "part", "cells")
    name = meta.get("spectra", (None,))[0]
    other = spectra.select(
        F.lit("spectra").alias("dataset"), F.lit(name).cast("string").alias("coordinate"), F.lit(None).cast("string").alias("station"),
        F.to_date("measured_at").cast("string").alias("part"), F.col("data_matrix").cast("array<double>").alias("cells"),
    )
    return days.unionByName(other)


def curve_digests(curves: DataFrame, meta: dict, by_part: bool = False, settings: DigestSettings | None = None) -> DataFrame:
    """``(dataset, grouping, key[, date], part, means, weights)``: digests of the cells of ``curves_of``.

    Every non-missing cell counts once for each of its groups. Groupings: ``coordinate``, ``station``,
    ``grid_point`` and ``occupied``, whose values are the grid points of the non-missing cells. Cells without a
    grid point in the meta are in no ``grid_point`` group and do not occupy any; curves without a station are in
    no ``station`` group. With ``by_part``, ``date`` parts the digests, for keeping and combining them later.
    """
    s, keys = settings or DigestSettings(), CURVE_KEYS + ["date"] * by_part
    work = _collect(lambda t, into: _of_curves(t, meta, by_part, into), lambda: _Digester(keys, s))
    return curves.mapInArrow(work, _digest_kind(keys))


def certified_curves(curves: DataFrame, meta: dict, found: DataFrame, percentiles: tuple = PERCENTILES, settings: DigestSettings | None = None) -> DataFrame:
    """The counting pass over ``curves_of``, with the result of ``certified``."""
    s, k = settings or DigestSettings(), len(percentiles)

    def count(known: dict) -> DataFrame:
        return curves.mapInArrow(_collect(lambda t, into: _of_curves(t, meta, False, into), lambda: _Counter(CURVE_KEYS, known, k)), _counts_kind(CURVE_KEYS))

    return _certify(found, CURVE_KEYS, percentiles, s, count)


def curve_cells(curves: DataFrame, meta: dict) -> DataFrame:
    """``(dataset, grouping, key, part, value)``: every non-missing cell of ``curves_of`` once for each of its groups."""
    of = F.create_map(*[x for d, (_, points, _) in meta.items() for x in (F.lit(d), F.array(*[F.lit(float(p)) for p in points]).cast("array<double>"))]) if meta else F.create_map().cast("map<string,array<double>>")
    cells = curves.select("dataset", "coordinate", "station", "part", F.try_element_at(of, F.col("dataset")).alias("grid_points"), F.posexplode("cells").alias("pos", "value"))
    cells = cells.where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    point = F.when(F.isnan(F.get("grid_points", F.col("pos"))), None).otherwise(F.get("grid_points", F.col("pos")))
    group = lambda name, key, value: F.struct(F.lit(name).alias("grouping"), key.cast("string").alias("key"), value.alias("value"))
    groups = F.array(
        group("coordinate", F.col("coordinate"), F.col("value")), group("station", F.col("station"), F.col("value")),
        group("grid_point", point, F.col("value")), group("occupied", F.lit("all"), point),
    )
    return (
        cells.select("dataset", "part", F.explode(groups).alias("g")).select("dataset", "part", "g.grouping", "g.key", "g.value")
        .where("value is not null and (grouping = 'coordinate' or key is not null)")
    )
