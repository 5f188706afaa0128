"""Clustering of curves."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.columns import constant
from curvelake.frames import Curves
from curvelake.numerics import report_unfinished
from curvelake.operators.classification import nearest_of
from curvelake.operators.metrics import lp_norm_column
from curvelake.operators.stats import spread
from curvelake.session import checkpoint


def _means(curves: Curves, assigned: DataFrame, centres: np.ndarray) -> np.ndarray:
    rows = curves.df.join(assigned, "id").select("cluster", F.posexplode("data").alias("pos", "v")).groupBy("cluster", "pos").agg(F.avg("v").alias("m")).collect()
    out = centres.copy()
    for r in rows:
        if r["m"] is not None:
            out[r["cluster"], r["pos"]] = r["m"]
    return out


def assign(curves: Curves, centres: np.ndarray, p: float = 2) -> DataFrame:
    """``(id, cluster, distance)``; ties go to the smaller cluster."""
    return nearest_of(curves, list(range(len(centres))), centres, p).withColumnRenamed("predicted", "cluster")


def centre_distances(curves: Curves, centres: np.ndarray, p: float = 2) -> DataFrame:
    """``(id, distances)``: the distance of each curve to every centre, in their order."""
    off = lambda c: F.zip_with("data", constant(c), lambda x, y: x - y)
    return curves.df.select("id", F.array(*[lp_norm_column(off(c), curves.weights(), p) for c in np.asarray(centres, float)]).alias("distances"))


def lloyd_step(curves: Curves, centres: np.ndarray, p: float = 2) -> tuple[DataFrame, np.ndarray]:
    labels = assign(curves, centres, p)
    return labels, _means(curves, labels.select("id", "cluster"), centres)


def starting_centres(curves: Curves, k: int, seed: int = 0) -> np.ndarray:
    """k different curves drawn by a hash of their id."""
    drawn = curves.df.where(F.forall("data", lambda x: x.isNotNull())).groupBy("data").agg(F.min(F.xxhash64("id", F.lit(seed))).alias("h"), F.min("id").alias("i")).orderBy("h", "i").limit(k).collect()
    if len(drawn) < k:
        raise ValueError("fewer different curves than clusters")
    return np.array([r["data"] for r in drawn])


def k_means(curves: Curves, k: int, init: np.ndarray | None = None, n_init: int = 1, max_iter: int = 100, tol: float = 1e-4, p: float = 2, seed: int = 0) -> tuple[DataFrame, np.ndarray, float]:
    """(labels, centres, inertia): Lloyd's rounds, one aggregation each, until no centre moves more than ``tol`` of the curves' spread."""
    if k < 2 or n_init < 1 or max_iter < 1 or tol < 0:
        raise ValueError("wrong parameters of k-means")
    curves = curves.with_df(checkpoint(curves.df.select("id", "data")))
    least = tol * spread(curves)
    best = None
    for run in range(n_init if init is None else 1):
        centres = starting_centres(curves, k, seed + run) if init is None else np.asarray(init, float)
        for _ in range(max_iter):
            labels, new = lloyd_step(curves, centres, p)
            moved = np.max(np.sqrt(np.maximum((new - centres) ** 2 @ curves.weights(), 0)))
            centres = new
            if moved <= least:
                break
        else:
            report_unfinished("k-means", max_iter, moved, least)
        labels = assign(curves, centres, p)
        inertia = labels.agg(F.sum(F.col("distance") * F.col("distance"))).first()[0]
        if best is None or inertia < best[2]:
            best = (labels, centres, inertia)
    return best


def memberships(curves: Curves, centres: np.ndarray, fuzzifier: float = 2.0, p: float = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *carry, membership array<double>)``: shares of d^(2 / (1 - m)); a curve on a centre belongs to it alone."""
    if fuzzifier <= 1:
        raise ValueError("the fuzzifier exceeds 1")
    w = curves.weights()
    near = F.array(*[lp_norm_column(F.zip_with("data", constant(c), lambda x, y: x - y), w, p) for c in centres])
    rows = curves.df.select("id", *carry, near.alias("d"))
    on = F.exists("d", lambda x: x == 0)
    raw = F.when(on, F.transform("d", lambda x: (x == 0).cast("double"))).otherwise(F.transform("d", lambda x: F.pow(x, F.lit(2 / (1 - fuzzifier)))))
    return rows.withColumn("r", raw).select("id", *carry, F.transform("r", lambda x: x / F.aggregate("r", F.lit(0.0), lambda a, y: a + y)).alias("membership"))


def fuzzy_c_means(curves: Curves, k: int = 2, fuzzifier: float = 2.0, init: np.ndarray | None = None, max_iter: int = 100, tol: float = 1e-4, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(memberships, centres): rounds of one aggregation until no centre moves more than ``tol`` of the curves' spread."""
    curves = curves.with_df(checkpoint(curves.df.select("id", "data")))
    least = tol * spread(curves)
    centres = starting_centres(curves, k, seed) if init is None else np.asarray(init, float)
    for _ in range(max_iter):
        cells = memberships(curves, centres, fuzzifier, carry=("data",)).select(F.posexplode("data").alias("pos", "v"), "membership").select("pos", "v", F.posexplode("membership").alias("cluster", "u"))
        weight = F.pow("u", F.lit(fuzzifier))
        rows = cells.groupBy("cluster", "pos").agg((F.sum(weight * F.col("v")) / F.sum(weight)).alias("m")).collect()
        new = centres.copy()
        for r in rows:
            new[r["cluster"], r["pos"]] = r["m"]
        moved = np.max(np.sqrt(np.maximum((new - centres) ** 2 @ curves.weights(), 0)))
        centres = new
        if moved <= least:
            break
    else:
        report_unfinished("fuzzy c-means", max_iter, moved, least)
    return memberships(curves, centres, fuzzifier), centres


class _Linkage:
    """Distances of clusters from their members: of a cluster to all later ones, without a matrix of all pairs.

    Centroids and spreads bound every distance, so only clusters that may be the nearest are compared member by member. The
    sums (least, largest) of a cluster of at least ``large`` members to all clusters are kept, and merged with them.
    """

    def __init__(self, x: np.ndarray, linkage: str, large: int):
        self.x, self.linkage, self.large, n = x, linkage, large, len(x)
        self.of, self.size, self.alive = np.arange(n), np.ones(n), np.ones(n, bool)
        self.members = [np.array([i]) for i in range(n)]
        self.centre, self.spread, self.reach = x.copy(), np.zeros(n), np.zeros(n)
        self.kept: dict[int, np.ndarray] = {}
        self.join, self.none = {"average": (np.add, 0.0), "complete": (np.maximum, -np.inf), "single": (np.minimum, np.inf)}[linkage]
        self.slack = 1e-7 * (1 + float(np.sqrt((x * x).sum(1).max(initial=0))))

    def between(self, i: int, others: np.ndarray) -> np.ndarray:
        """Sums (least, largest) of the distances of the members of i to those of each other cluster."""
        if len(others) == 0:
            return np.zeros(0)
        single = self.size[others] == 1
        if single.all():
            points, owner = others, np.arange(len(others))
        else:
            place = np.full(len(self.x), -1)
            place[others] = np.arange(len(others))
            owner = place[self.of]
            points = np.flatnonzero(owner >= 0)
            owner = owner[points]
        mine, theirs = self.x[self.members[i]], self.x[points]
        total = np.full(len(points), self.none)
        for row in mine:
            total = self.join(total, np.sqrt(((theirs - row) ** 2).sum(1)))
        if len(points) == len(others) and single.all():
            return total
        if self.linkage == "average":
            return np.bincount(owner, total, len(others))
        out = np.full(len(others), self.none)
        self.join.at(out, owner, total)
        return out

    def nearest(self, i: int) -> tuple[float, int]:
        """(distance, j) of the nearest later cluster, the first of equal ones."""
        others = np.flatnonzero(self.alive[i + 1 :]) + i + 1
        if not len(others):
            return np.inf, -1
        if i in self.kept:
            got = self.kept[i][others]
        else:
            off = np.sqrt(((self.centre[others] - self.centre[i]) ** 2).sum(1))
            if self.linkage == "complete":
                least, most = off, off + self.reach[i] + self.reach[others]
            else:
                least, most = off, np.sqrt(off * off + self.spread[i] + self.spread[others])
            if self.linkage == "single":
                least = off - self.reach[i] - self.reach[others]
            others = others[least <= most.min() + self.slack]
            big = np.array([j in self.kept for j in others.tolist()], bool) if self.kept else np.zeros(len(others), bool)
            got = np.empty(len(others))
            got[~big] = self.between(i, others[~big])
            got[big] = [self.kept[j][i] for j in others[big].tolist()]
        if self.linkage == "average":
            got = got / (self.size[i] * self.size[others])
        k = int(got.argmin())
        return float(got[k]), int(others[k])

    def merge(self, i: int, j: int) -> None:
        self.alive[j] = False
        if self.size[i] + self.size[j] >= self.large:
            live = np.flatnonzero(self.alive)
            rows = []
            for c in (i, j):
                row = self.kept.pop(c, None)
                if row is None:
                    row = np.full(len(self.x), self.none)
                    row[live] = self.between(c, live)
                rows.append(row)
            self.kept[i] = self.join(*rows)
        for c, row in self.kept.items():
            if c != i:
                row[i] = self.join(row[i], row[j])
        n = self.size[i] + self.size[j]
        centre = (self.size[i] * self.centre[i] + self.size[j] * self.centre[j]) / n
        self.members[i], self.members[j] = np.concatenate([self.members[i], self.members[j]]), None
        off = ((self.x[self.members[i]] - centre) ** 2).sum(1)
        self.centre[i], self.spread[i], self.reach[i], self.size[i] = centre, off.mean(), np.sqrt(off.max()), n
        self.of[self.members[i]] = i


def merged(x: np.ndarray, k: int, linkage: str = "average", kept_bytes: int = 200_000_000) -> np.ndarray:
    """The first member of the cluster of each row when ``k`` are left; the nearest two are merged first, of equal pairs the first.

    Memory grows with the rows and ``kept_bytes``. All three linkages never bring a merged cluster nearer to a third
    than the nearer of its parts was, so an old nearest distance is a bound until its turn comes.
    """
    n = len(x)
    state = _Linkage(np.ascontiguousarray(x, float), linkage, max(16, -(-8 * n * n // kept_bytes)))
    clock, grown, since = 0, {}, {}  # merges so far; when a cluster last grew, and when its nearest was looked for
    near = [state.nearest(i) for i in range(n)]
    queue = [(d, i, j) for i, (d, j) in enumerate(near) if j >= 0]
    heapq.heapify(queue)
    for _ in range(n - max(1, k)):
        while True:
            d, i, j = heapq.heappop(queue)
            if not state.alive[i] or near[i] != (d, j):
                continue  # a newer entry stands for this cluster, or none
            if state.alive[j] and not grown.get(j, 0) > since.get(i, 0):
                break
            near[i] = state.nearest(i)
            since[i] = clock
            if near[i][1] >= 0:
                heapq.heappush(queue, (near[i][0], i, near[i][1]))
        state.merge(i, j)
        clock += 1
        grown[i] = since[i] = clock
        near[i] = state.nearest(i)
        if near[i][1] >= 0:
            heapq.heappush(queue, (near[i][0], i, near[i][1]))
    return state.of


def agglomerate(curves: Curves, k: int = 2, linkage: str = "average") -> DataFrame:
    """``(id, cluster)``: bottom-up merging by all L2 distances.

    Merging is one step after another, on the driver, which holds the curves but no matrix of their distances; the time
    grows with the square of their number.
    """
    got = curves.df.select("id", "data").orderBy("id").toPandas()
    x = np.stack(got["data"]) * np.sqrt(np.maximum(curves.weights(), 0))
    member = merged(x, k, linkage)
    names = {m: c for c, m in enumerate(dict.fromkeys(member.tolist()))}
    return curves.df.sparkSession.createDataFrame([(i, names[m]) for i, m in zip(got["id"].tolist(), member.tolist())], f"id {dict(curves.df.dtypes)['id']}, cluster int")
