"""Depths, outlyingness and outlier detectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelake.columns import constant
from curvelake.frames import Curves
from curvelake.operators.metrics import BLOCK_BYTES, distances_to, in_blocks, k_neighbours, matrix_of
from curvelake.operators.ranks import WINDOW_ROWS, first_rows, quantiles, rank_counts
from curvelake.operators.stats import moments
from curvelake.session import checkpoint

DEPTH_DIGITS = 10


def _pairs(k: Column) -> Column:
    return k * (k - 1) / 2


def _simplicial(below: Column, upto: Column, n: Column) -> Column:
    above = n - upto
    return F.coalesce(1 - F.try_divide(_pairs(below) + _pairs(above), _pairs(n)), F.lit(1.0))


def _fraiman_muniz(below: Column, upto: Column, n: Column) -> Column:
    return 1 - F.abs(F.lit(0.5) - upto / n)


POINTWISE = {"simplicial": _simplicial, "fraiman_muniz": _fraiman_muniz}


def _counted(curves: Curves, reference: Curves | None = None, window_rows: int = WINDOW_ROWS, by: list[str] | None = None) -> DataFrame:
    cells = curves.long(*(by or []))
    if reference is None:
        return rank_counts(cells.withColumn("ref", F.lit(1)), curves.df.count(), window_rows)
    curves._same_grid(reference)
    both = cells.select("id", "pos", "v", F.lit(0).alias("ref")).unionByName(reference.long().select("id", "pos", "v", F.lit(1).alias("ref")))
    rows = curves.df.count() + reference.df.count()
    return rank_counts(both, rows, window_rows).where("ref = 0")


def pointwise_depth(curves: Curves, kind: str = "fraiman_muniz", reference: Curves | None = None) -> DataFrame:
    """``(id, pos, v, depth)``"""
    return _counted(curves, reference).select("id", "pos", "v", POINTWISE[kind](F.col("below"), F.col("upto"), F.col("n")).alias("depth"))


def _averaged(cells: DataFrame, curves: Curves, value: Column, name: str) -> DataFrame:
    w = F.get(constant(curves.weights() / curves.length()), F.col("pos"))
    return cells.groupBy("id").agg(F.sum(value * w).alias(name))


def integrated_depth(curves: Curves, kind: str = "fraiman_muniz", reference: Curves | None = None) -> DataFrame:
    """``(id, depth)``: the domain average of a pointwise depth. Curves with missing cells are judged by the others."""
    return _averaged(pointwise_depth(curves, kind, reference), curves, F.col("depth"), "depth")


def modified_band_depth(curves: Curves, reference: Curves | None = None) -> DataFrame:
    return integrated_depth(curves, "simplicial", reference)


def modified_epigraph_index(curves: Curves) -> DataFrame:
    """``(id, mei)``: share of curves above, averaged over the domain; the curve itself is not counted."""
    cells = _counted(curves)
    return _averaged(cells, curves, (F.col("n") - F.col("below") - 1) / F.col("n"), "mei")


def _packed_signs(positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words: where a row is above, then where it is below."""
    def words(bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits, axis=1)
        return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)

    return np.hstack([words(positive), words(negative)])


def _free_pairs(words: np.ndarray, count: np.ndarray, other: np.ndarray, other_count: np.ndarray) -> int:
    """Pairs of the rows of two sets that are nowhere on the same side."""
    out = 0
    step = max(1, 4_000_000 // max(1, other.size))
    for k in range(0, len(words), step):
        clash = np.zeros((len(words[k : k + step]), len(other)), bool)
        for c in range(words.shape[1]):
            clash |= (words[k : k + step, c, None] & other[None, :, c]) != 0
        out += int(count[k : k + step] @ (~clash @ other_count))
    return out


def pairs_around(left: np.ndarray, right: np.ndarray | None, row: np.ndarray) -> int:
    """Pairs of one row of each set (of two rows of ``left`` without ``right``) whose band holds the whole row.

    Two rows off ``row`` everywhere hold it only if one is above exactly where the other is below, so such pairs are counted by
    their signs; only rows that meet it somewhere are compared with the others. NaN lies on no side.
    """
    d = left.shape[1]
    sets, alike = [], []
    for q in [left] if right is None else [left, right]:
        above, below = q.T > row[:, None], q.T < row[:, None]
        sides = np.packbits(above, axis=0), np.packbits(below, axis=0)
        on = (sides[0] | sides[1] == np.packbits(np.ones((d, 1), bool), axis=0)).all(0)
        none = ~on & ~(sides[0] | sides[1]).any(0)  # on no side anywhere: such a row makes a free pair with every other
        alike.append(int(none.sum()))
        if d <= 16:
            code = sides[0][0].astype(np.int64) if d <= 8 else sides[0][0].astype(np.int64) << 8 | sides[0][1]
            signs, n = None, np.bincount(code[on] >> (-d % 8), minlength=1 << d)
        else:
            signs, n = np.unique(sides[0][:, on].T, axis=0, return_counts=True)
        rest = ~none
        some = (~on & rest).any()
        sets.append((above, below, rest, on, signs, n, some))
    if any(x[-1] for x in sets):
        sets = [(_packed_signs(above.T[rest], below.T[rest]), ~on[rest], signs, n) for above, below, rest, on, signs, n, _ in sets]
    else:
        none = np.zeros((0, 1), np.uint64), np.zeros(0, bool)
        sets = [(*none, signs, n) for *_, signs, n, _ in sets]
    sizes = [len(left), len(left if right is None else right)]
    apart = sizes[0] * sizes[1] - (sizes[0] - alike[0]) * (sizes[1] - alike[-1]) if right is not None else alike[0] * (sizes[0] - alike[0]) + alike[0] * (alike[0] - 1) // 2
    (words, met, signs, n), (theirs, their_met, their_signs, their_n) = sets[0], sets[-1]
    if signs is None:
        opposite = int(n @ their_n[::-1])
    else:
        at = {s.tobytes(): int(k) for s, k in zip(their_signs, their_n)}
        turned = ~signs & np.packbits(np.ones((1, d), bool), axis=1)
        opposite = sum(int(k) * at.get(s.tobytes(), 0) for s, k in zip(turned, n))
    touching, touching_n = np.unique(words[met], axis=0, return_counts=True)
    every, every_n = (np.unique(theirs, axis=0, return_counts=True) if len(touching) > 8 else (theirs, np.ones(len(theirs), int)))
    if right is None:
        own = _free_pairs(touching, touching_n, touching, touching_n)  # ordered pairs; none is free with itself
        mixed = _free_pairs(touching, touching_n, every, every_n) - own
        return apart + (opposite + own) // 2 + mixed
    touched, touched_n = np.unique(theirs[their_met], axis=0, return_counts=True)
    mine, mine_n = np.unique(words[~met], axis=0, return_counts=True)
    return apart + opposite + _free_pairs(touching, touching_n, every, every_n) + _free_pairs(touched, touched_n, mine, mine_n)


def band_depth(curves: Curves, reference: Curves | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(id, depth)``: share of the pairs of reference curves whose band holds the whole curve.

    The work is one pass over the reference set for each curve, and more only where curves meet. A reference set beyond
    ``block_bytes`` is cut into blocks; each pair of blocks is the work of a task for every part of the curves.
    """
    reference = reference or curves
    curves, reference = curves.with_df(checkpoint(curves.df.select("id", "data"))), reference.with_df(checkpoint(reference.df.select("id", "data")))
    n, size = reference.df.count(), curves.meta.size
    if curves.meta.codomain != 1:
        raise NotImplementedError("band depth is defined for one coordinate")
    kind = f"id {dict(curves.df.dtypes)['id']}, "
    blocks = max(1, -(-n * size * 8 // block_bytes))
    if blocks == 1:
        def work(frame, q, b, x):
            q = np.asfortranarray(q)
            return pd.DataFrame({"id": b["id"], "depth": [pairs_around(q, None, row) / (n * (n - 1) / 2) if n > 1 else 1.0 for row in x]})

        spread = curves.with_df(curves.df.repartition(max(1, min(200, curves.df.count() // 500))))
        return in_blocks(reference, spread, work, kind + "depth double", block_bytes=block_bytes)
    blocks *= 2  # a task holds two
    groups = max(1, -(-curves.df.count() * size * 8 // block_bytes))
    pairs = [(p, q) for p in range(blocks) for q in range(p, blocks)]
    table = lambda: F.broadcast(curves.df.sparkSession.createDataFrame(pairs, "p int, q int"))  # bounded by the blocks
    rows = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    left = reference.df.select("data", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own")).join(table(), F.expr("own = p or own = q")).withColumn("g", rows)
    right = curves.df.select(F.col("id").alias("r_id"), F.col("data").alias("r_data")).withColumn("g", F.pmod(F.xxhash64("r_id", F.lit(1)), F.lit(groups)).cast("int")).crossJoin(table())

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, q = matrix_of(b["r_data"], size), np.asfortranarray(matrix_of(a["data"], size))
        p_is = (a["own"] == a["p"]).to_numpy()
        one = len(a) == 0 or a["p"].iloc[0] == a["q"].iloc[0]
        return pd.DataFrame({"id": b["r_id"], "pairs": [(pairs_around(q, None, r) if one else pairs_around(q[p_is], q[~p_is], r)) if len(q) else 0 for r in x]})

    found = left.groupBy("p", "q", "g").cogroup(right.groupBy("p", "q", "g")).applyInPandas(pair, kind + "pairs bigint")
    return found.groupBy("id").agg((F.sum("pairs") / (n * (n - 1) / 2)).alias("depth"))


def distance_depth(curves: Curves, centre=None, p: float = 2) -> DataFrame:
    """``(id, depth)``: 1 / (1 + distance to the mean)."""
    centre = moments(curves)[1] if centre is None else centre
    return distances_to(curves, centre, "d", p).select("id", (1 / (1 + F.col("d"))).alias("depth"))


def stahel_donoho(curves: Curves, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``(id, pos, outlyingness)``: distance to the median over the median distance, at each point; medians are exact."""
    cells, rows = curves.long().where("v is not null"), curves.df.count()
    middle = quantiles(cells, [0.5], rows, window_rows).select("pos", F.get("q", F.lit(0)).alias("m"))
    off = cells.join(F.broadcast(middle), "pos").withColumn("off", F.abs(F.col("v") - F.col("m")))  # a row a grid point
    spread = quantiles(off.select("pos", F.col("off").alias("v")), [0.5], rows, window_rows).select("pos", F.get("q", F.lit(0)).alias("mad"))
    return off.join(F.broadcast(spread), "pos").select("id", "pos", F.when(F.col("off") == 0, 0.0).otherwise(F.try_divide("off", "mad")).alias("outlyingness"))


def projection_depth(curves: Curves) -> DataFrame:
    """``(id, depth)``: the domain average of 1 / (1 + Stahel-Donoho outlyingness)."""
    return _averaged(stahel_donoho(curves), curves, 1 / (1 + F.col("outlyingness")), "depth")


def deepest(depths: DataFrame, k: int) -> DataFrame:
    """The k deepest ids; depths are rounded first and ties go to the smaller id."""
    return first_rows(depths, [F.round("depth", DEPTH_DIGITS).desc(), F.col("id")], k)


def depth_median(curves: Curves, depths: DataFrame | None = None) -> Curves:
    return curves.with_df(curves.df.join(deepest(depths or modified_band_depth(curves), 1).select("id"), "id", "left_semi"))


def trimmed_mean(curves: Curves, share: float, depths: DataFrame | None = None) -> DataFrame:
    """``(pos, value)``: mean of the n - int(n share) deepest curves."""
    n = curves.df.count()
    keep = deepest(depths or modified_band_depth(curves), n - int(n * share)).select("id")
    kept = curves.df.join(keep, "id", "left_semi")
    return curves.with_df(kept).long().groupBy("pos").agg(F.avg("v").alias("value"))


def envelope(curves: Curves, depths: DataFrame | None = None, share: float = 0.5) -> DataFrame:
    """``(pos, low, high)`` of the ceil(n share) deepest curves."""
    n = curves.df.count()
    region = curves.df.join(deepest(depths or modified_band_depth(curves), math.ceil(n * share)).select("id"), "id", "left_semi")
    return curves.with_df(region).long().groupBy("pos").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def boxplot_outliers(curves: Curves, depths: DataFrame | None = None, factor: float = 1.5) -> DataFrame:
    """``(id, is_outlier)``: whether the curve leaves the central envelope by more than ``factor`` times its width."""
    box = envelope(curves, depths)
    bounds = box.select("pos", (F.col("low") - factor * (F.col("high") - F.col("low"))).alias("least"), (F.col("high") + factor * (F.col("high") - F.col("low"))).alias("most"))
    return curves.long().join(F.broadcast(bounds), "pos").groupBy("id").agg(F.coalesce(F.bool_or((F.col("v") < F.col("least")) | (F.col("v") > F.col("most"))), F.lit(False)).alias("is_outlier"))


def outliergram(curves: Curves, factor: float = 1.5) -> DataFrame:
    """``(id, mbd, mei, distance, is_outlier)``: distance of (MEI, MBD) to the parabola of equal shapes."""
    cells = _counted(curves)
    w = F.get(constant(curves.weights() / curves.length()), F.col("pos"))
    below, upto, n = F.col("below"), F.col("upto"), F.col("n")
    both = cells.groupBy("id").agg(F.sum(_simplicial(below, upto, n) * w).alias("mbd"), F.sum((n - below - 1) / n * w).alias("mei"), F.max("n").alias("n"))
    a = F.lit(-2.0) / (F.col("n") * (F.col("n") - 1))
    middle = F.lit(2.0) * (F.col("n") + 1) / (F.col("n") - 1)
    both = both.withColumn("distance", a + middle * F.col("mei") + F.col("n") * F.col("n") * a * F.col("mei") * F.col("mei") - F.col("mbd"))
    quartiles = quantiles(both.select(F.lit(0).alias("pos"), F.col("distance").alias("v")), [0.25, 0.75], curves.df.count()).select("q")
    limit = F.get("q", F.lit(1)) + factor * (F.get("q", F.lit(1)) - F.get("q", F.lit(0)))
    return both.join(F.broadcast(quartiles)).select("id", "mbd", "mei", "distance", (F.col("distance") > limit).alias("is_outlier"))


def directional_outlyingness(curves: Curves, kind: str = "simplicial") -> DataFrame:
    """``(id, mean_outlyingness, variation)`` of one-coordinate curves: (1 / depth - 1) towards the deepest value."""
    cells = pointwise_depth(curves, kind)
    centre = cells.groupBy("pos").agg(F.min_by("v", F.struct(-F.round("depth", DEPTH_DIGITS), "id")).alias("centre"))
    w = F.get(constant(curves.weights() / curves.length()), F.col("pos"))
    out = cells.join(F.broadcast(centre), "pos").withColumn("o", (F.try_divide(F.lit(1.0), F.col("depth")) - 1) * F.signum(F.col("v") - F.col("centre"))).withColumn("w", w)
    sums = out.groupBy("id").agg(F.sum(F.col("o") * F.col("w")).alias("mean_outlyingness"), F.sum(F.col("o") * F.col("o") * F.col("w")).alias("square"))
    return sums.select("id", "mean_outlyingness", (F.col("square") - F.col("mean_outlyingness") * F.col("mean_outlyingness")).alias("variation"))


def fast_mcd(points: np.ndarray, seed: int = 0, starts: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter of the half of the points with the smallest determinant, by concentration steps."""
    n, d = points.shape
    h, rng, best = (n + d + 1) // 2, np.random.default_rng(seed), None
    for _ in range(starts):
        pick = rng.choice(n, d + 1, replace=False)
        for _ in range(10):
            m, c = points[pick].mean(0), np.cov(points[pick].T, bias=True) + 1e-12 * np.eye(d)
            off = points - m
            new = np.argsort(np.einsum("ij,jk,ik->i", off, np.linalg.inv(c), off), kind="stable")[:h]
            if set(new) == set(pick):
                break
            pick = new
        det = np.linalg.det(np.cov(points[pick].T, bias=True))
        if best is None or det < best[0]:
            best = (det, pick)
    pick = best[1]
    return points[pick].mean(0), np.cov(points[pick].T, bias=True) + 1e-12 * np.eye(d)


def _concentrated(points: DataFrame, n: int, centre: np.ndarray, scatter: np.ndarray, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Concentration steps over all points: moments of the half nearest to the centre, until they stay."""
    a, b = F.col("mean_outlyingness"), F.col("variation")
    for _ in range(rounds):
        inverse = np.linalg.inv(scatter)
        x, y = a - float(centre[0]), b - float(centre[1])
        squared = F.round(x * x * float(inverse[0, 0]) + x * y * float(2 * inverse[0, 1]) + y * y * float(inverse[1, 1]), 10)
        half = first_rows(points.withColumn("_d", squared), [F.col("_d"), F.col("id")], (n + 3) // 2)
        r = half.agg(F.avg(a).alias("a"), F.avg(b).alias("b"), F.var_pop(a).alias("aa"), F.var_pop(b).alias("bb"), F.covar_pop(a, b).alias("ab")).first()
        new = np.array([r["a"], r["b"]])
        moved = np.abs(new - centre).max()
        centre, scatter = new, np.array([[r["aa"], r["ab"]], [r["ab"], r["bb"]]]) + 1e-12 * np.eye(2)
        if moved < 1e-12:
            break
    return centre, scatter


def ms_plot_outliers(curves: Curves, share: float = 0.993, sample: int = 20_000, seed: int = 0) -> DataFrame:
    """``(id, mean_outlyingness, variation, robust_distance, is_outlier)``.

    The robust centre and scatter of the (mean, variation) points start from about ``sample`` of them, drawn by a
    hash, and are then concentrated over all points; all curves are judged. The cut is the chi-square quantile of ``share`` for two dimensions, scaled by the median.
    """
    points = directional_outlyingness(curves)
    points = checkpoint(points.where("mean_outlyingness is not null and variation is not null"))
    n = points.count()
    drawn = points.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(2**30)) < int(min(1.0, sample / max(1, n)) * 2**30)).orderBy("id").toPandas()
    centre, scatter = fast_mcd(drawn[["mean_outlyingness", "variation"]].to_numpy(float), seed)
    centre, scatter = _concentrated(points, n, centre, scatter)
    inverse = np.linalg.inv(scatter)
    a, b = F.col("mean_outlyingness") - float(centre[0]), F.col("variation") - float(centre[1])
    squared = a * a * float(inverse[0, 0]) + a * b * float(2 * inverse[0, 1]) + b * b * float(inverse[1, 1])
    scored = points.withColumn("robust_distance", squared)
    middle = quantiles(scored.select(F.lit(0).alias("pos"), F.col("robust_distance").alias("v")), [0.5], curves.df.count()).select(F.get("q", F.lit(0)).alias("m"))
    cut = -2 * math.log(1 - share) / (-2 * math.log(0.5))
    return scored.join(F.broadcast(middle)).select("id", "mean_outlyingness", "variation", "robust_distance", (F.col("robust_distance") > cut * F.col("m")).alias("is_outlier"))


def local_outlier_factor(queries: Curves, curves: Curves, k: int = 20, metric: str = "l2") -> DataFrame:
    """``(id, lof)`` of the query curves with respect to all curves.

    Three rounds of neighbours: of the queries, of their neighbours, and of those. A set that is its own query set
    needs one.
    """
    def neighbours(ids: DataFrame) -> DataFrame:
        some = curves.with_df(curves.df.join(ids.select(F.col("id")), "id", "left_semi"))
        return k_neighbours(some, curves, k, metric)

    first = k_neighbours(queries, curves, k, metric)
    everyone = first.select(F.col("query").alias("id")).union(first.select(F.col("neighbour").alias("id"))).distinct()
    second = neighbours(everyone)
    third = neighbours(second.select(F.col("neighbour").alias("id")).union(everyone).distinct())
    reach = third.groupBy("query").agg(F.max("distance").alias("k_distance")).select(F.col("query").alias("neighbour"), "k_distance")
    density = second.join(reach, "neighbour").groupBy("query").agg((1 / (F.avg(F.greatest("distance", "k_distance")) + 1e-10)).alias("lrd"))
    own = density.select("query", F.col("lrd").alias("own"))
    theirs = density.select(F.col("query").alias("neighbour"), "lrd")
    return first.join(theirs, "neighbour").join(own, "query").groupBy(F.col("query").alias("id")).agg((F.avg("lrd") / F.max("own")).alias("lof"))

