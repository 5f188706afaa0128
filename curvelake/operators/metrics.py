"""Norms, distances and neighbours of curves.

Norms and distances of matched curves are expressions of one row. A set of query curves is compared with all
curves in blocks: a block of queries, of checked size, goes to every task, which compares it with its rows
and returns only what was asked for (the k best, those in a radius). Larger query sets are cut into blocks, as
are the rows, and each pair of blocks is the work of a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelake.columns import constant, dot, total
from curvelake.frames import Curves

#: bytes of the query block that is sent to every task
BLOCK_BYTES = 64_000_000


def lp_norm_column(data: Column, weights, p: float) -> Column:
    if p != math.inf and p < 1:
        raise ValueError("p must be at least 1")
    if p == math.inf:
        return F.array_max(F.transform(data, F.abs))
    if p == 1:
        return total(F.zip_with(data, constant(weights), lambda x, w: F.abs(x) * w))
    if p == 2:
        return F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with(data, constant(weights), lambda x, w: x * x * w))))
    return F.pow(total(F.zip_with(data, constant(weights), lambda x, w: F.pow(F.abs(x), F.lit(float(p))) * w)), F.lit(1 / p))


def lp_norm(curves: Curves, p: float = 2, vector_norm: float | None = None) -> DataFrame:
    """``(id, norm)``; several coordinates are first combined at each point by the norm ``vector_norm`` (default p)."""
    d, data = curves.meta.codomain, F.col("data")
    if d > 1:
        q = p if vector_norm is None else vector_norm
        n = curves.meta.size // d
        inner = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lp_norm_column(F.slice("data", i * d + 1, F.lit(d)), np.ones(d), q))
        data = inner
    return curves.df.select("id", lp_norm_column(data, curves.weights(), p).alias("norm"))


def lp_distance(a: Curves, b: Curves, p: float = 2) -> DataFrame:
    """``(id, distance)`` of the curves of the same id."""
    return lp_norm(a - b, p).withColumnRenamed("norm", "distance")


def inner_product(a: Curves, b: Curves) -> DataFrame:
    """``(id, inner)`` of the curves of the same id."""
    return (a * b).integrate().withColumnRenamed("integral", "inner")


def cosine_similarity(a: Curves, b: Curves) -> DataFrame:
    a._same_grid(b)
    both = a.df.select("id", "data").join(b.df.select("id", F.col("data").alias("o")), "id")
    w = a.weights()
    inner = total(F.zip_with(F.zip_with("data", "o", lambda x, y: x * y), constant(w), lambda x, y: x * y))
    size = lp_norm_column(F.col("data"), w, 2) * lp_norm_column(F.col("o"), w, 2)
    return both.select("id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(inner, size))).alias("cosine"))


def angular_distance(a: Curves, b: Curves) -> DataFrame:
    return cosine_similarity(a, b).select("id", (F.acos("cosine") / math.pi).alias("distance"))


def distances_to(curves: Curves, centre, out: str = "distance", p: float = 2) -> DataFrame:
    """The frame with the distance of each curve to one known function on the grid."""
    off = F.zip_with("data", constant(centre), lambda x, c: x - c)
    return curves.df.withColumn(out, lp_norm_column(off, curves.weights(), p))


def srsf(curves: Curves) -> Curves:
    """sign(f') sqrt|f'|"""
    return curves.derivative().map(lambda x: F.signum(x) * F.sqrt(F.abs(x)))


def fisher_rao_distance(a: Curves, b: Curves) -> DataFrame:
    """L2 distance of the square-root slope functions, the domain scaled to [0, 1]."""
    low, high = a.meta.domain[0]
    scaled = lambda c: Curves(c.df, c.meta.with_points((c.meta.points - low) / (high - low), domain=((0.0, 1.0),)))
    return lp_distance(srsf(scaled(a)), srsf(scaled(b)))


def matrix_of(column: pd.Series, size: int) -> np.ndarray:
    """Rows as an array; null rows and cells are NaN."""
    if not len(column):
        return np.zeros((0, size))
    return np.stack([np.full(size, np.nan) if r is None else np.asarray(r, float) for r in column])


def norm_induced(norm: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable:
    """The metric of a norm: ``norm(rows, weights)`` of the differences of queries and rows."""
    return lambda q, x, w: np.stack([norm(row - x, w) for row in q]) if len(q) else np.zeros((0, len(x)))


def transformed(change: Callable[[np.ndarray], np.ndarray], metric="l2") -> Callable:
    """A metric of changed curves: ``change`` maps rows of values to rows of values on the same grid."""
    return lambda q, x, w: block_distances(change(q), change(x), w, metric)


def block_distances(q: np.ndarray, x: np.ndarray, w: np.ndarray, metric: str | Callable, p: float = 2) -> np.ndarray:
    """(queries, rows) distances; L1, L2 and others by differences, in slices of bounded memory.

    ``metric`` may be a function of (queries, rows, quadrature weights), as ``norm_induced`` and ``transformed`` make.
    """
    if callable(metric):
        return np.asarray(metric(q, x, w), float)
    out = np.empty((len(q), len(x)))
    if metric == "angular":
        signed = (q * w) @ x.T
        size = np.sqrt(((q * q) @ w)[:, None] * ((x * x) @ w)[None])
        return np.arccos(np.clip(signed / np.where(size == 0, 1, size), -1, 1)) / np.pi
    step = max(1, 2_000_000 // max(1, x.size))
    for i in range(0, len(q), step):
        d = q[i : i + step, None] - x[None]
        if metric == "l1":
            out[i : i + step] = np.abs(d) @ w
        elif metric == "linf":
            out[i : i + step] = np.abs(d).max(-1) if d.size else 0
        elif metric == "lp":
            out[i : i + step] = (np.abs(d) ** p @ w) ** (1 / p)
        else:
            out[i : i + step] = np.sqrt(np.maximum((d * d) @ w, 0))
    return out


def in_blocks(queries: Curves, rows: Curves, work: Callable[[pd.DataFrame, np.ndarray, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, query_columns: list[str] | None = None, row_columns: list[str] | None = None, block_bytes: int | None = None) -> DataFrame:
    """Run ``work(query frame, query matrix, row frame, row matrix)`` for every block of queries and batch of rows.

    Queries of up to ``block_bytes`` go to every task. More of them, and the rows, are cut into blocks of that
    size, and each pair of blocks is the work of one task; none passes through the driver.
    """
    block_bytes = BLOCK_BYTES if block_bytes is None else block_bytes
    queries._same_grid(rows)
    size = rows.meta.size
    asked = queries.df.select("id", "data", *(query_columns or []))
    data = rows.df.select("id", "data", *(row_columns or []))
    blocks = max(1, -(-asked.count() * size * 8 // block_bytes))
    if blocks == 1:  # the query set is small: it goes to every task, and the rows stay where they are
        frame = asked.toPandas()
        q = matrix_of(frame["data"], size)
        frame = frame.drop(columns="data")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b) and len(frame):
                    yield work(frame, q, b.drop(columns="data"), matrix_of(b["data"], size))

        return data.mapInPandas(run, schema)
    groups = max(1, -(-data.count() * size * 8 // block_bytes))
    left = asked.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = data.toDF(*[f"r_{c}" for c in data.columns]).withColumn("_group", F.pmod(F.xxhash64("r_id", F.lit(1)), F.lit(groups)).cast("int"))
    right = right.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    own, other = list(asked.columns), list(data.columns)

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.rename(columns={f"r_{c}": c for c in other})[other]
        q, frame = matrix_of(a["data"], size), a[own].drop(columns="data").reset_index(drop=True)
        made = [work(frame, q, c.drop(columns="data").reset_index(drop=True), matrix_of(c["data"], size)) for c in (b.iloc[k : k + 4096] for k in range(0, len(b), 4096))] if len(a) else []
        return pd.concat(made) if made else pd.DataFrame({x.split()[0]: [] for x in schema.split(", ")})

    return left.groupBy("_block", "_group").cogroup(right.groupBy("_block", "_group")).applyInPandas(pair, schema)


def k_neighbours(queries: Curves, rows: Curves, k: int, metric: str = "l2", p: float = 2, skip_self: bool = True, carry: list[str] | None = None) -> DataFrame:
    """``(query, neighbour, distance, rank, *carry)``: the k nearest of ``rows``; ties by id; rank from 1.

    Every task keeps its k best for each query, so what is shuffled grows with queries, k and tasks alone.
    """
    w, carry = rows.weights(), carry or []
    kinds = dict(rows.df.dtypes)
    schema = f"query {dict(queries.df.dtypes)['id']}, neighbour {kinds['id']}, distance double" + "".join(f", {c} {kinds[c]}" for c in carry)

    def best(frame, q, b, x):
        d = np.round(block_distances(q, x, w, metric, p), 10)
        ids = b["id"].to_numpy()
        same = frame["id"].to_numpy()[:, None] == ids[None] if skip_self else np.zeros(d.shape, bool)
        d = np.where(same | np.isnan(d), np.inf, d)
        take = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k] if d.shape[1] <= 4 * k else None
        if take is None:
            edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
            i, j = np.nonzero((d <= edge) & np.isfinite(d))
        else:
            i, j = np.repeat(np.arange(len(q)), take.shape[1]), take.ravel()
            ok = np.isfinite(d[i, j])
            i, j = i[ok], j[ok]
        return pd.DataFrame({"query": frame["id"].to_numpy()[i], "neighbour": ids[j], "distance": d[i, j], **{c: b[c].to_numpy()[j] for c in carry}})

    found = in_blocks(queries, rows, best, schema, row_columns=carry)
    order = Window.partitionBy("query").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def radius_neighbours(queries: Curves, rows: Curves, radius: float, metric: str = "l2", p: float = 2, skip_self: bool = True, carry: list[str] | None = None) -> DataFrame:
    """``(query, neighbour, distance, *carry)`` of the rows within the radius."""
    w, carry = rows.weights(), carry or []
    kinds = dict(rows.df.dtypes)
    schema = f"query {dict(queries.df.dtypes)['id']}, neighbour {kinds['id']}, distance double" + "".join(f", {c} {kinds[c]}" for c in carry)

    def near(frame, q, b, x):
        d = np.round(block_distances(q, x, w, metric, p), 10)
        hit = d <= radius
        if skip_self:
            hit &= frame["id"].to_numpy()[:, None] != b["id"].to_numpy()[None]
        i, j = np.nonzero(hit)
        return pd.DataFrame({"query": frame["id"].to_numpy()[i], "neighbour": b["id"].to_numpy()[j], "distance": d[i, j], **{c: b[c].to_numpy()[j] for c in carry}})

    return in_blocks(queries, rows, near, schema, row_columns=carry)


def pair_distances(queries: Curves, rows: Curves, metric: str = "l2", p: float = 2) -> DataFrame:
    """``(query, row, distance)`` of a stated query set against all rows."""
    found = radius_neighbours(queries, rows, math.inf, metric, p, skip_self=False)
    return found.withColumnRenamed("neighbour", "row")


def gram(queries: Curves, rows: Curves) -> DataFrame:
    """``(query, row, inner)``: inner products of a stated query set with all rows."""
    w = rows.weights()
    kinds = dict(queries.df.dtypes)["id"], dict(rows.df.dtypes)["id"]

    def work(frame, q, b, x):
        g = (q * w) @ x.T
        i, j = np.indices(g.shape)
        return pd.DataFrame({"query": frame["id"].to_numpy()[i.ravel()], "row": b["id"].to_numpy()[j.ravel()], "inner": g.ravel()})

    return in_blocks(queries, rows, work, f"query {kinds[0]}, row {kinds[1]}, inner double")


def mahalanobis(curves: Curves, centre, components: np.ndarray, eigenvalues: np.ndarray, alpha: float = 1e-3) -> DataFrame:
    """``(id, distance)``: sum of lambda <x - centre, e>^2 / (lambda + alpha)^2, without a root."""
    w = curves.weights()
    centred = F.zip_with("data", constant(centre), lambda x, c: x - c)
    terms = [dot(centred, e * w) * dot(centred, e * w) * float(v / (v + alpha) ** 2) for e, v in zip(components, eigenvalues)]
    return curves.df.select("id", reduce(lambda a, b: a + b, terms).alias("distance"))

