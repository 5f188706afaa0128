"""Blocked neighbour joins over numeric vectors.

Vectors are placed into cells round pivots (fitted on a bounded sample; every row is indexed) and
cells into shards of bounded size. A query row is sent to a shard only if the triangle inequality
lets one of the shard's cells hold a row within the query's radius. Inside a task, large cells are
cut again round pivots of their own, and pairs are tested by int8 product tiles: both sides are
quantised relative to the cell's pivot, a row's scale being its largest residual, so that the
distance of the quantised rows differs from the true one by at most the two residual norms. Pairs
that survive the bound are recomputed in double precision. No pair within the radius is lost.

The int8 values are multiplied as float32, in which these integer sums are exact for up to 1,040
dimensions a slice; wider rows are cut into such slices. Vectors travel packed
without loss (``packed``): those of a few decimals as whole numbers, others as their doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.session import checkpoint, release

SLICE = 1040


@dataclass(frozen=True)
class BlockSettings:
    #: rows of the sample on which pivots are fitted, and the most pivots
    sample_rows: int = 20_000
    most_pivots: int = 2048
    rows_per_pivot: int = 64
    #: cells of more rows than this are cut again in their task, into parts of about a quarter of that
    most_cell: int = 512
    #: bounds of the rows in a shard, and of the queries in a task
    least_shard: int = 8192
    most_shard: int = 32_768
    shards_wanted: int = 12
    #: rows further from their pivot than this multiple of the sample's median are loose: they are kept apart
    far_ratio: float = 2.5
    queries_per_task: int = 16_384
    #: rows that ``routed`` may send at once, if the index has fewer
    turn_rows: int = 200_000
    seed: int = 7


#: decimals and width in bytes of the forms a row may be packed in, tried in this order; any other row keeps its doubles
FORMS = tuple((k, width) for width in (2, 4) for k in range(7))


def packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column: a byte for the form, then the cells.

    A row of numbers of a few decimals is stored as the differences of whole numbers, their low bytes before their
    high ones, if that gives back every double; NaN is the least whole number. Equal rows have equal bytes.
    """
    x = np.ascontiguousarray(x, np.float64)
    n, d = x.shape
    form, made, gone = np.full(n, 255, np.uint8), [], np.isnan(x)
    plain, left = np.where(gone, 0.0, x), np.arange(n)
    for f, (k, width) in enumerate(FORMS):
        fits = lambda v: ((np.rint(v * 10.0**k) / 10.0**k == v) & (np.abs(v * 10.0**k) < 2.0 ** (8 * width - 1) - 1) & ~((v == 0) & np.signbit(v))).all(1)  # noqa: B023, E731
        mine = left[fits(plain[left, : min(d, 8)])]  # few rows pass the first cells in a form that is not theirs
        mine = mine[fits(plain[mine])]
        left = left[~np.isin(left, mine)]
        cells = np.where(gone[mine], -(2.0 ** (8 * width - 1)), np.rint(plain[mine] * 10.0**k)).astype(np.int64).astype(f"<u{width}")
        cells[:, 1:] -= cells[:, :-1].copy()
        form[mine] = f
        made.append((mine, cells.view(np.uint8).reshape(len(mine), d, width).transpose(0, 2, 1).reshape(len(mine), d * width)))
        if not len(left):
            break
    made.append((left, x[left].view(np.uint8).reshape(len(left), 8 * d)))
    size = np.zeros(n, np.int64)
    for mine, cells in made:
        size[mine] = cells.shape[1] + 1
    edges = np.r_[0, np.cumsum(size)]
    out = np.empty(edges[-1], np.uint8)
    out[edges[:-1]] = form
    for mine, cells in made:
        out[(edges[mine] + 1)[:, None] + np.arange(cells.shape[1])] = cells
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(out)])


def matrix(column: pa.ChunkedArray, dimension: int) -> np.ndarray:
    """A column of packed rows as the rows of a matrix."""
    n = len(column)
    out = np.empty((n, dimension))
    at = 0
    for part in column.chunks:
        if not len(part):
            continue
        start = np.frombuffer(part.buffers()[1], np.int32, len(part) + 1, 4 * part.offset)[:-1].astype(np.int64)
        data = np.frombuffer(part.buffers()[2], np.uint8)
        form = data[start]
        for f in np.unique(form).tolist():
            k, width = FORMS[f] if f < len(FORMS) else (0, 8)
            mine = np.flatnonzero(form == f)
            for a in range(0, len(mine), 8192):
                some = mine[a : a + 8192]
                cells = data[(start[some] + 1)[:, None] + np.arange(dimension * width)]
                if f == 255:
                    out[at + some] = cells.view(np.float64)
                    continue
                whole = np.ascontiguousarray(cells.reshape(len(some), width, dimension).transpose(0, 2, 1)).view(f"<u{width}")[..., 0]
                whole = np.cumsum(whole, axis=1, dtype=whole.dtype).view(f"<i{width}")
                out[at + some] = np.where(whole == np.iinfo(whole.dtype).min, np.nan, whole / 10.0**k)
        at += len(part)
    return out


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


def complete_vectors(df: DataFrame, id_column: str, data_column: str, dimension: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """``(complete, incomplete, dimension)``.

    Both frames have ``id, vec`` (packed). A vector is complete if it has ``dimension`` cells (by default the
    most frequent length, the greater of ties) and none is null, NaN or infinite; an incomplete one has
    ``dimension`` cells of which some are missing (NaN in ``vec``) and at least one is not. All other rows
    (null id, null, empty or otherwise long arrays) are in neither. ``-0.0`` becomes ``0.0``.
    """
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(data_column).cast("array<double>").alias("raw")).where("id is not null and raw is not null")
    if dimension is None:
        sizes = rows.groupBy(F.size("raw").alias("n")).count().where("n > 0").orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
        dimension = sizes[0]["n"] if sizes else 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("raw").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, dimension) + 0.0
            x[~np.isfinite(x)] = np.nan
            gone = np.isnan(x).sum(1)
            some = gone < dimension
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(some)), packed(x[some]), pa.array(gone[some], pa.int32())], names=["id", "vec", "gone"])

    if not dimension:
        none = df.sparkSession.createDataFrame([], "id bigint, vec binary")
        return none, none, 0
    rows = checkpoint(rows.where(F.size("raw") == dimension).mapInArrow(pack, "id bigint, vec binary, gone int"))
    return rows.where("gone = 0").select("id", "vec"), rows.where("gone > 0").select("id", "vec"), dimension


def one_a_id(vectors: DataFrame) -> DataFrame:
    """``(id, vec, h)``: of an id with different vectors the one of the smallest hash ``h``, once."""
    keyed = vectors.select("id", "vec", F.struct(F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2")).alias("h"))
    return keyed.groupBy("id").agg(F.min(F.struct("h", "vec")).alias("r")).select("id", "r.vec", "r.h")


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(distinct (id, vec, copies), members (id, rep))`` of ``one_a_id``: copies become the one with the smallest id."""
    keyed = checkpoint(vectors)
    groups = keyed.groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = keyed.select("id", "h").join(groups.select("h", "rep"), "h").select("id", "rep")
    distinct = keyed.join(groups.select(F.col("rep").alias("id"), "copies"), "id").select("id", "vec", "copies")
    return distinct, members


def _fit_pivots(sample: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Farthest-first starts among random rows, then a few rounds of k-means."""
    rng = np.random.default_rng(seed)
    norms = (sample * sample).sum(1)
    to = lambda i: np.maximum(norms + norms[i] - 2 * (sample @ sample[i]), 0)
    first = [int(rng.integers(len(sample)))]
    near = to(first[0])
    near[first[0]] = 0
    while len(first) < count and near.max() > 0:
        pool = rng.choice(len(sample), size=min(len(sample), 64), replace=False)
        pick = int(pool[near[pool].argmax()])
        if near[pick] == 0:
            pick = int(near.argmax())
        first.append(pick)
        near = np.minimum(near, to(pick))
        near[pick] = 0
    pivots = sample[first]
    for _ in range(4):
        owner = nearest_pivot(sample, pivots)[0]
        order = np.argsort(owner, kind="stable")
        edge = np.flatnonzero(np.r_[True, np.diff(owner[order]) != 0])
        size = np.diff(np.r_[edge, len(order)])
        pivots[owner[order][edge]] = np.add.reduceat(sample[order], edge) / size[:, None]
    return pivots


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T, 0))


def rounding_slack(x: np.ndarray, pivots: np.ndarray) -> float:
    """More than ``pivot_distances`` may be off: the root of the rounding error of the squared norms."""
    largest = max(np.nan_to_num(x * x).sum(1).max(initial=0), (pivots * pivots).sum(1).max(initial=0))
    return 1e-9 + float(np.sqrt(largest)) * 1e-6


def nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner = np.concatenate([pivot_distances(x[a : a + 4096], pivots).argmin(1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)
    return owner, np.sqrt(((x - pivots[owner]) ** 2).sum(1))


@dataclass
class BlockIndex:
    """Placed vectors with the bounded metadata that routes queries."""

    placed: DataFrame  # id, vec, copies, cell, shard
    pivots: np.ndarray
    parts: np.ndarray  # shard, cell, rows
    radius: np.ndarray  # of each part
    dimension: int
    rows: int
    settings: BlockSettings

    @property
    def loose(self) -> np.ndarray:
        """Whether each part holds loose rows."""
        return self.parts[:, 1] >= len(self.pivots) // 2

    @property
    def shards(self) -> int:
        return int(self.parts[:, 0].max()) + 1 if len(self.parts) else 0

    def needed(self, x: np.ndarray, radius: np.ndarray, useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, shard) of the shards that may hold a row within a query's radius.

        ``useful`` (queries x parts) may exclude parts. Missing cells of a query count nothing.
        """
        half = max(1, len(self.pivots) // 2)  # the second half repeats the pivots, for the far rows
        shard, cell, pivots = self.parts[:, 0], self.parts[:, 1] % half, self.pivots[:half]
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        out = []
        for a in range(0, len(x), 2048):
            q = x[a : a + 2048]
            seen = ~np.isnan(q)
            if seen.all():
                far = pivot_distances(q, pivots)
            else:
                zero = np.where(seen, q, 0)
                far = np.sqrt(np.maximum((zero * zero).sum(1)[:, None] + seen @ (pivots * pivots).T - 2 * zero @ pivots.T, 0))
            reach = far[:, cell] - self.radius[None] <= radius[a : a + 2048, None] + rounding_slack(q, pivots)
            if useful is not None:
                reach &= useful[a : a + 2048]
            i, k = np.nonzero(np.logical_or.reduceat(reach, starts, axis=1))
            out.append((a + i, shard[starts][k]))
        if not out:
            return np.zeros(0, int), np.zeros(0, int)
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def lists(owner: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """A list column of n rows; ``owner`` ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values, kind))


def _sample(vectors: DataFrame, rows: int, dimension: int, s: BlockSettings) -> np.ndarray:
    """At most ``sample_rows`` rows drawn by a hash of their ids."""
    share = int(min(1.0, 1.1 * s.sample_rows / rows) * 2**30)
    drawn = vectors.where(F.pmod(F.xxhash64(F.lit(s.seed), "id"), F.lit(2**30)) < share).select("id", "vec").toArrow().sort_by("id")
    got = matrix(drawn.column("vec"), dimension)
    return got[np.sort(np.random.default_rng(s.seed).permutation(len(got))[: s.sample_rows])] if len(got) else matrix(vectors.limit(1).select("vec").toArrow().column("vec"), dimension)


def build_index(vectors: DataFrame, dimension: int, settings: BlockSettings | None = None) -> BlockIndex:
    """Index every row of ``vectors (id, vec, copies)``; ids must be unique."""
    s = settings or BlockSettings()
    vectors = checkpoint(vectors.select("id", "vec", "copies"))
    rows = vectors.count()
    if not rows:
        return BlockIndex(vectors.select("*", F.lit(0).alias("cell"), F.lit(0).alias("shard")), np.zeros((0, dimension)), np.zeros((0, 3), int), np.zeros(0), dimension, 0, s)
    sample = _sample(vectors, rows, dimension, s)
    pivots = _fit_pivots(sample, max(1, min(s.most_pivots, rows // s.rows_per_pivot)), s.seed)
    # rows far from every pivot would blow up the radius of a cell of close rows: these loose rows get cells, and
    # shards, of their own
    count, cut = len(pivots), s.far_ratio * float(np.median(nearest_pivot(sample, pivots)[1]))
    pivots = np.concatenate([pivots, pivots])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, far = nearest_pivot(matrix(pa.chunked_array([b.column("vec")]), dimension), pivots[:count])
            cell = pa.array((owner + count * (far > cut)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("id", "vec", "copies")], cell, pa.array(far)], names=["id", "vec", "copies", "cell", "far"])

    placed = checkpoint(vectors.mapInArrow(place, "id bigint, vec binary, copies bigint, cell int, far double"))
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # a row a cell
    want = min(s.most_shard, max(s.least_shard, rows // s.shards_wanted))
    # neighbouring cells share shards: cells in the order of the pivots' first principal direction
    centred = pivots[:count] - pivots[:count].mean(0)
    order = np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0]) if count > 1 else np.zeros(1, int)
    order = np.concatenate([order, order + count])
    table, shard, room = [], 0, want
    for turn, cell in enumerate(order.tolist()):
        if turn == count and room < want:
            shard, room = shard + 1, want  # loose rows share no shard with others
        n = sizes.get(cell, 0)
        if n > want:
            if room < want:
                shard, room = shard + 1, want
            parts = -(-n // want)
            table.append((cell, shard, parts))
            shard, room = shard + parts, want
        elif n:
            if n > room:
                shard, room = shard + 1, want
            table.append((cell, shard, 1))
            room -= n
    del vectors
    release(placed.sparkSession)
    cells = F.broadcast(placed.sparkSession.createDataFrame(table, "cell int, first int, parts int"))  # at most two rows a pivot
    placed = placed.join(cells, "cell").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    meta = placed.groupBy("shard", "cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).orderBy("shard", "cell").collect()
    parts = np.array([(r["shard"], r["cell"], r["n"]) for r in meta], int)
    return BlockIndex(placed.select("id", "vec", "copies", "cell", "shard"), pivots, parts, np.array([r["far"] for r in meta]), dimension, rows, s)


def quantise(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the norms of what they miss, and their squared norms."""
    scale = np.abs(residual).max(1) / 127 if residual.shape[1] else np.zeros(len(residual))
    scale[scale == 0] = 1
    small = np.rint(residual / scale[:, None]).astype(np.int8)
    back = small * scale[:, None]
    return small, scale, np.sqrt(((residual - back) ** 2).sum(1)), (back * back).sum(1)


class Tile:
    """The int8 products of two quantised sets, and what they say about the distances of all pairs."""

    def __init__(self, a: tuple, b: tuple):
        self.a, self.b, self.dots = a, b, 0
        for k in range(0, a[0].shape[1], SLICE):
            self.dots = self.dots + a[0][:, k : k + SLICE].astype(np.float32) @ b[0][:, k : k + SLICE].astype(np.float32).T

    def within(self, limit: np.ndarray) -> np.ndarray:
        """The pairs whose distance may be at most ``limit``, by row."""
        a, b = self.a, self.b
        if not len(b[1]):
            return np.zeros(self.dots.shape, bool)
        # the distance of the quantised rows may be further by both residual norms, the largest of b for all
        far = (limit + a[2] + b[2].max()) ** 2 + 8e-6 * (a[3] + b[3].max()) - a[3]
        return b[3].astype(np.float32)[None] - self.dots * (2 * a[1]).astype(np.float32)[:, None] * b[1].astype(np.float32)[None] <= far.astype(np.float32)[:, None] * np.float32(1 + 1e-6)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Approximate distances of all pairs and their error bounds."""
        return _bounds(self.a, self.b, self.dots)


def _bounds(a: tuple, b: tuple, dots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    na, nb = a[3].astype(np.float32), b[3].astype(np.float32)
    total = na[:, None] + nb[None]
    square = total - (2 * a[1]).astype(np.float32)[:, None] * b[1].astype(np.float32)[None] * dots
    near = np.sqrt(np.maximum(square, 0))
    # rounding of float32: an error of delta in the square moves the root by at most sqrt(delta), and delta / (2 root)
    delta = total * np.float32(4e-6)
    rounding = np.minimum(np.sqrt(delta), delta / np.maximum(near, np.float32(1e-12)))
    return near, a[2].astype(np.float32)[:, None] + b[2].astype(np.float32)[None] + rounding


def _tile(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    return Tile(a, b).bounds()


class Candidates:
    """One shard in a task: rows by cell, quantised once."""

    def __init__(self, table: pa.Table, pivots: np.ndarray, s: BlockSettings, tile_rows: int = 8192):
        cells, ids = numbers(table.column("cell")), numbers(table.column("id"))
        rows = matrix(table.column("vec"), pivots.shape[1])
        order = np.lexsort((ids, cells))
        cells, tiles = cells[order], []
        edges = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True]) if len(cells) else np.zeros(0, int)
        loose = int(np.searchsorted(cells, len(pivots) // 2))
        for a in range(loose, len(cells), 2 * s.most_cell):  # no bound excludes loose rows, so their cells are not kept apart
            b = min(len(cells), a + 2 * s.most_cell)
            tiles.append((a, b, rows[order[a:b]].mean(0)))
        for a, b in zip(edges, edges[1:]):
            if a >= loose:
                break
            if b - a <= s.most_cell:
                tiles.append((a, b, pivots[cells[a]]))
                continue
            own = _fit_pivots(rows[order[a:b]], max(2, 4 * (b - a) // s.most_cell), s.seed)
            part, _ = nearest_pivot(rows[order[a:b]], own)
            sub = np.argsort(part, kind="stable")
            order[a:b], part = order[a:b][sub], part[sub]
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            tiles += [(a + lo, a + hi, own[part[lo]]) for lo, hi in zip(cut, cut[1:])]
        self.order, self.ids, self.rows = order, ids[order], rows[order]
        self.table, self.tiles = table, []
        for a, b, pivot in tiles:
            for lo in range(a, b, tile_rows):
                hi = min(b, lo + tile_rows)
                residual = self.rows[lo:hi] - pivot
                self.tiles.append((lo, hi, pivot, np.sqrt((residual**2).sum(1)).max(), quantise(residual)))
        self.centres = np.array([t[2] for t in self.tiles]).reshape(len(self.tiles), -1)

    def column(self, name: str) -> np.ndarray:
        return numbers(self.table.column(name))[self.order]


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (i, j) in double precision."""
    return np.concatenate([((a[i[k : k + 65536]] - b[j[k : k + 65536]]) ** 2).sum(1) for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0)


def visit(
    queries: np.ndarray, radius: np.ndarray, found: Candidates, do: Callable, chunk: int = 128, shrink: int = 0, both: np.ndarray | None = None, theirs: np.ndarray | None = None
) -> None:
    """Call ``do(query indices, span of rows, tile)`` for every tile a query may need.

    Queries marked in ``both`` also need tiles that hold a row whose own radius, in ``theirs``, they may lie
    within. ``radius`` is read anew for each tile, so ``do`` may lower it. With ``shrink`` = k, the first tile of more
    than k rows bounds an infinite radius by its k-th smallest upper bound.
    """
    for a in range(0, len(queries), chunk):
        q = queries[a : a + chunk]
        if not found.tiles:
            continue
        far = pivot_distances(q, found.centres)
        slack = rounding_slack(q, found.centres)
        for k in np.argsort(far.min(0), kind="stable"):
            lo, hi, pivot, reach, packed = found.tiles[k]
            limit = radius[a : a + chunk]
            if both is not None:
                limit = np.where(both[a : a + chunk], np.maximum(limit, theirs[lo:hi].max()), limit)
            mine = np.flatnonzero(far[:, k] - reach <= limit + slack)
            if not len(mine):
                continue
            tile = Tile(quantise(q[mine] - pivot), packed)
            if shrink and hi - lo > shrink:
                new = np.flatnonzero(np.isinf(radius[a + mine]))
                if len(new):
                    near, bound = _bounds(tuple(x[new] for x in tile.a), tile.b, tile.dots[new])
                    top = np.partition(near + bound, shrink, axis=1)[:, shrink]  # one more than k: the row itself may be there
                    radius[a + mine[new]] = top * (1 + 1e-6) + 1e-9
            do(a + mine, (lo, hi), tile)


class Nearest:
    """The k nearest of every query so far: a heap a query, merged tile by tile."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, found: Candidates, k: int, radius: np.ndarray):
        self.ids, self.queries, self.found, self.k = ids, queries, found, k
        self.radius = radius.astype(float).copy()
        self.square = np.full((len(ids), k), np.inf)
        self.near = np.full((len(ids), k), np.iinfo(np.int64).max)

    def __call__(self, mine: np.ndarray, span: tuple, tile: Tile, keep: np.ndarray | None = None) -> None:
        hit = tile.within(self.radius[mine])
        if keep is not None:
            hit &= keep
        i, j = np.nonzero(hit)
        self.merge(mine[i], span[0] + j)

    def merge(self, i: np.ndarray, j: np.ndarray) -> None:
        """Add the pairs of queries i and rows j that are near enough."""
        other = self.found.ids[j] != self.ids[i]
        i, j = i[other], j[other]
        if not len(i):
            return
        d = exact(self.queries, self.found.rows, i, j)
        inside = d <= (self.radius[i] * (1 + 1e-9)) ** 2 + 1e-18
        i, j, d = i[inside], j[inside], d[inside]
        if not len(i):
            return
        touched, local = np.unique(i, return_inverse=True)
        who = np.r_[local, np.repeat(np.arange(len(touched)), self.k)]
        d = np.r_[d, self.square[touched].ravel()]
        ids = np.r_[self.found.ids[j], self.near[touched].ravel()]
        order = np.lexsort((ids, d, who))
        who = who[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        take = order[rank < self.k]
        self.square[touched] = d[take].reshape(-1, self.k)
        self.near[touched] = ids[take].reshape(-1, self.k)
        self.radius[touched] = np.minimum(self.radius[touched], np.sqrt(self.square[touched, -1]))


def tasks(n: int) -> int:
    return int(max(8, 2 * n))


def within_shards(index: BlockIndex, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Run ``work`` over each shard by itself."""
    return index.placed.repartition(tasks(index.shards), "shard").groupBy("shard").applyInArrow(work, schema)


def routed(index: BlockIndex, queries: DataFrame, rows: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Run ``work(queries, candidates)`` for each shard and part of its queries.

    ``queries`` have ``id`` and ``to``, the shards they are sent to (``needed``); ``rows`` are candidates with
    ``shard``, perhaps fewer than are placed.
    """
    spark, s = queries.sparkSession, index.settings
    queries = queries.withColumn("to", F.explode("to"))
    counts = queries.groupBy("to").count().collect()  # a row a shard
    if not counts:
        return spark.createDataFrame([], schema)
    held = np.bincount(index.parts[:, 0], index.parts[:, 2])

    def together(salts: list[tuple[int, int]]) -> DataFrame:
        table = F.broadcast(spark.createDataFrame(salts, "to int, salts int"))
        n = tasks(sum(k for _, k in salts))
        left = queries.join(table, "to").withColumn("salt", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("salts")).cast("int")).drop("salts").repartition(n, "to", "salt")
        right = rows.withColumn("to", F.col("shard")).join(table, "to").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts").repartition(n, "to", "salt")
        return left.groupBy("to", "salt").cogroup(right.groupBy("to", "salt")).applyInArrow(work, schema)

    # rows that are sent to many shards would fill the disk at once: shards take turns, about as many rows a turn as are placed
    turns, sent = [[]], 0
    for r in sorted(counts, key=lambda r: r["to"]):
        salts = -(-r["count"] // s.queries_per_task)
        more = r["count"] + int(held[r["to"]]) * salts
        if turns[-1] and sent + more > max(index.rows, s.turn_rows):
            turns, sent = [*turns, []], 0
        turns[-1].append((r["to"], salts))
        sent += more
    if len(turns) == 1:
        return together(turns[0])
    found = []
    for turn in turns:
        found.append(checkpoint(together(turn)))
        release(spark)
    return reduce(DataFrame.unionByName, found)
