"""Most similar vectors for every vector (problem 5): a block matrix join with int8 product tiles."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvelake.llm.blocks import BlockIndex, BlockSettings, Candidates, Nearest, Tile, build_index, complete_vectors, distinct_vectors, lists, matrix, numbers, one_a_id, routed, visit, within_shards
from curvelake.session import checkpoint, release

_FOUND = "id bigint, radius double, near array<bigint>, square array<double>"
_FIRST = _FOUND + ", vec binary, cell int, shard int, to array<int>"


def _answer(n: Nearest) -> dict[str, pa.Array]:
    i, k = np.nonzero(np.isfinite(n.square))
    many = len(n.ids)
    return {
        "id": pa.array(n.ids, pa.int64()), "radius": pa.array(np.sqrt(n.square[:, -1]), pa.float64()),
        "near": lists(i, n.near[i, k], many, pa.int64()), "square": lists(i, n.square[i, k], many, pa.float64()),
    }


def nearest_distinct(index: BlockIndex, k: int) -> DataFrame:
    """``(id, near, square)``: the k nearest other rows of every row of the index, by squared distance, then id.

    The own shard is searched first; the distance of the k-th row found there bounds what other shards can add.
    Loose rows, which no bound excludes from any shard, are sent to all others; there they look for their own
    neighbours and are offered to the rows they meet, so that those need not be sent to the loose ones.
    """
    pivots, d, s = index.pivots, index.dimension, index.settings
    meta = BlockIndex(None, index.pivots, index.parts, index.radius, d, index.rows, s)
    half, apart = len(pivots) // 2, index.loose
    close = np.unique(index.parts[~apart, 0])

    def own(table: pa.Table) -> pa.Table:
        found = Candidates(table, pivots, s)
        best = Nearest(found.ids, found.rows, found, k, np.full(len(found.ids), np.inf))
        visit(found.rows, best.radius, found, best, shrink=k)
        loose = table.column("cell")[0].as_py() >= half  # a shard has rows of one kind
        q, to = meta.needed(found.rows, np.sqrt(best.square[:, -1]), np.broadcast_to(apart == loose, (len(found.ids), len(apart))))
        if loose:
            every = np.repeat(np.arange(len(found.ids)), len(close))
            q, to = np.r_[q, every], np.r_[to, np.tile(close, len(found.ids))]
            order = np.argsort(q, kind="stable")
            q, to = q[order], to[order]
        other = to != table.column("shard")[0].as_py()
        far = lists(q[other], to[other], len(found.ids), pa.int32())
        order = pa.array(found.order)
        return pa.table(_answer(best) | {"vec": table.column("vec").combine_chunks().take(order), "cell": table.column("cell").combine_chunks().take(order), "shard": table.column("shard").combine_chunks(), "to": far})

    first = checkpoint(within_shards(index, own, _FIRST))
    release(first.sparkSession)
    if index.shards < 2:
        return first.select("id", "near", "square")

    def further(queries: pa.Table, table: pa.Table) -> pa.Table:
        if not queries.num_rows or not table.num_rows:
            return pa.schema([("id", pa.int64()), ("radius", pa.float64()), ("near", pa.list_(pa.int64())), ("square", pa.list_(pa.float64()))]).empty_table()
        found = Candidates(table, pivots, s)
        queries = queries.sort_by("cell")
        best = Nearest(numbers(queries.column("id")), matrix(queries.column("vec"), d), found, k, numbers(queries.column("radius")))
        offered = (numbers(queries.column("cell")) >= half) & (table.column("cell")[0].as_py() < half)
        met = Nearest(found.ids, found.rows, SimpleNamespace(ids=best.ids, rows=best.queries), k, found.column("radius"))

        def do(mine: np.ndarray, span: tuple, tile: Tile) -> None:
            best(mine, span, tile)
            new = np.flatnonzero(offered[mine])
            if len(new):
                # most rows have small radii: only those that a loose row may come near are looked at
                most = met.radius[span[0] : span[1]].max()
                i, j = np.nonzero(tile.within(np.full(len(mine), most))[new])
                met.merge(span[0] + j, mine[new[i]])

        if offered.any():
            visit(best.queries, best.radius, found, do, shrink=k, both=offered, theirs=met.radius)
        else:
            visit(best.queries, best.radius, found, best, shrink=k)
        answers = [pa.table(_answer(x)).filter(pa.array(np.isfinite(x.square[:, 0]))) for x in (best, met)]
        return pa.concat_tables(answers)

    asked = first.where(F.size("to") > 0).select("id", "vec", "radius", "cell", "to")
    more = routed(index, asked, first.toDF(*[f"_{c}" for c in first.columns]).select(*[F.col(f"_{c}").alias(c) for c in ("id", "vec", "radius", "cell", "shard")]), further, _FOUND)
    pairs = F.arrays_zip(F.col("square").alias("square"), F.col("near").alias("near"))
    return (
        first.select("id", "near", "square").unionByName(more.select("id", "near", "square")).select("id", pairs.alias("pairs"))
        .groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("pairs"))), 1, k).alias("best"))
        .select("id", F.col("best.near").alias("near"), F.col("best.square").alias("square"))
    )


def k_nearest(df: DataFrame, k: int = 10, id_column: str = "id", data_column: str = "data_matrix", settings: BlockSettings | None = None) -> DataFrame:
    """``(id, rank, neighbour, distance)``: the k nearest other complete vectors of every complete vector.

    Distance is Euclidean; at equal distance the smaller id is nearer; rank counts from 0. Vectors with a
    null, NaN or infinite cell, of another length, null or empty take no part. Exact copies under other ids
    take part: they are joined once as a group and each member then gets its own neighbours. A collection of
    n <= k vectors gives n - 1 neighbours each. An id repeated with the same vector is one row; repeated with
    different vectors, the one of the smaller hash. Other columns are ignored. An empty table gives no rows.

    The result is exact: no tile is skipped that may hold a neighbour, so the share of true neighbours lost is 0.
    """
    vectors, _, dimension = complete_vectors(df, id_column, data_column)
    distinct, members = distinct_vectors(one_a_id(vectors))
    members = checkpoint(members)
    index = build_index(distinct, dimension, settings)
    found = nearest_distinct(index, k)
    # only the k + 1 smallest ids of a group of copies can be anyone's neighbours
    w = Window.partitionBy("rep").orderBy("id")
    heads = members.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("heads"))
    flat = found.select(F.col("id").alias("from"), F.explode(F.arrays_zip("near", "square")).alias("p")).select("from", F.col("p.near").alias("rep"), F.col("p.square").alias("square"))
    pair = lambda x, sq: F.struct(sq.alias("square"), x.alias("id"))
    outer = (
        flat.join(heads, "rep")
        .select("from", F.transform("heads", lambda x: pair(x, F.col("square"))).alias("pairs"))
        .groupBy("from").agg(F.slice(F.array_sort(F.flatten(F.collect_list("pairs"))), 1, k).alias("outer"))
    )
    lists = heads.join(outer.withColumnRenamed("from", "rep"), "rep", "left").select(
        "rep",
        F.concat(F.transform("heads", lambda x: pair(x, F.lit(0.0))), F.coalesce("outer", F.array().cast("array<struct<square:double,id:bigint>>"))).alias("all"),
    )
    return (
        members.join(lists, "rep")
        .select("id", F.slice(F.filter("all", lambda p: p["id"] != F.col("id")), 1, k).alias("best"))
        .select("id", F.posexplode("best").alias("rank", "p"))
        .select("id", "rank", F.col("p.id").alias("neighbour"), F.sqrt("p.square").alias("distance"))
    )
