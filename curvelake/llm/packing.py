"""Filling fixed-capacity containers with items (problem 6): best-two-fit.

A bin is filled greedily with the largest item that fits. Then, as long as that tightens it, its
smallest item makes room for the two unpacked items that together fit the gap it leaves best.

Items are packed in shards drawn by a hash of their id, so the work is spread evenly whatever ids or
sizes prevail. Bins that stay under ``dense`` are dissolved and packed again in a later round of fewer
shards; what the last round leaves is final.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.session import checkpoint


@dataclass(frozen=True)
class PackSettings:
    #: items and tokens that a task packs
    shard_items: int = 20_000
    shard_tokens: int = 8_000_000
    dense: float = 0.99
    rounds: int = 4


class _Pool:
    """Unpacked items by size."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        order = np.argsort(sizes, kind="stable")[::-1]
        self.items = {}
        for i in order:
            self.items.setdefault(int(sizes[i]), []).append(int(i))
        self.count = np.bincount(sizes, minlength=capacity + 1)
        self._refresh()

    def _refresh(self) -> None:
        here = self.count > 0
        self.sizes = np.flatnonzero(here)
        self.floor = np.maximum.accumulate(np.where(here, np.arange(len(here)), 0))

    def take(self, size: int) -> int:
        self.count[size] -= 1
        if not self.count[size]:
            self._refresh()
        return self.items[size].pop()

    def give(self, size: int, item: int) -> None:
        self.items.setdefault(size, []).append(item)
        self.count[size] += 1
        if self.count[size] == 1:
            self._refresh()

    def best_two(self, room: int) -> tuple[int, int, int]:
        """(total, larger, smaller) of the two items that fill ``room`` best; (0, 0, 0) if there are none."""
        a = self.sizes[self.sizes < room]
        if not len(a):
            return 0, 0, 0
        b = self.floor[room - a]
        lone = (b == a) & (self.count[a] < 2)
        b = np.where(lone, self.floor[a - 1], b)
        total = np.where(b > 0, a + b, 0)
        k = len(total) - 1 - int(total[::-1].argmax())
        return int(total[k]), int(a[k]), int(b[k])


def best_two_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item indices; every size is at least 1 and at most ``capacity``."""
    pool, bins = _Pool(sizes, capacity), []
    while len(pool.sizes):
        members, gap = [], capacity
        while True:
            while size := int(pool.floor[gap]):
                members.append((size, pool.take(size)))
                gap -= size
            if not gap:
                break
            smallest = min(range(len(members)), key=lambda i: (members[i][0], -i))
            size = members[smallest][0]
            total, a, b = pool.best_two(gap + size)
            if total <= size:
                break
            item = members.pop(smallest)[1]
            members += [(a, pool.take(a)), (b, pool.take(b))]
            pool.give(size, item)
            gap += size - total
        bins.append([i for _, i in members])
    return bins


def _items(sizes: DataFrame, packs: dict[str, int]) -> DataFrame:
    """One row per piece of a document: whole, or cut at multiples of the capacity if longer than it.

    ``copy`` numbers rows that are repeated, so that each piece has a key of its own.
    """
    every = F.array(*[F.struct(F.lit(name).alias("pack_name"), F.lit(size).alias("capacity")) for name, size in sorted(packs.items())])
    return (
        sizes.where("n_tokens > 0").groupBy(F.col("id").alias("doc_id"), F.col("n_tokens").cast("long").alias("total")).count()
        .select("doc_id", "total", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("copy"))
        .select("doc_id", "total", "copy", F.explode(every).alias("pack"))
        .select("pack.pack_name", "pack.capacity", "doc_id", "total", "copy")
        .select("pack_name", "capacity", "doc_id", "total", "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / F.col("capacity")))).alias("part"))
        .select("pack_name", "capacity", "doc_id", "total", "copy", "part", (F.col("part") * F.col("capacity")).alias("start_token"), F.least(F.col("capacity").cast("long"), F.col("total") - F.col("part") * F.col("capacity")).alias("n_tokens"))
    )


_PACKED = "pack_name string, capacity int, doc_id bigint, total bigint, copy bigint, part bigint, start_token bigint, n_tokens bigint, pack_id string, filled bigint"
_RESULT = "pack_name string, pack_id string, doc_id bigint, part bigint, start_token bigint, n_tokens bigint, filled bigint, capacity int, fill double"


def pack(sizes: DataFrame, pack_sizes: DataFrame, settings: PackSettings | None = None) -> DataFrame:
    """``(pack_name, pack_id, doc_id, part, start_token, n_tokens, filled, capacity, fill)``: one row per member.

    ``sizes``: ``id, n_tokens``; ``pack_sizes``: ``pack_name, capacity_tokens``, a handful of rows, each of which
    packs all documents (they are fetched). A document longer than the capacity is cut into full pieces and a rest; the full pieces
    are packs of their own. Documents without tokens or with a null size are in no pack. Repeated rows are packed
    each time. Pack sizes that are null or below 1 are ignored, of a repeated name the largest counts.
    """
    s = settings or PackSettings()
    packs = pack_sizes.where("pack_name is not null and capacity_tokens > 0").groupBy("pack_name").agg(F.max("capacity_tokens").cast("int").alias("capacity"))
    packs = {r["pack_name"]: r["capacity"] for r in packs.collect()}
    if not packs:
        return sizes.sparkSession.createDataFrame([], _RESULT)
    items = checkpoint(_items(sizes, packs))
    full = items.where("n_tokens = capacity").select("*", F.concat_ws("-", F.lit("full"), "doc_id", "total", "copy", "part").alias("pack_id"), F.col("n_tokens").alias("filled"))
    rest, done = items.where("n_tokens < capacity"), [full]
    for turn in range(s.rounds):
        load = rest.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()  # a row a pack size
        if not load:
            break
        shards = {r["pack_name"]: max(1, -(-r["n"] // s.shard_items), -(-r["t"] // s.shard_tokens)) for r in load}
        last = turn == s.rounds - 1 or max(shards.values()) == 1

        def work(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["doc_id", "total", "copy", "part"], kind="stable").reset_index(drop=True)
            sizes_, bins = frame["n_tokens"].to_numpy(np.int64), np.empty(len(frame), np.int64)
            filled = np.empty(len(frame), np.int64)
            for k, members in enumerate(best_two_fit(sizes_, int(frame["capacity"].iloc[0]))):
                bins[members], filled[members] = k, sizes_[members].sum()
            name = f"{turn}-{frame['shard'].iloc[0]}-"  # noqa: B023
            return frame.drop(columns="shard").assign(pack_id=[f"{name}{k}" for k in bins], filled=filled)

        of = F.coalesce(*[F.when(F.col("pack_name") == k, F.lit(n)) for k, n in shards.items()])
        placed = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "total", "copy", "part", F.lit(turn)), of).cast("int"))
        n = int(min(4000, max(8, 2 * sum(shards.values()))))
        made = checkpoint(placed.repartition(n, "pack_name", "shard").groupBy("pack_name", "shard").applyInPandas(work, _PACKED))
        loose = (F.col("filled") < s.dense * F.col("capacity")) & F.col("pack_name").isin([k for k, v in shards.items() if v > 1 and not last])
        done.append(made.where(~loose))
        rest = made.where(loose).drop("pack_id", "filled")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("pack_name", "pack_id", "doc_id", "part", "start_token", "n_tokens", "filled", "capacity", (F.col("filled") / F.col("capacity")).alias("fill"))


def pack_summary(packed: DataFrame) -> DataFrame:
    """``(pack_name, capacity, packs, pieces, tokens, fill)`` of a packing."""
    packs = packed.groupBy("pack_name", "capacity", "pack_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
    sums = packs.groupBy("pack_name", "capacity").agg(F.count(F.lit(1)).alias("packs"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"))
    return sums.select("pack_name", "capacity", "packs", "pieces", "tokens", F.round(F.col("tokens") / F.col("packs") / F.col("capacity"), 6).alias("fill"))
