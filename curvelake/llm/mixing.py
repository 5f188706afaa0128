"""Mixing sources to target weights (problem 7): Efraimidis-Spirakis sampling to token budgets.

Every source with a target and documents gets a share of a total that is as large as the repeats allow.
Its complete epochs come first: every document as often as whole copies of the source fit its budget. The
rest is a weighted sample without replacement: documents in the order of exponential keys divided by their
quality weights, taken while their prefix sum of tokens stays within what remains.

The order is not made by sorting a source in one task: keys are cut into buckets by their own
distribution, bucket sums give each bucket its offset, and a bucket is sorted by itself. After a document
too long for what is left of a budget, those that still fit are taken in the order of their keys until none
does: of every length only the first few can be among them, so that this rest is small.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelake.session import checkpoint, small


@dataclass(frozen=True)
class MixSettings:
    seed: int = 17
    #: buckets of a source, by the distribution function of its keys: this many, or more where they would
    #: hold more documents than ``bucket_documents``
    buckets: int = 256
    bucket_documents: int = 20_000
    least_quality: float = 0.1
    most_quality: float = 10.0
    #: total tokens wanted; None for as many as the repeats allow
    total_tokens: int | None = None


def source_name(c: Column) -> Column:
    """Names that differ in letter case or in blanks at either end are one source."""
    return F.lower(F.trim(c))


def text_quality(text: Column) -> Column:
    """Share of letters and digits in the text, between 0 and 1; a plain measure of clean prose."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return F.coalesce(F.try_divide(kept.cast("double"), F.length(text)), F.lit(0.0))


def quality_weight(prose: Column, n_tokens: Column, different: Column, pairs: Column) -> Column:
    """Weight of a document between 0 and 1, from its whole text.

    The product of ``prose``, the share of letters and digits; of how rarely the text repeats itself, by the
    logarithms of its different tokens and different pairs of neighbouring tokens against all of them
    (1 if none comes twice, whatever the length); and of its length, which counts half at 16 tokens.
    """
    n = F.greatest(n_tokens, F.lit(2)).cast("double")
    fresh = lambda x: F.least(F.lit(1.0), F.ln(1 + x.cast("double")) / F.ln(1 + n))
    return F.coalesce(prose * fresh(different) * fresh(pairs + 1) * n_tokens / (n_tokens + 16.0), F.lit(0.0))


def mix_plan(sized: DataFrame, targets: DataFrame, settings: MixSettings | None = None) -> DataFrame:
    """``(source, documents, tokens, target_weight, target_share, max_repeats, budget, epochs, rest)``: a row a source.

    Only sources with a positive target weight, a ``max_repeats`` of at least 1 and some tokens share the total;
    the shares of the others go to these in proportion. Of a repeated target the one with the greatest weight counts.
    """
    s = settings or MixSettings()
    wanted = (
        targets.select(source_name(F.col("source")).alias("source"), F.struct("target_weight", "max_repeats").alias("w")).where("source is not null and w.target_weight > 0 and w.max_repeats >= 1")
        .groupBy("source").agg(F.max("w").alias("w")).select("source", "w.target_weight", "w.max_repeats")
    )
    have = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens")).where("source is not null and tokens > 0")
    both = have.join(wanted, "source")
    every = Window.partitionBy()
    share = F.col("target_weight") / F.sum("target_weight").over(every)
    most = F.min(F.col("tokens") * F.col("max_repeats") / share).over(every)
    total = most if s.total_tokens is None else F.least(most, F.lit(float(s.total_tokens)))
    return (
        both.withColumn("target_share", share).withColumn("budget", F.floor(total * F.col("target_share") + 1e-6))
        .withColumn("epochs", F.least(F.floor(F.col("budget") / F.col("tokens")), F.col("max_repeats").cast("long")))
        .withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(F.lit(0).cast("long")))
    )


def _within_rest(rows: DataFrame) -> DataFrame:
    """``rows`` with ``taken``: whether the prefix sum of tokens, in the order of keys, stays within the source's ``rest``."""
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("source", "bucket", before.alias("before"))  # a row a bucket of the source in a task
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.join(offsets, ["source", "bucket"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside))
    return summed.withColumn("taken", F.col("upto") <= F.col("rest")).drop("before", "upto")


def _fill(open_rows: DataFrame) -> DataFrame:
    """``(id, source)``: what is taken from ``open_rows`` in the order of keys, each document that still fits ``rest``.

    At most rest / n documents of n tokens fit, so only the first ones of each length are looked at: buckets
    beyond those are left out by their counts, and a source has at most rest * ln(rest) such documents, with a
    rest shorter than its longest document.
    """
    counts = open_rows.groupBy("source", "n_tokens", "bucket").agg(F.count(F.lit(1)).alias("c"))
    by = Window.partitionBy("source", "n_tokens")
    before = F.coalesce(F.sum("c").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.withColumn("before", before)
    near = open_rows.join(first.drop("c"), ["source", "n_tokens", "bucket"]).where("before * n_tokens < rest")
    near = near.withColumn("turn", F.row_number().over(Window.partitionBy("source", "n_tokens", "bucket").orderBy("key", "id")) + F.col("before")).where("turn * n_tokens <= rest")

    def take(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "id"], kind="stable")
        rest, got = int(frame["rest"].iloc[0]), []
        for i, n in zip(frame["id"], frame["n_tokens"]):
            if n <= rest:
                rest -= n
                got.append(i)
        return pd.DataFrame({"id": pd.Series(got, dtype="int64"), "source": frame["source"].iloc[0]})

    return near.select("source", "id", "key", "n_tokens", "rest").groupBy("source").applyInPandas(take, "id bigint, source string")


def mix(sized: DataFrame, targets: DataFrame, settings: MixSettings | None = None) -> tuple[DataFrame, DataFrame]:
    """``(chosen, report)`` from ``sized (id, source, quality, n_tokens)``.

    ``chosen``: ``doc_id, source, repeats, n_tokens``, one row per document that is used at least once; no document
    is used more than ``max_repeats`` times. ``report``: one row per source that has documents or a target, with
    ``documents, tokens, target_weight, target_share, max_repeats, epochs, budget, chosen_tokens, actual_share``;
    shares are null where a source takes no part. Documents of null sources are reported under a null source.
    Documents without tokens are never chosen. Of an id repeated in ``sized`` the row
    sorted first counts.
    """
    s = settings or MixSettings()
    sized = checkpoint(sized.select("id", source_name(F.col("source")).alias("source"), F.coalesce(F.col("quality"), F.lit(0.0)).alias("quality"), "n_tokens").groupBy("id").agg(F.min(F.struct("source", "quality", "n_tokens")).alias("r")).select("id", "r.*"))
    plan = checkpoint(mix_plan(sized, targets, s))
    spread = (F.xxhash64("id", F.lit(s.seed)).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    unit = F.greatest(F.lit(1e-18), F.least(F.lit(1.0), spread))
    weight = F.least(F.lit(s.most_quality), F.greatest(F.lit(s.least_quality), F.col("quality")))
    rows = sized.where("n_tokens > 0").withColumn("weight", weight).withColumn("key", -F.ln(unit) / F.col("weight"))
    mean = rows.groupBy("source").agg(F.avg("weight").alias("typical"), F.greatest(F.lit(s.buckets), F.ceil(F.count(F.lit(1)) / s.bucket_documents)).alias("buckets"))
    shares = small(checkpoint(plan.select("source", "epochs", "rest").join(mean, "source")))
    rows = rows.join(shares, "source").withColumn("bucket", F.floor(F.col("buckets") * (1 - F.exp(-F.col("key") * F.col("typical")))))
    part = checkpoint(_within_rest(rows.select("source", "id", "key", "bucket", "n_tokens", "rest")))
    left = checkpoint(part.groupBy("source").agg((F.max("rest") - F.sum(F.when(F.col("taken"), F.col("n_tokens")).otherwise(0))).alias("rest")).where("rest > 0"))
    extra = part.where("taken").select("id", "source")
    extra = extra.unionByName(_fill(part.where("not taken").drop("rest", "taken").join(small(left), "source").where("n_tokens <= rest")))
    extra = extra.groupBy("id", "source").agg(F.count(F.lit(1)).alias("more"))
    whole = sized.where("n_tokens > 0").join(small(plan.where("epochs > 0").select("source", "epochs")), "source").select("id", "source", "n_tokens", "epochs")
    once = part.select("id", "source", "n_tokens", F.lit(0).cast("long").alias("epochs"))
    every = whole.unionByName(once.join(small(plan.where("epochs = 0").select("source")), "source", "left_semi"))
    chosen = checkpoint(
        every.join(extra, ["id", "source"], "left").withColumn("repeats", F.col("epochs") + F.coalesce("more", F.lit(0)))
        .where("repeats > 0").select(F.col("id").alias("doc_id"), "source", "repeats", "n_tokens")
    )
    got = chosen.groupBy("source").agg(F.sum(F.col("repeats") * F.col("n_tokens")).alias("chosen_tokens"))
    have = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"))
    asked = targets.select(source_name(F.col("source")).alias("source"), F.struct("target_weight", "max_repeats").alias("w")).groupBy("source").agg(F.max("w").alias("w")).select("source", "w.target_weight", "w.max_repeats")
    one = asked.select(F.col("source").alias("s1"), "target_weight", "max_repeats")
    report = (
        have.join(one, have["source"].eqNullSafe(one["s1"]), "full_outer").withColumn("source", F.coalesce("source", "s1")).drop("s1")
        .join(plan.select("source", "target_share", "epochs", "budget"), "source", "left").join(got, "source", "left")
        .select(
            "source", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "target_weight", "target_share", "max_repeats", "epochs", "budget",
            F.coalesce("chosen_tokens", F.lit(0)).alias("chosen_tokens"),
            F.when(F.col("target_share").isNotNull(), F.try_divide(F.coalesce("chosen_tokens", F.lit(0)).cast("double"), F.sum("chosen_tokens").over(Window.partitionBy()))).alias("actual_share"),
        )
    )
    return chosen, report
