import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvelake.llm.mixing import MixSettings, mix, quality_weight, text_quality
from curvelake.llm.packing import PackSettings, best_two_fit, pack, pack_summary
from curvelake.llm.tokens import TOKENIZER, with_token_counts

PACKS = "pack_name string, capacity_tokens int, shard string"
SIZES = "id bigint, n_tokens bigint, capacity string, part string"


def check_packing(rows, capacity, sizes):
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault(r["pack_id"], []).append(r)
        pieces.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
    for members in bins.values():
        total = sum(r["n_tokens"] for r in members)
        assert total <= capacity and all(r["filled"] == total for r in members)
    for doc, n in sizes.items():
        at = 0
        for start, size in sorted(pieces.get(doc, [])):
            assert start == at
            at += size
        assert at == n and (n <= 0 or len(pieces[doc]) == -(-n // capacity))
    return bins


def test_best_two_fit_beats_greedy():
    assert sorted(map(len, best_two_fit(np.array([6, 3, 2, 5, 4]), 10))) == [2, 3] or len(best_two_fit(np.array([6, 3, 2, 5, 4]), 10)) == 2
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 120, 3000)
    bins = best_two_fit(sizes, 256)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert all(sizes[b].sum() <= 256 for b in bins)
    assert sizes.sum() / (256 * len(bins)) > 0.99


def test_every_document_is_packed_once(spark):
    rng = np.random.default_rng(1)
    sizes = {i: int(n) for i, n in enumerate(rng.integers(0, 400, 900))}
    sizes[900], sizes[901], sizes[902] = 100, 200, 5000
    df = spark.createDataFrame([(i, n, "x", "x") for i, n in sizes.items()] + [(None, 0, "x", "x")], SIZES)
    packs = spark.createDataFrame([("a", 100, "x"), ("b", 256, "x"), ("bad", 0, "x"), (None, 5, "x")], PACKS)
    got = pack(df, packs, PackSettings(shard_items=300)).cache()
    assert {r[0] for r in got.select("pack_name").distinct().collect()} == {"a", "b"}
    for name, capacity in (("a", 100), ("b", 256)):
        bins = check_packing(got.where(F.col("pack_name") == name).collect(), capacity, sizes)
        assert sum(sizes.values()) / (capacity * len(bins)) > 0.97
    told = {r["pack_name"]: r for r in pack_summary(got).collect()}
    assert told["a"]["tokens"] == sum(sizes.values())


def test_packing_of_nothing(spark):
    packs = spark.createDataFrame([("a", 100, "x")], PACKS)
    assert pack(spark.createDataFrame([], SIZES), packs).count() == 0
    assert pack(spark.createDataFrame([(1, 5, "x", "x")], SIZES), packs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="the public tokenizer's file is not here")
def test_token_counts_cover_whole_texts(spark):
    texts = [(1, "hello world"), (2, ""), (3, None), (4, "word " * 50_000), (None, "x"), (5, "<|endoftext|>")]
    got = {r["id"]: r["n_tokens"] for r in with_token_counts(spark.createDataFrame(texts, "id bigint, text string"), "id", "text").collect()}
    assert got[1] == 2 and got[2] == 0 and 3 not in got and got[4] >= 50_000 and None not in got and got[5] > 1


TARGETS = "source string, target_weight double, max_repeats int, tokens string"


@pytest.fixture(scope="module")
def sized(spark):
    rng = np.random.default_rng(2)
    rows = [(i, s, float(rng.uniform(0.5, 1)), int(rng.integers(5, 60))) for i, s in enumerate(["big"] * 2000 + ["BIG "] * 500 + ["small"] * 200 + ["tiny"] * 30 + ["other"] * 50)]
    return spark.createDataFrame(rows + [(9000, None, 1.0, 10), (9001, "small", None, 0)], "id bigint, source string, quality double, n_tokens bigint").repartition(5)


def test_shares_meet_targets_within_repeats(spark, sized):
    targets = spark.createDataFrame([("big", 50.0, 1, "x"), ("small", 30.0, 4, "x"), ("tiny", 5.0, 6, "x"), ("absent", 10.0, 2, "x"), ("big", 50.0, 1, "x")], TARGETS)
    chosen, report = mix(sized, targets)
    rows = {r["source"]: r for r in report.collect()}
    assert set(rows) == {"big", "small", "tiny", "absent", "other", None}
    for name in ("big", "small", "tiny"):
        r = rows[name]
        assert abs(r["actual_share"] - r["target_share"]) < 0.002 and r["chosen_tokens"] <= r["budget"]
    assert rows["other"]["chosen_tokens"] == 0 and rows["absent"]["documents"] == 0 and rows["absent"]["actual_share"] is None
    got = chosen.collect()
    limits = {"big": 1, "small": 4, "tiny": 6}
    assert all(1 <= r["repeats"] <= limits[r["source"]] for r in got) and len({r["doc_id"] for r in got}) == len(got)
    repeats = {s: {r["repeats"] for r in got if r["source"] == s} for s in limits}
    assert all(max(v) - min(v) <= 1 for v in repeats.values())  # complete epochs come first
    again = {(r["doc_id"], r["repeats"]) for r in mix(sized.repartition(3), targets)[0].collect()}
    assert again == {(r["doc_id"], r["repeats"]) for r in got}


def test_better_documents_are_chosen_more_often(spark):
    rows = [(i, "a", 0.1 if i % 2 else 1.0, 10) for i in range(4000)] + [(10_000 + i, "b", 1.0, 10) for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, source string, quality double, n_tokens bigint")
    targets = spark.createDataFrame([("a", 10.0, 1, "x"), ("b", 1.0, 1, "x")], TARGETS)
    got = [r["doc_id"] for r in mix(df, targets, MixSettings(buckets=16))[0].where("source = 'a'").collect()]
    assert len(got) == 1000 and np.mean([i % 2 == 0 for i in got]) > 0.8


def test_mixing_of_nothing(spark):
    none = spark.createDataFrame([], "id bigint, source string, quality double, n_tokens bigint")
    targets = spark.createDataFrame([("a", 10.0, 1, "x")], TARGETS)
    chosen, report = mix(none, targets)
    assert chosen.count() == 0 and report.first()["chosen_tokens"] == 0
    chosen, report = mix(none, targets.limit(0))
    assert chosen.count() == 0 and report.count() == 0


def test_quality_of_texts(spark):
    got = [r[0] for r in spark.createDataFrame([("ab1",), ("a!",), ("",), (None,)], "text string").select(text_quality(F.col("text"))).collect()]
    assert got == [1.0, 0.5, 0.0, 0.0]


def test_weights_fall_with_repetition_and_grow_with_length(spark):
    rows = [(1, "the quick brown fox jumps over the lazy dog while seven wizards watch from a tower"), (2, "buy now buy now buy now buy now buy now buy now buy now buy now"), (3, "ok"), (4, "!!! ### $$$ %%% &&& *** ((( ))) ___ +++ === --- ;;; :::"), (5, ""), (6, "ok")]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("prose", text_quality(F.col("text")))
    sized = with_token_counts(df, "id", "text", ["prose"], variety=True)
    got = {r["id"]: r["w"] for r in sized.select("id", quality_weight(*[F.col(c) for c in ("prose", "n_tokens", "different", "pairs")]).alias("w")).collect()}
    assert got[1] > 2 * got[2] and got[1] > 5 * got[3] and got[4] == 0 and got[5] == 0 and got[3] == got[6] > 0 and max(got.values()) < 1


def test_budgets_are_filled_until_nothing_fits(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "a", float(rng.uniform(0.2, 1)), int(rng.choice([3, 5, 7, 50, 400]))) for i in range(3000)] + [(9000 + i, "b", 1.0, 7) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, source string, quality double, n_tokens bigint")
    targets = spark.createDataFrame([("a", 40.0, 2, "x"), ("b", 1.0, 3, "x")], TARGETS)
    for buckets in (1, 64, 4096):
        chosen, report = mix(df, targets, MixSettings(buckets=buckets))
        got = {r["doc_id"]: r["repeats"] for r in chosen.collect()}
        if buckets == 1:
            first = got
        assert got == first
        a = {r["source"]: r for r in report.collect()}["a"]
        open_sizes = [n for i, s, _, n in rows if s == "a" and got.get(i, 0) <= a["epochs"]]
        assert 0 <= a["budget"] - a["chosen_tokens"] < min(open_sizes)
