"""Queries of the subpackage's problems over the data folder's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelake.llm.density_peaks import density_clusters, describe_clusters
from curvelake.llm.digests import CURVE_KEYS, certified_curves, curve_digests, curves_of, estimates, grid_points, merge_digests
from curvelake.llm.knn import k_nearest
from curvelake.llm.mixing import mix, quality_weight, source_name, text_quality
from curvelake.llm.packing import pack, pack_summary
from curvelake.llm.tokens import with_token_counts
from curvelake.llm.visual import distinct_forms, look_same_pairs
from curvelake.session import checkpoint, table


def _percentiles(spark: SparkSession, d: str, by_part: bool) -> DataFrame:
    meta = grid_points(table(spark, d, "grid_meta"))
    curves = curves_of(*[table(spark, d, t) for t in ("station_days", "spectra", "sources")], meta)
    digests = curve_digests(curves, meta, by_part)
    if by_part:  # a digest a group and date, kept; those of the whole are made of them
        digests = merge_digests(digests, [*CURVE_KEYS, "date"]).drop("date")
    return certified_curves(curves, meta, estimates(merge_digests(digests, CURVE_KEYS), CURVE_KEYS))


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _percentiles(spark, d, False)


def p2_dates(spark: SparkSession, d: str) -> DataFrame:
    return _percentiles(spark, d, True)


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """How many values each group has, and whether all of its percentiles are within half a percent of their ranks."""
    found = p2_percentiles(spark, d)
    return found.groupBy("dataset", "grouping", "key").agg(F.max("n").alias("n"), (F.max("rank_error") <= 0.005).alias("within"))


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text").withColumn("prose", text_quality(F.col("text")))
    sized = with_token_counts(docs, "doc_id", "text", ["source", "prose"], variety=True)
    return sized.select("id", "source", quality_weight(*[F.col(c) for c in ("prose", "n_tokens", "different", "pairs")]).alias("quality"), "n_tokens")


def p6_packs(spark: SparkSession, d: str) -> DataFrame:
    return pack(with_token_counts(table(spark, d, "documents"), "doc_id", "text"), table(spark, d, "pack_sizes"))


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    return pack_summary(p6_packs(spark, d))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """Of each pack size: the documents packed, and whether all tokens of each are, no pack is over its capacity and only longer documents are cut."""
    sizes = checkpoint(with_token_counts(table(spark, d, "documents"), "doc_id", "text"))
    packed = checkpoint(pack(sizes, table(spark, d, "pack_sizes")))
    each = packed.groupBy("pack_name", "capacity", "doc_id").agg(F.sum("n_tokens").alias("packed"), F.count(F.lit(1)).alias("parts")).join(sizes.select(F.col("id").alias("doc_id"), "n_tokens"), "doc_id")
    docs = each.groupBy("pack_name", "capacity").agg(
        F.count(F.lit(1)).alias("documents"), F.bool_and(F.col("packed") == F.col("n_tokens")).alias("whole"), F.bool_and((F.col("parts") == 1) | (F.col("n_tokens") > F.col("capacity"))).alias("cut_if_longer"))
    packs = packed.groupBy("pack_name", "pack_id").agg(F.sum("n_tokens").alias("t"), F.max("capacity").alias("c"), F.max("filled").alias("f"))
    fits = packs.groupBy("pack_name").agg(F.bool_and((F.col("t") <= F.col("c")) & (F.col("t") == F.col("f"))).alias("fits"))
    return docs.join(fits, "pack_name")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(_weighted(spark, d), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(_weighted(spark, d), table(spark, d, "mix_targets"))[1]


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """Of each source in the mix: its target share, and whether its tokens stay within the budget, short of it by less than one document's tokens."""
    sized, targets = checkpoint(_weighted(spark, d)), table(spark, d, "mix_targets")
    chosen, report = mix(sized, targets)
    most = sized.groupBy(source_name(F.col("source")).alias("source")).agg(F.max("n_tokens").alias("longest"))
    repeats = chosen.groupBy("source").agg(F.max("repeats").alias("repeats"))
    both = report.where("target_share is not null").join(most, "source").join(repeats, "source", "left")
    return both.select(
        "source", "documents", F.round("target_share", 9).alias("target_share"), (F.coalesce("repeats", F.lit(0)) <= F.col("max_repeats")).alias("repeats_within"),
        (F.col("chosen_tokens") <= F.col("budget")).alias("within"), (F.col("budget") - F.col("chosen_tokens") <= F.col("longest")).alias("filled"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return density_clusters(table(spark, d, "spectra")).select("cluster_id", "id")


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    return describe_clusters(density_clusters(table(spark, d, "spectra")))


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return k_nearest(table(spark, d, "spectra")).withColumn("distance", F.round("distance", 6))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_neighbours(spark, d).select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return look_same_pairs(table(spark, d, "documents"))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    forms = distinct_forms(table(spark, d, "documents"))
    return docs.join(forms, ["k1", "k2"]).select("doc_id", "form")


QUERIES = {
    "p2_percentiles": p2_percentiles, "p2_dates": p2_dates, "p2_groups": p2_groups, "p6_check": p6_check, "p7_check": p7_check, "p6_packs": p6_packs, "p6_summary": p6_summary, "p7_mix": p7_mix, "p7_shares": p7_shares,
    "p3_found": p3_found, "p3_clusters": p3_clusters, "p5_found": p5_found, "p5_neighbours": p5_neighbours, "p8_found": p8_found, "p8_forms": p8_forms}
_NEAREST = """
        with x as (select id, any_value(data_matrix) as v from spectra where len(data_matrix) = 100 and len(list_filter(data_matrix, lambda c: c is not null and isfinite(c))) = 100 group by id),
        d as (select a.id as q, b.id as n, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as s from x a join x b on a.id <> b.id),
        k as (select q, n, s, row_number() over (partition by q order by s, n) as r from d)
"""
_SETS = """
        with recursive x as (select id, list_transform(data_matrix, lambda c: case when c is not null and isfinite(c) then c end) as v from spectra where id is not null and len(data_matrix) = 100),
        y as (select id, v, len(list_filter(v, lambda c: c is not null)) as n from x),
        pairs as (select a.id as a, b.id as b, a.n as m, b.n as n, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 100.0 / len(list_filter(list_zip(a.v, b.v), lambda z: z[1] is not null and z[2] is not null)) as s
            from y a join y b on a.id <> b.id where a.n > 0 and b.n > 0),
        near as (select a, sqrt(min(s)) as d from pairs where m = 100 and n = 100 and s > 0 group by a),
        steps as (select d, lead(d) over (order by d) as further, row_number() over (order by d) * 1.0 / count(*) over () as below from near),
        link as (select arg_max(sqrt(d * further), further / d) as r from steps where below > 0.001),
        edges as (select a, b from pairs, link where s <= r * r),
        reach as (select id as a, id as b from y where n > 0 union select reach.a, edges.b from reach join edges on edges.a = reach.b),
        sets as (select a as id, min(b) as cluster_id, count(*) as size from reach group by a)
        select cluster_id, id from sets where size >= 5
"""
_TALLY = """
        with k as (select source_id, max(coordinate) as coordinate from sources group by 1),
        names as (select dataset, coordinate_names[1] as name, grid_points as g from grid_meta),
        c as (select 'station_days' as dataset, coordinate, cast(station_id as varchar) as station, generate_subscripts(data_matrix, 1) as pos, unnest(data_matrix) as v from station_days left join k using (source_id)
            union all select 'spectra', (select name from names where dataset = 'spectra'), null, generate_subscripts(data_matrix, 1), unnest(data_matrix) from spectra),
        f as (select c.dataset, coordinate, station, cast(g[pos] as varchar) as point from c join names using (dataset) where v is not null and isfinite(v))
        select dataset, 'coordinate' as grouping, coordinate as key, count(*) as n, true as within from f group by 1, 2, 3
        union all select dataset, 'station', station, count(*), true from f where station is not null group by 1, 2, 3
        union all select dataset, 'grid_point', point, count(*), true from f where point is not null group by 1, 2, 3
        union all select dataset, 'occupied', 'all', count(*), true from f where point is not null group by 1, 2, 3
"""
ORACLE = {
    "p2_groups": _TALLY,
    "p3_found": _SETS,
    "p5_found": _NEAREST + "select distinct least(q, n) as id_a, greatest(q, n) as id_b from k where r <= 10",
    "p5_neighbours": _NEAREST + "select q as id, r - 1 as rank, n as neighbour, round(sqrt(s), 6) as distance from k where r <= 10",
    "p6_check": "select pack_name, max(capacity_tokens) as capacity, (select count(distinct doc_id) from documents where doc_id is not null and text <> '') as documents, true as whole, true as cut_if_longer, true as fits from pack_sizes where pack_name is not null and capacity_tokens > 0 group by 1",
    "p7_check": """
        with have as (select lower(trim(source)) as source, count(distinct doc_id) as documents from documents where source is not null and text is not null group by 1),
        t as (select lower(trim(source)) as source, max(target_weight) as w from mix_targets where target_weight > 0 and max_repeats >= 1 group by 1)
        select source, documents, round(w / sum(w) over (), 9) as target_share, true as repeats_within, true as within, true as filled from have join t using (source)
    """,
}
