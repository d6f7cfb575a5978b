"""Interval queries over events (key event_type, seconds) and lineitem (key l_returnflag, part numbers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import stats
from lodestar.operators import ranges
from lodestar.plans.registry import query
from lodestar.session import table

SEC = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals of value * 2 seconds."""
    return table(spark, sf_dir, "events").selectExpr("event_id AS id", "event_type AS chr", f"{SEC} AS start", f"{SEC} + CAST(floor(value * 2) AS BIGINT) AS end", "value AS score", "user_id")


SPANS = "SELECT event_id AS id, event_type AS chr, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 2) AS BIGINT) AS e, value AS score, user_id FROM events"
#: with the half-open rule that an interval has one base at least
WIDE = f"SELECT id, chr, s, greatest(e, s + 1) AS e, score, user_id FROM ({SPANS})"


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as intervals of one to four minutes on the same axis, one key per priority's first digit."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS oid", "element_at(array('click','error','purchase','signup','view'), CAST(substring(o_orderpriority, 1, 1) AS INT)) AS chr", "1704067200 + (o_orderkey * 977) % 2592000 AS start_b", "1704067200 + (o_orderkey * 977) % 2592000 + 60 * (1 + o_custkey % 4) AS end_b", "o_totalprice AS price"
    )


WINDOWS = "SELECT o_orderkey AS oid, (['click','error','purchase','signup','view'])[CAST(substring(o_orderpriority, 1, 1) AS INT)] AS chr, 1704067200 + (o_orderkey * 977) % 2592000 AS s, 1704067200 + (o_orderkey * 977) % 2592000 + 60 * (1 + o_custkey % 4) AS e, o_totalprice AS price FROM orders"
HIT = "a.chr = b.chr AND a.s < b.e AND a.e > b.s"


@query("range_overlap_join", f"WITH a AS ({WIDE}), b AS ({WINDOWS}) SELECT a.id, b.oid, a.chr, least(a.e, b.e) - greatest(a.s, b.s) AS bases FROM a JOIN b ON {HIT}")
def range_overlap_join(spark, sf_dir):
    pairs = ranges.overlap_join(spans(spark, sf_dir), windows(spark, sf_dir), ["chr"], 512)
    return pairs.select("id", "oid", "chr", (F.least("end", "end_b") - F.greatest("start", "start_b")).alias("bases"))


@query("range_overlap_closed", f"WITH a AS ({SPANS}), b AS ({WINDOWS}) SELECT a.chr, count(*) AS pairs, sum(a.id) AS ids FROM a JOIN b ON a.chr = b.chr AND a.s <= b.e AND a.e >= b.s GROUP BY a.chr")
def range_overlap_closed(spark, sf_dir):
    pairs = ranges.overlap_join(spans(spark, sf_dir), windows(spark, sf_dir), ["chr"], 512, closed=True)
    return pairs.groupBy("chr").agg(F.count(F.lit(1)).alias("pairs"), F.sum("id").alias("ids"))


@query("range_left_best_score", f"WITH a AS ({WIDE}), b AS ({WINDOWS}) SELECT a.id, coalesce(max(b.price), 0) AS best FROM a LEFT JOIN b ON {HIT} GROUP BY a.id")
def range_left_best_score(spark, sf_dir):
    pairs = ranges.overlap_join(spans(spark, sf_dir), windows(spark, sf_dir), ["chr"], 512, how="left")
    return pairs.groupBy("id").agg(F.coalesce(F.max("price"), F.lit(0.0)).alias("best"))


@query("range_semi", f"WITH a AS ({WIDE}), b AS ({WINDOWS}) SELECT id, chr FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {HIT})")
def range_semi(spark, sf_dir):
    return ranges.overlap_join(spans(spark, sf_dir), windows(spark, sf_dir), ["chr"], 512, how="semi").select("id", "chr")


@query("range_anti", f"WITH a AS ({WIDE}), b AS ({WINDOWS}) SELECT id, chr FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {HIT})")
def range_anti(spark, sf_dir):
    return ranges.overlap_join(spans(spark, sf_dir), windows(spark, sf_dir), ["chr"], 512, how="anti").select("id", "chr")


@query("range_count_zero_filled", f"WITH a AS ({WIDE}), b AS ({WINDOWS}) SELECT b.oid, count(a.id) AS n, coalesce(round(sum(a.score), 4), 0) AS weight FROM b LEFT JOIN a ON {HIT} GROUP BY b.oid")
def range_count_zero_filled(spark, sf_dir):
    a, b = spans(spark, sf_dir), windows(spark, sf_dir)
    swapped = ranges.overlap_join(b.withColumnsRenamed({"start_b": "start", "end_b": "end"}), a.withColumnsRenamed({"start": "start_b", "end": "end_b"}), ["chr"], 512, how="left")
    return swapped.groupBy("oid").agg(F.count("id").alias("n"), F.coalesce(F.round(F.sum("score"), 4), F.lit(0.0)).alias("weight"))


@query("range_keyed_overlap", f"WITH a AS ({WIDE}) SELECT a.id, b.id AS other FROM a JOIN a b ON a.chr = b.chr AND a.user_id = b.user_id AND a.s < b.e AND a.e > b.s AND a.id < b.id")
def range_keyed_overlap(spark, sf_dir):
    a = spans(spark, sf_dir).select("id", "chr", "user_id", "start", "end")
    b = a.toDF("other", "chr", "user_id", "start_b", "end_b")
    return ranges.overlap_join(a, b, ["chr", "user_id"], 1024).where("id < other").select("id", "other")


@query("range_point_lookup", f"WITH b AS ({WINDOWS}) SELECT a.event_id AS id, count(*) AS n, max(b.price) AS price FROM events a JOIN b ON a.event_type = b.chr AND CAST(floor(epoch(a.ts)) AS BIGINT) >= b.s AND CAST(floor(epoch(a.ts)) AS BIGINT) < b.e GROUP BY a.event_id")
def range_point_lookup(spark, sf_dir):
    points = spans(spark, sf_dir).select("id", "chr", "start", (F.col("start") + 1).alias("end"))
    return ranges.overlap_join(points, windows(spark, sf_dir), ["chr"], 512).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("price"))


@query("range_prefix_sum_count", f"WITH a AS ({WIDE}) SELECT a.id, (SELECT count(*) FROM a t WHERE t.chr = a.chr AND t.s < a.e) - (SELECT count(*) FROM a t WHERE t.chr = a.chr AND t.e <= a.s) AS n_overlaps FROM a")
def range_prefix_sum_count(spark, sf_dir):
    a = ranges.normalised(spans(spark, sf_dir))
    return ranges.count_overlaps(a, a, ["chr"]).select("id", "n_overlaps")


ISLANDS = "SELECT *, sum(CASE WHEN p IS NULL OR s - p > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, max(e) OVER (PARTITION BY {key} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ({rows}))"


@query("interval_merge_bookended", f"SELECT chr, min(s) AS \"start\", max(e) AS \"end\", max(score) AS top, count(*) AS n FROM ({ISLANDS.format(gap=0, key='chr', rows=WIDE)}) GROUP BY chr, g")
def interval_merge_bookended(spark, sf_dir):
    return ranges.merge_intervals(ranges.normalised(spans(spark, sf_dir)), ["chr"], aggs={"top": F.max("score"), "n": F.count(F.lit(1))})


@query("interval_covered_bases", f"SELECT chr, CAST(sum(e - s) AS BIGINT) AS covered FROM (SELECT chr, g, min(s) AS s, max(e) AS e FROM ({ISLANDS.format(gap=0, key='chr', rows=WIDE)}) GROUP BY chr, g) GROUP BY chr")
def interval_covered_bases(spark, sf_dir):
    return ranges.covered_bases(ranges.normalised(spans(spark, sf_dir)), ["chr"])


@query("interval_stitch_gap", f"SELECT user_id, min(s) AS \"start\", max(e) AS \"end\", round(sum(score), 4) AS score_sum, count(*) AS n_peaks FROM ({ISLANDS.format(gap=12500, key='user_id', rows=WIDE)}) GROUP BY user_id, g")
def interval_stitch_gap(spark, sf_dir):
    return ranges.merge_intervals(ranges.normalised(spans(spark, sf_dir)), ["user_id"], 12500, {"score_sum": F.round(F.sum("score"), 4), "n_peaks": F.count(F.lit(1))})


@query("nearest_interval", f"WITH b AS ({WINDOWS}), a AS (SELECT event_id AS id, event_type AS chr, CAST(floor(epoch(ts)) AS BIGINT) AS p FROM events) SELECT a.id, min(CASE WHEN b.s <= a.p AND b.e > a.p THEN 0 WHEN b.e <= a.p THEN a.p - b.e ELSE b.s - a.p - 1 END) AS distance FROM a LEFT JOIN b ON a.chr = b.chr GROUP BY a.id")
def nearest_interval(spark, sf_dir):
    points = spans(spark, sf_dir).select("id", "chr", F.col("start").alias("pos"))
    b = windows(spark, sf_dir).select("chr", F.col("start_b").alias("start"), F.col("end_b").alias("end"))
    return ranges.nearest(points, b, ["chr"]).select("id", "distance")


@query("distance_bins", "WITH d AS (SELECT o_custkey % 50 AS tissue, o_orderkey, abs(o_custkey * 37 - o_orderkey) AS d FROM orders) SELECT g AS distance_group, count(DISTINCT tissue) AS tissues, count(*) AS n FROM (SELECT *, CASE WHEN d > 0 AND d <= 1000 THEN 1000 WHEN d > 1000 AND d <= 5000 THEN 5000 WHEN d > 5000 AND d <= 20000 THEN 20000 ELSE 0 END AS g FROM d) GROUP BY g")
def distance_bins(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("tissue"), F.abs(F.col("o_custkey") * 37 - F.col("o_orderkey")).alias("d"))
    return d.groupBy(ranges.distance_group(F.col("d"), [1000, 5000, 20000]).alias("distance_group")).agg(F.count_distinct("tissue").alias("tissues"), F.count(F.lit(1)).alias("n"))


PAIRS = "SELECT p.p_partkey, s.s_suppkey, p.p_size, abs(p.p_partkey * 50 - s.s_suppkey * 900) AS d FROM part p JOIN supplier s ON p.p_size % 5 = s.s_nationkey % 5 WHERE abs(p.p_partkey * 50 - s.s_suppkey * 900) < 20000"


@query("window_pairs_powerlaw_score", f"SELECT p_partkey, s_suppkey, round(w / sum(w) OVER (PARTITION BY p_partkey), 6) AS score FROM (SELECT *, sqrt(p_size) * exp(5.9594510043736655e0 - 1.024238616787792e0 * ln(greatest(d, 5000) + 1)) AS w FROM ({PAIRS}))")
def window_pairs_powerlaw_score(spark, sf_dir):
    a = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_size") % 5).alias("chr"), (F.col("p_partkey") * 50).alias("pos"))
    b = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("chr"), (F.col("s_suppkey") * 900).alias("pos_b"))
    pairs = ranges.distance_pairs(a, b, ["chr"], 20000)
    w = pairs.withColumn("w", F.sqrt("p_size") * stats.powerlaw_contact(F.abs(F.col("pos") - F.col("pos_b"))))
    from pyspark.sql import Window

    return w.select("p_partkey", "s_suppkey", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("p_partkey")), 6).alias("score"))


FLAGSHIP = f"""
WITH v AS (SELECT id, chr, s, s + 1 AS e, user_id % 20 AS tissue FROM ({SPANS}) WHERE score > 40),
hit AS (SELECT DISTINCT v.id, v.chr, v.s, v.tissue, b.category FROM v JOIN (SELECT chr, s, e, oid % 3 AS category FROM ({WINDOWS})) b ON v.chr = b.chr AND v.s < b.e AND v.e > b.s),
tss AS (SELECT chr, avg((s + e) / 2) AS centre FROM ({WINDOWS}) GROUP BY chr),
d AS (SELECT hit.*, abs(tss.centre - hit.s) AS distance FROM hit JOIN tss ON hit.chr = tss.chr WHERE category <> 2)
SELECT tissue, CASE WHEN distance > 0 AND distance <= 86400 THEN 86400 WHEN distance > 86400 AND distance <= 604800 THEN 604800 WHEN distance > 604800 AND distance <= 1209600 THEN 1209600 ELSE 0 END AS distance_group, count(DISTINCT id) AS variants FROM d GROUP BY 1, 2
"""


@query("flagship_prepare_variants", FLAGSHIP)
def flagship_prepare_variants(spark, sf_dir):
    """Filter by score, overlap with a partition, mean centre lookup, right-closed distance bins, distinct counts."""
    v = spans(spark, sf_dir).where("score > 40").select("id", "chr", "start", (F.col("start") + 1).alias("end"), (F.col("user_id") % 20).alias("tissue"))
    w = windows(spark, sf_dir).withColumn("category", F.col("oid") % 3)
    hit = ranges.overlap_join(v, w.where("category <> 2"), ["chr"], 512).select("id", "chr", "start", "tissue", "category").distinct()
    tss = w.groupBy("chr").agg(F.avg((F.col("start_b") + F.col("end_b")) / 2).alias("centre"))
    d = hit.join(tss, "chr").withColumn("distance", F.abs(F.col("centre") - F.col("start")))
    return d.groupBy("tissue", ranges.distance_group(F.col("distance"), [86400, 604800, 1209600]).alias("distance_group")).agg(F.count_distinct("id").alias("variants"))
