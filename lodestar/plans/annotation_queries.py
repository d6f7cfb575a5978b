"""Annotation, notation parsing, evidence fusion and method-comparison queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import stats
from lodestar.operators import ordered, ranges
from lodestar.plans.portable import portable, translated
from lodestar.plans.range_queries import HIT, WIDE, WINDOWS, spans, windows
from lodestar.plans.registry import query
from lodestar.session import place, table


@query("annotate_regions", f"""
WITH b AS ({WINDOWS}), a AS ({WIDE}), c AS (SELECT a.id, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e, b.oid FROM a JOIN b ON {HIT}),
p AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
u AS (SELECT id, CAST(sum(greatest(0, e - greatest(s, coalesce(reach, s)))) AS BIGINT) AS covered, count(*) AS hits, min(oid) AS first_hit FROM p GROUP BY id)
SELECT a.id, coalesce(hits, 0) AS hits, coalesce(covered, 0) AS covered, round(coalesce(covered, 0) / (a.e - a.s), 4) AS fraction, first_hit FROM a LEFT JOIN u ON a.id = u.id""")
def annotate_regions(spark, sf_dir):
    """Overlaps of each region, and the bases and share of it that their union covers."""
    a = ranges.normalised(spans(spark, sf_dir)).select("id", "chr", "start", "end")
    c = ranges.overlap_join(a, windows(spark, sf_dir), ["chr"], 512)
    c = c.select("id", F.greatest("start", "start_b").alias("start"), F.least("end", "end_b").alias("end"), "oid")
    w = Window.partitionBy("id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(w), F.col("start"))))
    u = c.withColumn("fresh", fresh).groupBy("id").agg(F.sum("fresh").alias("covered"), F.count(F.lit(1)).alias("hits"), F.min("oid").alias("first_hit"))
    out = a.join(u, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("id", zero("hits").alias("hits"), zero("covered").alias("covered"), F.round(zero("covered") / (F.col("end") - F.col("start")), 4).alias("fraction"), "first_hit")


@query("collapse_to_intervals", f"WITH a AS ({WIDE}), b AS ({WINDOWS}) SELECT b.oid, count(*) AS n, string_agg(CAST(a.id AS VARCHAR), ',' ORDER BY a.s, a.id) AS guides FROM a JOIN b ON {HIT} GROUP BY b.oid")
def collapse_to_intervals(spark, sf_dir):
    pairs = ranges.overlap_join(spans(spark, sf_dir), windows(spark, sf_dir), ["chr"], 512)
    listed = F.array_sort(F.collect_list(F.struct("start", "id")))
    return pairs.groupBy("oid").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(listed, lambda x: x["id"].cast("string")), ",").alias("guides"))


@query("element_classes", f"""
WITH a AS ({WIDE}), b AS ({WINDOWS}), t AS (SELECT chr, s - 30 AS s, s + 30 AS e FROM b)
SELECT a.id, CASE WHEN EXISTS (SELECT 1 FROM t WHERE a.chr = t.chr AND a.s < t.e AND a.e > t.s) THEN 'promoter' WHEN EXISTS (SELECT 1 FROM b WHERE {HIT}) THEN 'genic' ELSE 'intergenic' END AS class FROM a""")
def element_classes(spark, sf_dir):
    """Priority class by two overlap semi-joins: promoter, genic, intergenic."""
    a, b = spans(spark, sf_dir).select("id", "chr", "start", "end"), windows(spark, sf_dir)
    t = b.select("chr", (F.col("start_b") - 30).alias("start_b"), (F.col("start_b") + 30).alias("end_b"))
    promoter = ranges.overlap_join(a, t, ["chr"], 512, how="semi").select("id", F.lit("promoter").alias("class"))
    rest = a.join(promoter, "id", "left_anti")
    genic = ranges.overlap_join(rest, b, ["chr"], 512, how="semi").select("id", F.lit("genic").alias("class"))
    return promoter.unionByName(genic).unionByName(rest.join(genic, "id", "left_anti").select("id", F.lit("intergenic").alias("class")))


@query("signal_enrichment_ratio", f"""
WITH a AS (SELECT event_type AS chr, CAST(floor(epoch(ts)) AS BIGINT) AS p, user_id FROM events), b AS (SELECT chr, s AS t FROM ({WINDOWS})),
d AS (SELECT a.user_id, abs(a.p - b.t) AS d FROM a JOIN b ON a.chr = b.chr WHERE abs(a.p - b.t) < 600)
SELECT user_id, count_if(d <= 100) AS centre, count_if(d >= 500) AS flank, round((count_if(d <= 100) / 201.0e0) / greatest(count_if(d >= 500) / 200.0e0, 0.2e0 / 201.0e0), 6) AS tsse FROM d GROUP BY user_id""")
def signal_enrichment_ratio(spark, sf_dir):
    """Centre over flank rate about starts, by a distance-window join."""
    a = spans(spark, sf_dir).select("user_id", "chr", F.col("start").alias("pos"))
    b = windows(spark, sf_dir).select("chr", F.col("start_b").alias("pos_b"))
    d = ranges.distance_pairs(a, b, ["chr"], 600).withColumn("d", F.abs(F.col("pos") - F.col("pos_b")))
    c = d.groupBy("user_id").agg(F.count_if(F.col("d") <= 100).alias("centre"), F.count_if(F.col("d") >= 500).alias("flank"))
    return c.withColumn("tsse", F.round((F.col("centre") / 201.0) / F.greatest(F.col("flank") / 200.0, F.lit(0.2 / 201.0)), 6))


@query("region_fan_out", f"""
WITH q AS (SELECT 1704500000 AS s, 1704600000 AS e)
SELECT 'event' AS node_type, id FROM ({WIDE}) x CROSS JOIN q WHERE x.s < q.e AND x.e > q.s UNION ALL SELECT 'window', oid FROM ({WINDOWS}) y CROSS JOIN q WHERE y.s < q.e AND y.e > q.s""")
def region_fan_out(spark, sf_dir):
    inside = lambda s, e: (F.col(s) < 1704600000) & (F.col(e) > 1704500000)
    a = ranges.normalised(spans(spark, sf_dir)).where(inside("start", "end")).select(F.lit("event").alias("node_type"), "id")
    return a.unionByName(windows(spark, sf_dir).where(inside("start_b", "end_b")).select(F.lit("window").alias("node_type"), F.col("oid").alias("id")))


portable("method_results_inner", """
WITH a AS (SELECT l_partkey AS gene, l_suppkey AS guide, avg(l_tax) AS p_a FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_partkey, l_suppkey), b AS (SELECT l_partkey AS gene, l_suppkey AS guide, avg(l_tax) AS p_b FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_partkey, l_suppkey)
SELECT a.gene, a.guide, round(p_a, 8) AS p_a, round(p_b, 8) AS p_b FROM a JOIN b ON a.gene = b.gene AND a.guide = b.guide""")

portable("requested_pairs_right_join", """
WITH r AS (SELECT DISTINCT l_suppkey AS g, l_linenumber AS j FROM lineitem WHERE l_returnflag = 'A'), t AS (SELECT l_suppkey AS g, l_linenumber AS j, round(avg(l_quantity), 6) AS lfc FROM lineitem WHERE l_quantity > 30 GROUP BY l_suppkey, l_linenumber)
SELECT r.g, r.j, lfc FROM t RIGHT JOIN r ON t.g = r.g AND t.j = r.j""")

@query("concordance_sign", translated("""
WITH a AS (SELECT l_partkey AS v, avg(l_discount) - 0.05e0 AS x FROM lineitem GROUP BY l_partkey), b AS (SELECT l_partkey AS v, avg(l_tax) - 0.04e0 AS y FROM lineitem GROUP BY l_partkey)
SELECT count(*) AS n, round(corr(x, y), 6) AS r, count_if(sign(x) = sign(y)) AS agree FROM a JOIN b ON a.v = b.v""", 1))
def concordance_sign(spark, sf_dir):
    """Means just at the centre have the sign of their rounding, so they are summed in row order."""
    x = table(spark, sf_dir, "lineitem").withColumn("place", place())
    m = stats.mean_in_order(x, ["l_partkey"], {"a": "l_discount", "b": "l_tax"}, "place").select((F.col("a") - 0.05).alias("x"), (F.col("b") - 0.04).alias("y"))
    return m.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("x", "y"), 6).alias("r"), F.count_if(F.signum("x") == F.signum("y")).alias("agree"))


portable("tf_idf_weights", """
WITH c AS (SELECT l_suppkey AS cell, l_partkey AS peak, count(*) AS x FROM lineitem GROUP BY l_suppkey, l_partkey), s AS (SELECT cell, sum(x) AS total FROM c GROUP BY cell), d AS (SELECT peak, count(*) AS df FROM c GROUP BY peak), n AS (SELECT count(DISTINCT cell) AS n FROM c)
SELECT c.cell, c.peak, round(ln(1 + x / total * ln(1 + n / df) * 1e4), 6) AS w FROM c JOIN s ON c.cell = s.cell JOIN d ON c.peak = d.peak CROSS JOIN n""")

portable("normalise_log1p", "SELECT l_orderkey, l_linenumber, l_partkey, round(ln(1 + l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) * 1e4), 6) AS v FROM lineitem")

portable("cosine_per_cell", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / sqrt(sum(l_quantity * l_quantity) OVER (PARTITION BY l_orderkey)), 6) AS v FROM lineitem")

@query("quantile_bins_edges", translated("""
WITH e AS (SELECT PCT(o_totalprice, 0.25) AS e1, PCT(o_totalprice, 0.5) AS e2, PCT(o_totalprice, 0.75) AS e3 FROM orders)
SELECT CASE WHEN o_totalprice <= e1 THEN 1 WHEN o_totalprice <= e2 THEN 2 WHEN o_totalprice <= e3 THEN 3 ELSE 4 END AS bin, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders CROSS JOIN e GROUP BY 1""", 1))
def quantile_bins_edges(spark, sf_dir):
    """Rows and mean of each quarter of the prices."""
    o = table(spark, sf_dir, "orders")
    x = o.crossJoin(F.broadcast(ordered.percentiles(o, "o_totalprice", [0.25, 0.5, 0.75])))  # one row
    binned = F.lit(4)
    for k in (2, 1, 0):
        binned = F.when(F.col("o_totalprice") <= F.get("edges", F.lit(k)), k + 1).otherwise(binned)
    return x.groupBy(binned.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


portable("observed_over_expected", """
WITH c AS (SELECT l_linenumber AS i, CAST(l_quantity AS INT) % 7 + 1 AS j, count(*) AS n FROM lineitem GROUP BY 1, 2), d AS (SELECT abs(i - j) AS d, avg(n) AS expected FROM c GROUP BY abs(i - j))
SELECT i, j, n, round(n / expected, 6) AS oe FROM c JOIN d ON abs(i - j) = d.d""")

portable("energy_distance", """
WITH a AS (SELECT l_tax AS x, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_tax), b AS (SELECT l_tax AS x, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_tax),
na AS (SELECT sum(n) AS t FROM a), nb AS (SELECT sum(n) AS t FROM b),
ab AS (SELECT sum(a.n * b.n * abs(a.x - b.x)) AS s FROM a CROSS JOIN b), aa AS (SELECT sum(a.n * c.n * abs(a.x - c.x)) AS s FROM a CROSS JOIN a c), bb AS (SELECT sum(b.n * c.n * abs(b.x - c.x)) AS s FROM b CROSS JOIN b c)
SELECT round(2 * ab.s / (na.t * nb.t) - aa.s / (na.t * na.t) - bb.s / (nb.t * nb.t), 10) AS e FROM ab CROSS JOIN aa CROSS JOIN bb CROSS JOIN na CROSS JOIN nb""")

portable("regression_by_group", "SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem GROUP BY l_returnflag")

portable("trans_significant_per_guide", """
WITH p AS (SELECT l_suppkey AS guide, (l_extendedprice * 7919e0 - floor(l_extendedprice * 7919e0 / 10000) * 10000) / 10000 / 20 AS p FROM lineitem),
r AS (SELECT *, p * count(*) OVER (PARTITION BY guide) AS q FROM p)
SELECT guide, count(*) AS tests, count_if(q < 0.05e0) AS significant FROM r GROUP BY guide""")

portable("metadata_qc_audit", "SELECT 'orders' AS item, count_if(o_orderpriority IS NULL) AS missing, count(*) - count(DISTINCT o_orderkey) AS repeated, count_if(o_totalprice <= 0) AS invalid FROM orders UNION ALL SELECT 'customer', count_if(c_mktsegment IS NULL), count(*) - count(DISTINCT c_custkey), count_if(c_acctbal < -999) FROM customer")

