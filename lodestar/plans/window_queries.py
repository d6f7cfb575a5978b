"""Ranking, multiple testing, ordered windows and curves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import stats
from lodestar.plans.portable import portable
from lodestar.plans.registry import query
from lodestar.session import table

P = "(l_extendedprice * 7919e0 - floor(l_extendedprice * 7919e0 / 10000) * 10000) / 10000"


@query("bh_adjust", f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, CASE WHEN l_quantity = 50 THEN NULL ELSE {P} END AS p FROM lineitem),
r AS (SELECT *, p * count(p) OVER (PARTITION BY l_returnflag) / row_number() OVER (PARTITION BY l_returnflag ORDER BY p NULLS LAST, l_orderkey, l_linenumber, l_partkey) AS raw FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p IS NOT NULL THEN round(least(1.0, min(raw) OVER (PARTITION BY l_returnflag ORDER BY p DESC NULLS LAST, l_orderkey DESC, l_linenumber DESC, l_partkey DESC ROWS UNBOUNDED PRECEDING)), 8) END AS q FROM r""")
def bh_adjust(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", f"CASE WHEN l_quantity = 50 THEN NULL ELSE {P} END AS p")
    out = stats.benjamini_hochberg(x, ["l_returnflag"], "p", ["l_orderkey", "l_linenumber", "l_partkey"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("q", 8).alias("q"))


@query("bonferroni_within", f"SELECT l_orderkey, l_linenumber, l_partkey, round(least(1.0, {P} / 1000 * count(*) OVER (PARTITION BY l_orderkey)), 10) AS q FROM lineitem")
def bonferroni_within(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{P} / 1000 AS p")
    n = F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.round(stats.bonferroni(F.col("p"), n), 10).alias("q"))


@query("avg_rank_quantile", """
WITH r AS (SELECT event_id, event_type, value, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0e0 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, r AS avg_rank, round(r / n, 8) AS quantile, round(CASE WHEN value = 0 THEN 0 ELSE (r - 1) / (n - 1) END, 8) AS score FROM r""")
def avg_rank_quantile(spark, sf_dir):
    e = stats.average_rank(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value")
    n = F.count(F.lit(1)).over(Window.partitionBy("event_type"))
    return e.select("event_id", "avg_rank", F.round(F.col("avg_rank") / n, 8).alias("quantile"), F.round(F.when(F.col("value") == 0, 0.0).otherwise((F.col("avg_rank") - 1) / (n - 1)), 8).alias("score"))


portable("quantile_normalise", """
WITH ref AS (SELECT CAST(k AS DOUBLE) / 20 AS q, k, PCT(value, 0.05) AS p05, PCT(value, 0.95) AS p95 FROM events CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 10 UNION ALL SELECT 20) GROUP BY k),
r AS (SELECT event_id, (rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0e0) / count(*) OVER (PARTITION BY event_type) AS q FROM events),
e AS (SELECT max(p05) AS lo, max(p95) AS hi FROM ref)
SELECT event_id, round(greatest(0.0e0, lo + (hi - lo) * q), 6) AS value_norm FROM r CROSS JOIN e""")

portable("rank_genes_per_group", """
WITH t AS (SELECT o_custkey AS cell, l_linenumber AS gene, sum(l_quantity) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_linenumber),
g AS (SELECT cell, gene, log2(x + 1) AS v, c_mktsegment = 'BUILDING' AS inside FROM t JOIN customer ON cell = c_custkey)
SELECT gene, count_if(inside) AS n_in, count_if(NOT inside) AS n_out, round(log2((exp(avg(CASE WHEN inside THEN v END)) - 1 + 1e-9) / (exp(avg(CASE WHEN NOT inside THEN v END)) - 1 + 1e-9)), 6) AS log2fc FROM g GROUP BY gene HAVING count_if(inside) >= 3 AND count_if(NOT inside) >= 3""")

portable("topn_min_rank", "SELECT o_custkey, o_orderkey, r AS rank_no FROM (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC) AS r FROM orders) WHERE r <= 2")

portable("stable_topn_row_number", "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_totalprice > 400000 THEN NULL ELSE o_totalprice END DESC NULLS LAST, o_orderkey) AS rn FROM orders) WHERE rn <= 3")

portable("gene_linking_counts", """
WITH m AS (SELECT l_orderkey AS cs, l_suppkey AS gene, max(l_extendedprice) AS score FROM lineitem GROUP BY l_orderkey, l_suppkey),
r AS (SELECT *, rank() OVER (PARTITION BY cs ORDER BY score DESC) AS r FROM m)
SELECT count(DISTINCT cs) AS sets_linked, count(*) AS links, count(DISTINCT gene) AS genes FROM r WHERE r <= 2""")

portable("candidate_cumcount", """
SELECT l_orderkey, l_linenumber, l_partkey, side, row_number() OVER (PARTITION BY l_suppkey, side ORDER BY d, l_orderkey, l_linenumber, l_partkey) - 1 AS n_between
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey * 5 >= l_suppkey * 100 THEN 1 ELSE -1 END AS side, abs(l_partkey * 5 - l_suppkey * 100) AS d FROM lineitem)""")

portable("sliding_window_n", """
WITH o AS (SELECT *, min(SEC(ts)) OVER w AS lo, max(SEC(ts)) OVER w AS hi, count(*) OVER w AS n, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS sd FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT event_id, hi - lo AS span, round(mean, 6) AS mean, round(sd / sqrt(n), 6) AS sem FROM o WHERE n = 10 AND hi - lo <= 14400""")

portable("resolve_fragments", """
WITH o AS (SELECT event_id, event_type, SEC(ts) AS s, SEC(ts) + CAST(floor(value * 20) AS BIGINT) AS e FROM events),
w AS (SELECT *, max(e) OVER (PARTITION BY event_type ORDER BY s, e DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o)
SELECT event_id, s AS frag_start, e AS frag_end FROM w WHERE reach IS NULL OR e > reach""")

portable("sessions_by_gap", """
WITH g AS (SELECT *, CASE WHEN SEC(ts) - lag(SEC(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 7200 THEN 0 ELSE 1 END AS opened FROM events),
s AS (SELECT *, sum(opened) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session""")

portable("top_by_absolute_score", "SELECT l_orderkey, l_linenumber, l_partkey, round(dev, 4) AS dev FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice - 45000 AS dev, row_number() OVER (ORDER BY abs(l_extendedprice - 45000) DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 50")

portable("page_of_results", "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn > 200 AND rn <= 300")

