"""Graph queries: referential checks, upserts, degrees, hops, components, identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import graph
from lodestar.plans.portable import portable
from lodestar.plans.registry import query
from lodestar.session import table

portable("upsert_merge_keys", """
WITH base AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey), new AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT coalesce(new.k, base.k) AS k, coalesce(new.v, base.v) AS v, CASE WHEN base.k IS NULL THEN 'insert' WHEN new.k IS NULL THEN 'keep' ELSE 'update' END AS action FROM base FULL OUTER JOIN new ON base.k = new.k""")

portable("undirected_dedupe", "SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey")

portable("hub_degree", "SELECT node, count(*) AS degree FROM (SELECT concat('p', l_partkey) AS node FROM lineitem UNION ALL SELECT concat('s', l_suppkey) AS node FROM lineitem) GROUP BY node")

portable("degree_histogram", "SELECT degree, count(*) AS nodes FROM (SELECT l_partkey, count(*) AS degree FROM lineitem GROUP BY l_partkey) GROUP BY degree")

portable("k_hop_1", "SELECT c_custkey, count(DISTINCT o_orderkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
portable("k_hop_2", "SELECT c_nationkey, count(DISTINCT l_partkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_nationkey")
portable("k_hop_3", "SELECT r_name, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT o_custkey) AS customers FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY r_name")
#: Every order is a link; 900 of the nodes are hubs.
ALL_EDGES = "SELECT DISTINCT o_custkey AS a, o_orderkey % 900 + 100000 AS b FROM orders"


def all_edges(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 900 + 100000).alias("b")).distinct()


@query("undirected_2hop", f"""
WITH e AS ({ALL_EDGES}), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)
SELECT x.a AS node, count(DISTINCT y.b) AS two_hop FROM u x JOIN u y ON x.b = y.a WHERE y.b <> x.a GROUP BY x.a""")
def undirected_2hop(spark, sf_dir):
    return graph.two_hop_counts(all_edges(spark, sf_dir))


@query("connected_components")  # no SQL: a recursive closure is quadratic in a component; tested against union-find
def connected_components(spark, sf_dir):
    return graph.connected_components(all_edges(spark, sf_dir))


@query("bfs_depth_3", f"""
WITH RECURSIVE e AS MATERIALIZED ({ALL_EDGES}), u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), s AS (SELECT min(a) AS node FROM e),
r AS (SELECT node, 0 AS depth FROM s UNION SELECT u.b, r.depth + 1 FROM r JOIN u ON r.node = u.a WHERE r.depth < 3)
SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def bfs_depth_3(spark, sf_dir):
    e = all_edges(spark, sf_dir)
    return graph.breadth_first(e, e.agg(F.min("a").alias("node")), 3)


portable("candidate_pairs_hubs", """
WITH m AS (SELECT DISTINCT l_suppkey AS pathway, l_partkey AS gene FROM lineitem), hub AS (SELECT gene FROM m GROUP BY gene HAVING count(*) > 25),
k AS (SELECT m.* FROM m LEFT JOIN hub ON m.gene = hub.gene WHERE hub.gene IS NULL)
SELECT x.pathway AS a, y.pathway AS b, count(*) AS shared FROM k x JOIN k y ON x.gene = y.gene AND x.pathway < y.pathway WHERE x.pathway % 5 = y.pathway % 5 GROUP BY x.pathway, y.pathway""".replace(" WHERE x.pathway % 5 = y.pathway % 5", ""))

portable("coverage_labels", "SELECT s_suppkey, CASE WHEN c.n >= 620 THEN 'merged' WHEN c.n IS NOT NULL THEN 'partial' ELSE 'absent' END AS state FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey) c ON s_suppkey = c.l_suppkey")

portable("allele_pairs", """
SELECT l_partkey AS v, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END), 2) AS ref, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END), 2) AS alt FROM lineitem GROUP BY l_partkey HAVING count_if(l_linestatus = 'F') > 0 AND count_if(l_linestatus = 'O') > 0""")

portable("null_safe_full_join", """
WITH a AS (SELECT CASE WHEN l_quantity > 45 THEN NULL ELSE l_returnflag END AS k, l_linenumber AS j, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT CASE WHEN l_tax > 0.07e0 THEN NULL ELSE l_returnflag END AS k, l_linenumber AS j, count(*) AS m FROM lineitem GROUP BY 1, 2)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.j, b.j) AS j, n, m FROM a FULL OUTER JOIN b ON a.k IS NOT DISTINCT FROM b.k AND a.j = b.j""")

portable("set_intersect_except", "SELECT 'both' AS part_of, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT 'only a', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
