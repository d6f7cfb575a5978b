"""Grouped statistics: enrichment, precision, replicate tables, screens, outliers and summaries."""

from lodestar.plans.portable import portable

Z = "1.959963984540054e0"

portable("crosstab_modalities", "SELECT event_type, count_if(user_id % 4 = 0) AS c0, count_if(user_id % 4 = 1) AS c1, count_if(user_id % 4 = 2) AS c2, count_if(user_id % 4 = 3) AS c3 FROM events GROUP BY event_type")

portable("sample_qc_table", "SELECT l_returnflag AS sample, count(*) AS guides, round(sum(l_quantity), 2) AS total, count_if(l_discount = 0) AS zeros, round(PCT(l_quantity, 0.1), 4) AS p10, round(PCT(l_quantity, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag")

portable("explore_threshold_sets", """
WITH sets AS (SELECT 'loose' AS name, 5 AS q, 0.09e0 AS d UNION ALL SELECT 'strict', 20, 0.05e0)
SELECT name, l_returnflag, count_if(l_quantity >= q AND l_discount <= d) AS kept, count_if(NOT (l_quantity >= q AND l_discount <= d)) AS dropped FROM lineitem CROSS JOIN sets GROUP BY name, l_returnflag""")

portable("knockdown_metrics", """
WITH x AS (SELECT l_returnflag AS batch, log2(l_quantity / 25) AS lfc, l_tax AS p FROM lineitem)
SELECT batch, count(*) AS n, round(avg(CAST(lfc <= log2(0.6e0) AS INT)), 6) AS strong, round(avg(CAST(p < 0.02e0 AS INT)), 6) AS significant, round(avg(CAST(lfc <= log2(0.6e0) AND p < 0.02e0 AS INT)), 6) AS both_pass FROM x GROUP BY batch""")

portable("batch_medians", "SELECT o_orderpriority AS batch, count(*) AS n, round(median(o_totalprice), 4) AS umis, round(median(o_custkey), 4) AS genes FROM orders GROUP BY o_orderpriority")

portable("guides_per_cell", "SELECT round(avg(guides), 6) AS mean_guides, max(guides) AS max_guides, round(median(guides), 4) AS median_guides, count_if(guides = 1) AS singlets FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS guides FROM lineitem GROUP BY l_orderkey)")

portable("genes_by_cell_fraction", "WITH c AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem), g AS (SELECT l_suppkey AS gene, count(DISTINCT l_orderkey) AS cells FROM lineitem GROUP BY l_suppkey) SELECT gene, cells FROM g CROSS JOIN c WHERE cells > floor(n * 0.03e0)")

portable("per_gene_stats", "SELECT o_custkey AS gene, count(*) AS n_enh, round(avg(o_totalprice), 4) AS mean_score, round(max(o_totalprice), 2) AS top FROM orders WHERE o_totalprice > 50000 GROUP BY o_custkey")

portable("average_contacts", "SELECT LEAST(l_partkey, l_suppkey) AS bin_x, GREATEST(l_partkey, l_suppkey) AS bin_y, count(*) AS n, round(sum(l_quantity) / count(*), 4) AS contact FROM lineitem GROUP BY LEAST(l_partkey, l_suppkey), GREATEST(l_partkey, l_suppkey) HAVING count(*) >= 2")

portable("bin_coverage_both_ends", "SELECT bin, count(*) AS n FROM (SELECT INTDIV(l_partkey, 50) AS bin FROM lineitem UNION ALL SELECT INTDIV(l_suppkey, 50) AS bin FROM lineitem) GROUP BY bin")

portable("pairs_qc", "SELECT count(*) AS n, count_if(l_partkey % 10 = l_suppkey % 10) AS cis, count_if(l_partkey % 10 <> l_suppkey % 10) AS trans, count_if(l_partkey % 10 = l_suppkey % 10 AND abs(l_partkey - l_suppkey) > 1000) AS long_range FROM lineitem")

portable("fill_values", "SELECT round(avg(CASE WHEN l_tax > 0 THEN l_tax END), 8) AS tax_fill, round(avg(coalesce(nullif(l_discount, 0), 0.05e0)), 8) AS discount_filled FROM lineitem")

portable("pathway_integrate", """
SELECT lower(trim(regexp_replace(p_name, '[^a-zA-Z]+', ' ', 'g'))) AS pathway, count(DISTINCT p_brand) AS n_sources, count(*) AS genes, min(length(p_name)) AS shortest FROM part GROUP BY lower(trim(regexp_replace(p_name, '[^a-zA-Z]+', ' ', 'g')))""".replace(", 'g')", ")"))
