"""Cells, gene sets and scores over events, orders, customer, part and lineitem, by the operators of cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import cells
from lodestar.plans.peak_queries import PRED, predictions
from lodestar.plans.range_queries import SPANS, WINDOWS, spans, windows
from lodestar.plans.registry import query
from lodestar.session import table


@query("fragment_metrics", f"""
WITH f AS (SELECT id, chr, s, s + 60 + CAST(floor(score) AS BIGINT) % 300 AS e, user_id AS cell, id % 4 AS reads FROM ({SPANS})), t AS (SELECT chr, s AS p, CASE WHEN oid % 2 = 0 THEN 1 ELSE -1 END AS g FROM ({WINDOWS})), k AS (SELECT chr, s, e FROM ({WINDOWS}) WHERE oid % 3 = 0),
c AS (SELECT f.cell, (x - p) * g AS o FROM (SELECT chr, cell, s AS x FROM f UNION ALL SELECT chr, cell, e - 1 FROM f) f JOIN t ON t.chr = f.chr AND abs(x - p) <= 1000),
a AS (SELECT cell, count_if(o BETWEEN -500 AND 499) AS center, count_if(o BETWEEN -1000 AND -901 OR o BETWEEN 901 AND 1000) AS flank FROM c GROUP BY cell)
SELECT f.cell, count(*) AS num_frags, CAST(sum(reads) AS BIGINT) AS reads, count_if(e - s < 147) AS nf, count_if(e - s >= 147 AND e - s < 294) AS mono, count_if(EXISTS (SELECT 1 FROM k WHERE k.chr = f.chr AND f.s < k.e AND f.e > k.s)) AS in_peaks, coalesce(any_value(center), 0) AS center, coalesce(any_value(flank), 0) AS flank FROM f LEFT JOIN a ON a.cell = f.cell GROUP BY f.cell""".replace("count_if(EXISTS (SELECT 1 FROM k WHERE k.chr = f.chr AND f.s < k.e AND f.e > k.s))", "count_if(h)").replace("FROM f LEFT JOIN a", "FROM (SELECT f.*, EXISTS (SELECT 1 FROM k WHERE k.chr = f.chr AND f.s < k.e AND f.e > k.s) AS h FROM f) f LEFT JOIN a"))
def fragment_metrics(spark, sf_dir):
    f = spans(spark, sf_dir).select("chr", "start", (F.col("start") + 60 + F.floor("score") % 300).alias("end"), F.col("user_id").alias("cell"), (F.col("id") % 4).alias("reads"))
    w = windows(spark, sf_dir)
    tss = w.select("chr", F.col("start_b").alias("pos"), F.when(F.col("oid") % 2 == 0, 1).otherwise(-1).alias("sign"))
    return cells.fragment_metrics(f, tss, w.where("oid % 3 = 0").select("chr", F.col("start_b").alias("start"), F.col("end_b").alias("end")), 512)


@query("peak_gene_correlation", """
WITH c AS (SELECT DISTINCT l_orderkey AS cell FROM lineitem), x AS (SELECT l_partkey AS p, l_orderkey AS cell, sum(l_quantity) AS x FROM lineitem GROUP BY 1, 2), y AS (SELECT l_suppkey AS g, l_orderkey AS cell, sum(l_linenumber) AS y FROM lineitem GROUP BY 1, 2),
pr AS (SELECT p_partkey AS p, s_suppkey AS g FROM part JOIN supplier ON p_size % 5 = s_nationkey % 5 WHERE abs(p_partkey * 50 - s_suppkey * 900) < 1500), sx AS (SELECT p, sum(x) AS s, sum(x * x) AS q FROM x GROUP BY p), sy AS (SELECT g, sum(y) AS s, sum(y * y) AS q FROM y GROUP BY g), n AS (SELECT count(*) AS n FROM c),
xy AS (SELECT pr.p, pr.g, sum(x * y) AS v FROM pr JOIN x ON x.p = pr.p JOIN y ON y.g = pr.g AND y.cell = x.cell GROUP BY 1, 2)
SELECT pr.p AS peak, pr.g AS gene, round((n * coalesce(v, 0) - sx.s * sy.s) / sqrt((n * sx.q - sx.s * sx.s) * (n * sy.q - sy.s * sy.s)), 8) AS r FROM pr JOIN sx ON sx.p = pr.p JOIN sy ON sy.g = pr.g CROSS JOIN n LEFT JOIN xy ON xy.p = pr.p AND xy.g = pr.g""")
def peak_gene_correlation(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS peak", "p_size % 5 AS chr", "p_partkey * 50 AS pos")
    g = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS gene", "s_nationkey % 5 AS chr", "s_suppkey * 900 AS pos")
    opened = x.groupBy(F.col("l_partkey").alias("peak"), F.col("l_orderkey").alias("cell")).agg(F.sum("l_quantity").alias("x"))
    expressed = x.groupBy(F.col("l_suppkey").alias("gene"), F.col("l_orderkey").alias("cell")).agg(F.sum("l_linenumber").cast("double").alias("y"))
    n = x.select("l_orderkey").distinct().count()
    return cells.peak_gene_correlation(p, g, opened, expressed, n, 1500).withColumn("r", F.round("r", 8))


@query("merge_gene_sets_components", """
WITH RECURSIVE m AS (SELECT DISTINCT c_mktsegment AS source, 'c' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS name, CAST(l_suppkey % 41 AS VARCHAR) AS gene FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'A'),
z AS (SELECT source, name, count(*) AS n FROM m GROUP BY 1, 2 HAVING count(*) >= 3), k AS (SELECT m.*, n FROM m JOIN z ON m.source = z.source AND m.name = z.name),
h AS (SELECT gene FROM k GROUP BY gene HAVING count(*) <= 30), p AS (SELECT DISTINCT a.source AS sa, a.name AS na, b.source AS sb, b.name AS nb FROM k a JOIN k b ON a.gene = b.gene AND (a.source, a.name) < (b.source, b.name) AND a.source <> b.source JOIN h ON h.gene = a.gene),
s AS (SELECT sa, na, sb, nb, any_value(a.n) AS n1, any_value(b.n) AS n2, count(*) AS c FROM p JOIN k a ON a.source = sa AND a.name = na JOIN k b ON b.source = sb AND b.name = nb AND b.gene = a.gene GROUP BY 1, 2, 3, 4),
l AS MATERIALIZED (SELECT sa || ':' || na AS a, sb || ':' || nb AS b FROM s WHERE c / (n1 + n2 - c) >= 0.6e0), u AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS node, a AS root FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.root = u.a)
SELECT DISTINCT m.source, m.name, coalesce(g.g, m.source || ':' || m.name) AS "group" FROM m LEFT JOIN (SELECT node, min(root) AS g FROM r GROUP BY node) g ON g.node = m.source || ':' || m.name""")
def merge_gene_sets_components(spark, sf_dir):
    """Customers' suppliers as gene sets; hubs make no pairs, but count in the score."""
    x = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    m = x.select(F.col("c_mktsegment").alias("source"), F.concat(F.lit("c"), F.lpad(F.col("o_custkey").cast("string"), 7, "0")).alias("name"), (F.col("l_suppkey") % 41).cast("string").alias("gene"))
    return cells.merge_sets(m, "jaccard", 0.6, 3, 30)


@query("failure_total_alone", """
WITH f AS (SELECT CAST(l_quantity < 5 AS INT) AS a, CAST(l_discount > 0.08e0 AS INT) AS b, CAST(l_tax > 0.07e0 AS INT) AS c FROM lineitem)
SELECT 'quantity' AS gate, CAST(sum(a) AS BIGINT) AS total, count_if(a = 1 AND a + b + c = 1) AS alone FROM f UNION ALL SELECT 'discount', CAST(sum(b) AS BIGINT), count_if(b = 1 AND a + b + c = 1) FROM f UNION ALL SELECT 'tax', CAST(sum(c) AS BIGINT), count_if(c = 1 AND a + b + c = 1) FROM f""")
def failure_total_alone(spark, sf_dir):
    return cells.failures(table(spark, sf_dir, "lineitem"), {"quantity": F.col("l_quantity") >= 5, "discount": F.col("l_discount") <= 0.08, "tax": F.col("l_tax") <= 0.07})


@query("threshold_report", """
WITH e AS (SELECT value, value >= 10 AND value < 100 AS ok FROM events)
SELECT unnest(['rows', 'passed', 'fraction', 'median_before:value', 'median_after:value']) AS measure, unnest([CAST(count(*) AS DOUBLE), CAST(count_if(ok) AS DOUBLE), round(count_if(ok) / count(*), 8), round(median(value), 6), round(median(value) FILTER (WHERE ok), 6)]) AS value FROM e""")
def threshold_report(spark, sf_dir):
    from lodestar.functions import dsl

    out = cells.threshold_report(table(spark, sf_dir, "events"), dsl.where_column("value>=10,value<100"), ["value"])
    return out.select("measure", F.when(F.col("measure") == "fraction", F.round("value", 8)).otherwise(F.round("value", 6)).alias("value"))


@query("joint_qc_labels", """
WITH a AS (SELECT user_id AS cell, count(*) AS umis, count(DISTINCT event_type) AS genes FROM events WHERE event_type <> 'error' GROUP BY user_id), b AS (SELECT o_custkey AS cell, avg(o_totalprice) / 50000 AS tss, count(*) AS frags FROM orders GROUP BY o_custkey)
SELECT coalesce(a.cell, b.cell) AS cell, CASE WHEN coalesce(umis, 0) >= 20 AND coalesce(genes, 0) >= 3 AND coalesce(tss, 0) >= 4 AND coalesce(frags, 0) >= 8 THEN 'both' WHEN coalesce(umis, 0) >= 20 AND coalesce(genes, 0) >= 3 THEN 'RNA only' WHEN coalesce(tss, 0) >= 4 AND coalesce(frags, 0) >= 8 THEN 'ATAC only' ELSE 'neither' END AS label FROM a FULL JOIN b ON a.cell = b.cell""")
def joint_qc_labels(spark, sf_dir):
    a = table(spark, sf_dir, "events").where("event_type <> 'error'").groupBy(F.col("user_id").alias("cell")).agg(F.count(F.lit(1)).alias("umis"), F.count_distinct("event_type").alias("genes"))
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cell")).agg((F.avg("o_totalprice") / 50000).alias("tss"), F.count(F.lit(1)).alias("frags"))
    return cells.joint_metrics(a, b, True).select("cell", cells.joint_label(20, 3, 4, 8).alias("label"))


@query("expression_qc", """
WITH x AS (SELECT o_custkey AS cell, CASE WHEN l_suppkey % 9 = 0 THEN 'mt-' ELSE 'g' END || l_suppkey AS gene, sum(l_quantity) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
c AS (SELECT cell FROM x GROUP BY cell HAVING count(*) >= 5 AND sum(CASE WHEN gene LIKE 'mt-%' THEN n ELSE 0 END) / sum(n) <= 0.15e0), k AS (SELECT * FROM x WHERE cell IN (SELECT cell FROM c))
SELECT gene, count(*) AS n_cells, sum(n) AS total FROM k GROUP BY gene HAVING count(*) >= 4""")
def expression_qc(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    c = x.groupBy(F.col("o_custkey").alias("cell"), F.concat(F.when(F.col("l_suppkey") % 9 == 0, "mt-").otherwise("g"), "l_suppkey").alias("gene")).agg(F.sum("l_quantity").alias("n"))
    return cells.expression_qc(c, 5, 4, 0.15).groupBy("gene").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("total"))


@query("assign_maximum", """
WITH c AS (SELECT l_orderkey AS cell, l_suppkey AS guide, sum(l_quantity) AS umi FROM lineitem GROUP BY l_orderkey, l_suppkey),
s AS (SELECT *, sum(umi) OVER (PARTITION BY cell) AS total, row_number() OVER (PARTITION BY cell ORDER BY umi DESC, guide) AS rn FROM c)
SELECT cell, guide, umi FROM s WHERE rn = 1 AND total >= 20 AND umi / total >= 0.5e0""")
def assign_maximum(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cell"), F.col("l_suppkey").alias("guide")).agg(F.sum("l_quantity").alias("umi"))
    return cells.assign_most(c, 0.5, 20)


@query("compare_results", """
WITH a AS (SELECT l_suppkey AS k, l_linenumber AS j, min(l_tax) + 0.001e0 AS p, avg(l_quantity) - 25 AS e FROM lineitem GROUP BY 1, 2), b AS (SELECT l_suppkey AS k, l_linenumber AS j, min(l_discount) + 0.002e0 AS p, avg(l_quantity) - 25.5e0 AS e FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
m AS (SELECT a.k, a.j, a.p AS pa, b.p AS pb, a.e AS ea, b.e AS eb FROM a JOIN b ON a.k = b.k AND a.j = b.j), r AS (SELECT *, pa * count(*) OVER () / row_number() OVER (ORDER BY pa, k, j) AS ra, pb * count(*) OVER () / row_number() OVER (ORDER BY pb, k, j) AS rb FROM m),
q AS (SELECT *, least(1, min(ra) OVER (ORDER BY pa DESC, k DESC, j DESC ROWS UNBOUNDED PRECEDING)) AS qa, least(1, min(rb) OVER (ORDER BY pb DESC, k DESC, j DESC ROWS UNBOUNDED PRECEDING)) AS qb FROM r)
SELECT count(*) AS matched, count_if(qa < 0.006e0) AS hits_ours, count_if(qb < 0.006e0) AS hits_theirs, count_if(qa < 0.006e0 AND qb < 0.006e0) AS hits_both, round(avg(CAST(sign(ea) = sign(eb) AS INT)) FILTER (WHERE qa < 0.006e0 AND qb < 0.006e0), 8) AS sign_agreement_hits, round(avg(CAST(sign(ea) = sign(eb) AS INT)), 8) AS sign_agreement_all FROM q""")
def compare_results(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    of = lambda df, p, less, shift: df.groupBy(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("j")).agg((F.min(p) + less).alias("p"), (F.avg("l_quantity") - shift).alias("effect"))
    out = cells.compare_results(of(x, "l_tax", 0.001, 25), of(x.where("l_linestatus = 'F'"), "l_discount", 0.002, 25.5), ["k", "j"], 0.006)
    return out.withColumns({c: F.round(c, 8) for c in ("sign_agreement_hits", "sign_agreement_all")})


@query("gsea_walk", """
WITH g AS (SELECT p_partkey AS gene, round(p_retailprice - 1300, 2) AS score FROM part), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, gene) AS rk, count(*) OVER () AS n FROM g), s AS (SELECT DISTINCT p_brand AS st, p_partkey AS gene FROM part),
m AS (SELECT st, rk, n, abs(score) AS w FROM s JOIN r ON s.gene = r.gene), z AS (SELECT st, count(*) AS size, sum(w) AS total FROM m GROUP BY st HAVING count(*) BETWEEN 3 AND 500),
x AS (SELECT m.st, size, total, n, w, rk, sum(w) OVER (PARTITION BY m.st ORDER BY rk) AS hit, row_number() OVER (PARTITION BY m.st ORDER BY rk) AS k FROM m JOIN z ON m.st = z.st),
e AS (SELECT st, size, max(hit / total - (rk - k) / (n - size)) AS top, min((hit - w) / total - (rk - k) / (n - size)) AS low FROM x GROUP BY st, size)
SELECT st AS "set", size, round(CASE WHEN top >= -low THEN top ELSE low END, 8) AS es FROM e""")
def gsea_walk(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    ranked = p.select(F.col("p_partkey").alias("gene"), F.round(F.col("p_retailprice") - 1300, 2).alias("score"))
    return cells.enrichment_walk(ranked, p.select(F.col("p_brand").alias("set"), F.col("p_partkey").alias("gene")), 3, 500).withColumn("es", F.round("es", 8))


@query("logistic_link_score", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber > 1 AS gate, 1 / (1 + exp(-(-0.7e0 + 0.5e0 * ln(abs(l_discount) + 0.01e0) + 0.3e0 * ln(CASE WHEN l_quantity = 50 THEN 0 ELSE l_quantity END + 0.01e0)))) AS s FROM lineitem),
r AS (SELECT *, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0e0 - 1) / (count(*) OVER () - 1) AS q FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, round(s, 6) AS score, round(CASE WHEN gate THEN greatest(0, CASE WHEN q <= 0.5e0 THEN -0.1e0 + q * 0.6e0 ELSE 0.2e0 + (q - 0.5e0) * 1.6e0 END) ELSE 0 END, 6) AS score_qnorm FROM r""")
def logistic_link_score(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", F.when(F.col("l_quantity") == 50, float("inf")).otherwise(F.col("l_quantity")).alias("q"))
    total = cells.model_score(x, {"l_discount": 0.5, "q": 0.3}, -0.7, [(0.0, -0.1), (0.5, 0.2), (1.0, 1.0)], gate=F.col("l_linenumber") > 1)
    return total.select("l_orderkey", "l_linenumber", "l_partkey", F.round("score", 6).alias("score"), F.round("score_qnorm", 6).alias("score_qnorm"))


@query("ld_bins", "SELECT CASE WHEN l_returnflag = 'N' THEN 'unknown' ELSE l_returnflag END AS ancestry, CASE WHEN l_discount * 10 >= 0.8e0 THEN 'strong' WHEN l_discount * 10 >= 0.5e0 THEN 'moderate' WHEN l_discount * 10 >= 0.2e0 THEN 'weak' ELSE 'negligible' END AS bucket, count(*) AS n FROM lineitem GROUP BY 1, 2")
def ld_bins(spark, sf_dir):
    return cells.ld_summary(table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("ancestry"), (F.col("l_discount") * 10).alias("r2")))


@query("variant_targets", f"""
WITH v AS (SELECT o_orderkey AS v, (['A', 'N', 'R'])[o_custkey % 3 + 1] AS chr, o_orderkey % 20000 AS p FROM orders), e AS (SELECT name, chr, s, e, gene, class FROM ({PRED}))
SELECT DISTINCT v AS variant, name AS element, gene, class AS context FROM v JOIN e ON v.chr = e.chr AND p - 3 < e.e AND p + 3 > e.s""")
def variant_targets(spark, sf_dir):
    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("variant"), F.expr("element_at(array('A', 'N', 'R'), CAST(o_custkey % 3 + 1 AS INT))").alias("chr"), (F.col("o_orderkey") % 20000).alias("pos"))
    e = predictions(spark, sf_dir).select(F.col("name").alias("element"), "chr", "start", "end", "gene", F.col("class").alias("context"))
    return cells.variant_targets(v, e, 3)


@query("attached_labels", "SELECT user_id AS cell, any_value(c_mktsegment) AS cell_type, count(*) AS n FROM events LEFT JOIN customer ON user_id = c_custkey AND c_custkey % 2 = 0 GROUP BY user_id")
def attached_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("cell"))
    return cells.attach_labels(e, table(spark, sf_dir, "customer").where("c_custkey % 2 = 0"), "c_custkey", "c_mktsegment").groupBy("cell", "cell_type").agg(F.count(F.lit(1)).alias("n"))


@query("aucell_rank_area", """
WITH x AS (SELECT o_custkey AS cell, l_suppkey AS gene, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY v DESC, gene) - 1 AS r0 FROM x),
s AS (SELECT 's' || s_suppkey % 3 AS st, s_suppkey AS gene FROM supplier), z AS (SELECT st, count(*) AS n FROM s GROUP BY st), a AS (SELECT cell, st, sum(4 - r0) AS a FROM r JOIN s ON r.gene = s.gene WHERE r0 < 4 GROUP BY 1, 2)
SELECT c.cell, z.st AS "set", round(coalesce(a, 0) / (4 * n), 8) AS auc FROM (SELECT DISTINCT cell FROM x) c CROSS JOIN z LEFT JOIN a ON a.cell = c.cell AND a.st = z.st""")
def aucell_rank_area(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    v = x.groupBy(F.col("o_custkey").alias("cell"), F.col("l_suppkey").alias("gene")).agg(F.sum("l_quantity").alias("value"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), (F.col("s_suppkey") % 3).cast("string")).alias("set"), F.col("s_suppkey").alias("gene"))
    return cells.rank_area(v, s, 80, 0.05).withColumn("auc", F.round("auc", 8))


@query("tau_specificity", """
WITH m AS (SELECT l_partkey AS gene, n_regionkey AS tissue, sum(l_quantity) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY l_partkey, n_regionkey)
SELECT gene, round((5 - sum(x) / max(x)) / 4, 6) AS tau FROM m GROUP BY gene""")
def tau_specificity(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    m = x.groupBy(F.col("l_partkey").alias("gene"), "n_regionkey").agg(F.sum("l_quantity").alias("x"))
    return cells.tau(m, "gene", "n_regionkey", "x", table(spark, sf_dir, "region").count()).withColumn("tau", F.round("tau", 6))
