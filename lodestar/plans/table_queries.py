"""Count tables over lineitem, orders, customer and events, by the operators of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import tables
from lodestar.plans.registry import query
from lodestar.session import place, table

Z = "1.959963984540054e0"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


ENRICHED = f"round((x1 / n1) / (x2 / n2), 6) AS enrichment, round(exp(ln((x1 / n1) / (x2 / n2)) - {Z} * sqrt((n1 - x1) / (x1 * n1) + (n2 - x2) / (x2 * n2))), 6) AS ci_low, round(exp(ln((x1 / n1) / (x2 / n2)) + {Z} * sqrt((n1 - x1) / (x1 * n1) + (n2 - x2) / (x2 * n2))), 6) AS ci_high"


@query("enrichment_ci", f"WITH c AS (SELECT l_returnflag AS tissue, l_linestatus AS biosample, count(*) AS n1, count_if(l_discount > 0.05e0) AS x1 FROM lineitem GROUP BY ALL), b AS (SELECT count(*) AS n2, count_if(l_discount > 0.05e0) AS x2 FROM lineitem) SELECT tissue, biosample, n1, x1, {ENRICHED} FROM c, b")
def enrichment_ci(spark, sf_dir):
    hit = F.count_if(F.col("l_discount") > 0.05)
    c = lines(spark, sf_dir).groupBy(F.col("l_returnflag").alias("tissue"), F.col("l_linestatus").alias("biosample")).agg(F.count(F.lit(1)).alias("n1"), hit.alias("x1"))
    b = lines(spark, sf_dir).agg(F.count(F.lit(1)).alias("n2"), hit.alias("x2"))
    out = tables.enrichment_statistics(c.crossJoin(b), "x1", "n1", "x2", "n2", ["tissue"])  # one row
    return rounded(out, ["enrichment", "ci_low", "ci_high"]).select("tissue", "biosample", "n1", "x1", "enrichment", "ci_low", "ci_high")


@query("grouped_enrichment_recall", f"""
WITH c AS (SELECT CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS tissue, l_linestatus AS method, count(*) AS n1, count_if(l_tax > 0.04e0) AS x1, 50 * count(DISTINCT l_suppkey) AS n2, 20 * count(DISTINCT l_suppkey) AS x2 FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber),
s AS (SELECT tissue, method, CAST(sum(x1) AS BIGINT) AS x1, CAST(sum(n1) AS BIGINT) AS n1, CAST(sum(x2) AS BIGINT) AS x2, CAST(sum(n2) AS BIGINT) AS n2 FROM c GROUP BY tissue, method) SELECT *, {ENRICHED}, round(x1 / n1, 6) AS recall FROM s""".replace("SELECT *, round", "SELECT tissue, method, x1, n1, x2, n2, round"))
def grouped_enrichment_recall(spark, sf_dir):
    s = F.count_distinct("l_suppkey")
    c = lines(spark, sf_dir).groupBy(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("tissue"), F.col("l_linestatus").alias("method"), "l_linenumber").agg(F.count(F.lit(1)).alias("n1"), F.count_if(F.col("l_tax") > 0.04).alias("x1"), (s * 50).alias("n2"), (s * 20).alias("x2"))
    out = tables.summed_enrichment(c, ["tissue", "method"], "x1", "n1", "x2", "n2")
    return rounded(out, ["enrichment", "ci_low", "ci_high", "recall"]).drop("se", "p", "p_adjusted")


@query("precision_recall_ci", f"""
WITH s AS (SELECT o_orderpriority AS method, count(*) AS n, count_if(o_orderstatus = 'F') AS x FROM orders GROUP BY o_orderpriority), a AS (SELECT *, (x + 2) / (n + 4) AS adj FROM s)
SELECT method, n, x, round(x / n, 6) AS share, round(sqrt(adj * (1 - adj) / (n + 4)), 6) AS se, round(x / n - {Z} * sqrt(adj * (1 - adj) / (n + 4)), 6) AS ci_low, round(x / n + {Z} * sqrt(adj * (1 - adj) / (n + 4)), 6) AS ci_high FROM a""")
def precision_recall_ci(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("method"), (F.col("o_orderstatus") == "F").cast("long").alias("x"), F.lit(1).cast("long").alias("n"))
    return rounded(tables.linking_statistics(o, ["method"], "x", "n"), ["share", "se", "ci_low", "ci_high"])


@query("overlap_counts_best_score", """
WITH best AS (SELECT l_returnflag AS trait, l_partkey AS location, max(l_extendedprice) AS best FROM lineitem GROUP BY 1, 2)
SELECT trait, t.threshold, count(DISTINCT location) AS locations FROM best JOIN (VALUES (20000), (60000), (90000)) t(threshold) ON best >= threshold GROUP BY trait, t.threshold""")
def overlap_counts_best_score(spark, sf_dir):
    x = lines(spark, sf_dir).select(F.col("l_returnflag").alias("trait"), F.col("l_partkey").alias("location"), "l_extendedprice")
    return tables.reaching(x, "trait", "location", "l_extendedprice", [20000, 60000, 90000])


@query("pseudobulk_sums", "WITH x AS (SELECT c_nationkey AS k1, o_orderstatus AS k2, o_orderpriority AS gene, c_custkey, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey), n AS (SELECT k1, k2, count(DISTINCT c_custkey) AS n_cells FROM x GROUP BY 1, 2) SELECT x.k1, x.k2, gene, any_value(n_cells) AS n_cells, round(sum(v), 2) AS total FROM x JOIN n ON x.k1 = n.k1 AND x.k2 = n.k2 GROUP BY x.k1, x.k2, gene")
def pseudobulk_sums(spark, sf_dir):
    x = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("k1"), F.col("o_orderstatus").alias("k2"), F.col("o_orderpriority").alias("gene"), "c_custkey", "o_totalprice")
    return rounded(tables.pseudobulk(x, ["k1", "k2"], "gene", "c_custkey", "o_totalprice"), ["total"], 2)


@query("mean_by_group_with_zeros", """
WITH cells AS (SELECT c_nationkey AS grp, count(*) AS n FROM customer GROUP BY 1), g AS (SELECT c_nationkey AS grp, o_orderpriority AS gene, sum(o_totalprice) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT g.grp, gene, round(s / n, 4) AS mean FROM g JOIN cells ON g.grp = cells.grp""")
def mean_by_group_with_zeros(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("grp"))
    v = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("grp", F.col("o_orderpriority").alias("gene"), "o_totalprice")
    return rounded(tables.mean_by_group(v, c, "grp", "gene", "o_totalprice"), ["mean"], 4)


CNT = "SELECT l_orderkey * 10 + l_linenumber AS barcode, l_partkey AS oligo, l_returnflag AS replicate, CAST(l_quantity AS BIGINT) % 9 AS dna, CAST(floor(l_extendedprice) AS BIGINT) % 23 AS rna FROM lineitem"


CNT_COLUMNS = ["l_orderkey * 10 + l_linenumber AS barcode", "l_partkey AS oligo", "l_returnflag AS replicate", "CAST(l_quantity AS BIGINT) % 9 AS dna", "CAST(floor(l_extendedprice) AS BIGINT) % 23 AS rna"]


def counts(spark, sf_dir, placed=False):
    x = lines(spark, sf_dir)
    return x.withColumn("place", place()).selectExpr("place", *CNT_COLUMNS) if placed else x.selectExpr(*CNT_COLUMNS)


@query("merge_counts_cpm_ratio", f"""
WITH c AS (SELECT barcode, sum(dna) AS dna, sum(rna) AS rna FROM ({CNT}) GROUP BY barcode), a AS (SELECT barcode, min(oligo) AS oligo FROM ({CNT}) GROUP BY barcode HAVING count(*) = 1), k AS (SELECT oligo, dna + 1 AS dna, rna FROM c JOIN a ON c.barcode = a.barcode WHERE dna >= 0 AND rna >= 2), t AS (SELECT sum(dna) AS d, sum(rna) AS r FROM k),
p AS (SELECT oligo, count(*) AS n_bc, CAST(sum(dna) AS BIGINT) AS dna, CAST(sum(rna) AS BIGINT) AS rna FROM k GROUP BY oligo)
SELECT oligo, n_bc, dna, rna, round(dna / n_bc / d * 1e6, 4) AS dna_normalized, round(rna / n_bc / r * 1e6, 4) AS rna_normalized, round((rna / r) / (dna / d), 6) AS ratio, round(log2((rna / r) / (dna / d)), 6) AS log2_ratio FROM p, t""")
def merge_counts_cpm_ratio(spark, sf_dir):
    c = counts(spark, sf_dir)
    out = tables.merged_counts(c.groupBy("barcode").agg(F.sum("dna").alias("dna"), F.sum("rna").alias("rna")), c, 0, 2)
    return rounded(rounded(out, ["ratio", "log2_ratio"]), ["dna_normalized", "rna_normalized"], 4)


@query("drop_all_duplicates", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS seen FROM lineitem) WHERE seen = 1")
def drop_all_duplicates(spark, sf_dir):
    return tables.unique_rows(lines(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


REP = f"SELECT oligo, replicate, sum(dna) + 1 AS dna, sum(rna) + 1 AS rna, count(*) AS n_bc FROM ({CNT}) GROUP BY oligo, replicate"


def replicates(spark, sf_dir):
    x = counts(spark, sf_dir).groupBy("oligo", "replicate").agg((F.sum("dna") + 1).alias("dna"), (F.sum("rna") + 1).alias("rna"), F.count(F.lit(1)).alias("n_bc"))
    return x.withColumn("log2_ratio", F.when(F.col("n_bc") > 4, F.log2(F.col("rna") / F.col("dna"))).otherwise(float("nan")))


@query("combine_replicates", f"WITH r AS ({REP}), t AS (SELECT sum(dna) AS d, sum(rna) AS n FROM r) SELECT oligo, count(*) AS replicates, round(log2((sum(rna) / any_value(n)) / (sum(dna) / any_value(d))), 6) AS pooled, round(avg(CASE WHEN n_bc > 4 THEN log2(rna / dna) END), 6) AS averaged FROM r, t GROUP BY oligo")
def combine_replicates(spark, sf_dir):
    return rounded(tables.combined_replicates(replicates(spark, sf_dir)), ["pooled", "averaged"])


@query("master_table_threshold", f"SELECT replicate, count(*) AS oligos, count_if(n_bc >= 10) AS kept, round(avg(n_bc), 6) AS mean_bc, round(avg(n_bc) FILTER (WHERE n_bc >= 10), 6) AS mean_bc_kept FROM ({REP}) GROUP BY replicate")
def master_table_threshold(spark, sf_dir):
    return rounded(tables.master_table(replicates(spark, sf_dir), 10), ["mean_bc", "mean_bc_kept"])


@query("assignment_filter", """
WITH c AS (SELECT l_orderkey AS bc, 'o' || l_suppkey % 3 AS oligo, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY bc) AS total, row_number() OVER (PARTITION BY bc ORDER BY n DESC, oligo DESC) AS rn FROM c)
SELECT bc AS barcode, oligo, n || '/' || CAST(total AS BIGINT) AS support FROM s WHERE rn = 1 AND total >= 3 AND n >= 3 AND n / total >= 0.6e0""")
def assignment_filter(spark, sf_dir):
    return tables.agreed_assignment(lines(spark, sf_dir).select(F.col("l_orderkey").alias("barcode"), F.concat(F.lit("o"), (F.col("l_suppkey") % 3).cast("string")).alias("oligo")), 3, 0.6)


@query("assignment_statistics", "SELECT n_bc, count(*) AS oligos FROM (SELECT l_partkey, count(DISTINCT l_suppkey) AS n_bc FROM lineitem GROUP BY l_partkey) GROUP BY n_bc")
def assignment_statistics(spark, sf_dir):
    return tables.barcode_distribution(lines(spark, sf_dir).selectExpr("l_partkey AS oligo", "l_suppkey AS barcode"))


@query("lincoln_index", f"""
WITH s AS (SELECT DISTINCT oligo AS bc, replicate AS r FROM ({CNT}) WHERE dna > 0 AND rna > 0), n AS (SELECT r, count(*) AS n FROM s GROUP BY r)
SELECT a.r AS a, b.r AS b, any_value(x.n) AS n_a, any_value(y.n) AS n_b, count(*) AS shared, round(any_value(x.n) * any_value(y.n) / count(*), 4) AS lincoln FROM s a JOIN s b ON a.bc = b.bc AND a.r < b.r JOIN n x ON x.r = a.r JOIN n y ON y.r = b.r GROUP BY a.r, b.r""")
def lincoln_index(spark, sf_dir):
    return rounded(tables.shared_barcodes(counts(spark, sf_dir).drop("barcode").withColumnRenamed("oligo", "barcode")), ["lincoln"], 4)


@query("barcode_matrix_pivot", f"""
SELECT oligo AS barcode, {', '.join(f"CAST(sum(CASE WHEN replicate = '{r}' THEN {m} ELSE 0 END) AS BIGINT) AS {m}_{r}" for m in ('dna', 'rna') for r in 'AN')} FROM ({CNT}) GROUP BY oligo""")
def barcode_matrix_pivot(spark, sf_dir):
    return tables.barcode_matrix(counts(spark, sf_dir).drop("barcode").withColumnRenamed("oligo", "barcode"), ["A", "N"])


@query("oligo_outliers_z", f"""
WITH c AS ({CNT}), z AS (SELECT barcode, oligo, replicate, rna, (rna - avg(rna) OVER w) / coalesce(nullif(stddev_samp(rna) OVER w, 0), 1) AS z FROM c WHERE dna + rna > 0 WINDOW w AS (PARTITION BY replicate, oligo)) SELECT barcode, oligo, replicate, rna, round(z, 6) AS z FROM z WHERE abs(z) > 1.5e0""")
def oligo_outliers_z(spark, sf_dir):
    return rounded(tables.within_oligo_outliers(counts(spark, sf_dir, placed=True), 1.5, "place").where("outlier").select("barcode", "oligo", "replicate", "rna", "z"), ["z"])


@query("global_outliers_z", f"WITH c AS (SELECT * FROM ({CNT}) WHERE dna + rna > 0), m AS (SELECT replicate, avg(rna) AS mu, stddev_samp(rna) AS sd FROM c GROUP BY 1) SELECT c.replicate, count(*) AS n, count_if(sd > 0 AND abs(rna - mu) > 1.5e0 * sd) AS outliers FROM c JOIN m ON c.replicate = m.replicate GROUP BY c.replicate")
def global_outliers_z(spark, sf_dir):
    return tables.global_outliers(counts(spark, sf_dir), 1.5)


@query("z_filtered_barcodes", f"WITH c AS ({CNT}), m AS (SELECT oligo, avg(rna) AS mu, stddev_samp(rna) AS sd FROM c GROUP BY 1) SELECT barcode, c.oligo, replicate, dna, rna FROM c JOIN m ON c.oligo = m.oligo WHERE sd > 0 AND abs(rna - mu) <= 1.2e0 * sd")
def z_filtered_barcodes(spark, sf_dir):
    return tables.z_filter(counts(spark, sf_dir, placed=True), 1.2, "place").drop("place")


@query("mad_outliers", f"""
WITH c AS (SELECT *, CASE WHEN rna > 0 AND dna > 0 THEN log2(dna / rna) WHEN rna > 0 THEN CAST('-inf' AS DOUBLE) END AS r, CASE WHEN rna > 0 THEN log10(rna) END AS l FROM ({CNT})), m AS (SELECT oligo, median(r) AS m FROM c WHERE r IS NOT NULL GROUP BY oligo), d AS (SELECT c.*, r - m.m AS d FROM c JOIN m ON c.oligo = m.oligo),
q AS (SELECT quantile_cont(l, [0, 0.25, 0.5, 0.75]) AS e FROM d), b AS (SELECT d.*, CASE WHEN l = e[1] THEN 1 ELSE len(list_filter(e, lambda x: x < l)) END AS b FROM d, q WHERE l <= e[4]), w AS (SELECT b, median(abs(d)) AS mad FROM b WHERE isfinite(d) AND b >= 1 GROUP BY b)
SELECT barcode, oligo, replicate, dna, rna FROM b JOIN w ON b.b = w.b WHERE d <= 2 * mad""")
def mad_outliers(spark, sf_dir):
    return tables.mad_filter(counts(spark, sf_dir), 4, 2.0)


@query("large_expression_outliers", f"""
WITH c AS (SELECT * FROM ({CNT}) WHERE dna + rna > 0), t AS (SELECT replicate, sum(dna) + count(*) AS d, sum(rna) + count(*) AS r FROM c GROUP BY 1), v AS (SELECT barcode, oligo, log2(sum((rna + 1) / r) / sum((dna + 1) / d)) AS v FROM c JOIN t ON c.replicate = t.replicate GROUP BY 1, 2), m AS (SELECT oligo, median(v) AS m FROM v GROUP BY 1)
SELECT barcode, v.oligo, round(v - m, 6) AS above FROM v JOIN m ON v.oligo = m.oligo WHERE round(v - m, 9) > 1""")
def large_expression_outliers(spark, sf_dir):
    return rounded(tables.expression_outliers(counts(spark, sf_dir), 1.0), ["above"])


@query("replicate_correlation", """
WITH r AS (SELECT l_partkey AS k, l_returnflag AS rep, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2) SELECT a.rep AS a, b.rep AS b, count(*) AS n, round(corr(a.x, b.x), 6) AS r FROM r a JOIN r b ON a.k = b.k AND a.rep < b.rep GROUP BY a.rep, b.rep""")
def replicate_correlation(spark, sf_dir):
    x = lines(spark, sf_dir).groupBy(F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("rep")).agg(F.sum("l_extendedprice").alias("x"))
    return rounded(tables.pairwise_correlation(x, "k", "rep", "x"), ["r"])


@query("replicate_rank_correlation", """
WITH r AS (SELECT l_partkey AS k, l_returnflag AS rep, count(*) AS x FROM lineitem GROUP BY 1, 2), p AS (SELECT a.rep AS a, b.rep AS b, a.x AS x, b.x AS y FROM r a JOIN r b ON a.k = b.k AND a.rep < b.rep),
z AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS ry FROM p) SELECT a, b, count(*) AS n, round(corr(rx, ry), 6) AS r FROM z GROUP BY a, b""")
def replicate_rank_correlation(spark, sf_dir):
    x = lines(spark, sf_dir).groupBy(F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("rep")).agg(F.count(F.lit(1)).alias("x"))
    return rounded(tables.pairwise_correlation(x, "k", "rep", "x", True), ["r"])


@query("sort_gradient_score", """
WITH b AS (SELECT l_partkey AS guide, l_linenumber AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT bin, sum(n) AS t FROM b GROUP BY bin), f AS (SELECT guide, b.bin, n, n / t AS f FROM b JOIN t ON b.bin = t.bin), g AS (SELECT guide, sum(n) AS reads, sum(f) AS s FROM f GROUP BY guide HAVING sum(n) >= 5),
x AS (SELECT g.guide, k.bin, coalesce(f.f, 0) / s * reads + 0.5e0 AS c, reads, s, f.f FROM g CROSS JOIN (SELECT unnest(range(1, 8)) AS bin) k LEFT JOIN f ON f.guide = g.guide AND f.bin = k.bin)
SELECT guide, CAST(any_value(reads) AS BIGINT) AS reads, round(sum(bin * f) / any_value(s), 6) AS score, round((sum(bin * bin * c) / sum(c) - (sum(bin * c) / sum(c)) ** 2) / (any_value(reads) + 3.5e0), 8) AS variance FROM x GROUP BY guide""")
def sort_gradient_score(spark, sf_dir):
    c = lines(spark, sf_dir).groupBy(F.col("l_partkey").alias("guide"), F.col("l_linenumber").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(rounded(tables.gradient_scores(c, 7, 5), ["score"]), ["variance"], 8)


@query("mean_centred_controls", """
WITH c AS (SELECT avg(value) AS c, count(*) AS n FROM events WHERE event_type = 'view'), m AS (SELECT median(value) AS m FROM events) SELECT event_type, count(*) AS n, round(avg(value - CASE WHEN c.n >= 5 THEN c ELSE m END), 6) AS centred FROM events, c, m GROUP BY event_type""")
def mean_centred_controls(spark, sf_dir):
    out = tables.centred(table(spark, sf_dir, "events").select("event_type", "value"), "value", F.col("event_type") == "view")
    return rounded(out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("centred").alias("centred")), ["centred"])


@query("tail_screen", """
WITH c AS (SELECT l_partkey AS guide, l_linestatus AS replicate, count_if(l_linenumber <= 2) AS lo, count_if(l_linenumber >= 6) AS hi FROM lineitem GROUP BY 1, 2), t AS (SELECT replicate, sum(lo) AS l, sum(hi) AS h FROM c GROUP BY 1)
SELECT guide, c.replicate, lo, hi, round(log2(((lo + 0.5e0) / l) / ((hi + 0.5e0) / h)), 6) AS lfc FROM c JOIN t ON c.replicate = t.replicate WHERE lo + hi >= 5""")
def tail_screen(spark, sf_dir):
    c = lines(spark, sf_dir).groupBy(F.col("l_partkey").alias("guide"), F.col("l_linestatus").alias("replicate")).agg(F.count_if(F.col("l_linenumber") <= 2).alias("lo"), F.count_if(F.col("l_linenumber") >= 6).alias("hi"))
    return rounded(tables.tail_scores(c, 5), ["lfc"])


SCREEN = "SELECT l_partkey AS guide, l_linestatus AS condition, l_returnflag AS replicate, sum(l_quantity) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL"


def screen(spark, sf_dir):
    return lines(spark, sf_dir).where("l_returnflag <> 'N'").groupBy(F.col("l_partkey").alias("guide"), F.col("l_linestatus").alias("condition"), F.col("l_returnflag").alias("replicate")).agg(F.sum("l_quantity").alias("n"))


@query("rpm_log_fold_change", f"WITH c AS ({SCREEN}), v AS (SELECT *, log2(n * 1e6 / sum(n) OVER (PARTITION BY condition, replicate) + 1) AS v FROM c) SELECT guide, replicate, round(max(v) FILTER (WHERE condition = 'F') - max(v) FILTER (WHERE condition = 'O'), 6) AS lfc FROM v GROUP BY guide, replicate")
def rpm_log_fold_change(spark, sf_dir):
    return rounded(tables.fold_changes(screen(spark, sf_dir), "F", "O"), ["lfc"])


@query("outlier_guides", f"WITH c AS ({SCREEN}), v AS (SELECT *, n * 1e6 / sum(n) OVER (PARTITION BY condition, replicate) AS rpm FROM c), m AS (SELECT guide, condition, median(rpm) AS m FROM v GROUP BY 1, 2) SELECT v.guide, v.condition, replicate, round(rpm, 4) AS rpm FROM v JOIN m ON v.guide = m.guide AND v.condition = m.condition WHERE rpm > 1.2e0 * m AND rpm > 400")
def outlier_guides(spark, sf_dir):
    return rounded(tables.loud_guides(screen(spark, sf_dir), 1.2, 400), ["rpm"], 4)


@query("matrix_stats", "SELECT count(*) AS nnz, (SELECT count(*) FROM part) * 7 - count(*) AS zeros, least(min(v), 0) AS lo, max(v) AS hi, round(sum(v), 4) AS total, count_if(v <> floor(v)) AS fractional FROM (SELECT l_partkey, l_linenumber, sum(l_quantity) / 4 AS v FROM lineitem GROUP BY 1, 2) WHERE v <> 0")
def matrix_stats(spark, sf_dir):
    x = lines(spark, sf_dir).groupBy("l_partkey", "l_linenumber").agg((F.sum("l_quantity") / 4).alias("v"))
    return rounded(tables.matrix_stats(x, "v", table(spark, sf_dir, "part").count(), 7), ["total"], 4)


@query("gene_flags", "SELECT o_custkey AS cell, bool_or(l_returnflag = 'A' AND l_tax > 0) AS has_A, bool_or(l_returnflag = 'N' AND l_tax > 0) AS has_N FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey")
def gene_flags(spark, sf_dir):
    x = lines(spark, sf_dir).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("cell"), F.col("l_returnflag").alias("gene"), F.col("l_tax").alias("value"))
    return tables.gene_flags(x, ["A", "N"])


@query("balanced_strata", "WITH s AS (SELECT c_nationkey AS n, c_mktsegment AS m FROM customer GROUP BY 1, 2 HAVING count(DISTINCT c_custkey // 4) > 1) SELECT c_nationkey, c_mktsegment, count(*) AS kept FROM customer JOIN s ON c_nationkey = n AND c_mktsegment = m GROUP BY 1, 2")
def balanced_strata(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("donor", F.floor(F.col("c_custkey") / 4))
    return tables.balanced(c, ["c_nationkey", "c_mktsegment"], "donor").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("kept"))


@query("replicated_hits", "WITH d AS (SELECT l_returnflag AS s, count(DISTINCT l_linenumber) AS donors FROM lineitem GROUP BY 1), h AS (SELECT l_returnflag AS s, l_partkey AS gene, count(DISTINCT l_linenumber) AS seen FROM lineitem WHERE l_quantity > 20 GROUP BY 1, 2) SELECT h.s AS stratum, gene, seen, donors FROM h JOIN d ON h.s = d.s WHERE seen / donors >= 0.5e0")
def replicated_hits(spark, sf_dir):
    x = lines(spark, sf_dir).selectExpr("l_returnflag AS stratum", "l_partkey AS gene", "l_linenumber AS donor", "l_quantity")
    return tables.replicated(x.where("l_quantity > 20"), x, "stratum", "gene", "donor", 0.5)


@query("cell_type_prevalence", "SELECT l_partkey AS gene, count_if(x > 30) AS n FROM (SELECT l_partkey, l_linenumber, avg(l_quantity) AS x FROM lineitem GROUP BY 1, 2) GROUP BY l_partkey")
def cell_type_prevalence(spark, sf_dir):
    return tables.prevalence(lines(spark, sf_dir).groupBy(F.col("l_partkey").alias("gene"), "l_linenumber").agg(F.avg("l_quantity").alias("x")), "gene", "x", 30)


@query("evidence_rank", "SELECT l_partkey AS variant, count(DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_suppkey END) AS n_assays, count(*) AS n_edges, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS kinds FROM lineitem GROUP BY 1 HAVING count(DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_suppkey END) >= 4")
def evidence_rank(spark, sf_dir):
    return tables.evidence_rank(lines(spark, sf_dir).selectExpr("l_partkey AS variant", "l_suppkey AS assay", "l_returnflag AS kind"), "variant", "assay", "kind", ["N"], 4)


@query("trait_enrichment_ratio", """
WITH h AS (SELECT p_partkey FROM part WHERE p_size > 35), c AS (SELECT l_suppkey AS trait, l_partkey IN (SELECT p_partkey FROM h) AS hit FROM lineitem), tot AS (SELECT count(*) AS n, count_if(hit) AS hits FROM c), t AS (SELECT trait, count(*) AS cat, count_if(hit) AS a FROM c GROUP BY trait HAVING count_if(hit) >= 3)
SELECT trait, a, cat - a AS b, hits - a AS c, n - cat - (hits - a) AS d, round(a / greatest(cat * hits / n, 0.01e0), 6) AS enrichment FROM t, tot""")
def trait_enrichment_ratio(spark, sf_dir):
    hits = table(spark, sf_dir, "part").where("p_size > 35").selectExpr("p_partkey AS item")
    out = tables.trait_enrichment(hits, lines(spark, sf_dir).selectExpr("l_suppkey AS trait", "l_partkey AS item"), "trait", "item", 3)
    return rounded(out.drop("p", "q"), ["enrichment"])


@query("cpm_welch_statistic", """
WITH lib AS (SELECT l_orderkey, sum(l_quantity) AS size FROM lineitem GROUP BY 1), x AS (SELECT l_partkey AS gene, l_linestatus AS g, log2(l_quantity / size * 1e6 + 1) AS v FROM lineitem JOIN lib USING (l_orderkey)), m AS (SELECT gene, count_if(g = 'F') AS na, count_if(g = 'O') AS nb, avg(v) FILTER (WHERE g = 'F') AS ma, avg(v) FILTER (WHERE g = 'O') AS mb, var_samp(v) FILTER (WHERE g = 'F') AS va, var_samp(v) FILTER (WHERE g = 'O') AS vb FROM x GROUP BY gene)
SELECT gene, na, nb, round(mb - ma, 6) AS log2fc, round((mb - ma) / sqrt(va / na + vb / nb), 4) AS t FROM m WHERE na >= 2 AND nb >= 2""")
def cpm_welch_statistic(spark, sf_dir):
    x = lines(spark, sf_dir)
    lib = x.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("size"))
    v = x.join(lib, "l_orderkey").select(F.col("l_partkey").alias("gene"), F.col("l_linestatus").alias("grp"), F.log2(F.col("l_quantity") / F.col("size") * 1e6 + 1).alias("v"))
    return rounded(rounded(tables.welch_by_gene(v, "gene", "grp", "F", "O", "v").drop("p", "q"), ["log2fc"]), ["t"], 4)


@query("paired_skew_statistic", """
WITH r AS (SELECT l_partkey AS variant, l_returnflag AS replicate, log2(sum(l_quantity) FILTER (WHERE l_linestatus = 'F') + 1) AS ref, log2(sum(l_quantity) FILTER (WHERE l_linestatus = 'O') + 1) AS alt FROM lineitem GROUP BY 1, 2), d AS (SELECT variant, count(*) AS n, avg(alt - ref) AS skew, stddev_samp(alt - ref) / sqrt(count(*)) AS se FROM r WHERE ref IS NOT NULL AND alt IS NOT NULL GROUP BY 1)
SELECT variant, n, round(skew, 6) AS skew, round(se, 6) AS se, round(CASE WHEN se > 0 THEN skew / se END, 4) AS t FROM d""")
def paired_skew_statistic(spark, sf_dir):
    side = lambda s: F.log2(F.sum(F.when(F.col("l_linestatus") == s, F.col("l_quantity"))) + 1)
    r = lines(spark, sf_dir).groupBy(F.col("l_partkey").alias("variant"), F.col("l_returnflag").alias("replicate")).agg(side("F").alias("ref"), side("O").alias("alt"))
    return rounded(rounded(tables.paired_skew(r).drop("p", "q"), ["skew", "se"]), ["t"], 4)


@query("facet_counts", "SELECT 'o_orderstatus' AS facet, o_orderstatus AS term, count(*) AS n FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority")
def facet_counts(spark, sf_dir):
    return tables.facets(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("faceted_search", "WITH k AS (SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 200000), t AS (SELECT o_orderkey FROM k ORDER BY o_totalprice DESC, o_orderkey LIMIT 25) SELECT 'hit' AS facet, CAST(o_orderkey AS VARCHAR) AS term, 1 AS n FROM t UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM k GROUP BY o_orderpriority")
def faceted_search(spark, sf_dir):
    hits, facets = tables.faceted_search(table(spark, sf_dir, "orders"), "o_orderstatus=F, O;o_totalprice=gte:200000", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 25, ["o_orderpriority"])
    return hits.select(F.lit("hit").alias("facet"), F.col("o_orderkey").cast("string").alias("term"), F.lit(1).cast("long").alias("n")).unionByName(facets)


@query("unique_name_map", "WITH x AS (SELECT p_name AS name, CAST(p_partkey AS VARCHAR) AS id, 'part' AS source FROM part UNION ALL SELECT s_name, CAST(s_suppkey AS VARCHAR), 'supplier' FROM supplier) SELECT name, min(id) AS id, min(source) AS source FROM x GROUP BY name HAVING count(*) = 1")
def unique_name_map(spark, sf_dir):
    return tables.named_once({"part": (table(spark, sf_dir, "part"), "p_name", "p_partkey"), "supplier": (table(spark, sf_dir, "supplier"), "s_name", "s_suppkey")})


@query("compare_outputs_full_join", """
WITH a AS (SELECT nullif(o_custkey % 40, 0) AS k, o_orderstatus AS s, sum(o_totalprice) AS x FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2), b AS (SELECT nullif(o_custkey % 41, 0) AS k, o_orderstatus AS s, sum(o_totalprice) AS x FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2)
SELECT count_if(b.s IS NULL) AS left_only, count_if(a.s IS NULL) AS right_only, count_if(abs(a.x - b.x) <= 1e6) AS equal, count_if(abs(a.x - b.x) > 1e6) AS differs FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k AND a.s = b.s""")
def compare_outputs_full_join(spark, sf_dir):
    of = lambda where, n: table(spark, sf_dir, "orders").where(where).groupBy(F.nullif(F.col("o_custkey") % n, F.lit(0)).alias("k"), F.col("o_orderstatus").alias("s")).agg(F.sum("o_totalprice").alias("x"))
    return tables.joined_outputs(of("o_orderstatus <> 'P'", 40), of("o_orderpriority <> '5-LOW'", 41), ["k", "s"], "x", 1e6)


@query("score_thresholds", "WITH q AS (SELECT quantile_cont(l_extendedprice, [0, 0.25, 0.5, 0.75, 1]) AS q, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), t AS (SELECT unnest(q) AS t FROM q UNION SELECT lo + (hi - lo) * unnest([0, 0.25, 0.5, 0.75, 1]) FROM q) SELECT round(t, 4) AS threshold FROM t")
def score_thresholds(spark, sf_dir):
    found = tables.threshold_span(lines(spark, sf_dir), "l_extendedprice", 4)
    return spark.createDataFrame([(round(t, 4),) for t in found], "threshold double")
