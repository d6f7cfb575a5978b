"""Screens, cells and count tables over lineitem, orders, customer and events, by the operators of screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import ordered, screens
from lodestar.plans.registry import query
from lodestar.session import table


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


BC = "SELECT l_orderkey AS barcode, l_partkey AS oligo, l_returnflag AS replicate, CAST(l_quantity AS BIGINT) % 7 AS dna, CAST(floor(l_extendedprice) AS BIGINT) % 5 AS rna FROM lineitem"


def barcodes(spark, sf_dir):
    return lines(spark, sf_dir).selectExpr("l_orderkey AS barcode", "l_partkey AS oligo", "l_returnflag AS replicate", "CAST(l_quantity AS BIGINT) % 7 AS dna", "CAST(floor(l_extendedprice) AS BIGINT) % 5 AS rna")


@query("replicate_totals", f"SELECT replicate, CAST(sum(dna) AS BIGINT) AS dna_total, CAST(sum(rna) AS BIGINT) AS rna_total, count_if(dna + rna > 0) AS observed, round(avg(rna) FILTER (WHERE dna + rna > 0), 8) AS mean_rna, round(stddev_samp(rna) FILTER (WHERE dna + rna > 0), 8) AS sd_rna FROM ({BC}) GROUP BY replicate")
def replicate_totals(spark, sf_dir):
    return screens.replicate_totals(barcodes(spark, sf_dir)).withColumns({c: F.round(c, 8) for c in ("mean_rna", "sd_rna")})


@query("barcode_activity", f"""
WITH b AS ({BC}), t AS (SELECT replicate, sum(dna) + count_if(dna + rna > 0) AS d, sum(rna) + count_if(dna + rna > 0) AS r FROM b GROUP BY replicate)
SELECT barcode, oligo, b.replicate, round(CASE WHEN dna + rna > 0 THEN log2(((rna + 1) / r) / ((dna + 1) / d)) END, 6) AS activity FROM b JOIN t ON b.replicate = t.replicate""")
def barcode_activity(spark, sf_dir):
    return screens.barcode_activity(barcodes(spark, sf_dir)).select("barcode", "oligo", "replicate", F.round("activity", 6).alias("activity"))


SNP = "SELECT l_partkey AS snp, CASE WHEN l_linestatus = 'F' THEN 'ref' ELSE 'B' END AS allele, l_returnflag AS replicate, count(*) AS dna, CAST(sum(l_quantity) AS BIGINT) AS rna FROM lineitem GROUP BY ALL"


@query("allelic_skew", f"""
WITH x AS (SELECT *, dna + 0.5e0 AS d, rna + 0.5e0 AS r FROM ({SNP})), t AS (SELECT replicate, sum(d) AS td, sum(r) AS tr FROM x GROUP BY replicate),
a AS (SELECT snp, allele, avg(ln((r / tr) / (d / td))) AS m FROM x JOIN t ON x.replicate = t.replicate GROUP BY snp, allele)
SELECT x.snp, round(x.m, 6) AS ref, round(y.m, 6) AS alt, round(y.m - x.m, 6) AS skew FROM a x JOIN a y ON x.snp = y.snp AND x.allele = 'ref' AND y.allele = 'B'""")
def allelic_skew(spark, sf_dir):
    c = lines(spark, sf_dir).groupBy(F.col("l_partkey").alias("snp"), F.when(F.col("l_linestatus") == "F", "ref").otherwise("B").alias("allele"), F.col("l_returnflag").alias("replicate")).agg(F.count(F.lit(1)).alias("dna"), F.sum("l_quantity").cast("long").alias("rna"))
    a = screens.fragment_activity(c.withColumn("fragment", F.concat_ws("_", F.col("snp").cast("string"), "allele")))
    return screens.allelic_skew(a).select("snp", *(F.round(c, 6).alias(c) for c in ("ref", "alt", "skew")))


@query("variant_table", """
WITH c AS (SELECT l_partkey AS oligo, avg(l_quantity) AS ratio, count(*) AS n_bc FROM lineitem WHERE l_partkey % 4 > 0 GROUP BY l_partkey), d AS (SELECT p_partkey AS id, p_partkey AS ref, p_partkey + 1 AS alt FROM part)
SELECT d.id, d.ref, d.alt, round(coalesce(a.ratio, 0), 8) AS ratio_ref, CAST(coalesce(a.n_bc, 0) AS DOUBLE) AS n_bc_ref, round(coalesce(b.ratio, 0), 8) AS ratio_alt, CAST(coalesce(b.n_bc, 0) AS DOUBLE) AS n_bc_alt, round(log2(b.ratio / a.ratio), 6) AS log2_skew FROM d LEFT JOIN c a ON d.ref = a.oligo LEFT JOIN c b ON d.alt = b.oligo""")
def variant_table(spark, sf_dir):
    c = lines(spark, sf_dir).where("l_partkey % 4 > 0").groupBy(F.col("l_partkey").alias("oligo")).agg(F.avg("l_quantity").alias("ratio"), F.count(F.lit(1)).alias("n_bc"))
    d = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_partkey AS ref", "p_partkey + 1 AS alt")
    out = screens.variant_table(c, d, ["ratio", "n_bc"])
    return out.withColumns({"ratio_ref": F.round("ratio_ref", 8), "ratio_alt": F.round("ratio_alt", 8), "log2_skew": F.round("log2_skew", 6)})


@query("aggregate_lfcs", "SELECT l_partkey, CASE WHEN count(*) = count(CASE WHEN l_quantity < 49 THEN l_tax END) THEN round(stddev_pop(l_tax), 8) END AS lfc FROM lineitem GROUP BY l_partkey")
def aggregate_lfcs(spark, sf_dir):
    x = lines(spark, sf_dir).select("l_partkey", F.when(F.col("l_quantity") < 49, F.col("l_tax")).otherwise(float("nan")).alias("lfc"))
    return screens.aggregate_lfcs(x, "l_partkey", "lfc", "sd").withColumn("lfc", F.round("lfc", 8))


@query("add_screens", "SELECT l_partkey, l_linenumber, CAST(2 * sum(l_quantity) + count(*) AS DOUBLE) AS n FROM lineitem GROUP BY l_partkey, l_linenumber")
def add_screens(spark, sf_dir):
    g = lines(spark, sf_dir).groupBy("l_partkey", "l_linenumber")
    return screens.add_screens(g.agg(F.sum("l_quantity").alias("n")), g.agg((F.sum("l_quantity") + F.count(F.lit(1))).alias("n")), ["l_partkey", "l_linenumber"], "n")


@query("element_scores", """
WITH g AS (SELECT l_partkey AS element, floor(l_extendedprice / 100) AS score FROM lineitem WHERE l_returnflag <> 'N'), c AS (SELECT floor(l_extendedprice / 100) AS score FROM lineitem WHERE l_returnflag = 'N'),
cc AS (SELECT score, count(*) AS c FROM c GROUP BY score), r AS (SELECT score, c, sum(c) OVER (ORDER BY score) - c AS below FROM cc), k AS (SELECT count(*) AS nc, avg(score) AS mc, var_samp(score) AS vc FROM c),
m AS (SELECT element, count(*) AS n, avg(score) AS m, var_samp(score) AS v FROM g GROUP BY element HAVING count(*) >= 3),
u AS (SELECT g.element, sum((SELECT coalesce(max(below + c), 0) FROM r WHERE r.score < g.score) + 0.5e0 * coalesce((SELECT c FROM r WHERE r.score = g.score), 0)) AS u FROM g GROUP BY g.element)
SELECT m.element, n, round(m, 6) AS mean, round(sqrt(v / n), 6) AS sem, round((m - mc) / sqrt(((n - 1) * v + (nc - 1) * vc) / (n + nc - 2) * (1 / n + 1 / nc)), 6) AS t, u FROM m CROSS JOIN k JOIN u ON m.element = u.element""")
def element_scores(spark, sf_dir):
    """The p values have no SQL; a test compares them with counting."""
    x = lines(spark, sf_dir).select("l_returnflag", F.col("l_partkey").alias("element"), F.floor(F.col("l_extendedprice") / 100).cast("double").alias("score"))
    out = screens.element_scores(x.where("l_returnflag <> 'N'").select("element", "score"), x.where("l_returnflag = 'N'").select("score"))
    return out.select("element", "n", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"), F.round("t", 6).alias("t"), "u")


@query("effects_in_real_space", """
WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN 'negative_control' ELSE 'x' END AS target, l_quantity / 50 AS m, l_tax * 5 AS s FROM lineitem), x AS (SELECT *, 10 ** (m + s * s / 2) - 0.5e0 AS v FROM e),
c AS (SELECT median(v) AS c FROM x WHERE target = 'negative_control'), y AS (SELECT *, greatest(0, least(5, v / c)) AS w FROM x CROSS JOIN c), d AS (SELECT avg(w) AS d FROM y WHERE target = 'negative_control')
SELECT l_orderkey, l_linenumber, l_partkey, round(w / d, 6) AS effect, round(sqrt((10 ** (s * s) - 1) * (v + 0.5e0) * (v + 0.5e0)), 6) AS sd FROM y CROSS JOIN d""")
def effects_in_real_space(spark, sf_dir):
    e = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "A", "negative_control").otherwise("x").alias("target"), (F.col("l_quantity") / 50).alias("log_mean"), (F.col("l_tax") * 5).alias("log_sd"))
    return screens.to_real_space(e, 0.5).select("l_orderkey", "l_linenumber", "l_partkey", F.round("effect", 6).alias("effect"), F.round("sd", 6).alias("sd"))


FLAT = "SELECT l_partkey AS guide, l_returnflag || l_linestatus || l_linenumber % 2 AS sample, l_linestatus AS grouping, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL"


@query("guide_count_checks", f"""
WITH f AS ({FLAT}), t AS (SELECT sample, sum(n) AS t FROM f GROUP BY sample), s AS (SELECT DISTINCT sample, grouping FROM f), g AS (SELECT DISTINCT grouping, guide FROM f),
x AS (SELECT g.grouping, g.guide, s.sample, coalesce(f.n / t.t * 100, 0) AS x FROM g JOIN s ON g.grouping = s.grouping LEFT JOIN f ON f.sample = s.sample AND f.guide = g.guide LEFT JOIN t ON t.sample = f.sample)
SELECT 'r' AS kind, a.grouping, a.sample AS a, b.sample AS b, round(corr(a.x, b.x), 6) AS v FROM x a JOIN x b ON a.grouping = b.grouping AND a.guide = b.guide AND a.sample < b.sample GROUP BY a.grouping, a.sample, b.sample
UNION ALL SELECT 'cv', grouping, CAST(guide AS VARCHAR), '', round(stddev_samp(x) / avg(x) * 100, 4) FROM x GROUP BY grouping, guide HAVING count(*) >= 2""")
def guide_count_checks(spark, sf_dir):
    f = lines(spark, sf_dir).groupBy(F.col("l_partkey").alias("guide"), F.concat("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 2).cast("string")).alias("sample"), F.col("l_linestatus").alias("grouping")).agg(F.sum("l_quantity").cast("long").alias("count"))
    r, cv = screens.guide_count_checks(f.select("guide", "sample", "count"), f.select("sample", "grouping").distinct())
    one = r.select(F.lit("r").alias("kind"), "grouping", "a", "b", F.round("r", 6).alias("v"))
    return one.unionByName(cv.select(F.lit("cv").alias("kind"), "grouping", F.col("guide").cast("string").alias("a"), F.lit("").alias("b"), F.round("cv", 4).alias("v")))


@query("library_qc", """
WITH c AS (SELECT l_suppkey AS sample, l_partkey AS gene, CAST(sum(l_quantity) AS BIGINT) - 5 AS n FROM lineitem GROUP BY ALL), d AS (SELECT sample, gene, greatest(n, 0) AS n FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY n DESC, gene) AS rn FROM d)
SELECT sample, CAST(sum(n) AS BIGINT) AS library_size, count_if(n > 0) AS genes_detected, round(sum(n) FILTER (WHERE rn <= 10) / sum(n), 8) AS top10_frac FROM r GROUP BY sample""")
def library_qc(spark, sf_dir):
    c = lines(spark, sf_dir).groupBy(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("gene")).agg(F.greatest(F.sum("l_quantity").cast("long") - 5, F.lit(0)).alias("count"))
    return screens.library_qc(c).withColumn("top10_frac", F.round("top10_frac", 8))


TESTS = "SELECT l_suppkey AS guide, l_partkey % 40 AS gene, avg(l_quantity) / 10 - 3 AS lfc, min(l_tax) + 0.004e0 AS p FROM lineitem GROUP BY ALL"
GUIDES = "SELECT s_suppkey AS guide, s_nationkey AS target, s_nationkey > 3 AS targeting FROM supplier"


def tests(spark, sf_dir):
    t = lines(spark, sf_dir).groupBy(F.col("l_suppkey").alias("guide"), (F.col("l_partkey") % 40).alias("gene")).agg((F.avg("l_quantity") / 10 - 3).alias("lfc"), (F.min("l_tax") + 0.004).alias("p"))
    return t, table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS guide", "s_nationkey AS target", "s_nationkey > 3 AS targeting")


@query("knockdown_summary", f"""
WITH g AS ({GUIDES}), x AS (SELECT g.guide, t.lfc, t.p FROM g LEFT JOIN ({TESTS}) t ON t.guide = g.guide AND t.gene = g.target), f AS (SELECT *, lfc IS NOT NULL AND p IS NOT NULL AS ok, coalesce(lfc <= log2(0.7e0), false) AS st, coalesce(p < 0.03e0, false) AS sg FROM x)
SELECT count(*) AS n_guides, count_if(ok) AS n_tested, count_if(st) AS n_strong, count_if(sg) AS n_significant, count_if(st AND sg) AS n_both, round(median(lfc), 6) AS median_lfc, round(avg(lfc), 6) AS mean_lfc, round(count_if(st) / count_if(ok), 6) AS frac_strong, round(count_if(sg) / count_if(ok), 6) AS frac_significant, round(count_if(st AND sg) / count_if(ok), 6) AS frac_both FROM f""")
def knockdown_summary(spark, sf_dir):
    out = screens.knockdown_summary(*tests(spark, sf_dir), 0.7, 0.03)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if not c.startswith("n_")})


@query("trans_summary", f"""
WITH t AS ({TESTS}), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, guide, gene) AS raw FROM t), a AS (SELECT *, least(1.0, min(raw) OVER (ORDER BY p DESC, guide DESC, gene DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)
SELECT a.guide, count(*) AS n_tests, count_if(q < 0.02e0) AS n_significant, count_if(q < 0.02e0 AND lfc > 0) AS n_up, count_if(q < 0.02e0 AND lfc < 0) AS n_down, round(median(lfc), 6) AS median_lfc, round(max(abs(lfc)), 6) AS max_abs_lfc, round(count_if(q < 0.02e0) / count(*), 6) AS frac_significant
FROM a JOIN ({GUIDES}) g ON a.guide = g.guide WHERE a.gene <> g.target GROUP BY a.guide""")
def trans_summary(spark, sf_dir):
    out = screens.trans_summary(*tests(spark, sf_dir), 0.02)
    return out.withColumns({c: F.round(c, 6) for c in ("median_lfc", "max_abs_lfc", "frac_significant")})


@query("collapsed_guides", """
WITH a AS (SELECT DISTINCT l_orderkey AS cell, 'g' || l_suppkey % 30 AS guide, l_suppkey % 30 // 10 AS element FROM lineitem), k AS (SELECT cell FROM a GROUP BY cell HAVING count(DISTINCT element) <= 1 AND count(*) BETWEEN 2 AND 3)
SELECT a.cell, a.element, string_agg(guide, '|' ORDER BY guide) AS guides FROM a JOIN k ON a.cell = k.cell GROUP BY a.cell, a.element""")
def collapsed_guides(spark, sf_dir):
    a = lines(spark, sf_dir).select(F.col("l_orderkey").alias("cell"), F.concat(F.lit("g"), (F.col("l_suppkey") % 30).cast("string")).alias("guide"), F.floor((F.col("l_suppkey") % 30) / 10).alias("element")).distinct()
    return screens.collapse_guides(a, 1, 2, 3)


@query("merged_guides", "SELECT l_orderkey AS cell, 'T' || l_suppkey % 5 AS feature, sum(l_quantity) AS umi FROM lineitem GROUP BY ALL")
def merged_guides(spark, sf_dir):
    c = lines(spark, sf_dir).select(F.col("l_orderkey").alias("cell"), F.concat(F.lit("T"), (F.col("l_suppkey") % 5).cast("string"), F.lit("|"), F.col("l_linenumber").cast("string")).alias("feature"), F.col("l_quantity").alias("umi"))
    return screens.merge_guides(c, True)


@query("cell_covariates", """
WITH r AS (SELECT o_custkey AS cell, CASE WHEN o_orderpriority = '5-LOW' THEN 'mt-x' ELSE 'g' END AS gene, o_orderkey % 4 AS n FROM orders), g AS (SELECT user_id AS cell, event_id % 3 AS n FROM events),
a AS (SELECT cell, count_if(n <> 0) AS x, sum(n) AS s, coalesce(sum(n) FILTER (WHERE gene = 'mt-x'), 0) AS mt FROM r GROUP BY cell), b AS (SELECT cell, count_if(n <> 0) AS x, sum(n) AS s FROM g GROUP BY cell)
SELECT coalesce(a.cell, b.cell) AS cell, coalesce(a.x, 0) AS response_n_nonzero, CAST(coalesce(a.s, 0) AS BIGINT) AS response_n_umis, coalesce(b.x, 0) AS grna_n_nonzero, CAST(coalesce(b.s, 0) AS BIGINT) AS grna_n_umis, round(CASE WHEN a.s > 0 THEN a.mt / a.s ELSE 0 END, 8) AS response_p_mito FROM a FULL JOIN b ON a.cell = b.cell""")
def cell_covariates(spark, sf_dir):
    r = table(spark, sf_dir, "orders").selectExpr("o_custkey AS cell", "CASE WHEN o_orderpriority = '5-LOW' THEN 'mt-x' ELSE 'g' END AS gene", "o_orderkey % 4 AS n")
    g = table(spark, sf_dir, "events").selectExpr("user_id AS cell", "event_type AS guide", "event_id % 3 AS n")
    return screens.cell_covariates(r, g).withColumn("response_p_mito", F.round("response_p_mito", 8))


@query("guide_capture", "SELECT l_suppkey AS guide, count(*) AS n_cells, round(count(*) / 5000, 8) AS frac_cells, sum(l_quantity) AS total_umi, round(avg(l_quantity), 6) AS mean_umi, round(median(l_quantity), 6) AS median_umi, round(stddev_pop(l_quantity), 6) AS sd_umi, max(l_quantity) AS max_umi FROM lineitem WHERE l_quantity > 0 GROUP BY l_suppkey")
def guide_capture(spark, sf_dir):
    out = screens.guide_capture(lines(spark, sf_dir).selectExpr("l_orderkey AS cell", "l_suppkey AS guide", "l_quantity AS umi"), 5000)
    return out.withColumns({c: F.round(c, 8 if c == "frac_cells" else 6) for c in ("frac_cells", "mean_umi", "median_umi", "sd_umi")})


@query("guides_per_cell_table", """
WITH g AS (SELECT c_custkey, count(o_orderkey) AS g FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey)
SELECT count(*) AS n_cells, round(avg(g), 6) AS mean, round(stddev_samp(g), 6) AS sd, min(g) AS least, max(g) AS most, median(g) AS median, count_if(g > 0) AS with_guide, count_if(g = 1) AS with_one, round(avg(CAST(g > 0 AS INT)), 6) AS frac_with_guide FROM g""")
def guides_per_cell_table(spark, sf_dir):
    out = screens.guides_per_cell(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("cell")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell")))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "frac_with_guide")})


@query("batch_metrics", "SELECT o_orderpriority, count(*) AS n_cells, round(avg(o_totalprice), 4) AS o_totalprice_mean, round(median(o_totalprice), 4) AS o_totalprice_median, round(stddev_samp(o_totalprice), 4) AS o_totalprice_sd, min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max FROM orders GROUP BY o_orderpriority")
def batch_metrics(spark, sf_dir):
    out = screens.batch_metrics(table(spark, sf_dir, "orders"), "o_orderpriority", ["o_totalprice"])
    return out.withColumns({f"o_totalprice_{k}": F.round(f"o_totalprice_{k}", 4) for k in ("mean", "median", "sd")})


@query("measured_pairs", "SELECT DISTINCT l_partkey AS gene, l_suppkey AS guide FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def measured_pairs(spark, sf_dir):
    pairs = lines(spark, sf_dir).selectExpr("l_partkey AS gene", "l_suppkey AS guide").distinct()
    return screens.restrict_pairs(pairs, table(spark, sf_dir, "part").where("p_size > 20").selectExpr("p_partkey AS gene"), table(spark, sf_dir, "supplier").where("s_acctbal > 0").selectExpr("s_suppkey AS guide"))


@query("shared_cells", "WITH a AS (SELECT o_custkey AS cell FROM orders WHERE o_totalprice > 200000), b AS (SELECT user_id AS cell FROM events) SELECT 'a' AS side, cell, count(*) AS n FROM a WHERE cell IN (SELECT cell FROM b) GROUP BY cell UNION ALL SELECT 'b', cell, count(*) FROM b WHERE cell IN (SELECT cell FROM a) GROUP BY cell")
def shared_cells(spark, sf_dir):
    a, b = screens.shared_cells(table(spark, sf_dir, "orders").where("o_totalprice > 200000").selectExpr("o_custkey AS cell"), table(spark, sf_dir, "events").selectExpr("user_id AS cell"))
    n = lambda df, side: df.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))
    return n(a, "a").unionByName(n(b, "b"))


@query("enrichment_scores", """
WITH a AS (SELECT l_partkey AS pos, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_partkey AS pos, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 10 GROUP BY 1), x AS (SELECT coalesce(a.pos, b.pos) AS pos, coalesce(a.n, 0) AS late, coalesce(b.n, 0) AS early FROM a FULL JOIN b ON a.pos = b.pos)
SELECT pos, late, early, round(log2(((late + 1) / (SELECT sum(late) FROM x)) / ((early + 1) / (SELECT sum(early) FROM x))), 6) AS log2_enrichment FROM x WHERE late + early >= 20""")
def enrichment_scores(spark, sf_dir):
    n = lambda where: lines(spark, sf_dir).where(where).groupBy(F.col("l_partkey").alias("pos")).agg(F.count(F.lit(1)).alias("n"))
    return screens.enrichment_scores(n("l_linestatus = 'F'"), n("l_linestatus = 'O' AND l_quantity > 10"), ["pos"], 1.0, 20).withColumn("log2_enrichment", F.round("log2_enrichment", 6))


@query("network_edges_of", "SELECT DISTINCT l_suppkey AS source, l_partkey AS target, l_discount - 0.05e0 AS weight FROM lineitem WHERE abs(l_discount - 0.05e0) >= 0.03e0 AND l_suppkey = 7")
def network_edges_of(spark, sf_dir):
    return screens.network_edges(lines(spark, sf_dir).selectExpr("l_suppkey AS source", "l_partkey AS target", "l_discount - 0.05D AS weight"), "source", "weight", 0.03, 7)


@query("baseline_precision", """
WITH g AS (SELECT l_returnflag AS trait, l_orderkey AS cs, l_suppkey AS gene, max(l_extendedprice) AS s, max(l_linenumber) = 2 AS truth FROM lineitem GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY trait, cs ORDER BY CASE WHEN s > 90000 THEN NULL ELSE s END DESC NULLS LAST, gene) AS rn FROM g),
t AS (SELECT DISTINCT trait, cs, gene AS tg FROM g WHERE truth), m AS (SELECT r.trait, r.cs, r.gene, tg FROM r LEFT JOIN t ON r.trait = t.trait AND r.cs = t.cs WHERE rn <= 2), n AS (SELECT trait, count(DISTINCT cs) AS sets FROM g GROUP BY trait)
SELECT m.trait, any_value(sets) AS sets, count(DISTINCT (m.cs, gene)) AS predictions, count(DISTINCT CASE WHEN gene = tg THEN (m.cs, gene) END) AS correct, round(count(DISTINCT CASE WHEN gene = tg THEN (m.cs, gene) END) / any_value(sets), 8) AS recall, round(count(DISTINCT CASE WHEN gene = tg THEN (m.cs, gene) END) / count(DISTINCT (m.cs, gene)), 8) AS precision FROM m JOIN n ON m.trait = n.trait GROUP BY m.trait""")
def baseline_precision(spark, sf_dir):
    g = lines(spark, sf_dir).groupBy(F.col("l_returnflag").alias("trait"), F.col("l_orderkey").alias("credible_set"), F.col("l_suppkey").alias("gene")).agg(F.max("l_extendedprice").alias("s"), (F.max("l_linenumber") == 2).alias("truth"))
    out = screens.evaluate_baseline(g, F.when(F.col("s") <= 90000, F.col("s")).desc_nulls_last(), 2)
    return out.withColumns({"recall": F.round("recall", 8), "precision": F.round("precision", 8)})


@query("hallmark_coverage", """
WITH c AS (SELECT l_linenumber AS cell_type, 'g' || l_suppkey % 20 AS gene, avg(l_quantity) - 25 AS lfc FROM lineitem GROUP BY 1, 2), h AS (SELECT * FROM (VALUES ('a', 'g1'), ('a', 'g2'), ('b', 'g3'), ('c', 'g4'), ('c', 'g5')) t(hallmark, gene)), x AS (SELECT cell_type, hallmark, c.gene FROM c JOIN h ON c.gene = h.gene WHERE lfc > 0.5e0)
SELECT t.cell_type, count(DISTINCT hallmark) AS hallmarks_present, coalesce(string_agg(DISTINCT gene, ',' ORDER BY gene), '') AS genes FROM (SELECT DISTINCT cell_type FROM c) t LEFT JOIN x ON t.cell_type = x.cell_type GROUP BY t.cell_type""")
def hallmark_coverage(spark, sf_dir):
    c = lines(spark, sf_dir).groupBy(F.col("l_linenumber").alias("cell_type"), F.concat(F.lit("g"), (F.col("l_suppkey") % 20).cast("string")).alias("gene")).agg((F.avg("l_quantity") - 25).alias("lfc"))
    return screens.hallmark_coverage(c, spark.createDataFrame([("a", "g1"), ("a", "g2"), ("b", "g3"), ("c", "g4"), ("c", "g5")], "hallmark string, gene string"), 0.5)


@query("adjusted_rand_index", """
WITH c AS (SELECT c_mktsegment AS a, c_nationkey % 5 AS b, count(*) AS n FROM customer GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2) AS ab, sum(n) AS n FROM c), x AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT CAST(n AS BIGINT) AS n, round((ab - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 8) AS index FROM s, x, y""")
def adjusted_rand_index(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("a"), (F.col("c_nationkey") % 5).alias("b"))
    return screens.adjusted_rand(c, "a", "b").withColumn("index", F.round("index", 8))


@query("set_overlap_test", """
WITH h AS (SELECT DISTINCT l_partkey AS g FROM lineitem WHERE l_tax > 0.075e0 AND l_quantity > 40), bg AS (SELECT p_partkey AS g FROM part WHERE p_size > 5), m AS (SELECT DISTINCT p_brand AS s, p_partkey AS g FROM part), n AS (SELECT count(*) AS hits FROM h), b AS (SELECT count(*) AS n, count(h.g) AS hb FROM bg LEFT JOIN h ON bg.g = h.g),
x AS (SELECT m.s, count(h.g) AS a, count_if(bg.g IS NOT NULL AND h.g IS NULL) AS c, count(bg.g) AS inb FROM m LEFT JOIN h ON m.g = h.g LEFT JOIN bg ON m.g = bg.g GROUP BY m.s)
SELECT s AS p_brand, a, hits - a AS b, c, n - hb - c AS d, round(a / (hits * inb / n), 6) AS fold FROM x, n, b WHERE hits * inb > 0""")
def set_overlap_test(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    hits = lines(spark, sf_dir).where("l_tax > 0.075D AND l_quantity > 40").selectExpr("l_partkey AS p_partkey")
    out = screens.set_test(hits, p.select("p_brand", "p_partkey"), p.where("p_size > 5").select("p_partkey"), "p_partkey", "p_brand")
    return out.where("fold < double('infinity')").select("p_brand", "a", "b", "c", "d", F.round("fold", 6).alias("fold"))


@query("skew_normal_moments", """
WITH m AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem GROUP BY 1), k AS (SELECT l_returnflag AS g, avg((l_extendedprice - m) ** 3) / avg((l_extendedprice - m) ** 2) ** 1.5e0 AS sk FROM lineitem JOIN m ON l_returnflag = m.g GROUP BY 1),
d AS (SELECT m.*, greatest(-0.995e0, least(0.995e0, sign(sk) * sqrt(pi() / 2 * abs(greatest(-0.99e0, least(0.99e0, sk))) ** (2.0e0 / 3) / (abs(greatest(-0.99e0, least(0.99e0, sk))) ** (2.0e0 / 3) + ((4 - pi()) / 2) ** (2.0e0 / 3))))) AS d FROM m JOIN k ON m.g = k.g)
SELECT g AS l_returnflag, n, round(m - s / sqrt(1 - 2 * d * d / pi()) * d * sqrt(2 / pi()), 2) AS xi, round(s / sqrt(1 - 2 * d * d / pi()), 2) AS omega, round(d / sqrt(1 - d * d), 4) AS alpha FROM d""")
def skew_normal_moments(spark, sf_dir):
    out = screens.skew_normal(lines(spark, sf_dir), ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", "n", F.round("xi", 2).alias("xi"), F.round("omega", 2).alias("omega"), F.round("alpha", 4).alias("alpha"))


@query("robust_rank_rho")  # beta probabilities have no SQL; a test compares them with binomial sums
def robust_rank_rho(spark, sf_dir):
    r = ordered.value_ranks(lines(spark, sf_dir), "l_extendedprice")
    x = lines(spark, sf_dir).join(r, "l_extendedprice")
    return screens.robust_rank(x.select("l_partkey", (F.col("avg_rank") / lines(spark, sf_dir).count()).alias("r")), "l_partkey", "r")


@query("auroc", """
WITH r AS (SELECT o_orderstatus = 'F' AS y, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0e0 AS r FROM orders)
SELECT count_if(y) AS pos, count_if(NOT y) AS neg, round((sum(CASE WHEN y THEN r ELSE 0 END) - count_if(y) * (count_if(y) + 1) / 2) / (count_if(y) * count_if(NOT y)), 8) AS auc FROM r""")
def auroc(spark, sf_dir):
    out = ordered.auroc(table(spark, sf_dir, "orders").select("o_totalprice", (F.col("o_orderstatus") == "F").alias("y")), "o_totalprice", "y")
    return out.select(F.col("n_pos").alias("pos"), F.col("n_neg").alias("neg"), F.round("auroc", 8).alias("auc"))


@query("ranksum_u_stat", """
WITH r AS (SELECT event_type = 'view' AS grp, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0e0 AS r FROM (SELECT event_type, floor(value) AS value FROM events)),
s AS (SELECT count_if(grp) AS n1, count_if(NOT grp) AS n2, sum(CASE WHEN grp THEN r ELSE 0 END) AS r1 FROM r)
SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, round((r1 - n1 * (n1 + 1) / 2) / n1 / n2, 8) AS auc FROM s""")
def ranksum_u_stat(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.floor("value").cast("double").alias("v"), (F.col("event_type") == "view").alias("y"))
    out = ordered.auroc(e, "v", "y")
    return out.select(F.col("n_pos").alias("n1"), F.col("n_neg").alias("n2"), F.round(F.col("auroc") * F.col("n_pos") * F.col("n_neg"), 1).alias("u"), F.round("auroc", 8).alias("auc"))


@query("precision_recall_curve", """
WITH t AS (SELECT CAST(floor(o_totalprice / 5000) AS BIGINT) AS score, count(*) AS n, count_if(o_orderstatus = 'F') AS pos FROM orders GROUP BY 1),
c AS (SELECT score, sum(n) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS k, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(pos) OVER () AS total FROM t)
SELECT score AS threshold, round(tp / k, 8) AS precision_at, round(tp / total, 8) AS recall_at FROM c""")
def precision_recall_curve(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_totalprice") / 5000).alias("threshold"), (F.col("o_orderstatus") == "F").alias("y"))
    return ordered.precision_recall(o, "threshold", "y").select("threshold", F.round("precision", 8).alias("precision_at"), F.round("recall", 8).alias("recall_at"))


@query("average_precision", """
WITH s AS (SELECT o_orderkey, o_totalprice AS score, CAST(o_orderstatus = 'F' AS INT) AS y FROM orders),
c AS (SELECT *, row_number() OVER (ORDER BY score DESC, o_orderkey) AS k, sum(y) OVER (ORDER BY score DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS tp, sum(y) OVER () AS pos FROM s)
SELECT CAST(max(pos) AS BIGINT) AS positives, round(sum(CASE WHEN y = 1 THEN tp / k ELSE 0 END) / max(pos), 6) AS ap, round(max(CASE WHEN tp / pos >= 0.7e0 THEN tp / k END), 6) AS p_at_70 FROM c""")
def average_precision(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").cast("long").alias("y"))
    run = ordered.running(s, [], [ordered.down("o_totalprice"), F.col("o_orderkey")], {"k": ("sum", F.lit(1).cast("long")), "tp": ("sum", F.col("y"))})
    x = run.crossJoin(F.broadcast(s.agg(F.sum("y").alias("pos"))))  # one row
    return x.groupBy(F.col("pos").alias("positives")).agg(F.round(F.sum(F.when(F.col("y") == 1, F.col("tp") / F.col("k"))) / F.max("pos"), 6).alias("ap"), F.round(F.max(F.when(F.col("tp") / F.col("pos") >= 0.7, F.col("tp") / F.col("k"))), 6).alias("p_at_70"))


@query("inflection_point", """
WITH r AS (SELECT floor(o_totalprice / 1000) AS s, row_number() OVER (ORDER BY floor(o_totalprice / 1000) DESC) - 1 AS i, count(*) OVER () AS n, max(floor(o_totalprice / 1000)) OVER () AS top FROM orders), d AS (SELECT i, s, s / top - i / greatest(n - 1, 1) AS d FROM r)
SELECT (SELECT count(*) FROM orders) AS n, max(i) + 1 AS rank, max_by(s, i) AS score FROM d WHERE d = (SELECT max(d) FROM d)""")
def inflection_point(spark, sf_dir):
    return ordered.inflection(table(spark, sf_dir, "orders").select(F.floor(F.col("o_totalprice") / 1000).cast("double").alias("s")), "s")


@query("knee_rank_counts", """
WITH c AS (SELECT o_custkey, count(*) AS umi FROM orders GROUP BY o_custkey), r AS (SELECT umi, row_number() OVER (ORDER BY umi DESC, o_custkey) AS r FROM c)
SELECT umi, min(r) AS first_rank, max(r) AS last_rank FROM r GROUP BY umi""")
def knee_rank_counts(spark, sf_dir):
    by = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("umi")).groupBy("umi").agg(F.count(F.lit(1)).alias("n"))
    run = ordered.running(by, [], [ordered.down("umi")], {"last_rank": ("sum", F.col("n"))})
    return run.select("umi", (F.col("last_rank") - F.col("n") + 1).alias("first_rank"), "last_rank")


@query("knee_threshold", """
WITH c AS (SELECT count(*) AS c FROM orders GROUP BY o_custkey), r AS (SELECT c, row_number() OVER (ORDER BY c DESC) AS k, count(*) OVER () AS n, max(c) OVER () AS hi, min(c) OVER () AS lo FROM c), d AS (SELECT c, k, n, hi, lo, abs((log10(lo) - log10(hi)) * log10(k) - log10(n) * log10(c) + log10(n) * log10(hi)) / sqrt(log10(n) ** 2 + (log10(lo) - log10(hi)) ** 2) AS d FROM r)
SELECT n, CASE WHEN n >= 50 AND hi > lo AND k - 1 >= n * 0.001e0 AND k - 1 <= n * 0.98e0 THEN c ELSE 0 END AS threshold FROM d ORDER BY d DESC, k LIMIT 1""")
def knee_threshold(spark, sf_dir):
    return ordered.knee(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("c")), "c", 50)


@query("empirical_p", """
WITH t AS (SELECT o_orderkey AS id, o_totalprice AS v, 1 AS test FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, o_totalprice, 0 FROM orders WHERE o_orderstatus <> 'P'),
c AS (SELECT id, test, sum(1 - test) OVER (ORDER BY v DESC RANGE UNBOUNDED PRECEDING) - sum(1 - test) OVER (PARTITION BY v) AS above, sum(1 - test) OVER () AS b FROM t)
SELECT id, round((above + 1) / (b + 1), 8) AS p FROM c WHERE test = 1""")
def empirical_p(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), "o_orderstatus")
    return ordered.empirical_p(o.where("o_orderstatus = 'P'").select("id", "v"), o.where("o_orderstatus <> 'P'").select("v"), "v").select("id", F.round("p", 8).alias("p"))


@query("custom_order_sort", """
SELECT o_orderkey, row_number() OVER (ORDER BY ord, o_totalprice, o_orderkey) AS position FROM orders JOIN (SELECT '5-LOW' AS p, 0 AS ord UNION ALL SELECT '1-URGENT', 1 UNION ALL SELECT '3-MEDIUM', 2) m ON o_orderpriority = p""")
def custom_order_sort(spark, sf_dir):
    ranks = spark.createDataFrame([("5-LOW", 0), ("1-URGENT", 1), ("3-MEDIUM", 2)], "o_orderpriority string, ord int")
    o = table(spark, sf_dir, "orders").join(F.broadcast(ranks), "o_orderpriority").select("o_orderkey", "ord", "o_totalprice")
    return ordered.row_numbers(o, [F.col("ord"), F.col("o_totalprice"), F.col("o_orderkey")], "position").select("o_orderkey", "position")


@query("gini_lorenz", """
WITH v AS (SELECT c_acctbal + 1000 AS v, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r, count(*) OVER () AS n FROM customer WHERE c_acctbal IS NOT NULL)
SELECT max(n) AS n, round(2 * sum(r * v) / (max(n) * sum(v)) - (max(n) + 1) / max(n), 6) AS gini FROM v""")
def gini_lorenz(spark, sf_dir):
    return ordered.gini(table(spark, sf_dir, "customer").select((F.col("c_acctbal") + 1000).alias("v")), "v").withColumn("gini", F.round("gini", 6))


@query("spearman_correlation", """
WITH a AS (SELECT o_custkey AS k, count(*) AS x, sum(o_totalprice) AS y FROM orders GROUP BY o_custkey),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0e0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0e0 AS ry FROM a)
SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r""")
def spearman_correlation(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("x"), F.round(F.sum("o_totalprice"), 2).alias("y"))
    rx, ry = (ordered.value_ranks(a, c, name=f"r{c}").select(c, f"r{c}") for c in ("x", "y"))
    return a.join(rx, "x").join(ry, "y").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("rx", "ry"), 6).alias("rho"))


@query("one_way_anova", "WITH m AS (SELECT l_linenumber AS g, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS gm, sum(n) AS n, count(*) AS k FROM m) SELECT any_value(k) AS groups, CAST(any_value(t.n) AS BIGINT) AS n, round((sum(m.n * (m - gm) ** 2) / (any_value(k) - 1)) / (sum((m.n - 1) * v) / (any_value(t.n) - any_value(k))), 4) AS f FROM m, t")
def one_way_anova(spark, sf_dir):
    from lodestar.functions.stats import anova

    return anova(lines(spark, sf_dir), "l_linenumber", "l_quantity").select("groups", "n", F.round("f", 4).alias("f"))


@query("na_poison_agg", "SELECT user_id, CASE WHEN count(*) = count_if(value <= 300) THEN max(value) END AS top, CASE WHEN count(*) = count_if(value <= 300) THEN round(sum(value), 4) END AS total FROM events GROUP BY user_id")
def na_poison_agg(spark, sf_dir):
    from lodestar.functions.stats import na_poison

    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("value") <= 300, F.col("value")).otherwise(F.when(F.col("event_id") % 2 == 0, float("nan"))).alias("v"))
    return e.groupBy("user_id").agg(na_poison("v", "max").alias("top"), F.round(na_poison("v", "sum"), 4).alias("total"))


@query("count_table_outer_bins", "SELECT l_partkey AS oligo, count_if(l_linenumber = 1) AS bin_1, count_if(l_linenumber = 2) AS bin_2, count_if(l_linenumber = 3) AS bin_3 FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_partkey")
def count_table_outer_bins(spark, sf_dir):
    """Counts of each bin from a table of its own, joined on all guides that any bin has, 0 where one has none."""
    samples = {f"bin_{k}": lines(spark, sf_dir).where(f"l_linenumber = {k}").groupBy(F.col("l_partkey").alias("guide")).agg(F.count(F.lit(1)).alias("count")) for k in (1, 2, 3)}
    flat = screens.flat_counts(samples)
    return flat.groupBy(F.col("guide").alias("oligo")).pivot("sample", list(samples)).agg(F.sum("count")).na.fill(0)
