"""Contact maps, candidate elements and element-gene predictions over lineitem, part, supplier and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import contacts, peaks, ranges
from lodestar.plans.range_queries import ISLANDS, SPANS, WIDE, WINDOWS, spans, windows
from lodestar.plans.registry import query
from lodestar.session import table

#: Lines as predictions of element-gene pairs, in DuckDB.
PRED = """SELECT l_orderkey AS k, l_linenumber AS j, l_returnflag AS chr, l_partkey * 100 AS s, l_partkey * 100 + CAST(l_quantity * 10 AS BIGINT) AS e, 'E' || l_partkey AS name, 'G' || l_suppkey AS gene,
  l_suppkey * 2000 AS tss, round(l_discount * 10, 4) AS score, CASE WHEN l_linenumber = 1 THEN 'promoter' WHEN l_linenumber <= 3 THEN 'genic' ELSE 'intergenic' END AS class, l_tax AS activity,
  (l_linenumber = 1 AND l_suppkey % 2 = 0) AS self_promoter, abs(l_partkey * 100 - l_suppkey * 2000) AS distance FROM lineitem"""


def predictions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS k", "l_linenumber AS j", "l_returnflag AS chr", "l_partkey * 100 AS start", "l_partkey * 100 + CAST(l_quantity * 10 AS BIGINT) AS end", "concat('E', l_partkey) AS name", "concat('G', l_suppkey) AS gene",
        "l_suppkey * 2000 AS tss", "round(l_discount * 10, 4) AS score", "CASE WHEN l_linenumber = 1 THEN 'promoter' WHEN l_linenumber <= 3 THEN 'genic' ELSE 'intergenic' END AS class", "l_tax AS activity",
        "(l_linenumber = 1 AND l_suppkey % 2 = 0) AS self_promoter", "abs(l_partkey * 100 - l_suppkey * 2000) AS distance",
    )


RECORDS = "SELECT l_returnflag AS chr, least(l_partkey * 10, l_suppkey * 150) AS x, greatest(l_partkey * 10, l_suppkey * 150) AS y, l_quantity AS v FROM lineitem"


@query("contact_bins", f"""
WITH r AS ({RECORDS}), e AS (SELECT chr, x AS p, v FROM r UNION ALL SELECT chr, y, v FROM r WHERE x <> y), m AS (SELECT chr, avg(s) AS rm FROM (SELECT chr, p, sum(v) AS s FROM e GROUP BY chr, p) GROUP BY chr),
b AS (SELECT chr, x // 1000 AS bx, y // 1000 AS b_y, max(v) AS v FROM r GROUP BY ALL),
n AS (SELECT chr, bin, max(v) AS v FROM (SELECT chr, bx AS bin, v FROM b WHERE b_y > bx AND b_y - bx <= 5 UNION ALL SELECT chr, b_y, v FROM b WHERE b_y > bx AND b_y - bx <= 5) GROUP BY chr, bin)
SELECT b.chr, b.bx AS bin_x, b.b_y AS bin_y, round(CASE WHEN bx = b_y THEN coalesce(n.v, 0) ELSE b.v END / rm, 8) AS contact FROM b JOIN m ON b.chr = m.chr LEFT JOIN n ON n.chr = b.chr AND n.bin = b.bx""")
def contact_bins(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS chr", "least(l_partkey * 10, l_suppkey * 150) AS x", "greatest(l_partkey * 10, l_suppkey * 150) AS y", "l_quantity AS value")
    return contacts.binned_contacts(r, 1000, ["chr"]).select("chr", "bin_x", "bin_y", F.round("contact", 8).alias("contact"))


@query("contact_join", f"""
WITH p AS ({PRED}), c AS (SELECT l_returnflag AS chr, least(l_partkey // 40, l_suppkey // 3) AS bx, greatest(l_partkey // 40, l_suppkey // 3) AS b_y, max(l_quantity) AS contact FROM lineitem GROUP BY ALL)
SELECT p.k, p.j, p.name, p.gene, c.contact FROM p LEFT JOIN c ON p.chr = c.chr AND c.bx = least(CAST(floor((s + e) / 2 / 5000) AS BIGINT), tss // 5000) AND c.b_y = greatest(CAST(floor((s + e) / 2 / 5000) AS BIGINT), tss // 5000)""")
def contact_join(spark, sf_dir):
    x, y = F.floor(F.col("l_partkey") / 40), F.floor(F.col("l_suppkey") / 3)
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("chr"), F.least(x, y).alias("bin_x"), F.greatest(x, y).alias("bin_y")).agg(F.max("l_quantity").alias("contact"))
    return contacts.with_contacts(predictions(spark, sf_dir), c, 5000, (F.col("start") + F.col("end")) / 2, F.col("tss"), ["chr"]).select("k", "j", "name", "gene", "contact")


@query("weak_contacts", f"""
WITH p AS ({PRED}), w AS (SELECT gene FROM p WHERE self_promoter GROUP BY gene HAVING sum(activity) < 0.5e0)
SELECT p.k, p.j, p.name, p.gene, round(CASE WHEN w.gene IS NOT NULL THEN exp(5.9594510043736655e0 - 1.024238616787792e0 * ln(greatest(distance, 5000) + 1)) ELSE activity END, 8) AS contact FROM p LEFT JOIN w ON p.gene = w.gene""")
def weak_contacts(spark, sf_dir):
    return contacts.replace_weak_contacts(predictions(spark, sf_dir), "gene", "activity", "distance", "self_promoter", 0.5).select("k", "j", "name", "gene", F.round("activity", 8).alias("contact"))


A = "SELECT p_partkey AS id_a, p_size % 5 AS chr, p_partkey * 50 AS s, p_partkey * 50 + p_size * 20 AS e FROM part"
B = "SELECT s_suppkey AS id_b, s_nationkey % 5 AS chr, s_suppkey * 900 AS t, s_suppkey * 900 + s_nationkey * 40 + 1 AS u FROM supplier"


@query("pair_distance_table", f"""
WITH x AS (SELECT id_a, id_b, a.chr, unnest([{{'how': 'start', 'distance': CAST(abs(s - t) AS DOUBLE)}}, {{'how': 'midpoint', 'distance': abs((s + e) / 2 - (t + u) / 2)}}, {{'how': 'shortest', 'distance': CAST(greatest(0, t - e, s - u) AS DOUBLE)}}]) AS d FROM ({A}) a JOIN ({B}) b ON a.chr = b.chr)
SELECT d.how AS how, id_a, id_b, chr, d.distance AS distance FROM x WHERE d.distance <= 3000""")
def pair_distance_table(spark, sf_dir):
    a = table(spark, sf_dir, "part").selectExpr("p_partkey AS id_a", "p_size % 5 AS chr", "p_partkey * 50 AS start", "p_partkey * 50 + p_size * 20 AS end")
    b = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id_b", "s_nationkey % 5 AS chr", "s_suppkey * 900 AS start_b", "s_suppkey * 900 + s_nationkey * 40 + 1 AS end_b")
    parts = [contacts.pair_distances(a, b, "chr", how, 3000).withColumn("how", F.lit(how)) for how in ("start", "midpoint", "shortest")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("target_gene_pairs", """
SELECT p_partkey AS guide_id, CAST(s_suppkey AS VARCHAR) AS gene_name, p_brand AS target, 'discovery' AS pair_type FROM part JOIN (SELECT s_name, min(s_suppkey) AS s_suppkey, min(s_nationkey) AS s_nationkey FROM supplier GROUP BY s_name) ON p_size % 5 = s_nationkey % 5 WHERE p_size <> 7 AND abs(p_partkey * 50 - s_suppkey * 900) <= 4000""")
def target_gene_pairs(spark, sf_dir):
    guides = table(spark, sf_dir, "part").selectExpr("p_partkey AS guide_id", "p_brand AS target", "p_size % 5 AS chr", "CASE WHEN p_size <> 7 THEN p_partkey * 50 END AS start")
    genes = table(spark, sf_dir, "supplier").selectExpr("concat(s_suppkey, '.', s_nationkey) AS gene_id", "s_name AS gene_name", "s_nationkey % 5 AS chr", "s_suppkey * 900 AS start")
    return contacts.target_gene_pairs(guides, genes, 4000)


@query("contact_matrix_window", """
WITH r AS (SELECT (l_partkey - 10) // 50 AS a, (l_suppkey * 10 - 10) // 50 AS b FROM lineitem WHERE l_linenumber % 2 = 1 AND l_suppkey % 2 = 1 AND l_partkey BETWEEN 10 AND 899 AND l_suppkey * 10 BETWEEN 10 AND 899)
SELECT bin_1, bin_2, count(*) AS n FROM (SELECT a AS bin_1, b AS bin_2 FROM r UNION ALL SELECT b, a FROM r WHERE a <> b) GROUP BY bin_1, bin_2""")
def contact_matrix_window(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").selectExpr("concat('c', l_linenumber % 2) AS chrom1", "l_partkey AS pos1", "concat('c', l_suppkey % 2) AS chrom2", "l_suppkey * 10 AS pos2")
    return contacts.contact_matrix(p, "c1", 50, 10, 900)


CELLS = "SELECT l_returnflag AS chrom, l_linenumber - 1 AS bin_1, CAST(l_quantity AS INT) % 9 AS bin_2, count(*) AS value FROM lineitem GROUP BY 1, 2, 3"


@query("peak_pileup", f"""
WITH m AS ({CELLS}), a AS (SELECT DISTINCT l_returnflag AS chrom, l_suppkey % 9 AS i, l_partkey % 9 AS j FROM lineitem WHERE l_tax > 0.06e0), w AS (SELECT * FROM a WHERE i >= 1 AND j >= 1 AND i + 1 < 9 AND j + 1 < 9),
o AS (SELECT unnest([-1, 0, 1]) AS d)
SELECT x.d AS dx, y.d AS dy, round(avg(coalesce(m.value, 0)), 8) AS mean FROM w CROSS JOIN o x CROSS JOIN o y LEFT JOIN m ON m.chrom = w.chrom AND m.bin_1 = w.i + x.d AND m.bin_2 = w.j + y.d GROUP BY x.d, y.d""")
def peak_pileup(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    m = x.selectExpr("l_returnflag AS chrom", "l_linenumber - 1 AS bin_1", "CAST(l_quantity AS INT) % 9 AS bin_2").groupBy("chrom", "bin_1", "bin_2").agg(F.count(F.lit(1)).cast("double").alias("value"))
    a = x.where("l_tax > 0.06D").selectExpr("l_returnflag AS chrom", "l_suppkey % 9 AS i", "l_partkey % 9 AS j").distinct()
    sizes = x.select(F.col("l_returnflag").alias("chrom"), F.lit(9).alias("n")).distinct()
    return contacts.peak_pileup(m, a, sizes, 1).select("dx", "dy", F.round("mean", 8).alias("mean"))


@query("loop_contacts", """
WITH l AS (SELECT o_orderkey AS id, o_orderstatus AS chr, o_custkey * 90 AS s, o_custkey * 90 + 300 AS e, (o_orderkey % 1000) * 60 AS t, (o_orderkey % 1000) * 60 + 300 AS u, o_totalprice AS c FROM orders),
x AS (SELECT p_partkey AS id, (['F', 'O', 'P'])[p_size % 3 + 1] AS chr, p_partkey * 75 AS p FROM part), g AS (SELECT s_suppkey AS id, (['F', 'O', 'P'])[s_nationkey % 3 + 1] AS chr, s_suppkey * 700 AS p FROM supplier)
SELECT DISTINCT x.id AS element_id, g.id AS gene_id, l.id AS loop_id, c AS contact FROM l JOIN x ON l.chr = x.chr JOIN g ON l.chr = g.chr WHERE (x.p >= s AND x.p < e AND g.p >= t AND g.p < u) OR (x.p >= t AND x.p < u AND g.p >= s AND g.p < e)""".replace("SELECT DISTINCT x.id AS element_id, g.id AS gene_id, l.id AS loop_id, c AS contact", "SELECT x.id AS element_id, g.id AS gene_id, c AS contact"))
def loop_contacts(spark, sf_dir):
    chrom = lambda c: f"element_at(array('F', 'O', 'P'), CAST({c} % 3 + 1 AS INT)) AS chr"
    loops = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS loop_id", "o_orderstatus AS chr", "o_custkey * 90 AS start", "o_custkey * 90 + 300 AS end", "o_orderstatus AS chr2", "(o_orderkey % 1000) * 60 AS start2", "(o_orderkey % 1000) * 60 + 300 AS end2", "o_totalprice AS contact")
    e = table(spark, sf_dir, "part").selectExpr("p_partkey AS element_id", chrom("p_size"), "p_partkey * 75 AS pos")
    g = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS gene_id", chrom("s_nationkey"), "s_suppkey * 700 AS pos")
    return contacts.contacts_of_loops(e, g, loops, 1024)


@query("clip_and_shrink", f"""
WITH p AS ({PRED}), z AS (SELECT * FROM (VALUES ('A', 100000), ('N', 15000)) t(chr, size)), c AS (SELECT k, j, name, p.chr, greatest(s - 5000, 0) AS s, least(e, coalesce(size, e)) AS e FROM p LEFT JOIN z ON p.chr = z.chr)
SELECT k, j, name, chr, CASE WHEN s + 150 > e - 150 THEN CAST(floor((s + e) / 2) AS BIGINT) ELSE s + 150 END AS "start", CASE WHEN s + 150 > e - 150 THEN CAST(floor((s + e) / 2) AS BIGINT) ELSE e - 150 END AS "end" FROM c""")
def clip_and_shrink(spark, sf_dir):
    p = predictions(spark, sf_dir).select("k", "j", "name", "chr", (F.col("start") - 5000).alias("start"), "end")
    return peaks.shrink(peaks.clip_to_genome(p, spark.createDataFrame([("A", 100000), ("N", 15000)], "chr string, size long")), 150)


def merged(rows: str, value: str = "") -> str:
    """DuckDB: intervals (chr, s, e) merged, book-ended ones too."""
    return f"SELECT chr, min(s) AS s, max(e) AS e{value} FROM ({ISLANDS.format(gap=0, key='chr', rows=rows)}) GROUP BY chr, g"


@query("candidate_regions", f"""
WITH w AS (SELECT chr, s, e, price AS c FROM ({WINDOWS})), top AS (SELECT chr, s, e FROM ({merged('SELECT chr, s, e, c FROM w', ', max(c) AS c')}) ORDER BY c DESC, chr DESC, s DESC LIMIT 60),
pk AS (SELECT a.chr, a.s, a.e, (a.e - a.s) // 2 AS m FROM ({WIDE}) a WHERE EXISTS (SELECT 1 FROM top b WHERE a.chr = b.chr AND a.s < b.e AND a.e > b.s)),
r AS ({merged('SELECT chr, greatest(s + m - 250, 0) AS s, s + m + 250 AS e FROM pk')}), bl AS (SELECT chr, s, e FROM ({WINDOWS}) WHERE oid % 97 = 0), inc AS (SELECT chr, s, e FROM ({WINDOWS}) WHERE oid % 301 = 0),
k AS (SELECT chr, s, e FROM r a WHERE NOT EXISTS (SELECT 1 FROM bl b WHERE a.chr = b.chr AND a.s < b.e AND a.e > b.s) UNION ALL SELECT chr, s, e FROM inc)
SELECT chr, s AS "start", e AS "end" FROM ({merged('SELECT * FROM k')})""")
def candidate_regions(spark, sf_dir):
    w = windows(spark, sf_dir).select("chr", F.col("start_b").alias("start"), F.col("end_b").alias("end"), F.col("price").alias("count"), "oid")
    pk = ranges.normalised(spans(spark, sf_dir)).select("chr", "start", "end", F.floor((F.col("end") - F.col("start")) / 2).alias("summit"))
    sizes = spark.createDataFrame([(c, 1 << 40) for c in ("click", "error", "purchase", "signup", "view")], "chr string, size long")
    one = lambda n: w.where(f"oid % {n} = 0").select("chr", "start", "end")
    return peaks.candidate_regions(pk, w.select("chr", "start", "end", "count"), sizes, 60, 250, one(97), one(301))


@query("expressed_genes", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_retailprice / 2000 >= 0.7e0 ELSE p_size >= 25 END AS expressed FROM part")
def expressed_genes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 4 == 0, F.when(F.col("p_size") % 8 == 0, float("nan"))).otherwise(F.col("p_size").cast("double")).alias("tpm"), (F.col("p_retailprice") / 2000).alias("quantile"))
    return p.select("p_partkey", peaks.is_expressed(F.col("tpm"), F.col("quantile"), 25, 0.7).alias("expressed"))


@query("threshold_predictions", f"SELECT k, j, name, gene FROM ({PRED}) WHERE score >= 0.5e0 AND (class <> 'promoter' OR self_promoter)")
def threshold_predictions(spark, sf_dir):
    return peaks.threshold_predictions(predictions(spark, sf_dir), "score", 0.5).select("k", "j", "name", "gene")


@query("gene_prediction_stats", f"SELECT chr, gene, tss, count(score) = 0 AS failed, count(name) AS considered, count_if(class <> 'promoter' AND score > 0.6e0) AS distal FROM ({PRED}) GROUP BY chr, gene, tss HAVING count_if(class <> 'promoter') > 0")
def gene_prediction_stats(spark, sf_dir):
    return peaks.gene_prediction_stats(predictions(spark, sf_dir), "score", 0.6)


@query("prediction_summary", f"""
WITH p AS ({PRED}), t AS (SELECT * FROM p WHERE score >= 0.6e0 AND class <> 'promoter'), a AS (SELECT chr, s, e, count(*) AS n FROM t GROUP BY chr, s, e), b AS (SELECT gene, count(*) AS n FROM t GROUP BY gene)
SELECT (SELECT count(*) FROM a) AS n_enh_elements, (SELECT round(avg(n), 6) FROM a) AS mean_genes_per_enh, (SELECT round(avg(e - s), 6) FROM a) AS mean_enh_width, (SELECT count(*) FROM b) AS n_genes_with_enh, (SELECT round(avg(n), 6) FROM b) AS mean_enh_per_gene,
  (SELECT count(*) FROM t) AS n_enh_gene_links, (SELECT round(avg(distance), 4) FROM t) AS mean_dist_to_tss, (SELECT count(DISTINCT gene) FROM p) AS n_genes_active_promoter, (SELECT count(DISTINCT gene) FROM p WHERE score = 0) AS n_genes_not_expressed""")
def prediction_summary(spark, sf_dir):
    p = predictions(spark, sf_dir)
    out = peaks.prediction_summary(p, peaks.threshold_predictions(p, "score", 0.6), "score", "distance")
    return out.withColumns({c: F.round(c, 4 if c == "mean_dist_to_tss" else 6) for c in out.columns if c.startswith("mean")})


@query("prediction_qc", f"""
WITH p AS ({PRED}), g AS (SELECT gene, count(*) AS n FROM p GROUP BY gene), e AS (SELECT chr, s, e, count(*) AS n FROM p GROUP BY chr, s, e), c AS (SELECT chr, count(*) AS n FROM p GROUP BY chr), d AS (SELECT distance AS d FROM p WHERE distance > 0)
SELECT (SELECT round(avg(n), 4) FROM g) AS mean_enh_per_gene, (SELECT round(median(n), 4) FROM g) AS median_enh_per_gene, (SELECT round(stddev_pop(n), 4) FROM g) AS sd_enh_per_gene, (SELECT count(*) FROM e) AS n_enhancers, (SELECT round(median(n), 4) FROM e) AS median_gene_per_enh, (SELECT round(stddev_pop(n), 4) FROM e) AS sd_gene_per_enh,
  (SELECT round(avg(n), 4) FROM c) AS mean_pairs_per_chr, (SELECT round(median(n), 4) FROM c) AS median_pairs_per_chr, round(median(d), 4) AS median_distance, round(avg(d), 4) AS mean_distance, round(stddev_pop(d), 4) AS sd_distance, round(quantile_cont(d, 0.1), 4) AS p10_distance, round(quantile_cont(d, 0.9), 4) AS p90_distance FROM d""")
def prediction_qc(spark, sf_dir):
    out = peaks.prediction_qc(predictions(spark, sf_dir), "distance")
    return out.select(*(F.round(c, 4).alias(c) if c != "n_enhancers" else F.col(c) for c in out.columns))


@query("tss_between", f"""
WITH p AS ({PRED}), t AS (SELECT l_returnflag AS chr, s_suppkey * 2000 - 250 AS s, s_suppkey * 2000 + 250 AS e FROM supplier CROSS JOIN (SELECT DISTINCT l_returnflag FROM lineitem)),
q AS (SELECT chr, name, gene, CASE WHEN tss < (s + e) // 2 THEN tss ELSE s END AS s, CASE WHEN tss < (s + e) // 2 THEN e ELSE (s + e) // 2 + distance END AS e FROM p)
SELECT * FROM (SELECT name, gene, (SELECT count(*) FROM t WHERE t.chr = q.chr AND t.s < q.e) - (SELECT count(*) FROM t WHERE t.chr = q.chr AND t.e <= q.s) AS n FROM q) WHERE n > 0""")
def tss_between(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2000 - 250).alias("start"), (F.col("s_suppkey") * 2000 + 250).alias("end"))
    flags = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("chr")).distinct()
    return peaks.tss_between(predictions(spark, sf_dir), flags.crossJoin(t))  # three flags


@query("nearby_elements", f"""
WITH r AS (SELECT DISTINCT chr, s, e, name, activity AS w FROM ({PRED})), q AS (SELECT DISTINCT chr, name, greatest((s + e) // 2 - 700, 0) AS s, (s + e) // 2 + 700 AS e FROM ({PRED}) WHERE j = 2),
h AS (SELECT q.chr, q.name, q.s, q.e, r.w, r.name = q.name AS own FROM q JOIN r ON r.chr = q.chr AND r.s < q.e AND r.e > q.s), f AS (SELECT name AS n2, chr, s, e FROM r)
SELECT name, CAST(sum(n) AS BIGINT) AS count, round(sum(t), 6) AS sum FROM (SELECT chr, name, s, e, count_if(NOT own) AS n, coalesce(sum(w) FILTER (WHERE NOT own), 0) AS t FROM h GROUP BY chr, name, s, e) WHERE n > 0 GROUP BY name""")
def nearby_elements(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return peaks.nearby_elements(p, p.where("j = 2").select("chr", "start", "end", "name"), 700).withColumn("sum", F.round("sum", 6))


@query("features_by_overlap", f"""
WITH b AS (SELECT DISTINCT chr, gene, s, e FROM ({PRED}) WHERE j <= 2), f AS (SELECT chr, gene, s, e, CASE WHEN k % 50 = 0 THEN NULL ELSE activity END AS a, score AS c FROM ({PRED}) WHERE j >= 3)
SELECT b.chr, b.gene, b.s AS "start", b.e AS "end", CASE WHEN count(f.gene) = count(f.a) THEN max(f.a) END AS activity, coalesce(round(sum(f.c), 6), -1) AS score FROM b LEFT JOIN f ON b.chr = f.chr AND b.gene = f.gene AND b.s <= f.e AND b.e >= f.s GROUP BY b.chr, b.gene, b.s, b.e""")
def features_by_overlap(spark, sf_dir):
    p = predictions(spark, sf_dir)
    b = p.where("j <= 2").select("chr", "gene", "start", "end").distinct()
    f = p.where("j >= 3").select("chr", "gene", "start", "end", F.when(F.col("k") % 50 == 0, F.when(F.col("k") % 100 == 0, float("nan"))).otherwise(F.col("activity")).alias("activity"), "score")
    return peaks.add_features(b, f, {"activity": "max", "score": "sum"}, fill={"score": -1.0}).withColumn("score", F.round("score", 6))


@query("features_by_gene", f"WITH f AS (SELECT 'G' || s_suppkey AS gene, s_acctbal AS balance FROM supplier WHERE s_suppkey % 2 = 0) SELECT k, j, name, coalesce(balance, 0) AS balance FROM ({PRED}) p LEFT JOIN f ON p.gene = f.gene")
def features_by_gene(spark, sf_dir):
    f = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("G"), "s_suppkey").alias("gene"), F.col("s_acctbal").alias("balance"))
    return peaks.add_features(predictions(spark, sf_dir), f, {"balance": "max"}, by="gene", fill={"balance": 0.0}).select("k", "j", "name", "balance")


@query("correlation_score", f"""
WITH p AS (SELECT DISTINCT chr, gene, s, e, max(score) AS score FROM ({PRED}) WHERE j <= 3 GROUP BY chr, gene, s, e), c AS (SELECT chr, gene, s, e, activity * 2 - 0.05e0 AS r FROM ({PRED}) WHERE j >= 4),
m AS (SELECT p.chr, p.gene, p.s, p.e, p.score, max(c.r) AS r FROM p LEFT JOIN c ON p.chr = c.chr AND p.gene = c.gene AND p.s <= c.e AND p.e >= c.s GROUP BY ALL),
f AS (SELECT count(*) AS n, stddev_samp(ln(score)) AS sl, stddev_samp(r) AS sc, corr(ln(score), r) AS q FROM m WHERE score > 0 AND r IS NOT NULL)
SELECT chr, gene, s AS "start", e AS "end", round(r, 8) AS correlation, round(CASE WHEN score > 0 AND r IS NOT NULL AND n >= 3 THEN exp(ln(score) + r * sl / sc * q) ELSE score END, 6) AS arc FROM m CROSS JOIN f""")
def correlation_score(spark, sf_dir):
    p = predictions(spark, sf_dir)
    a = p.where("j <= 3").groupBy("chr", "gene", "start", "end").agg(F.max("score").alias("score"))
    c = p.where("j >= 4").select("chr", "gene", "start", "end", (F.col("activity") * 2 - 0.05).alias("correlation"))
    return peaks.integrate_correlation(a, c, "score").select("chr", "gene", "start", "end", F.round("correlation", 8).alias("correlation"), F.round("arc", 6).alias("arc"))


@query("one_to_one_names", """
WITH g AS (SELECT p_size AS id, p_brand AS ref_name FROM part WHERE p_partkey % 20 = 0), t AS (SELECT n_nationkey AS id, n_name AS name FROM nation), a AS (SELECT t.id, min(ref_name) AS ref_name, min(name) AS name FROM t JOIN g ON t.id = g.id GROUP BY t.id HAVING count(*) = 1)
SELECT ref_name, min_by(name, id) AS name FROM a GROUP BY ref_name""")
def one_to_one_names(spark, sf_dir):
    g = table(spark, sf_dir, "part").where("p_partkey % 20 = 0").selectExpr("p_size AS ensembl_id", "p_brand AS ref_name")
    return peaks.one_to_one_names(g, table(spark, sf_dir, "nation").selectExpr("n_nationkey AS ensembl_id", "n_name AS name"))


FRAG = f"SELECT chr, s, s + 120 AS e, user_id AS cell FROM ({SPANS}) WHERE user_id % 3 <> 0"


@query("fragment_counts", f"""
WITH f AS ({FRAG}), p AS ({WINDOWS}) SELECT 'fragment' AS mode, p.oid AS peak_id, f.cell, count(*) AS n FROM f JOIN p ON f.chr = p.chr AND f.s < p.e AND f.e + 1 > p.s GROUP BY p.oid, f.cell
UNION ALL SELECT 'insertion', p.oid, f.cell, count(*) FROM (SELECT chr, cell, s + 1 AS x FROM f UNION ALL SELECT chr, cell, e FROM f) f JOIN p ON f.chr = p.chr AND f.x >= p.s AND f.x <= p.e GROUP BY p.oid, f.cell""")
def fragment_counts(spark, sf_dir):
    f = spans(spark, sf_dir).select("chr", "start", (F.col("start") + 120).alias("end"), F.col("user_id").alias("cell"))
    p = windows(spark, sf_dir).select(F.col("oid").alias("peak_id"), "chr", F.col("start_b").alias("start"), F.col("end_b").alias("end"))
    cells = f.where("cell % 3 <> 0").select("cell")
    one = lambda mode: peaks.fragment_counts(f, p, cells, mode, 512).withColumn("mode", F.lit(mode))
    return one("fragment").unionByName(one("insertion"))


@query("fragment_tags", f"""
WITH f AS ({FRAG}), c AS (SELECT * FROM (VALUES ('view', 0), ('click', 1)) t(chr, ord)), t AS (SELECT chr, s, (s + e) // 2 AS e, '+' AS strand FROM f UNION ALL SELECT chr, (s + e) // 2 + 1, e, '-' FROM f)
SELECT t.chr, ord, s AS "start", e AS "end", strand FROM t JOIN c ON t.chr = c.chr""")
def fragment_tags(spark, sf_dir):
    f = spans(spark, sf_dir).select("chr", "start", (F.col("start") + 120).alias("end"), F.col("user_id").alias("cell"))
    return peaks.tags_of_fragments(f, spark.createDataFrame([("view", 0), ("click", 1)], "chr string, ord int"), f.where("cell % 3 <> 0").select("cell"))


@query("chosen_cells")  # by Spark's hash: no SQL; the test compares it with another order of the rows
def chosen_cells(spark, sf_dir):
    e, o = table(spark, sf_dir, "events").select(F.col("user_id").alias("cell")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cell"))
    return peaks.choose_cells(e, o, 100)


@query("element_gene_lists", f"""
WITH g AS (SELECT 'G' || s_suppkey AS name FROM supplier), p AS (SELECT DISTINCT gene FROM ({PRED}) WHERE score > 0.95e0), x AS (SELECT 'G' || s_suppkey AS name, s_acctbal / 1000 AS tpm FROM supplier WHERE s_suppkey % 3 > 0)
SELECT g.name, tpm, p.gene IS NULL AS removed_by_promoter, coalesce(tpm < 1, false) AS removed_by_tpm, tpm IS NOT NULL AS in_matrix, p.gene IS NOT NULL AND coalesce(tpm >= 1, false) AS considered FROM g LEFT JOIN p ON g.name = p.gene LEFT JOIN x ON g.name = x.name""")
def element_gene_lists(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("G"), "s_suppkey").alias("name"), (F.col("s_acctbal") / 1000).alias("tpm"), "s_suppkey")
    return peaks.element_gene_lists(s.select("name"), predictions(spark, sf_dir).where("score > 0.95D"), s.where("s_suppkey % 3 > 0"), 1.0)


@query("nearest_elements", f"""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY s, e, oid) AS i FROM ({WINDOWS})), a AS (SELECT id, chr, s, e FROM ({WIDE})),
i AS (SELECT a.*, coalesce((SELECT max(i) FROM b WHERE b.chr = a.chr AND b.s < a.s), 0) AS p FROM a),
c AS (SELECT i.id, b.i - i.p AS k, b.oid, CASE WHEN b.s < i.e AND b.e > i.s THEN 0 WHEN b.s >= i.e THEN b.s - i.e ELSE i.s - b.e END AS d FROM i JOIN b ON b.chr = i.chr AND b.i BETWEEN i.p AND i.p + 2)
SELECT id AS region_id, min(greatest(d, 0)) AS distance FROM c GROUP BY id""")
def nearest_elements(spark, sf_dir):
    a = ranges.normalised(spans(spark, sf_dir)).select(F.col("id").alias("region_id"), "chr", "start", "end")
    b = windows(spark, sf_dir).select(F.col("oid").alias("element_id"), "chr", F.col("start_b").alias("start"), F.col("end_b").alias("end"), F.lit("w").alias("class"))
    return peaks.nearest_elements(a, b).select("region_id", "distance")


@query("stitched_peaks", f"""
WITH t AS (SELECT chr, s AS p FROM ({WINDOWS}) WHERE oid % 5 = 0), a AS (SELECT id, chr, s, e, score FROM ({WIDE}) a WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.chr = a.chr AND abs((a.s + a.e) // 2 - t.p) <= 200))
SELECT chr, min(s) AS "start", max(e) AS "end", round(sum(score), 4) AS score_sum, count(*) AS n_peaks FROM ({ISLANDS.format(gap=60, key='chr', rows='SELECT * FROM a')}) GROUP BY chr, g""")
def stitched_peaks(spark, sf_dir):
    t = windows(spark, sf_dir).where("oid % 5 = 0").select("chr", F.col("start_b").alias("pos"))
    return peaks.stitched(spans(spark, sf_dir), 60, t, 200).withColumn("score_sum", F.round("score_sum", 4))
