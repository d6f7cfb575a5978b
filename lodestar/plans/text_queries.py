"""Identifiers, names and sequences made of the tables' columns, by the functions of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.plans.registry import query
from lodestar.session import table


def part(spark, sf_dir):
    return table(spark, sf_dir, "part")


@query("entities_in_text", """
WITH x AS (SELECT p_partkey AS k, 'see ENCFF' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || 'ABC and RS' || (p_partkey + 10) || ', chr' || (p_size % 22 + 1) || ':1,' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '-2,000.' AS t FROM part)
SELECT k, 'dataset:ENCFF' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || 'ABC;variant:rs' || (k + 10) || ';region:chr' || (p_size % 22 + 1) || ':1' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '-2000' AS found FROM x JOIN part ON p_partkey = k""")
def entities_in_text(spark, sf_dir):
    p = part(spark, sf_dir)
    t = F.concat(F.lit("see ENCFF"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit("ABC and RS"), (F.col("p_partkey") + 10).cast("string"), F.lit(", chr"), (F.col("p_size") % 22 + 1).cast("string"), F.lit(":1,"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit("-2,000."))
    return p.select(F.col("p_partkey").alias("k"), F.array_join(F.transform(text.entities(t), lambda e: F.concat(e["kind"], F.lit(":"), e["name"])), ";").alias("found"))


@query("impossible_claims", "SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(';', CASE WHEN l_quantity / 40 > 1 THEN 'p_adj=' || CAST(l_quantity / 40 AS VARCHAR) END, CASE WHEN l_linenumber > 1 THEN 'auroc=' || l_linenumber END) AS bad FROM lineitem")
def impossible_claims(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    t = F.concat(F.lit("We found p_adj = "), (F.col("l_quantity") / 40).cast("string"), F.lit(" with\nAUROC: "), F.col("l_linenumber").cast("string"), F.lit(", r2 is 0.5"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(F.transform(text.impossible_claims(t), lambda c: F.concat(c["field"], F.lit("="), c["value"])), ";").alias("bad"))


@query("variant_notation_parse", """
SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'chr-pos-ref-alt' WHEN 1 THEN 'spdi' WHEN 2 THEN 'rsid' ELSE 'hgvs-g' END AS kind, CASE WHEN o_orderkey % 4 IN (0, 3) THEN CAST(o_custkey % 22 + 1 AS VARCHAR) END AS chrom, CASE WHEN o_orderkey % 4 IN (0, 3) THEN o_orderkey + 5 END AS pos,
  CASE o_orderkey % 4 WHEN 1 THEN 'NC_00000' || (o_custkey % 9 + 1) || '.11:' || o_orderkey || ':C:T' WHEN 2 THEN 'rs' || o_orderkey ELSE 'chr' || (o_custkey % 22 + 1) || ':' || (o_orderkey + 4) || ':A:G' END AS variant_id FROM orders""")
def variant_notation_parse(spark, sf_dir):
    v = F.expr("CASE o_orderkey % 4 WHEN 0 THEN concat('\"chr', o_custkey % 22 + 1, '-', o_orderkey + 5, '-a-G,') WHEN 1 THEN concat('NC_00000', o_custkey % 9 + 1, '.11:', o_orderkey, ':C:T') WHEN 2 THEN concat(' RS', o_orderkey) ELSE concat('chr', o_custkey % 22 + 1, ':g.', o_orderkey + 5, 'A>g') END")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), text.parse_variant(v).alias("v")).select("k", "v.kind", "v.chrom", "v.pos", "v.variant_id")


@query("spdi_tokens", "SELECT o_orderkey AS k, CASE WHEN o_custkey % 30 BETWEEN 1 AND 24 THEN CASE o_custkey % 30 WHEN 23 THEN 'X' WHEN 24 THEN 'Y' ELSE CAST(o_custkey % 30 AS VARCHAR) END || '-' || (o_orderkey + 1) || '-T-C' ELSE '' END AS token FROM orders")
def spdi_tokens(spark, sf_dir):
    s = F.concat(F.lit("NC_"), F.lpad((F.col("o_custkey") % 30).cast("string"), 6, "0"), F.lit(".10:"), F.col("o_orderkey").cast("string"), F.lit(":t:C"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), text.spdi_token(s).alias("token"))


@query("vcf_records", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '7-' || o_orderkey || '-AC-T' END || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ';' END || '8-9-G-A' AS tokens FROM orders")
def vcf_records(spark, sf_dir):
    t = F.concat(F.lit("##x\n#CHROM POS\n\n7\t"), F.when(F.col("o_orderkey") % 3 == 0, "n").otherwise(F.col("o_orderkey").cast("string")), F.lit("\t.\tAC\tT\t.\r\n8 9 . G A\nshort 1"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.array_join(text.vcf_tokens(t), ";").alias("tokens"))


@query("canonical_names", "SELECT p_partkey, lower(trim(regexp_replace(p_name || '/' || p_type, '[^A-Za-z0-9]+', ' ', 'g'))) AS name FROM part")
def canonical_names(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", text.canonical_name(F.concat(F.lit(" "), "p_name", F.lit("/"), "p_type", F.lit(" - Homo sapiens (human)"))).alias("name"))


@query("unique_joins", "SELECT o_custkey, string_agg(x, ';' ORDER BY i) AS joined FROM (SELECT o_custkey, x, row_number() OVER (PARTITION BY o_custkey ORDER BY x) AS i FROM (SELECT DISTINCT o_custkey, o_orderpriority AS x FROM orders)) WHERE i <= 3 GROUP BY o_custkey")
def unique_joins(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderpriority")).alias("x")).select("o_custkey", text.unique_join("x", 3).alias("joined"))


@query("name_closeness", """
WITH t AS (SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda w: w <> '')) AS h FROM part)
SELECT p_partkey, 2 * len(list_intersect(h, ['standard', 'anodized'])) + len(list_filter(h, lambda w: w NOT IN ('standard', 'anodized') AND substr(w, 1, 5) IN ('stand', 'anodi'))) AS score FROM t""")
def name_closeness(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", text.closeness(["standard", "anodized"], F.col("p_type")).alias("score"))


@query("barcode_windows", """
WITH l AS (SELECT DISTINCT substr(p_name, 1, 8) AS form FROM part WHERE length(p_name) >= 8), r AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'x' || p_name WHEN 1 THEN p_name WHEN 2 THEN 'xy' || p_name ELSE 'xyz' || p_name END AS w FROM part)
SELECT p_partkey, coalesce(a.form, b.form, c.form) AS barcode FROM r LEFT JOIN l a ON a.form = substr(w, 2, 8) LEFT JOIN l b ON b.form = substr(w, 1, 8) LEFT JOIN l c ON c.form = CASE WHEN length(w) < 10 THEN substr(w, 3) || 'N' ELSE substr(w, 3, 8) END""")
def barcode_windows(spark, sf_dir):
    p = part(spark, sf_dir)
    lib = p.where(F.length("p_name") >= 8).select(F.substring("p_name", 1, 8).alias("form")).distinct().withColumn("barcode", F.col("form"))
    lead = F.when(F.col("p_size") % 4 == 0, "x").when(F.col("p_size") % 4 == 1, "").when(F.col("p_size") % 4 == 2, "xy").otherwise("xyz")
    return text.match_barcode(p.select("p_partkey", F.concat(lead, "p_name").alias("w")), lib, "w").select("p_partkey", "barcode")


@query("round_barcodes", "SELECT doc_id, CASE WHEN length(text) >= 38 THEN substr(text, 3, 8) || substr(text, 16, 8) || substr(text, 31, 8) END AS bc FROM documents")
def round_barcodes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.round_barcode(F.col("text"), (2, 15, 30)).alias("bc"))


@query("well_counts", "SELECT well, count(*) AS n FROM part JOIN (SELECT DISTINCT upper(substr(regexp_replace(p_name, '[-_]', '', 'g'), 1, 8)) AS pre, p_size AS well FROM part WHERE p_partkey % 11 = 0) ON pre = upper(substr(regexp_replace(p_name, '[-_]', '', 'g'), 1, 8)) GROUP BY well")
def well_counts(spark, sf_dir):
    p = part(spark, sf_dir)
    white = p.where("p_partkey % 11 = 0").select(F.upper(F.substring(F.regexp_replace("p_name", "[-_]", ""), 1, 8)).alias("prefix"), F.col("p_size").alias("well")).distinct()
    return text.well_counts(p, white, "p_name")


SEQ = "translate(substr(md5(CAST(p_partkey AS VARCHAR)), 1, 32), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def sequences(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))


@query("design_failures", f"""
WITH s AS (SELECT p_partkey, {SEQ} AS q FROM part), r AS (SELECT *, list_max(list_transform(['A', 'C', 'G', 'T'], lambda b: list_max(list_transform(range(1, 33), lambda k: CASE WHEN contains(q, repeat(b, k)) THEN k ELSE 0 END)))) AS run FROM s)
SELECT p_partkey, CASE WHEN run > 4 THEN 'homopolymer' WHEN contains(q, 'AGCT') THEN 'restriction_site:AluI' WHEN contains(q, 'CATG') THEN 'restriction_site:NlaIII' END AS reason FROM r""")
def design_failures(spark, sf_dir):
    return sequences(spark, sf_dir).select("p_partkey", text.design_failure(F.col("seq"), 4, {"AluI": "AGCT", "NlaIII": "CATG"}).alias("reason"))


@query("pam_sites", f"""
WITH s AS (SELECT p_partkey, {SEQ} AS q FROM part), i AS (SELECT p_partkey, q, unnest(range(1, 31)) AS i FROM s)
SELECT p_partkey, count_if(substr(q, i + 1, 2) = 'GG') AS forward, CAST(coalesce(sum(i + 99) FILTER (WHERE substr(q, i + 1, 2) = 'GG'), 0) AS BIGINT) AS sum_forward, count_if(substr(q, i, 2) = 'CC') AS backward, CAST(coalesce(sum(i + 102) FILTER (WHERE substr(q, i, 2) = 'CC'), 0) AS BIGINT) AS sum_backward FROM i GROUP BY p_partkey""")
def pam_sites(spark, sf_dir):
    f, b = text.pam_sites(F.col("seq"), "NGG", 100)
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
    return sequences(spark, sf_dir).select("p_partkey", F.size(f).alias("forward"), total(f).alias("sum_forward"), F.size(b).alias("backward"), total(b).alias("sum_backward"))


@query("guide_chemistry", f"WITH s AS (SELECT p_partkey, substr({SEQ}, 1, 20) AS q FROM part) SELECT p_partkey, contains(q, 'TTTT') AS poly_t, contains(q, 'GGGG') AS poly_g, contains(q, 'CCCC') AS poly_c, contains(q, 'AAAA') AS poly_a, length(regexp_replace(q, '[^GC]', '', 'g')) * 100 / 20 AS gc_content FROM s")
def guide_chemistry(spark, sf_dir):
    s = sequences(spark, sf_dir).select("p_partkey", F.substring("seq", 1, 20).alias("g"))
    return s.select("p_partkey", *(c.alias(n) for n, c in text.guide_chemistry(F.col("g")).items()))


PWM = [{"A": 1.0, "C": -0.5, "G": 0.25, "T": -1.0}, {"A": -0.75, "C": 1.5, "G": -0.25, "T": 0.5}, {"A": 0.5, "C": -1.0, "G": 2.0, "T": -0.5}]
CASES = [" + ".join(f"CASE substr(q, i + {j}, 1) WHEN 'A' THEN {w['A']} WHEN 'C' THEN {w['C']} WHEN 'G' THEN {w['G']} ELSE {w['T']} END" for j, w in enumerate(PWM))][0]


@query("pwm_scores", f"WITH s AS (SELECT p_partkey, {SEQ} AS q FROM part), i AS (SELECT p_partkey, q, unnest(range(1, 31)) AS i FROM s) SELECT p_partkey, CAST(max({CASES}) AS DOUBLE) AS score FROM i GROUP BY p_partkey")
def pwm_scores(spark, sf_dir):
    return sequences(spark, sf_dir).select("p_partkey", text.pwm_score(PWM, F.col("seq")).alias("score"))


@query("feature_design", "SELECT l_orderkey, l_linenumber, l_partkey, round(ln(l_tax + 0.01e0), 8) AS tax, round(ln(l_quantity + 0.01e0), 8) AS quantity, round(ln(l_tax * l_quantity + 0.01e0), 8) AS both FROM lineitem")
def feature_design(spark, sf_dir):
    d = text.design_matrix(["l_tax", "l_quantity"], squares=True)
    names = {"l_tax": "tax", "l_quantity": "quantity", "l_tax l_quantity": "both"}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *(F.round(d[k], 8).alias(v) for k, v in names.items()))


@query("keys_in_range", "SELECT p_partkey FROM part WHERE encode(p_name) >= encode('c') AND encode(p_name) < encode('gr')")
def keys_in_range(spark, sf_dir):
    return part(spark, sf_dir).where(text.key_range(F.col("p_name"), "c", "gr")).select("p_partkey")


@query("lcs_lengths")  # DuckDB has no such function; a test compares it with a table of lengths
def lcs_lengths(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", text.lcs_length(F.substring("p_name", 1, 20), F.substring(F.lower("p_type"), 1, 20)).alias("n"))
