"""Filter languages, projections, identifiers, sequences, search and semi-structured columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import dsl, sequences
from lodestar.operators import search
from lodestar.plans.portable import portable
from lodestar.plans.registry import query
from lodestar.session import table


@query("where_dsl", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity >= 10 AND l_discount < 0.05e0 AND l_linenumber <> 3")
def where_dsl(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where(dsl.where_column("l_quantity>=10,l_discount<0.05,l_linenumber!=3")).select("l_orderkey", "l_linenumber", "l_partkey")


@query("filter_dsl", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority <> '5-LOW' AND o_totalprice >= 100000")
def filter_dsl(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(dsl.filter_column("o_orderstatus=F,P;o_orderpriority!=5-LOW;o_totalprice=gte:100000")).select("o_orderkey")


@query("pvalue_rewrite", "SELECT o_orderkey, round(o_totalprice / 50000, 9) AS log10pvalue FROM orders WHERE o_totalprice / 50000 >= 7.301e0")
def pvalue_rewrite(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 50000).alias("log10pvalue"))
    return x.where(dsl.filter_column("p_value=lte:5e-8")).select("o_orderkey", F.round("log10pvalue", 9).alias("log10pvalue"))


@query("region_parse", "SELECT o_orderkey, concat('chr', o_custkey % 22 + 1) AS chrom, o_orderkey * 1000 AS start_pos, o_orderkey * 1000 + 500 AS end_pos FROM orders")
def region_parse(spark, sf_dir):
    text = F.concat(F.lit("chr"), F.col("o_custkey") % 22 + 1, F.lit(":"), F.format_number(F.col("o_orderkey") * 1000, 0), F.lit("-"), F.format_number(F.col("o_orderkey") * 1000 + 500, 0))
    p = dsl.region(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", p["chrom"].alias("chrom"), p["start"].alias("start_pos"), p["end"].alias("end_pos"))


portable("detect_id_type", """
WITH x AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN concat('rs', p_partkey) WHEN 1 THEN concat('ENSG0000', p_partkey) WHEN 2 THEN concat('chr1:', p_partkey, '-', p_partkey + 9) WHEN 3 THEN upper(split_part(p_name, ' ', 1)) ELSE concat('NC_000001.11:', p_partkey, ':A:G') END AS v FROM part)
SELECT k, CASE WHEN MATCHES(v, '^rs[0-9]+$') THEN 'rsid' WHEN MATCHES(v, '^ENSG[0-9]+$') THEN 'ensembl' WHEN MATCHES(v, '^chr[0-9XYM]+:[0-9]+-[0-9]+$') THEN 'region' WHEN MATCHES(v, '^NC_[0-9.]+:[0-9]+:[ACGT]*:[ACGT]*$') THEN 'spdi' ELSE 'symbol' END AS kind FROM x""")

portable("typed_props", "SELECT event_id, KJSON(props) AS k, event_type, CASE WHEN KJSON(props) >= 50 THEN 'high' ELSE 'low' END AS band FROM events")

portable("digest_ids", "SELECT o_orderkey, substring(SHA(k), 1, 16) AS edge_id FROM (SELECT o_orderkey, concat_ws('|', CAST(o_orderkey AS VARCHAR(20)), CAST(o_custkey AS VARCHAR(20)), o_orderstatus, 'orders') AS k FROM orders)")

portable("key_of_reference", "SELECT event_id, split_part(concat('events/', event_type, '/', CAST(event_id AS VARCHAR(20))), '/', 3) AS ref_key FROM events")

portable("incremental_ledger", """
WITH ledger AS (SELECT DISTINCT o_custkey AS shard FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00')
SELECT o_custkey AS shard, count(*) AS fresh FROM orders LEFT JOIN ledger ON o_custkey = shard WHERE shard IS NULL GROUP BY o_custkey""")

portable("validate_ranges", "SELECT count_if(NOT (l_discount BETWEEN 0 AND 0.1e0)) AS bad_discount, count_if(l_quantity < 1 OR l_quantity > 50) AS bad_quantity, count_if(l_returnflag NOT IN ('A', 'N', 'R')) AS bad_flag, count(*) AS n FROM lineitem")

portable("activity_geometric_mean", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax > 0 THEN round(sqrt(l_tax * l_quantity), 8) ELSE l_quantity END AS activity FROM lineitem")


@query("unpivot_measures", "SELECT p_partkey, 'p_size' AS tissue, CAST(p_size AS DOUBLE) AS tpm FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def unpivot_measures(spark, sf_dir):
    x = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return x.unpivot("p_partkey", ["p_size", "p_retailprice"], "tissue", "tpm")


@query("pivot_event_counts", "SELECT user_id, count_if(event_type = 'click') AS click, count_if(event_type = 'view') AS view FROM events GROUP BY user_id")
def pivot_event_counts(spark, sf_dir):
    x = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).count()
    return x.select("user_id", F.coalesce("click", F.lit(0)).alias("click"), F.coalesce("view", F.lit(0)).alias("view"))


@query("props_pack_unpack", "SELECT event_id, user_id, event_type FROM events")
def props_pack_unpack(spark, sf_dir):
    packed = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("user_id", "event_type")).alias("p"))
    return packed.select("event_id", F.from_json("p", "user_id long, event_type string").alias("s")).select("event_id", "s.user_id", "s.event_type")


@query("hamming1_join", """
WITH lib AS (SELECT DISTINCT substr(p_name, 1, 6) AS entry FROM part), reads AS (SELECT p_partkey AS id, substr(p_name, 1, 3) || 'a' || substr(p_name, 5, 2) AS rd FROM part),
d AS (SELECT id, rd, entry, hamming(rd, entry) AS h FROM reads JOIN lib ON length(rd) = length(entry) WHERE hamming(rd, entry) <= 1),
b AS (SELECT id, rd, min(h) AS distance FROM d GROUP BY id, rd)
SELECT d.id, d.rd, min(entry) AS entry, CAST(max(distance) AS INT) AS distance FROM d JOIN b ON d.id = b.id AND d.h = b.distance GROUP BY d.id, d.rd HAVING count(*) = 1""")
def hamming1_join(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    lib = p.select(F.substring("p_name", 1, 6).alias("entry")).distinct()
    reads = p.select(F.col("p_partkey").alias("id"), F.concat(F.substring("p_name", 1, 3), F.lit("a"), F.substring("p_name", 5, 2)).alias("rd"))
    return sequences.hamming1_join(reads, lib, "rd", "entry", " abcdefghijklmnopqrstuvwxyz")


@query("kmer_jaccard", """
WITH k AS (SELECT p_partkey, list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3))) AS a, list_distinct(list_transform(range(1, length(p_type) - 1), lambda i: substr(lower(p_type), i, 3))) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1), 8) AS j FROM k""")
def kmer_jaccard(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(sequences.jaccard(sequences.kmers(F.col("p_name"), 3), sequences.kmers(F.lower("p_type"), 3)), 8).alias("j"))


@query("token_overlap", """
WITH t AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a FROM part)
SELECT x.p_partkey AS a, y.p_partkey AS b, round(len(list_intersect(x.a, y.a)) / least(len(x.a), len(y.a)), 6) AS overlap FROM t x JOIN t y ON x.p_partkey + 1 = y.p_partkey""")
def token_overlap(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("t"))
    y = t.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("t").alias("u"), F.col("p_partkey").alias("b"))
    return t.join(y, "p_partkey").select(F.col("p_partkey").alias("a"), "b", F.round(sequences.overlap_coefficient(F.col("t"), F.col("u")), 6).alias("overlap"))


@query("levenshtein_capped", "SELECT p_partkey, CASE WHEN levenshtein(p_name, lower(p_type)) <= 8 THEN levenshtein(p_name, lower(p_type)) ELSE 9 END AS d FROM part")
def levenshtein_capped(spark, sf_dir):
    d = F.levenshtein("p_name", F.lower("p_type"), 8)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(d >= 0, d).otherwise(9).cast("long").alias("d"))


@query("longest_run")
def longest_run(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", sequences.longest_run(F.col("p_name")).alias("run"), F.round(sequences.gc_share(F.col("p_name")), 6).alias("gc"))


@query("tile_regions", "SELECT p_partkey, unnest(list_distinct(list_concat(range(p_partkey, greatest(p_partkey, p_partkey + p_size * 10 - 100) + 1, 40), [greatest(p_partkey, p_partkey + p_size * 10 - 100)]))) AS tile FROM part")
def tile_regions(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(sequences.tiles(F.col("p_partkey"), F.col("p_partkey") + F.col("p_size") * 10, 100, 40)).alias("tile"))


@query("bm25_search", """
WITH w AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM documents),
p AS (SELECT term, id, count(*) AS tf FROM w GROUP BY term, id), s AS (SELECT id, sum(tf) AS dl FROM p GROUP BY id), t AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM s),
h AS (SELECT * FROM p WHERE term IN ('the', 'from')), d AS (SELECT term, count(*) AS df FROM h GROUP BY term), g AS (SELECT id FROM h GROUP BY id HAVING count(*) = 2)
SELECT h.id, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score FROM h JOIN g ON h.id = g.id JOIN d ON h.term = d.term JOIN s ON h.id = s.id CROSS JOIN t GROUP BY h.id""")
def bm25_search(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), "doc_id", "text", ["the", "from"]).select("id", F.round("score", 6).alias("score"))


@query("cosine_top_k", """
WITH q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY list_cosine_similarity(qe, CAST(embedding AS DOUBLE[])) DESC, vec_id) AS rn FROM q CROSS JOIN embeddings WHERE vec_id <> qid)
SELECT qid, vec_id, rn FROM s WHERE rn <= 5""")
def cosine_top_k(spark, sf_dir):
    """Queries are the stated set of rows whose id is divisible by 20, searched for against all rows in blocks."""
    from lodestar.operators.vectors import top_k

    e = table(spark, sf_dir, "embeddings")
    return top_k(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)
