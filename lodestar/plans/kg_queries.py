"""Graph build, identities, merges and warehouse rows over customer, orders, lineitem, part, supplier and nation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestar import warehouse
from lodestar.operators import kg
from lodestar.plans.registry import query
from lodestar.session import ensure_checkpoint_dir, table
from lodestar.sources import mirror
from lodestar.streaming import jobs

NODE = {"gene_type": ("STRING", "p_type"), "size": ("INT64", "p_size"), "missing": ("DOUBLE", None), "flag": ("BOOL", "p_name")}


@query("node_table", """
SELECT 'genes/' || p_partkey AS id, 'ENSEMBL:' || p_partkey AS curie, CASE WHEN p_partkey % 2 = 0 THEN 'S' || p_partkey ELSE p_name END AS name, CASE WHEN p_size % 3 = 0 THEN 'Homo sapiens' WHEN p_size % 3 = 1 THEN 'Mus musculus' ELSE 'rat' END AS taxon, p_brand AS source,
  p_type AS gene_type, CAST(p_size AS BIGINT) AS size, CAST(NULL AS DOUBLE) AS missing, CAST(NULL AS BOOLEAN) AS flag, p_partkey AS key_in_props FROM part""")
def node_table(spark, sf_dir):
    organism = F.when(F.col("p_size") % 3 == 0, "HOMO SAPIENS (human)").when(F.col("p_size") % 3 == 1, "mus musculus").otherwise("rat")
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("genes/"), "p_partkey").alias("_id"), F.col("p_partkey").cast("string").alias("_key"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("S"), "p_partkey")).alias("symbol"), F.col("p_brand").alias("source"), organism.alias("organism"), "p_type", "p_size", "p_name", "p_partkey")
    out = kg.node_table(p, "Gene", NODE)
    return out.withColumn("key_in_props", F.get_json_object("props", "$.p_partkey").cast("long")).drop("props")


EDGE = """SELECT l_orderkey AS k, CASE WHEN l_linenumber = 7 THEN 'things/' || l_partkey WHEN l_linenumber = 6 THEN 'pairs/' || l_suppkey ELSE 'parts/' || l_partkey * (1 + l_linenumber % 2) END AS f, CASE WHEN l_linenumber = 5 THEN 'variants/' || l_suppkey ELSE 'suppliers/' || l_suppkey * (1 + l_linenumber % 3 // 2) END AS t FROM lineitem"""
TYPES = {"parts": "Part", "suppliers": "Supplier", "variants": "Variant"}


def edge_parts(spark, sf_dir):
    x = F.expr("CASE WHEN l_linenumber = 7 THEN concat('things/', l_partkey) WHEN l_linenumber = 6 THEN concat('pairs/', l_suppkey) ELSE concat('parts/', l_partkey * (1 + l_linenumber % 2)) END")
    y = F.expr("CASE WHEN l_linenumber = 5 THEN concat('variants/', l_suppkey) ELSE concat('suppliers/', l_suppkey * (1 + l_linenumber % 3 div 2)) END")
    edges = table(spark, sf_dir, "lineitem").select(x.alias("_from"), y.alias("_to"), F.col("l_orderkey").alias("k"))
    hyper = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").selectExpr("concat('pairs/', s_suppkey) AS _id", "concat('parts/', s_suppkey) AS _from", "concat('suppliers/', s_suppkey) AS _to")
    nodes = {"Part": table(spark, sf_dir, "part").selectExpr("concat('parts/', p_partkey) AS id"), "Supplier": table(spark, sf_dir, "supplier").selectExpr("concat('suppliers/', s_suppkey) AS id")}
    return edges, nodes, hyper


REASONED = f"""e AS ({EDGE}), h AS (SELECT 'pairs/' || s_suppkey AS id, 'parts/' || s_suppkey AS f, 'suppliers/' || s_suppkey AS via FROM supplier WHERE s_suppkey % 2 = 0),
x AS (SELECT e.k, coalesce(h.f, e.f) AS f, e.t, via FROM e LEFT JOIN h ON e.f = h.id),
r AS (SELECT x.*, split_part(f, '/', 1) AS fp, split_part(t, '/', 1) AS tp, f IN (SELECT 'parts/' || p_partkey FROM part) OR f IN (SELECT 'suppliers/' || s_suppkey FROM supplier) AS okf, t LIKE 'variants/%' OR t IN (SELECT 'suppliers/' || s_suppkey FROM supplier) AS okt FROM x),
z AS (SELECT *, CASE WHEN fp = 'pairs' THEN 'hyperedge endpoint not in mirror' WHEN fp = 'things' THEN 'unknown endpoint type' WHEN NOT (okf AND okt) THEN 'dangling endpoint' END AS reason FROM r)"""


@query("edge_build", f"WITH {REASONED} SELECT coalesce(reason, 'kept') AS outcome, count(*) AS n, count(via) AS vias, CAST(sum(k) FILTER (WHERE reason IS NULL) AS BIGINT) AS keys FROM z GROUP BY 1")
def edge_build(spark, sf_dir):
    """Every edge comes out once, kept or with a reason."""
    edges, nodes, hyper = edge_parts(spark, sf_dir)
    kept, rejects = kg.edge_table(edges, nodes, TYPES, hyper)
    a = kept.agg(F.count(F.lit(1)).alias("n"), F.count("via").alias("vias"), F.sum("k").alias("keys")).withColumn("outcome", F.lit("kept"))
    b = rejects.groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("vias"), F.lit(None).cast("long").alias("keys"))
    return a.unionByName(b)


@query("referential_split", f"WITH {REASONED} SELECT f AS from_id, t AS to_id, count(*) AS n FROM z WHERE reason = 'dangling endpoint' GROUP BY f, t")
def referential_split(spark, sf_dir):
    edges, nodes, hyper = edge_parts(spark, sf_dir)
    return kg.edge_table(edges, nodes, TYPES, hyper)[1].where("reason = 'dangling endpoint'").groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n"))


@query("missing_stub_nodes", f"""
WITH {REASONED}, w AS (SELECT DISTINCT t AS id FROM z WHERE reason IS NULL AND tp = 'variants')
SELECT id, 'stub' AS kind, 'kg:' || id AS curie FROM w WHERE id NOT IN (SELECT 'variants/' || s_suppkey FROM supplier WHERE s_acctbal > 0) UNION ALL SELECT id, 'found', NULL FROM w WHERE id IN (SELECT 'variants/' || s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def missing_stub_nodes(spark, sf_dir):
    edges, nodes, hyper = edge_parts(spark, sf_dir)
    known = table(spark, sf_dir, "supplier").where("s_acctbal > 0").selectExpr("concat('variants/', s_suppkey) AS id")
    found, stubs = kg.referenced_nodes(kg.edge_table(edges, nodes, TYPES, hyper)[0], "Variant", known)
    return stubs.select("id", F.lit("stub").alias("kind"), "curie").unionByName(found.select("id", F.lit("found").alias("kind"), F.lit(None).cast("string").alias("curie")))


@query("graph_validate", """
SELECT * FROM (VALUES ('edges:lines:accounted', true), ('edges:lines:reject_rate', false), ('nodes:Part:unique_ids', true), ('nodes:Supplier:unique_ids', true)) t("check", ok)""")
def graph_validate(spark, sf_dir):
    """The planted edges hold more rejects than one in a hundred, so that gate fails and the others pass."""
    edges, nodes, hyper = edge_parts(spark, sf_dir)
    return kg.validate_build(nodes, {"lines": (edges, *kg.edge_table(edges, nodes, TYPES, hyper))}, 0.01).select("check", "ok")


GENES = "SELECT p_partkey AS id, upper(trim(split_part(p_name, ' ', 1))) || p_partkey % 300 AS symbol FROM part"


def identity(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("_key"), F.concat(F.substring_index("p_name", " ", 1), (F.col("p_partkey") % 300).cast("string")).alias("symbol"), F.concat(F.lit("ENTREZ:"), F.when(F.col("p_size") > 3, F.col("p_size"))).alias("entrez"), F.lit(None).cast("string").alias("hgnc"))
    tp = table(spark, sf_dir, "supplier").selectExpr("concat('transcripts/t', s_suppkey % 50) AS _from", "concat('proteins/p', s_suppkey) AS _to")
    gt = table(spark, sf_dir, "part").selectExpr("concat('genes/', p_partkey) AS _from", "concat('transcripts/t', p_partkey) AS _to")
    return kg.identity_index(p, tp, gt)


INDEX = f"""g AS ({GENES}), d AS (SELECT symbol, CAST(count(*) > 1 AS INT) AS amb FROM g GROUP BY symbol), gg AS (SELECT g.id, g.symbol, amb, p_size FROM g JOIN d ON g.symbol = d.symbol JOIN part ON p_partkey = g.id),
i AS (SELECT symbol AS alias, 'symbol' AS kind, symbol, id, amb FROM gg UNION ALL SELECT CAST(id AS VARCHAR), 'ensg', symbol, id, amb FROM gg UNION ALL SELECT CAST(p_size AS VARCHAR), 'entrez', symbol, id, amb FROM gg WHERE p_size > 3
  UNION ALL SELECT DISTINCT 'P' || s_suppkey, 'ensp', symbol, id, amb FROM supplier JOIN gg ON gg.id = s_suppkey % 50)"""


@query("identity_resolution", f"WITH {INDEX} SELECT alias, kind, symbol, CAST(id AS VARCHAR) AS gene_id, amb AS ambiguous FROM i")
def identity_resolution(spark, sf_dir):
    return identity(spark, sf_dir)


@query("alias_resolver", f"WITH {INDEX} SELECT alias, min(symbol) AS symbol FROM i WHERE amb = 0 GROUP BY alias HAVING count(DISTINCT symbol) = 1")
def alias_resolver(spark, sf_dir):
    return kg.resolver(identity(spark, sf_dir))


@query("ppi_merge_resolved", f"""
WITH {INDEX}, r AS (SELECT alias, min(symbol) AS symbol FROM i WHERE amb = 0 GROUP BY alias HAVING count(DISTINCT symbol) = 1), p AS (SELECT 'P' || l_suppkey AS a, 'P' || l_partkey % 120 AS b FROM lineitem)
SELECT DISTINCT least(x.symbol, y.symbol) AS a, greatest(x.symbol, y.symbol) AS b FROM p JOIN r x ON p.a = x.alias JOIN r y ON p.b = y.alias WHERE x.symbol <> y.symbol""")
def ppi_merge_resolved(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").selectExpr("concat('proteins/p', l_suppkey) AS _from", "concat('proteins/p', l_partkey % 120) AS _to")
    return kg.merge_interactions(pairs, kg.resolver(identity(spark, sf_dir)))


@query("membership_merge", f"""
WITH {INDEX}, r AS (SELECT alias, min(symbol) AS symbol FROM i WHERE amb = 0 GROUP BY alias HAVING count(DISTINCT symbol) = 1), e AS (SELECT DISTINCT 'w' || l_linenumber AS g, symbol FROM lineitem JOIN r ON alias = CAST(l_partkey AS VARCHAR))
SELECT g AS group_id, coalesce(n.n_name, g) AS label, symbol, count(*) OVER (PARTITION BY g) AS members FROM e LEFT JOIN nation n ON g = 'w' || n.n_nationkey AND n_nationkey % 2 = 0""")
def membership_merge(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").selectExpr("concat('genes/', l_partkey) AS _from", "concat('pathways/w', l_linenumber) AS _to")
    labels = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").selectExpr("concat('pathways/W', n_nationkey) AS _id", "n_name AS name")
    return kg.merge_memberships(e, kg.resolver(identity(spark, sf_dir)), labels, "_from", "_to")


@query("upsert_fold", """
WITH n AS (SELECT user_id AS id, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), a AS (SELECT id, count(*) AS observations, min_by(event_type, event_id) AS label, max_by(event_type, event_id) AS last_type, max_by(k, event_id) AS last_k FROM n GROUP BY id)
SELECT coalesce(a.id, c.c_custkey) AS id, CASE WHEN c.c_custkey IS NOT NULL THEN 'old' ELSE label END AS label, coalesce(a.observations, 0) + CASE WHEN c.c_custkey IS NOT NULL THEN 3 ELSE 0 END AS observations, last_type, CAST(last_k AS VARCHAR) AS last_k, CASE WHEN c.c_custkey IS NOT NULL THEN c.c_mktsegment END AS segment FROM a FULL JOIN (SELECT * FROM customer WHERE c_custkey <= 50) c ON a.id = c.c_custkey""")
def upsert_fold(spark, sf_dir):
    """Old nodes keep their label and what is not overwritten; later observations win."""
    old = table(spark, sf_dir, "customer").where("c_custkey <= 50").select(F.col("c_custkey").alias("id"), F.lit("user").alias("node_type"), F.lit("old").alias("label"), F.lit("x").alias("source"), F.create_map(F.lit("segment"), "c_mktsegment").alias("props"), F.lit(3).cast("long").alias("observations"))
    props = F.create_map(F.lit("type"), "event_type", F.lit("k"), F.get_json_object("props", "$.k"))
    new = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.lit("user").alias("node_type"), F.col("event_type").alias("label"), F.lit("y").alias("source"), props.alias("props"), F.col("event_id").alias("seq"))
    out = kg.upsert_nodes(old, new)
    at = lambda k: F.try_element_at("props", F.lit(k))
    return out.select("id", "label", "observations", at("type").alias("last_type"), at("k").alias("last_k"), at("segment").alias("segment"))


@query("upsert_edges", """
WITH n AS (SELECT DISTINCT 'c' || o_custkey AS a, 's' || o_orderstatus AS b, 'places' AS t, o_orderpriority AS s FROM orders), x AS (SELECT *, substr(sha1(a || '|' || b || '|' || t || '|' || s), 1, 16) AS id FROM n)
SELECT id, a AS from_id, b AS to_id FROM x""")
def upsert_edges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("from_id"), F.concat(F.lit("s"), "o_orderstatus").alias("to_id"), F.lit("places").alias("edge_type"), F.col("o_orderpriority").alias("source"))
    empty = spark.createDataFrame([], "id string, from_id string, to_id string, edge_type string, source string")
    first = kg.upsert_edges(empty, o.where("source < '3'"))
    return kg.upsert_edges(first, o).select("id", "from_id", "to_id")


PPI = "SELECT 'p' || l_partkey AS id_a, 's' || l_suppkey AS id_b, l_returnflag AS source, l_linestatus AS evidence_type FROM lineitem"


def interactions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("id_a"), F.concat(F.lit("s"), "l_suppkey").alias("id_b"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("evidence_type"))


@query("interaction_stats", f"WITH e AS ({PPI}) SELECT 'interactions' AS measure, 'all' AS term, count(*) AS n FROM e UNION ALL SELECT 'ids', 'all', count(DISTINCT id) FROM (SELECT id_a AS id FROM e UNION ALL SELECT id_b FROM e) UNION ALL SELECT 'source', source, count(*) FROM e GROUP BY source UNION ALL SELECT 'evidence_type', evidence_type, count(*) FROM e GROUP BY evidence_type")
def interaction_stats(spark, sf_dir):
    return kg.interaction_stats(interactions(spark, sf_dir), ["source", "evidence_type"])


@query("top_hubs", f"WITH e AS ({PPI}) SELECT id, count(*) AS degree FROM (SELECT id_a AS id FROM e UNION ALL SELECT id_b FROM e) GROUP BY id ORDER BY degree DESC, id LIMIT 30")
def top_hubs(spark, sf_dir):
    return kg.hubs(interactions(spark, sf_dir), 30)


@query("id_search", f"WITH e AS ({PPI}), u AS (SELECT id_a AS id, count(*) AS degree, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM e WHERE id_a ILIKE '%p10%' GROUP BY id_a UNION ALL SELECT id_b, count(*), string_agg(DISTINCT source, ',' ORDER BY source) FROM e WHERE id_b ILIKE '%p10%' GROUP BY id_b) SELECT id, max(degree) AS degree, max(sources) AS sources FROM u GROUP BY id ORDER BY 2 DESC, 1 LIMIT 20")
def id_search(spark, sf_dir):
    return kg.search_ids(interactions(spark, sf_dir), "P10", 20)


@query("node_summary", """
WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 200 AS b FROM lineitem), o AS (SELECT a AS n, count(*) AS x FROM e GROUP BY a), i AS (SELECT b AS n, count(*) AS x FROM e GROUP BY b), w AS (SELECT p_partkey % 200 AS n, string_agg(DISTINCT p_brand, ';' ORDER BY p_brand) AS p FROM part WHERE p_partkey % 200 < 40 GROUP BY 1)
SELECT coalesce(o.n, i.n) AS node, coalesce(o.x, 0) AS out_degree, coalesce(i.x, 0) AS in_degree, coalesce(o.x, 0) + coalesce(i.x, 0) AS total_degree, coalesce(w.p, '') AS pathways FROM o FULL JOIN i ON o.n = i.n LEFT JOIN w ON w.n = coalesce(o.n, i.n)""")
def node_summary(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 200).alias("target")).distinct()
    m = table(spark, sf_dir, "part").where("p_partkey % 200 < 40").select((F.col("p_partkey") % 200).alias("node"), F.col("p_brand").alias("pathway"))
    return kg.node_summary(e, m)


@query("collapsed_graph", """
WITH n AS (SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'sample' ELSE 'file' END AS kind, CASE WHEN o_orderkey % 5 = 0 THEN 'o' || o_orderkey ELSE 'f' || o_custkey % 7 || '::' || o_orderstatus END AS g, o_totalprice AS size FROM orders),
e AS (SELECT 'o' || l_orderkey AS a, 'o' || (l_orderkey + 1) AS b, CASE WHEN l_returnflag = 'A' THEN 'derived_from' ELSE l_returnflag END AS label FROM lineitem), l AS (SELECT DISTINCT x.g AS a, y.g AS b, label FROM e JOIN n x ON e.a = x.id JOIN n y ON e.b = y.id WHERE label <> 'derived_from' AND x.g <> y.g)
SELECT 'group' AS part, g AS a, CASE WHEN min(kind) = 'file' THEN 'filegroup' ELSE min(kind) END AS b, count(*) AS n FROM n GROUP BY g UNION ALL SELECT 'links', a, label, count(*) FROM l GROUP BY a, label""")
def collapsed_graph(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, "sample").otherwise("file").alias("kind"), F.concat(F.lit("f"), (F.col("o_custkey") % 7).cast("string")).alias("file_set"), F.col("o_orderstatus").alias("product"), F.col("o_totalprice").alias("size"))
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("a"), F.concat(F.lit("o"), (F.col("l_orderkey") + 1).cast("string")).alias("b"), F.when(F.col("l_returnflag") == "A", "derived_from").otherwise(F.col("l_returnflag")).alias("label"))
    groups, links = kg.collapse(n, e, ["derived_from"])
    one = groups.select(F.lit("group").alias("part"), F.col("id").alias("a"), F.col("kind").alias("b"), "n")
    return one.unionByName(links.groupBy("a", F.col("label").alias("b")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("links").alias("part"), "a", "b", "n"))


@query("evidence_pack", "WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS c FROM customer WHERE c_custkey % 50 = 1) SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS center, 'orders' AS relation, CAST(o_orderkey AS VARCHAR) AS other FROM orders WHERE CAST(o_custkey AS VARCHAR) IN (SELECT c FROM c) UNION ALL SELECT DISTINCT CAST(user_id AS VARCHAR), 'events', event_type FROM events WHERE CAST(user_id AS VARCHAR) IN (SELECT c FROM c)")
def evidence_pack(spark, sf_dir):
    center = table(spark, sf_dir, "customer").where("c_custkey % 50 = 1").select(F.col("c_custkey").cast("string").alias("center"))
    return kg.evidence_pack(center, {"orders": (table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey"), "events": (table(spark, sf_dir, "events"), "user_id", "event_type")})


@query("resolved_ids", f"WITH {INDEX}, q AS (SELECT DISTINCT 'p' || s_suppkey AS q FROM supplier WHERE s_suppkey % 7 = 0), h AS (SELECT DISTINCT q, id FROM q JOIN i ON upper(q) = alias) SELECT DISTINCT h.q AS query, i.symbol, CAST(i.id AS VARCHAR) AS gene_id, i.kind, i.alias FROM h JOIN i ON h.id = i.id")
def resolved_ids(spark, sf_dir):
    q = table(spark, sf_dir, "supplier").where("s_suppkey % 7 = 0").select(F.concat(F.lit(" p"), "s_suppkey").alias("query"))
    return kg.resolve_ids(identity(spark, sf_dir), q).withColumn("query", F.trim("query"))


@query("prior_knowledge", "SELECT 's' || l_suppkey AS source, 1 AS sign, trim(p_name) AS target FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 3 AND l_returnflag = 'A'")
def prior_knowledge(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    x = x.select(F.concat(F.lit(" s"), "l_suppkey").alias("id_a"), F.col("p_name").alias("id_b"), F.col("l_linenumber").alias("taxon"), F.col("l_returnflag").alias("evidence_type"))
    return kg.prior_knowledge(x, 3, "A")


@query("support_score", """
WITH c AS (SELECT DISTINCT o_custkey AS e, 'g' || o_orderkey % 40 AS g, o_orderstatus AS m FROM orders WHERE o_orderpriority = '1-URGENT'), p AS (SELECT DISTINCT o_custkey AS e, 'g' || o_orderkey % 40 AS g FROM orders WHERE o_orderpriority = '5-LOW'), l AS (SELECT o_custkey AS e, max(o_totalprice) AS s FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1),
u AS (SELECT e, g FROM c UNION SELECT e, g FROM p), k AS (SELECT e, g, count(DISTINCT m) AS n FROM c GROUP BY e, g)
SELECT u.e AS element, u.g AS gene, coalesce(k.n, 0) + CAST(p.e IS NOT NULL AS INT) + CAST(l.e IS NOT NULL AS INT) AS n_methods, coalesce(l.s, 0) AS loop_score, 3.0 * CAST(k.n IS NOT NULL AS INT) + 2.0 * CAST(l.e IS NOT NULL AS INT) + 1.0 * CAST(p.e IS NOT NULL AS INT) AS support FROM u LEFT JOIN k ON u.e = k.e AND u.g = k.g LEFT JOIN p ON u.e = p.e AND u.g = p.g LEFT JOIN l ON u.e = l.e""")
def support_score(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("element"), F.concat(F.lit("g"), (F.col("o_orderkey") % 40).cast("string")).alias("gene"), F.col("o_orderstatus").alias("method"), F.col("o_totalprice").alias("score"), "o_orderpriority")
    of = lambda p: o.where(F.col("o_orderpriority") == p)
    return kg.support_scores(of("1-URGENT"), of("2-HIGH"), of("5-LOW")).drop("methods")


@query("visible_items", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '5-LOW' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 3)")
def visible_items(spark, sf_dir):
    items = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderstatus = 'P' THEN 'shared' ELSE o_orderpriority END AS owner")
    members = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", "CASE WHEN l_suppkey = 3 THEN '5-LOW' ELSE 'x' END AS username")
    return kg.visible(items, members, "5-LOW").select("id")


@query("newest_first", "SELECT event_id AS ref FROM events WHERE upper(event_type) = 'VIEW' ORDER BY ts DESC, event_id LIMIT 50")
def newest_first(spark, sf_dir):
    return kg.newest(table(spark, sf_dir, "events").selectExpr("upper(event_type) AS accession", "ts AS at", "event_id AS ref"), " view ", 50).select("ref")


@query("cross_source_flags", """
SELECT c_custkey AS k, CASE WHEN s.s_suppkey IS NULL THEN 'second_missing' WHEN s_suppkey % 4 = 0 THEN 'second_error' ELSE concat_ws(',', CASE WHEN c_nationkey <> 1 AND s_nationkey <> 2 AND c_nationkey <> s_nationkey THEN 'x' END) END AS f FROM customer LEFT JOIN supplier s ON c_custkey = s_suppkey""".replace("concat_ws(',', CASE WHEN c_nationkey <> 1 AND s_nationkey <> 2 AND c_nationkey <> s_nationkey THEN 'x' END)", "CASE WHEN c_nationkey % 3 <> s_nationkey % 3 THEN 'disease_terms_disjoint,significance_differs' ELSE '' END").replace("AS f FROM", "AS flags FROM"))
def cross_source_flags(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("Sig_"), (F.col("c_nationkey") % 3).cast("string")).alias("significance"), F.concat(F.lit("word"), (F.col("c_nationkey") % 3).cast("string"), F.lit(" a"), "c_custkey").alias("disease"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 4 == 0, "error").otherwise("ok").alias("status"), F.concat(F.lit("sig "), (F.col("s_nationkey") % 3).cast("string")).alias("significance"), F.concat(F.lit("Word"), (F.col("s_nationkey") % 3).cast("string")).alias("disease"))
    return kg.cross_source(a, b, "k").select("k", "flags")


@query("with_experiment", """
WITH x AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, max(s_acctbal) AS v FROM supplier GROUP BY 1)
SELECT p_partkey, coalesce(a.v, b.v) AS effect FROM part LEFT JOIN x a ON a.k = CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END LEFT JOIN x b ON b.k = CAST(p_partkey % 80 AS VARCHAR)""")
def with_experiment(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).alias("first"), (F.col("p_partkey") % 80).cast("string").alias("second"))
    x = table(spark, sf_dir, "supplier").select(F.concat(F.lit(" "), "s_suppkey").alias("id"), F.col("s_acctbal").alias("effect"))
    return kg.with_experiment(rows, x, ["first", "second"], "id").select("p_partkey", "effect")


@query("functional_flags", """
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_tax >= 0.06e0 OR l_discount >= 0.06e0 AS a, l_quantity / 1000 >= 0.06e0 AS b, l_returnflag = 'R' AS clinical, l_linenumber > 3 AS qtl FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, a, b, clinical, qtl, a OR b OR clinical OR qtl AS any_flag, CAST(a AS INT) + CAST(b AS INT) + CAST(clinical AS INT) + CAST(qtl AS INT) AS n_flags FROM f""")
def functional_flags(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_discount", (F.col("l_quantity") / 1000).alias("q"), F.when(F.col("l_returnflag") == "R", "Likely_Pathogenic").alias("clin"))
    out = kg.functional_flags(x, {"a": ["l_tax", "l_discount"], "b": ["q"]}, 0.06, F.col("clin"), {"qtl": F.col("l_linenumber") - 3})
    return out.drop("l_tax", "l_discount", "q", "clin")


@query("warehouse_edges", "SELECT CASE WHEN l_returnflag = 'A' THEN 'protein' ELSE 'symbol' END AS src_type, CAST(l_partkey AS VARCHAR) AS src_id, CAST(l_suppkey AS VARCHAR) AS dst_id, 'interacts_with' AS relation, CASE WHEN l_linenumber <> 2 THEN l_tax END AS score, l_linestatus AS upstream FROM lineitem")
def warehouse_edges(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("id_a"), F.col("l_suppkey").cast("string").alias("id_b"), F.when(F.col("l_returnflag") == "A", "uniprot").otherwise("symbol").alias("id_type"), F.when(F.col("l_linenumber") != 2, F.col("l_tax").cast("string")).otherwise("n/a").alias("score"), F.lit("1").alias("pubmed_id"), F.lit("e").alias("evidence_type"), F.col("l_linestatus").alias("source"))
    return warehouse.interaction_edges(x).drop("dst_type", "pubmed_id", "evidence")


@query("hgvs_protein_parse", """
WITH x AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'G' ELSE 'W' END AS wt, p_size AS pos, CASE p_size % 4 WHEN 0 THEN '*' WHEN 1 THEN 'S' WHEN 2 THEN '?' ELSE 'V' END AS alt FROM part WHERE p_partkey % 9 > 0)
SELECT p_partkey AS key, wt, pos, alt FROM x""")
def hgvs_protein_parse(spark, sf_dir):
    wt = F.when(F.col("p_size") % 3 == 0, "Ala").when(F.col("p_size") % 3 == 1, "Gly").otherwise("Trp")
    alt = F.when(F.col("p_size") % 4 == 0, "Ter").when(F.col("p_size") % 4 == 1, "Ser").when(F.col("p_size") % 4 == 2, "=").otherwise("Val")
    h = F.when(F.col("p_partkey") % 9 == 0, "c.12A>G").otherwise(F.concat(F.lit("p.("), wt, "p_size", alt, F.lit(")")))
    x = table(spark, sf_dir, "part").select(F.concat(F.lit("urn:mavedb:"), "p_partkey").alias("urn"), h.alias("hgvs_pro"), F.lit(1.0).alias("score"), F.lit(0.0).alias("se"), F.lit(0).alias("abundance_class"))
    return warehouse.substitution_scores(x).select(F.col("gene_id").cast("long").alias("key"), F.col("aa_wt").alias("wt"), F.col("aa_position").alias("pos"), F.col("aa_alt").alias("alt"))


@query("ingest_routing", "SELECT 'genes' AS target, p_partkey AS k FROM part WHERE p_size % 4 = 0 UNION ALL SELECT 'variants', p_partkey FROM part WHERE p_size % 4 = 1 UNION ALL SELECT 'proteins', p_partkey FROM part WHERE p_size % 4 = 2")
def ingest_routing(spark, sf_dir):
    kind = F.when(F.col("p_size") % 4 == 0, "gene").when(F.col("p_size") % 4 == 1, "variant").when(F.col("p_size") % 4 == 2, "protein").otherwise("other")
    routed = warehouse.routed_nodes(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), kind.alias("node_type"), F.col("p_name").alias("label"), F.lit("x").alias("source")))
    out = None
    for name, rows in sorted(routed.items()):
        one = rows.select(F.lit(name).alias("target"), F.col(rows.columns[0]).cast("long").alias("k"))
        out = one if out is None else out.unionByName(one)
    return out


@query("warehouse_row_counts", "SELECT 'cells' AS table_name, (SELECT count(DISTINCT user_id) FROM events) AS n UNION ALL SELECT 'genes', count(*) FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'proteins', 0")
def warehouse_row_counts(spark, sf_dir):
    """Tables made, filled by upserts that meet the same keys twice, and counted."""
    ensure_checkpoint_dir(spark)
    names = {n: warehouse.TABLES[n] for n in ("genes", "cells", "proteins")}
    w = warehouse.Warehouse(spark, f"{spark.sparkContext.getCheckpointDir()}/warehouse-{uuid.uuid4().hex}", tables=names)
    w.init()
    genes = table(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.concat(F.lit("G"), "p_partkey").alias("gene_id"), F.col("p_name").alias("symbol"))
    w.upsert("genes", genes.where("symbol < 'm'"))
    w.upsert("genes", genes, replace=False)
    w.upsert("cells", table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("cell_id"), F.lit(1).alias("n_counts")))
    return w.row_counts()


@query("mirrored_ranges", "SELECT count(*) AS n, count(DISTINCT p_name || p_partkey) AS keys FROM part")
def mirrored_ranges(spark, sf_dir):
    """A table pulled range by range: every key is there once."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/mirror-{uuid.uuid4().hex}"
    df = table(spark, sf_dir, "part").withColumn("_key", F.concat("p_name", "p_partkey"))
    status = mirror.pull(df, "_key", path, max(1, df.count() // 3))
    if set(status.values()) != {"done"}:
        raise RuntimeError(f"ranges failed: {status}")
    return mirror.union_shards(spark, [f"{path}/{tag}" for tag in sorted(status)]).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_key").alias("keys"))


HOUR = "CAST(floor(epoch(ts) / 3600) AS BIGINT)"


@query("stream_tumbling_windows", f"SELECT {HOUR} AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling_windows(spark, sf_dir):
    """Windows that the watermark closes are appended to Parquet, over three runs from one ledger.

    Far events in the second and third run close the windows before them; a row of the first day in the third run is
    late by then and is left out.
    """
    ensure_checkpoint_dir(spark)
    top = f"{spark.sparkContext.getCheckpointDir()}/windows-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    ends = e.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))

    def planted(at, kind):
        row = ends.select(F.lit(-1).alias("event_id"), at.alias("ts"), F.lit(-1).alias("user_id"), F.lit(kind).alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
        return row.select(*(F.col(f.name).cast(f.dataType) for f in e.schema.fields))

    days = lambda n: F.col("hi") + F.expr(f"INTERVAL {n} DAYS")
    for name, df in (("a", e), ("b", planted(days(30), "far")), ("c", planted(days(60), "far").unionByName(planted(F.col("lo"), "late")))):
        df.write.parquet(f"{top}/in/{name}")
        counts = jobs.windowed_counts(jobs.file_stream(spark, f"{top}/in/*", e.schema), "ts", "event_type", "1 hour", "2 hours")
        jobs.append(counts, f"{top}/out", f"{top}/ledger").awaitTermination()
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("window.start").cast("timestamp_ntz"))
    return spark.read.parquet(f"{top}/out").where("event_type <> 'far'").select((seconds / 3600).cast("long").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sessions", """
WITH g AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800 THEN 0 ELSE 1 END AS o FROM events), s AS (SELECT user_id, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, n, count(*) AS sessions FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY user_id, k) GROUP BY user_id, n""")
def stream_sessions(spark, sf_dir):
    """Sessions of each user, closed by half an hour without events; a far event of the same user closes the last ones."""
    ensure_checkpoint_dir(spark)
    top = f"{spark.sparkContext.getCheckpointDir()}/sessions-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    for name, days in (("a", 0), ("b", 30), ("c", 60)):
        far = e.groupBy(F.lit(-1).alias("user_id")).agg((F.max("ts") + F.expr(f"INTERVAL {days} DAYS")).alias("ts"), F.lit(-1).alias("event_id"), F.lit("far").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
        (far.select(*(F.col(f.name).cast(f.dataType) for f in e.schema.fields)) if days else e).write.parquet(f"{top}/in/{name}")
        counts = jobs.session_counts(jobs.file_stream(spark, f"{top}/in/*", e.schema), "ts", "user_id", "30 minutes", "2 hours")
        jobs.append(counts, f"{top}/out", f"{top}/ledger").awaitTermination()
    return spark.read.parquet(f"{top}/out").where("user_id <> -1").groupBy("user_id", "n").agg(F.count(F.lit(1)).alias("sessions"))
