"""Knowledge graph build: typed nodes, checked edges with rejects, stubs, identities, merges and reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Type names of the model and what they are in Spark.
TYPES = {"STRING": "string", "INT64": "bigint", "DOUBLE": "double", "BOOL": "boolean"}
HUMAN, MOUSE = "Homo sapiens", "Mus musculus"


def typed(available: list[str], source: str | None, kind: str) -> Column:
    """A source column as its type, null where it does not fit or is not there."""
    return F.col(f"`{source}`").try_cast(TYPES[kind]) if source and source in available else F.lit(None).cast(TYPES[kind])


def packed_rest(available: list[str], used: set[str]) -> Column:
    """All other columns as one JSON object; null if there are none."""
    rest = [c for c in available if c not in used | {"_rev", "_key", "_id"}]
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in rest)), {"ignoreNullFields": "false"}) if rest else F.lit(None).cast("string")


def curie(table: str) -> Column:
    """Compact identifier of a node by its table and key."""
    key, own = F.col("_key"), F.concat(F.lit("kg:"), F.col("_id"))
    named = lambda prefix: F.concat(F.lit(f"{prefix}:"), key)
    if table in ("Gene", "Transcript", "Protein"):
        return named("ENSEMBL")
    if table == "OntologyTerm":
        return F.regexp_replace(key, "^([^_]*)_", "$1:")
    if table in ("Pathway", "Complex", "Drug"):
        return named({"Pathway": "REACT", "Complex": "ComplexPortal", "Drug": "PHARMGKB.DRUG"}[table])
    starts = {"Study": {"GCST": "GWAS"}, "Donor": {"ENCDO": "ENCODE"}, "Dataset": {"ENC": "ENCODE", "IGVF": "IGVF"}, "Variant": {"NC_": "SPDI"}}.get(table, {})
    out = own
    for start, prefix in reversed(list(starts.items())):
        out = F.when(key.startswith(start), named(prefix)).otherwise(out)
    return out


def ontology_category(categories: dict[str, str]) -> Column:
    """Category of an ontology term by the letters that its key begins with."""
    letters = F.regexp_extract("_key", "^([A-Za-z]+)", 1)
    out = F.lit("OntologyClass")
    for prefix, name in categories.items():
        out = F.when(letters == prefix, name).otherwise(out)
    return out


def taxon(default: str | None, available: list[str]) -> Column:
    """A collection's taxon: the given one, else by what the organism column says."""
    if default:
        return F.lit(default)
    if "organism" not in available:
        return F.lit(None).cast("string")
    organism = F.col("organism").cast("string")
    return F.when(organism.ilike("%sapiens%"), HUMAN).when(organism.ilike("%musculus%"), MOUSE).otherwise(organism)


def node_table(source: DataFrame, table: str, columns: dict[str, tuple[str, str | None]], default_taxon: str | None = None, categories: dict[str, str] | None = None) -> DataFrame:
    """id, curie, name, taxon, source, the table's columns and props of a source collection.

    columns maps a column to its type and source column. What the model does not name is packed into props; a gene is
    named by its symbol if it has one.
    """
    have = source.columns
    name = typed(have, "name", "STRING")
    if table == "Gene" and "symbol" in have:
        name = F.coalesce(F.col("symbol").cast("string"), name)
    own = [ontology_category(categories or {}).alias(c) if table == "OntologyTerm" and c == "category" else typed(have, src, kind).alias(c) for c, (kind, src) in columns.items()]
    used = {"source", "name"} | {src for _, src in columns.values() if src}
    return source.select(F.col("_id").alias("id"), curie(table).alias("curie"), name.alias("name"), taxon(default_taxon, have).alias("taxon"), typed(have, "source", "STRING").alias("source"), *own, packed_rest(have, used).alias("props"))


def edge_table(edges: DataFrame, nodes: dict[str, DataFrame], tables: dict[str, str], hyperedges: DataFrame | None = None, unchecked: tuple[str, ...] = ("Variant",)) -> tuple[DataFrame, DataFrame]:
    """(kept, rejects) of edges (_from, _to, ...): typed endpoints that exist, and the others with a reason.

    tables maps the prefix of an id (before /) to its node table, nodes a table to its ids (id). An endpoint that names
    an edge of hyperedges (_id, _from, _to) is replaced by that edge's start, and its end is kept in via. Endpoints in
    unchecked tables need not exist, as their nodes are made from the edges. Every edge comes out in one of the two, with
    how often it was there: rejects for an unknown endpoint type, a hyperedge that is not there, or a dangling endpoint.
    """
    rest = [c for c in edges.columns if c not in ("_from", "_to")]
    prefix = lambda c: F.substring_index(F.col(c), "/", 1)
    e = edges.select(F.col("_from").alias("from_id"), F.col("_to").alias("to_id"), *rest)
    if hyperedges is not None:
        h = hyperedges.select(F.col("_id").alias("_h"), F.col("_from").alias("_hf"), F.col("_to").alias("via")).dropDuplicates(["_h"])
        e = e.join(h, F.col("from_id") == F.col("_h"), "left").withColumn("from_id", F.coalesce("_hf", "from_id")).drop("_h", "_hf")
    else:
        e = e.withColumn("via", F.lit(None).cast("string"))
    mapping = F.create_map(*(x for k, v in sorted(tables.items()) for x in (F.lit(k), F.lit(v))))
    e = e.withColumns({"from_type": F.try_element_at(mapping, prefix("from_id")), "to_type": F.try_element_at(mapping, prefix("to_id"))})
    hyper = set() if hyperedges is None else {"hyper"}
    if hyper:
        kinds = hyperedges.select(F.substring_index("_id", "/", 1).alias("_p")).distinct()
        named = F.broadcast(kinds)  # names of edge collections: a few
        e = e.join(named.withColumn("_hyper_from", F.lit(True)), prefix("from_id") == F.col("_p"), "left").drop("_p")
        e = e.join(named.withColumn("_hyper_to", F.lit(True)), prefix("to_id") == F.col("_p"), "left").drop("_p")
        edge_like = F.coalesce("_hyper_from", F.lit(False)) | F.coalesce("_hyper_to", F.lit(False))
    else:
        edge_like = F.lit(False)
    ids = None
    for table, df in sorted(nodes.items()):
        if table not in unchecked:
            part = df.select(F.lit(table).alias("_t"), F.col("id").alias("_i")).distinct()
            ids = part if ids is None else ids.unionByName(part)
    found_from = found_to = F.lit(True)
    if ids is not None:
        a, b = (ids.toDF(f"_t{s}", f"_i{s}").withColumn(f"_f{s}", F.lit(True)) for s in ("1", "2"))
        e = e.join(a, (F.col("from_type") == F.col("_t1")) & (F.col("from_id") == F.col("_i1")), "left").join(b, (F.col("to_type") == F.col("_t2")) & (F.col("to_id") == F.col("_i2")), "left")
        found_from = F.col("from_type").isin(*unchecked) | F.coalesce("_f1", F.lit(False))
        found_to = F.col("to_type").isin(*unchecked) | F.coalesce("_f2", F.lit(False))
    unknown = F.col("from_type").isNull() | F.col("to_type").isNull()
    reason = F.when(unknown & edge_like, "hyperedge endpoint not in mirror").when(unknown, "unknown endpoint type").when(~(found_from & found_to), "dangling endpoint")
    e = e.withColumn("reason", reason)
    kept = e.where("reason IS NULL").select("from_id", "to_id", "from_type", "to_type", *rest, "via")
    return kept, e.where("reason IS NOT NULL").select("from_id", "to_id", "reason")


def referenced_nodes(edges: DataFrame, table: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, stubs): the known nodes that edges refer to in a table, and rows (id, curie, taxon, props) for the others."""
    want = edges.where(F.col("from_type") == table).select(F.col("from_id").alias("id")).unionByName(edges.where(F.col("to_type") == table).select(F.col("to_id").alias("id"))).distinct()
    found = known.join(want, "id", "left_semi")
    mouse = F.when(F.col("id").startswith("mm_"), MOUSE).otherwise(HUMAN)
    stubs = want.join(known.select("id").distinct(), "id", "left_anti").select("id", F.concat(F.lit("kg:"), "id").alias("curie"), mouse.alias("taxon"), F.lit(json.dumps({"_missing": "not in mirror"})).alias("props"))
    return found, stubs


def validate_build(nodes: dict[str, DataFrame], edges: dict[str, tuple[DataFrame, DataFrame, DataFrame]], max_reject_rate: float) -> DataFrame:
    """(check, ok, detail): ids are unique, every edge is kept or rejected, and few are rejected.

    edges maps a collection to (input, kept, rejects); the counts are taken in one job each.
    """
    parts = []
    for table, df in sorted(nodes.items()):
        c = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("different"))
        parts.append(c.select(F.lit(f"nodes:{table}:unique_ids").alias("check"), (F.col("rows") == F.col("different")).alias("ok"), F.to_json(F.struct("rows", "different")).alias("detail")))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    for name, (given, kept, rejects) in sorted(edges.items()):
        c = count(given, "rows_in").crossJoin(count(kept, "rows_out")).crossJoin(count(rejects, "rejected"))  # one row each
        parts.append(c.select(F.lit(f"edges:{name}:accounted").alias("check"), (F.col("rows_in") == F.col("rows_out") + F.col("rejected")).alias("ok"), F.to_json(F.struct("rows_in", "rows_out", "rejected")).alias("detail")))
        rate = F.when(F.col("rows_in") > 0, F.col("rejected") / F.col("rows_in")).otherwise(0.0)
        parts.append(c.select(F.lit(f"edges:{name}:reject_rate").alias("check"), (rate <= max_reject_rate).alias("ok"), F.to_json(F.struct(F.round(rate, 6).alias("rate"))).alias("detail")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def identity_index(genes: DataFrame, transcripts_proteins: DataFrame, genes_transcripts: DataFrame, proteins: DataFrame | None = None) -> DataFrame:
    """(alias, kind, symbol, gene_id, ambiguous) of genes (_key, symbol, entrez, hgnc) and their proteins.

    Aliases are upper case; external ids keep what stands after the last colon. A symbol of more than one gene is
    ambiguous in every row. Proteins come over genes_transcripts and transcripts_proteins (_from, _to), their accessions
    from proteins (_key, uniprot_ids as JSON).
    """
    key = lambda c: F.substring_index(F.col(c), "/", -1)
    some = genes.where("symbol IS NOT NULL")
    twice = some.groupBy("symbol").agg((F.count(F.lit(1)) > 1).cast("int").alias("ambiguous"))
    g = some.join(twice, "symbol").select(F.col("_key").alias("gene_id"), F.upper(F.trim("symbol")).alias("symbol"), "ambiguous", "entrez", "hgnc")
    last = lambda c: F.upper(F.trim(F.substring_index(F.col(c).cast("string"), ":", -1)))
    each = F.array(*(F.struct(a.alias("alias"), F.lit(k).alias("kind")) for a, k in ((F.col("symbol"), "symbol"), (F.upper(F.col("gene_id").cast("string")), "ensg"), (last("entrez"), "entrez"), (last("hgnc"), "hgnc"))))
    direct = g.select(F.explode(each).alias("a"), "symbol", "gene_id", "ambiguous").select("a.alias", "a.kind", "symbol", "gene_id", "ambiguous").where("alias IS NOT NULL AND alias <> ''")
    tp, gt = transcripts_proteins.select(key("_from").alias("t"), key("_to").alias("p")), genes_transcripts.select(key("_from").alias("gene_id"), key("_to").alias("t"))
    hop = tp.join(gt, "t").select("p", "gene_id").distinct().join(g.select("gene_id", "symbol", "ambiguous"), "gene_id")
    out = direct.unionByName(hop.select(F.upper("p").alias("alias"), F.lit("ensp").alias("kind"), "symbol", "gene_id", "ambiguous"))
    if proteins is not None:
        acc = proteins.select(key("_key").alias("p"), F.explode(F.from_json("uniprot_ids", "array<string>")).alias("acc")).where("acc IS NOT NULL AND acc <> ''")
        out = out.unionByName(acc.join(hop, "p").select(F.upper("acc").alias("alias"), F.lit("uniprot").alias("kind"), "symbol", "gene_id", "ambiguous"))
    return out


def resolver(index: DataFrame, allow_ambiguous: bool = False) -> DataFrame:
    """(alias, symbol): aliases that stand for one symbol, those of ambiguous symbols only if allowed."""
    some = index if allow_ambiguous else index.where("ambiguous = 0")
    return some.groupBy("alias").agg(F.min("symbol").alias("symbol"), F.max("symbol").alias("_most")).where("symbol = _most").drop("_most")


def merge_interactions(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b) in order, once each, of pairs (_from, _to) whose ends both resolve, to different symbols."""
    key = lambda c: F.upper(F.substring_index(F.col(c), "/", -1))
    one, two = names.toDF("_x", "sa"), names.toDF("_y", "sb")
    met = pairs.select(key("_from").alias("_x"), key("_to").alias("_y")).join(one, "_x").join(two, "_y").where("sa <> sb")
    return met.select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b")).distinct()


def merge_memberships(edges: DataFrame, names: DataFrame, labels: DataFrame, member: str, group: str) -> DataFrame:
    """(group_id, label, symbol, members): groups with each of their members that resolve; labels (_id, name) name them.

    members counts the resolved members of the group; a group without any is left out, one without a label is its own.
    """
    key = lambda c: F.substring_index(F.col(c), "/", -1)
    e = edges.select(key(group).alias("group_id"), F.upper(key(member)).alias("alias")).join(names, "alias").select("group_id", "symbol").distinct()
    n = e.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"))
    named = labels.groupBy(F.upper(key("_id")).alias("_g")).agg(F.min("name").alias("label"))
    return e.join(n, "group_id").join(named, F.upper("group_id") == F.col("_g"), "left").select("group_id", F.coalesce("label", "group_id").alias("label"), "symbol", "members")


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes (id, node_type, label, source, props map, observations) after observations new (the same and seq) come in.

    Properties of later observations win, the first source and label stay, observations count.
    """
    first = old.select("id", "node_type", "label", "source", "props", "observations", F.lit(-1).cast("long").alias("seq"))
    every = first.unionByName(new.select("id", "node_type", "label", "source", "props", F.lit(1).cast("long").alias("observations"), F.col("seq").cast("long")))
    by = every.groupBy("id").agg(F.min_by("node_type", "seq").alias("node_type"), F.min_by("label", "seq").alias("label"), F.min_by("source", F.when(F.col("source").isNotNull(), F.col("seq"))).alias("source"), F.array_sort(F.collect_list(F.struct("seq", F.map_entries(F.coalesce("props", F.expr("map()"))).alias("e")))).alias("log"), F.sum("observations").alias("observations"))
    entries = F.flatten(F.transform("log", lambda x: x["e"]))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return by.select("id", "node_type", "label", "source", F.map_from_arrays(keys, F.transform(keys, last)).alias("props"), "observations")


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by the digest of (from, to, type, source): those that are there stay, new ones come in once."""
    digest = F.substring(F.sha1(F.concat_ws("|", "from_id", "to_id", "edge_type", "source")), 1, 16)
    fresh = new.withColumn("id", digest).dropDuplicates(["id"]).join(old.select("id"), "id", "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def interaction_stats(edges: DataFrame, groups: list[str]) -> DataFrame:
    """(measure, term, n) of interactions (id_a, id_b, ...): rows, different ids, and rows by each group column."""
    ends = edges.select(F.explode(F.array("id_a", "id_b")).alias("id"))
    out = edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("interactions").alias("measure"), F.lit("all").alias("term"), "n")
    out = out.unionByName(ends.agg(F.count_distinct("id").alias("n")).select(F.lit("ids").alias("measure"), F.lit("all").alias("term"), "n"))
    for g in groups:
        out = out.unionByName(edges.groupBy(F.col(g).cast("string").alias("term")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(g).alias("measure"), "term", "n"))
    return out


def hubs(edges: DataFrame, k: int) -> DataFrame:
    """The k ids of the most ends of edges (id_a, id_b); equals by id."""
    ends = edges.select(F.explode(F.array("id_a", "id_b")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.col("degree").desc(), "id").limit(k)


def search_ids(edges: DataFrame, term: str, limit: int = 50) -> DataFrame:
    """(id, degree, sources) of ids that hold the term, by the larger of their two one-sided degrees."""
    like = f"%{term}%"
    side = lambda c: edges.where(F.col(c).ilike(like)).groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    both = side("id_a").unionByName(side("id_b")).groupBy("id").agg(F.max("degree").alias("degree"), F.max("sources").alias("sources"))
    return both.orderBy(F.col("degree").desc(), "id").limit(limit)


def node_summary(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(node, in_degree, out_degree, total_degree, pathways) of directed edges (source, target) and members (node, pathway)."""
    out = edges.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    both = out.join(into, "node", "full_outer").na.fill(0, ["out_degree", "in_degree"]).withColumn("total_degree", F.col("out_degree") + F.col("in_degree"))
    if members is None:
        return both.withColumn("pathways", F.lit(""))
    named = members.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("pathway")), ";").alias("pathways"))
    return both.join(named, "node", "left").withColumn("pathways", F.coalesce("pathways", F.lit("")))


def collapse(nodes: DataFrame, edges: DataFrame, skip: list[str]) -> tuple[DataFrame, DataFrame]:
    """(groups, links): file nodes (id, kind, file_set, product, size) as one node a file set and product, and the links left.

    groups (id, kind, n, size); links (a, b, label) between different groups, without the labels to skip.
    """
    group = F.when(F.col("kind") == "file", F.concat(F.coalesce("file_set", F.lit("none")), F.lit("::"), F.coalesce("product", F.lit("none")))).otherwise(F.col("id"))
    of = nodes.select("id", group.alias("g"), "kind", "size")
    groups = of.groupBy(F.col("g").alias("id")).agg(F.min(F.when(F.col("kind") == "file", "filegroup").otherwise(F.col("kind"))).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    one, two = of.select(F.col("id").alias("a"), F.col("g").alias("ga")), of.select(F.col("id").alias("b"), F.col("g").alias("gb"))
    links = edges.where(~F.col("label").isin(skip)).join(one, "a").join(two, "b").where("ga <> gb").select(F.col("ga").alias("a"), F.col("gb").alias("b"), "label").distinct()
    return groups, links


def evidence_pack(center: DataFrame, relations: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(center, relation, other) over all relations: name -> (edges, column of the centre, column of the other end)."""
    parts = [edges.select(F.col(a).cast("string").alias("center"), F.lit(name).alias("relation"), F.col(b).cast("string").alias("other")).join(center, "center", "left_semi").distinct() for name, (edges, a, b) in sorted(relations.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def resolve_ids(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, symbol, gene_id, kind, alias): every alias of the genes that a query (query) names under any alias."""
    hit = queries.join(index.select(F.col("alias").alias("_a"), "gene_id"), F.upper(F.trim("query")) == F.col("_a")).select("query", "gene_id").distinct()
    return hit.join(index, "gene_id").select("query", "symbol", "gene_id", "kind", "alias").distinct()


def prior_knowledge(interactions: DataFrame, taxon_id: int, evidence: str | None = None, sign: int = 1) -> DataFrame:
    """(source, sign, target) of interactions of one taxon, and one kind of evidence if it is given; empty ends go."""
    x = interactions.where(F.col("taxon") == taxon_id)
    if evidence is not None:
        x = x.where(F.col("evidence_type") == evidence)
    return x.select(F.trim("id_a").alias("source"), F.lit(sign).alias("sign"), F.trim("id_b").alias("target")).where("source <> '' AND target <> ''")


def support_scores(catalog: DataFrame, loops: DataFrame, proximity: DataFrame) -> DataFrame:
    """(element, gene, methods, n_methods, loop_score, support): 3 for catalogue links, 2 for loops, 1 for proximity.

    catalog (element, gene, method), loops (element, score), proximity (element, gene). Loops support the pairs that
    the others found; they make none themselves. A pair without a gene is none.
    """
    c = catalog.where("gene <> ''").groupBy("element", "gene").agg(F.collect_set(F.concat(F.lit("catalog:"), F.coalesce("method", F.lit("")))).alias("_c"))
    p = proximity.where("gene <> ''").select("element", "gene", F.lit(True).alias("_p")).distinct()
    loop = loops.groupBy("element").agg(F.max("score").alias("_l"))
    x = c.join(p, ["element", "gene"], "full_outer").join(loop, "element", "left")
    none = F.expr("cast(array() as array<string>)")
    methods = F.concat(F.coalesce("_c", none), F.when(F.col("_l").isNotNull(), F.array(F.lit("loops"))).otherwise(none), F.when(F.col("_p"), F.array(F.lit("proximity"))).otherwise(none))
    support = F.when(F.col("_c").isNotNull(), 3.0).otherwise(0.0) + F.when(F.col("_l").isNotNull(), 2.0).otherwise(0.0) + F.when(F.col("_p"), 1.0).otherwise(0.0)
    return x.select("element", "gene", F.array_join(F.array_sort(methods), ",").alias("methods"), F.size(methods).alias("n_methods"), F.coalesce("_l", F.lit(0.0)).alias("loop_score"), support.alias("support"))


def visible(items: DataFrame, members: DataFrame, viewer: str | None, shared_owner: str = "shared") -> DataFrame:
    """items (id, owner) that a viewer owns, that are shared, or of which they are a member (id, username); all for None."""
    if viewer is None:
        return items
    own = items.where(F.col("owner").isin(viewer, shared_owner)).select("id")
    return items.join(own.unionByName(members.where(F.col("username") == viewer).select("id")).distinct(), "id", "left_semi")


def newest(index: DataFrame, accession: str, limit: int) -> DataFrame:
    """Rows of one accession, the newest first."""
    return index.where(F.col("accession") == accession.strip().upper()).orderBy(F.col("at").desc(), "ref").limit(limit)


def cross_source(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, flags, agree): what two sources (key, status, significance, disease) say about one key.

    Flags: the second has not the record, significances differ (underscores and case aside), no common disease word.
    """
    plain = lambda c: F.lower(F.trim(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("_"), F.lit(" "))))
    words = lambda c: F.array_distinct(F.filter(F.split(plain(c), r"\s+"), lambda w: w != ""))
    x = a.select(key, F.col("significance").alias("sa"), F.col("disease").alias("da")).join(b.select(key, F.col("status").alias("st"), F.col("significance").alias("sb"), F.col("disease").alias("db")), key, "left")
    ok = F.coalesce(F.col("st") == "ok", F.lit(False))
    flag = lambda when, name: F.when(when, F.lit(name))
    both = lambda p, q: (plain(p) != "") & (plain(q) != "")
    flags = F.array_sort(F.array_compact(F.array(F.when(~ok, F.concat(F.lit("second_"), F.coalesce("st", F.lit("missing")))), flag(ok & both("sa", "sb") & (plain("sa") != plain("sb")), "significance_differs"), flag(ok & both("da", "db") & ~F.arrays_overlap(words("da"), words("db")), "disease_terms_disjoint"))))
    return x.select(key, F.array_join(flags, ",").alias("flags"), (F.size(flags) == 0).alias("agree"))


def with_experiment(rows: DataFrame, experiment: DataFrame, candidates: list[str], join_col: str) -> DataFrame:
    """rows with the columns of an experiment, by the first of the candidate columns whose value it knows.

    Of rows of the experiment with one key the largest counts; blank keys do not.
    """
    fields = [c for c in experiment.columns if c != join_col]
    one = experiment.withColumn("_k", F.trim(F.col(join_col))).where("_k <> ''").groupBy("_k").agg(F.max(F.struct(*fields)).alias("_x"))
    keyed = rows.withColumn("_row", F.struct(*(F.col(f"`{c}`") for c in rows.columns)))
    tried = keyed.select("_row", F.posexplode(F.array(*(F.col(f"`{c}`").cast("string") for c in candidates))).alias("_n", "_k"))
    best = tried.join(one, "_k").groupBy("_row").agg(F.min_by("_x", "_n").alias("_x"))
    return keyed.select("_row").join(best, "_row", "left").select("_row.*", *(F.col(f"_x.`{c}`").alias(c) for c in fields))


def functional_flags(rows: DataFrame, groups: dict[str, list[str]], threshold: float, terms: Column, counts: dict[str, Column]) -> DataFrame:
    """rows with a flag per group of scores (any from the threshold on), for harmful terms and for counts above 0.

    any_flag is whether one of them holds, n_flags how many.
    """
    above = lambda c: F.coalesce(F.col(c).try_cast("double") >= threshold, F.lit(False))
    flags: dict[str, Column] = {}
    for name, columns in groups.items():
        hit = F.lit(False)
        for c in columns:
            hit = hit | above(c)
        flags[name] = hit
    low = F.lower(F.coalesce(terms, F.lit("")))
    flags["clinical"] = low.contains("pathogenic") | low.contains("drug_response")
    flags |= {name: F.coalesce(c, F.lit(0)) > 0 for name, c in counts.items()}
    out = rows.withColumns(flags)
    total = sum((F.col(n).cast("int") for n in flags), F.lit(0))
    return out.withColumns({"any_flag": total > 0, "n_flags": total})
