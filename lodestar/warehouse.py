"""Warehouse of Parquet tables: a schema registry, upserts, views, read-only SQL, and the provenance of every write."""

from __future__ import annotations

import datetime
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: table -> (schema, key columns)
TABLES: dict[str, tuple[str, list[str]]] = {
    "genes": ("gene_id string, symbol string, aliases array<string>, organism_taxid int, source_priority string", ["gene_id"]),
    "variants": ("variant_id string, rsid string, chrom string, pos bigint, ref string, alt string", ["variant_id"]),
    "proteins": ("uniprot_ac string, symbol string, gene_id string, organism_taxid int", ["uniprot_ac"]),
    "regulatory_elements": ("element_id string, chrom string, start bigint, end bigint, class string", ["element_id"]),
    "samples": ("sample_id string, biosample string, organism string", ["sample_id"]),
    "datasets": ("dataset_id string, upstream_source string, accession string, title string, assay string, modality string, year int, n_samples int, pubmed_id string, license string", ["dataset_id"]),
    "cells": ("cell_id string, dataset_id string, n_counts bigint, call string", ["cell_id"]),
    "edges": ("src_type string, src_id string, dst_type string, dst_id string, relation string, score double, pubmed_id string, evidence string, upstream string", ["src_type", "src_id", "dst_type", "dst_id", "relation", "upstream"]),
    "vampseq_scores": ("gene_id string, aa_position int, aa_wt string, aa_alt string, score double, se double, abundance_class int, dataset_id string, upstream string", ["gene_id", "aa_position", "aa_wt", "aa_alt", "dataset_id"]),
    "perturbseq_effects": ("guide string, gene_id string, log2fc double, p_value double, dataset_id string", ["guide", "gene_id", "dataset_id"]),
    "versions": ("name string, version string", ["name"]),
    "qc": ("check_name string, ok boolean, detail string", ["check_name"]),
    "runs": ("run_id string, skill string, subcommand string, args string, started string, rows bigint, target_table string, success boolean", ["run_id"]),
}
#: What a statement must begin with, and the words that no part of it may begin with.
READS, WRITES = ("select", "with", "values", "show", "describe", "desc", "explain", "table", "from"), r"insert|update|delete|merge|create|drop|alter|truncate|replace|load|msck|analyze|cache|uncache|refresh|set|reset|add|grant|revoke|call|use|export|import|overwrite"


def guarded(sql: str) -> str:
    """The statement, if it is one that only reads; else an error. Text in quotes and comments is not looked at."""
    plain = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`", "''", re.sub(r"/\*.*?\*/|--[^\n]*", " ", sql, flags=re.S))
    parts = [p.strip() for p in plain.split(";") if p.strip()]
    if len(parts) != 1 or not re.match(rf"\(*\s*(?:{'|'.join(READS)})\b", parts[0], re.I) or re.search(rf"(?:^|[(])\s*(?:{WRITES})\b|\binsert\s+(?:into|overwrite)\b", parts[0], re.I):
        raise ValueError("only one statement that reads is allowed")
    return sql.strip().rstrip(";")


class Warehouse:
    """Tables as folders of Parquet under one path, each written whole beside the old one and then named by a pointer row."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False, tables: dict[str, tuple[str, list[str]]] | None = None):
        self.spark, self.path, self.read_only, self.tables = spark, path.rstrip("/"), read_only, tables or TABLES

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _version(self, name: str) -> int:
        fs, path = self._fs()
        folder = path(f"{self.path}/{name}")
        found = [int(s.getPath().getName()[1:]) for s in (fs.listStatus(folder) if fs.exists(folder) else []) if re.fullmatch(r"v\d+", s.getPath().getName()) and fs.exists(path(f"{s.getPath()}/_SUCCESS"))]
        return max(found, default=-1)

    def _write(self, name: str, df: DataFrame) -> None:
        if self.read_only:
            raise PermissionError("the warehouse is open for reading only")
        # a version counts once its _SUCCESS file is there; readers of the old one are not disturbed
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}/v{self._version(name) + 1}")

    def init(self) -> list[str]:
        """Make the tables that are not there yet, empty; safe to repeat. Returns their names."""
        for name, (schema, _) in self.tables.items():
            if self._version(name) < 0:
                self._write(name, self.spark.createDataFrame([], schema))
        return sorted(self.tables)

    def table(self, name: str) -> DataFrame:
        version = self._version(name)
        if version < 0:
            raise KeyError(f"no table {name}")
        return self.spark.read.schema(StructType.fromDDL(self.tables[name][0])).parquet(f"{self.path}/{name}/v{version}")

    def fitted(self, name: str, rows: DataFrame) -> DataFrame:
        """rows as the table's columns and types; columns that rows have not are null."""
        schema = StructType.fromDDL(self.tables[name][0])
        return rows.select(*((F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))

    def upsert(self, name: str, rows: DataFrame, replace: bool = True) -> None:
        """Put rows in by the table's key: a row with the key is replaced, or else kept. Of equal keys one row counts."""
        _, key = self.tables[name]
        new = self.fitted(name, rows).dropDuplicates(key)
        old = self.table(name)
        match = lambda a, b: [a[k].eqNullSafe(b[k]) for k in key]
        if replace:
            out = old.join(new, match(old, new), "left_anti").unionByName(new)
        else:
            out = old.unionByName(new.join(old, match(new, old), "left_anti"))
        self._write(name, out)

    def append(self, name: str, rows: DataFrame) -> None:
        self._write(name, self.table(name).unionByName(self.fitted(name, rows)))

    def record_run(self, skill: str, subcommand: str, args: dict, rows: int, target: str, success: bool, now: datetime.datetime) -> str:
        """Note a run; the time comes from the caller, to the microsecond, so that ids differ and tests repeat."""
        label = lambda t: re.sub(r"[^A-Za-z0-9_.-]", "_", t)
        run_id = f"{now:%Y%m%d_%H%M%S}_{now.microsecond:06d}_{label(skill)}_{label(subcommand)}_{label(target)[:20]}"
        row = [(run_id, skill, subcommand, json.dumps(args, default=str, sort_keys=True), f"{now:%Y-%m-%d %H:%M:%S}", rows, target, success)]
        self.append("runs", self.spark.createDataFrame(row, self.tables["runs"][0]))
        return run_id

    def register(self, prefix: str = "") -> list[str]:
        """One temporary view per table; returns their names."""
        out = []
        for name in sorted(self.tables):
            if self._version(name) >= 0:
                self.table(name).createOrReplaceTempView(f"{prefix}{name}")
                out.append(f"{prefix}{name}")
        return out

    def query(self, sql: str, limit: int | None = None) -> DataFrame:
        """A statement that reads, over the registered tables; a limit goes into the plan."""
        text = guarded(sql)
        self.register()
        out = self.spark.sql(text)
        return out.limit(limit) if limit is not None else out

    def row_counts(self) -> DataFrame:
        """(table_name, n) of every table."""
        out = None
        for name in sorted(self.tables):
            if self._version(name) >= 0:
                one = self.table(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
                out = one if out is None else out.unionByName(one)
        if out is None:
            raise KeyError("the warehouse has no tables")
        return out

    def last_runs(self, n: int = 5) -> DataFrame:
        return self.table("runs").orderBy(F.col("run_id").desc()).limit(n)


#: One-letter names of amino acids.
AMINO = {"Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C", "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I", "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P", "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V", "Ter": "*"}


def amino(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for three, one in AMINO.items():
        out = F.when(name == three, one).otherwise(out)
    return out


def protein_rows(id_map: DataFrame) -> DataFrame:
    """Rows of proteins from (uniprot_ac, ensembl, symbol)."""
    return id_map.where("uniprot_ac IS NOT NULL").select("uniprot_ac", "symbol", F.col("ensembl").alias("gene_id"), F.lit(9606).alias("organism_taxid"))


def interaction_edges(interactions: DataFrame) -> DataFrame:
    """Rows of edges from interactions; an id type uniprot means proteins."""
    kind = F.when(F.col("id_type") == "uniprot", "protein").otherwise(F.col("id_type"))
    return interactions.select(kind.alias("src_type"), F.col("id_a").alias("src_id"), kind.alias("dst_type"), F.col("id_b").alias("dst_id"), F.lit("interacts_with").alias("relation"), F.col("score").try_cast("double").alias("score"), "pubmed_id", F.col("evidence_type").alias("evidence"), F.col("source").alias("upstream"))


def catalogue_datasets(datasets: DataFrame) -> DataFrame:
    """Rows of datasets from catalogue records: lists joined, numbers that are 0 null, records without an id left out."""
    zero = lambda c: F.nullif(F.coalesce(F.col(c).try_cast("int"), F.lit(0)), F.lit(0))
    joined = lambda c: F.array_join(F.coalesce(F.col(c), F.expr("cast(array() as array<string>)")), ", ")
    some = datasets.where("dataset_id IS NOT NULL AND dataset_id <> ''")
    title = F.coalesce(F.nullif(F.col("study_title"), F.lit("")), F.col("experiment_title"))
    return some.select(F.concat(F.lit("pcat:"), "dataset_id").alias("dataset_id"), F.lit("perturb-catalogue").alias("upstream_source"), F.col("dataset_id").alias("accession"), title.alias("title"), joined("perturbation_types").alias("assay"), F.lit("perturbation").alias("modality"), zero("study_year").alias("year"), zero("n_perturbed").alias("n_samples"), joined("licenses").alias("license"))


def classified_cells(cells: DataFrame, newest: int = 3) -> DataFrame:
    """Rows of cells from (run, modified, cell, total_tag_umi, droplet_type): the newest runs, keyed run:cell."""
    runs = cells.groupBy("run").agg(F.max("modified").alias("m")).orderBy(F.col("m").desc(), "run").limit(newest)
    some = cells.join(F.broadcast(runs.select("run")), "run")
    return some.select(F.concat_ws(":", "run", F.col("cell").cast("string")).alias("cell_id"), F.concat(F.lit("multiseq:"), "run").alias("dataset_id"), F.coalesce(F.col("total_tag_umi"), F.lit(0)).cast("bigint").alias("n_counts"), F.col("droplet_type").alias("call"))


def routed_nodes(nodes: DataFrame) -> dict[str, DataFrame]:
    """Rows of genes, variants and proteins from graph nodes (id, node_type, label, source)."""
    of = lambda kind: nodes.where(F.col("node_type") == kind)
    return {
        "genes": of("gene").select(F.col("id").alias("gene_id"), F.col("label").alias("symbol"), F.col("source").alias("source_priority")),
        "variants": of("variant").select(F.col("id").alias("variant_id"), F.col("label").alias("rsid")),
        "proteins": of("protein").select(F.col("id").alias("uniprot_ac"), F.col("label").alias("symbol")),
    }


def graph_edges(edges: DataFrame) -> DataFrame:
    """Rows of edges from graph edges (from_node, to_node, edge_type, source)."""
    return edges.select(F.lit("node").alias("src_type"), F.col("from_node").alias("src_id"), F.lit("node").alias("dst_type"), F.col("to_node").alias("dst_id"), F.col("edge_type").alias("relation"), F.col("source").alias("upstream"))


def substitution_scores(scores: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Rows of vampseq_scores from (urn, hgvs_pro, score, se, abundance_class); other notations are left out.

    The gene is looked up by the tag of the urn, which stands for itself if names has it not; a change that is no amino
    acid (=) is ?; a score that is NaN, and 0 in the other numbers, are null.
    """
    pattern = r"^p\.\(?([A-Z][a-z]{2})(\d+)([A-Z][a-z]{2}|Ter|=)\)?$"
    part = lambda k: F.regexp_extract("hgvs_pro", pattern, k)
    tag = F.replace("urn", F.lit("urn:mavedb:"), F.lit(""))
    gene = tag
    for key, name in (names or {}).items():
        gene = F.when(tag == key, name).otherwise(gene)
    zero = lambda c, t: F.nullif(F.col(c).cast(t), F.lit(0).cast(t))
    out = scores.select(gene.alias("gene_id"), part(2).try_cast("int").alias("aa_position"), amino(part(1)).alias("aa_wt"), F.coalesce(amino(part(3)), F.lit("?")).alias("aa_alt"), F.nanvl(F.col("score").cast("double"), F.lit(None).cast("double")).alias("score"), zero("se", "double").alias("se"), zero("abundance_class", "int").alias("abundance_class"), F.col("urn").alias("dataset_id"), F.lit("mavedb").alias("upstream"))
    return out.where("aa_position IS NOT NULL AND aa_wt IS NOT NULL")
