"""Readers for the tabular formats of genome analysis; every one returns a typed DataFrame and reads by Spark only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The columns of a narrowPeak file.
NARROW_PEAK = ["chr", "start", "end", "name", "score", "strand", "signal", "p", "q", "summit"]
_TYPES = {"start": "long", "end": "long", "score": "double", "signal": "double", "p": "double", "q": "double", "summit": "long", "start2": "long", "end2": "long"}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not empty, no comment and no track or browser line."""
    return spark.read.text(path).where(~F.col("value").rlike(r"^(#|track\b|browser\b)") & (F.trim("value") != ""))


def split_columns(df: DataFrame, names: list[str], sep: str = "\t") -> DataFrame:
    parts = F.split("value", sep, -1)
    typed = lambda c, k: F.get(parts, F.lit(k)).try_cast(_TYPES[c]) if c in _TYPES else F.get(parts, F.lit(k))
    return df.select(*(typed(c, k).alias(c) for k, c in enumerate(names)))


def read_bed(spark: SparkSession, path: str, extra: list[str] | None = None) -> DataFrame:
    """BED with chr, start, end and further columns by position."""
    return split_columns(lines(spark, path), ["chr", "start", "end", *(extra or [])])


def read_narrow_peak(spark: SparkSession, path: str) -> DataFrame:
    return split_columns(lines(spark, path), NARROW_PEAK)


def read_bedpe(spark: SparkSession, path: str) -> DataFrame:
    return split_columns(lines(spark, path), ["chr", "start", "end", "chr2", "start2", "end2", "name", "score"])


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    return split_columns(lines(spark, path), ["chr", "end"]).withColumnRenamed("end", "size")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """TSV with a header that may begin with #; comment lines above it are skipped. All files have the same header.

    The header is the last line with # at the head of a file, or the first line without one. Data lines that equal the
    header stay; later lines with # are data.
    """
    files = spark.read.text(path, wholetext=False).select("value", F.col("_metadata.file_path").alias("file")).limit(1).collect()
    if not files:
        return spark.createDataFrame([], "value string")
    top = [r.value for r in spark.read.text(files[0]["file"]).limit(1000).collect()]
    skip = 0
    while skip < len(top) and top[skip].startswith("#"):
        skip += 1
    has_hash = skip > 0 and (skip >= len(top) or len(top[skip - 1].split("\t")) == len(top[skip].split("\t")))
    names = (top[skip - 1].lstrip("#") if has_hash else top[skip]).split("\t")
    schema = StructType([StructField(n.strip(), StringType()) for n in names])
    # every line with # at the head is a comment for the reader; a header without # is skipped by its place in the file
    options = {"sep": "\t", "header": not has_hash, "quote": "", "enforceSchema": True, "mode": "PERMISSIVE"}
    return spark.read.options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).option("comment", "#").schema(schema).csv(path)


def read_gct(spark: SparkSession, path: str) -> DataFrame:
    """Wide GCT of median TPM as (gene, description, tissue, tpm)."""
    body = spark.read.text(path).where(~F.col("value").rlike(r"^(#1|\d+\t\d+(\t|$))"))
    names = body.first().value.split("\t")
    wide = split_columns(body.where(~F.col("value").startswith("Name\t")), names)
    return wide.unpivot(names[:2], names[2:], "tissue", "tpm").select(F.col(f"`{names[0]}`").alias("gene"), F.col(f"`{names[1]}`").alias("description"), "tissue", F.col("tpm").try_cast("double").alias("tpm"))


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """MatrixMarket triplets as (row, col, value), numbered from 1; the size line, the first of each file, is dropped.

    The reader takes it for a header, so an entry that equals it stays. A file without values has value 1.
    """
    raw = spark.read.option("comment", "%").option("header", "true").option("sep", "\u0001").option("quote", "").schema("value string").csv(path)
    parts = F.split(F.trim("value"), r"\s+")
    return raw.where(F.trim("value") != "").select(F.get(parts, F.lit(0)).cast("long").alias("row"), F.get(parts, F.lit(1)).cast("long").alias("col"), F.coalesce(F.get(parts, F.lit(2)).cast("double"), F.lit(1.0)).alias("value"))


def fragments_to_tags(fragments: DataFrame) -> DataFrame:
    """Two tags of a fragment, about its midpoint (rounded down): + up to it, - from the base after it."""
    mid = F.floor((F.col("start") + F.col("end")) / 2)
    tag = lambda s, e, strand: F.struct(s.alias("start"), e.alias("end"), F.lit(strand).alias("strand"))
    both = F.array(tag(F.col("start"), mid, "+"), tag(mid + 1, F.col("end"), "-"))
    return fragments.select("chr", F.explode(both).alias("t")).select("chr", "t.*")


def load_tags(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(chr, start, end, strand) of a tagAlign file or of a fragment file."""
    if kind == "tagalign":
        return split_columns(lines(spark, path), ["chr", "start", "end", "name", "score", "strand"]).select("chr", "start", "end", "strand")
    if kind == "fragments":
        return fragments_to_tags(read_bed(spark, path, ["barcode"]))
    raise ValueError("kind must be tagalign or fragments")


def read_tss(spark: SparkSession, path: str) -> DataFrame:
    """(chr, pos, name, strand) of a BED of starts: the middle of each interval, rounded down."""
    bed = read_bed(spark, path, ["name", "score", "strand"])
    return bed.select("chr", F.floor((F.col("start") + F.col("end")) / 2).alias("pos"), "name", "strand")


def read_dense_matrix(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(gene, cell, value) of the values other than 0 of a table with genes as rows and cells as columns."""
    wide = spark.read.option("sep", sep).option("header", "true").csv(path)
    gene, *cells = wide.columns
    long = wide.unpivot([gene], cells, "cell", "value").select(F.col(f"`{gene}`").alias("gene"), "cell", F.col("value").try_cast("double").alias("value"))
    return long.where("value IS NOT NULL AND value <> 0")


def read_cell_matrix(spark: SparkSession, matrix: str, barcodes: str, features: str, features_are_rows: bool = True) -> DataFrame:
    """(gene, cell, value) of a MatrixMarket file and the names of its rows and columns, one a line, in order."""
    from lodestar.operators.ordered import row_numbers

    def names(path: str, name: str) -> DataFrame:
        listed = spark.read.text(path).select(F.get(F.split("value", "\t"), F.lit(0)).alias(name), F.monotonically_increasing_id().alias("_at"))
        return row_numbers(listed, [F.col("_at")], "_i").select(name, "_i")

    entries = read_matrix_market(spark, matrix)
    gene, cell = ("row", "col") if features_are_rows else ("col", "row")
    out = entries.join(names(features, "gene"), F.col(gene) == F.col("_i")).drop("_i")
    return out.join(names(barcodes, "cell"), F.col(cell) == F.col("_i")).select("gene", "cell", "value")


def read_screen(spark: SparkSession, counts: str, guides: str, samples: str, sep: str = ",") -> tuple[DataFrame, DataFrame, DataFrame]:
    """((guide, sample, count), guides, samples) of three tables; the first column of the last two names guide and sample."""
    table = lambda path: spark.read.option("sep", sep).option("header", "true").csv(path)
    wide, g, s = table(counts), table(guides), table(samples)
    key, *columns = wide.columns
    long = wide.unpivot([key], columns, "sample", "count").select(F.col(f"`{key}`").alias("guide"), "sample", F.col("count").try_cast("double").alias("count"))
    return long, g.withColumnRenamed(g.columns[0], "guide"), s.withColumnRenamed(s.columns[0], "sample")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(chrom1, pos1, chrom2, pos2) of a pairs file, by the columns that its header names; # lines are comments."""
    head = [r.value for r in spark.read.text(path).limit(1000).collect()]
    named = next((x.split(":", 1)[1].split() for x in head if x.startswith("#columns:")), None)
    first = next((x for x in head if x.strip() and not x.startswith("#")), "").split("\t")
    bare = {"chrom1", "pos1", "chrom2", "pos2"} <= set(first)
    names = named or (first if bare else ["readID", "chrom1", "pos1", "chrom2", "pos2"])
    rows = lines(spark, path)
    if bare:
        rows = rows.where(F.col("value") != "\t".join(first))  # a row of column names is no contact wherever it stands
    parts = F.split("value", "\t", -1)
    at = {n: F.get(parts, F.lit(k)) for k, n in enumerate(names)}
    out = rows.select(at["chrom1"].alias("chrom1"), at["pos1"].try_cast("long").alias("pos1"), at["chrom2"].alias("chrom2"), at["pos2"].try_cast("long").alias("pos2"))
    return out.where("pos1 IS NOT NULL AND pos2 IS NOT NULL")


def read_biogrid(spark: SparkSession, path: str) -> DataFrame:
    """Human interactions of a tab3 file: symbols, first accessions, method, evidence and publication."""
    t = spark.read.option("sep", "\t").option("header", "true").option("quote", "").csv(path)
    t = t.withColumnsRenamed({c: c.lstrip("#").strip() for c in t.columns})
    c = lambda name: F.col(f"`{name}`") if name in t.columns else F.lit("")
    human = (c("Organism Name Interactor A") == "Homo sapiens") & (c("Organism Name Interactor B") == "Homo sapiens") if "Organism Name Interactor A" in t.columns else (c("Organism ID Interactor A") == "9606") & (c("Organism ID Interactor B") == "9606")
    first = lambda name: F.substring_index(c(name), "|", 1)
    return t.where(human).select(c("Official Symbol Interactor A").alias("id_a"), c("Official Symbol Interactor B").alias("id_b"), F.lit("symbol").alias("id_type"), first("SWISS-PROT Accessions Interactor A").alias("uniprot_a"), first("SWISS-PROT Accessions Interactor B").alias("uniprot_b"), c("BioGRID Interaction ID").alias("source_id"), c("Experimental System").alias("detection_method"), c("Experimental System Type").alias("evidence_type"), c("Publication Source").alias("pubmed_id"), c("Score").alias("score"))


def read_mitab(spark: SparkSession, path: str) -> DataFrame:
    """Human interactions of a PSI-MITAB file between proteins with accessions, with publication and confidence."""
    parts = F.split("value", "\t", -1)
    col = lambda k: F.get(parts, F.lit(k))
    acc = lambda k: F.regexp_extract(col(k), r"uniprotkb:([A-Z0-9]+(?:-\d+)?)", 1)
    rows = spark.read.text(path).where((F.size(parts) >= 14) & col(9).contains("9606") & col(10).contains("9606"))
    out = rows.select(acc(0).alias("id_a"), acc(1).alias("id_b"), F.lit("uniprot").alias("id_type"), col(13).alias("source_id"), col(6).alias("detection_method"), F.lit("experimental").alias("evidence_type"), F.regexp_extract(col(8), r"pubmed:(\d+)", 1).alias("pubmed_id"), F.substring_index(col(14), ":", -1).try_cast("double").alias("score"))
    return out.where("id_a <> '' AND id_b <> ''")


def read_idmapping(spark: SparkSession, path: str) -> DataFrame:
    """(uniprot_ac, entrez, ensembl) of a wide id mapping: the first of several ids, by place in the line."""
    parts = F.split("value", "\t", -1)
    first = lambda k: F.trim(F.substring_index(F.get(parts, F.lit(k)), ";", 1))
    return spark.read.text(path).where(F.size(parts) >= 19).select(F.trim(F.get(parts, F.lit(0))).alias("uniprot_ac"), first(2).alias("entrez"), first(18).alias("ensembl"))


#: Names under which tables give the columns of a region.
ALIASES = {"chr": ["chr", "chrom", "chromosome", "seqnames", "seqname"], "start": ["start", "chromstart", "begin", "start_position", "pos", "position"], "end": ["end", "chromend", "stop", "end_position"]}


def read_regions(spark: SparkSession, path: str, sep: str = "\t", names: dict[str, str] | None = None) -> DataFrame:
    """A table with a header as chr, start, end and its other columns; the region's columns go by any of their usual names.

    names overrides a column's name; a table without an end has intervals of one base.
    """
    t = spark.read.option("sep", sep).option("header", "true").csv(path)
    low = {c.lower().lstrip("#").strip(): c for c in t.columns}
    found = {k: (names or {}).get(k) or next((low[a] for a in known if a in low), None) for k, known in ALIASES.items()}
    if not found["chr"] or not found["start"]:
        raise ValueError(f"no region columns among {t.columns}")
    start = F.col(f"`{found['start']}`").try_cast("long")
    end = F.col(f"`{found['end']}`").try_cast("long") if found["end"] else start + 1
    rest = [c for c in t.columns if c not in found.values()]
    return t.select(F.col(f"`{found['chr']}`").alias("chr"), start.alias("start"), end.alias("end"), *(F.col(f"`{c}`") for c in rest))


#: Header sets by which a delimited artefact is recognised, in this order: kind -> (needed columns, source, target, relation).
ARTEFACTS = {
    "network_edges": ({"source", "target"}, "source", "target", "network"),
    "ppi": ({"id_a", "id_b"}, "id_a", "id_b", "interacts_with"),
    "element_gene": ({"element_id", "gene"}, "element_id", "gene", "regulates"),
    "gene_disease": ({"gene", "disease"}, "gene", "disease", "associated_with"),
    "gene_pathway": ({"gene", "pathway"}, "gene", "pathway", "member_of_pathway"),
    "variant_gene": ({"variant", "gene"}, "variant", "gene", "linked_to"),
}


def recognise(columns: list[str]) -> str | None:
    """The first kind of artefact whose columns are all there; names without regard to case."""
    have = {c.strip().lower() for c in columns}
    return next((kind for kind, (need, *_) in ARTEFACTS.items() if need <= have), None)


def artefact_edges(df: DataFrame, source: str) -> DataFrame | None:
    """(from_name, to_name, edge_type, source) of a recognised artefact's rows with both ends; None for any other."""
    kind = recognise(df.columns)
    if kind is None:
        return None
    _, a, b, relation = ARTEFACTS[kind]
    low = {c.strip().lower(): c for c in df.columns}
    name = lambda c: F.upper(F.trim(F.col(f"`{low[c]}`").cast("string")))
    own = F.coalesce(F.col(f"`{low['source']}`"), F.lit(source)) if "source" in low and a != "source" else F.lit(source)
    out = df.select(name(a).alias("from_name"), name(b).alias("to_name"), F.lit(relation).alias("edge_type"), own.alias("source"))
    return out.where("from_name <> '' AND to_name <> ''")


def file_kind(path: Column) -> Column:
    """Kind by extension, compression aside."""
    return F.regexp_extract(F.lower(path), r"\.([a-z0-9]+?)(\.gz|\.bgz|\.zst)?$", 1)
