"""Identifiers, names and sequences in text: parsing, folding and checks as columns."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.sequences import longest_run

#: Bases of restriction sites that a design must not hold.
RESTRICTION_SITES = {"EcoRI": "GAATTC", "BamHI": "GGATCC", "KpnI": "GGTACC", "XbaI": "TCTAGA"}
#: Letters of the IUPAC code.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "[AG]", "Y": "[CT]", "S": "[CG]", "W": "[AT]", "K": "[GT]", "M": "[AC]", "B": "[CGT]", "D": "[AGT]", "H": "[ACT]", "V": "[ACG]", "N": "[ACGT]"}
_COMPLEMENT = ("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN")
#: Field -> (least, most) of quantities that cannot lie outside.
RANGES = {"p_value": (0.0, 1.0), "pvalue": (0.0, 1.0), "p_adj": (0.0, 1.0), "padj": (0.0, 1.0), "fdr": (0.0, 1.0), "r2": (0.0, 1.0), "correlation": (-1.0, 1.0), "auroc": (0.0, 1.0), "auprc": (0.0, 1.0), "neg_log10_pvalue": (0.0, 400.0)}


def region_id(chrom: Column, start: Column, end: Column) -> Column:
    """chrom:start-end."""
    return F.concat(F.trim(chrom), F.lit(":"), F.trim(start.cast("string")), F.lit("-"), F.trim(end.cast("string")))


def entities(text: Column, accession: str = r"\b(?:ENC|IGVF)[A-Z]{2}\d{3,4}[A-Z]{3,4}\b") -> Column:
    """array<struct<kind, name>>: accessions, rs numbers (lower case) and regions (without commas) of a text, in this order."""
    found = lambda pattern: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    named = lambda names, kind: F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    regions = F.transform(found(r"\bchr[0-9XYM]{1,2}:[\d,]+-[\d,]+"), lambda n: F.replace(n, F.lit(","), F.lit("")))
    return F.concat(named(found(accession), "dataset"), named(F.transform(found(r"(?i)\brs\d{2,}\b"), F.lower), "variant"), named(regions, "region"))


def impossible_claims(text: Column, ranges: dict[str, tuple[float, float]] | None = None) -> Column:
    """array<struct<field, value>> of `field = value` claims whose value lies outside of the field's range.

    Fields are looked for without regard to case, in the order of ranges; a claim counts once.
    """
    out = []
    for field, (low, high) in (ranges or RANGES).items():
        pattern = rf"(?im)(?:^|[\s`*|(\[,;]){field}\b(?:\*\*|`)?\s*(?:=|:|is|of)\s*(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
        values = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)))
        bad = F.filter(values, partial(_beyond, low, high))
        out.append(F.transform(bad, partial(_claim, field)))
    return F.concat(*out)


def _beyond(low: float, high: float, value: Column) -> Column:
    return (value.cast("double") < low) | (value.cast("double") > high)


def _claim(field: str, value: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), value.alias("value"))


def outside_range(field: Column, value: Column, ranges: dict[str, tuple[float, float]] | None = None) -> Column:
    """Whether a value is impossible for its field; unknown fields, text and values that are not finite are not."""
    x = value.try_cast("double")
    out = F.lit(False)
    for name, (low, high) in (ranges or RANGES).items():
        out = F.when(F.lower(field) == name, (x < low) | (x > high)).otherwise(out)
    return F.coalesce(out & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def parse_variant(token: Column) -> Column:
    """struct<kind, chrom, pos, ref, alt, variant_id> of an rs number, SPDI, chr-pos-ref-alt or genomic HGVS; kind is
    null if it is none of them. pos is 1-based as written, the position in variant_id 0-based."""
    t = F.regexp_replace(F.trim(token), r"""^[,;"']+|[,;"']+$""", "")
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    delim = r"(?i)^(?:chr)?([0-9]{1,2}|X|Y|MT?)[-:_](\d+)[-:_]([ACGTN]+)[-:_>/]([ACGTN]+)$"
    hgvs = r"(?i)^(?:chr)?([0-9]{1,2}|X|Y|MT?):g\.(\d+)([ACGTN]+)>([ACGTN]+)$"
    spdi = r"(?i)^NC_\d+\.\d+:\d+:[ACGTN]*:[ACGTN]*$"
    none = F.lit(None).cast("string")

    def located(pattern: str, kind: str) -> Column:
        chrom, pos = F.upper(part(pattern, 1)), part(pattern, 2).cast("long")
        ref, alt = F.upper(part(pattern, 3)), F.upper(part(pattern, 4))
        return F.struct(F.lit(kind).alias("kind"), chrom.alias("chrom"), pos.alias("pos"), ref.alias("ref"), alt.alias("alt"), F.concat(F.lit("chr"), chrom, F.lit(":"), (pos - 1).cast("string"), F.lit(":"), ref, F.lit(":"), alt).alias("variant_id"))

    plain = lambda kind, value: F.struct(F.lit(kind).alias("kind"), none.alias("chrom"), F.lit(None).cast("long").alias("pos"), none.alias("ref"), none.alias("alt"), value.alias("variant_id"))
    fits = lambda pattern: t.rlike(pattern) & (part(pattern, 2).cast("long") > 0)
    return F.when(t.rlike(r"(?i)^rs\d+$"), plain("rsid", F.lower(t))).when(t.rlike(spdi), plain("spdi", t)).when(fits(delim), located(delim, "chr-pos-ref-alt")).when(fits(hgvs), located(hgvs, "hgvs-g")).otherwise(plain(None, none))


def spdi_position(spdi: Column) -> Column:
    """struct<chrom, pos> of an NC_ SPDI: chr1 to chr22, chrX, chrY, and the 1-based position; null fields if it is none."""
    pattern = r"(?i)^NC_0*(\d+)\.\d+:(\d+):"
    number, pos = F.regexp_extract(spdi, pattern, 1), F.regexp_extract(spdi, pattern, 2).try_cast("long") + 1
    chrom = F.when(number == "", None).when(number == "23", "chrX").when(number == "24", "chrY").otherwise(F.concat(F.lit("chr"), number))
    return F.struct(chrom.alias("chrom"), pos.alias("pos"))


def spdi_token(spdi: Column) -> Column:
    """chr-pos-ref-alt (1-based) of an SPDI with both alleles; empty if it is none."""
    at = spdi_position(spdi)
    pattern = r"(?i)^NC_0*\d+\.\d+:\d+:([ACGTN]+):([ACGTN]+)$"
    ref, alt = F.upper(F.regexp_extract(spdi, pattern, 1)), F.upper(F.regexp_extract(spdi, pattern, 2))
    ok = spdi.rlike(pattern) & (F.regexp_extract(spdi, r"(?i)^NC_0*(\d+)", 1).try_cast("int").between(1, 24))
    return F.coalesce(F.when(ok, F.concat_ws("-", F.replace(at["chrom"], F.lit("chr"), F.lit("")), at["pos"].cast("string"), ref, alt)), F.lit(""))


def vcf_tokens(text: Column) -> Column:
    """chrom-pos-ref-alt of the records of a VCF text, whose fields are parted by white space."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1), lambda x: ~x.startswith("#") & (F.trim(x) != ""))
    fields = F.transform(lines, lambda x: F.split(F.trim(x), r"\s+", -1))
    good = F.filter(fields, lambda f: (F.size(f) >= 5) & F.get(f, F.lit(1)).rlike(r"^\d+$") & F.get(f, F.lit(3)).rlike(r"(?i)^[ACGTN]+$"))
    return F.transform(good, lambda f: F.concat_ws("-", F.get(f, F.lit(0)), F.get(f, F.lit(1)), F.get(f, F.lit(3)), F.get(f, F.lit(4))))


def canonical_name(name: Column, suffix: str = r"(?i)\s*-\s*homo sapiens.*$|\s*\(human\)\s*$") -> Column:
    """A pathway's name without an organism suffix, in lower case, letters and digits parted by one blank."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), suffix, ""), "[^A-Za-z0-9]+", " ")))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two short strings: one row of the table a letter, with array functions."""
    letters = F.split(a, "")
    start = F.array_repeat(F.lit(0), F.length(b) + 1)

    def step(row: Column, x: Column) -> Column:
        # row[j] is the length for the letters so far and the first j of b
        best = F.transform(F.split(b, ""), lambda y, j: F.when(x == y, F.get(row, j) + 1).otherwise(F.get(row, j + 1)))
        grown = F.transform(best, lambda v, j: F.array_max(F.slice(best, F.lit(1), j + 1)))
        return F.concat(F.array(F.lit(0)), grown)

    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.element_at(F.aggregate(letters, start, step), -1))


def unique_join(values: Column, limit: int = 8) -> Column:
    """The first different non-empty values of an array, in order, joined by ;."""
    return F.array_join(F.slice(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))), 1, limit), ";")


def flatten_structs(df: DataFrame) -> DataFrame:
    """One level of struct columns as columns parent_child; the others stay."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "struct":
            out += [F.col(f"`{f.name}`.`{c}`").alias(f"{f.name}_{c}") for c in f.dataType.names]
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def lift_nodes(df: DataFrame, collections: dict[str, str]) -> DataFrame:
    """Struct columns with _id or name become a reference collection/_id (or the bare id) and columns _id and _name."""
    out = []
    for f in df.schema.fields:
        names = f.dataType.names if f.dataType.typeName() == "struct" else []
        if not {"_id", "name"} & set(names):
            out.append(F.col(f"`{f.name}`"))
            continue
        if "_id" in names:
            key = F.col(f"`{f.name}`._id")
            out += [(F.concat(F.lit(f"{collections[f.name]}/"), key) if f.name in collections else key).alias(f.name), key.alias(f"{f.name}_id")]
        if "name" in names:
            out.append(F.col(f"`{f.name}`.name").alias(f"{f.name}_name"))
    return df.select(*out)


def closeness(wanted: list[str], term: Column) -> Column:
    """Twice the words that a term shares with wanted, and one for each further word with a five-letter stem of them."""
    have = F.array_distinct(F.filter(F.split(F.lower(term), "[^a-z0-9]+"), lambda w: w != ""))
    want = F.array(*(F.lit(w) for w in sorted(set(wanted))))
    stems = F.array(*(F.lit(w) for w in sorted({w[:5] for w in wanted})))
    rest = F.filter(F.array_except(have, want), lambda w: F.array_contains(stems, F.substring(w, 1, 5)))
    return 2 * F.size(F.array_intersect(have, want)) + F.size(rest)


def query_terms(text: str) -> list[tuple[str, bool]]:
    """Words of a free query as (term, is a prefix); a star at the end asks for a prefix."""
    import re

    found = [(t.rstrip("*"), t.endswith("*")) for t in re.findall(r"[A-Za-z0-9_:\-.]+\*?", text or "")]
    return [(t, star) for t, star in found if t]


def shifted_barcode(window: Column, offset: int = 1, width: int = 8) -> Column:
    """array of the three places that a barcode can have in a read's window: as designed, one base early, one late.

    A late one that the window is too short for is filled up with N.
    """
    late = F.substring(window, offset + 2, width)
    return F.array(F.substring(window, offset + 1, width), F.substring(window, offset, width), F.when(F.length(window) < offset + 1 + width, F.concat(F.substring(window, offset + 2, width), F.lit("N"))).otherwise(late))


def match_barcode(reads: DataFrame, whitelist: DataFrame, window: str) -> DataFrame:
    """reads with barcode, the whitelist (form, barcode) entry of the first of the three places that has one."""
    keyed = reads.withColumn("_read", F.struct(*(F.col(f"`{c}`") for c in reads.columns)))
    forms = keyed.select("_read", F.posexplode(shifted_barcode(F.col(window))).alias("_k", "form"))
    hit = forms.join(whitelist, "form").groupBy("_read").agg(F.min_by("barcode", "_k").alias("barcode"))
    return keyed.select("_read").join(hit, "_read", "left").select("_read.*", "barcode")


def round_barcode(read: Column, offsets: tuple[int, int, int], width: int = 8) -> Column:
    """Barcode of three rounds at fixed places of a read (from 0); null if the read is too short."""
    parts = [F.substring(read, o + 1, width) for o in offsets]
    return F.when(F.length(read) >= offsets[-1] + width, F.concat(*parts))


def well_counts(cells: DataFrame, whitelist: DataFrame, barcode: str) -> DataFrame:
    """(well, n): cells by the first eight bases of their barcode, dashes aside, looked up in whitelist (prefix, well)."""
    prefix = F.upper(F.substring(F.regexp_replace(barcode, "[-_]", ""), 1, 8))
    return cells.select(prefix.alias("prefix")).join(F.broadcast(whitelist), "prefix").groupBy("well").agg(F.count(F.lit(1)).alias("n"))


def design_failure(seq: Column, max_run: int | None, sites: dict[str, str] | None = None) -> Column:
    """Why a designed sequence fails: homopolymer, or the first restriction site in it; null if it does not."""
    out = F.lit(None).cast("string")
    for name, site in reversed(list((sites or RESTRICTION_SITES).items())):
        both = site if site == _turned(site) else f"{site}|{_turned(site)}"
        out = F.when(F.upper(seq).rlike(both), F.lit(f"restriction_site:{name}")).otherwise(out)
    return F.when(longest_run(seq) > max_run, F.lit("homopolymer")).otherwise(out) if max_run is not None else out


def _turned(site: str) -> str:
    return site.translate(str.maketrans(*_COMPLEMENT))[::-1]


def pam_sites(seq: Column, pam: str = "NGG", offset: int = 0) -> tuple[Column, Column]:
    """Places (from 0, plus offset) at which a PAM begins, and at which one of the other strand ends; they may overlap."""

    def starts(motif: str) -> Column:
        pattern = "^(?:" + "".join(IUPAC[c] for c in motif) + ")"
        spots = F.when(F.length(seq) >= len(motif), F.sequence(F.lit(1), F.length(seq) - len(motif) + 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.filter(spots, lambda i: F.substring(F.upper(seq), i, F.lit(len(motif))).rlike(pattern))

    forward = F.transform(starts(pam), lambda i: i - 1 + offset)
    return forward, F.transform(starts(_turned(pam)), lambda i: i - 1 + offset + len(pam))


def guide_chemistry(guide: Column, length: int = 20) -> dict[str, Column]:
    """Runs of four equal bases, and GC in percent of the guide's length by design."""
    s = F.upper(guide)
    runs = {f"poly_{b.lower()}": s.contains(b * 4) for b in "TGCA"}
    return runs | {"gc_content": F.length(F.regexp_replace(s, "[^GC]", "")) * 100 / length}


def pwm_score(pwm: list[dict[str, float]], seq: Column) -> Column:
    """Largest sum of a position weight matrix over all windows of known bases; -1e9 without one."""
    width = len(pwm)
    weights = F.array(*(F.create_map(*(x for b in "ACGT" for x in (F.lit(b), F.lit(float(w[b]))))) for w in pwm))
    spots = F.when(F.length(seq) >= width, F.sequence(F.lit(1), F.length(seq) - width + 1)).otherwise(F.expr("cast(array() as array<int>)"))
    bases = F.sequence(F.lit(0), F.lit(width - 1))
    at = lambda i: F.aggregate(bases, F.lit(0.0), lambda s, j: s + F.try_element_at(F.get(weights, j), F.substring(seq, i + j, F.lit(1))))
    return F.coalesce(F.array_max(F.array_compact(F.transform(spots, at))), F.lit(-1e9))


def conversions(ref: Column, read: Column, quality: Column, reverse: Column, least: int) -> Column:
    """struct<labelled, other>: T>C changes (A>G on the reverse strand) and others, of aligned bases with enough quality."""
    bases = F.transform(F.arrays_zip(F.split(F.upper(ref), "").alias("r"), F.split(F.upper(read), "").alias("q"), quality.alias("s")), lambda x: F.struct(x["r"].alias("r"), x["q"].alias("q"), (x["s"] >= least).alias("ok")))
    changed = F.filter(bases, lambda x: (x["r"] != x["q"]) & x["ok"])
    want = lambda x: F.when(reverse, (x["r"] == "A") & (x["q"] == "G")).otherwise((x["r"] == "T") & (x["q"] == "C"))
    labelled = F.size(F.filter(changed, want))
    return F.struct(labelled.alias("labelled"), (F.size(changed) - labelled).alias("other"))


def design_matrix(columns: list[str], epsilon: float = 0.01, squares: bool = False) -> dict[str, Column]:
    """log(|x| + epsilon) of feature columns, with all products of two of them if squares."""
    out = {c: F.col(c) for c in columns}
    if squares:
        out |= {f"{a} {b}" if a != b else f"{a}^2": F.col(a) * F.col(b) for k, a in enumerate(columns) for b in columns[k:]}
    return {name: F.log(F.abs(x) + epsilon) for name, x in out.items()}


def key_range(key: Column, low: str | None, high: str | None) -> Column:
    """Keys in [low, high) by bytes, whatever the session's collation."""
    k = key.cast("binary")
    out = F.lit(True)
    if low is not None:
        out = out & (k >= F.lit(low).cast("binary"))
    return out & (k < F.lit(high).cast("binary")) if high is not None else out
