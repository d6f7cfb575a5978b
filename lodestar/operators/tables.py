"""Count tables of reporter assays, screens, traits and cells: outliers, replicate merging, scores and summaries.

Totals are broadcast only where they are one row, or a row a replicate, condition or bin of the assay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import numeric, stats


def enrichment_statistics(df: DataFrame, x1: str, n1: str, x2: str, n2: str, within: list[str] | None = None, z: float = 1.959963984540054, compat: bool = False) -> DataFrame:
    """df with enrichment, se, its interval on the log scale, the hypergeometric p of more than x1, and p times the rows of its group.

    The group is the table, or the rows with equal within columns. Without rows on a side p is null; see stats.enrichment.
    """
    a, b, c, d = (F.col(v).cast("double") for v in (x1, n1, x2, n2))
    p = numeric.hypergeometric_tail(*(F.coalesce(v, F.lit(0.0)) for v in (a, b + d, b, a + c)))
    out = df.withColumns(stats.enrichment(a, b, c, d, z, compat)).withColumn("p", F.when((b > 0) & (d > 0) & a.isNotNull() & c.isNotNull(), p))
    if within:
        size = df.groupBy(*within).agg(F.count(F.lit(1)).alias("_n")).select(*(F.col(f"`{w}`").alias(f"_w{k}") for k, w in enumerate(within)), "_n")
        on = F.lit(True)
        for k, w in enumerate(within):
            on = on & F.col(f"`{w}`").eqNullSafe(F.col(f"_w{k}"))
        out = out.join(size, on).drop(*(f"_w{k}" for k in range(len(within))))
    else:
        out = out.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))))  # one row
    return out.withColumn("p_adjusted", stats.bonferroni(F.col("p"), F.col("_n"))).drop("_n")


def summed_enrichment(df: DataFrame, keys: list[str], x1: str, n1: str, x2: str, n2: str) -> DataFrame:
    """enrichment_statistics of sums over keys (a null is a key), adjusted within all keys but the last, and recall x1 / n1."""
    total = df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in (x1, n1, x2, n2)))
    return enrichment_statistics(total, x1, n1, x2, n2, keys[:-1] or None).withColumn("recall", F.try_divide(F.col(x1).cast("double"), F.col(n1).cast("double")))


def linking_statistics(df: DataFrame, keys: list[str], hits: str, total: str) -> DataFrame:
    """(keys, hits, total, share, se, ci_low, ci_high) of sums over keys: raw shares with an adjusted standard error."""
    s = df.groupBy(*keys).agg(F.sum(hits).alias(hits), F.sum(total).alias(total))
    return s.withColumns(stats.proportion(F.col(hits), F.col(total)))


def reaching(best: DataFrame, key: str, location: str, score: str, thresholds: list[float]) -> DataFrame:
    """(key, threshold, locations): different locations of a key whose largest score reaches each threshold."""
    top = best.groupBy(key, location).agg(F.max(score).alias("_s"))
    each = top.select(key, F.explode(F.filter(F.array(*(F.lit(float(t)) for t in thresholds)), lambda t: F.col("_s") >= t)).alias("threshold"))
    return each.groupBy(key, "threshold").agg(F.count(F.lit(1)).alias("locations"))


def threshold_span(df: DataFrame, score: str, steps: int, provided: list[float] | None = None) -> list[float]:
    """Thresholds of a score: quantiles and even steps between its ends, each value once; or the ones provided."""
    if provided:
        return sorted(set(provided))
    shares = [k / steps for k in range(steps + 1)]
    q, low, high = df.agg(F.percentile(score, F.array(*(F.lit(s) for s in shares))), F.min(score), F.max(score)).first()
    return sorted({*q, *(low + (high - low) * s for s in shares)}) if q else []


def pseudobulk(cells: DataFrame, keys: list[str], gene: str, cell: str, value: str) -> DataFrame:
    """(keys, gene, total, n_cells): summed counts of the cells of each combination, with its number of cells."""
    n = cells.groupBy(*keys).agg(F.count_distinct(cell).alias("n_cells"))
    return cells.groupBy(*keys, gene).agg(F.sum(value).alias("total")).join(n, keys)


def mean_by_group(values: DataFrame, cells: DataFrame, group: str, gene: str, value: str) -> DataFrame:
    """(group, gene, mean) over all cells of a group (cell, group), those without a row as zeros."""
    n = cells.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    return values.groupBy(group, gene).agg(F.sum(value).alias("_s")).join(n, group).select(group, gene, (F.col("_s") / F.col("_n")).alias("mean"))


def unique_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once; all copies of a repeated key go."""
    once = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return df.join(once, keys, "left_semi")


def merged_counts(counts: DataFrame, assignment: DataFrame, min_dna: int = 1, min_rna: int = 1, scaling: float = 1e6, with_unassigned: bool = False) -> DataFrame:
    """(oligo, n_bc, dna, rna, dna_normalized, rna_normalized, ratio, log2_ratio) of counts (barcode, dna, rna) by assignment (barcode, oligo).

    A barcode that the assignment holds twice is dropped; counts below a minimum are. A side whose minimum is 0 gets a
    pseudocount of 1 a barcode. Normalised is the mean a barcode per scaling reads, of assigned barcodes or, with_unassigned,
    of all that pass the minima.
    """
    own = unique_rows(assignment.select("barcode", "oligo"), ["barcode"])
    some = counts.where((F.col("dna") >= min_dna) & (F.col("rna") >= min_rna))
    some = some.withColumns({"dna": F.col("dna") + int(min_dna == 0), "rna": F.col("rna") + int(min_rna == 0)})
    kept = some.join(own, "barcode")
    tot = (some if with_unassigned else kept).agg(F.sum("dna").alias("_d"), F.sum("rna").alias("_r"))
    per = kept.groupBy("oligo").agg(F.count(F.lit(1)).alias("n_bc"), F.sum("dna").alias("dna"), F.sum("rna").alias("rna")).crossJoin(F.broadcast(tot))
    per = per.withColumns({"dna_normalized": F.try_divide(F.col("dna") / F.col("n_bc"), F.col("_d")) * scaling, "rna_normalized": F.try_divide(F.col("rna") / F.col("n_bc"), F.col("_r")) * scaling})
    return per.withColumn("ratio", F.try_divide("rna_normalized", "dna_normalized")).withColumn("log2_ratio", F.log2("ratio")).drop("_d", "_r")


def combined_replicates(master: DataFrame) -> DataFrame:
    """(oligo, replicates, pooled, averaged) of (oligo, replicate, dna, rna, log2_ratio): log2 of pooled shares, and the mean of the replicates'."""
    tot = master.agg(F.sum("dna").alias("_d"), F.sum("rna").alias("_r"))
    x = master.groupBy("oligo").agg(F.count(F.lit(1)).alias("replicates"), F.sum("dna").alias("_a"), F.sum("rna").alias("_b"), F.avg(F.nanvl("log2_ratio", F.lit(None).cast("double"))).alias("averaged"))
    x = x.crossJoin(F.broadcast(tot))  # one row
    return x.select("oligo", "replicates", F.log2(F.try_divide(F.try_divide("_b", "_r"), F.try_divide("_a", "_d"))).alias("pooled"), "averaged")


def master_table(replicates: DataFrame, least: int) -> DataFrame:
    """(replicate, oligos, kept, mean_bc, mean_bc_kept) of (oligo, replicate, n_bc): oligos with least barcodes or more are kept."""
    ok = F.col("n_bc") >= least
    return replicates.groupBy("replicate").agg(F.count(F.lit(1)).alias("oligos"), F.count_if(ok).alias("kept"), F.avg("n_bc").alias("mean_bc"), F.avg(F.when(ok, F.col("n_bc"))).alias("mean_bc_kept"))


def agreed_assignment(pairs: DataFrame, least: int, share: float) -> DataFrame:
    """(barcode, oligo, support) of reads (barcode, oligo): barcodes with enough reads that agree on one oligo.

    The oligo has least reads and the share of all of the barcode's, more than a half; support is its reads/all reads.
    """
    if share <= 0.5:
        raise ValueError("the share must be more than a half")
    n = pairs.groupBy("barcode", "oligo").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("barcode").agg(F.sum("n").alias("t"), F.max(F.struct("n", "oligo")).alias("b"))
    ok = (F.col("t") >= least) & (F.col("b.n") >= least) & (F.col("b.n") / F.col("t") >= share)
    return best.where(ok).select("barcode", "b.oligo", F.concat_ws("/", F.col("b.n").cast("string"), F.col("t").cast("string")).alias("support"))


def barcode_distribution(assignment: DataFrame) -> DataFrame:
    """(n_bc, oligos): how many oligos have each number of barcodes."""
    return assignment.groupBy("oligo").agg(F.count_distinct("barcode").alias("n_bc")).groupBy("n_bc").agg(F.count(F.lit(1)).alias("oligos"))


def shared_barcodes(counts: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, shared, lincoln) of every two replicates of (barcode, replicate, dna, rna); both counts above 0 make a barcode seen."""
    seen = counts.where("dna > 0 AND rna > 0").select("barcode", "replicate").distinct()
    n = seen.groupBy("replicate").agg(F.count(F.lit(1)).alias("n"))
    s = seen.toDF("barcode", "a").join(seen.toDF("barcode", "b"), "barcode").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    out = s.join(F.broadcast(n.toDF("a", "n_a")), "a").join(F.broadcast(n.toDF("b", "n_b")), "b")
    return out.select("a", "b", "n_a", "n_b", "shared", (F.col("n_a") * F.col("n_b") / F.col("shared")).alias("lincoln"))


def barcode_matrix(counts: DataFrame, replicates: list[str]) -> DataFrame:
    """(barcode, dna_x, rna_x for each replicate x) with 0 where a replicate has not the barcode."""
    wide = counts.groupBy("barcode").pivot("replicate", replicates).agg(F.sum("dna").alias("dna"), F.sum("rna").alias("rna"))
    return wide.select("barcode", *(F.coalesce(f"{r}_{m}", F.lit(0)).alias(f"{m}_{r}") for m in ("dna", "rna") for r in replicates))


def within_oligo_outliers(counts: DataFrame, times: float = 3.0, place: str | None = None) -> DataFrame:
    """counts (barcode, oligo, replicate, dna, rna) with z of the RNA count within its oligo and replicate, and outlier.

    Barcodes without any read are not looked at; a spread of 0, or of one barcode, counts as 1. With place, a column with
    the rows' order, spreads are summed in it, so that rows just at the bound do not depend on partitions.
    """
    x = counts.where(F.col("dna") + F.col("rna") > 0)
    m = x.groupBy(F.col("replicate").alias("_w0"), F.col("oligo").alias("_w1")).agg(F.avg("rna").alias("_m"), (stats.deviation_in_order("rna", place) if place else F.stddev_samp("rna")).alias("_s"))
    x = x.join(m, F.col("replicate").eqNullSafe(F.col("_w0")) & F.col("oligo").eqNullSafe(F.col("_w1")))
    sd = F.coalesce(F.nullif("_s", F.lit(0.0)), F.lit(1.0))
    return x.withColumn("z", (F.col("rna") - F.col("_m")) / sd).withColumn("outlier", F.abs("z") > times).drop("_w0", "_w1", "_m", "_s")


def global_outliers(counts: DataFrame, times: float = 3.0) -> DataFrame:
    """(replicate, n, outliers): barcodes whose RNA count is so many spreads from the replicate's mean; none without a spread."""
    x = counts.where(F.col("dna") + F.col("rna") > 0)
    m = x.groupBy("replicate").agg(F.avg("rna").alias("_m"), F.stddev_samp("rna").alias("_s"))
    far = (F.col("_s") > 0) & (F.abs(F.col("rna") - F.col("_m")) > times * F.col("_s"))
    return x.join(F.broadcast(m), "replicate").groupBy("replicate").agg(F.count(F.lit(1)).alias("n"), F.count_if(far).alias("outliers"))


def z_filter(counts: DataFrame, times: float = 3.0, place: str | None = None) -> DataFrame:
    """Barcodes whose RNA count is within so many spreads of their oligo's mean; an oligo without a spread has none.

    place as in within_oligo_outliers.
    """
    m = counts.groupBy("oligo").agg(F.avg("rna").alias("_m"), (stats.deviation_in_order("rna", place) if place else F.stddev_samp("rna")).alias("_s")).where(F.col("_s") > 0)
    return counts.join(m, "oligo").where(F.abs(F.col("rna") - F.col("_m")) <= times * F.col("_s")).select(*counts.columns)


def mad_filter(counts: DataFrame, n_bins: int = 20, times: float = 5.0, two_sided: bool = False, top_bin: bool = False) -> DataFrame:
    """Barcodes whose log2 of DNA over RNA is not far above their oligo's median, by the median deviation of their depth bin.

    Bins are between quantiles of log10 of the RNA count, closed above, the first one closed below; without top_bin the
    quantile 1 is no edge, so that the deepest barcodes are in no bin and go. A DNA count of 0 gives minus infinity, an
    RNA count of 0 no ratio and no place. Logarithms are the C library's: ratios are often just at the bound, and the
    quotient of two natural logarithms is off by a last digit for one ratio in three.
    """
    ratio = F.when((F.col("rna") > 0) & (F.col("dna") > 0), numeric.log2(F.col("dna") / F.nullif("rna", F.lit(0)))).when(F.col("rna") > 0, float("-inf"))
    x = counts.withColumn("_r", ratio).withColumn("_l", F.when(F.col("rna") > 0, numeric.log10(F.col("rna").cast("double"))))
    med = x.where("_r IS NOT NULL").groupBy("oligo").agg(F.median("_r").alias("_m"))
    x = x.join(med, "oligo").withColumn("_d", F.col("_r") - F.col("_m"))
    shares = [k / n_bins for k in range(n_bins + int(top_bin))]
    edges = x.agg(F.percentile("_l", F.array(*(F.lit(s) for s in shares))).alias("_e"))
    x = x.crossJoin(F.broadcast(edges)).withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col("_l"))))
    x = x.withColumn("_b", F.when(F.col("_l") == F.get("_e", F.lit(0)), 1).otherwise(F.col("_b"))).where((F.col("_l") <= F.element_at("_e", -1)) & (F.col("_b") >= 1))
    mad = x.where(~F.isnan("_d") & (F.abs("_d") < float("inf"))).groupBy("_b").agg(F.median(F.abs("_d")).alias("_mad"))
    d = F.abs("_d") if two_sided else F.col("_d")
    return x.join(F.broadcast(mad), "_b").where(d <= times * F.col("_mad")).select(*counts.columns)  # a row a bin


def expression_outliers(counts: DataFrame, times: float) -> DataFrame:
    """(barcode, oligo, above) of barcodes whose log2 RNA over DNA, by reads summed over replicates, is so far above the oligo's median.

    Each replicate's counts are per million with one read more for each observed barcode. The difference is compared at
    nine decimals, so that the order of a sum decides no tie.
    """
    seen = F.col("dna") + F.col("rna") > 0
    t = counts.groupBy("replicate").agg((F.sum("dna") + F.count_if(seen)).alias("_d"), (F.sum("rna") + F.count_if(seen)).alias("_r"))
    x = counts.where(seen).join(F.broadcast(t), "replicate")
    per = x.groupBy("barcode", "oligo").agg(F.sum((F.col("dna") + 1) / F.col("_d")).alias("_a"), F.sum((F.col("rna") + 1) / F.col("_r")).alias("_b")).withColumn("_v", F.log2(F.col("_b") / F.col("_a")))
    med = per.groupBy("oligo").agg(F.median("_v").alias("_m"))
    return per.join(med, "oligo").withColumn("above", F.col("_v") - F.col("_m")).where(F.round("above", 9) > times).select("barcode", "oligo", "above")


def pairwise_correlation(values: DataFrame, key: str, sample: str, value: str, spearman: bool = False) -> DataFrame:
    """(a, b, n, r) of every two samples over the keys that both have."""
    x = values.select(F.col(key).alias("_k"), F.col(sample).alias("_s"), F.col(value).cast("double").alias("_v"))
    pairs = x.toDF("_k", "a", "x").join(x.toDF("_k", "b", "y"), "_k").where("a < b")
    if spearman:
        pairs = stats.average_rank(stats.average_rank(pairs, ["a", "b"], "x", "_rx"), ["a", "b"], "y", "_ry").select("a", "b", F.col("_rx").alias("x"), F.col("_ry").alias("y"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"))


def gradient_scores(counts: DataFrame, n_bins: int, least: int) -> DataFrame:
    """(guide, reads, score, variance) of (guide, bin, n), bins numbered from 1: frequency-weighted mean bin.

    A frequency is a bin's share of all reads in it. The variance is that of a multinomial over all bins, half a read
    added to each, over the reads; guides of fewer reads than least are left out.
    """
    tot = counts.groupBy("bin").agg(F.sum("n").alias("_t"))
    f = counts.join(F.broadcast(tot), "bin").withColumn("_f", F.try_divide("n", "_t"))
    g = f.groupBy("guide").agg(F.sum("n").alias("reads"), F.sum("_f").alias("_s"), F.sum(F.col("bin") * F.col("_f")).alias("_m"), F.sum(F.col("bin") * F.col("bin") * F.col("_f")).alias("_q")).where((F.col("reads") >= least) & (F.col("reads") > 0))
    # counts on the scale of reads: f * reads / sum(f) + 0.5 in each of the bins
    total = F.col("reads") + 0.5 * n_bins
    first = (F.col("_m") / F.col("_s") * F.col("reads") + 0.5 * n_bins * (n_bins + 1) / 2) / total
    second = (F.col("_q") / F.col("_s") * F.col("reads") + 0.5 * n_bins * (n_bins + 1) * (2 * n_bins + 1) / 6) / total
    return g.select("guide", "reads", (F.col("_m") / F.col("_s")).alias("score"), ((second - first * first) / total).alias("variance"))


def centred(scores: DataFrame, value: str, control: Column, least: int = 5) -> DataFrame:
    """scores with centred: less the mean of the controls if there are least of them, else less the median of all."""
    m = scores.agg(F.count_if(control).alias("_n"), F.avg(F.when(control, F.col(value))).alias("_c"), F.median(value).alias("_m"))
    out = scores.crossJoin(F.broadcast(m))  # one row
    return out.withColumn("centred", F.col(value) - F.when(F.col("_n") >= least, F.col("_c")).otherwise(F.col("_m"))).drop("_n", "_c", "_m")


def tail_scores(counts: DataFrame, least: int) -> DataFrame:
    """(guide, replicate, lo, hi, lfc) of (guide, replicate, lo, hi): log2 of shares of the two tails, half a read added.

    Only replicates with reads in both tails count, and guides with least reads in both together.
    """
    tot = counts.groupBy("replicate").agg(F.sum("lo").alias("_l"), F.sum("hi").alias("_h")).where("_l > 0 AND _h > 0")
    x = counts.where(F.col("lo") + F.col("hi") >= least).join(F.broadcast(tot), "replicate")
    return x.withColumn("lfc", F.log2(((F.col("lo") + 0.5) / F.col("_l")) / ((F.col("hi") + 0.5) / F.col("_h")))).drop("_l", "_h")


def fold_changes(counts: DataFrame, one: str, two: str) -> DataFrame:
    """(guide, replicate, lfc): difference of log2(reads per million + 1) of condition one and two in each replicate.

    counts (guide, condition, replicate, n) has one sample a condition and replicate; another number is an error (one job).
    """
    of = counts.where(F.col("condition").isin(one, two))
    bad = of.groupBy("replicate").agg(F.count_distinct("condition").alias("c")).where("c <> 2")
    if not bad.isEmpty():
        raise ValueError("every replicate needs one sample of each condition")
    tot = of.groupBy("condition", "replicate").agg(F.sum("n").alias("_t"))
    x = of.join(F.broadcast(tot), ["condition", "replicate"]).withColumn("_v", F.log2(F.try_divide(F.col("n") * 1e6, F.col("_t")) + 1))
    side = lambda c: F.max(F.when(F.col("condition") == c, F.col("_v")))
    return x.groupBy("guide", "replicate").agg((side(one) - side(two)).alias("lfc"))


def loud_guides(counts: DataFrame, times: float, least: float) -> DataFrame:
    """(guide, condition, replicate, rpm) of samples above so many times the guide's median over its condition, and above least."""
    tot = counts.groupBy("condition", "replicate").agg(F.sum("n").alias("_t"))
    x = counts.join(F.broadcast(tot), ["condition", "replicate"]).withColumn("rpm", F.try_divide(F.col("n") * 1e6, F.col("_t")))
    med = x.groupBy("guide", "condition").agg(F.median("rpm").alias("_m"))
    return x.join(med, ["guide", "condition"]).where((F.col("rpm") > times * F.col("_m")) & (F.col("rpm") > least)).select("guide", "condition", "replicate", "rpm")


def matrix_stats(entries: DataFrame, value: str, n_rows: int, n_columns: int) -> DataFrame:
    """One row about a sparse matrix: entries other than 0, zeros, extremes over all cells, sum, and values that are no integers."""
    v = F.col(value)
    some = entries.where(v != 0).agg(F.count(F.lit(1)).alias("nnz"), F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.sum(v).alias("total"), F.count_if(v != F.floor(v)).alias("fractional"))
    zeros = F.lit(n_rows * n_columns) - F.col("nnz")
    low, high = F.when(zeros > 0, F.least("_lo", F.lit(0.0))).otherwise(F.col("_lo")), F.when(zeros > 0, F.greatest("_hi", F.lit(0.0))).otherwise(F.col("_hi"))
    return some.select("nnz", zeros.alias("zeros"), low.alias("lo"), high.alias("hi"), "total", "fractional")


def gene_flags(values: DataFrame, genes: list[str]) -> DataFrame:
    """(cell, a flag per gene): whether a cell of (cell, gene, value) has any of it."""
    hit = lambda g: F.coalesce(F.max((F.col("gene") == g) & (F.col("value") > 0)), F.lit(False))
    return values.groupBy("cell").agg(*(hit(g).alias(f"has_{g}") for g in genes))


def balanced(cells: DataFrame, strata: list[str], donor: str) -> DataFrame:
    """Cells of strata with more than one donor."""
    some = cells.groupBy(*strata).agg(F.count_distinct(donor).alias("_d")).where("_d > 1").drop("_d")
    return cells.join(some, strata, "left_semi")


def replicated(hits: DataFrame, donors: DataFrame, stratum: str, gene: str, donor: str, share: float = 0.5) -> DataFrame:
    """(stratum, gene, seen, donors): genes that pass in the share or more of a stratum's donors."""
    n = donors.groupBy(stratum).agg(F.count_distinct(donor).alias("donors"))
    x = hits.groupBy(stratum, gene).agg(F.count_distinct(donor).alias("seen")).join(n, stratum)
    return x.where(F.col("seen") / F.col("donors") >= share)


def prevalence(changes: DataFrame, gene: str, value: str, least: float) -> DataFrame:
    """(gene, n): in how many rows (cell types) of a gene its change is above least."""
    return changes.groupBy(gene).agg(F.count_if(F.col(value) > least).alias("n"))


def evidence_rank(edges: DataFrame, variant: str, assay: str, kind: str, predictions: list[str], least: int) -> DataFrame:
    """(variant, n_assays, n_edges, kinds) of variants with least assays, by falling assays, edges, and variant.

    Assays of predicted kinds do not count; edges are all of the variant's.
    """
    real = F.when(~F.col(kind).isin(predictions), F.col(assay))
    x = edges.groupBy(variant).agg(F.count_distinct(real).alias("n_assays"), F.count(F.lit(1)).alias("n_edges"), F.array_join(F.array_sort(F.collect_set(kind)), ";").alias("kinds"))
    return x.where(F.col("n_assays") >= least).orderBy(F.col("n_assays").desc(), F.col("n_edges").desc(), variant)


def trait_enrichment(hits: DataFrame, catalogue: DataFrame, trait: str, item: str, least: int) -> DataFrame:
    """(trait, a, b, c, d, enrichment, p, q) of hit items in each trait of a catalogue of rows, for traits of least hits.

    Expected is the trait's rows times the hit rows over all rows, 0.01 at least; p is one-sided, q over the traits.
    """
    x = catalogue.join(hits.select(item).distinct().withColumn("_h", F.lit(True)), item, "left")
    tot = x.agg(F.count(F.lit(1)).alias("_n"), F.count("_h").alias("_hits"))
    t = x.groupBy(trait).agg(F.count(F.lit(1)).alias("_c"), F.count("_h").alias("a")).where(F.col("a") >= least).crossJoin(F.broadcast(tot))
    t = t.withColumns({"b": F.greatest(F.col("_c") - F.col("a"), F.lit(0)), "c": F.greatest(F.col("_hits") - F.col("a"), F.lit(0))})
    t = t.withColumn("d", F.greatest(F.col("_n") - F.col("_c") - F.col("c"), F.lit(0)))
    t = t.withColumn("enrichment", F.col("a") / F.greatest(F.col("_c") * F.col("_hits") / F.col("_n"), F.lit(0.01)))
    d = lambda c: c.cast("double")
    t = t.withColumn("p", numeric.hypergeometric_tail(d(F.col("a") - 1), d(F.col("a") + F.col("b") + F.col("c") + F.col("d")), d(F.col("a") + F.col("c")), d(F.col("a") + F.col("b"))))
    t = t.select(trait, "a", "b", "c", "d", "enrichment", "p")
    return stats.benjamini_hochberg(t, [], "p", [trait], "q").select(trait, "a", "b", "c", "d", "enrichment", "p", "q")


def welch_by_gene(values: DataFrame, gene: str, group: str, a: str, b: str, value: str) -> DataFrame:
    """(gene, na, nb, log2fc, t, p, q) of values of two groups: mean of b less mean of a, by Welch's test; two values a side."""
    side = lambda f, g: f(F.when(F.col(group) == g, F.col(value)))
    m = values.groupBy(gene).agg(side(F.count, a).alias("na"), side(F.count, b).alias("nb"), side(F.avg, a).alias("_ma"), side(F.avg, b).alias("_mb"), side(F.var_samp, a).alias("_va"), side(F.var_samp, b).alias("_vb")).where("na >= 2 AND nb >= 2")
    ua, ub = F.col("_va") / F.col("na"), F.col("_vb") / F.col("nb")
    df = (ua + ub) * (ua + ub) / (ua * ua / (F.col("na") - 1) + ub * ub / (F.col("nb") - 1))
    t = F.when(ua + ub > 0, (F.col("_mb") - F.col("_ma")) / F.sqrt(ua + ub))
    m = m.withColumns({"log2fc": F.col("_mb") - F.col("_ma"), "t": t, "_df": F.when(ua + ub > 0, df)})
    m = m.withColumn("p", F.coalesce(numeric.student_p(F.coalesce("t", F.lit(float("nan"))), F.coalesce("_df", F.lit(0.0))), F.lit(1.0)))
    return stats.benjamini_hochberg(m, [], "p", [gene], "q").select(gene, "na", "nb", "log2fc", "t", "p", "q")


def paired_skew(values: DataFrame) -> DataFrame:
    """(variant, n, skew, se, t, p, q) of (variant, replicate, ref, alt): paired t over replicates of alt less ref."""
    d = values.where("ref IS NOT NULL AND alt IS NOT NULL").groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("alt") - F.col("ref")).alias("skew"), F.stddev_samp(F.col("alt") - F.col("ref")).alias("_s"))
    d = d.withColumn("se", F.col("_s") / F.sqrt("n")).withColumn("t", F.when(F.col("se") > 0, F.col("skew") / F.col("se")))
    d = d.withColumn("p", numeric.student_p(F.coalesce("t", F.lit(float("nan"))), (F.col("n") - 1).cast("double")))
    return stats.benjamini_hochberg(d, [], "p", ["variant"], "q").select("variant", "n", "skew", "se", "t", "p", "q")


def facets(df: DataFrame, fields: list[str]) -> DataFrame:
    """(facet, term, n) of several fields in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("term")) for f in fields)))
    return df.select(each.alias("x")).groupBy("x.facet", "x.term").agg(F.count(F.lit(1)).alias("n"))


def faceted_search(df: DataFrame, filters: str, order: list[Column], limit: int, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the first rows that a filter keeps, facets of all that it keeps)."""
    from lodestar.functions.dsl import filter_column

    kept = df.where(filter_column(filters))
    return kept.orderBy(*order).limit(limit), facets(kept, fields)


def named_once(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(name, id, source) of sequences that one entry of one table has: tables maps a source to (table, name column, id column)."""
    parts = [df.select(F.col(n).alias("name"), F.col(i).cast("string").alias("id"), F.lit(s).alias("source")) for s, (df, n, i) in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("id"), F.min("source").alias("source")).where("_n = 1").drop("_n")


def joined_outputs(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """One row (left_only, right_only, equal, differs) of two outputs by key, nulls being keys; both null is equal."""
    x = a.select(*(F.col(k).alias(f"_a{k}") for k in keys), F.col(value).alias("_x"), F.lit(True).alias("_l"))
    y = b.select(*(F.col(k).alias(f"_b{k}") for k in keys), F.col(value).alias("_y"), F.lit(True).alias("_r"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"_a{k}").eqNullSafe(F.col(f"_b{k}"))
    j = x.join(y, on, "full_outer")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    same = F.coalesce(F.abs(F.col("_x") - F.col("_y")) <= tolerance, F.col("_x").isNull() & F.col("_y").isNull())
    return j.agg(F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"), F.count_if(both & same).alias("equal"), F.count_if(both & ~same).alias("differs"))
