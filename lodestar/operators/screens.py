"""Screens and count tables: replicate totals, activities, fold changes, guides per cell, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import numeric
from lodestar.functions.stats import benjamini_hochberg
from lodestar.operators.ordered import value_ranks


def replicate_totals(barcodes: DataFrame) -> DataFrame:
    """(replicate, dna_total, rna_total, observed, mean_rna, sd_rna) of (barcode, oligo, replicate, dna, rna).

    A barcode is observed if it has any read; the moments are over the observed ones.
    """
    seen = F.col("dna") + F.col("rna") > 0
    rna = F.when(seen, F.col("rna").cast("double"))
    return barcodes.groupBy("replicate").agg(F.sum("dna").alias("dna_total"), F.sum("rna").alias("rna_total"), F.count_if(seen).alias("observed"), F.avg(rna).alias("mean_rna"), F.stddev_samp(rna).alias("sd_rna"))


def barcode_activity(barcodes: DataFrame, pseudocount: float = 1.0, scaling: float = 1e6) -> DataFrame:
    """barcodes with activity, log2 of RNA over DNA per scaling reads; null for a barcode that is not observed."""
    tot = replicate_totals(barcodes).select("replicate", (F.col("dna_total") + pseudocount * F.col("observed")).alias("_d"), (F.col("rna_total") + pseudocount * F.col("observed")).alias("_r"))
    share = lambda x, t: (F.col(x) + pseudocount) / F.when(F.col(t) == 0, 1).otherwise(F.col(t)) * scaling
    out = barcodes.join(F.broadcast(tot), "replicate")  # one row a replicate
    return out.withColumn("activity", F.when(F.col("dna") + F.col("rna") > 0, F.log2(share("rna", "_r") / share("dna", "_d")))).drop("_d", "_r")


def fragment_activity(counts: DataFrame, scaling: float = 5000.0) -> DataFrame:
    """(fragment, snp, allele, mean, sd, n) of (fragment, snp, allele, replicate, dna, rna): mean log RNA over DNA share.

    Half a read is added to each count; shares are within a replicate, times scaling. sd is null for one replicate.
    """
    x = counts.withColumns({"_d": F.col("dna") + 0.5, "_r": F.col("rna") + 0.5})
    tot = x.groupBy("replicate").agg(F.sum("_d").alias("_td"), F.sum("_r").alias("_tr"))
    log = F.log((F.col("_r") / F.col("_tr") * scaling) / (F.col("_d") / F.col("_td") * scaling))
    return x.join(F.broadcast(tot), "replicate").groupBy("fragment", "snp", "allele").agg(F.avg(log).alias("mean"), F.stddev_samp(log).alias("sd"), F.count(F.lit(1)).alias("n"))


def allelic_skew(activity: DataFrame) -> DataFrame:
    """(snp, ref, alt, skew) of snps with both alleles (REF or A, ALT or B): difference of their mean activities."""
    allele = F.upper("allele")
    side = F.when(allele.isin("REF", "A"), "ref").when(allele.isin("ALT", "B"), "alt")
    mean = lambda s: F.avg(F.when(side == s, F.col("mean"))).alias(s)
    out = activity.groupBy("snp").agg(mean("ref"), mean("alt")).where("ref IS NOT NULL AND alt IS NOT NULL")
    return out.withColumn("skew", F.col("alt") - F.col("ref"))


def variant_table(counts: DataFrame, declaration: DataFrame, measures: list[str], ratio: str = "ratio") -> DataFrame:
    """declaration (id, ref, alt) with measures of both oligos (missing ones 0) and log2 of the alt over the ref ratio.

    The logarithm is null where a ratio is missing or 0.
    """
    number = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    side = lambda s: counts.select(F.col("oligo").alias(s), *(number(m).alias(f"{m}_{s}") for m in measures))
    out = declaration.join(side("ref"), "ref", "left").join(side("alt"), "alt", "left")
    out = out.withColumns({f"{m}_{s}": F.coalesce(f"{m}_{s}", F.lit(0.0)) for m in measures for s in ("ref", "alt")})
    both = (F.col(f"{ratio}_ref") != 0) & (F.col(f"{ratio}_alt") != 0)
    return out.withColumn("log2_skew", F.when(both, F.log2(F.col(f"{ratio}_alt") / F.col(f"{ratio}_ref"))))


def aggregate_lfcs(lfcs: DataFrame, key: str, value: str, how: str = "median") -> DataFrame:
    """One fold change per key over replicates: mean, median or population sd; null if a replicate is missing."""
    agg = {"mean": F.avg, "median": F.median, "sd": F.stddev_pop}
    if how not in agg:
        raise ValueError("how must be mean, median or sd")
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return lfcs.groupBy(key).agg(F.when(F.count(x) == F.count(F.lit(1)), agg[how](x)).alias(value))


def add_screens(a: DataFrame, b: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Sum of two screens in long form that hold the same keys; a difference is an error (one job checks it)."""
    both = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b"), count).unionByName(b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b"), count))
    summed = both.groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"), F.sum(count).alias(count))
    if not summed.where("_a <> _b").isEmpty():
        raise ValueError("the screens do not have the same guides and samples")
    return summed.select(*keys, count)


def flat_counts(samples: dict[str, DataFrame]) -> DataFrame:
    """(guide, count, sample) of count tables (guide, count) by sample name."""
    parts = [df.select("guide", "count", F.lit(name).alias("sample")) for name, df in samples.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def element_scores(guides: DataFrame, controls: DataFrame, min_guides: int = 3, fdr: float = 0.05, min_effect: float = 0.0) -> DataFrame:
    """(element, n, mean, sem, t, p, q, p_u, q_u, significant, regulated) of guides (element, score) against controls (score).

    Student's t with equal variances and the rank-sum test, each with Benjamini-Hochberg over elements of min_guides or
    more; significant by t, regulated by ranks and below the controls, both with an effect of min_effect at least.
    """
    ctrl = controls.agg(F.count("score").alias("nc"), F.avg("score").alias("mc"), F.var_samp("score").alias("vc"))
    g = guides.groupBy("element").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.var_samp("score").alias("v")).where(F.col("n") >= min_guides)
    x = g.crossJoin(F.broadcast(ctrl))  # one row
    pooled = ((F.col("n") - 1) * F.col("v") + (F.col("nc") - 1) * F.col("vc")) / (F.col("n") + F.col("nc") - 2)
    x = x.withColumn("t", (F.col("mean") - F.col("mc")) / F.sqrt(pooled * (1 / F.col("n") + 1 / F.col("nc"))))
    x = x.withColumn("p", numeric.student_p("t", (F.col("n") + F.col("nc") - 2).cast("double"))).withColumn("sem", F.sqrt(F.col("v") / F.col("n")))
    below = value_ranks(controls.where("score IS NOT NULL"), "score").select("score", F.col("n").alias("c"))
    u = mann_whitney(guides.join(g.select("element"), "element", "left_semi"), below, "element", "score")
    x = x.join(u, "element").withColumn("p_u", numeric.rank_sum_test("u", F.col("n").cast("double"), F.col("nc").cast("double"), "tie_term"))
    x = benjamini_hochberg(benjamini_hochberg(x, [], "p", ["element"], "q"), [], "p_u", ["element"], "q_u")
    effect = F.abs(F.col("mean") - F.col("mc")) >= min_effect
    return x.select("element", "n", "mean", "sem", "t", "p", "q", "u", "p_u", "q_u", ((F.col("q") < fdr) & effect).alias("significant"), ((F.col("q_u") < fdr) & effect & (F.col("mean") < F.col("mc"))).alias("regulated"))


def mann_whitney(groups: DataFrame, control_counts: DataFrame, key: str, value: str) -> DataFrame:
    """(key, u, tie_term) of every group against one set of controls, given by the count c of each value.

    The controls below and at a value come from running sums over the different values of both; nothing is paired.
    """
    from lodestar.operators.ordered import running

    own = groups.groupBy(key, value).agg(F.count(F.lit(1)).alias("g"))
    values = control_counts.select(value, "c").unionByName(own.select(value).distinct().withColumn("c", F.lit(0).cast("long"))).groupBy(value).agg(F.sum("c").alias("c"))
    lower = running(values, [], [F.col(value)], {"below": ("sum", F.col("c"))}, before=True)
    cube = lambda t: t * t * t - t
    alone = values.agg(F.sum(cube(F.col("c"))).alias("_ties"))
    met = own.join(lower, value).crossJoin(F.broadcast(alone))  # one row
    out = met.groupBy(key).agg(F.sum(F.col("g") * (F.col("below") + F.col("c") / 2.0)).alias("u"), (F.max("_ties") + F.sum(cube(F.col("g") + F.col("c")) - cube(F.col("c")))).cast("double").alias("tie_term"))
    return out


def to_real_space(estimates: DataFrame, background: float = 0.0, clamp: float = 5.0) -> DataFrame:
    """estimates (guide, target, log_mean, log_sd) with effect and sd of the log-normal, relative to the controls.

    Controls are rows with target negative_control. The mean less background is divided by the controls' median, cut to
    [0, clamp], and divided by the controls' mean after that. Without controls the effect is null.
    """
    mean = F.pow(F.lit(10.0), F.col("log_mean") + F.col("log_sd") * F.col("log_sd") / 2)
    sd = F.sqrt((F.pow(F.lit(10.0), F.col("log_sd") * F.col("log_sd")) - 1) * mean * mean)
    x = estimates.withColumns({"_m": mean - background, "sd": sd})
    control = F.col("target") == "negative_control"
    x = x.crossJoin(F.broadcast(x.agg(F.median(F.when(control, F.col("_m"))).alias("_c"))))  # one row
    x = x.withColumn("_m", F.greatest(F.lit(0.0), F.least(F.lit(clamp), F.col("_m") / F.col("_c"))))
    x = x.crossJoin(F.broadcast(x.agg(F.avg(F.when(control, F.col("_m"))).alias("_c2"))))  # one row
    return x.withColumn("effect", F.col("_m") / F.col("_c2")).drop("_m", "_c", "_c2")


def guide_count_checks(flat: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grouping, a, b, r) of every two samples of a grouping, and (grouping, guide, mean, sd, cv) over its samples.

    flat (guide, sample, count), samples (sample, grouping). Counts are percent of their sample; a guide that a sample
    has not counts 0 in it.
    """
    pct = flat.join(flat.groupBy("sample").agg(F.sum("count").alias("_t")), "sample").select("sample", "guide", (F.col("count") / F.col("_t") * 100).alias("x")).groupBy("sample", "guide").agg(F.sum("x").alias("x"))
    of = pct.join(F.broadcast(samples), "sample")
    grid = of.select("grouping", "guide").distinct().join(F.broadcast(samples), "grouping")
    full = grid.join(of, ["grouping", "guide", "sample"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    a, b = full.toDF("grouping", "guide", "a", "xa"), full.toDF("grouping", "guide", "b", "xb")
    r = a.join(b, ["grouping", "guide"]).where("a < b").groupBy("grouping", "a", "b").agg(F.corr("xa", "xb").alias("r"))
    cv = full.groupBy("grouping", "guide").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.count(F.lit(1)).alias("_n")).where("_n >= 2").drop("_n")
    return r, cv.withColumn("cv", F.when(F.col("mean") != 0, F.col("sd") / F.col("mean") * 100))


def library_qc(counts: DataFrame) -> DataFrame:
    """(sample, library_size, genes_detected, top10_frac) of (sample, gene, count)."""
    rn = F.row_number().over(Window.partitionBy("sample").orderBy(F.col("count").desc(), "gene"))
    out = counts.withColumn("_rn", rn).groupBy("sample").agg(F.sum("count").alias("library_size"), F.count_if(F.col("count") > 0).alias("genes_detected"), F.sum(F.when(F.col("_rn") <= 10, F.col("count"))).alias("_top"))
    return out.select("sample", "library_size", "genes_detected", F.when(F.col("library_size") > 0, F.col("_top") / F.col("library_size")).otherwise(0.0).alias("top10_frac"))


def knockdown_summary(tested: DataFrame, guides: DataFrame, fold: float = 0.4, p_cut: float = 0.05) -> DataFrame:
    """One row about guides on their own target: tested (guide, gene, lfc, p), guides (guide, target, targeting).

    Strong is a fold change of fold or less, significant a p below p_cut; shares are of the guides with both values.
    """
    own = tested.join(guides.select("guide", "target"), "guide").where("gene = target").groupBy("guide", "gene").agg(F.min(F.struct("lfc", "p")).alias("s"))
    x = guides.join(own.select("guide", "s.lfc", "s.p"), "guide", "left")
    valid = F.col("lfc").isNotNull() & F.col("p").isNotNull()
    strong, sig = valid & (F.col("lfc") <= F.log2(F.lit(fold))), valid & (F.col("p") < p_cut)
    lfc = F.when(valid, F.col("lfc"))
    counts = x.agg(F.count(F.lit(1)).alias("n_guides"), F.count_if(valid).alias("n_tested"), F.count_if(strong).alias("n_strong"), F.count_if(sig).alias("n_significant"), F.count_if(strong & sig).alias("n_both"), F.median(lfc).alias("median_lfc"), F.avg(lfc).alias("mean_lfc"))
    return counts.withColumns({f"frac_{k}": F.when(F.col("n_tested") > 0, F.col(f"n_{k}") / F.col("n_tested")).otherwise(0.0) for k in ("strong", "significant", "both")})


def trans_summary(tested: DataFrame, guides: DataFrame, p_cut: float = 0.05, method: str = "fdr_bh") -> DataFrame:
    """Per guide, its tests other than on its own target: n, significant ones up and down, and fold changes.

    p is adjusted over all tests by fdr_bh, bonferroni or none; rows without a fold change or p do not count.
    """
    if method == "fdr_bh":
        adj = benjamini_hochberg(tested, [], "p", ["guide", "gene"], "p_adj")
    elif method == "bonferroni":
        n = tested.agg(F.count(F.when(~F.isnan("p"), F.col("p"))).alias("_n"))
        adj = tested.crossJoin(F.broadcast(n)).withColumn("p_adj", F.least(F.lit(1.0), F.col("p") * F.col("_n"))).drop("_n")
    else:
        adj = tested.withColumn("p_adj", F.col("p"))
    x = adj.join(guides.select("guide", "target"), "guide").where("gene <> target AND lfc IS NOT NULL AND p_adj IS NOT NULL")
    sig = F.col("p_adj") < p_cut
    out = x.groupBy("guide").agg(F.count(F.lit(1)).alias("n_tests"), F.count_if(sig).alias("n_significant"), F.count_if(sig & (F.col("lfc") > 0)).alias("n_up"), F.count_if(sig & (F.col("lfc") < 0)).alias("n_down"), F.median("lfc").alias("median_lfc"), F.max(F.abs("lfc")).alias("max_abs_lfc"))
    return out.withColumn("frac_significant", F.col("n_significant") / F.col("n_tests"))


def collapse_guides(assigned: DataFrame, max_elements: int = 1, min_guides: int = 2, max_guides: int = 2) -> DataFrame:
    """(cell, element, guides) of cells whose guides (cell, guide, element) are few and on few elements, joined by |."""
    per = assigned.groupBy("cell").agg(F.count_distinct("element").alias("_e"), F.count(F.lit(1)).alias("_g"))
    keep = per.where((F.col("_e") <= max_elements) & F.col("_g").between(min_guides, max_guides))
    return assigned.join(keep.select("cell"), "cell", "left_semi").groupBy("cell", "element").agg(F.array_join(F.array_sort(F.collect_list("guide")), "|").alias("guides"))


def merge_guides(counts: DataFrame, by_target: bool) -> DataFrame:
    """(cell, feature, umi): sums over guides of one feature, or of what stands before | in its name."""
    feature = F.substring_index("feature", "|", 1) if by_target else F.col("feature")
    return counts.groupBy("cell", feature.alias("feature")).agg(F.sum("umi").alias("umi"))


def cell_covariates(response: DataFrame, grna: DataFrame) -> DataFrame:
    """Per cell: genes and UMIs, the share of UMIs in genes named MT-, guides and guide UMIs; missing ones 0.

    response (cell, gene, n), grna (cell, guide, n).
    """
    mt = F.sum(F.when(F.col("gene").rlike("(?i)^MT-"), F.col("n")).otherwise(0))
    a = response.groupBy("cell").agg(F.count_if(F.col("n") != 0).alias("response_n_nonzero"), F.sum("n").alias("response_n_umis"), mt.alias("_mt"))
    b = grna.groupBy("cell").agg(F.count_if(F.col("n") != 0).alias("grna_n_nonzero"), F.sum("n").alias("grna_n_umis"))
    out = a.join(b, "cell", "full_outer").na.fill(0)
    return out.withColumn("response_p_mito", F.when(F.col("response_n_umis") > 0, F.col("_mt") / F.col("response_n_umis")).otherwise(0.0)).drop("_mt")


def guide_capture(counts: DataFrame, n_cells: int) -> DataFrame:
    """Per guide of (cell, guide, umi): cells that detect it, their share, and the moments of its UMIs where detected."""
    seen = counts.where(F.col("umi") > 0)
    return seen.groupBy("guide").agg(F.count(F.lit(1)).alias("n_cells"), (F.count(F.lit(1)) / n_cells).alias("frac_cells"), F.sum("umi").alias("total_umi"), F.avg("umi").alias("mean_umi"), F.median("umi").alias("median_umi"), F.stddev_pop("umi").alias("sd_umi"), F.max("umi").alias("max_umi"))


def guides_per_cell(assigned: DataFrame, cells: DataFrame) -> DataFrame:
    """One row about guides per cell of (cell, guide), over all cells: moments, and how many cells have any or just one."""
    n = cells.select("cell").distinct().join(assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("g")), "cell", "left").select(F.coalesce("g", F.lit(0)).alias("g"))
    return n.agg(F.count(F.lit(1)).alias("n_cells"), F.avg("g").alias("mean"), F.stddev_samp("g").alias("sd"), F.min("g").alias("least"), F.max("g").alias("most"), F.median("g").alias("median"), F.count_if(F.col("g") > 0).alias("with_guide"), F.count_if(F.col("g") == 1).alias("with_one"), F.avg((F.col("g") > 0).cast("double")).alias("frac_with_guide"))


def batch_metrics(cells: DataFrame, batch: str, measures: list[str]) -> DataFrame:
    """Per batch: cells, and mean, median, sd, least and most of each measure."""
    per = [f(m).alias(f"{m}_{name}") for m in measures for name, f in (("mean", F.avg), ("median", F.median), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return cells.groupBy(batch).agg(F.count(F.lit(1)).alias("n_cells"), *per)


def restrict_pairs(pairs: DataFrame, genes: DataFrame, guides: DataFrame) -> DataFrame:
    """pairs (guide, gene, ...) whose gene and guide are both measured."""
    return pairs.join(genes.select("gene").distinct(), "gene", "left_semi").join(guides.select("guide").distinct(), "guide", "left_semi")


def shared_cells(a: DataFrame, b: DataFrame, key: str = "cell") -> tuple[DataFrame, DataFrame]:
    """Both modalities restricted to the cells that they share."""
    return a.join(b.select(key).distinct(), key, "left_semi"), b.join(a.select(key).distinct(), key, "left_semi")


def enrichment_scores(late: DataFrame, early: DataFrame, keys: list[str], pseudocount: float = 1.0, least: int = 0) -> DataFrame:
    """log2 of the frequency (n + pseudocount over the library's total) in late over early, of keys with least reads in both together."""
    both = late.select(*keys, F.col("n").alias("late")).join(early.select(*keys, F.col("n").alias("early")), keys, "full_outer").na.fill(0, ["late", "early"])
    tot = both.agg(F.greatest(F.sum("late"), F.lit(1)).alias("_l"), F.greatest(F.sum("early"), F.lit(1)).alias("_e"))
    x = both.where(F.col("late") + F.col("early") >= least).crossJoin(F.broadcast(tot))  # one row
    return x.withColumn("log2_enrichment", F.log2(((F.col("late") + pseudocount) / F.col("_l")) / ((F.col("early") + pseudocount) / F.col("_e")))).drop("_l", "_e")


def network_edges(edges: DataFrame, source: str, weight: str, least: float | None = 0.01, center: str | None = None) -> DataFrame:
    """Different edges of an absolute weight from least on, of one centre if it is given."""
    out = edges.distinct()
    if least is not None:
        out = out.where(F.abs(weight) >= least)
    return out.where(F.col(source) == center) if center is not None else out


def top_baseline(genes: DataFrame, score: Column, n: int) -> DataFrame:
    """The n genes of (trait, credible_set, gene, ...) that come first by score in each credible set; nulls come last."""
    w = Window.partitionBy("trait", "credible_set").orderBy(score, "gene")
    return genes.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def evaluate_baseline(genes: DataFrame, score: Column, n: int) -> DataFrame:
    """(trait, sets, predictions, correct, recall, precision) of the n first genes a credible set against its true gene.

    genes (trait, credible_set, gene, truth, ...): truth marks the true gene of its set.
    """
    total = genes.groupBy("trait").agg(F.count_distinct("credible_set").alias("sets"))
    truth = genes.where("truth").select("trait", "credible_set", F.col("gene").alias("true_gene")).distinct()
    met = top_baseline(genes, score, n).join(truth, ["trait", "credible_set"], "left")
    hit = F.when(F.col("gene") == F.col("true_gene"), F.struct("credible_set", "gene"))
    x = met.groupBy("trait").agg(F.count_distinct(F.struct("credible_set", "gene")).alias("predictions"), F.count_distinct(hit).alias("correct")).join(total, "trait")
    return x.select("trait", "sets", "predictions", "correct", (F.col("correct") / F.col("sets")).alias("recall"), (F.col("correct") / F.col("predictions")).alias("precision"))


def hallmark_coverage(changes: DataFrame, hallmarks: DataFrame, least: float) -> DataFrame:
    """(cell_type, hallmarks_present, genes): hallmarks (hallmark, gene) with a gene above least among (cell_type, gene, lfc)."""
    hit = changes.where(F.col("lfc") > least).join(F.broadcast(hallmarks), "gene")
    present = hit.groupBy("cell_type").agg(F.count_distinct("hallmark").alias("h"), F.array_join(F.array_sort(F.collect_set("gene")), ",").alias("genes"))
    return changes.select("cell_type").distinct().join(present, "cell_type", "left").select("cell_type", F.coalesce("h", F.lit(0)).alias("hallmarks_present"), F.coalesce("genes", F.lit("")).alias("genes"))


def adjusted_rand(cells: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, index): agreement of two labels of the same rows, corrected for chance; 1 if both are one group."""
    pairs = lambda n: n * (n - 1) / 2
    both = cells.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    s = both.agg(F.sum(pairs(F.col("n"))).alias("ab"), F.sum("n").alias("n"))
    sa = both.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sa"))
    sb = both.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sb"))
    x = s.crossJoin(sa).crossJoin(sb)  # one row each
    expected, most = F.col("sa") * F.col("sb") / pairs(F.col("n")), (F.col("sa") + F.col("sb")) / 2
    return x.select("n", F.when(most == expected, 1.0).otherwise((F.col("ab") - expected) / (most - expected)).alias("index"))


def set_test(hits: DataFrame, members: DataFrame, background: DataFrame, gene: str, set_col: str) -> DataFrame:
    """(set, a, b, c, d, fold, p) of the hits among the genes of each set, one-sided by the hypergeometric tail.

    a hits in the set, b hits outside, c other background genes in the set, d the rest. Genes count once.
    """
    deg, bg = hits.select(gene).distinct().withColumn("_h", F.lit(1)), background.select(gene).distinct().withColumn("_b", F.lit(1))
    m = members.select(set_col, gene).distinct().join(deg, gene, "left").join(bg, gene, "left")
    sizes = m.groupBy(set_col).agg(F.count("_h").alias("a"), F.count_if(F.col("_b").isNotNull() & F.col("_h").isNull()).alias("c"), F.count_if(F.col("_b").isNotNull()).alias("_in"), F.count_if(F.col("_h").isNotNull() & F.col("_b").isNotNull()).alias("_hb"))
    n_hits = deg.agg(F.count(F.lit(1)).alias("_hits"))
    n_bg = bg.join(deg, gene, "left").agg(F.count(F.lit(1)).alias("_n"), F.count("_h").alias("_hbg"))
    x = sizes.crossJoin(F.broadcast(n_hits)).crossJoin(F.broadcast(n_bg))  # one row each
    x = x.withColumns({"b": F.col("_hits") - F.col("a"), "d": F.col("_n") - F.col("_hbg") - F.col("c")})
    expected = F.col("_hits") * F.col("_in") / F.col("_n")
    x = x.withColumn("fold", F.when(expected > 0, F.col("a") / expected).otherwise(float("inf")))
    n, k, draws = F.col("a") + F.col("b") + F.col("c") + F.col("d"), F.col("a") + F.col("b"), F.col("a") + F.col("c")
    p = numeric.hypergeometric_tail((F.col("a") - 1).cast("double"), n.cast("double"), k.cast("double"), draws.cast("double"))
    return x.select(set_col, "a", "b", "c", "d", "fold", p.alias("p"))


def skew_normal(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, xi, omega, alpha): skew-normal by moments, from means of powers; skewness is cut to 0.99."""
    x = F.col(value)
    m = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.skewness(x).alias("g"))
    g = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.col("g")))
    a = F.pow(F.abs(g), 2.0 / 3.0)
    size = F.sqrt(F.lit(3.141592653589793 / 2) * a / (a + ((4 - 3.141592653589793) / 2) ** (2.0 / 3.0)))
    delta = F.greatest(F.lit(-0.995), F.least(F.lit(0.995), F.signum(g) * size))
    out = m.withColumn("_d", delta).withColumn("omega", F.col("s") / F.sqrt(1 - 2 * F.col("_d") * F.col("_d") / 3.141592653589793))
    return out.select(*keys, "n", (F.col("m") - F.col("omega") * F.col("_d") * (2 / 3.141592653589793) ** 0.5).alias("xi"), "omega", (F.col("_d") / F.sqrt(1 - F.col("_d") * F.col("_d"))).alias("alpha"))


def robust_rank(ranks: DataFrame, key: str, rank: str, alpha: float = 0.25) -> DataFrame:
    """(key, n, rho): the smallest beta probability of a group's normalised ranks up to alpha, or of its best one."""
    w = Window.partitionBy(key)
    x = ranks.where(F.col(rank).isNotNull() & ~F.isnan(rank)).select(key, F.col(rank).cast("double").alias("r"), F.row_number().over(w.orderBy(rank)).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    x = x.where((F.col("r") <= alpha) | (F.col("i") == 1))
    p = numeric.beta_cdf("r", F.col("i").cast("double"), (F.col("n") - F.col("i") + 1).cast("double"))
    return x.withColumn("_p", p).groupBy(key, "n").agg(F.min("_p").alias("rho"))
