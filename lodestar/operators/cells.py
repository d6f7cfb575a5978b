"""Cells and gene sets: fragment and expression metrics, gates, correlations of peaks and genes, set merging and scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.stats import benjamini_hochberg
from lodestar.operators.graph import connected_components
from lodestar.operators.ordered import down, row_numbers, running, value_ranks
from lodestar.operators.ranges import distance_pairs, merge_intervals, overlap_join


def fragment_metrics(fragments: DataFrame, tss: DataFrame, peaks: DataFrame, bin_size: int = 4096) -> DataFrame:
    """Per cell of fragments (chr, start, end, cell, reads): fragments, reads, short (< 147) and mono (147 to 293) ones,
    those that meet a peak (chr, start, end), and cut sites at the centre (-500 to 499) and flank (901 to 1000, -1000 to
    -901) of starts (chr, pos, sign), by the start's strand.
    """
    size = F.col("end") - F.col("start")
    f = fragments.select("chr", "start", "end", "cell", "reads")
    basic = f.groupBy("cell").agg(F.count(F.lit(1)).alias("num_frags"), F.sum("reads").alias("reads"), F.count_if(size < 147).alias("nf"), F.count_if((size >= 147) & (size < 294)).alias("mono"))
    merged = merge_intervals(peaks.select("chr", "start", "end"), ["chr"]).select("chr", F.col("start").alias("start_b"), F.col("end").alias("end_b"))
    inside = overlap_join(f, merged, ["chr"], bin_size, how="semi").groupBy("cell").agg(F.count(F.lit(1)).alias("in_peaks"))
    cuts = f.select("chr", "cell", F.explode(F.array(F.col("start"), F.col("end") - 1)).alias("pos"))
    near = distance_pairs(cuts, tss.select("chr", F.col("pos").alias("pos_b"), "sign"), ["chr"], 1001)
    off = (F.col("pos") - F.col("pos_b")) * F.col("sign")
    about = near.groupBy("cell").agg(F.count_if(off.between(-500, 499)).alias("center"), F.count_if(off.between(-1000, -901) | off.between(901, 1000)).alias("flank"))
    return basic.join(inside, "cell", "left").join(about, "cell", "left").na.fill(0, ["in_peaks", "center", "flank"])


def peak_gene_correlation(peaks: DataFrame, genes: DataFrame, opened: DataFrame, expressed: DataFrame, n_cells: int, window: int) -> DataFrame:
    """(peak, gene, r) of peaks (peak, chr, pos) and genes (gene, chr, pos) nearer than window, over all cells.

    opened (peak, cell, x) and expressed (gene, cell, y) hold what is not 0; cells that both lack count as zeros, so the
    sums of products need only the cells that a pair shares.
    """
    pairs = distance_pairs(peaks, genes.select("gene", "chr", F.col("pos").alias("pos_b")), ["chr"], window).select("peak", "gene")
    sums = lambda df, key, v: df.groupBy(key).agg(F.sum(v).alias(f"s{v}"), F.sum(F.col(v) * F.col(v)).alias(f"q{v}"))
    shared = pairs.join(opened, "peak").join(expressed, ["gene", "cell"]).groupBy("peak", "gene").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    out = pairs.join(sums(opened, "peak", "x"), "peak").join(sums(expressed, "gene", "y"), "gene").join(shared, ["peak", "gene"], "left")
    n = F.lit(float(n_cells))
    cov = n * F.coalesce("xy", F.lit(0.0)) - F.col("sx") * F.col("sy")
    spread = (n * F.col("qx") - F.col("sx") * F.col("sx")) * (n * F.col("qy") - F.col("sy") * F.col("sy"))
    return out.select("peak", "gene", F.when(spread > 0, cov / F.sqrt(spread)).alias("r"))


def merge_sets(members: DataFrame, criterion: str = "jaccard", cutoff: float = 0.7, least: int = 5, hub: int = 400, across: bool = True) -> DataFrame:
    """(source, name, group) of gene sets (source, name, gene): sets that agree are one group, named by its smallest set.

    Only sets of least genes or more are compared, and only those that share a gene of no more than hub sets; a gene of
    more sets makes no pairs, so a gene makes at most hub ** 2 / 2 of them, but it counts in the score. criterion: jaccard
    or containment. across: only sets of different sources.
    """
    if criterion not in ("jaccard", "containment"):
        raise ValueError("criterion must be jaccard or containment")
    m = members.where("name <> '' AND gene <> ''").select("source", "name", "gene").distinct()
    named = row_numbers(m.select("source", "name").distinct(), [F.col("source"), F.col("name")], "id")
    m = m.join(named, ["source", "name"]).select("id", "source", "gene")
    size = m.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    m = m.join(size, "id")
    rare = m.join(m.groupBy("gene").agg(F.count(F.lit(1)).alias("_s")).where(F.col("_s") <= hub).select("gene"), "gene", "left_semi")
    a, b = m.toDF("a", "sa", "gene", "na"), m.toDF("b", "sb", "gene", "nb")
    other = F.col("sa") != F.col("sb") if across else F.lit(True)
    pairs = rare.toDF("a", "sa", "gene", "na").join(rare.toDF("b", "sb", "gene", "nb"), "gene").where(F.col("a") < F.col("b")).where(other).select("a", "b").distinct()
    shared = pairs.join(a.select("a", "gene", "na"), "a").join(b.select("b", "gene", "nb"), ["b", "gene"]).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    score = F.col("c") / (F.col("na") + F.col("nb") - F.col("c")) if criterion == "jaccard" else F.col("c") / F.least("na", "nb")
    linked = connected_components(shared.where(score >= cutoff).select("a", "b"))
    out = named.join(linked, F.col("id") == F.col("node"), "left").select("source", "name", F.coalesce("component", "id").alias("_g"))
    label = named.select(F.col("id").alias("_g"), F.concat_ws(":", "source", "name").alias("group"))
    return out.join(label, "_g").select("source", "name", "group")


def failures(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """(gate, total, alone): rows that fail a gate (false or null), and those that fail no other."""
    fails = {g: ~F.coalesce(c, F.lit(False)) for g, c in gates.items()}
    n = reduce(lambda a, b: a + b, (c.cast("int") for c in fails.values()))
    counts = df.select(n.alias("_n"), *(c.alias(f"_f{k}") for k, c in enumerate(fails.values())))
    row = counts.agg(F.array(*(F.struct(F.lit(g).alias("gate"), F.count_if(F.col(f"_f{k}")).alias("total"), F.count_if(F.col(f"_f{k}") & (F.col("_n") == 1)).alias("alone")) for k, g in enumerate(fails))).alias("r"))
    return row.select(F.explode("r").alias("r")).select("r.*")


def threshold_report(df: DataFrame, passes: Column, columns: list[str]) -> DataFrame:
    """(measure, value): rows, those that pass, their share, and medians of columns before and after."""
    ok = F.coalesce(passes, F.lit(False))
    x = df.withColumn("_ok", ok)
    items = {"rows": F.count(F.lit(1)).cast("double"), "passed": F.count_if("_ok").cast("double"), "fraction": F.count_if("_ok") / F.count(F.lit(1))}
    for c in columns:
        items |= {f"median_before:{c}": F.median(c), f"median_after:{c}": F.median(F.when(F.col("_ok"), F.col(c)))}
    row = x.agg(F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in items.items())).alias("r"))
    return row.select(F.explode("r").alias("r")).select("r.*")


def joint_metrics(rna: DataFrame, atac: DataFrame, drop_empty: bool = False) -> DataFrame:
    """(cell, umis, genes, tss, frags) of both modalities, 0 where one has not the cell; drop_empty: cells with any of it."""
    out = rna.select("cell", "umis", "genes").join(atac.select("cell", "tss", "frags"), "cell", "full_outer").na.fill(0)
    return out.where((F.col("umis") > 0) | (F.col("frags") > 0)) if drop_empty else out


def joint_label(min_umis: float, min_genes: float, min_tss: float, min_frags: float) -> Column:
    """both, RNA only, ATAC only or neither, by what reaches its cut-offs."""
    rna, atac = (F.col("umis") >= min_umis) & (F.col("genes") >= min_genes), (F.col("tss") >= min_tss) & (F.col("frags") >= min_frags)
    return F.when(rna & atac, "both").when(rna, "RNA only").when(atac, "ATAC only").otherwise("neither")


def expression_qc(counts: DataFrame, min_genes: int, min_cells: int, max_mito: float, mito: str = "^MT-") -> DataFrame:
    """counts (cell, gene, n) of cells with enough genes and not too much mitochondrial share, and of genes in enough such cells."""
    seen = counts.where(F.col("n") > 0)
    share = F.sum(F.when(F.col("gene").rlike(f"(?i){mito}"), F.col("n")).otherwise(0)) / F.sum("n")
    cells = seen.groupBy("cell").agg(F.count(F.lit(1)).alias("_g"), share.alias("_m")).where((F.col("_g") >= min_genes) & (F.col("_m") <= max_mito))
    kept = seen.join(cells.select("cell"), "cell", "left_semi")
    genes = kept.groupBy("gene").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= min_cells)
    return kept.join(genes.select("gene"), "gene", "left_semi")


def assign_most(counts: DataFrame, least_share: float, least_total: float) -> DataFrame:
    """(cell, guide, umi): the guide with the most UMIs of each cell (cell, guide, umi) that has enough of them in all and in share.

    Of guides with equally many the first by name counts.
    """
    best = counts.groupBy("cell").agg(F.sum("umi").alias("_t"), F.max(F.struct("umi")).alias("_top"))
    first = counts.join(best, "cell").where(F.col("umi") == F.col("_top.umi")).groupBy("cell", "_t", "umi").agg(F.min("guide").alias("guide"))
    return first.where((F.col("_t") >= least_total) & (F.col("umi") / F.col("_t") >= least_share)).select("cell", "guide", "umi")


def compare_results(ours: DataFrame, theirs: DataFrame, keys: list[str], fdr: float = 0.1) -> DataFrame:
    """One row about results (keys, p, effect) in both: matched rows, hits by Benjamini-Hochberg, and agreement of signs."""
    m = ours.select(*keys, F.col("p").alias("pa"), F.col("effect").alias("ea")).join(theirs.select(*keys, F.col("p").alias("pb"), F.col("effect").alias("eb")), keys).where("pa IS NOT NULL AND pb IS NOT NULL")
    m = benjamini_hochberg(benjamini_hochberg(m, [], "pa", keys, "qa"), [], "pb", keys, "qb")
    a, b = F.col("qa") < fdr, F.col("qb") < fdr
    same = (F.signum("ea") == F.signum("eb")).cast("double")
    return m.agg(F.count(F.lit(1)).alias("matched"), F.count_if(a).alias("hits_ours"), F.count_if(b).alias("hits_theirs"), F.count_if(a & b).alias("hits_both"), F.avg(F.when(a & b, same)).alias("sign_agreement_hits"), F.avg(same).alias("sign_agreement_all"))


def enrichment_walk(ranked: DataFrame, sets: DataFrame, min_size: int = 10, max_size: int = 1000) -> DataFrame:
    """(set, size, es): the running sum over genes (gene, score) by falling score that goes up at a set's genes by their
    absolute scores and down at others, where it is farthest from 0.

    Only places at and just before a set's genes can be extreme, so nothing but members is ranked per set.
    """
    place = row_numbers(ranked, [down("score"), F.col("gene")], "rank")
    n = ranked.agg(F.count(F.lit(1)).alias("n_genes"))
    m = sets.select("set", "gene").distinct().join(place, "gene").withColumn("w", F.abs("score"))
    size = m.groupBy("set").agg(F.count(F.lit(1)).alias("size"), F.sum("w").alias("total")).where(F.col("size").between(min_size, max_size))
    w = Window.partitionBy("set").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    x = m.join(size, "set").crossJoin(F.broadcast(n)).select("set", "size", "total", "n_genes", "rank", "w", F.sum("w").over(w).alias("hit"), F.count(F.lit(1)).over(w).alias("k"))
    share = lambda v: F.when(F.col("total") > 0, v / F.col("total")).otherwise(0.0)
    missed = (F.col("rank") - F.col("k")) / F.greatest(F.col("n_genes") - F.col("size"), F.lit(1))
    at, before = share(F.col("hit")) - missed, share(F.col("hit") - F.col("w")) - missed
    ends = x.select("set", "size", at.alias("at"), before.alias("before")).groupBy("set", "size").agg(F.max("at").alias("top"), F.min("before").alias("low"))
    return ends.select("set", "size", F.when(F.col("top") >= -F.col("low"), F.col("top")).otherwise(F.col("low")).alias("es"))


def quantiles(df: DataFrame, value: str, name: str = "quantile") -> DataFrame:
    """df with (average rank - 1) / (rows - 1) of a value; zeros take the lowest ranks but have quantile 0, as has a single row."""
    ranks = value_ranks(df, value, name="_rank").select(F.col(value).alias("_v"), "_rank")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    out = df.join(ranks, F.col(value).eqNullSafe(F.col("_v"))).crossJoin(F.broadcast(n))  # one row
    q = F.when((F.col(value) == 0) | (F.col("_n") < 2), 0.0).otherwise((F.col("_rank") - 1) / (F.col("_n") - 1))
    return out.withColumn(name, q).drop("_v", "_rank", "_n")


def interpolated(x: Column, reference: list[tuple[float, float]]) -> Column:
    """Line through reference points (x, y) by x, carried on beyond both ends, and 0 at least."""
    points = sorted(reference)
    pieces = list(zip(points, points[1:], strict=False))
    line = lambda p, q: p[1] + (x - p[0]) * ((q[1] - p[1]) / (q[0] - p[0]))
    out = line(*pieces[-1])
    for p, q in reversed(pieces[:-1]):
        out = F.when(x <= q[0], line(p, q)).otherwise(out)
    return F.greatest(out, F.lit(0.0))


def model_score(df: DataFrame, weights: dict[str, float], intercept: float, reference: list[tuple[float, float]], epsilon: float = 0.01, gate: Column | None = None) -> DataFrame:
    """df with score (logistic, over log(|x| + epsilon) of features; missing and infinite values are 0) and score_qnorm.

    score_qnorm maps the score's quantile to the reference; where the gate does not hold it is 0.
    """
    clean = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c))
    total = reduce(lambda a, b: a + b, (F.log(F.abs(clean(c)) + epsilon) * w for c, w in weights.items()), F.lit(float(intercept)))
    scored = quantiles(df.withColumn("score", 1 / (1 + F.exp(-total))), "score", "_q")
    q = interpolated(F.col("_q"), reference)
    return scored.withColumn("score_qnorm", F.when(gate, q).otherwise(0.0) if gate is not None else q).drop("_q")


def ld_summary(proxies: DataFrame) -> DataFrame:
    """(ancestry, bucket, n) of proxies (ancestry, r2): strong from 0.8, moderate from 0.5, weak from 0.2, else negligible."""
    r2 = F.coalesce(F.col("r2").cast("double"), F.lit(0.0))
    bucket = F.when(r2 >= 0.8, "strong").when(r2 >= 0.5, "moderate").when(r2 >= 0.2, "weak").otherwise("negligible")
    return proxies.groupBy(F.coalesce("ancestry", F.lit("unknown")).alias("ancestry"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def variant_targets(variants: DataFrame, elements: DataFrame, window: int = 1) -> DataFrame:
    """(variant, element, gene, context) of predictions (element, chr, start, end, gene, context) whose element meets a variant (variant, chr, pos) within window."""
    at = variants.select("variant", "chr", (F.col("pos") - window).alias("start"), (F.col("pos") + window).alias("end"))
    e = elements.select("element", "chr", F.col("start").alias("start_b"), F.col("end").alias("end_b"), "gene", "context")
    return overlap_join(at, e, ["chr"], 4096).select("variant", "element", "gene", "context").distinct()


def attach_labels(cells: DataFrame, labels: DataFrame, key: str, label: str, name: str = "cell_type") -> DataFrame:
    """cells (cell, ...) with a label from another table; of labels with one key the smallest counts."""
    one = labels.groupBy(F.col(key).cast("string").alias("_k")).agg(F.min(label).alias(name))
    return cells.join(one, F.col("cell").cast("string") == F.col("_k"), "left").drop("_k")


def subsample(cells: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most n cells by a hash of the cell, the same ones whatever the partitions."""
    return cells.orderBy(F.xxhash64("cell", F.lit(seed)), "cell").limit(n)


def rank_area(values: DataFrame, sets: DataFrame, n_genes: int, share: float = 0.05) -> DataFrame:
    """(cell, set, auc): area under the recovery of a set's genes among the first of each cell (cell, gene, value).

    The first are max(1, round(n_genes * share)) genes by falling value, equals by name; the area is over its largest
    value, the number of first places times the genes of the set (set, gene).
    """
    first = max(1, round(n_genes * share))
    rn = F.row_number().over(Window.partitionBy("cell").orderBy(F.col("value").desc(), "gene")) - 1
    top = values.withColumn("_r", rn).where(F.col("_r") < first)
    size = sets.select("set", "gene").distinct().groupBy("set").agg(F.count(F.lit(1)).alias("_n"))
    area = top.join(F.broadcast(sets.select("set", "gene").distinct()), "gene").groupBy("cell", "set").agg(F.sum(first - F.col("_r")).alias("_a"))
    every = values.select("cell").distinct().crossJoin(F.broadcast(size))  # a few sets
    return every.join(area, ["cell", "set"], "left").select("cell", "set", (F.coalesce("_a", F.lit(0)) / (first * F.col("_n"))).alias("auc"))


def tau(values: DataFrame, gene: str, group: str, value: str, n_groups: int) -> DataFrame:
    """(gene, tau): how much a gene is one group's, 0 to 1, over all groups, those without a row as zeros; null if none is above 0."""
    by = values.groupBy(gene).agg(F.max(value).alias("_m"), F.sum(value).alias("_s"))
    return by.select(gene, F.when((F.col("_m") > 0) & (F.lit(n_groups) > 1), (F.lit(n_groups) - F.col("_s") / F.col("_m")) / (n_groups - 1)).alias("tau"))


def running_share(df: DataFrame, order: Column, value: str) -> DataFrame:
    """df with share: the running sum of a value in an order over its total."""
    out = running(df, [], [order], {"_c": ("sum", F.col(value))})
    return out.crossJoin(F.broadcast(df.agg(F.sum(value).alias("_t")))).withColumn("share", F.col("_c") / F.col("_t")).drop("_c", "_t")
