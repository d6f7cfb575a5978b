"""Peaks, candidate elements and element-gene predictions: making them, filtering them, features and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.stats import na_poison
from lodestar.operators.ordered import down, running
from lodestar.operators.ranges import count_overlaps, islands, merge_intervals, normalised, overlap_join


def clip_to_genome(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """Intervals cut at 0 and at the length of their chromosome; one that sizes (chr, size) has not is cut at 0 only."""
    out = df.join(F.broadcast(sizes.select("chr", F.col("size").alias("_size"))), "chr", "left")
    return out.withColumns({"start": F.greatest(F.col("start"), F.lit(0)), "end": F.least("end", F.coalesce("_size", "end"))}).select(*df.columns)


def shrink(df: DataFrame, bp: int) -> DataFrame:
    """Intervals with bp cut off at both ends; what would end before it starts becomes its middle."""
    start, end, middle = F.col("start") + bp, F.col("end") - bp, F.floor((F.col("start") + F.col("end")) / 2)
    return df.select(*(F.when(start > end, middle).otherwise(start).alias("start") if c == "start" else F.when(start > end, middle).otherwise(end).alias("end") if c == "end" else F.col(f"`{c}`") for c in df.columns))


def strongest(counts: DataFrame, n: int) -> DataFrame:
    """The n merged intervals of the largest count; equals by their line of text, the last first."""
    merged = merge_intervals(counts, ["chr"], aggs={"count": F.max("count")})
    line = F.concat_ws("\t", "chr", F.col("start").cast("string"), F.col("end").cast("string"), F.col("count").cast("string"))
    return merged.orderBy(F.col("count").desc(), line.desc()).limit(n)


def candidate_regions(peaks: DataFrame, counts: DataFrame, sizes: DataFrame, n: int, extend: int = 250, block: DataFrame | None = None, include: DataFrame | None = None, use_summit: bool = True, least_width: int = 500) -> DataFrame:
    """(chr, start, end): the peaks that meet the n strongest merged intervals, extended, merged and filtered.

    peaks (chr, start, end, summit), counts (chr, start, end, count). About the summit (its place within the peak) or
    about both ends, clipped to the genome; book-ended regions merge; what meets block goes, include is added, and the
    union is merged once more.
    """
    top = strongest(counts, n).select("chr", F.col("start").alias("start_b"), F.col("end").alias("end_b"))
    sel = overlap_join(peaks, top, ["chr"], how="semi")
    if use_summit:
        at = F.col("start") + F.col("summit")
        regions = clip_to_genome(sel.select("chr", (at - extend).alias("start"), (at + extend).alias("end")), sizes)
    else:
        regions = clip_to_genome(sel.select("chr", (F.col("start") - extend).alias("start"), (F.col("end") + extend).alias("end")), sizes)
        pad = F.floor((least_width - (F.col("end") - F.col("start"))) / 2)
        short = F.col("end") - F.col("start") < least_width
        regions = regions.select("chr", F.when(short, F.greatest(F.col("start") - pad, F.lit(0))).otherwise(F.col("start")).alias("start"), F.when(short, F.col("end") + pad).otherwise(F.col("end")).alias("end"))
    regions = merge_intervals(regions, ["chr"])
    if block is not None:
        regions = overlap_join(regions, block.select("chr", F.col("start").alias("start_b"), F.col("end").alias("end_b")), ["chr"], how="anti")
    if include is not None:
        on_genome = include.join(F.broadcast(sizes), "chr").where("start >= 0 AND end <= size")
        regions = regions.unionByName(on_genome.select("chr", "start", "end"))
    return merge_intervals(regions, ["chr"])


def is_expressed(expression: Column, promoter_quantile: Column, expression_cut: float, quantile_cut: float) -> Column:
    """Expression from the cut on, or, where it is unknown (null or NaN), promoter activity from its quantile on."""
    unknown = expression.isNull() | F.isnan(expression)
    return F.when(unknown, F.coalesce(promoter_quantile >= quantile_cut, F.lit(False))).otherwise(expression >= expression_cut)


def threshold_predictions(pred: DataFrame, score: str, least: float, keep_self_promoters: bool = True, strict: bool = False) -> DataFrame:
    """Predictions from the score on (above it, if strict) that are no promoters, or a gene's own promoter.

    pred has the columns class and self_promoter. A score that is no number fails.
    """
    value = F.nanvl(F.col(score).try_cast("double"), F.lit(None).cast("double"))
    passes = (value > least) if strict else (value >= least)
    distal = F.col("class") != "promoter"
    return pred.where(F.coalesce(passes, F.lit(False)) & (distal | F.coalesce("self_promoter", F.lit(False)) if keep_self_promoters else distal))


def gene_prediction_stats(pred: DataFrame, score: str, least: float) -> DataFrame:
    """(chr, gene, tss, failed, considered, distal): per gene how many elements were considered and predicted.

    Only genes with an element that is no promoter; failed marks genes without any score.
    """
    keys = ["chr", "gene", "tss"]
    value = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    distal = F.col("class") != "promoter"
    out = pred.groupBy(*keys).agg((F.count(value) == 0).alias("failed"), F.count("name").alias("considered"), F.count_if(distal & (value > least)).alias("distal"), F.count_if(distal).alias("_distal"))
    return out.where("_distal > 0").drop("_distal")


def prediction_summary(full: DataFrame, kept: DataFrame, score: str, distance: str) -> DataFrame:
    """One row of counts and means of kept predictions that are no promoters, and of the genes of all."""
    thr = kept.where(F.col("class") != "promoter")
    per_enh = thr.groupBy("chr", "start", "end").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_enh_elements"), F.avg("n").alias("mean_genes_per_enh"), F.avg(F.col("end") - F.col("start")).alias("mean_enh_width"))
    per_gene = thr.groupBy("gene").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_genes_with_enh"), F.avg("n").alias("mean_enh_per_gene"))
    links = thr.agg(F.count(F.lit(1)).alias("n_enh_gene_links"), F.avg(distance).alias("mean_dist_to_tss"))
    genes = full.agg(F.count_distinct("gene").alias("n_genes_active_promoter"), F.count_distinct(F.when(F.col(score) == 0, F.col("gene"))).alias("n_genes_not_expressed"))
    return per_enh.crossJoin(per_gene).crossJoin(links).crossJoin(genes)  # one row each


def prediction_qc(pred: DataFrame, distance: str) -> DataFrame:
    """One row: mean, median and sd of elements per gene, genes per element and pairs per chromosome, and distances.

    Standard deviations are of the population; distances count if they are above 0.
    """
    epg = pred.groupBy("gene").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("mean_enh_per_gene"), F.median("n").alias("median_enh_per_gene"), F.stddev_pop("n").alias("sd_enh_per_gene"))
    gpe = pred.groupBy("chr", "start", "end").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_enhancers"), F.median("n").alias("median_gene_per_enh"), F.stddev_pop("n").alias("sd_gene_per_enh"))
    per_chr = pred.groupBy("chr").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("mean_pairs_per_chr"), F.median("n").alias("median_pairs_per_chr"))
    d = F.when(F.col(distance) > 0, F.col(distance))
    far = pred.agg(F.median(d).alias("median_distance"), F.avg(d).alias("mean_distance"), F.stddev_pop(d).alias("sd_distance"), F.percentile(d, 0.1).alias("p10_distance"), F.percentile(d, 0.9).alias("p90_distance"))
    return epg.crossJoin(gpe).crossJoin(per_chr).crossJoin(far)  # one row each


def tss_between(pred: DataFrame, tss_regions: DataFrame) -> DataFrame:
    """(name, gene, n) of predictions with start regions between the element's outer edge and the gene's start; n > 0.

    pred (chr, start, end, name, gene, tss, distance); the middle of an element is rounded down.
    """
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    upstream = F.col("tss") < middle
    q = pred.select("chr", "name", "gene", F.when(upstream, F.col("tss")).otherwise(F.col("start")).alias("start"), F.when(upstream, F.col("end")).otherwise(middle + F.col("distance")).alias("end"))
    return count_overlaps(q, tss_regions.select("chr", "start", "end"), ["chr"]).where("n_overlaps > 0").select("name", "gene", F.col("n_overlaps").alias("n"))


def nearby_elements(rows: DataFrame, elements: DataFrame, window: int, sizes: DataFrame | None = None, value: str = "activity") -> DataFrame:
    """(name, count, sum) of other elements that meet the window about an element's middle; count > 0.

    rows (chr, start, end, name, value): the different rows count, those of the element's own name that meet its window
    do not. elements (chr, start, end, name); windows are clipped to the genome. Counts come from running sums over end
    points, not from a join.
    """
    slim = rows.select("chr", "start", "end", "name", F.col(value).alias("w")).distinct()
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    q = elements.select("chr", "name", F.greatest(middle - window, F.lit(0)).alias("start"), (middle + window).alias("end"))
    if sizes is not None:
        q = q.join(F.broadcast(sizes.select("chr", F.col("size").alias("_size"))), "chr", "left").withColumn("end", F.least("end", F.coalesce("_size", "end"))).drop("_size")
    q = q.withColumn("_q", F.xxhash64("chr", "name", "start", "end")).distinct()
    points = slim.select("chr", F.col("start").alias("pos"), F.lit(1).alias("ord"), F.lit(1).alias("opened"), F.coalesce("w", F.lit(0.0)).alias("w_open"), F.lit(0).alias("closed"), F.lit(0.0).alias("w_closed"), F.lit(None).cast("long").alias("_q"), F.lit(0).alias("side"))
    ends = slim.select("chr", F.col("end").alias("pos"), F.lit(0).alias("ord"), F.lit(0).alias("opened"), F.lit(0.0).alias("w_open"), F.lit(1).alias("closed"), F.coalesce("w", F.lit(0.0)).alias("w_closed"), F.lit(None).cast("long").alias("_q"), F.lit(0).alias("side"))
    ask = lambda pos, rank, side: q.select("chr", F.col(pos).alias("pos"), F.lit(rank).alias("ord"), F.lit(0).alias("opened"), F.lit(0.0).alias("w_open"), F.lit(0).alias("closed"), F.lit(0.0).alias("w_closed"), "_q", F.lit(side).alias("side"))
    every = points.unionByName(ends).unionByName(ask("end", 0, 1)).unionByName(ask("start", 2, 2))
    run = running(every, ["chr"], [F.col("pos"), F.col("ord")], {c: ("sum", F.col(v)) for c, v in (("n_open", "opened"), ("s_open", "w_open"), ("n_closed", "closed"), ("s_closed", "w_closed"))}).where("_q IS NOT NULL")
    sign = lambda o, c: F.sum(F.when(F.col("side") == 1, F.col(o)).otherwise(-F.col(c)))
    counted = run.groupBy("_q").agg(sign("n_open", "n_closed").alias("n"), sign("s_open", "s_closed").alias("s"))
    own = q.join(slim.toDF("_chr", "_start", "_end", "name", "w"), "name").where("chr = _chr AND _start < end AND _end > start").groupBy("_q").agg(F.count(F.lit(1)).alias("own_n"), F.sum(F.coalesce("w", F.lit(0.0))).alias("own_s"))
    out = q.join(counted, "_q").join(own, "_q", "left").select("name", (F.col("n") - F.coalesce("own_n", F.lit(0))).alias("n"), (F.col("s") - F.coalesce("own_s", F.lit(0.0))).alias("s"))
    return out.where("n > 0").groupBy("name").agg(F.sum("n").alias("count"), F.sum("s").alias("sum"))


def add_features(base: DataFrame, features: DataFrame, columns: dict[str, str], by: str = "overlap", fill: dict[str, float] | None = None) -> DataFrame:
    """base with feature columns joined by overlap (within chr and gene, closed ends) or by gene alone.

    columns maps a feature column to its aggregate (max, min, mean, sum, median); by overlap a null or NaN in a group
    makes the aggregate null. What finds nothing is null, or the value that fill names.
    """
    if by == "gene":
        out = base.join(features.select("gene", *columns), "gene", "left")
    elif by == "overlap":
        keyed = base.withColumn("_key", F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in base.columns)))
        left = keyed.select("_key", "chr", "gene", "start", "end").distinct()
        right = features.select("chr", "gene", F.col("start").alias("start_b"), F.col("end").alias("end_b"), *columns)
        met = overlap_join(left, right, ["chr", "gene"], closed=True).groupBy("_key").agg(*(na_poison(c, how).alias(c) for c, how in columns.items()))
        out = keyed.join(met, "_key", "left").drop("_key")
    else:
        raise ValueError("by must be overlap or gene")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (fill or {}).items()}) if fill else out


def fill_values(features: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the mean of the finite values of each column, which stands in for missing ones."""
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    return features.agg(*(F.avg(finite(c)).alias(c) for c in columns))


def integrate_correlation(pairs: DataFrame, correlations: DataFrame, score: str) -> DataFrame:
    """pairs with correlation (the largest that overlaps, closed ends, within chr and gene) and the integrated arc score.

    Where the score is above 0 and a correlation is known, arc = exp(ln s + c * sd(ln s) / sd(c) * r) over at least three
    such rows, else arc is the score.
    """
    with_c = add_features(pairs, correlations.where("correlation IS NOT NULL"), {"correlation": "max"})
    ok = (F.col(score) > 0) & F.col("correlation").isNotNull() & (F.col(score) < float("inf"))
    ln, c = F.when(ok, F.log(score)), F.when(ok, F.col("correlation"))
    fit = with_c.agg(F.count_if(ok).alias("_n"), F.stddev_samp(ln).alias("_sl"), F.stddev_samp(c).alias("_sc"), F.corr(ln, c).alias("_r"))
    use = ok & (F.col("_n") >= 3) & (F.col("_sl") > 0) & (F.col("_sc") > 0)
    out = with_c.crossJoin(F.broadcast(fit))  # one row
    arc = F.when(use, F.exp(F.log(score) + F.col("correlation") * F.col("_sl") / F.col("_sc") * F.col("_r"))).otherwise(F.col(score))
    return out.withColumn("arc", arc).drop("_n", "_sl", "_sc", "_r")


def one_to_one_names(genes: DataFrame, tss: DataFrame) -> DataFrame:
    """(ref_name, name): names of genes (ensembl_id, ref_name) in tss (ensembl_id, name), by ids that join just one pair."""
    met = tss.join(genes, "ensembl_id").where("ref_name IS NOT NULL")
    alone = met.groupBy("ensembl_id").agg(F.count(F.lit(1)).alias("n"), F.min("ref_name").alias("ref_name"), F.min("name").alias("name")).where("n = 1")
    return alone.groupBy("ref_name").agg(F.min_by("name", "ensembl_id").alias("name"))


def fragment_counts(fragments: DataFrame, peaks: DataFrame, cells: DataFrame, mode: str = "fragment", bin_size: int = 4096) -> DataFrame:
    """(peak_id, cell, n): fragments (chr, start, end, cell) or their two cut sites in peaks (peak_id, chr, start, end).

    Only the given cells count. fragment: a fragment counts once for every peak that its bases [start + 1, end] meet;
    insertion: the cut sites start + 1 and end count, peaks with closed ends.
    """
    some = fragments.join(cells.select("cell").distinct(), "cell", "left_semi")
    if mode == "fragment":
        q = some.select("cell", "chr", "start", (F.col("end") + 1).alias("end"))
        right = peaks.select("peak_id", "chr", F.col("start").alias("start_b"), F.col("end").alias("end_b"))
    elif mode == "insertion":
        site = F.explode(F.array(F.col("start") + 1, F.col("end")))
        q = some.select("cell", "chr", site.alias("start")).withColumn("end", F.col("start") + 1)
        right = peaks.select("peak_id", "chr", F.col("start").alias("start_b"), (F.col("end") + 1).alias("end_b"))
    else:
        raise ValueError("mode must be fragment or insertion")
    return overlap_join(q, right, ["chr"], bin_size).groupBy("peak_id", "cell").agg(F.count(F.lit(1)).alias("n"))


def tags_of_fragments(fragments: DataFrame, chroms: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(chr, ord, start, end, strand), two tags a fragment on known chromosomes (chr, ord), in genome order."""
    from lodestar.sources.readers import fragments_to_tags

    some = fragments.join(cells.select("cell").distinct(), "cell", "left_semi") if cells is not None else fragments
    return fragments_to_tags(some).join(F.broadcast(chroms), "chr").orderBy("ord", "start", "end", "strand")


def choose_cells(cells: DataFrame, barcodes: DataFrame, most: int, seed: int = 123) -> DataFrame:
    """At most so many of the cells that have fragments, by a hash of the cell: the same ones whatever the partitions."""
    both = cells.select("cell").distinct().join(barcodes.select("cell").distinct(), "cell", "left_semi")
    return both.orderBy(F.xxhash64("cell", F.lit(seed)), "cell").limit(most)


def element_gene_lists(genes: DataFrame, pred: DataFrame, expression: DataFrame, least_tpm: float) -> DataFrame:
    """genes (name) with the flags by which the pipeline leaves them out.

    removed_by_promoter: no prediction names the gene; removed_by_tpm: expression (name, tpm) below least_tpm;
    in_matrix: expression is known; considered: none of these speaks against it.
    """
    named = pred.select(F.col("gene").alias("name")).distinct().withColumn("_pred", F.lit(True))
    out = genes.join(named, "name", "left").join(expression.select("name", "tpm"), "name", "left")
    removed, low, known = F.col("_pred").isNull(), F.coalesce(F.col("tpm") < least_tpm, F.lit(False)), F.col("tpm").isNotNull()
    return out.withColumns({"removed_by_promoter": removed, "removed_by_tpm": low, "in_matrix": known, "considered": ~removed & ~low & known}).drop("_pred")


def nearest_elements(regions: DataFrame, elements: DataFrame) -> DataFrame:
    """(region_id, distance, element_id, class) of the nearest of the three elements about a region's start, by start.

    regions (region_id, chr, start, end), elements (element_id, chr, start, end, class). Distance 0 if they overlap, else
    the gap. The elements are the last one that starts before the region, and the two that follow; of equally near ones
    the first in this order counts. A region on a chromosome without elements is left out.
    """
    one = F.struct("start", "end", "element_id", "class")
    placed = elements.where("chr IS NOT NULL").select("chr", "start", "end", "element_id", one.alias("e"))
    following = running(placed, ["chr"], [down("start"), down("end"), down("element_id")], {"second": ("min", F.col("e"))}, before=True)
    both = following.select("chr", "start", "end", F.lit(1).alias("ord"), F.lit(None).cast(regions.schema["region_id"].dataType).alias("region_id"), F.struct("e", "second").alias("pair"))
    both = both.unionByName(regions.where("chr IS NOT NULL").select("chr", "start", "end", F.lit(0).alias("ord"), "region_id", F.lit(None).cast(both.schema["pair"].dataType).alias("pair")))
    # at equal starts the region stands before the elements: they follow it
    back = running(both, ["chr"], [F.col("start"), F.col("ord")], {"prev": ("max", F.col("pair.e"))})
    found = running(back, ["chr"], [down("start"), down("ord")], {"nxt": ("min", F.col("pair"))}).where("ord = 0")
    found = found.select("region_id", "start", "end", "prev", F.col("nxt.e").alias("nxt"), F.col("nxt.second").alias("second"))
    gap = lambda e: F.when((e["start"] < F.col("end")) & (e["end"] > F.col("start")), 0).otherwise(F.greatest(F.when(e["start"] >= F.col("end"), e["start"] - F.col("end")).otherwise(F.col("start") - e["end"]), F.lit(0)))
    option = lambda c, k: F.when(F.col(c).isNotNull(), F.struct(gap(F.col(c)).cast("long").alias("distance"), F.lit(k).alias("k"), F.col(f"{c}.element_id").alias("element_id"), F.col(f"{c}.class").alias("class")))
    best = F.array_min(F.array_compact(F.array(option("prev", 0), option("nxt", 1), option("second", 2))))
    return found.select("region_id", best.alias("b")).where("b IS NOT NULL").select("region_id", "b.distance", "b.element_id", "b.class")


def stitched(df: DataFrame, gap: int, tss: DataFrame | None = None, tss_reach: int = 2000) -> DataFrame:
    """(chr, start, end, score_sum, n_peaks) of peaks no farther apart than gap, those near a start (chr, pos) left out.

    A peak is near if its middle, rounded down, is within tss_reach of a start, that included.
    """
    peaks = normalised(df)
    if tss is not None:
        middle = F.floor((F.col("start") + F.col("end")) / 2)
        zones = tss.select("chr", (F.col("pos") - tss_reach).alias("start_b"), (F.col("pos") + tss_reach).alias("end_b"))
        at = peaks.withColumns({"_s": F.col("start"), "_e": F.col("end"), "start": middle, "end": middle})
        peaks = overlap_join(at, zones, ["chr"], max(2 * tss_reach, 64), closed=True, how="anti").withColumns({"start": F.col("_s"), "end": F.col("_e")}).drop("_s", "_e")
    return islands(peaks, ["chr"], gap).groupBy("chr", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("score").alias("score_sum"), F.count(F.lit(1)).alias("n_peaks")).drop("island")
