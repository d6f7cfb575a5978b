"""Contact maps and element-gene pairs: binning, joins on bins, distances, scores and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.stats import powerlaw_contact
from lodestar.operators.ranges import overlap_join


def binned_contacts(records: DataFrame, resolution: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, bin_x, bin_y, contact) of raw records (x, y, value), by the mean row sum of the raw map.

    A bin pair has its largest value; a bin with itself has the largest of its neighbours within 5 kb, 0 without any.
    """
    keys = keys or []
    ends = records.select(*keys, F.explode(F.when(F.col("x") == F.col("y"), F.array("x")).otherwise(F.array("x", "y"))).alias("pos"), "value")
    rows = ends.groupBy(*keys, "pos").agg(F.sum("value").alias("s"))
    mean = rows.groupBy(*keys).agg(F.avg("s").alias("row_mean"))
    bins = records.groupBy(*keys, F.floor(F.col("x") / resolution).alias("bin_x"), F.floor(F.col("y") / resolution).alias("bin_y")).agg(F.max("value").alias("value"))
    reach = -(-5000 // resolution) if resolution < 5000 else 1
    off = bins.where((F.col("bin_x") < F.col("bin_y")) & (F.col("bin_y") - F.col("bin_x") <= reach))
    near = off.select(*keys, F.explode(F.array("bin_x", "bin_y")).alias("bin_x"), "value").groupBy(*keys, "bin_x").agg(F.max("value").alias("_near"))
    out = bins.join(near, [*keys, "bin_x"], "left")
    value = F.when(F.col("bin_x") == F.col("bin_y"), F.greatest(F.coalesce("_near", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("value"))
    out = out.withColumn("value", value)
    out = out.join(mean, keys) if keys else out.crossJoin(F.broadcast(mean))  # one row
    return out.select(*keys, "bin_x", "bin_y", (F.col("value") / F.col("row_mean")).alias("contact"))


def with_contacts(pairs: DataFrame, contacts: DataFrame, resolution: int, element: Column, tss: Column, keys: list[str] | None = None, oriented: bool = False) -> DataFrame:
    """pairs with contact of the bins of an element's middle and a gene's start (null where the map has none).

    oriented: the map has rows (bin of the start, bin of the element) and is not symmetric; else the smaller bin is first.
    """
    keys = keys or []
    e, t = F.floor(element / resolution), F.floor(tss / resolution)
    x, y = (t, e) if oriented else (F.least(e, t), F.greatest(e, t))
    side = contacts.select(*keys, "bin_x", "bin_y", "contact")
    return pairs.withColumns({"bin_x": x, "bin_y": y}).join(side, [*keys, "bin_x", "bin_y"], "left").drop("bin_x", "bin_y")


def contacts_of_loops(elements: DataFrame, genes: DataFrame, loops: DataFrame, bin_size: int = 65536) -> DataFrame:
    """(element_id, gene_id, contact): loops whose two anchors hold an element's middle and a gene's start, either way.

    elements (element_id, chr, pos), genes (gene_id, chr, pos), loops (loop_id, chr, start, end, chr2, start2, end2,
    contact). The two anchors are joined on the loop, so no pair of elements and genes is made beforehand.
    """
    point = lambda df, name: df.select(F.col(name), "chr", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    anchor = lambda c, s, e: loops.select("loop_id", F.col(c).alias("chr"), F.col(s).alias("start_b"), F.col(e).alias("end_b"), "contact")
    first, second = anchor("chr", "start", "end"), anchor("chr2", "start2", "end2")
    hit = lambda df, name, a: overlap_join(point(df, name), a, ["chr"], bin_size).select(name, "loop_id", "contact")
    one = hit(elements, "element_id", first).join(hit(genes, "gene_id", second).drop("contact"), "loop_id")
    two = hit(elements, "element_id", second).join(hit(genes, "gene_id", first).drop("contact"), "loop_id")
    return one.unionByName(two).select("element_id", "gene_id", "loop_id", "contact").distinct().drop("loop_id")


def replace_weak_contacts(pairs: DataFrame, gene: str, contact: str, distance: str, self_promoter: str, least: float = 0.01, resolution: int = 5000) -> DataFrame:
    """pairs in which genes whose own promoters sum to less than least contact take the power law of the distance.

    A gene without a promoter row keeps its contacts; null contacts count as none.
    """
    weak = pairs.where(self_promoter).groupBy(gene).agg(F.coalesce(F.sum(contact), F.lit(0.0)).alias("_own")).where(F.col("_own") < least).select(gene, F.lit(True).alias("_weak"))
    out = pairs.join(weak, gene, "left")
    return out.withColumn(contact, F.when(F.col("_weak"), powerlaw_contact(F.col(distance), least=resolution)).otherwise(F.col(contact))).drop("_weak")


def pair_distances(a: DataFrame, b: DataFrame, key: str, how: str, most: int) -> DataFrame:
    """(id_a, id_b, key, distance) of all pairs on one key that are no farther than most.

    a (id_a, key, start, end), b (id_b, key, start_b, end_b). how: start (between starts), midpoint, or shortest (the
    gap, 0 if they overlap). Both sides are dealt over bins as wide as the reach, so that no other pairs are made.
    """
    if how == "start":
        distance = F.abs(F.col("start") - F.col("start_b")).cast("double")
        left = a.withColumns({"_s": F.col("start") - most, "_e": F.col("start") + most + 1})
        right = b.withColumns({"_t": F.col("start_b"), "_u": F.col("start_b") + 1})
    elif how == "midpoint":
        distance = F.abs((F.col("start") + F.col("end")) / 2 - (F.col("start_b") + F.col("end_b")) / 2)
        left = a.withColumns({"_s": F.floor((F.col("start") + F.col("end")) / 2) - most - 1, "_e": F.floor((F.col("start") + F.col("end")) / 2) + most + 2})
        right = b.withColumns({"_t": F.floor((F.col("start_b") + F.col("end_b")) / 2), "_u": F.floor((F.col("start_b") + F.col("end_b")) / 2) + 1})
    elif how == "shortest":
        distance = F.greatest(F.lit(0), F.col("start_b") - F.col("end"), F.col("start") - F.col("end_b")).cast("double")
        left = a.withColumns({"_s": F.col("start") - most, "_e": F.col("end") + most + 1})
        right = b.withColumns({"_t": F.col("start_b"), "_u": F.col("end_b")})
    else:
        raise ValueError("how must be start, midpoint or shortest")
    left = left.select("id_a", key, F.col("start").alias("_as"), F.col("end").alias("_ae"), F.col("_s").alias("start"), F.col("_e").alias("end"))
    right = right.select("id_b", key, F.col("start_b").alias("_bs"), F.col("end_b").alias("_be"), F.col("_t").alias("start_b"), F.col("_u").alias("end_b"))
    met = overlap_join(left, right, [key], max(2 * most, 64)).select("id_a", "id_b", key, F.col("_as").alias("start"), F.col("_ae").alias("end"), F.col("_bs").alias("start_b"), F.col("_be").alias("end_b"))
    return met.withColumn("distance", distance).where(F.col("distance") <= most).select("id_a", "id_b", key, "distance")


def target_gene_pairs(guides: DataFrame, genes: DataFrame, limit: int) -> DataFrame:
    """(guide_id, gene_name, target, pair_type) of genes whose start is within limit of a guide's target start.

    guides (guide_id, target, chr, start), genes (gene_id, gene_name, chr, start), one row a gene name counts; versions
    of gene ids are cut off. A guide without a start has no pairs.
    """
    first = genes.groupBy("gene_name").agg(F.min(F.struct("chr", "start", "gene_id")).alias("g"))
    g = first.select(F.substring_index("g.gene_id", ".", 1).alias("id_b"), F.col("g.chr").alias("chr"), F.col("g.start").alias("start_b"), F.col("g.start").alias("end_b"))
    a = guides.where("start IS NOT NULL").select(F.struct("guide_id", "target").alias("id_a"), "chr", "start", F.col("start").alias("end"))
    pairs = pair_distances(a, g, "chr", "start", limit)
    return pairs.select("id_a.guide_id", F.col("id_b").alias("gene_name"), "id_a.target", F.lit("discovery").alias("pair_type"))


def contact_matrix(pairs: DataFrame, chrom: str, resolution: int, start: int, end: int) -> DataFrame:
    """(bin_1, bin_2, n) of the contacts of one chromosome and window, both orders of a pair of different bins."""
    inside = pairs.where((F.col("chrom1") == chrom) & (F.col("chrom2") == chrom) & F.col("pos1").between(start, end - 1) & F.col("pos2").between(start, end - 1))
    b = inside.select(F.floor((F.col("pos1") - start) / resolution).alias("a"), F.floor((F.col("pos2") - start) / resolution).alias("b"))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return b.select(F.explode(both).alias("p")).groupBy(F.col("p.a").alias("bin_1"), F.col("p.b").alias("bin_2")).agg(F.count(F.lit(1)).alias("n"))


def peak_pileup(matrix: DataFrame, anchors: DataFrame, sizes: DataFrame, flank: int) -> DataFrame:
    """(dx, dy, mean): mean of the windows about anchors (chrom, i, j) of matrix (chrom, bin_1, bin_2, value).

    Windows that leave the matrix, of sizes (chrom, n) bins, do not count; cells that the matrix has not are 0.
    """
    whole = anchors.join(F.broadcast(sizes), "chrom").where((F.col("i") >= flank) & (F.col("j") >= flank) & (F.col("i") + flank < F.col("n")) & (F.col("j") + flank < F.col("n"))).select("chrom", "i", "j")
    counted = whole.groupBy("chrom", "i", "j").agg(F.count(F.lit(1)).alias("times"))
    steps = F.sequence(F.lit(-flank), F.lit(flank))
    cells = counted.select("*", F.explode(steps).alias("dx")).select("*", F.explode(steps).alias("dy"))
    cells = cells.withColumns({"bin_1": F.col("i") + F.col("dx"), "bin_2": F.col("j") + F.col("dy")})
    sums = cells.join(matrix, ["chrom", "bin_1", "bin_2"], "left").groupBy("dx", "dy").agg(F.sum(F.col("times") * F.coalesce("value", F.lit(0.0))).alias("s"), F.sum("times").alias("t"))
    return sums.select("dx", "dy", (F.col("s") / F.col("t")).alias("mean"))
