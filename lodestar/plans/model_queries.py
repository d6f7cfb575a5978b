"""Model fitting per group, and p values that SQL cannot express."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import glm, matrices, models
from lodestar.plans.registry import query
from lodestar.session import table


@query("kendall_tau_b", """
WITH e AS (SELECT user_id AS k, CAST(floor(value / 10) AS INT) AS x, CAST(event_type = 'view' AS INT) AS y FROM events),
p AS (SELECT a.k, sum(sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s, sum(CAST(a.x <> b.x AS INT)) / 2 AS nx, sum(CAST(a.y <> b.y AS INT)) / 2 AS ny FROM e a JOIN e b ON a.k = b.k GROUP BY a.k)
SELECT k AS user_id, round(s / sqrt(nx * ny), 6) AS tau FROM p""")
def kendall_tau_b(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.floor(F.col("value") / 10).alias("x"), (F.col("event_type") == "view").alias("y"))
    return models.kendall_tau_b(e, ["user_id"], "x", "y").select("user_id", F.round("tau", 6).alias("tau"))


@query("mixture_assignment")
def mixture_assignment(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("umi"))
    h = c.groupBy("event_type", "umi").agg(F.count(F.lit(1)).alias("n"))
    return models.mixture_thresholds(h, "event_type", "umi", "n")


@query("poisson_glm_per_group")
def poisson_glm_per_group(spark, sf_dir):
    return models.poisson_glm(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_discount")


@query("logistic_leave_one_out")
def logistic_leave_one_out(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_quantity") > 25).alias("y"), "l_extendedprice", "l_discount", "l_tax")
    return models.leave_one_out_logistic(x, "l_returnflag", "y", ["l_extendedprice", "l_discount", "l_tax"]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


@query("hypergeometric_enrichment")
def hypergeometric_enrichment(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    tot = x.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 40).alias("k"))
    g = x.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("l_quantity") > 40).alias("x")).crossJoin(F.broadcast(tot))
    return g.select("l_suppkey", "x", models.hypergeometric_tail(*(F.col(c).cast("double") for c in ("x", "n", "k", "m"))).alias("p"))


@query("moderated_t_per_group")
def moderated_t_per_group(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_partkey", (F.log2("l_quantity") - 4.5).alias("v"))
    return models.moderated_t(x, ["l_partkey"], "v", 0.5)


@query("nb_regression")  # fits have no SQL; a test checks that they solve the score equations
def nb_regression(spark, sf_dir):
    """Counts of lines per order by priority group, on two covariates, with a size by maximum likelihood."""
    x = table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_totalprice") / 1000).cast("int").alias("y"), F.substring("o_orderpriority", 1, 1).cast("double").alias("level"), (F.col("o_custkey") % 2).cast("double").alias("odd"))
    return glm.nb_glm(x, ["o_orderstatus"], "y", ["level", "odd"])


@query("likelihood_ratio_per_group")
def likelihood_ratio_per_group(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") % 9).cast("int").alias("y"), (F.col("l_linestatus") == "F").cast("double").alias("x"), "l_tax")
    return glm.likelihood_ratio(x, ["l_returnflag"], "y", "x", ["l_tax"])


@query("guide_mixture_calls")
def guide_mixture_calls(spark, sf_dir):
    umi = F.sum(F.when(F.col("l_partkey") % 7 == 0, F.col("l_quantity")).otherwise(F.col("l_quantity") % 3)).cast("long")
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("guide"), F.col("l_orderkey").alias("cell")).agg(umi.alias("umi"), F.log(F.count(F.lit(1)) + 1.0).alias("depth"))
    return glm.poisson_mixture(c, "guide", "cell", "umi", ["depth"])


@query("tag_calls")
def tag_calls(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg((F.count(F.lit(1)) - 1).alias("n"))
    return matrices.tag_calls(c, "event_type", "user_id", "n")


@query("bootstrap_interval", "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, true AS inside FROM lineitem GROUP BY l_returnflag")
def bootstrap_interval(spark, sf_dir):
    """The interval has no SQL; that the mean is inside has."""
    b = glm.bootstrap(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 60)
    return b.select("l_returnflag", "n", F.round("mean", 6).alias("mean"), ((F.col("low") < F.col("mean")) & (F.col("mean") < F.col("high"))).alias("inside"))


@query("copy_states")
def copy_states(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("chrom"), F.floor(F.col("l_partkey") / 10).alias("bin")).agg((F.avg("l_quantity") / 12).alias("ratio"))
    return matrices.copy_states(t, "chrom", [0.0, 1.0, 2.0, 3.0, 4.0])


@query("compartment_track")
def compartment_track(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS chrom", "least(l_partkey % 30, l_suppkey % 30) AS bin_1", "greatest(l_partkey % 30, l_suppkey % 30) AS bin_2").groupBy("chrom", "bin_1", "bin_2").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return matrices.compartment_track(c, "chrom", 30)


@query("imputed_contacts")
def imputed_contacts(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS chrom", "least(l_partkey % 30, l_suppkey % 30) AS bin_1", "greatest(l_partkey % 30, l_suppkey % 30) AS bin_2").groupBy("chrom", "bin_1", "bin_2").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return matrices.impute_contacts(c, "chrom", 30)


@query("tiled_deconvolution")
def tiled_deconvolution(spark, sf_dir):
    g = table(spark, sf_dir, "supplier").selectExpr("s_nationkey % 3 AS region", "CAST(s_suppkey * 12 AS DOUBLE) AS position", "s_acctbal / 1000 AS score")
    return matrices.deconvolve(g, "region", 30.0, 0.5, 20)


@query("pseudobulk_de")
def pseudobulk_de(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("sample"), F.col("l_linestatus").alias("grp")).agg(F.sum("l_quantity").alias("n"))
    size = x.groupBy("sample", "grp").agg(F.sum("n").alias("size"))
    mean = size.agg(F.avg("size").alias("_m"))
    sized = size.crossJoin(F.broadcast(mean)).select("sample", "grp", (F.col("size") / F.col("_m")).alias("size"))
    return glm.pseudobulk_de(x.join(sized, ["sample", "grp"]), "gene", "grp", "F", "O", "n", "size")
