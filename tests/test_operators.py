"""Operators against brute force on small planted inputs."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import dsl, sequences, stats
from lodestar.operators import graph, models, ranges
from lodestar.sources import mirror, readers, writers
from lodestar.streaming import jobs


def intervals(rng, n, shift=""):
    return [(k, rng.choice("ab"), s := rng.randint(-50, 300), s + rng.randint(0, 40)) for k in range(n)]


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("size", [8, 64])
def test_overlap_join(spark, closed, size):
    rng = random.Random(size)
    a, b = intervals(rng, 60), intervals(rng, 60)
    got = ranges.overlap_join(spark.createDataFrame(a, "i long, k string, start long, end long"), spark.createDataFrame(b, "j long, k string, start_b long, end_b long"), ["k"], size, closed)
    widen = 0 if closed else 1
    hit = lambda x, y: x[1] == y[1] and (x[2] <= y[3] and x[3] >= y[2] if closed else x[2] < max(y[3], y[2] + widen) and max(x[3], x[2] + widen) > y[2])
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((x[0], y[0]) for x in a for y in b if hit(x, y))


def test_overlap_how(spark):
    a = spark.createDataFrame([(1, "a", 0, 10), (1, "a", 0, 10), (2, "a", 50, 50), (3, "b", 0, 5)], "i long, k string, start long, end long")
    b = spark.createDataFrame([(7, "a", 5, 60)], "j long, k string, start_b long, end_b long")
    ids = lambda how: sorted(r.i for r in ranges.overlap_join(a, b, ["k"], 16, how=how).collect())
    assert ids("semi") == [1, 1, 2] and ids("anti") == [3] and ids("left") == [1, 1, 2, 3]


def test_count_overlaps(spark):
    rng = random.Random(3)
    a = [(k, c, s, max(e, s + 1)) for k, c, s, e in intervals(rng, 80)]
    df = spark.createDataFrame(a, "i long, k string, start long, end long")
    got = {r.i: r.n_overlaps for r in ranges.count_overlaps(df, df, ["k"]).collect()}
    assert got == {x[0]: sum(x[1] == y[1] and x[2] < y[3] and x[3] > y[2] for y in a) for x in a}


def test_merge_bookended_and_gap(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 8), ("a", 10, 12), ("b", 1, 3)], "k string, start long, end long")
    assert sorted(map(tuple, ranges.merge_intervals(df, ["k"]).collect())) == [("a", 0, 8), ("a", 10, 12), ("b", 1, 3)]
    assert sorted(map(tuple, ranges.merge_intervals(df, ["k"], 2).collect())) == [("a", 0, 12), ("b", 1, 3)]
    assert dict(map(tuple, ranges.covered_bases(df, ["k"]).collect())) == {"a": 10, "b": 2}


def test_components_chain_star_and_loop(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(5, k) for k in range(200, 260)]
    df = spark.createDataFrame([*chain, *star, (9, 9), (300, None)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(df).collect()}
    assert {got[k] for k in range(100, 161)} == {100} and {got[k] for k in [5, *range(200, 260)]} == {5} and got[9] == 9 and 300 not in got
    assert graph.connected_components(df.limit(0)).count() == 0


def test_breadth_first(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "a long, b long")
    assert sorted(map(tuple, graph.breadth_first(e, e.select(F.lit(1).cast("long").alias("node")).limit(1), 2).collect())) == [(1, 0), (2, 1), (3, 2)]


def test_dsl(spark):
    df = spark.createDataFrame([("5", 1.0), ("x", 2.0), (None, 3.0), ("7", 9.0)], "a string, log10pvalue double")
    assert df.where(dsl.where_column("a>=5")).count() == 2 and df.where(dsl.where_column("a!=5")).count() == 1
    assert df.where(dsl.filter_column("a=5,7;p_value=lt:0.001")).count() == 1 and df.where(dsl.filter_column("a!=x")).count() == 2
    with pytest.raises(ValueError):
        dsl.conditions("a")


def test_bh_and_average_rank(spark):
    p = [0.01, 0.04, 0.03, None, 0.5]
    df = spark.createDataFrame(list(enumerate(p)), "i long, p double")
    got = {r.i: r.q for r in stats.benjamini_hochberg(df, [], "p", ["i"]).collect()}
    assert got[3] is None and [round(got[k], 6) for k in (0, 1, 2, 4)] == [0.04, 0.053333, 0.053333, 0.5]
    r = {x.i: x.avg_rank for x in stats.average_rank(spark.createDataFrame([(0, 1), (1, 1), (2, 5)], "i long, v long"), [], "v").collect()}
    assert r == {0: 1.5, 1: 1.5, 2: 3.0}


def test_sequences(spark):
    lib = spark.createDataFrame([("AAAA",), ("AAAT",), ("GGGG",)], "entry string")
    reads = spark.createDataFrame([(1, "AAAA"), (2, "GGGC"), (3, "AAAC"), (4, "TTTT")], "id long, rd string")
    assert sorted((r.id, r.entry, r.distance) for r in sequences.hamming1_join(reads, lib, "rd", "entry", "ACGT").collect()) == [(1, "AAAA", 0), (2, "GGGG", 1)]
    one = spark.createDataFrame([("aabbbbc",), ("",)], "t string").select(sequences.longest_run(F.col("t")).alias("r"), F.size(sequences.kmers(F.col("t"), 3)).alias("n"))
    assert [tuple(r) for r in one.collect()] == [(4, 5), (0, 0)]


def test_models(spark):
    rng = random.Random(1)
    rows = [("g", float(k % 5), rng.randint(0, 3) + k % 5) for k in range(200)]
    fit = models.poisson_glm(spark.createDataFrame(rows, "k string, x double, y long"), "k", "y", "x").first()
    assert 0.1 < fit.slope < 0.6 and fit.se > 0
    t = models.moderated_t(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0)], "k string, v double"), ["k"], "v", 0.1).orderBy("k").collect()
    assert round(t[0].p, 4) == 0.0742 and t[1].p == 1.0


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track x\n#c\nchr1\t5\t9\tn\n\nchr2\t1\tx\tm\n")
    assert [tuple(r) for r in readers.read_bed(spark, str(tmp_path / "a.bed"), ["name"]).collect()] == [("chr1", 5, 9, "n"), ("chr2", 1, None, "m")]
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n2 2 2\n1 1 3\n2 2 4.5\n")
    assert sorted(tuple(r) for r in readers.read_matrix_market(spark, str(tmp_path / "m.mtx")).collect()) == [(1, 1, 3.0), (2, 2, 4.5)]
    (tmp_path / "g.gct").write_text("#1.2\n1\t2\nName\tDescription\tLiver\tLung\nE1\tG1\t1.5\t2\n")
    assert sorted(tuple(r) for r in readers.read_gct(spark, str(tmp_path / "g.gct")).collect()) == [("E1", "G1", "Liver", 1.5), ("E1", "G1", "Lung", 2.0)]
    writers.write_table(spark.range(5).selectExpr("id", "id AS x"), str(tmp_path / "s1"))
    writers.write_table(spark.range(2).selectExpr("id", "'q' AS x", "1.5D AS y"), str(tmp_path / "s2"))
    both = mirror.union_shards(spark, [str(tmp_path / "s1"), str(tmp_path / "s2")])
    assert dict(both.dtypes) == {"id": "bigint", "x": "string", "y": "double"} and both.count() == 7
    assert writers.unseen(spark.range(5), spark.range(3), ["id"]).count() == 2


def test_stream_ingests_once(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    for n in (3, 4):
        spark.range(n).write.mode("append").parquet(src)
        jobs.ingest_once(jobs.file_stream(spark, src, spark.range(1).schema), out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 7
