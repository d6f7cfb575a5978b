"""What SQL cannot say: special functions, fits, order operators, readers, the mirror, the warehouse and flows."""

import datetime
import itertools
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar import flow, warehouse
from lodestar.functions import dsl, numeric, text
from lodestar.operators import glm, kg, matrices, models, ordered, peaks, ranges, screens
from lodestar.plans import registry
from lodestar.sources import mirror, readers, writers


def test_special_functions():
    x = np.array([0.1, 0.5, 1.0, 2.5, 7.0, 30.0])
    assert np.allclose(numeric.log_gamma(x), [math.lgamma(v) for v in x], atol=1e-10)
    h = 1e-5
    assert np.allclose(numeric.digamma(x), (numeric.log_gamma(x + h) - numeric.log_gamma(x - h)) / (2 * h), rtol=1e-5)
    assert np.allclose(numeric.trigamma(x), (numeric.digamma(x + h) - numeric.digamma(x - h)) / (2 * h), rtol=1e-4)
    for n, k, p in ((5, 2, 0.3), (20, 15, 0.8), (50, 1, 0.02)):  # P(at least k of n) is an incomplete beta function
        assert np.isclose(numeric.beta_share(k, n - k + 1, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))
    for args in ((3, 20, 8, 9), (0, 50, 5, 10), (7, 20, 8, 9), (-1, 9, 3, 3), (8, 20, 8, 9)):
        big, n, k, m = args
        want = sum(math.comb(k, i) * math.comb(n - k, m - i) for i in range(max(big + 1, 0), min(k, m) + 1) if m - i <= n - k) / math.comb(n, m)
        assert np.isclose(numeric.hypergeometric_sf(*args), want)


def test_rank_sum_exact_and_normal():
    rng = random.Random(1)
    for _ in range(10):
        n1, n2 = rng.randint(1, 4), rng.randint(1, 4)
        us = [sum(a > b for a in c for b in range(n1 + n2) if b not in c) for c in itertools.combinations(range(n1 + n2), n1)]
        for u in set(us):
            above, below = sum(v >= u for v in us) / len(us), sum(v <= u for v in us) / len(us)
            assert np.isclose(numeric.rank_sum_p(u, n1, n2, 0), min(1, 2 * min(above, below))) and np.isclose(numeric.rank_sum_p(u, n1, n2, 0, "right"), above)
    assert numeric.rank_sum_p(8, 4, 4, 8**3 - 8) == 1.0 and 0.9 < numeric.rank_sum_p(50, 10, 10, 6) <= 1


def test_element_scores_p_values(spark):
    rng = random.Random(4)
    guides = [(e, float(rng.randint(0, 12))) for e in ("a", "b") for _ in range(6)]
    ctrl = [float(rng.randint(3, 15)) for _ in range(20)]
    got = {r.element: r for r in screens.element_scores(spark.createDataFrame(guides, "element string, score double"), spark.createDataFrame([(c,) for c in ctrl], "score double")).collect()}
    for e in ("a", "b"):
        own = [s for k, s in guides if k == e]
        u = sum((a > b) + 0.5 * (a == b) for a in own for b in ctrl)
        ties = sum(t**3 - t for t in (([*own, *ctrl]).count(v) for v in {*own, *ctrl}))
        assert got[e].u == u and np.isclose(got[e].p_u, numeric.rank_sum_p(u, 6, 20, ties))


def test_robust_rank(spark):
    ranks = [("a", 0.01), ("a", 0.2), ("a", 0.9), ("b", 0.5), ("b", 0.6), ("c", None)]
    got = {r.g: r.rho for r in screens.robust_rank(spark.createDataFrame(ranks, "g string, r double"), "g", "r").collect()}
    at_least = lambda x, i, n: sum(math.comb(n, k) * x**k * (1 - x) ** (n - k) for k in range(i, n + 1))
    assert np.isclose(got["a"], min(at_least(0.01, 1, 3), at_least(0.2, 2, 3))) and np.isclose(got["b"], at_least(0.5, 1, 2)) and "c" not in got


def test_running_over_one_key_and_null_keys(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "a", "a", None]), rng.randint(0, 20), rng.randint(-5, 5)) for k in range(300)]
    df = spark.createDataFrame(rows, "i long, k string, o long, v long")
    got = ordered.running(df, ["k"], [ordered.down("o"), F.col("i")], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, before=True)
    for r in got.collect():
        seen = [x[3] for x in rows if x[1] == r.k and (-x[2], x[0]) < (-r.o, r.i)]
        assert r.s == sum(seen) and r.m == max(seen, default=None)
    plan = ordered.running(df, [], [F.col("o")], {"s": ("sum", F.col("v"))})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1  # what is handed on: a row a partition
    assert ordered.running(df.limit(0), [], [F.col("o")], {"s": ("sum", F.col("v"))}).count() == 0


def test_nearest_by_brute_force(spark):
    rng = random.Random(9)
    a = [(k, "c", rng.randint(0, 400)) for k in range(60)] + [(99, "other", 5)]
    b = [("c", s := rng.randint(0, 400), s + rng.randint(1, 30)) for _ in range(12)]
    got = {r.id: r.distance for r in ranges.nearest(spark.createDataFrame(a, "id long, k string, pos long"), spark.createDataFrame(b, "k string, start long, end long"), ["k"]).collect()}
    gap = lambda p, s, e: 0 if s <= p < e else p - e if e <= p else s - (p + 1)
    assert got == {k: min((gap(p, s, e) for _, s, e in b), default=None) if c == "c" else None for k, c, p in a}


def test_negative_binomial_solves_its_equations(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, 400).astype(float)
    y = rng.negative_binomial(3, 3 / (3 + np.exp(0.5 + 0.8 * x))).astype(float)
    one = np.ones(400)
    design = np.column_stack([one, x])
    beta, mu, cov = glm.nb_fit(y, design, one, np.zeros(400), 3.0)
    assert np.abs(design.T @ ((y - mu) / (1 + mu / 3.0))).max() < 1e-4 and abs(beta[1] - 0.8) < 0.3
    theta = glm.theta_ml(y, mu, one)
    top = max(np.linspace(0.3, 20, 4000), key=lambda t: glm.nb_loglik(y, mu, t))
    assert abs(theta - top) < 0.02 * top + 0.01
    df = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(x, y, strict=True)], "k string, x double, y int")
    rows = {r.term: r for r in glm.nb_glm(df, ["k"], "y", ["x"]).collect()}
    assert abs(rows["x"].beta - 0.8) < 0.3 and rows["x"].se > 0 and rows["x"].n == 400
    lr = glm.likelihood_ratio(df, ["k"], "y", "x", []).first()
    assert lr.p < 1e-4 and abs(lr.beta - rows["x"].beta) < 0.1 and np.isclose(lr.fold, math.exp(lr.beta))


def test_poisson_mixture_finds_planted_cells(spark):
    rng = np.random.default_rng(5)
    rows = [("g", k, int(rng.poisson(0.3)) if k >= 20 else int(rng.poisson(12)) + 1, 1.0) for k in range(300)] + [("few", k, 7 if k < 2 else 0, 1.0) for k in range(30)]
    got = glm.poisson_mixture(spark.createDataFrame(rows, "g string, cell long, n long, z double"), "g", "cell", "n", []).collect()
    assert len({r.cell for r in got if r.g == "g"} & set(range(20))) >= 17 and max(r.cell for r in got if r.g == "g") < 25
    assert sorted((r.cell, r.method) for r in got if r.g == "few") == [(0, "backup"), (1, "backup")]


def test_selection_and_permutation(spark):
    worth = {"a": 1.0, "b": 3.0, "c": 2.0}
    score = lambda fs: sum(worth[f] for f in fs)
    assert glm.forward_selection(score, ["a", "b", "c"]) == [("b", 3.0), ("c", 5.0), ("a", 6.0)]
    assert glm.backward_selection(score, ["a", "b", "c"]) == [("None", 6.0), ("a", 5.0), ("c", 3.0), ("b", None)]
    assert glm.forward_selection(lambda fs: 0.0, ["x", "y"])[0][0] == "y"
    rng = random.Random(6)
    rows = [(f"f{k % 2}", rng.random(), x := rng.random(), int(x > 0.5)) for k in range(200)]
    out = glm.permutation_importance(spark.createDataFrame(rows, "fold string, noise double, signal double, y int"), "fold", "y", ["noise", "signal"], 1)
    loss = {f: v for f, _, v in out}
    assert loss["signal"] > 0.2 > abs(loss["noise"])


def test_principal_components(spark):
    x = np.random.default_rng(3).normal(size=(200, 4)) * [5, 1, 3, 0.1] + 2
    parts, variance = glm.principal_components(spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(3), "v", 2)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(variance, values[::-1][:2]) and np.allclose(np.abs((parts * vectors[:, ::-1][:, :2]).sum(axis=0)), 1)


def test_matrix_maths():
    rng = np.random.default_rng(1)
    m = rng.poisson(2, (8, 8)).astype(float)
    m = m + m.T
    q = matrices.imputed(m, rounds=200, tolerance=1e-12)
    wide = np.pad(m, 1)
    s = sum(wide[a : a + 8, b : b + 8] for a in range(3) for b in range(3))
    exact = 0.5 * np.linalg.inv(np.eye(8) - 0.5 * s / s.sum(axis=1, keepdims=True))
    exact = (exact + exact.T) / 2
    assert np.allclose(q, exact / exact.sum(), atol=1e-8)
    blocks = np.kron(np.array([[5.0, 1.0], [1.0, 5.0]]), np.ones((4, 4))) + rng.random((8, 8)) * 0.1
    pc = matrices.compartments(blocks + blocks.T, np.array([1.0] * 4 + [0.0] * 4))
    assert (pc[:4] > 0).all() and (pc[4:] < 0).all()
    empty = blocks.copy()
    empty[3] = empty[:, 3] = 0
    assert np.isnan(matrices.compartments(empty)[3]) and np.isnan(matrices.compartments(np.zeros((4, 4)))).all()
    states, ratio = np.array([1.0, 2.0, 3.0]), np.array([1.1, 0.9, np.nan, 2.1, 2.9, 2.0])

    def weight(path):
        w = sum(-0.5 * ((r - states[p]) / 0.5) ** 2 for r, p in zip(ratio, path, strict=True) if np.isfinite(r))
        return w + sum(math.log(0.9 if a == b else 0.05) for a, b in zip(path, path[1:], strict=False))

    best = max(itertools.product(range(3), repeat=6), key=weight)
    assert np.isclose(weight([int(v) - 1 for v in matrices.segmented(ratio, states, stay=0.9)]), weight(best))
    a, b = rng.normal(size=(20, 3)), rng.normal(size=(25, 3)) + 2
    e, null = matrices.energy_permutations(a, b, 50, 0)
    assert e > null.max() and matrices.disco([a, b]) > 1 and np.isnan(matrices.disco([a]))
    two = np.concatenate([rng.normal(0, 1, 500), rng.normal(8, 1, 500)])
    assert 2 < matrices.valley(*np.histogram(two, 64)) < 6
    spots = np.arange(0.0, 200, 4)
    beta = matrices.deconvolved(spots, np.exp(-0.5 * ((spots - 100) / 10) ** 2) * 3, np.arange(0.0, 201, 10), 10, 0.05)
    assert beta.argmax() == 10 and np.count_nonzero(beta) < 6
    assert matrices.point_ranges([0, 1, 2, 3, 4], [0, 1, 3, 3, 0], {1: 0.5, 4: 2.0}) == [(1, 1, 2), (4, 2, 4)]


def test_moderated_t_bounds(spark):
    df = spark.createDataFrame([("a", 1.0, 0.1), ("a", 2.0, 5.0), ("b", 3.0, 0.0), ("c", 4.0, 0.0), ("c", 4.0, 0.0)], "k string, v double, c double")
    by = {r.k: r for r in models.moderated_t(df, ["k"], "v", 0.0, "c").collect()}
    assert by["a"].sd_used == 5.0 and by["b"].p == 1.0 and by["b"].t == 0 and by["c"].t == 0 and by["c"].p == 1.0


def test_filter_language(spark):
    df = spark.createDataFrame([("5", 1.0), ("7", 9.0)], "a string, log10pvalue double")
    assert df.where(dsl.filter_column("a=5, 7 ,")).count() == 2 and df.where(dsl.filter_column("p_value=gt:1e-5")).count() == 1
    for bad in ("p_value=lte:0", "p_value=lte:1.5", "a"):
        with pytest.raises(ValueError):
            dsl.filter_column(bad)


def test_lcs_and_conversions(spark):
    rng = random.Random(8)

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    pairs = [("".join(rng.choices("abc", k=rng.randint(0, 8))), "".join(rng.choices("abc", k=rng.randint(0, 8)))) for _ in range(80)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == length(r.a, r.b) for r in got)
    reads = [("TTAC", "CTGC", [30, 30, 30, 30], False), ("TTAC", "CTGC", [5, 30, 30, 30], False), ("TTAC", "CTGC", [30, 30, 30, 30], True)]
    df = spark.createDataFrame(reads, "ref string, rd string, q array<int>, rev boolean").select(text.conversions(F.col("ref"), F.col("rd"), F.col("q"), F.col("rev"), 20).alias("c"))
    assert [tuple(r.c) for r in df.collect()] == [(1, 1), (0, 1), (1, 1)]
    assert text.query_terms('gene* "x" AND?') == [("gene", True), ("x", False), ("AND", False)]


def test_flatten_and_lift(spark):
    df = spark.createDataFrame([(1, ("R1", "P"), (3,))], "id int, pathway struct<_id: string, name: string>, at struct<x: int>")
    assert text.flatten_structs(df).first().asDict() == {"id": 1, "pathway__id": "R1", "pathway_name": "P", "at_x": 3}
    lifted = text.lift_nodes(df, {"pathway": "pathways"}).first()
    assert lifted.pathway == "pathways/R1" and lifted.pathway_id == "R1" and lifted.pathway_name == "P" and lifted["at"].x == 3


def test_chosen_cells_do_not_depend_on_order(spark):
    cells = spark.range(200).select(F.col("id").alias("cell"))
    one = {r.cell for r in peaks.choose_cells(cells, cells, 30).collect()}
    assert len(one) == 30 and one == {r.cell for r in peaks.choose_cells(cells.orderBy(F.col("cell").desc()).repartition(7), cells, 30).collect()}


def test_readers_keep_lines_that_equal_the_head(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n% c\n3 3 3\n1 1 2\n3 3 3\n3 3 3\n")
    assert sorted(tuple(r) for r in readers.read_matrix_market(spark, str(tmp_path / "m.mtx")).collect()) == [(1, 1, 2.0), (3, 3, 3.0), (3, 3, 3.0)]
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "a.tsv").write_text("## note\n#x\ty\nx\ty\n1\t2\n")
    (folder / "b.tsv").write_text("#x\ty\n3\t4\n")
    got = readers.read_tsv(spark, str(folder))
    assert got.columns == ["x", "y"] and sorted(tuple(r) for r in got.collect()) == [("1", "2"), ("3", "4"), ("x", "y")]
    (tmp_path / "p.tsv").write_text("x\ty\nx\ty\n1\t2\n")
    assert sorted(tuple(r) for r in readers.read_tsv(spark, str(tmp_path / "p.tsv")).collect()) == [("1", "2"), ("x", "y")]


def test_other_readers(spark, tmp_path):
    put = lambda name, body: (tmp_path / name).write_text(body) and str(tmp_path / name)
    tags = readers.fragments_to_tags(spark.createDataFrame([("c", 10, 21)], "chr string, start long, end long"))
    assert sorted(tuple(r) for r in tags.collect()) == [("c", 10, 15, "+"), ("c", 16, 21, "-")]
    assert [tuple(r) for r in readers.read_tss(spark, put("t.bed", "chr1\t10\t21\tG\t.\t+\n")).collect()] == [("chr1", 15, "G", "+")]
    assert sorted(tuple(r) for r in readers.read_dense_matrix(spark, put("d.tsv", "g\tc1\tc2\na\t0\t2\nb\t1.5\t0\n")).collect()) == [("a", "c2", 2.0), ("b", "c1", 1.5)]
    cells = readers.read_cell_matrix(spark, put("m.mtx", "%%M\n2 2 2\n1 2 5\n2 1 7\n"), put("b.txt", "c1\nc2\n"), put("f.txt", "g1\tx\ng2\ty\n"))
    assert sorted(tuple(r) for r in cells.collect()) == [("g1", "c2", 5.0), ("g2", "c1", 7.0)]
    pairs = readers.read_pairs(spark, put("x.pairs", "## pairs\n#columns: readID chrom1 pos1 chrom2 pos2 strand1\nr\tchr1\t5\tchr2\t9\t+\nr\tchr1\tx\tchr2\t9\t+\n"))
    assert [tuple(r) for r in pairs.collect()] == [("chr1", 5, "chr2", 9)]
    regions = readers.read_regions(spark, put("r.tsv", "Chrom\tBegin\tStop\tname\nchr1\t3\t8\tq\n"))
    assert regions.columns == ["chr", "start", "end", "name"] and tuple(regions.first()) == ("chr1", 3, 8, "q")
    mitab = "\t".join(["uniprotkb:P1", "uniprotkb:Q2-3", "", "", "", "", "two hybrid", "", "pubmed:77|x", "taxid:9606(human)", "taxid:9606", "", "", "EBI-1", "intact-miscore:0.5"])
    assert readers.read_mitab(spark, put("i.txt", f"#head\n{mitab}\n{mitab.replace('9606', '10090')}\n")).select("id_a", "id_b", "pubmed_id", "score").collect() == [("P1", "Q2-3", "77", 0.5)]
    biogrid = "#BioGRID Interaction ID\tOfficial Symbol Interactor A\tOfficial Symbol Interactor B\tOrganism Name Interactor A\tOrganism Name Interactor B\n1\tA\tB\tHomo sapiens\tHomo sapiens\n2\tA\tC\tHomo sapiens\tMus musculus\n"
    assert [(r.id_a, r.id_b, r.source_id) for r in readers.read_biogrid(spark, put("b.tab3", biogrid)).collect()] == [("A", "B", "1")]
    assert readers.recognise(["Gene", "Disease"]) == "gene_disease" and readers.recognise(["x"]) is None
    edges = readers.artefact_edges(spark.createDataFrame([("abc", "d1"), ("", "x")], "gene string, disease string"), "run")
    assert [tuple(r) for r in edges.collect()] == [("ABC", "D1", "associated_with", "run")]


def test_shard_types(spark, tmp_path):
    paths = []
    for k, df in enumerate([spark.range(2).selectExpr("id", "id AS mixed", "id + 9007199254740993 AS big", "id AS s"), spark.range(2).selectExpr("CAST(id AS INT) AS id", "0.5D AS mixed", "0.5D AS big", "'t' AS s", "true AS extra")]):
        paths.append(str(tmp_path / f"s{k}"))
        writers.write_table(df, paths[-1])
    got = mirror.union_shards(spark, paths)
    assert dict(got.dtypes) == {"id": "bigint", "mixed": "double", "big": "string", "s": "string", "extra": "boolean"}
    assert sorted(r.big for r in got.collect())[-1] == "9007199254740994" and got.where("extra IS NULL").count() == 2


def test_ranges_hold_every_key_once(spark, tmp_path):
    rng = random.Random(7)
    keys = ["".join(rng.choices("NCZ_xa", k=rng.randint(1, 4))) for _ in range(400)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i long")
    plan = mirror.plan_ranges(df, "k", 60)
    assert len(plan) > 3 and sum(n for *_, n in plan) == 400 and plan[0][0] is None and plan[-1][1] is None and all(a[1] == b[0] for a, b in zip(plan, plan[1:], strict=False))
    assert all(sum((lo is None or k.encode() >= lo.encode()) and (hi is None or k.encode() < hi.encode()) for k in keys) == n for lo, hi, n in plan)
    path = str(tmp_path / "m")
    assert set(mirror.pull(df, "k", path, 60).values()) == {"done"} and set(mirror.pull(df, "k", path, 60).values()) == {"done"}
    assert sorted(r.i for r in spark.read.parquet(f"{path}/r*").collect()) == list(range(400))
    assert mirror.pull_range(lambda lo, hi: df, (None, None, 399), str(tmp_path / "n"), "r0") == "count_mismatch" and not (tmp_path / "n" / "r0").exists()
    calls = []

    def flaky(lo, hi):
        calls.append(1)
        return df.withColumn("x", F.raise_error(F.lit("gone"))) if len(calls) == 1 else df

    assert mirror.pull_range(flaky, (None, None, 400), str(tmp_path / "o"), "r0") == "done" and len(calls) == 2


def test_warehouse(spark, tmp_path):
    names = {n: warehouse.TABLES[n] for n in ("genes", "runs", "edges")}
    w = warehouse.Warehouse(spark, str(tmp_path / "w"), tables=names)
    assert w.init() == w.init() == ["edges", "genes", "runs"]
    w.upsert("genes", spark.createDataFrame([("g1", "A"), ("g2", "B")], "gene_id string, symbol string"))
    w.upsert("genes", spark.createDataFrame([("g2", "C"), ("g3", "D")], "gene_id string, symbol string"))
    w.upsert("genes", spark.createDataFrame([("g1", "Z")], "gene_id string, symbol string"), replace=False)
    run = w.record_run("kg", "all nodes", {"b": 1, "a": 2}, 3, "genes", True, datetime.datetime(2024, 1, 2, 3, 4, 5, 6))
    assert run == "20240102_030405_000006_kg_all_nodes_genes" and w.last_runs().first().args == '{"a": 2, "b": 1}'
    reader = warehouse.Warehouse(spark, str(tmp_path / "w"), read_only=True, tables=names)
    assert [tuple(r) for r in reader.query("SELECT gene_id, symbol FROM genes ORDER BY gene_id").collect()] == [("g1", "A"), ("g2", "C"), ("g3", "D")]
    assert reader.query("WITH x AS (SELECT 'drop table' AS t) SELECT * FROM x", 1).count() == 1 and {r.table_name: r.n for r in reader.row_counts().collect()} == {"edges": 0, "genes": 3, "runs": 1}
    for bad in ("DROP TABLE genes", "SELECT 1; DROP TABLE genes", "/* SELECT */ insert into genes values (1)", "WITH x AS (SELECT 1) INSERT INTO genes SELECT * FROM x", ""):
        with pytest.raises(ValueError):
            reader.query(bad)
    with pytest.raises(PermissionError):
        reader.upsert("genes", reader.table("genes"))
    cells = warehouse.classified_cells(spark.createDataFrame([(f"r{k}", k, f"c{k}", None, "singlet") for k in range(5)], "run string, modified int, cell string, total_tag_umi int, droplet_type string"))
    assert sorted(r.cell_id for r in cells.collect()) == ["r2:c2", "r3:c3", "r4:c4"]
    sets = warehouse.catalogue_datasets(spark.createDataFrame([("d", "", "E", ["x", "y"], "2020", 0, None), ("", "", "", [], "", 0, [])], "dataset_id string, study_title string, experiment_title string, perturbation_types array<string>, study_year string, n_perturbed int, licenses array<string>"))
    assert [(r.dataset_id, r.title, r.assay, r.year, r.n_samples, r.license) for r in sets.collect()] == [("pcat:d", "E", "x, y", 2020, None, "")]


def test_flow_and_checks(spark, tmp_path):
    tools = {"big": lambda df, least: df.where(F.col("id") >= least), "join": lambda df, other: df.join(other, "id")}
    spec = {"parameters": {"least": {"default": 3}, "name": {"default": "x"}}, "steps": [{"tool": "big", "label": "x", "input": "t", "args": {"least": "${least}"}}, {"tool": "join", "label": "y", "input": "x", "with": {"other": "t"}}]}
    frames = flow.run_flow(spec, tools, {"t": spark.range(6)}, {"least": 4})
    assert frames["y"].count() == 2
    with pytest.raises(KeyError):
        flow.run_flow({"steps": [{"tool": "no", "input": "t"}]}, tools, {"t": spark.range(1)})
    skills = tmp_path / "skills"
    skills.mkdir()
    (skills / "my_query.py").write_text("QUERIES = {'q': lambda spark, sf: spark.range(3)}\n")
    (skills / "_private.py").write_text("")
    found = flow.discover([str(tmp_path)])
    assert list(found) == ["my-query"] and flow.load(found["my-query"]).QUERIES["q"](spark, "").count() == 3
    (tmp_path / "tools").mkdir()
    (tmp_path / "tools" / "t.json").write_text('{"name": "few", "sql": "SELECT * FROM {t} WHERE id < :n"}')
    assert flow.run_tool(spark, flow.manifest_tools([str(tmp_path)])["few"], {"t": spark.range(9)}, {"n": 4}).count() == 4
    path = str(tmp_path / "out")
    spark.range(5).write.parquet(path)
    assert flow.check(spark, {"kind": "rows", "path": path, "min": 5})[0] and not flow.check(spark, {"kind": "where", "path": path, "condition": "id < 4"})[0]
    stage = {"name": "s", "status": "done", "evidence": {path: flow.content_hash(spark.read.parquet(path))}}
    assert flow.stale_stages(spark, [stage]) == []
    spark.range(6).write.mode("overwrite").parquet(path)
    assert flow.stale_stages(spark, [stage]) == ["s"]


def test_edge_build_accounts_for_every_edge(spark):
    """Dangling ends, unknown types, hyperedges that resolve and that do not, and variants that no node table has."""
    edges = spark.createDataFrame([("genes/1", "proteins/1"), ("genes/1", "proteins/1"), ("genes/9", "proteins/1"), ("odd/1", "proteins/1"), ("pairs/1", "proteins/1"), ("pairs/9", "proteins/1"), ("genes/1", "variants/7"), (None, "proteins/1")], "_from string, _to string")
    hyper = spark.createDataFrame([("pairs/1", "genes/1", "proteins/5")], "_id string, _from string, _to string")
    nodes = {"Gene": spark.createDataFrame([("genes/1",)], "id string"), "Protein": spark.createDataFrame([("proteins/1",), ("proteins/1",)], "id string")}
    kept, rejects = kg.edge_table(edges, nodes, {"genes": "Gene", "proteins": "Protein", "variants": "Variant"}, hyper)
    assert sorted((r.from_id, r.to_id, r.via or "") for r in kept.collect()) == [("genes/1", "proteins/1", ""), ("genes/1", "proteins/1", ""), ("genes/1", "proteins/1", "proteins/5"), ("genes/1", "variants/7", "")]
    assert sorted(r.reason for r in rejects.collect()) == ["dangling endpoint", "hyperedge endpoint not in mirror", "unknown endpoint type", "unknown endpoint type"]
    found, stubs = kg.referenced_nodes(kept, "Variant", spark.createDataFrame([("variants/1",)], "id string"))
    assert found.count() == 0 and [(r.id, r.taxon) for r in stubs.collect()] == [("variants/7", kg.HUMAN)]


def test_deconvolution_keeps_to_the_guides_it_sees():
    rng = np.random.default_rng(3)
    position, score = np.sort(rng.integers(0, 60000, 20000)) * 12.0, rng.normal(4, 3, 20000)
    bins = np.arange(position[0] - 30, position[-1] + 31, 20)
    tracemalloc.start()
    beta = matrices.deconvolved(position, score, bins, 30.0, 0.5, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and len(beta) == len(bins)  # guides times bins would be 5.8 GB
    some = np.argsort(position, kind="stable")[:300]
    x, y, b = position[some], score[some], bins[:200]
    kernel = np.exp(-0.5 * ((x[:, None] - b) / 30) ** 2) * (np.abs(x[:, None] - b) <= 90)
    want, rest = np.zeros(len(b)), y.copy()
    for _ in range(250):  # bin after bin
        for k in np.flatnonzero(kernel.any(axis=0)):
            pull, square = kernel[:, k] @ rest + (kernel[:, k] ** 2).sum() * want[k], (kernel[:, k] ** 2).sum()
            new = np.sign(pull) * max(abs(pull) - 0.5, 0) / square
            rest, want[k] = rest - kernel[:, k] * (new - want[k]), new
    shuffled = rng.permutation(300)
    assert np.allclose(matrices.deconvolved(x[shuffled], y[shuffled], b, 30.0, 0.5, 250), want, atol=1e-9)


def test_percentiles_over_ranges(spark):
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 1000):
        x = np.round(rng.normal(0, 3, n), 1)
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(3)
        (edges,) = ordered.percentiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0]).first()
        assert np.allclose(edges, np.quantile(x, [0, 0.25, 0.5, 0.9, 1]), rtol=0, atol=1e-12)
    assert ordered.percentiles(df.limit(0), "v", [0.5]).first() == ([None],)
    plan = registry.queries()["quantile_bins_edges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan  # its buffer holds every different value in one task


def test_nearest_of_three_by_ranges(spark):
    rng = np.random.default_rng(8)
    spots = rng.integers(0, 300, 80)
    elements = [(k, "ab"[k % 2], int(s), int(s + rng.integers(1, 12)), None if k % 5 else "c") for k, s in enumerate(spots)]
    regions = [(k, "abz"[k % 3], int(s), int(s + rng.integers(1, 9))) for k, s in enumerate(rng.integers(-20, 330, 120))]
    found = peaks.nearest_elements(spark.createDataFrame(regions, "region_id long, chr string, start long, end long").repartition(3), spark.createDataFrame(elements, "element_id long, chr string, start long, end long, class string"))
    want = {}
    for r, c, s, e in regions:
        own = sorted((x[2], x[3], x[0]) for x in elements if x[1] == c)
        p = sum(x[0] < s for x in own)
        about = [*own[max(p - 1, 0) : p], *own[p : p + 2]]
        gaps = [(0 if b < e and f > s else max(b - e if b >= e else s - f, 0), k, i) for k, (b, f, i) in enumerate(about)]
        if gaps:
            d, _, i = min(gaps)
            want[r] = (d, i)
    assert {r.region_id: (r.distance, r.element_id) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()  # such a frame is gone through anew for every row
