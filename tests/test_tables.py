"""Count tables: p values, refusals and rules that SQL does not show."""

import math

import numpy as np
import pytest

from lodestar.operators import tables


def test_enrichment_p(spark):
    df = spark.createDataFrame([("a", "x", 3, 10, 5, 40), ("a", "y", 0, 10, 5, 40), ("b", "x", 8, 10, 5, 40)], "k string, m string, x1 long, n1 long, x2 long, n2 long")
    out = {(r.k, r.m): r for r in tables.enrichment_statistics(df, "x1", "n1", "x2", "n2", ["k"]).collect()}
    for (k, m), r in out.items():
        hits, n = r.x1 + r.x2, r.n1 + r.n2
        want = sum(math.comb(hits, i) * math.comb(n - hits, r.n1 - i) for i in range(r.x1 + 1, min(hits, r.n1) + 1)) / math.comb(n, r.n1)
        assert np.isclose(r.p, want) and np.isclose(r.p_adjusted, min(1, want * (2 if k == "a" else 1)))
    assert tuple(out["a", "y"])[6:10] == (0.0, math.inf, 0.0, None)
    rare = spark.createDataFrame([(2, 10, 0, 40), (0, 10, 0, 40), (0, 0, 1, 40), (None, 10, 1, 40)], "x1 long, n1 long, x2 long, n2 long")
    got = [tuple(r)[4:] for r in tables.enrichment_statistics(rare, "x1", "n1", "x2", "n2").collect()]
    assert got[0][:4] == (math.inf, math.inf, None, math.inf) and got[0][4] == 0
    assert got[1][0] is None and got[1][2:4] == (None, None) and got[2] == (None, None, None, None, None, None) and got[3][4] is None
    assert tables.enrichment_statistics(df.limit(0), "x1", "n1", "x2", "n2").collect() == []


def test_trait_enrichment_p(spark):
    hits = spark.createDataFrame([(i,) for i in range(10)], "item long")
    catalogue = spark.createDataFrame([("t" if i < 8 or i > 35 else "u", i) for i in range(40)], "trait string, item long")
    out = {r.trait: r for r in tables.trait_enrichment(hits, catalogue, "trait", "item", 1).collect()}
    t = out["t"]
    assert (t.a, t.b, t.c, t.d) == (8, 4, 2, 26)
    assert np.isclose(t.p, sum(math.comb(10, i) * math.comb(30, 12 - i) for i in range(8, 11)) / math.comb(40, 12))
    assert np.isclose(t.q, min(1, t.p * 2)) and out["u"].q >= out["u"].p


def test_fold_changes_need_both_samples(spark):
    df = spark.createDataFrame([("g", "a", 1, 5), ("g", "b", 1, 5), ("h", "a", 2, 5)], "guide string, condition string, replicate int, n long")
    with pytest.raises(ValueError):
        tables.fold_changes(df, "a", "b")
    assert [r.lfc for r in tables.fold_changes(df.where("replicate = 1"), "a", "b").collect()] == [0.0]


def test_agreement_needs_more_than_half(spark):
    with pytest.raises(ValueError):
        tables.agreed_assignment(spark.createDataFrame([], "barcode string, oligo string"), 1, 0.5)


def test_centre_and_thresholds(spark):
    df = spark.createDataFrame([(float(v), v < 4) for v in (0, 1, 2, 3, 9, 30)], "v double, c boolean")
    assert {r.v - r.centred for r in tables.centred(df, "v", df.c).collect()} == {2.5}  # four controls: the median
    assert {r.v - r.centred for r in tables.centred(df, "v", df.c, 4).collect()} == {1.5}
    assert tables.threshold_span(df, "v", 2) == [0.0, 2.5, 15.0, 30.0]
    assert tables.threshold_span(df, "v", 2, [3.0, 1.0, 3.0]) == [1.0, 3.0]
    assert tables.threshold_span(df.limit(0), "v", 2) == []


def test_deepest_barcodes_and_zero_counts(spark):
    rows = [(b, "o", "r", 4, 2**b) for b in range(8)] + [(90, "o", "r", 0, 4), (91, "o", "r", 4, 0)]
    c = spark.createDataFrame(rows, "barcode long, oligo string, replicate string, dna long, rna long")
    kept = {r.barcode for r in tables.mad_filter(c, 2, 50.0).collect()}
    assert 7 not in kept and 91 not in kept and 90 in kept  # no last edge; no ratio; minus infinity is not far above
    assert 7 in {r.barcode for r in tables.mad_filter(c, 2, 50.0, top_bin=True).collect()}


def test_merged_counts_pseudocounts_and_totals(spark):
    counts = spark.createDataFrame([("a", 0, 3), ("b", 2, 5), ("c", 4, 1), ("d", 1, 8)], "barcode string, dna long, rna long")
    owners = spark.createDataFrame([("a", "x"), ("b", "x"), ("d", "y"), ("d", "z")], "barcode string, oligo string")
    (r,) = tables.merged_counts(counts, owners, 0, 1, 10.0).collect()
    assert (r.oligo, r.n_bc, r.dna, r.rna) == ("x", 2, 4, 8) and np.isclose(r.dna_normalized, 5) and np.isclose(r.rna_normalized, 5)
    (r,) = tables.merged_counts(counts, owners, 0, 1, 10.0, True).collect()
    assert np.isclose(r.dna_normalized, 2 / 11 * 10) and np.isclose(r.rna_normalized, 4 / 17 * 10)


def test_outputs_compared_with_null_keys(spark):
    a = spark.createDataFrame([(None, 1.0), ("x", None), ("y", 2.0), ("z", 1.0)], "k string, v double")
    b = spark.createDataFrame([(None, 1.0), ("x", None), ("y", None), ("w", 1.0)], "k string, v double")
    assert tuple(tables.joined_outputs(a, b, ["k"], "v", 0.1).first()) == (1, 1, 2, 1)
