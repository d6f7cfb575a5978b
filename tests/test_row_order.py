"""Rows just at a bound: the same as SQL however the table is dealt over partitions."""

import duckdb
import pytest

from lodestar.plans import registry

ROWS = """SELECT * REPLACE ({key} AS l_partkey, l_quantity + l_suppkey % 5 AS l_quantity, {price} AS l_extendedprice)
FROM (SELECT *, row_number() OVER () AS rn FROM '/root/testdata/sf0.01/lineitem.parquet')"""
#: many ratios; a few different counts, so that many a row is just as far from its mean as the bound
KINDS = {"wide": ("l_partkey % 700", "round(l_extendedprice * 1.1137, 2)"), "few": ("rn % 2000", "1.0 + l_suppkey % 4"), "two": ("rn % 2400", "1.0 + l_suppkey % 2")}


@pytest.fixture(scope="module")
def split_lines(tmp_path_factory):
    found = {}
    for kind, (key, price) in KINDS.items():
        folder, con = tmp_path_factory.mktemp(kind), duckdb.connect()
        con.execute("SET threads = 1")  # rows are added in their order
        con.execute(f"COPY ({ROWS.format(key=key, price=price)}) TO '{folder}/lineitem.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)")
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
        found[kind] = str(folder), con
    return found


@pytest.mark.parametrize("name, kind", [("concordance_sign", "wide"), ("mad_outliers", "wide"), ("z_filtered_barcodes", "two"), ("oligo_outliers_z", "few")])
def test_bounds_do_not_depend_on_partitions(spark, split_lines, name, kind):
    folder, con = split_lines[kind]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60k")
    try:
        df = registry.queries()[name](spark, folder)
        got = sorted(tuple(r) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracles()[name]})").fetchall())
