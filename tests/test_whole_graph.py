"""The graph queries over all orders, against union-find."""

import pyarrow.parquet as pq

from lodestar.operators import graph
from lodestar.plans import registry

SF = "/root/testdata/sf0.001"


def test_components_of_all_orders(spark):
    orders = pq.read_table(f"{SF}/orders.parquet").to_pandas()
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in zip(orders.o_custkey, orders.o_orderkey % 900 + 100000, strict=True):
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.node: r.component for r in registry.queries()["connected_components"](spark, SF).collect()}
    assert got == {x: find(x) for x in root}


def test_two_hops_of_hubs_without_paths(spark):
    star = spark.range(60000).selectExpr("id AS a", "-1L AS b")  # 3.6 billion paths
    other = spark.createDataFrame([(5, -2), (70000, -2), (70000, 70000), (None, -2), (80000, 80001)], "a long, b long")
    got = {r.node: r.two_hop for r in graph.two_hop_counts(star.unionByName(other)).collect()}
    assert got == {k: 59999 for k in range(60000)} | {5: 60000, 70000: 2, -1: 1, -2: 2}  # 70000 is its own neighbour
