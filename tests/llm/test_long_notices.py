"""Templates longer than half a block are found at every offset."""

from lodestar.llm import licenses


def test_long_notices_at_unaligned_offsets(spark):
    templates = [("long", " ".join(f"term{k}" for k in range(100))), ("middle", " ".join(f"part{k}" for k in range(70)))]
    rows = []
    for _, notice in templates:
        rows += [(len(rows) + k, "x " * at + notice + " y" * 90) for k, at in enumerate((0, 25, 57, 133))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs, templates=templates).collect()}
    assert got == {k: ("long" if k < 4 else "middle", 1.0) for k in range(8)}
