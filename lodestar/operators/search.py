"""Full-text search: a postings table and BM25 ranking by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, tf) of lower-case words of letters and digits."""
    words = F.explode(F.filter(F.split(F.lower(text_col), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return docs.select(F.col(id_col).alias("id"), words.alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))


def bm25(index: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the documents that hold all terms, from a whole index."""
    return ranked(index.where(F.col("term").isin(terms)).join(index.groupBy("id").agg(F.sum("tf").alias("dl")), "id"), index.groupBy("id").agg(F.sum("tf").alias("dl")), terms, k1, b)


def search(docs: DataFrame, id_col: str, text_col: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the documents that hold all terms, in one pass over the texts: only the terms' counts leave the scan.

    The length of a document is that of its word list; rows of one id are one document each.
    """
    words = docs.select(F.col(id_col).alias("id"), F.filter(F.split(F.lower(text_col), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("words"))
    sized = words.select("id", F.size("words").cast("long").alias("dl"), "words").where("dl > 0")
    times = lambda t: F.size(F.filter("words", lambda w: w == t)).cast("long")
    counts = F.array(*(F.struct(F.lit(t).alias("term"), times(t).alias("tf")) for t in sorted(set(terms))))
    hits = sized.select("id", "dl", F.explode(F.filter(counts, lambda c: c["tf"] > 0)).alias("c")).select("id", "dl", "c.term", "c.tf")
    return ranked(hits, sized.select("id", "dl"), terms, k1, b)


def ranked(hits: DataFrame, sizes: DataFrame, terms: list[str], k1: float, b: float) -> DataFrame:
    """BM25 of hits (id, term, tf, dl) among documents of the given sizes; only documents with all terms count."""
    totals = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row a term
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    joined = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals))  # one row
    return joined.groupBy("id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("_got")).where(F.col("_got") == len(set(terms))).drop("_got")
