"""Sequence operators on strings with array functions: neighbours, k-mers, runs, windows of bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hamming1(text: Column, alphabet: str) -> Column:
    """All strings with exactly one letter replaced."""
    at = lambda i: F.transform(F.array(*(F.lit(c) for c in alphabet)), lambda c: F.overlay(text, c, i))
    return F.array_except(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(text)), at))), F.array(text))


def hamming1_join(reads: DataFrame, library: DataFrame, read: str, entry: str, alphabet: str) -> DataFrame:
    """Match reads to library entries exactly, else by one substitution if only one entry is so near."""
    near = library.select(entry, F.explode(hamming1(F.col(entry), alphabet)).alias("_form"), F.lit(1).alias("distance"))
    forms = near.unionByName(library.select(entry, F.col(entry).alias("_form"), F.lit(0).alias("distance")))
    best = forms.groupBy("_form", "distance").agg(F.min(entry).alias(entry), F.count_distinct(entry).alias("n"))
    pick = best.groupBy("_form").agg(F.min_by(F.struct(entry, "n", "distance"), F.col("distance")).alias("b")).where("b.n = 1")
    return reads.join(pick, reads[read] == pick["_form"]).select(*reads.columns, F.col(f"b.{entry}").alias(entry), "b.distance")


def kmers(text: Column, k: int) -> Column:
    spots = F.when(F.length(text) >= k, F.sequence(F.lit(1), F.length(text) - k + 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(spots, lambda i: F.substring(text, i, F.lit(k)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def overlap_coefficient(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))), F.lit(1))


def longest_run(text: Column) -> Column:
    """Length of the longest run of one character."""
    runs = F.regexp_extract_all(text, F.lit(r"(?s)((.)\2*)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))


def gc_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^GCgc]", "")) / F.greatest(F.length(text), F.lit(1))


def tiles(start: Column, end: Column, width: int, step: int) -> Column:
    """Starts of tiles of one width, the last one ending at end."""
    last = F.greatest(start, end - width)
    return F.array_distinct(F.concat(F.sequence(start, last, F.lit(step)), F.array(last)))
