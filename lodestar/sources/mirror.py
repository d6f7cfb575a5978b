"""Mirror of keyed collections: key ranges by measured counts, all-or-nothing pulls, and shards of mixed types."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import key_range

Range = tuple[str | None, str | None, int]


def plan_ranges(df: DataFrame, key: str, target: int) -> list[Range]:
    """(low, high, rows) of contiguous ranges [low, high) of keys in byte order, of about target rows each.

    The cuts come from one range partitioning, their counts from one pass; they must add up to the table's rows. One
    key is never split, so a range holds more than target rows only if a key or a stretch between two cuts does. Only
    the cuts come to the driver: rows / target of them.
    """
    total = df.count()
    n = max(1, -(-total // target))
    dealt = df.select(F.col(key).cast("binary").alias("k")).repartitionByRange(n, "k")
    lows = [r.k for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k")).where("k IS NOT NULL").orderBy("k").collect()]
    cuts = [bytes(x).decode() for x in lows[1:]]
    bounds = [None, *cuts, None]
    pairs = list(zip(bounds, bounds[1:], strict=False))
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col(key).cast("binary") >= F.lit(c).cast("binary")).cast("int")
    counted = {r.i: r.n for r in df.where(F.col(key).isNotNull()).groupBy(number.alias("i")).agg(F.count(F.lit(1)).alias("n")).collect()}
    out = [(low, high, counted.get(i, 0)) for i, (low, high) in enumerate(pairs)]
    if sum(n for *_, n in out) != df.where(F.col(key).isNotNull()).count():
        raise RuntimeError("the ranges do not add up to the table")
    return out


def pull_range(source: Callable[[str | None, str | None], DataFrame], part: Range, path: str, tag: str, attempts: int = 4) -> str:
    """Write one range to path/tag, whole or not at all: done, or count_mismatch if it is not as many rows as planned.

    A try writes to a folder of its own; a failed one is started afresh, and only one with the planned rows is renamed.
    """
    low, high, planned = part
    error: Exception | None = None
    for k in range(attempts):
        df = source(low, high)
        spark = df.sparkSession
        work = f"{path}/_partial_{tag}_{k}"
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(work)
        except Exception as e:  # the source can fail at any row; the next try starts the range again
            error = e
            continue
        rows = spark.read.parquet(work).count()
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
        if rows != planned:
            fs.delete(hadoop(work), True)
            return "count_mismatch"
        fs.delete(hadoop(f"{path}/{tag}"), True)
        fs.rename(hadoop(work), hadoop(f"{path}/{tag}"))
        return "done"
    raise RuntimeError(f"range {tag} failed {attempts} times") from error


def pull(df: DataFrame, key: str, path: str, target: int) -> dict[str, str]:
    """Mirror a table range by range; ranges that are there already are not pulled again. tag -> status."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    for k, part in enumerate(plan_ranges(df, key, target)):
        tag = f"r{k:04d}"
        done = fs.exists(hadoop(f"{path}/{tag}/_SUCCESS"))
        out[tag] = "done" if done else pull_range(lambda low, high: df.where(key_range(F.col(key), low, high)), part, path, tag)
    return out


def verify(spark: SparkSession, views: list[str]) -> DataFrame:
    """(view, n) of every registered view."""
    out = None
    for v in views:
        one = spark.table(v).agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("view"), "n")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no views")
    return out


def shard_types(frames: Iterator[DataFrame] | list[DataFrame]) -> dict[str, str]:
    """The type of each column over shards: integers and doubles together are double, unless an integer is beyond the
    doubles that are exact (2 ** 53); that, and all other mixtures, is string."""
    kinds: dict[str, set[str]] = {}
    frames = list(frames)
    for f in frames:
        for c, k in f.dtypes:
            kinds.setdefault(c, set()).add(k)
    whole, broken = {"tinyint", "smallint", "int", "bigint"}, {"float", "double"}
    out = {}
    for c, found in kinds.items():
        if len(found) == 1:
            out[c] = next(iter(found))
        elif found <= whole:
            out[c] = "bigint"
        elif found <= whole | broken | {"boolean"} and "boolean" not in found:
            big = any(not f.where(F.abs(F.col(f"`{c}`").cast("decimal(38,0)")) > 2**53).isEmpty() for f in frames if dict(f.dtypes).get(c) == "bigint")
            out[c] = "string" if big else "double"
        else:
            out[c] = "string"
    return out


def union_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Shards with the union of their columns, each column of one type by shard_types; what a shard has not is null."""
    frames = [spark.read.parquet(p) for p in paths]
    to = shard_types(frames)
    cast = [f.select(*(F.col(f"`{c}`").cast(to[c]).alias(c) for c in f.columns)) for f in frames]
    out = cast[0]
    for f in cast[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
