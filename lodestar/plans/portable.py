"""Queries whose plan is stated in SQL: Catalyst plans it over the lazily read tables, and the same text, but for the
dialect tokens below, is the oracle's."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans.registry import query
from lodestar.session import table

TABLES = "region nation customer supplier part orders lineitem events documents labels embeddings pages benchmark conversations".split()

#: token -> (Spark, DuckDB)
DIALECT = {
    "SEC": (r"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', \1)", r"CAST(floor(epoch(\1)) AS BIGINT)"),
    "INTDIV": (r"CAST(floor((\1) / (\2)) AS BIGINT)", r"CAST(floor((\1) / (\2)) AS BIGINT)"),
    "MATCHES": (r"regexp_like(\1, \2)", r"regexp_matches(\1, \2)"),
    "SHA": (r"sha2(\1, 256)", r"sha256(\1)"),
    "PCT": (r"percentile(\1, \2)", r"quantile_cont(\1, \2)"),
    "KJSON": (r"CAST(get_json_object(\1, '$.k') AS BIGINT)", r"CAST(json_extract_string(\1, '$.k') AS BIGINT)"),
    "JOINED": (r"array_join(array_sort(collect_set(\1)), ';')", r"string_agg(DISTINCT \1, ';' ORDER BY \1)"),
}


def translated(sql: str, side: int) -> str:
    for token, forms in DIALECT.items():
        arity = 2 if r"\2" in forms[0] else 1
        args = r"\(([^(),]+)\)" if arity == 1 else r"\(([^,]+), ([^()]+)\)"
        sql = re.sub(rf"\b{token}{args}", forms[side], sql)
    return sql


def portable(name: str, sql: str) -> None:
    """Register a query given in SQL; tables are bound as DataFrames, so no view outlives the call."""
    text = translated(sql, 0)
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound = text
        for t in used:
            named = r"(?=\s+(?!ON\b|WHERE\b|GROUP\b|JOIN\b|LEFT\b|FULL\b|CROSS\b|UNION\b|WINDOW\b|INTERSECT\b|EXCEPT\b|HAVING\b|ORDER\b)\w)"
            bound = re.sub(rf"\b(FROM|JOIN)\s+{t}\b{named}", rf"\1 {{{t}}}", bound)  # it has an alias
            bound = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}} AS {t}", bound)
        return spark.sql(bound, **{t: table(spark, sf_dir, t) for t in used})

    query(name, translated(sql, 1))(run)
