"""Small filter languages compiled to columns, so that Catalyst can push them into the scan."""

from __future__ import annotations

import math
import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a condition's operator means, the longer ones first.
COMPARE = {"<=": operator.le, ">=": operator.ge, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "=": operator.eq}
#: Names of comparisons in a filter's value, and what they turn into for a falling scale.
BOUNDS = {"gte": operator.ge, "lte": operator.le, "gt": operator.gt, "lt": operator.lt}
TURNED = {"gte": "lte", "lte": "gte", "gt": "lt", "lt": "gt"}


def conditions(spec: str) -> list[tuple[str, str, float]]:
    """`a>=1,b<2` as (column, operator, number); a part without an operator or a number is an error.

    An operator of two characters is found before one of one, wherever it stands in the part.
    """
    out = []
    for part in (p for p in spec.split(",") if p.strip()):
        found = next((op for op in COMPARE if op in part), None)
        if found is None:
            raise ValueError(f"no operator in {part!r}")
        name, value = (x.strip() for x in part.split(found, 1))
        out.append((name, found, float(value)))
    return out


def where_column(spec: str) -> Column:
    """All conditions hold; a missing or non-numeric value fails its condition."""
    tests = [COMPARE[op](F.col(n).try_cast("double"), F.lit(v)) for n, op, v in conditions(spec)]
    return reduce(lambda a, b: a & b, (F.coalesce(t, F.lit(False)) for t in tests), F.lit(True))


def falling(value: str) -> tuple[str | None, float]:
    """A comparison of a p value as one of minus its logarithm to 3 decimals: (turned comparison or None, number)."""
    m = re.fullmatch(r"(?:(gte|lte|gt|lt):)?(.+)", value, re.I)
    p = float(m[2])
    if not 0 < p <= 1:
        raise ValueError(f"p value out of range: {p}")
    return TURNED[m[1].lower()] if m[1] else None, round(-math.log10(p), 3)


def filter_column(spec: str) -> Column:
    """`;` separates clauses, the first = splits, != negates, a comma lists alternatives, gte: lte: gt: lt: compare.

    Blanks about values do not count, nor do empty values. p_value compares log10pvalue the other way round; a p value
    that is not in (0, 1] is an error, as is a clause without =.
    """
    out = F.lit(True)
    for clause in (c.strip() for c in spec.split(";") if c.strip()):
        if "=" not in clause:
            raise ValueError(f"bad clause {clause!r}")
        negated = "!=" in clause
        name, value = (x.strip() for x in clause.split("!=" if negated else "=", 1))
        listed = [v.strip() for v in value.split(",") if v.strip()]
        tests, plain = [], []
        for v in listed:
            m = re.fullmatch(r"(gte|lte|gt|lt):(.+)", v)
            if name == "p_value":
                how, number = falling(v)
                x = F.col("log10pvalue").try_cast("double")
                tests.append(BOUNDS[how](x, F.lit(number)) if how else x == number)
            elif m:
                tests.append(BOUNDS[m[1]](F.col(name).try_cast("double"), F.lit(float(m[2]))))
            else:
                plain.append(v)
        if plain:
            tests.append(F.col(name).cast("string").isin(plain))
        if tests:
            any_of = reduce(lambda a, b: a | b, tests)
            out = out & F.coalesce(~any_of if negated else any_of, F.lit(False))
    return out


def region(text: Column) -> dict[str, Column]:
    """chr:start-end with thousands commas."""
    clean = F.regexp_replace(text, ",", "")
    part = lambda k: F.regexp_extract(clean, r"^(chr\w+):(\d+)-(\d+)$", k)
    return {"chrom": F.nullif(part(1), F.lit("")), "start": part(2).try_cast("long"), "end": part(3).try_cast("long")}


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page number (from 0) of size rows in a total order."""
    return df.orderBy(*order).offset(number * size).limit(size)
