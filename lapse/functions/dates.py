"""Date expressions.  Storage dates are int YYYYMMDD; queries use DATE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def ymd(col) -> Column:
    """Strict int YYYYMMDD -> DATE.  Under ANSI mode a bad value raises."""
    return F.to_date(_c(col).cast("string"), "yyyyMMdd")


def try_ymd(col) -> Column:
    """Lenient int YYYYMMDD -> DATE: malformed or missing values become NULL."""
    return F.try_to_date(_c(col).cast("string"), "yyyyMMdd")


def to_ymd_int(col) -> Column:
    """DATE -> int YYYYMMDD (monotone, so range filters on it prune Parquet)."""
    d = _c(col)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")

