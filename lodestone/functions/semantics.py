"""PostgreSQL aggregate, ordering and pattern rules as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pg_sum(df: DataFrame, name: str) -> Column:
    """SUM: int2 and int4 give int8, int8 gives numeric(38,0), numeric(p,s) gives numeric(38,s)."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.LongType):
        return F.sum(F.col(name).cast("decimal(38,0)")).cast("decimal(38,0)")
    if isinstance(kind, T.DecimalType):
        return F.sum(F.col(name).cast(T.DecimalType(38, kind.scale))).cast(T.DecimalType(38, kind.scale))
    return F.sum(F.col(name).cast("long"))


def pg_avg(df: DataFrame, name: str, scale: int = 16) -> Column:
    """AVG as numeric(38, scale), rounded half away from zero; 38 digits bound the sum to 10^(38 - scale)."""
    total = pg_sum(df, name).cast(T.DecimalType(38, scale))
    return F.try_divide(total, F.count(name).cast("decimal(20,0)")).cast(T.DecimalType(38, scale))


def pg_order(column: Column | str, desc: bool = False, nulls: str | None = None) -> Column:
    """A sort key: by default nulls last when ascending, first when descending."""
    column = F.col(column) if isinstance(column, str) else column
    first = desc if nulls is None else nulls == "first"
    if desc:
        return column.desc_nulls_first() if first else column.desc_nulls_last()
    return column.asc_nulls_first() if first else column.asc_nulls_last()


def pg_like(column: Column, pattern: str) -> Column:
    """LIKE; a backslash before an ordinary character stands for that character, and a pure prefix can be pushed down."""
    pattern = re.sub(r"\\([^%_\\])", r"\1", pattern)
    if re.fullmatch(r"[^%_\\]*%", pattern):
        return column.startswith(pattern[:-1])
    return column.like(pattern)


def ranking(kind: str, window) -> Column:
    """row_number, rank or dense_rank over a window, as int8."""
    return getattr(F, kind)().over(window).cast("long")
