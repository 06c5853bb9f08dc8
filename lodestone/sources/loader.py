"""Parquet tables as typed DataFrames: money and quantities as decimals, explicit casts, nothing inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Double columns that hold exact amounts.
DECIMALS = {
    "customer": ("c_acctbal",),
    "supplier": ("s_acctbal",),
    "part": ("p_retailprice",),
    "orders": ("o_totalprice",),
    "lineitem": ("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def near(column: str, low: float | None, high: float | None) -> Column:
    """What a range of the rounded amount implies for the double below it: the range, half a cent wider at either end. Unlike a filter on
    the cast column it reaches the scan, and row groups outside of it are not read."""
    c = F.col(column)
    ends = [c >= low - 0.0051] if low is not None else []
    ends += [c <= high + 0.0051] if high is not None else []
    return reduce(lambda a, b: a & b, ends)


def load(spark: SparkSession, sf_dir: str, name: str, amounts: str = "decimal(12,2)", within: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """One table; the casts sit above the scan, so filters on other columns and column pruning still reach it. within: ranges of amounts that
    the caller filters by anyway, for the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for column, (low, high) in (within or {}).items():
        df = df.filter(near(column, low, high))
    return df.withColumns({c: F.col(c).cast(amounts) for c in DECIMALS.get(name, ())})


def load_all(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: load(spark, sf_dir, name) for name in TABLES}
