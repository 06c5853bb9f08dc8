"""Set algebra over any number of relations with equal columns; rows compare whole, NULL equals NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concat(*sources: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)


def concat_distinct(*sources: DataFrame) -> DataFrame:
    return concat(*sources).distinct()


def intersect_distinct(*sources: DataFrame) -> DataFrame:
    return reduce(DataFrame.intersect, sources)


def intersect_all(*sources: DataFrame) -> DataFrame:
    return reduce(DataFrame.intersectAll, sources)


def except_distinct(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Rows of the first source that no other has."""
    return first.subtract(concat(*rest)) if rest else first.distinct()


def except_all(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """The first source, each row of the others taken away once."""
    return reduce(DataFrame.exceptAll, rest, first)


def _tagged(sources: tuple[DataFrame, ...]) -> DataFrame:
    return concat(*(s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)))


def symmetric_difference_distinct(*sources: DataFrame) -> DataFrame:
    """Rows that are in exactly one source."""
    cols = sources[0].columns
    return _tagged(sources).groupBy(*cols).agg(F.count_distinct("_source").alias("_in")).filter("_in = 1").select(*cols)


def symmetric_difference_all(*sources: DataFrame) -> DataFrame:
    """Each row as often as the counts' difference, folded from the left over the sources. One aggregation for all sources."""
    cols = sources[0].columns
    counts = _tagged(sources).groupBy(*cols).agg(*(F.sum((F.col("_source") == i).cast("long")).alias(f"_n{i}") for i in range(len(sources))))
    n = reduce(lambda acc, i: F.abs(acc - F.col(f"_n{i}")), range(1, len(sources)), F.col("_n0"))
    return counts.withColumn("_n", n).filter("_n > 0").select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy")).drop("_copy")
