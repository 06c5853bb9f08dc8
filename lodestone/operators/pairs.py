"""Pairs of rows of one table that share a key, one of them before the other.

Groups may hold any share of the table, and their pairs grow with the square. So what is joined is blocks of a group's rows: two lists for up
to BLOCK * BLOCK pairs are dealt over all tasks, however few the keys are, and pairs come into being only where they are handed on.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def ordered_pairs(rows: DataFrame, keys: list[str], by: str, low: list[str], high: list[str], equal: bool = False) -> DataFrame:
    """Structs low and high of these columns for every two rows that agree in keys and of which by is less in low than in high (or, with
    equal, not greater). Rows with a null in keys or by are in no pair, repeated rows are in as many as they stand for."""
    before = (lambda a, b: a <= b) if equal else (lambda a, b: a < b)
    key = [f"k{i}" for i in range(len(keys))]  # own names, which cannot meet the table's

    def blocks(side: str, columns: list[str]) -> DataFrame:
        place = [f"{side}{i}" for i in range(len(columns))]
        df = rows.select(*(F.col(f"`{c}`").alias(k) for c, k in zip([*keys, *columns], [*key, *place])))
        df = df.filter(reduce(and_, (F.col(c).isNotNull() for c in [*key, place[0]])))
        at = F.row_number().over(Window.partitionBy(*key).orderBy(*place))  # by all columns: the same again if a task is repeated
        df = df.withColumn(f"{side}_block", F.floor((at - 1) / BLOCK)).groupBy(*key, f"{side}_block")
        rest = [F.collect_list(F.struct(*place[1:])).alias(f"{side}_rest")] if place[1:] else []
        return df.agg(F.collect_list(place[0]).alias(side), *rest, F.min(place[0]).alias(f"{side}_least"), F.max(place[0]).alias(f"{side}_most"))

    def struct(side: str, named: list[str], columns: list[str]) -> Column:
        return F.struct(*((F.col(f"{side}_rest")[F.col(f"{side}_at")][f"{side}{i}"] if (i := columns.index(c)) else F.col(f"{side}_by")).alias(c) for c in named)).alias(side)

    low_columns, high_columns = (list(dict.fromkeys([by, *columns])) for columns in (low, high))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as small lists make many pairs and must not be put together
    met = blocks("low", low_columns).join(blocks("high", high_columns), key).filter(before(F.col("low_least"), F.col("high_most"))).repartition(n, *key, "low_block", "high_block")
    high_lists = ["high", *(["high_rest"] if high_columns[1:] else [])]
    met = met.select(*high_lists, *(["low_rest"] if low_columns[1:] else []), F.posexplode("low").alias("low_at", "low_by")).select(struct("low", low, low_columns), "low_by", *high_lists)
    # A function over a list is run outside of generated code, which would hold all pairs of two blocks before it hands on the first.
    met = met.filter(F.exists("high", lambda x: before(F.col("low_by"), x)))
    met = met.select("low", "low_by", *high_lists[1:], F.posexplode("high").alias("high_at", "high_by")).filter(before(F.col("low_by"), F.col("high_by")))
    return met.select("low", struct("high", high, high_columns))
