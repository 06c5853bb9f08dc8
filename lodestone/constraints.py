"""Constraint verdicts as DataFrames: a constraint holds if its query of offenders is empty."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import ConstraintError


@dataclass(frozen=True)
class Constraint:
    """kind: primary, unique, foreign or check. expr: a check's condition; parent: a foreign key's (table, column)."""

    name: str
    kind: str
    columns: tuple[str, ...] = ()
    expr: str = ""
    parent: tuple[str, str] = ("", "")


def duplicates(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Keys that stand twice or more; a key with a NULL is never a duplicate."""
    whole = df.dropna(subset=list(columns)) if columns else df
    return whole.groupBy(*columns).count().filter("count > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Non-NULL references without a parent."""
    keys = parent.select(F.col(key).alias("_key")).distinct()
    return child.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_key"), "left_anti")


def failing(df: DataFrame, expr: str) -> DataFrame:
    """Rows for which the condition is false; NULL passes."""
    return df.filter(~F.expr(expr))


def taken(df: DataFrame, old: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Keys of df that old has already; a key with a NULL is never taken."""
    return old.select(*columns).join(df.dropna(subset=list(columns)).select(*columns).distinct(), list(columns), "left_semi")


def verify(table: str, df: DataFrame, constraints: list[Constraint], parents, old: DataFrame | None = None) -> None:
    """Raise for the first constraint that df breaks; parents(name) gives a parent table. old: rows that hold already, beside which df comes."""
    for c in constraints:
        if c.kind == "primary":
            missing = df.filter(" OR ".join(f"`{x}` IS NULL" for x in c.columns))
            if not missing.isEmpty():
                raise ConstraintError(f"null value in the primary key of {table}", "23502")
        if c.kind in ("primary", "unique") and not (duplicates(df, c.columns).isEmpty() and (old is None or taken(df, old, c.columns).isEmpty())):
            raise ConstraintError(f"duplicate key violates {c.name} of {table}", "23505")
        if c.kind == "check" and not failing(df, c.expr).isEmpty():
            raise ConstraintError(f"a row violates {c.name} of {table}", "23514")
        if c.kind == "foreign" and not orphans(df, c.columns[0], parents(c.parent[0]), c.parent[1]).isEmpty():
            raise ConstraintError(f"a row of {table} violates {c.name}", "23503")
