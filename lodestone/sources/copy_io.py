"""COPY in text and CSV format: typed reads with an explicit schema, and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataError
from ..types import SqlType, schema


def _typed(raw: DataFrame, columns: list[tuple[str, SqlType]]) -> DataFrame:
    out = []
    for name, kind in columns:
        c = F.col(name)
        if kind.name == "bool":
            low = F.lower(F.trim(c))
            c = F.when(low.isin("t", "true", "y", "yes", "on", "1"), F.lit(True)).when(low.isin("f", "false", "n", "no", "off", "0"), F.lit(False)).when(c.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("no bool: "), c)).cast("boolean"))
        elif kind.name == "uuid":
            c = F.when(c.isNull() | c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lower(c)).otherwise(F.raise_error(F.concat(F.lit("no uuid: "), c)))
        elif kind.name != "text":
            c = F.trim(c).cast(kind.spark)
        out.append(c.alias(name))
    return raw.select(*out)


def copy_from(spark: SparkSession, path: str, columns: list[tuple[str, SqlType]], fmt: str = "text", header: bool = False, delimiter: str | None = None, quote: str = '"', escape: str | None = None, null: str | None = None) -> DataFrame:
    """Rows of a COPY file. Text: tabs, \\N for NULL, backslash escapes. CSV: an empty unquoted field is NULL."""
    fields = schema([(name, SqlType("text", 25)) for name, _ in columns])
    if fmt == "csv":
        raw = spark.read.schema(fields).csv(path, header=header, sep=delimiter or ",", quote=quote, escape=escape or quote, nullValue=null or "", emptyValue="", multiLine=True, mode="FAILFAST", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        return _typed(raw, columns)
    if fmt != "text":
        raise DataError(f"COPY format {fmt!r} is not supported", "22023")
    null = "\\N" if null is None else null
    parts = F.split(F.col("value"), delimiter or "\t", -1)
    lines = spark.read.text(path)
    width = len(columns)
    checked = F.when(F.size(parts) == width, parts).otherwise(F.raise_error(F.concat(F.lit(f"a row has not {width} columns: "), F.col("value"))).cast("array<string>"))

    def plain(c):
        c = F.regexp_replace(c, r"\\\\", "\0")  # a doubled backslash waits as NUL, which no text value holds
        for mark, char in (("t", "\t"), ("n", "\n"), ("r", "\r")):
            c = F.regexp_replace(c, rf"\\{mark}", char)
        return F.translate(c, "\0", "\\")

    raw = lines.select(checked.alias("p")).select(*(F.when(F.get("p", F.lit(i)) != F.lit(null), plain(F.get("p", F.lit(i)))).alias(name) for i, (name, _) in enumerate(columns)))
    return _typed(raw, columns)


def rendered(df: DataFrame) -> DataFrame:
    """All columns as the text that COPY writes."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        out.append((F.when(c, F.lit("t")).when(~c, F.lit("f")) if f.dataType.typeName() == "boolean" else c.cast("string")).alias(f.name))
    return df.select(*out)


def copy_to(df: DataFrame, path: str, fmt: str = "text", header: bool = False, delimiter: str | None = None, null: str | None = None) -> None:
    """Write df as COPY does; one part file a partition."""
    text = rendered(df)
    if fmt == "csv":
        text.write.csv(path, header=header, sep=delimiter or ",", nullValue=null or "", emptyValue='""', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        return
    null = "\\N" if null is None else null

    def escaped(c):
        c = F.regexp_replace(c, r"\\", r"\\\\")
        for mark, char in (("t", "\t"), ("n", "\n"), ("r", "\r")):
            c = F.regexp_replace(c, char, rf"\\{mark}")
        return c

    text.select(F.concat_ws(delimiter or "\t", *(F.coalesce(escaped(F.col(c)), F.lit(null)) for c in text.columns)).alias("value")).write.text(path)
