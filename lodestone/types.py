"""The nine SQL types: names, Spark types, text parsing and rendering."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import types as T

from .errors import DataError


@dataclass(frozen=True)
class SqlType:
    name: str
    oid: int
    precision: int = 0
    scale: int = 0

    @property
    def spark(self) -> T.DataType:
        if self.name == "numeric":
            return T.DecimalType(self.precision, self.scale)
        return SPARK[self.name]

    @property
    def ddl(self) -> str:
        return f"numeric({self.precision},{self.scale})" if self.name == "numeric" else self.name


# Type names, their wire numbers and other spellings.
OIDS = {"int2": 21, "int4": 23, "int8": 20, "numeric": 1700, "bool": 16, "text": 25, "date": 1082, "timestamp": 1114, "uuid": 2950}
ALIASES = {"smallint": "int2", "int": "int4", "integer": "int4", "bigint": "int8", "decimal": "numeric", "boolean": "bool", "timestamp without time zone": "timestamp", "serial": "int4", "bigserial": "int8"}
TRUE_WORDS = frozenset({"t", "true", "y", "yes", "on", "1"})
FALSE_WORDS = frozenset({"f", "false", "n", "no", "off", "0"})
SPARK = {"int2": T.ShortType(), "int4": T.IntegerType(), "int8": T.LongType(), "bool": T.BooleanType(), "text": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "uuid": T.StringType()}
RANGES = {"int2": 1 << 15, "int4": 1 << 31, "int8": 1 << 63}
UUID = re.compile(r"\A\{?[0-9a-fA-F]{8}-?(?:[0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}\}?\Z")


def sql_type(text: str) -> SqlType:
    """The type that text names, as `numeric(12, 2)` or `integer`; bare numeric is numeric(38,0)."""
    m = re.fullmatch(r"\s*([A-Za-z0-9 ]+?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*", text)
    name = ALIASES.get(m[1].lower(), m[1].lower()) if m else ""
    if name not in OIDS or (m[2] and name != "numeric"):
        raise DataError(f"type {text!r} is not supported", "42704")
    if name != "numeric":
        return SqlType(name, OIDS[name])
    precision, scale = int(m[2] or 38), int(m[3] or 0)
    if not 1 <= precision <= 38 or not 0 <= scale <= precision:
        raise DataError(f"numeric precision {precision} or scale {scale} is out of range", "22023")
    return SqlType(name, OIDS[name], precision, scale)


def parse(value: str | None, kind: SqlType):
    """A value of kind from its text; None stays None."""
    if value is None:
        return None
    text = value.strip() if kind.name != "text" else value
    try:
        if kind.name in RANGES:
            number = int(text)
            if not -RANGES[kind.name] <= number < RANGES[kind.name]:
                raise DataError(f"{text} is out of range for {kind.name}", "22003")
            return number
        if kind.name == "numeric":
            number = Decimal(text).quantize(Decimal(1).scaleb(-kind.scale), ROUND_HALF_UP)
            if len(number.as_tuple().digits) > kind.precision and number:
                raise DataError(f"{text} is out of range for {kind.ddl}", "22003")
            return number
        if kind.name == "bool":
            if text.lower() in TRUE_WORDS:
                return True
            if text.lower() in FALSE_WORDS:
                return False
            raise ValueError
        if kind.name == "date":
            return datetime.date.fromisoformat(text)
        if kind.name == "timestamp":
            return datetime.datetime.fromisoformat(text)
        if kind.name == "uuid":
            if not UUID.match(text):
                raise ValueError
            raw = re.sub("[{}-]", "", text.lower())
            return "-".join((raw[:8], raw[8:12], raw[12:16], raw[16:20], raw[20:]))
    except DataError:
        raise
    except (ValueError, ArithmeticError) as e:
        raise DataError(f"{value!r} is no {kind.name}", "22P02") from e
    return text


def render(value) -> str | None:
    """A value's text form."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "t" if value else "f"
    if isinstance(value, datetime.datetime):
        return value.isoformat(" ")
    if isinstance(value, Decimal):
        return format(value, "f")
    return str(value)


def schema(columns: list[tuple[str, SqlType]]) -> T.StructType:
    return T.StructType([T.StructField(name, kind.spark, True, {"sql_type": kind.ddl}) for name, kind in columns])
