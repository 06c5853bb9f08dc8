"""Key/value chains: a row's value is the key of the next row. Sources, path filters, orders and projections.

A resolved row has pos (seed order), branch, source_key, source_value, key, value, tuple_id, path (array of key, value,
tuple_id from the seed to the row) and terminal (index in path of the terminal input). Rows that no chain made have a null path,
and a null path satisfies no path filter. Every hop is one equi-join on the key; a prefix terminal is one on each key's prefixes.
"""

from __future__ import annotations

from functools import reduce
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import setops

STEP = "struct<key:string,value:string,tuple_id:bigint>"
COLUMNS = ["pos", "branch", "source_key", "source_value", "key", "value", "tuple_id", "path", "terminal"]
Bundle = Literal["full", "seed_to_input"]
Segment = Literal["key", "value", "key_value"]


def visible(kv: DataFrame, snapshot: int) -> DataFrame:
    """Tuples that a snapshot sees: created at or before it, not deleted by it."""
    return kv.filter((F.col("created_by") <= snapshot) & (F.col("deleted_by").isNull() | (F.col("deleted_by") > snapshot)))


def _step(prefix: str = "") -> Column:
    return F.struct(*(F.col(prefix + c).alias(c) for c in ("key", "value", "tuple_id"))).cast(STEP)


def _plain(rows: DataFrame) -> DataFrame:
    null = F.lit(None)
    return rows.select(F.col("tuple_id").alias("pos"), null.cast("string").alias("branch"), null.cast("string").alias("source_key"), null.cast("string").alias("source_value"), "key", "value", "tuple_id", null.cast(f"array<{STEP}>").alias("path"), null.cast("int").alias("terminal"))


def full_scan(kv: DataFrame) -> DataFrame:
    return _plain(kv)


def key_lookup(kv: DataFrame, key: str) -> DataFrame:
    return _plain(kv.filter(F.col("key") == key))


def key_batch_lookup(kv: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in the order of keys; a key that is given twice gives its row twice."""
    asked = kv.sparkSession.createDataFrame(list(enumerate(keys)), "ask long, key string")
    found = kv.join(asked, "key")
    return _plain(found.withColumn("tuple_id", F.struct("tuple_id", "ask"))).select(F.col("pos.ask").alias("pos"), *(F.col("tuple_id.tuple_id").alias(c) if c == "tuple_id" else F.col(c) for c in COLUMNS[1:]))


def follow(kv: DataFrame, seeds: DataFrame, hops: int, terminal: Literal["row", "prefixes"] = "row", branch: str | None = None) -> DataFrame:
    """hops times the row whose key is the value so far; then that row, or all rows whose keys start with its value. A miss drops the seed."""
    now = seeds.select(F.col("tuple_id").alias("pos"), F.col("key").alias("source_key"), F.col("value").alias("source_value"), "key", "value", "tuple_id", F.array(_step()).alias("path"))
    nxt = kv.select(*(F.col(c).alias(f"n_{c}") for c in ("key", "value", "tuple_id")))
    for _ in range(hops):
        now = now.join(nxt, F.col("value") == F.col("n_key")).select("pos", "source_key", "source_value", *(F.col(f"n_{c}").alias(c) for c in ("key", "value", "tuple_id")), F.concat("path", F.array(_step("n_"))).alias("path"))
    if terminal == "prefixes":
        at = F.size("path") - 1
        prefix = F.transform(F.sequence(F.lit(0), F.length("n_key")), lambda n: F.substr(F.col("n_key"), F.lit(1), n))
        now = now.join(nxt.withColumn("n_prefix", F.explode(prefix)), F.col("value") == F.col("n_prefix")).select("pos", "source_key", "source_value", *(F.col(f"n_{c}").alias(c) for c in ("key", "value", "tuple_id")), F.concat("path", F.array(_step("n_"))).alias("path"), at.alias("terminal"))
    else:
        now = now.withColumn("terminal", F.lit(max(hops - 1, 0)))
    return now.withColumn("branch", F.lit(branch).cast("string")).select(*COLUMNS)


def follow_branches(kv: DataFrame, seeds: DataFrame, plans: list[tuple[str | None, int, str]], fan_in: Literal["all", "first_non_empty"] = "all") -> DataFrame:
    """Several chains (label, hops, terminal) from each seed: all of them, or each seed's first that finds a row."""
    rows = setops.concat(*(follow(kv, seeds, hops, terminal, label).withColumn("_plan", F.lit(i)) for i, (label, hops, terminal) in enumerate(plans)))
    if fan_in == "first_non_empty":
        rows = rows.withColumn("_first", F.min("_plan").over(Window.partitionBy("pos"))).filter("_plan = _first")
    return rows.select(*COLUMNS)


# path expressions


def bundle(which: Bundle = "full") -> Column:
    path = F.col("path")
    return path if which == "full" else F.slice(path, F.lit(1), F.col("terminal") + 1)


def segments(which: Bundle = "full", kind: Segment = "key") -> Column:
    text = {"key": lambda x: x["key"], "value": lambda x: x["value"], "key_value": lambda x: F.concat(x["key"], F.lit("="), x["value"])}[kind]
    return F.transform(bundle(which), text)


def summary(which: Bundle = "full", kind: Segment = "key") -> Column:
    return F.array_join(segments(which, kind), " -> ")


def frame(name: str) -> Column:
    """The path's tuple at `seed`, `terminal_input` or `hop:n`."""
    place = F.lit(0) if name == "seed" else F.col("terminal") if name == "terminal_input" else F.lit(int(name.partition(":")[2]))
    return F.get("path", place)


def starts(s: Column, pattern: list[str]) -> Column:
    """Places (from 0) where pattern begins in s, overlaps included; none for an empty pattern."""
    n = len(pattern)
    none = F.array().cast("array<int>")
    if not n:
        return F.when(s.isNotNull(), none)
    want = F.array(*map(F.lit, pattern))
    return F.when(s.isNull(), F.lit(None)).when(F.size(s) < n, none).otherwise(F.filter(F.sequence(F.lit(0), F.size(s) - n), lambda i: F.slice(s, i + 1, F.lit(n)) == want))


def occurrence(pattern: list[str], which: int | Literal["first", "last"] = "first", of: Bundle = "full", kind: Segment = "key") -> Column:
    """Where the chosen occurrence begins, counted from 0; a negative number counts from the last; null if there is none."""
    found = starts(segments(of, kind), pattern)
    place = {"first": F.lit(0), "last": F.size(found) - 1}.get(which, F.lit(which) if isinstance(which, int) and which >= 0 else F.size(found) + which if isinstance(which, int) else None)
    return F.get(found, place)


# filters: columns that are true, false or null


def key_prefix(prefix: str) -> Column:
    return F.startswith(F.col("key"), F.lit(prefix))


def source_key_prefix(prefix: str) -> Column:
    return F.startswith(F.col("source_key"), F.lit(prefix))


def provenance_key_prefix(name: str, prefix: str) -> Column:
    return F.startswith(frame(name)["key"], F.lit(prefix))


def provenance_value_equals(name: str, value: str) -> Column:
    return frame(name)["value"] == value


def branch_label_equals(label: str) -> Column:
    return F.col("branch") == label


def key_range(low: str, high: str) -> Column:
    return (F.col("key") >= low) & (F.col("key") < high)


def value_equals(value: str) -> Column:
    return F.col("value") == value


def source_value_equals(value: str) -> Column:
    return F.col("source_value") == value


def _match(x: Column, key: str | None, value: str | None) -> Column:
    parts = [x[c] == v for c, v in (("key", key), ("value", value)) if v is not None]
    return reduce(lambda a, b: a & b, parts)


def bundle_has(key: str | None = None, value: str | None = None, of: Bundle = "full") -> Column:
    return F.exists(bundle(of), lambda x: _match(x, key, value))


def bundle_key_prefix(prefix: str, of: Bundle = "full") -> Column:
    return F.exists(bundle(of), lambda x: F.startswith(x["key"], F.lit(prefix)))


def bundle_count_at_least(n: int, key: str | None = None, value: str | None = None, of: Bundle = "full") -> Column:
    return F.size(F.filter(bundle(of), lambda x: _match(x, key, value))) >= n


def bundle_len_equals(n: int, of: Bundle = "full") -> Column:
    return F.size(bundle(of)) == n


def path_equals(pattern: list[str], of: Bundle = "full", kind: Segment = "key") -> Column:
    return segments(of, kind) == F.array(*map(F.lit, pattern)).cast("array<string>")


def path_count_at_least(pattern: list[str], n: int, of: Bundle = "full", kind: Segment = "key") -> Column:
    return F.size(starts(segments(of, kind), pattern)) >= n


def path_contains(pattern: list[str], of: Bundle = "full", kind: Segment = "key") -> Column:
    return path_count_at_least(pattern, 1, of, kind)


def path_slice_equals(start: int, pattern: list[str], of: Bundle = "full", kind: Segment = "key") -> Column:
    """The pattern stands at `start`; a negative start counts from the path's end. False for an empty pattern."""
    s, n = segments(of, kind), len(pattern)
    if not n:
        return F.when(s.isNotNull(), F.lit(False))
    begin = F.lit(start) if start >= 0 else F.size(s) + start
    return F.when((begin >= 0) & (begin + n <= F.size(s)), F.slice(s, F.greatest(begin, F.lit(0)) + 1, F.lit(n)) == F.array(*map(F.lit, pattern))).otherwise(F.when(s.isNotNull(), F.lit(False)))


def path_prefix_equals(pattern: list[str], of: Bundle = "full", kind: Segment = "key") -> Column:
    return path_slice_equals(0, pattern, of, kind)


def path_suffix_equals(pattern: list[str], of: Bundle = "full", kind: Segment = "key") -> Column:
    return path_slice_equals(-len(pattern), pattern, of, kind)


def path_segment_equals(i: int, value: str, of: Bundle = "full", kind: Segment = "key") -> Column:
    return F.get(segments(of, kind), F.lit(i)) == value


def path_pair_at_distance(left: str, right: str, distance: int, of: Bundle = "full", kind: Segment = "key") -> Column:
    s = segments(of, kind)
    return F.exists(F.transform(s, lambda x, i: (x == left) & F.coalesce(F.get(s, i + distance) == right, F.lit(False))), lambda x: x)


def at(place: Column, n: int) -> Column:
    """The occurrence begins at n."""
    return F.coalesce(place == n, F.lit(False))


def within(place: Column, low: int, high: int) -> Column:
    """It begins from low to high; false for an inverted range."""
    return F.coalesce(place.between(low, high), F.lit(False))


def distance(left: Column, right: Column) -> Column:
    """From one occurrence to another, null if that is backwards or either is missing."""
    return F.when(right >= left, right - left)


def all_of(*filters: Column) -> Column:
    return reduce(lambda a, b: a & b, filters)


def any_of(*filters: Column) -> Column:
    return reduce(lambda a, b: a | b, filters)


# orders and projections


def ordered(rows: DataFrame, by: Column, desc: bool = False, number: bool = False) -> DataFrame:
    """Rows by one key, ties by the target key ascending; a missing text counts as empty, a missing number as less than any."""
    by = by if number else F.coalesce(by, F.lit(""))
    return rows.orderBy(by.desc_nulls_last() if desc else by.asc_nulls_first(), F.col("key").asc(), F.col("pos").asc())


#: name -> (source_key, key, value) of the output, each a column or None.
PROJECTIONS = {
    "key_value": lambda: (None, F.col("key"), F.col("value")),
    "key_only": lambda: (None, F.col("key"), None),
    "value_only": lambda: (None, None, F.col("value")),
    "branch_label_target_value": lambda: (F.col("branch"), F.col("key"), F.col("value")),
    "source_key_target_value": lambda: (F.col("source_key"), F.col("key"), F.col("value")),
    "source_value_only": lambda: (None, None, F.col("source_value")),
    "target_key_source_value": lambda: (None, F.col("key"), F.col("source_value")),
    "target_key_provenance_value": lambda name="seed": (None, F.col("key"), frame(name)["value"]),
    "target_key_provenance_summary": lambda kind="key": (None, F.col("key"), summary("full", kind)),
    "target_key_provenance_bundle_summary": lambda of="full", kind="key": (None, F.col("key"), summary(of, kind)),
    "target_key_provenance_bundle_occurrence_offset": lambda place: (None, F.col("key"), place.cast("string")),
    "target_key_provenance_bundle_occurrence_distance": lambda left, right: (None, F.col("key"), distance(left, right).cast("string")),
    "target_key_provenance_bundle_mixed_occurrence_offset_pair": lambda left, right: (None, F.col("key"), F.concat(left.cast("string"), F.lit(","), right.cast("string"))),
}


def project(rows: DataFrame, projection: str, /, **args) -> DataFrame:
    """(source_key, key, value) strings of a projection."""
    cols = PROJECTIONS[projection](**args)
    return rows.select(*((F.lit(None) if c is None else c).cast("string").alias(n) for n, c in zip(("source_key", "key", "value"), cols, strict=True)))


def read(rows: DataFrame, where: Column | None = None, order: tuple | None = None, limit: int | None = None, projection: str = "key_value", **args) -> DataFrame:
    """Filter, sort, limit, project: in that order."""
    rows = rows if where is None else rows.filter(where)
    rows = rows if order is None else ordered(rows, *order)
    rows = rows if limit is None else rows.limit(limit)
    return project(rows, projection, **args)
