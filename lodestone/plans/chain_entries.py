"""One query and its SQL for each named source, filter, order and projection of the chain algebra, over chains of six hops.

The tuples are those of `chains`, and each region's name leads back to a nation (three of them to the same one), so chains are endless and keys recur in them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chain, chain_names, setops
from ..sources.loader import load
from .chains import KV_SQL, customers, kv

HOPS = 6
RING_SQL = f"{KV_SQL}, ring AS (SELECT key, value, tuple_id FROM kv UNION ALL SELECT r_name, 'n' || CAST(CASE WHEN r_regionkey < 3 THEN 1 ELSE r_regionkey END AS VARCHAR), 3000000000 + r_regionkey FROM region)"


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = load(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.concat(F.lit("n"), F.when(F.col("r_regionkey") < 3, F.lit(1)).otherwise(F.col("r_regionkey")).cast("string")).alias("value"), (F.lit(3000000000) + F.col("r_regionkey")).cast("long").alias("tuple_id"))
    return setops.concat(kv(spark, sf_dir), back)


def rows(spark: SparkSession, sf_dir: str, hops: int = HOPS) -> DataFrame:
    t = ring(spark, sf_dir)
    return chain.follow(t, customers(t), hops)


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ring(spark, sf_dir)
    return chain.follow_branches(t, customers(t), [("near", 1, "row"), ("far", 4, "row")])


def walk_sql(hops: int = HOPS, prefixes: bool = False) -> str:
    """SQL for `h`: the tuples t0 ... of each chain as k0, v0 ..., the lists ks and vs of them, and pos."""
    last = hops + prefixes
    joins = "".join(f" JOIN ring t{i} ON " + (f"starts_with(t{i}.key, t{i - 1}.value)" if prefixes and i == last else f"t{i - 1}.value = t{i}.key") for i in range(1, last + 1))
    cols = ", ".join(f"t{i}.key AS k{i}, t{i}.value AS v{i}" for i in range(last + 1))
    lists = ", ".join(f"[{', '.join(f't{i}.{c}' for i in range(last + 1))}] AS {n}" for c, n in (("key", "ks"), ("value", "vs")))
    return f"WITH {RING_SQL}, h AS (SELECT t0.tuple_id AS pos, {cols}, {lists} FROM ring t0{joins} WHERE t0.key LIKE 'c%')"


def path_sql(of: str = "full", path: str = "key") -> str:
    s = {"key": "ks", "value": "vs", "key_value": "list_transform(range(1, len(ks) + 1), lambda j: ks[j] || '=' || vs[j])"}[path]
    return f"({s})" if of == "full" else f"({s})[1:len(ks) - 1]"


def starts_sql(pattern: list[str], of: str = "full", path: str = "key") -> str:
    s, m = path_sql(of, path), len(pattern)
    return f"list_filter(range(0, len({s}) - {m - 1}), lambda i: ({s})[i + 1:i + {m}] = {pattern!r})"


def place_sql(pattern: list[str], which, of: str = "full", path: str = "key") -> str:
    n = {"first": 1, "last": -1}.get(which, which + 1 if isinstance(which, int) and which >= 0 else which)
    return f"({starts_sql(pattern, of, path)})[{n}]"


def occurrence_sql(kind: str, check: str, pattern, right_pattern=None, index=0, right_index=0, want=0, right_want=0, of="full", path="key") -> str:
    left, right = chain_names.picked(kind, check)
    here = place_sql(pattern, index if left == "nth" else left, of, path)
    there = right and place_sql(right_pattern if "Mixed" in kind else pattern, right_index if right == "nth" else right, of, path)
    test = lambda x, n: f"{x} BETWEEN {n[0]} AND {n[1]}" if check.endswith("Within") else f"{x} = {n}"
    if check.startswith("Distance"):
        return f"{there} >= {here} AND " + test(f"({there} - {here})", want)
    return test(here, want) + (f" AND {test(there, right_want)}" if there else "")


def snake(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
LAST = f"k{HOPS}"


def _filter(name: str, sql: str, *args, **more) -> None:
    QUERIES[f"chain_filter_{snake(name)}"] = lambda spark, sf_dir: chain.read(rows(spark, sf_dir), chain_names.FILTERS[name](*args, **more), projection="source_key_target_value")
    ORACLES[f"chain_filter_{snake(name)}"] = f"{walk_sql()} SELECT k0 AS source_key, {LAST} AS key, v{HOPS} AS value FROM h WHERE {sql}"


for _name in chain_names.FOLLOWS:
    _hops, _terminal = chain_names.FOLLOWS[_name]
    _end = _hops + (_terminal == "prefixes")
    QUERIES[f"chain_source_{snake(_name)}"] = lambda spark, sf_dir, name=_name: chain.read(chain_names.follow(name, t := ring(spark, sf_dir), customers(t)), projection="source_key_target_value")
    ORACLES[f"chain_source_{snake(_name)}"] = f"{walk_sql(_hops, _terminal == 'prefixes')} SELECT k0 AS source_key, k{_end} AS key, v{_end} AS value FROM h"

_filter("KeyPrefix", f"starts_with({LAST}, 'A')", "A")
_filter("SourceKeyPrefix", "starts_with(k0, 'c1')", "c1")
_filter("ProvenanceKeyPrefix", "starts_with(k1, 'n1')", "hop:1", "n1")
_filter("ProvenanceBundleKeyEquals", "list_contains(ks[1:6], 'n7')", "n7", of="seed_to_input")
_filter("ProvenanceBundleKeyCountAtLeast", "len(list_filter(ks, lambda x: x = 'r1')) >= 2", "r1", 2)
_filter("ProvenanceBundleKeyPrefix", "len(list_filter(ks, lambda x: starts_with(x, 'n2'))) > 0", "n2")
_filter("KeyRange", f"{LAST} >= 'AM' AND {LAST} < 'B'", "AM", "B")
_filter("ValueEquals", f"v{HOPS} = 'n4'", "n4")
_filter("SourceValueEquals", "v0 = 'n9'", "n9")
_filter("ProvenanceValueEquals", "v5 = 'AMERICA'", "terminal_input", "AMERICA")
_filter("ProvenanceBundleValueEquals", "list_contains(vs, 'r3')", "r3")
_filter("ProvenanceBundleValueCountAtLeast", "len(list_filter(vs, lambda x: x = 'r4')) >= 2", "r4", 2)
_filter("ProvenanceBundleKeyValueEquals", "list_contains(list_transform(range(1, 8), lambda j: ks[j] || '=' || vs[j]), 'n7=r2')", "n7", "r2")
_filter("ProvenanceBundleKeyValueCountAtLeast", "len(list_filter(range(1, 8), lambda j: ks[j] = 'r4' AND vs[j] = 'MIDDLE EAST')) >= 2", "r4", "MIDDLE EAST", 2)
_filter("ProvenanceBundlePathEquals", "vs = ['n6', 'r1', 'AMERICA', 'n1', 'r1', 'AMERICA', 'n1']", ["n6", "r1", "AMERICA", "n1", "r1", "AMERICA", "n1"], kind="value")
_filter("ProvenanceBundlePathContains", f"len({starts_sql(['r1', 'AMERICA', 'n1'])}) > 0", ["r1", "AMERICA", "n1"])
_filter("ProvenanceBundlePathCountAtLeast", f"len({starts_sql(['r1', 'AMERICA'])}) >= 2", ["r1", "AMERICA"], 2)
_filter("ProvenanceBundlePathPairAtDistance", "len(list_filter(range(1, 5), lambda i: ks[i] = 'r1' AND ks[i + 3] = 'r1')) > 0", "r1", "r1", 3)
_filter("ProvenanceBundlePathSuffixEquals", "ks[6:7] = ['r4', 'MIDDLE EAST']", ["r4", "MIDDLE EAST"])
_filter("ProvenanceBundlePathPrefixEquals", "vs[1:2] = ['n5', 'r0']", ["n5", "r0"], kind="value")
_filter("ProvenanceBundlePathSliceEquals", "ks[3:4] = ['r2', 'ASIA']", 2, ["r2", "ASIA"])
_filter("ProvenanceBundlePathSegmentEquals", "k3 || '=' || v3 = 'EUROPE=n3'", 3, "EUROPE=n3", kind="key_value")
_filter("ProvenanceBundleLenEquals", "len(ks) - 1 = 6", 6, of="seed_to_input")
QUERIES["chain_filter_branch_label_equals"] = lambda spark, sf_dir: chain.read(branches(spark, sf_dir), chain_names.FILTERS["BranchLabelEquals"]("far"), projection="branch_label_target_value")
ORACLES["chain_filter_branch_label_equals"] = f"{walk_sql(4)} SELECT 'far' AS source_key, k4 AS key, v4 AS value FROM h"
QUERIES["chain_filter_all"] = lambda spark, sf_dir: chain.read(rows(spark, sf_dir), chain_names.FILTERS["All"](chain.key_prefix("A"), chain.bundle_has(key="r2"), chain.source_key_prefix("c")), projection="source_key_target_value")
ORACLES["chain_filter_all"] = f"{walk_sql()} SELECT k0 AS source_key, {LAST} AS key, v{HOPS} AS value FROM h WHERE starts_with({LAST}, 'A') AND list_contains(ks, 'r2') AND starts_with(k0, 'c')"
QUERIES["chain_filter_any"] = lambda spark, sf_dir: chain.read(rows(spark, sf_dir), chain_names.FILTERS["Any"](chain.bundle_has(key="r4"), chain.source_key_prefix("c2")), projection="source_key_target_value")
ORACLES["chain_filter_any"] = f"{walk_sql()} SELECT k0 AS source_key, {LAST} AS key, v{HOPS} AS value FROM h WHERE list_contains(ks, 'r4') OR starts_with(k0, 'c2')"

# Arguments by kind: patterns, indexes, and what At, Within, Distance and DistanceWithin ask for.
ONE, TWO = ["r1"], ["r1", "AMERICA"]
_asked: dict[str, tuple[dict, dict]] = {
    "FirstOccurrence": ({"pattern": ONE}, {"At": {"want": 2}, "Within": {"want": (3, 5)}}),
    "LastOccurrence": ({"pattern": TWO}, {"At": {"want": 5}, "Within": {"want": (3, 5)}}),
    "Occurrence": ({"pattern": ONE, "index": 1}, {"At": {"want": 5}, "Within": {"want": (4, 6)}, "Distance": {"index": 0, "right_index": 1, "want": 3}, "DistanceWithin": {"index": 0, "right_index": 1, "want": (1, 3)}}),
    "OccurrencePair": ({"pattern": ONE, "index": 0, "right_index": 1}, {"At": {"want": 2, "right_want": 5}, "Within": {"want": (1, 2), "right_want": (5, 6)}}),
    "FirstOccurrenceToOccurrence": ({"pattern": TWO, "right_index": 1}, {"At": {"want": 2, "right_want": 5}, "Within": {"want": (0, 2), "right_want": (3, 9)}}),
    "OccurrenceToLast": ({"pattern": ONE, "index": 0}, {"At": {"want": 5, "right_want": 5}, "Within": {"want": (2, 5), "right_want": (5, 5)}, "Distance": {"want": 0}}),
    "MixedOccurrence": ({"pattern": ["AMERICA"], "right_pattern": ONE, "index": 0, "right_index": 1}, {"At": {"want": 3, "right_want": 5}, "Within": {"want": (3, 3), "right_want": (4, 6)}, "Distance": {"want": 2}, "DistanceWithin": {"want": (0, 2)}}),
    "FirstMixedOccurrence": ({"pattern": ["n1"], "right_pattern": ["AMERICA"]}, {"At": {"want": 4, "right_want": 6}, "Within": {"want": (1, 4), "right_want": (3, 6)}, "Distance": {"want": 2}, "DistanceWithin": {"want": (0, 2)}}),
    "LastMixedOccurrence": ({"pattern": ONE, "right_pattern": ["n1"]}, {"At": {"want": 5, "right_want": 4}, "Within": {"want": (4, 5), "right_want": (1, 4)}, "Distance": {"pattern": ["n1"], "right_pattern": ONE, "want": 1}, "DistanceWithin": {"pattern": ["n1"], "right_pattern": ONE, "want": (0, 1)}}),
    "FirstMixedOccurrenceToOccurrence": ({"pattern": ["AMERICA"], "right_pattern": ONE, "right_index": 0}, {"At": {"want": 3, "right_want": 2}, "Within": {"want": (3, 6), "right_want": (5, 5)}, "Distance": {"right_index": 1, "want": 2}, "DistanceWithin": {"right_index": 1, "want": (2, 2)}}),
    "OccurrenceToLastMixed": ({"pattern": ["ASIA"], "right_pattern": TWO, "index": 0}, {"At": {"want": 3, "right_want": 5}, "Within": {"want": (0, 3), "right_want": (4, 5)}, "Distance": {"want": 2}, "DistanceWithin": {"want": (1, 4)}}),
}
for _kind, (_base, _checks) in _asked.items():
    for _check in chain_names.CHECKS:
        if f"ProvenanceBundlePath{_kind}{_check}" in chain_names.FILTERS:
            _more = _base | _checks.get(_check, {"want": 3} if _check == "Distance" else {"want": (0, 3)})
            _filter(f"ProvenanceBundlePath{_kind}{_check}", occurrence_sql(_kind, _check, **_more), **_more)


def _order(name: str, sql: str, args: Callable[[], tuple] = tuple) -> None:
    """Both directions of an order, each with a limit, which makes the order show."""
    text = name not in ("ProvenanceBundlePathOccurrenceOffset", "ProvenanceBundlePathOccurrenceDistance", "ProvenanceBundlePathMixedOccurrenceOffsetPair")
    for way, nulls in (("Asc", "ASC NULLS FIRST"), ("Desc", "DESC NULLS LAST")):
        QUERIES[f"chain_order_{snake(name + way)}"] = lambda spark, sf_dir, way=way: chain.read(chain_names.ordered(rows(spark, sf_dir), name + way, *args()), limit=40, projection="source_key_target_value")
        ORACLES[f"chain_order_{snake(name + way)}"] = f"{walk_sql()} SELECT k0 AS source_key, {LAST} AS key, v{HOPS} AS value FROM h ORDER BY " + (f"coalesce({sql}, '')" if text else f"({sql})") + f" {nulls}, {LAST}, pos LIMIT 40"


_order("Key", LAST)
_order("Value", f"v{HOPS}")
_order("SourceKey", "k0")
_order("SourceValue", "v0")
_order("ProvenanceKey", "k1", lambda: ("hop:1",))
_order("ProvenanceValue", "v5", lambda: ("terminal_input",))
_order("ProvenanceBundleKeyPath", "array_to_string(ks, ' -> ')")
_order("ProvenanceBundleValuePath", "array_to_string(vs[1:6], ' -> ')", lambda: ("seed_to_input",))
_order("ProvenanceBundlePathOccurrenceOffset", place_sql(ONE, "first"), lambda: (chain.occurrence(ONE),))
_distance = f"CASE WHEN {place_sql(ONE, 'last')} >= {place_sql(['n1'], 'first')} THEN {place_sql(ONE, 'last')} - {place_sql(['n1'], 'first')} END"
_order("ProvenanceBundlePathOccurrenceDistance", _distance, lambda: (chain.occurrence(["n1"]), chain.occurrence(ONE, "last")))
_pair = f"CASE WHEN {place_sql(ONE, 'first')} IS NOT NULL AND {place_sql(['AMERICA'], 'last')} IS NOT NULL THEN {place_sql(ONE, 'first')} * 100 + {place_sql(['AMERICA'], 'last')} END"
_order("ProvenanceBundlePathMixedOccurrenceOffsetPair", _pair, lambda: (chain.occurrence(ONE), chain.occurrence(["AMERICA"], "last")))
for _way, _sql in (("Asc", "ASC"), ("Desc", "DESC")):
    QUERIES[f"chain_order_{snake('BranchLabel' + _way)}"] = lambda spark, sf_dir, way=_way: chain.read(chain_names.ordered(branches(spark, sf_dir), "BranchLabel" + way), limit=40, projection="branch_label_target_value")
    ORACLES[f"chain_order_{snake('BranchLabel' + _way)}"] = f"{walk_sql(4)} SELECT source_key, key, value FROM (SELECT 'near' AS source_key, k1 AS key, v1 AS value, pos FROM h UNION ALL SELECT 'far', k4, v4, pos FROM h) ORDER BY source_key {_sql}, key, pos LIMIT 40"


def _projection(name: str, source_key: str, key: str, value: str, args: Callable[[], dict] = dict) -> None:
    QUERIES[f"chain_project_{name}"] = lambda spark, sf_dir: chain.read(rows(spark, sf_dir), projection=name, **args())
    ORACLES[f"chain_project_{name}"] = f"{walk_sql()} SELECT CAST({source_key} AS VARCHAR) AS source_key, CAST({key} AS VARCHAR) AS key, CAST({value} AS VARCHAR) AS value FROM h"


_projection("key_value", "NULL", LAST, f"v{HOPS}")
_projection("key_only", "NULL", LAST, "NULL")
_projection("value_only", "NULL", "NULL", f"v{HOPS}")
_projection("source_key_target_value", "k0", LAST, f"v{HOPS}")
_projection("source_value_only", "NULL", "NULL", "v0")
_projection("target_key_source_value", "NULL", LAST, "v0")
_projection("target_key_provenance_value", "NULL", LAST, "v2", lambda: {"name": "hop:2"})
_projection("target_key_provenance_summary", "NULL", LAST, "array_to_string(vs, ' -> ')", lambda: {"kind": "value"})
_projection("target_key_provenance_bundle_summary", "NULL", LAST, f"array_to_string({path_sql('seed_to_input', 'key_value')}, ' -> ')", lambda: {"of": "seed_to_input", "kind": "key_value"})
_projection("target_key_provenance_bundle_occurrence_offset", "NULL", LAST, place_sql(ONE, "last"), lambda: {"place": chain.occurrence(ONE, "last")})
_projection("target_key_provenance_bundle_occurrence_distance", "NULL", LAST, _distance, lambda: {"left": chain.occurrence(["n1"]), "right": chain.occurrence(ONE, "last")})
_projection("target_key_provenance_bundle_mixed_occurrence_offset_pair", "NULL", LAST, f"{place_sql(ONE, 'first')} || ',' || {place_sql(['AMERICA'], 'last')}", lambda: {"left": chain.occurrence(ONE), "right": chain.occurrence(["AMERICA"], "last")})
