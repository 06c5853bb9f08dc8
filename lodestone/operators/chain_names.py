"""The chain algebra by name: every source that follows values, filter and order, each a composition of `chain`'s expressions.

A filter on occurrences picks one occurrence of a pattern, or two of one pattern or of two (Mixed), and asks where they begin (At, Within) or
how far the second is from the first (Distance, DistanceWithin); OCCURRENCES says which two each name picks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chain

# Sources that follow values, as (hops, terminal).
FOLLOWS: dict[str, tuple[int, str]] = {
    "FollowValueKeyRefs": (1, "row"),
    "FollowValueKeyPrefixes": (0, "prefixes"),
    "FollowValueKeyRefPrefixes": (1, "prefixes"),
    "FollowValueKeyRefValueKeyRefs": (2, "row"),
    "FollowValueKeyRefValueKeyPrefixes": (2, "prefixes"),
    "FollowValueKeyRefValueKeyRefPrefixes": (3, "prefixes"),
    "FollowValueKeyRefValueKeyRefValueKeyRefs": (5, "row"),
    "FollowValueKeyRefValueKeyRefValueKeyPrefixes": (4, "prefixes"),
    "FollowValueKeyRefValueKeyRefValueKeyRefPrefixes": (5, "prefixes"),
}
# What filters on occurrences pick: (left, right), "nth" as the caller says; right None where only one is asked for.
OCCURRENCES: dict[str, tuple] = {
    "FirstOccurrence": ("first", None),
    "LastOccurrence": ("last", None),
    "Occurrence": ("nth", None),
    "OccurrencePair": ("nth", "nth"),
    "FirstOccurrenceToOccurrence": ("first", "nth"),
    "OccurrenceToLast": ("nth", "last"),
    "MixedOccurrence": ("nth", "nth"),
    "FirstMixedOccurrence": ("first", "first"),
    "LastMixedOccurrence": ("last", "last"),
    "FirstMixedOccurrenceToOccurrence": ("first", "nth"),
    "OccurrenceToLastMixed": ("nth", "last"),
}
# The pairs that distances of these names are between.
NEIGHBOURS: dict[str, tuple] = {"FirstOccurrence": (0, 1), "LastOccurrence": (-2, -1), "Occurrence": ("nth", "nth")}
CHECKS = ("At", "Within", "Distance", "DistanceWithin")


def follow(name: str, kv: DataFrame, seeds: DataFrame) -> DataFrame:
    return chain.follow(kv, seeds, *FOLLOWS[name])


def picked(kind: str, check: str) -> tuple:
    """The two selectors of an occurrence filter."""
    return NEIGHBOURS.get(kind, OCCURRENCES[kind]) if check.startswith("Distance") else OCCURRENCES[kind]


def occurrence_filter(kind: str, check: str, pattern: list[str], right_pattern: list[str] | None = None, index: int = 0, right_index: int = 0, want=0, right_want=0, of: chain.Bundle = "full", path: chain.Segment = "key") -> Column:
    """A filter ProvenanceBundlePath<kind><check>. want: a place, a distance, or a range (low, high); right_want likewise for the second
    occurrence. Rows without the occurrences asked for do not pass."""
    left, right = picked(kind, check)
    here = chain.occurrence(pattern, index if left == "nth" else left, of, path)
    there = None if right is None else chain.occurrence(right_pattern if "Mixed" in kind else pattern, right_index if right == "nth" else right, of, path)
    test = lambda place, n: chain.within(place, *n) if check.endswith("Within") else chain.at(place, n)
    if check.startswith("Distance"):
        return test(chain.distance(here, there), want)
    return test(here, want) if there is None else test(here, want) & test(there, right_want)


def _occurrence(kind: str, check: str) -> Callable[..., Column]:
    return lambda *args, **more: occurrence_filter(kind, check, *args, **more)


FILTERS: dict[str, Callable[..., Column]] = {
    "KeyPrefix": chain.key_prefix,
    "SourceKeyPrefix": chain.source_key_prefix,
    "ProvenanceKeyPrefix": chain.provenance_key_prefix,
    "ProvenanceBundleKeyEquals": lambda key, of="full": chain.bundle_has(key=key, of=of),
    "ProvenanceBundleKeyCountAtLeast": lambda key, n, of="full": chain.bundle_count_at_least(n, key=key, of=of),
    "ProvenanceBundleKeyPrefix": chain.bundle_key_prefix,
    "BranchLabelEquals": chain.branch_label_equals,
    "KeyRange": chain.key_range,
    "ValueEquals": chain.value_equals,
    "SourceValueEquals": chain.source_value_equals,
    "ProvenanceValueEquals": chain.provenance_value_equals,
    "ProvenanceBundleValueEquals": lambda value, of="full": chain.bundle_has(value=value, of=of),
    "ProvenanceBundleValueCountAtLeast": lambda value, n, of="full": chain.bundle_count_at_least(n, value=value, of=of),
    "ProvenanceBundleKeyValueEquals": lambda key, value, of="full": chain.bundle_has(key, value, of),
    "ProvenanceBundleKeyValueCountAtLeast": lambda key, value, n, of="full": chain.bundle_count_at_least(n, key, value, of),
    "ProvenanceBundlePathEquals": chain.path_equals,
    "ProvenanceBundlePathContains": chain.path_contains,
    "ProvenanceBundlePathCountAtLeast": chain.path_count_at_least,
    "ProvenanceBundlePathPairAtDistance": chain.path_pair_at_distance,
    "ProvenanceBundlePathSuffixEquals": chain.path_suffix_equals,
    "ProvenanceBundlePathPrefixEquals": chain.path_prefix_equals,
    "ProvenanceBundlePathSliceEquals": chain.path_slice_equals,
    "ProvenanceBundlePathSegmentEquals": chain.path_segment_equals,
    "ProvenanceBundleLenEquals": chain.bundle_len_equals,
    "All": chain.all_of,
    "Any": chain.any_of,
} | {f"ProvenanceBundlePath{kind}{check}": _occurrence(kind, check) for kind in OCCURRENCES for check in CHECKS if kind != "OccurrencePair" or not check.startswith("Distance")}

#: name without Asc or Desc -> (what to sort by, whether it is a number).
ORDER_KEYS: dict[str, tuple[Callable[..., Column], bool]] = {
    "Key": (lambda: F.col("key"), False),
    "Value": (lambda: F.col("value"), False),
    "BranchLabel": (lambda: F.col("branch"), False),
    "SourceKey": (lambda: F.col("source_key"), False),
    "SourceValue": (lambda: F.col("source_value"), False),
    "ProvenanceKey": (lambda name: chain.frame(name)["key"], False),
    "ProvenanceValue": (lambda name: chain.frame(name)["value"], False),
    "ProvenanceBundleKeyPath": (lambda of="full": chain.summary(of, "key"), False),
    "ProvenanceBundleValuePath": (lambda of="full": chain.summary(of, "value"), False),
    "ProvenanceBundlePathOccurrenceOffset": (lambda place: place, True),
    "ProvenanceBundlePathOccurrenceDistance": (chain.distance, True),
    "ProvenanceBundlePathMixedOccurrenceOffsetPair": (lambda left, right: F.when(left.isNotNull() & right.isNotNull(), F.struct(left.alias("l"), right.alias("r"))), True),
}


def ordered(rows: DataFrame, name: str, *args, **more) -> DataFrame:
    """Rows in the order of a name such as `SourceKeyDesc`."""
    desc = name.endswith("Desc")
    by, number = ORDER_KEYS[name[: -4 if desc else -3]]
    return chain.ordered(rows, by(*args, **more), desc, number)
