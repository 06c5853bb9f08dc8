from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodestone.functions import semantics
from lodestone.operators import chain, pairs, setops
from lodestone.streaming import upsert
from lodestone.storage import Store


def test_avg_and_sum(spark):
    df = spark.createDataFrame([(1, Decimal("1.00"), 1), (2, Decimal("2.00"), 2**62), (4, None, 2**62)], "i int, d decimal(10,2), b long")
    out = df.agg(semantics.pg_sum(df, "i").alias("i"), semantics.pg_sum(df, "b").alias("b"), semantics.pg_avg(df, "d").alias("d"), semantics.pg_avg(df, "i").alias("a")).first()
    assert out["i"] == 7 and out["b"] == Decimal(2**63 + 1) and out["d"] == Decimal("1.5") and out["a"] == Decimal("2.3333333333333333")
    empty = df.filter("i > 9")
    assert tuple(empty.agg(semantics.pg_sum(empty, "i"), semantics.pg_avg(empty, "d")).first()) == (None, None)


def test_like(spark):
    df = spark.createDataFrame([("a_b",), ("axb",), ("a%b",), (None,)], "t string")
    hit = lambda p: [r[0] for r in df.filter(semantics.pg_like(F.col("t"), p)).collect()]
    assert hit("a\\_b") == ["a_b"] and hit("a_b") == ["a_b", "axb", "a%b"] and hit("\\ax%") == ["axb"] and hit("a%") == ["a_b", "axb", "a%b"]


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_set_algebra(spark):
    a, b, c = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ([1, 1, 1, 2, None], [1, 3, None], [1, 2, 2]))
    assert bag(setops.symmetric_difference_all(a, b, c)) == bag(spark.createDataFrame([(1,), (2,), (3,)], "k int"))
    assert bag(setops.symmetric_difference_distinct(a, b, c)) == [(3,)]
    assert bag(setops.except_all(a, b)) == [(1,), (1,), (2,)]
    assert bag(setops.intersect_all(a, b)) == [(1,), (None,)]


@pytest.fixture
def kv(spark):
    return spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("c", "zz", 3), ("ab", "x", 4)], "key string, value string, tuple_id long")


def test_chain_paths(kv):
    rows = chain.follow(kv, kv.filter("key = 'a'"), 4)
    r = rows.select(chain.summary().alias("s"), chain.summary("seed_to_input", "value").alias("v"), "terminal").first()
    assert r["s"] == "a -> b -> a -> b -> a" and r["v"] == "b -> a -> b -> a" and r["terminal"] == 3
    assert chain.follow(kv, kv.filter("key = 'c'"), 1).isEmpty()


@pytest.mark.parametrize(("column", "want"), [
    (lambda: chain.occurrence(["a", "b"], "first"), 0), (lambda: chain.occurrence(["a", "b"], "last"), 2), (lambda: chain.occurrence(["a", "b"], 1), 2), (lambda: chain.occurrence(["a", "b", "a"], "last"), 2),
    (lambda: chain.occurrence([]), None), (lambda: chain.occurrence(["a"] * 9), None), (lambda: chain.distance(chain.occurrence(["b"], "last"), chain.occurrence(["a"])), None),
    (lambda: chain.distance(chain.occurrence(["a"]), chain.occurrence(["b"], "last")), 3), (lambda: chain.path_pair_at_distance("b", "b", 2), True), (lambda: chain.within(chain.occurrence(["b"]), 3, 1), False),
    (lambda: chain.path_suffix_equals(["b", "a"]), True), (lambda: chain.path_prefix_equals([]), False), (lambda: chain.path_count_at_least(["a"], 4), False), (lambda: chain.bundle_count_at_least(3, key="a"), True),
])
def test_occurrences(kv, column, want):
    assert chain.follow(kv, kv.filter("key = 'a'"), 4).select(column().alias("x")).first()["x"] == want


def test_path_filters_need_a_path(kv):
    assert chain.read(chain.full_scan(kv), chain.path_contains(["a"])).isEmpty()


def test_prefixes_and_lookup(kv):
    rows = chain.follow(kv, kv.filter("key = 'b'"), 0, "prefixes")
    assert bag(rows.select("source_key", "key")) == [("b", "a"), ("b", "ab")]
    assert bag(chain.key_batch_lookup(kv, ["c", "nope", "a"]).select("pos", "key")) == [(0, "c"), (2, "a")]


def test_prefixes_are_an_equi_join(spark):
    kv = spark.createDataFrame([("a", "b", 1), ("b", "", 2), ("bé😀", "bé", 3), ("", "none", 4), (None, "b", 5), ("c", None, 6), ("bé", "bé😀", 7)], "key string, value string, tuple_id long")
    rows = chain.follow(kv, kv, 0, "prefixes")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    every = [tuple(r) for r in kv.collect()]
    assert bag(rows.select("pos", "key")) == sorted(((i, k) for _, v, i in every for k, _, _ in every if v is not None and k is not None and k.startswith(v)), key=repr)


def test_visible(spark):
    kv = spark.createDataFrame([("a", 1, None), ("b", 1, 3), ("c", 4, None)], "key string, created_by long, deleted_by long")
    assert [bag(chain.visible(kv, s).select("key")) for s in (2, 3, 4)] == [[("a",), ("b",)], [("a",)], [("a",), ("c",)]]


def test_upsert_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, at int, v string").write.parquet(str(src))
    store = Store(spark)
    sink = upsert.Upsert(store, "t", ["k"], "at")
    upsert.run(spark.readStream.schema("k int, at int, v string").parquet(str(src)), sink, str(tmp_path / "cp"))
    sink(spark.createDataFrame([(2, 5, "d"), (3, 1, None)], "k int, at int, v string"), 7)
    sink(spark.createDataFrame([(2, 9, "again")], "k int, at int, v string"), 7)
    assert bag(store.read(store.latest("t"))) == [(1, 2, "b"), (2, 5, "d"), (3, 1, None)]


def grouped(spark):
    """Groups of 0, 1 and many rows, nulls in key, order and value, equal orders, a repeated row."""
    rows = [(i % 3, i // 2, None if i % 5 == 0 else f"v{i}") for i in range(60)] + [(None, 1, "n"), (None, 2, "n"), (1, None, "o"), (7, 1, "one"), (8, 1, "same"), (8, 1, "same"), (8, 2, None)]
    return spark.createDataFrame(rows, "g int, x int, v string")


@pytest.mark.parametrize("equal", [False, True])
@pytest.mark.parametrize("block", [1, 4, 1024])
@pytest.mark.parametrize(("low", "high"), [(["x"], ["x"]), (["v", "x"], ["x", "v"]), (["g"], ["v"])])
def test_ordered_pairs(spark, monkeypatch, equal, block, low, high):
    monkeypatch.setattr(pairs, "BLOCK", block)
    df = grouped(spark)
    all_rows = df.collect()
    want = [(tuple(a[c] for c in low), tuple(b[c] for c in high)) for a in all_rows for b in all_rows if None not in (a["g"], a["x"], b["g"], b["x"]) and a["g"] == b["g"] and (a["x"] < b["x"] or equal and a["x"] == b["x"])]
    got = pairs.ordered_pairs(df, ["g"], "x", low, high, equal).collect()
    assert sorted(((tuple(r["low"]), tuple(r["high"])) for r in got), key=repr) == sorted(want, key=repr)
    keyed = pairs.ordered_pairs(df, ["g", "v"], "x", low, high, equal).count()
    assert keyed == sum(1 for a in all_rows for b in all_rows if None not in (*a, *b) and (a["g"], a["v"]) == (b["g"], b["v"]) and (a["x"] < b["x"] or equal and a["x"] == b["x"]))


def test_pairs_of_one_key_are_dealt_over_all_tasks(spark):
    """A plain join makes all of these in the one task of their key."""
    df = pairs.ordered_pairs(spark.range(6000).withColumn("g", F.lit(1)), ["g"], "id", ["id"], ["id"])
    made = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(made) == 6000 * 5999 // 2 and len(made) == 4 and max(made) < sum(made) / 2
