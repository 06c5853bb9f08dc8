"""Set algebra and chain queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chain, setops
from ..sources.loader import load

KV_SQL = """kv AS (
  SELECT 'c' || CAST(c_custkey AS VARCHAR) AS key, 'n' || CAST(c_nationkey AS VARCHAR) AS value, c_custkey AS tuple_id FROM customer
  UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR), 1000000000 + n_nationkey FROM nation
  UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR), r_name, 2000000000 + r_regionkey FROM region)"""


def kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> nation -> region -> its name, as key/value tuples."""
    c, n, r = (load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    key = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    return setops.concat(
        c.select(key("c", "c_custkey").alias("key"), key("n", "c_nationkey").alias("value"), F.col("c_custkey").alias("tuple_id")),
        n.select(key("n", "n_nationkey").alias("key"), key("r", "n_regionkey").alias("value"), (F.lit(1000000000) + F.col("n_nationkey")).cast("long").alias("tuple_id")),
        r.select(key("r", "r_regionkey").alias("key"), F.col("r_name").alias("value"), (F.lit(2000000000) + F.col("r_regionkey")).cast("long").alias("tuple_id")),
    )


def customers(tuples: DataFrame) -> DataFrame:
    return tuples.filter(F.startswith("key", F.lit("c")))


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keys of whole tables that grow with the scale, the first two repeated: each holds keys that another lacks."""
    return tuple(load(spark, sf_dir, t).select(F.col(c).alias("k")) for t, c in (("orders", "o_custkey"), ("lineitem", "l_suppkey"), ("part", "p_partkey")))


def _set(name: str, how: int = 2):
    return lambda spark, sf_dir: getattr(setops, name)(*_keys(spark, sf_dir)[:how])


O, L, P = "SELECT o_custkey AS k FROM orders", "SELECT l_suppkey AS k FROM lineitem", "SELECT p_partkey AS k FROM part"
COUNTS = f"a AS (SELECT k, count(*) AS n FROM ({O}) GROUP BY k), b AS (SELECT k, count(*) AS n FROM ({L}) GROUP BY k), c AS (SELECT k, count(*) AS n FROM ({P}) GROUP BY k)"


def chain_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = kv(spark, sf_dir)
    return chain.read(chain.follow(t, customers(t), 1), projection="source_key_target_value")


def chain_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = kv(spark, sf_dir)
    return chain.read(chain.follow(t, customers(t), 2), projection="target_key_provenance_bundle_summary", kind="key_value")


def chain_seed_to_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = kv(spark, sf_dir)
    return chain.read(chain.follow(t, customers(t), 2), projection="target_key_provenance_bundle_summary", of="seed_to_input", kind="value")


def chain_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = kv(spark, sf_dir)
    return chain.read(chain.follow(t, customers(t), 0, "prefixes"), projection="source_key_target_value")


def chain_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = kv(spark, sf_dir)
    return chain.read(chain.follow_branches(t, customers(t), [("nation", 1, "row"), ("region", 2, "row")]), projection="branch_label_target_value")


def chain_first_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = kv(spark, sf_dir)
    return chain.read(chain.follow_branches(t, t, [("far", 2, "row"), ("near", 1, "row")], "first_non_empty"), projection="branch_label_target_value")


def chain_path_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = kv(spark, sf_dir)
    rows = chain.follow(t, customers(t), 2)
    keep = chain.all_of(chain.bundle_has(key="n3"), chain.path_suffix_equals(["n3", "r3"]), chain.bundle_len_equals(3)) | chain.path_contains(["n5"])
    return chain.read(rows, keep, projection="source_key_target_value")


def chain_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = kv(spark, sf_dir)
    rows = chain.follow(t, customers(t), 2)
    left, right = chain.occurrence(["n7"]), chain.occurrence(["r2"], "last")
    return chain.read(rows, chain.within(chain.distance(left, right), 0, 2), projection="target_key_provenance_bundle_occurrence_distance", left=left, right=right)


def chain_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = kv(spark, sf_dir)
    return chain.read(chain.follow(t, customers(t), 2), order=(F.col("source_key"), True), limit=10, projection="source_key_target_value")


def chain_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = kv(spark, sf_dir)
    return chain.read(setops.concat(chain.key_lookup(t, "r1"), chain.key_batch_lookup(t, ["n1", "n2", "zz"])), chain.any_of(chain.key_prefix("n"), chain.key_range("r", "s")))


ONE = f"WITH {KV_SQL}, h AS (SELECT s.key AS source_key, s.value AS source_value, a.key, a.value FROM kv s JOIN kv a ON s.value = a.key WHERE s.key LIKE 'c%')"
TWO = f"WITH {KV_SQL}, h AS (SELECT s.key AS k0, s.value AS v0, a.key AS k1, a.value AS v1, b.key AS k2, b.value AS v2 FROM kv s JOIN kv a ON s.value = a.key JOIN kv b ON a.value = b.key WHERE s.key LIKE 'c%')"
NONE = "CAST(NULL AS VARCHAR) AS source_key"

QUERIES = {
    "set_union_all": _set("concat"),
    "set_union": _set("concat_distinct"),
    "set_intersect": _set("intersect_distinct"),
    "set_intersect_all": _set("intersect_all"),
    "set_except": lambda spark, sf_dir: setops.except_distinct(_keys(spark, sf_dir)[2], _keys(spark, sf_dir)[1]),
    "set_except_all": _set("except_all"),
    "set_symdiff": _set("symmetric_difference_distinct"),
    "set_symdiff_all": _set("symmetric_difference_all", 3),
} | {f.__name__: f for f in (chain_one_hop, chain_two_hop, chain_seed_to_input, chain_prefix, chain_branches, chain_first_branch, chain_path_filters, chain_occurrence, chain_order_limit, chain_lookup)}

ORACLES = {
    "set_union_all": f"{O} UNION ALL {L}",
    "set_union": f"{O} UNION {L}",
    "set_intersect": f"{O} INTERSECT {L}",
    "set_intersect_all": f"{O} INTERSECT ALL {L}",
    "set_except": f"{P} EXCEPT {L}",
    "set_except_all": f"{O} EXCEPT ALL {L}",
    "set_symdiff": f"SELECT k FROM (SELECT DISTINCT 0 AS s, k FROM ({O}) UNION ALL SELECT DISTINCT 1, k FROM ({L})) GROUP BY k HAVING count(*) = 1",
    "set_symdiff_all": f"WITH {COUNTS}, d AS (SELECT k, abs(abs(coalesce(a.n, 0) - coalesce(b.n, 0)) - coalesce(c.n, 0)) AS n FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)), e AS (SELECT k, unnest(range(n)) AS i FROM d) SELECT k FROM e",
    "chain_one_hop": f"{ONE} SELECT source_key, key, value FROM h",
    "chain_two_hop": f"{TWO} SELECT {NONE}, k2 AS key, k0 || '=' || v0 || ' -> ' || k1 || '=' || v1 || ' -> ' || k2 || '=' || v2 AS value FROM h",
    "chain_seed_to_input": f"{TWO} SELECT {NONE}, k2 AS key, v0 || ' -> ' || v1 AS value FROM h",
    "chain_prefix": f"WITH {KV_SQL} SELECT s.key AS source_key, a.key, a.value FROM kv s JOIN kv a ON starts_with(a.key, s.value) WHERE s.key LIKE 'c%'",
    "chain_branches": f"{TWO} SELECT 'nation' AS source_key, k1 AS key, v1 AS value FROM h UNION ALL SELECT 'region', k2, v2 FROM h",
    "chain_first_branch": f"WITH {KV_SQL}, far AS (SELECT s.tuple_id, b.key, b.value FROM kv s JOIN kv a ON s.value = a.key JOIN kv b ON a.value = b.key), near AS (SELECT s.tuple_id, a.key, a.value FROM kv s JOIN kv a ON s.value = a.key) SELECT 'far' AS source_key, key, value FROM far UNION ALL SELECT 'near', key, value FROM near WHERE tuple_id NOT IN (SELECT tuple_id FROM far)",
    "chain_path_filters": f"{TWO} SELECT k0 AS source_key, k2 AS key, v2 AS value FROM h WHERE (k1 = 'n3' AND k2 = 'r3') OR k1 = 'n5'",
    "chain_occurrence": f"{TWO} SELECT {NONE}, k2 AS key, '1' AS value FROM h WHERE k1 = 'n7' AND k2 = 'r2'",
    "chain_order_limit": f"{TWO} SELECT k0 AS source_key, k2 AS key, v2 AS value FROM h ORDER BY k0 DESC, k2 LIMIT 10",
    "chain_lookup": f"WITH {KV_SQL} SELECT {NONE}, key, value FROM kv WHERE key IN ('r1', 'n1', 'n2')",
}
