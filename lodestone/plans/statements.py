"""DML, transactions, views, constraints and COPY as queries: each runs statements in a session of its own and returns rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constraints

from ..session import Session
from ..sources import copy_io
from ..sources.loader import load
from ..storage import Store
from ..streaming.upsert import Upsert
from ..types import sql_type

CUSTOMER = [("c_custkey", sql_type("bigint")), ("c_name", sql_type("text")), ("c_nationkey", sql_type("int")), ("c_acctbal", sql_type("numeric(12,2)"))]
NATION = [("n_nationkey", sql_type("int")), ("n_name", sql_type("text")), ("n_regionkey", sql_type("int"))]
COLS = "c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(12,2)) AS c_acctbal"


def _session(spark: SparkSession, sf_dir: str, **tables) -> Session:
    session = Session(spark)
    for name, columns in tables.items():
        session.load(name, load(spark, sf_dir, name), columns)
    return session


def dml_insert_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, nation=NATION)
    return s.sql("INSERT INTO nation (n_nationkey, n_name) VALUES (100, 'X'), (101, NULL) RETURNING n_nationkey, n_name, n_regionkey")


def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, nation=NATION)
    s.sql("INSERT INTO nation VALUES (100, 'it''s', $1)", (7,))
    return s.sql("SELECT * FROM nation")


def dml_update_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, customer=CUSTOMER)
    s.sql("UPDATE customer SET c_acctbal = c_acctbal + 10.50, c_name = 'changed' WHERE c_nationkey = 3 AND c_acctbal < 5000")
    return s.sql("SELECT * FROM customer")


def dml_update_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, customer=CUSTOMER)
    return s.sql("UPDATE customer SET c_nationkey = 99 WHERE c_custkey < 10 RETURNING c_custkey, c_nationkey")


def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, customer=CUSTOMER)
    s.sql("DELETE FROM customer WHERE c_acctbal < 0 OR c_nationkey IN (1, 2)")
    return s.sql("SELECT * FROM customer")


def dml_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, nation=NATION)
    s.sql("TRUNCATE TABLE nation")
    return s.sql("SELECT COUNT(*) FROM nation")


def snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, nation=NATION)
    s.sql("DELETE FROM nation WHERE n_nationkey < 10")
    return s.table("nation", as_of=1)


def transaction_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the writer sees before its commit, and what another session sees."""
    s = _session(spark, sf_dir, nation=NATION)
    other = Session(spark, s.store, s.catalog)
    s.sql("BEGIN")
    s.sql("DELETE FROM nation WHERE n_regionkey = 0")
    own, theirs = s.sql("SELECT * FROM nation"), other.sql("SELECT * FROM nation")
    s.sql("ROLLBACK")
    return own.withColumn("seen_by", F.lit("writer")).unionByName(theirs.withColumn("seen_by", F.lit("other")))


def constraint_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0")
    return constraints.orphans(orders, "o_custkey", customer, "c_custkey").select("o_orderkey", "o_custkey")


def constraint_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.duplicates(load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey"), ("l_partkey", "l_suppkey"))


def constraint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.failing(load(spark, sf_dir, "customer"), "c_acctbal > 100").select("c_custkey")


def view_over_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, customer=CUSTOMER)
    s.sql("CREATE VIEW rich AS SELECT * FROM customer WHERE c_acctbal > 5000")
    s.sql("CREATE VIEW richer AS SELECT * FROM rich WHERE c_acctbal > 8000")
    return s.sql("SELECT * FROM richer")


def matview_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, nation=NATION)
    s.sql("CREATE MATERIALIZED VIEW by_region AS SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey")
    s.sql("INSERT INTO nation VALUES (200, 'NEW', 0)")
    old = s.sql("SELECT * FROM by_region").withColumn("state", F.lit("before"))
    old = s.spark.createDataFrame(old.collect(), old.schema)  # a row a region
    s.sql("REFRESH MATERIALIZED VIEW by_region")
    return old.unionByName(s.sql("SELECT * FROM by_region").withColumn("state", F.lit("after")))


def prepared_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, customer=CUSTOMER)
    s.sql("PREPARE by_nation (int) AS SELECT c_custkey FROM customer WHERE c_nationkey = $1 AND c_acctbal > $2")
    return s.sql("EXECUTE by_nation (4, 100.00)")


def cursor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, customer=CUSTOMER)
    s.sql("DECLARE page CURSOR FOR SELECT c_custkey FROM customer ORDER BY c_custkey DESC")
    s.sql("MOVE FORWARD 5 IN page")
    return s.sql("FETCH 7 FROM page")


def copy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    src = load(spark, sf_dir, "customer").select(F.col("c_custkey"), F.when(F.col("c_custkey") % 4 != 0, F.concat("c_name", F.lit("\t\\x"))).alias("c_name"), "c_acctbal")
    columns = [("c_custkey", sql_type("bigint")), ("c_name", sql_type("text")), ("c_acctbal", sql_type("numeric(12,2)"))]
    copy_io.copy_to(src, f"{store.root}/copy_text")
    return copy_io.copy_from(spark, f"{store.root}/copy_text", columns)


def copy_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    src = load(spark, sf_dir, "customer").select(F.col("c_custkey"), F.concat(F.lit('say "'), "c_name", F.lit('", ')).alias("c_name"), (F.col("c_acctbal") > 0).alias("solvent"))
    copy_io.copy_to(src, f"{store.root}/copy_csv", "csv", header=True)
    return copy_io.copy_from(spark, f"{store.root}/copy_csv", [("c_custkey", sql_type("bigint")), ("c_name", sql_type("text")), ("solvent", sql_type("bool"))], "csv", header=True)


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in two batches into one row a user: the latest event."""
    events = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    store = Store(spark)
    sink = Upsert(store, "latest", ["user_id"], "event_id")
    sink(events.filter("event_id % 2 = 0"), 0)
    sink(events.filter("event_id % 2 = 1 OR event_id < 100"), 1)
    return store.read(store.latest("latest"))


def window_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, customer=CUSTOMER)
    return s.sql("SELECT c_custkey, ROW_NUMBER() OVER o AS rn, LAG(c_custkey) OVER (w ORDER BY c_custkey DESC) AS above FROM customer WINDOW w AS (PARTITION BY c_nationkey), o AS (w ORDER BY c_acctbal, c_custkey)")


def catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, nation=NATION)
    return s.sql("SELECT n.n_nationkey, c.column_name FROM nation n JOIN information_schema.columns c ON n.n_regionkey = c.ordinal_position")


def infoschema_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, nation=NATION)
    return s.sql("SELECT table_name, column_name, ordinal_position, data_type FROM information_schema.columns")


def digest_visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count and an order-free digest of a table's rows."""
    rows = load(spark, sf_dir, "nation").select(F.md5(F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey").cast("binary")).alias("h"))
    return rows.agg(F.count("*").alias("n"), F.max("h").alias("high"), F.min("h").alias("low"))


def digest_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count and the sum of a hash of every row: whatever changes in any row, or any row twice, changes it."""
    row = F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    hashed = F.conv(F.substring(F.md5(row.cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    return load(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.sum(hashed).alias("digest"))


QUERIES = {f.__name__: f for f in (dml_insert_returning, dml_insert, dml_update_add, dml_update_returning, dml_delete, dml_truncate, snapshot_as_of, transaction_overlay, constraint_fk, constraint_unique, constraint_check, view_over_view, matview_refresh, prepared_param, cursor_page, copy_roundtrip, copy_csv_roundtrip, stream_upsert, window_inherited, catalog_join, infoschema_columns, digest_visible_rows, digest_all_rows)}
BY_REGION = "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey"
ORACLES = {
    "window_inherited": "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(c_acctbal AS DECIMAL(12,2)) NULLS LAST, c_custkey) AS BIGINT) AS rn, lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS above FROM customer",
    "catalog_join": "SELECT n_nationkey, c.column_name FROM nation JOIN (VALUES (1, 'n_nationkey'), (2, 'n_name'), (3, 'n_regionkey')) c(i, column_name) ON n_regionkey = c.i",
    "dml_insert_returning": "SELECT CAST(100 AS INT) AS n_nationkey, 'X' AS n_name, CAST(NULL AS INT) AS n_regionkey UNION ALL SELECT 101, NULL, NULL",
    "dml_insert": "SELECT * FROM nation UNION ALL SELECT 100, 'it''s', 7",
    "dml_update_add": "SELECT c_custkey, CASE WHEN hit THEN 'changed' ELSE c_name END AS c_name, c_nationkey, CAST(c_acctbal + CASE WHEN hit THEN 10.50 ELSE 0 END AS DECIMAL(12,2)) AS c_acctbal FROM (SELECT " + COLS + ", c_nationkey = 3 AND c_acctbal < 5000 AS hit FROM customer)",
    "dml_update_returning": "SELECT c_custkey, CAST(99 AS INT) AS c_nationkey FROM customer WHERE c_custkey < 10",
    "dml_delete": f"SELECT {COLS} FROM customer WHERE NOT (c_acctbal < 0 OR c_nationkey IN (1, 2))",
    "dml_truncate": "SELECT CAST(0 AS BIGINT) AS count",
    "snapshot_as_of": "SELECT * FROM nation",
    "transaction_overlay": "SELECT *, 'writer' AS seen_by FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT *, 'other' FROM nation",
    "constraint_fk": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)",
    "constraint_unique": "SELECT l_partkey, l_suppkey, COUNT(*) AS count FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1",
    "constraint_check": "SELECT c_custkey FROM customer WHERE CAST(c_acctbal AS DECIMAL(12,2)) <= 100",
    "view_over_view": f"SELECT {COLS} FROM customer WHERE CAST(c_acctbal AS DECIMAL(12,2)) > 8000",
    "matview_refresh": f"SELECT *, 'before' AS state FROM ({BY_REGION}) UNION ALL SELECT n_regionkey, CASE WHEN n_regionkey = 0 THEN n + 1 ELSE n END, 'after' FROM ({BY_REGION})",
    "prepared_param": "SELECT c_custkey FROM customer WHERE c_nationkey = 4 AND CAST(c_acctbal AS DECIMAL(12,2)) > 100",
    "cursor_page": "SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 7 OFFSET 5",
    "copy_roundtrip": "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_name || chr(9) || chr(92) || 'x' END AS c_name, CAST(c_acctbal AS DECIMAL(12,2)) AS c_acctbal FROM customer",
    "copy_csv_roundtrip": "SELECT c_custkey, 'say \"' || c_name || '\", ' AS c_name, CAST(c_acctbal AS DECIMAL(12,2)) > 0 AS solvent FROM customer",
    "stream_upsert": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY odd DESC, event_id DESC) AS rn FROM (SELECT user_id, event_id, event_type, event_id % 2 = 1 OR event_id < 100 AS odd FROM events)) WHERE rn = 1",
    "digest_all_rows": "SELECT COUNT(*) AS n, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)), 1, 12) AS BIGINT)) AS DECIMAL(38,0)) AS digest FROM orders",
    "infoschema_columns": "SELECT * FROM (VALUES ('nation', 'n_nationkey', 1, 'integer'), ('nation', 'n_name', 2, 'text'), ('nation', 'n_regionkey', 3, 'integer')) AS t(table_name, column_name, ordinal_position, data_type)",
    "digest_visible_rows": "SELECT COUNT(*) AS n, max(h) AS high, min(h) AS low FROM (SELECT md5(concat_ws('|', n_nationkey, n_name, n_regionkey)) AS h FROM nation)",
}
