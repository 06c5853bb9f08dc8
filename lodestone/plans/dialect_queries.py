"""Queries in PostgreSQL text through `Session.sql`: no casts and no NULLS clauses, types, null order and errors are the session's own.

Each runs over whole tables that the session holds as versions. SQLSTATEs come out as rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Session
from ..sources.loader import load
from ..types import sql_type

KINDS = {"int": "int", "bigint": "bigint", "string": "text", "boolean": "bool", "date": "date", "timestamp_ntz": "timestamp", "timestamp": "timestamp", "smallint": "smallint"}


def kind(dtype: str):
    return sql_type(dtype.replace("decimal", "numeric") if dtype.startswith("decimal") else KINDS[dtype])


def session(spark: SparkSession, sf_dir: str, *names: str) -> Session:
    """A session that holds these tables."""
    s = Session(spark)
    for name in names:
        df = load(spark, sf_dir, name)
        s.load(name, df, [(c, kind(t)) for c, t in df.dtypes])
    return s


def typed(spark: SparkSession, sf_dir: str) -> Session:
    """Customers with a column of every type that the tables lack: uuid, int2, bool, date."""
    s = Session(spark)
    h = F.md5((F.col("c_custkey") % 40).cast("string").cast("binary"))
    uuid = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    df = load(spark, sf_dir, "customer").select("c_custkey", uuid.alias("u"), (F.col("c_custkey") % 7).cast("smallint").alias("small"), (F.col("c_nationkey") > 12).alias("flag"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 400).cast("int")).alias("day"), "c_acctbal")
    s.load("typed", df, [("c_custkey", sql_type("bigint")), ("u", sql_type("uuid")), ("small", sql_type("smallint")), ("flag", sql_type("bool")), ("day", sql_type("date")), ("c_acctbal", sql_type("numeric(12,2)"))])
    return s


H = "md5(CAST(c_custkey % 40 AS VARCHAR))"
TYPED_SQL = f"WITH typed AS (SELECT c_custkey, substr({H}, 1, 8) || '-' || substr({H}, 9, 4) || '-' || substr({H}, 13, 4) || '-' || substr({H}, 17, 4) || '-' || substr({H}, 21, 12) AS u, CAST(c_custkey % 7 AS SMALLINT) AS small, c_nationkey > 12 AS flag, CAST(DATE '2024-01-01' + CAST(c_custkey % 400 AS INTEGER) AS DATE) AS day, CAST(c_acctbal AS DECIMAL(12,2)) AS c_acctbal FROM customer)"


def states(spark: SparkSession, s: Session, statements: list[str]) -> DataFrame:
    """The SQLSTATE of each statement, 00000 for none."""
    found = []
    for text in statements:
        try:
            s.sql(text).collect()  # a statement's tag, or the one row of an aggregate
            state = "00000"
        except Exception as e:  # noqa: BLE001 - what is raised is the result
            state = getattr(e, "sqlstate", None) or (e.getSqlState() if hasattr(e, "getSqlState") else None) or "XX000"
        found.append((len(found), state))
    return spark.createDataFrame(found, "step int, state string")


def states_sql(*found: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(found)) + ") AS t(step, state)"


QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _select(name: str, tables: str, text: str, oracle: str = "") -> None:
    QUERIES[f"pg_{name}"] = lambda spark, sf_dir: (typed(spark, sf_dir) if tables == "typed" else session(spark, sf_dir, *tables.split())).sql(text)
    ORACLES[f"pg_{name}"] = f"{TYPED_SQL} {oracle or text}" if tables == "typed" else oracle or text


_select("date_literal", "orders", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= '1996-03-01' AND o_orderdate < '1996-04-01'")
_select("order_nulls_last", "customer", "SELECT a.c_custkey, b.c_custkey AS other FROM customer a LEFT JOIN customer b ON a.c_custkey = b.c_nationkey ORDER BY other, a.c_custkey LIMIT 500")
_select("order_desc_nulls_first", "customer", "SELECT a.c_custkey, b.c_custkey AS other FROM customer a LEFT JOIN customer b ON a.c_custkey = b.c_nationkey ORDER BY other DESC, a.c_custkey LIMIT 100", "SELECT a.c_custkey, b.c_custkey AS other FROM customer a LEFT JOIN customer b ON a.c_custkey = b.c_nationkey ORDER BY other DESC NULLS FIRST, a.c_custkey LIMIT 100")
_select("aggregates", "customer", "SELECT COUNT(*), SUM(c_nationkey), MIN(c_name), MAX(c_acctbal) FROM customer", "SELECT COUNT(*) AS count, CAST(SUM(c_nationkey) AS BIGINT) AS sum, MIN(c_name) AS min, MAX(CAST(c_acctbal AS DECIMAL(12,2))) AS max FROM customer")
_select("group_having", "customer", "SELECT c_nationkey, COUNT(*) AS n, SUM(c_acctbal) AS total FROM customer GROUP BY c_nationkey HAVING n > 3", "SELECT c_nationkey, COUNT(*) AS n, SUM(CAST(c_acctbal AS DECIMAL(12,2))) AS total FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 3")
_select("join_four_way", "region nation customer orders", "SELECT r.r_name, n.n_name, c.c_custkey, o.o_orderkey FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey WHERE r.r_name = 'ASIA'")
_select("anti_join", "customer orders", "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL")
_select("like_escape", "part", "SELECT p_partkey FROM part WHERE p_name LIKE '%a_e%' OR p_brand LIKE 'Brand#1%'")
_select("count_distinct", "lineitem", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
_select("window_named", "customer", "SELECT c_custkey, ROW_NUMBER() OVER w AS rn, LAG(c_custkey) OVER w AS above FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)")
_select("between_numeric", "part", "SELECT p_partkey FROM part WHERE p_retailprice BETWEEN 950.00 AND 1100.50", "SELECT p_partkey FROM part WHERE CAST(p_retailprice AS DECIMAL(12,2)) BETWEEN 950.00 AND 1100.50")
_select("numeric_arithmetic", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * l_discount > 5000.5", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(12,2)) > 5000.5")
_select("distinct_join", "customer nation", "SELECT DISTINCT n.n_name, c.c_mktsegment FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
_select("using", "customer orders", "SELECT COUNT(*) AS n FROM customer a JOIN customer b USING (c_custkey)")
_select("uuid_compare", "typed", "SELECT c_custkey, u FROM typed WHERE u > '80000000-0000-0000-0000-000000000000' AND u <> '98f13708-2101-94c4-7568-7be6106a3b84'")
_select("uuid_join", "typed", "SELECT a.c_custkey, b.c_custkey AS other FROM typed a JOIN typed b ON a.u = b.u WHERE a.c_custkey < b.c_custkey")
_select("uuid_group", "typed", "SELECT u, COUNT(*) AS n, MIN(day) AS first_day, MAX(day) AS last_day FROM typed GROUP BY u")
_select("uuid_min_max", "typed", "SELECT small, MIN(u) AS first_u, MAX(u) AS last_u FROM typed GROUP BY small")
_select("int2_group", "typed", "SELECT small, flag, COUNT(*) AS n FROM typed GROUP BY small, flag")
_select("date_group", "typed", "SELECT day, COUNT(*) AS n FROM typed WHERE day >= '2024-06-01' GROUP BY day")
_select("timestamp_group", "orders", "SELECT o_orderdate, COUNT(*) AS n, MIN(o_orderkey) AS least FROM orders GROUP BY o_orderdate")
_select("text_columns", "customer", "SELECT c_custkey FROM customer WHERE c_name < c_mktsegment OR c_mktsegment = 'BUILDING'")
_select("public_schema", "nation", "SELECT n_name, 'public.x' AS tag FROM public.nation WHERE n_name <> 'public.y'", "SELECT n_name, 'public.x' AS tag FROM nation")


def _(name: str, oracle: str):
    def put(f: Callable) -> Callable:
        QUERIES[f"pg_{name}"], ORACLES[f"pg_{name}"] = f, oracle
        return f

    return put


@_("function_call", "SELECT 42 AS answer")
def _function(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    s.sql("CREATE FUNCTION answer() RETURNS INT LANGUAGE SQL AS 'SELECT 42'")
    return s.sql("SELECT answer()")


@_("overflow", states_sql("22003", "22003", "22003", "00000"))
def _overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked arithmetic: int4, int8 and a sum that leaves its type."""
    s = session(spark, sf_dir, "nation")
    s.sql("CREATE TABLE big (a INT, b BIGINT)")
    s.sql("INSERT INTO big VALUES (2147483647, 9223372036854775807)")
    return states(spark, s, ["SELECT COUNT(*) FROM big WHERE a + 1 > 0", "SELECT COUNT(*) FROM big WHERE b * 2 > 0", "SELECT COUNT(*) FROM big WHERE a * 2 > 0", "SELECT SUM(b) FROM big"])


@_("errors", states_sql("23502", "23505", "23503", "23514", "42P01", "00000"))
def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, "region")
    s.sql("ALTER TABLE region ADD PRIMARY KEY (r_regionkey)")
    s.sql("CREATE TABLE t (id INT PRIMARY KEY, r INT REFERENCES region (r_regionkey), n INT CHECK (n > 0))")
    s.sql("INSERT INTO t VALUES (1, 0, 1)")
    return states(spark, s, ["INSERT INTO t VALUES (NULL, 0, 1)", "INSERT INTO t VALUES (1, 0, 1)", "INSERT INTO t VALUES (2, 99, 1)", "INSERT INTO t VALUES (2, 0, -1)", "SELECT * FROM nowhere_at_all WHERE 1 = 1", "INSERT INTO t VALUES (2, NULL, NULL)"])


@_("parent_protected", states_sql("23503", "00000"))
def _parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, "region", "nation")
    s.sql("ALTER TABLE region ADD PRIMARY KEY (r_regionkey)")
    s.sql("ALTER TABLE nation ADD FOREIGN KEY (n_regionkey) REFERENCES region (r_regionkey)")
    s.sql("INSERT INTO region VALUES (77, 'EMPTY')")
    return states(spark, s, ["DELETE FROM region WHERE r_regionkey = 0", "DELETE FROM region WHERE r_regionkey = 77"])


@_("failed_transaction", states_sql("00000", "42P01", "25P02", "00000", "00000"))
def _failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, session(spark, sf_dir, "nation"), ["BEGIN", "DELETE FROM nowhere WHERE a = 1", "SELECT COUNT(*) FROM nation", "ROLLBACK", "SELECT COUNT(*) FROM nation"])


@_("write_conflict", states_sql("00000", "00000", "40001", "00000"))
def _conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, "nation")
    other = Session(spark, s.store, s.catalog)
    first = states(spark, s, ["BEGIN ISOLATION LEVEL REPEATABLE READ", "UPDATE nation SET n_regionkey = 9 WHERE n_nationkey = 1"])
    other.sql("DELETE FROM nation WHERE n_nationkey = 2")
    rest = states(spark, s, ["COMMIT", "UPDATE nation SET n_regionkey = 9 WHERE n_nationkey = 1"]).withColumn("step", F.col("step") + 2)
    return first.unionByName(rest)


@_("ddl_rollback", "SELECT n_nationkey, n_name FROM nation")
def _ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, "nation")
    for text in ("BEGIN", "ALTER TABLE nation DROP COLUMN n_name", "CREATE TABLE other (a INT)", "ROLLBACK"):
        s.sql(text)
    return s.sql("SELECT n_nationkey, n_name FROM nation")


@_("vacuum", "SELECT * FROM nation WHERE n_nationkey >= 3")
def _vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, "nation")
    s.sql("DELETE FROM nation WHERE n_nationkey < 3")
    s.sql("VACUUM nation")
    return s.sql("SELECT * FROM nation")


@_("sequences", "SELECT 10 AS a, 11 AS b, 11 AS c, 50 AS d, 10 AS e")
def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    s.sql("CREATE SEQUENCE q START WITH 10")
    one = lambda text: s.sql(text).first()[0]
    a, b, c = one("SELECT nextval('q')"), one("SELECT nextval('q')"), one("SELECT currval('q')")
    s.setval("q", 49)
    d = one("SELECT nextval('q')")
    s.sql("ALTER SEQUENCE q RESTART")
    return spark.createDataFrame([(a, b, c, d, one("SELECT nextval('q')"))], "a int, b int, c int, d int, e int")


@_("serial_and_defaults", "SELECT * FROM (VALUES (1, 'x', 1.50), (2, 'x', 2.00), (3, 'y', 1.50)) AS t(id, tag, amount)")
def _serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    s.sql("CREATE TABLE t (id SERIAL PRIMARY KEY, tag TEXT DEFAULT 'x', amount NUMERIC(4,2) DEFAULT 1.5)")
    s.sql("INSERT INTO t DEFAULT VALUES")
    s.sql("INSERT INTO t (amount) VALUES (2)")
    s.sql("INSERT INTO t (tag, amount) VALUES ('y', DEFAULT)")
    return s.sql("SELECT * FROM t")


@_("copy_in_out", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def _copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COPY TO and COPY FROM through the session, into a table with constraints, in CSV with a delimiter and a quote of its own."""
    s = session(spark, sf_dir, "customer")
    path = f"{s.store.root}/copied"
    s.sql(f"COPY customer (c_custkey, c_name, c_nationkey) TO '{path}' WITH (FORMAT csv, DELIMITER ';', HEADER)")
    s.sql("CREATE TABLE again (c_custkey BIGINT PRIMARY KEY, c_name TEXT, c_nationkey INT CHECK (c_nationkey >= 0))")
    s.sql(f"COPY again FROM '{path}' WITH (FORMAT csv, DELIMITER ';', HEADER)")
    return s.sql("SELECT * FROM again")


@_("copy_serial", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS ids, 1 AS least, CAST(count(*) AS INTEGER) AS most FROM customer")
def _copy_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, "customer")
    s.sql(f"COPY customer (c_name) TO '{s.store.root}/names'")
    s.sql("CREATE TABLE again (id SERIAL PRIMARY KEY, c_name TEXT)")
    s.sql(f"COPY again (c_name) FROM '{s.store.root}/names'")
    return s.sql("SELECT COUNT(*) AS n, COUNT(DISTINCT id) AS ids, MIN(id) AS least, MAX(id) AS most FROM again")


@_("delete_returning", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def _delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir, "nation").sql("DELETE FROM nation WHERE n_regionkey = 2 RETURNING n_nationkey, n_name")


@_("catalog_casts", "SELECT 'nation' AS relname, TRUE AS visible, 'owner' AS owner UNION ALL SELECT 'region', TRUE, 'owner'")
def _casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A describe query as psql sends it: regular expression, casts to oids, catalog functions."""
    s = session(spark, sf_dir, "nation", "region", "supplier")
    return s.sql("SELECT c.relname, pg_catalog.pg_table_is_visible(c.oid) AS visible, pg_catalog.pg_get_userbyid(10) AS owner FROM pg_catalog.pg_class c WHERE c.relname OPERATOR(pg_catalog.~) '^(nation|region)$' AND c.relnamespace = 'public'::regnamespace AND c.oid <> 'supplier'::regclass")


@_("psql_lists", "SELECT * FROM (VALUES ('public', 'nation', 'table', 'owner'), ('public', 'asia', 'view', 'owner'), ('public', 'q', 'sequence', 'owner')) AS t(schema, name, type, owner)")
def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, "nation")
    s.sql("CREATE VIEW asia AS SELECT * FROM nation WHERE n_regionkey = 2")
    s.sql("CREATE SEQUENCE q")
    return s.psql("\\d")


@_("psql_describe", """SELECT * FROM (VALUES ('n_nationkey', 'integer', 'not null', ''), ('n_name', 'text', '', ''), ('n_regionkey', 'integer', '', '7')) AS t("column", type, nullable, "default")""")
def _describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, "nation")
    s.sql("ALTER TABLE nation ADD PRIMARY KEY (n_nationkey)")
    s.sql("ALTER TABLE nation ALTER COLUMN n_regionkey SET DEFAULT 7")
    return s.psql("\\d nation")


@_("relation_size", "SELECT TRUE AS some, TRUE AS none")
def _size(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir, "nation")
    s.sql("CREATE TABLE bare (a INT)")
    return s.sql("SELECT pg_relation_size('nation') > 0 AS some, pg_relation_size('bare') = 0 AS none")


@_("program", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 9 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT 500, 9")
def _program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predeclared transaction, run once whole and once taken back by its last statement."""
    s = session(spark, sf_dir, "nation")
    s.sql("ALTER TABLE nation ADD PRIMARY KEY (n_nationkey)")
    s.declare_program("move", ["UPDATE nation SET n_regionkey = $2 WHERE n_nationkey = $1", "DELETE FROM nation WHERE n_nationkey = $3", "INSERT INTO nation VALUES ($4, 'NEW', $2)"])
    s.run_program("move", (3, 9, 4, 500))
    try:
        s.run_program("move", (5, 8, 6, 500))  # the key is taken
    except Exception as e:  # noqa: BLE001
        assert getattr(e, "sqlstate", "") == "23505"
    return s.sql("SELECT n_nationkey, n_regionkey FROM nation")


@_("kv_batches", "SELECT 'c' || CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_nationkey = 1 THEN 'moved' ELSE c_name END AS value FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey IN (SELECT o_custkey FROM orders)")
def _kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of pairs set, set again and deleted, then a batch of keys read."""
    s = Session(spark)
    customer = load(s.spark, sf_dir, "customer")
    key = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    s.kv_set(customer.select(key("c_custkey"), "c_name"))
    s.kv_set(customer.filter("c_nationkey = 1").select(key("c_custkey"), F.lit("moved")))
    s.kv_delete(customer.filter("c_custkey % 3 = 0").select(key("c_custkey")))
    return s.kv_get(load(s.spark, sf_dir, "orders").select(key("o_custkey")))
