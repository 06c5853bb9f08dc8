"""Read queries: one SQL text for Spark and for the oracle, over typed relations.

Names in braces are relations of FIXTURES or tables; both sides define them alike, so a text is the whole query. Where the two dialects
differ, the query has a text for each.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.loader import DECIMALS, TABLES, load

#: Derived relations, in SQL that both sides read, over typed tables.
FIXTURES = {
    "orders_nullable": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_totalprice, o_orderdate FROM {orders}",
    "customer_some": "SELECT * FROM {customer} WHERE c_custkey % 3 <> 0",
    "events_nullable": "SELECT event_id, ts, user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 97 AS INT) END AS amount FROM {events}",
    "flags": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal > 0 END AS solvent FROM {customer}",
}
AVG = "CAST(ROUND(CAST(SUM({0}) AS DOUBLE) / COUNT({0}), 4) AS DECIMAL(38,4))"
SUM2 = "CAST(SUM(CAST({0} AS DECIMAL(38,2))) AS DECIMAL(38,2))"
SUMI = "CAST(SUM(CAST({0} AS BIGINT)) AS BIGINT)"


def avg(c: str) -> str:
    return AVG.format(c)


def sum2(c: str) -> str:
    return SUM2.format(c)


def sumi(c: str) -> str:
    return SUMI.format(c)


#: name -> SQL for both sides, or (Spark's, the oracle's).
SQL: dict[str, str | tuple[str, str]] = {
    # scans and projections
    "scan_projection_star": "SELECT * FROM {region}",
    "scan_star_with_columns": "SELECT n_name AS first_name, n.* FROM {nation} n",
    "scan_row_range": "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_orderkey >= 100 AND o_orderkey < 900",
    "scan_literal": "SELECT 7 AS i, CAST(1.50 AS DECIMAL(4,2)) AS n, 'x' AS t, TRUE AS b",
    "scan_pruned_partitions": "SELECT COUNT(*) AS n, MIN(l_orderkey) AS lo, MAX(l_orderkey) AS hi FROM {lineitem} WHERE l_orderkey BETWEEN 500 AND 1500",
    "point_lookup": "SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE o_orderkey = 77",
    "point_lookup_compound": "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_linenumber = 2 AND l_orderkey = 77",
    "point_lookup_batch": "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderkey IN (1, 5, 77, 500, 1000, 999999)",
    "point_lookup_text_batch": "SELECT p_name, p_brand FROM {part} WHERE p_partkey IN (3, 9, 27, 81)",
    "scan_chunk_skipping": "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_custkey IN (5, 77, 311) AND o_orderkey > 100",
    "scan_cold_chunks": "SELECT COUNT(*) AS n, MIN(l_shipdate) AS first_day, MAX(l_shipdate) AS last_day, MIN(l_returnflag) AS flag FROM {lineitem}",
    "join_out_of_core": "SELECT /*+ MERGE(l, o) */ o.o_orderpriority, COUNT(*) AS n, COUNT(l.l_orderkey) AS matched FROM {orders} o LEFT JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey AND l.l_linenumber > 3 GROUP BY o.o_orderpriority",
    # predicates
    "filter_int_compare": "SELECT p_partkey, p_size FROM {part} WHERE p_size > 25 AND 40 >= p_size AND p_size <> 30",
    "filter_col_vs_col": "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_partkey < l_suppkey * 10 AND l_orderkey <> l_partkey",
    "filter_arith": "SELECT o_orderkey FROM {orders} WHERE o_orderkey + o_custkey * 2 - 5 > 3000",
    "filter_decimal_arith": "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_extendedprice * (1 - l_discount) > 50000.00",
    "filter_and_or_nested": "SELECT p_partkey FROM {part} WHERE (p_size < 10 OR p_size > 40) AND (p_brand = 'Brand#11' OR p_retailprice > 950.00)",
    "filter_in": "SELECT c_custkey FROM {customer} WHERE c_nationkey IN (1, 3, 5) AND c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "filter_not_in": "SELECT c_custkey, c_nationkey FROM {customer} WHERE c_nationkey NOT IN (1, 3, 5)",
    "filter_between": "SELECT p_partkey, p_retailprice FROM {part} WHERE p_retailprice BETWEEN 910.00 AND 950.00",
    "filter_like_prefix": "SELECT c_custkey, c_name FROM {customer} WHERE c_name LIKE 'Customer#0000000%'",
    "filter_like_full": "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%a_e%'",
    "filter_like_escape": ("SELECT event_id FROM {events} WHERE event_type LIKE '%\\\\_%' OR event_type LIKE 'c%k'", "SELECT event_id FROM {events} WHERE event_type LIKE '%\\_%' ESCAPE '\\' OR event_type LIKE 'c%k'"),
    "filter_text_range": "SELECT n_nationkey, n_name FROM {nation} WHERE n_name >= 'NATION_1' AND n_name < 'NATION_2'",
    "filter_date_range": "SELECT o_orderkey FROM {orders} WHERE o_orderdate >= TIMESTAMP_NTZ '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP_NTZ '1996-01-01 00:00:00'",
    "filter_bool": "SELECT c_custkey FROM {flags} WHERE solvent",
    "filter_not_bool": "SELECT c_custkey FROM {flags} WHERE NOT solvent",
    "filter_bool_equals": "SELECT c_custkey, solvent FROM {flags} WHERE solvent = FALSE OR solvent IS NULL",
    "filter_is_null": "SELECT o_orderkey FROM {orders_nullable} WHERE o_custkey IS NULL",
    "filter_is_not_null": "SELECT event_id FROM {events_nullable} WHERE event_type IS NOT NULL AND amount IS NOT NULL",
    "filter_kleene": "SELECT event_id FROM {events_nullable} WHERE amount > 50 OR event_type = 'click'",
    "filter_mixed_width": "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_linenumber = l_suppkey",
    # joins
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = 7",
    "join_text_key": "SELECT a.n_nationkey, b.n_nationkey AS other FROM {nation} a JOIN {nation} b ON a.n_name = b.n_name",
    "join_decimal_key": "SELECT a.p_partkey, b.p_partkey AS other FROM {part} a JOIN {part} b ON a.p_retailprice = b.p_retailprice",
    "join_composite": "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 45",
    "join_mixed_width": "SELECT n.n_name, s.s_suppkey FROM {nation} n JOIN {supplier} s ON n.n_nationkey = s.s_suppkey",
    "join_three_way": "SELECT c.c_custkey, n.n_name, r.r_name FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'",
    "join_four_way": f"SELECT r.r_name, COUNT(*) AS n, {sum2('o.o_totalprice')} AS total FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey JOIN {{region}} r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
    "join_left": "SELECT o.o_orderkey, c.c_custkey FROM {orders_nullable} o LEFT JOIN {customer_some} c ON o.o_custkey = c.c_custkey",
    "join_right": "SELECT o.o_orderkey, c.c_custkey FROM {orders_nullable} o RIGHT JOIN {customer_some} c ON o.o_custkey = c.c_custkey",
    "join_full": "SELECT o.o_orderkey, c.c_custkey FROM {orders_nullable} o FULL JOIN {customer_some} c ON o.o_custkey = c.c_custkey",
    "join_outer_where": "SELECT o.o_orderkey, c.c_name FROM {orders_nullable} o LEFT JOIN {customer_some} c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 0 OR c.c_acctbal IS NULL",
    "join_outer_chain": "SELECT o.o_orderkey, c.c_custkey, n.n_name FROM {orders_nullable} o LEFT JOIN {customer_some} c ON o.o_custkey = c.c_custkey LEFT JOIN {nation} n ON c.c_nationkey = n.n_nationkey",
    "join_on_filter": "SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000.00",
    "join_anti_idiom": "SELECT c.c_custkey FROM {customer} c LEFT JOIN {orders_nullable} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 150000.00 WHERE o.o_orderkey IS NULL",
    "join_using": "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM {nation}) a JOIN (SELECT s_nationkey AS k, s_suppkey FROM {supplier}) b USING (k)",
    "join_natural": "SELECT * FROM (SELECT r_regionkey AS k, r_name FROM {region}) a NATURAL JOIN (SELECT n_regionkey AS k, n_name FROM {nation}) b",
    "join_comma": "SELECT n.n_name, r.r_name FROM {nation} n, {region} r WHERE n.n_regionkey = r.r_regionkey AND r.r_regionkey < 3",
    "join_self": "SELECT a.n_name, b.n_name AS neighbour FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_distinct": "SELECT DISTINCT r.r_name, c.c_mktsegment FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey",
    "join_order_limit": "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC NULLS FIRST, o.o_orderkey ASC NULLS LAST LIMIT 20 OFFSET 5",
    "join_many_to_many": "SELECT a.c_custkey, b.s_suppkey FROM {customer} a JOIN {supplier} b ON a.c_nationkey = b.s_nationkey",
    # aggregates
    "agg_scalar_all": f"SELECT COUNT(*) AS count, {sumi('amount')} AS sum, MIN(amount) AS min, MAX(amount) AS max, {avg('amount')} AS avg FROM {{events_nullable}}",
    "agg_scalar_filtered": f"SELECT COUNT(*) AS count, {sum2('l_extendedprice')} AS sum, MIN(l_discount) AS min, MAX(l_tax) AS max FROM {{lineitem}} WHERE l_quantity BETWEEN 10 AND 20",
    "agg_empty_input": f"SELECT COUNT(*) AS count, {sumi('amount')} AS sum, MIN(amount) AS min, MAX(event_type) AS max FROM {{events_nullable}} WHERE event_id < 0",
    "agg_all_null": f"SELECT COUNT(amount) AS count, {sumi('amount')} AS sum, MAX(amount) AS max FROM {{events_nullable}} WHERE amount IS NULL",
    "agg_sum_bigint": "SELECT CAST(SUM(CAST(o_orderkey AS DECIMAL(38,0))) AS DECIMAL(38,0)) AS sum FROM {orders}",
    "agg_count_distinct": "SELECT COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT event_type) AS types FROM {events_nullable}",
    "agg_min_max_text": "SELECT MIN(c_name) AS min, MAX(c_name) AS max, MIN(c_mktsegment) AS seg FROM {customer}",
    "agg_min_max_timestamp": "SELECT MIN(o_orderdate) AS min, MAX(o_orderdate) AS max FROM {orders}",
    "group_single_int": f"SELECT c_nationkey, COUNT(*) AS count, {sum2('c_acctbal')} AS sum, {avg('c_acctbal')} AS avg FROM {{customer}} GROUP BY c_nationkey",
    "group_single_text": "SELECT o_orderpriority, COUNT(*) AS count, MIN(o_totalprice) AS min, MAX(o_totalprice) AS max FROM {orders} GROUP BY o_orderpriority",
    "group_single_date": "SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS count FROM {orders} GROUP BY CAST(o_orderdate AS DATE)",
    "group_single_decimal": "SELECT l_discount, COUNT(*) AS count FROM {lineitem} GROUP BY l_discount",
    "group_single_bool": "SELECT solvent, COUNT(*) AS count FROM {flags} GROUP BY solvent",
    "group_composite": f"SELECT l_returnflag, l_linestatus, l_linenumber, COUNT(*) AS count, {sum2('l_quantity')} AS sum FROM {{lineitem}} GROUP BY l_returnflag, l_linestatus, l_linenumber",
    "group_expression": "SELECT l_linenumber + 1 AS k, COUNT(*) AS count FROM {lineitem} GROUP BY l_linenumber + 1",
    "group_multi_agg": f"SELECT l_returnflag, COUNT(*) AS n, {sum2('l_quantity')} AS q, {sum2('l_extendedprice')} AS p, MIN(l_discount) AS d, MAX(l_tax) AS t, {avg('l_quantity')} AS a FROM {{lineitem}} GROUP BY l_returnflag",
    "group_min_max_text": "SELECT c_nationkey, MIN(c_name) AS min, MAX(c_mktsegment) AS max FROM {customer} GROUP BY c_nationkey",
    "group_count_distinct": "SELECT event_type, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT amount) AS amounts FROM {events_nullable} GROUP BY event_type",
    "group_having": "SELECT user_id, COUNT(*) AS count FROM {events} GROUP BY user_id HAVING COUNT(*) >= 5 OR user_id < 3",
    "group_null_key": f"SELECT event_type, COUNT(*) AS count, COUNT(amount) AS amounts, {sumi('amount')} AS sum FROM {{events_nullable}} GROUP BY event_type",
    "group_order_limit": "SELECT c_nationkey, COUNT(*) AS count FROM {customer} GROUP BY c_nationkey ORDER BY count DESC NULLS FIRST, c_nationkey ASC NULLS LAST LIMIT 5",
    "distinct_single": "SELECT DISTINCT event_type FROM {events_nullable}",
    "duplicates_check": "SELECT l_partkey, l_suppkey, COUNT(*) AS count FROM {lineitem} GROUP BY l_partkey, l_suppkey HAVING COUNT(*) > 1",
    "duplicate_documents": "SELECT MIN(doc_id) AS doc_id, COUNT(*) AS count FROM {documents} GROUP BY text HAVING COUNT(*) > 1",
    # windows
    "window_row_number": "SELECT event_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts ASC NULLS LAST, event_id ASC NULLS LAST) AS BIGINT) AS rn FROM {events}",
    "window_rank_dense": "SELECT c_custkey, CAST(RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment ASC NULLS LAST) AS BIGINT) AS r, CAST(DENSE_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment ASC NULLS LAST) AS BIGINT) AS d FROM {customer}",
    "window_lag_lead": "SELECT event_id, LAG(event_id) OVER (PARTITION BY user_id ORDER BY ts ASC NULLS LAST, event_id ASC NULLS LAST) AS before, LEAD(amount, 2) OVER (PARTITION BY user_id ORDER BY ts ASC NULLS LAST, event_id ASC NULLS LAST) AS later FROM {events_nullable}",
    "window_named_limit": "SELECT event_id, user_id, CAST(ROW_NUMBER() OVER w AS BIGINT) AS rn, LAG(event_id) OVER w AS before FROM {events} WHERE user_id < 20 WINDOW w AS (PARTITION BY user_id ORDER BY ts ASC NULLS LAST, event_id ASC NULLS LAST) ORDER BY user_id ASC NULLS LAST, ts ASC NULLS LAST, event_id ASC NULLS LAST LIMIT 30 OFFSET 3",
    "window_desc_nulls": "SELECT event_id, CAST(RANK() OVER (PARTITION BY event_type ORDER BY amount DESC NULLS FIRST) AS BIGINT) AS r FROM {events_nullable}",
    "window_top_per_group": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey ASC NULLS LAST) AS rn FROM {orders}) t WHERE rn <= 2",
    # order and limit
    "order_multi_nulls": "SELECT event_id, event_type, amount FROM {events_nullable} ORDER BY event_type ASC NULLS LAST, amount DESC NULLS FIRST, event_id ASC NULLS LAST LIMIT 100",
    "order_nulls_explicit": "SELECT event_id, amount FROM {events_nullable} ORDER BY amount ASC NULLS FIRST, event_id DESC NULLS LAST LIMIT 50",
    "order_expression": "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey - o_custkey ASC NULLS LAST, o_orderkey ASC NULLS LAST LIMIT 25",
    "order_by_position": "SELECT n_name, n_nationkey FROM {nation} ORDER BY 1 DESC NULLS FIRST LIMIT 7",
    "limit_offset": "SELECT c_custkey FROM {customer} ORDER BY c_custkey ASC NULLS LAST LIMIT 10 OFFSET 40",
    "offset_only": "SELECT n_nationkey FROM {nation} ORDER BY n_nationkey ASC NULLS LAST OFFSET 20",
    "topn": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice DESC NULLS FIRST, l_orderkey ASC NULLS LAST, l_linenumber ASC NULLS LAST LIMIT 15",
    # star schema
    "revenue_by_nation": "SELECT n.n_name, CAST(SUM(CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(38,4))) AS DECIMAL(38,4)) AS revenue FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "shipping_priority": "SELECT l.l_orderkey, CAST(SUM(CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(38,4))) AS DECIMAL(38,4)) AS revenue, o.o_orderdate FROM {customer} c JOIN {orders} o ON c.c_custkey = o.o_custkey JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY l.l_orderkey, o.o_orderdate ORDER BY revenue DESC NULLS FIRST, o.o_orderdate ASC NULLS LAST, l.l_orderkey ASC NULLS LAST LIMIT 10",
    "forecast_revenue": "SELECT CAST(SUM(CAST(l_extendedprice * l_discount AS DECIMAL(38,4))) AS DECIMAL(38,4)) AS revenue FROM {lineitem} WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    # views
    "view_select": "SELECT * FROM (SELECT * FROM {customer_some}) v",
    "view_nested": "SELECT * FROM (SELECT * FROM (SELECT * FROM {flags}) inner_view) outer_view",
    "function_literal": "SELECT CAST(42 AS INT) AS answer",
}
FLAGSHIP = f"""SELECT l_returnflag, l_linestatus, COUNT(*) AS count_order, {sum2('l_quantity')} AS sum_qty, {sum2('l_extendedprice')} AS sum_base_price,
  CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(38,4))) AS DECIMAL(38,4)) AS sum_disc_price, {avg('l_quantity')} AS avg_qty, {avg('l_extendedprice')} AS avg_price
FROM {{lineitem}} WHERE l_shipdate >= TIMESTAMP_NTZ '1992-01-01 00:00:00' GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 1"""
SQL["flagship_pricing_summary"] = FLAGSHIP


def names_in(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


#: Ranges of amounts that a query's WHERE asks for, as the scan can use them: query -> table -> column -> (low, high).
RANGES: dict[str, dict] = {
    "filter_between": {"part": {"p_retailprice": (910, 950)}},
    "agg_scalar_filtered": {"lineitem": {"l_quantity": (10, 20)}},
    "forecast_revenue": {"lineitem": {"l_discount": (0.05, 0.07), "l_quantity": (None, 24)}},
}


def relation(spark: SparkSession, sf_dir: str, name: str, ranges: dict | None = None) -> DataFrame:
    return run_sql(spark, sf_dir, FIXTURES[name]) if name in FIXTURES else load(spark, sf_dir, name, within=(ranges or {}).get(name))


def run_sql(spark: SparkSession, sf_dir: str, text: str, ranges: dict | None = None) -> DataFrame:
    return spark.sql(text, **{name: relation(spark, sf_dir, name, ranges) for name in names_in(text)})


def oracle(text: str) -> str:
    """The text with its relations as CTEs over the plain tables."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        if name in FIXTURES:
            body = FIXTURES[name]
            for inner in names_in(body):
                add(inner)
            done[name] = re.sub(r"\{(\w+)\}", r"t_\1", body)
        elif name in TABLES:
            casts = ", ".join(f"CAST({c} AS DECIMAL(12,2)) AS {c}" for c in DECIMALS.get(name, ()))
            done[name] = f"SELECT * {f'REPLACE ({casts})' if casts else ''} FROM {name}"

    for name in names_in(text):
        add(name)
    body = re.sub(r"\{(\w+)\}", r"t_\1", text).replace("TIMESTAMP_NTZ '", "TIMESTAMP '")
    ctes = ", ".join(f"t_{name} AS ({sql})" for name, sql in done.items())
    return f"WITH {ctes} {body}" if ctes else body


def _query(name: str, text: str):
    return lambda spark, sf_dir: run_sql(spark, sf_dir, text, RANGES.get(name))


QUERIES = {name: _query(name, text if isinstance(text, str) else text[0]) for name, text in SQL.items()}
ORACLES = {name: oracle(text if isinstance(text, str) else text[1]) for name, text in SQL.items()}
