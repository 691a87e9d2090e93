"""Relational queries in SQL that means the same to Spark and DuckDB: filters, joins, groups, windows, sets, subqueries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.block_join import block_join
from .tables import table

SQL: dict[str, str] = {
    "q1_pricing_summary": """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "scan_project": "SELECT p_partkey, p_name, p_brand, p_retailprice FROM part",
    "project_expressions": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, -l_quantity AS neg_qty, l_quantity + 1 AS qty1, CAST(l_quantity AS BIGINT) AS qty_int FROM lineitem",
    "filter_compare": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F' AND o_orderkey <= 50000",
    "filter_or_not": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT (c_mktsegment = 'BUILDING' OR c_acctbal < 0) AND c_nationkey >= 3",
    "filter_in": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "filter_not_in": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')",
    "filter_between": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20",
    "filter_not_between": "SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 10 AND 40",
    "filter_like": "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%BRASS' OR p_name LIKE '_a%'",
    "filter_not_like": "SELECT p_partkey, p_type FROM part WHERE p_type NOT LIKE '%STEEL%'",
    "filter_null": "SELECT d.doc_id, l.toxic IS NULL AS unlabelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR l.quality = 1",
    "case_when": "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' ELSE 'high' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code FROM orders",
    "arithmetic": "SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) AS unit_price, round(l_discount * 100, 4) AS pct FROM lineitem",
    "inner_join": "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "left_join": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey",
    "right_join": "SELECT n.n_name, s.s_suppkey FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey",
    "full_join": "SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nationkey, c.c_custkey, s.s_suppkey FROM (SELECT * FROM customer WHERE c_nationkey < 15) c FULL OUTER JOIN (SELECT * FROM supplier WHERE s_nationkey > 10) s ON c.c_custkey = s.s_suppkey",
    "cross_join": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "self_join": "SELECT a.s_suppkey AS s1, b.s_suppkey AS s2 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "semi_join_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)",
    "anti_join_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "semi_join_in": "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "theta_join": "SELECT a.n_nationkey AS n1, b.n_nationkey AS n2 FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey",
    "compound_join": "SELECT s.s_suppkey, c.c_custkey FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey AND s.s_acctbal > c.c_acctbal",
    "multi_join": """
SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY n.n_name""",
    "group_by": "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean, min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer GROUP BY c_mktsegment",
    "group_by_global": "SELECT count(*) AS n, sum(l_linenumber) AS s, max(l_shipdate) AS last FROM lineitem",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10",
    "distinct": "SELECT DISTINCT p_brand, p_size FROM part",
    "count_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag",
    "order_by": "SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey",
    "top_n": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "limit_offset": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000",
    "scalar_subquery": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "correlated_subquery": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE l_quantity < (SELECT 0.3 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = l.l_partkey)",
    "derived_table": "SELECT t.c_nationkey, max(t.n) AS most FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) t GROUP BY t.c_nationkey",
    "cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), ranked AS (SELECT o_custkey, total, rank() OVER (ORDER BY round(total, 2) DESC) AS r FROM big) SELECT o_custkey, round(total, 2) AS total, r FROM ranked WHERE r <= 100",
    "recursive_cte": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT t.n, nation.n_name FROM t JOIN nation ON nation.n_nationkey = t.n",
    "window_rank": "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)",
    "window_distribution": "SELECT s_suppkey, round(percent_rank() OVER (ORDER BY s_acctbal, s_suppkey), 8) AS pr, round(cume_dist() OVER (ORDER BY s_acctbal, s_suppkey), 8) AS cd, ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS q FROM supplier",
    "window_lag_lead": "SELECT event_id, lag(event_id, 1) OVER w AS prev, lead(event_id, 2) OVER w AS next2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "window_values": "SELECT event_id, first_value(event_type) OVER w AS first, last_value(event_type) OVER w AS last, nth_value(event_type, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "window_running": "SELECT o_orderkey, count(*) OVER w AS n, round(sum(o_totalprice) OVER w, 2) AS running, round(avg(o_totalprice) OVER w, 4) AS mean, min(o_totalprice) OVER w AS least, max(o_totalprice) OVER w AS most FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "window_frame": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS around, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS before FROM events",
    "window_spread": "SELECT s_suppkey, round(stddev_pop(s_acctbal) OVER (PARTITION BY s_nationkey), 4) AS sd, round(var_pop(s_acctbal) OVER (PARTITION BY s_nationkey), 2) AS var FROM supplier",
    "top_per_group": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3",
    "or_branches": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 49 OR l_discount > 0.09) AND l_returnflag = 'R'",
    "orders_by_year": "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY year(o_orderdate), month(o_orderdate)",
    "shipping_priority": "SELECT l.l_orderkey, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, o.o_orderdate FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY l.l_orderkey, o.o_orderdate ORDER BY revenue DESC, l.l_orderkey LIMIT 10",
    "revenue_change": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.06 AND l_quantity < 24",
    "conversation_turns": "SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, length(text) AS n FROM conversations",
}


def compound_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL of that name; a nation has so many pairs that they are dealt out by blocks."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal")
    return block_join(s, c, ["nation"], F.col("s_acctbal") > F.col("c_acctbal")).select("s_suppkey", "c_custkey")


def self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL of that name, dealt out likewise."""
    s = table(spark, sf_dir, "supplier")
    a, b = (s.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias(n)) for n in ("s1", "s2"))
    return block_join(a, b, ["nation"], F.col("s1") < F.col("s2")).select("s1", "s2")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"compound_join": compound_join, "self_join": self_join}
