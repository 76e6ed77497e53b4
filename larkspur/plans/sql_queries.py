"""Queries in the SQL dialect: adapted decision-support queries and one per construct."""

from __future__ import annotations

from .registry import dialect

TS = "TIMESTAMP '{} 00:00:00'".format

# -- decision support, adapted to the tables there are

dialect(
    "tpch_q1",
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
           round(sum(l_extendedprice), 2) AS sum_base_price,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
           round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
           round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price,
           round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
    GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus
    """,
)
dialect(
    "tpch_q3",
    """
    SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
    FROM customer, orders, lineitem
    WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
      AND o_orderdate < TIMESTAMP '1995-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00'
    GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10
    """,
)
dialect(
    "tpch_q4",
    """
    SELECT o_orderpriority, count(*) AS order_count FROM orders
    WHERE o_orderdate >= TIMESTAMP '1994-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1995-01-01 00:00:00'
      AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)
    GROUP BY o_orderpriority ORDER BY o_orderpriority
    """,
)
dialect(
    "tpch_q5",
    """
    SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM customer, orders, lineitem, supplier, nation, region
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
      AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
    GROUP BY n_name ORDER BY revenue DESC, n_name
    """,
)
dialect(
    "tpch_q6",
    """
    SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-01-01 00:00:00'
      AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24
    """,
)
dialect(
    "tpch_q7",
    """
    SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue
    FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, EXTRACT(year FROM l_shipdate) AS l_year,
                 l_extendedprice * (1 - l_discount) AS volume
          FROM supplier, lineitem, orders, customer, nation n1, nation n2
          WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey
            AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
            AND n1.n_nationkey < 3 AND n2.n_nationkey < 3 AND n1.n_nationkey <> n2.n_nationkey) AS shipping
    GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year
    """,
    types={"l_year": "INTEGER"},
)
dialect(
    "tpch_q10",
    """
    SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name
    FROM customer, orders, lineitem, nation
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey
    GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20
    """,
)
dialect(
    "tpch_q11",
    """
    SELECT l_partkey, round(sum(l_extendedprice), 2) AS value FROM lineitem, supplier, nation
    WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_nationkey < 5
    GROUP BY l_partkey
    HAVING sum(l_extendedprice) > (SELECT sum(l_extendedprice) * 0.001 FROM lineitem, supplier WHERE l_suppkey = s_suppkey AND s_nationkey < 5)
    ORDER BY value DESC, l_partkey
    """,
)
dialect(
    "tpch_q12",
    """
    SELECT l_linestatus, sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS high_line_count,
           sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS low_line_count
    FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R')
    GROUP BY l_linestatus ORDER BY l_linestatus
    """,
    types={"high_line_count": "BIGINT", "low_line_count": "BIGINT"},
)
dialect(
    "tpch_q13",
    """
    SELECT c_count, count(*) AS custdist
    FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '5-LOW' GROUP BY c_custkey) AS c_orders
    GROUP BY c_count ORDER BY custdist DESC, c_count DESC
    """,
)
dialect(
    "tpch_q14",
    """
    SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
    FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1995-01-01 00:00:00'
    """,
)
dialect(
    "tpch_q15",
    """
    WITH revenue (supplier_no, total_revenue) AS (
      SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) FROM lineitem GROUP BY l_suppkey)
    SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue
    WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey
    """,
)
dialect(
    "tpch_q16",
    """
    SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem, part
    WHERE p_partkey = l_partkey AND p_size IN (1, 4, 9, 16, 25)
      AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
    GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size
    """,
)
dialect(
    "tpch_q17",
    """
    SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem, part
    WHERE p_partkey = l_partkey AND p_size < 10
      AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)
    """,
)
dialect(
    "tpch_q18",
    """
    SELECT c_name, c_custkey, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS total_qty
    FROM customer, orders, lineitem
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200)
      AND c_custkey = o_custkey AND o_orderkey = l_orderkey
    GROUP BY c_name, c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100
    """,
)
dialect(
    "tpch_q19",
    """
    SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem, part
    WHERE (p_partkey = l_partkey AND p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11)
       OR (p_partkey = l_partkey AND p_size BETWEEN 6 AND 15 AND l_quantity BETWEEN 10 AND 20)
       OR (p_partkey = l_partkey AND p_size BETWEEN 16 AND 30 AND l_quantity BETWEEN 20 AND 30)
    """,
)
dialect(
    "tpch_q21",
    """
    SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders
    WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R'
      AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
      AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'A')
    GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100
    """,
)
dialect(
    "tpch_q22",
    """
    SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
    WHERE c_nationkey IN (1, 3, 5, 7) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00)
      AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)
    GROUP BY c_nationkey ORDER BY c_nationkey
    """,
)

# -- scans, projections, constants

dialect("scan_filter_project", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03 AND l_returnflag IN ('A', 'N')")
dialect("scan_not_null", "SELECT o_orderkey FROM orders WHERE o_orderstatus IS NOT NULL AND o_totalprice > 400000")
dialect("values_relation", "SELECT x, y FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(x, y) ORDER BY x")
dialect("dummy_relation", "SELECT 1 AS one, 'x' AS letter")
dialect("projection_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
dialect("renaming", "SELECT t.k AS order_key, t.p AS price FROM (SELECT o_orderkey, o_totalprice FROM orders) AS t(k, p) WHERE t.p < 2000")
dialect("cte", "WITH big (k, p) AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000), n AS (SELECT k, count(*) AS c FROM big GROUP BY k) SELECT k, c FROM n WHERE c > 1")
dialect("star_expansion", "SELECT n.* FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND r.r_name = 'ASIA'")

# -- joins

dialect("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000")
dialect("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_totalprice > 350000")
dialect("join_right", "SELECT c_custkey, n_name FROM customer RIGHT OUTER JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 9500")
dialect("join_full", "SELECT a.k AS left_key, b.k AS right_key FROM (SELECT s_suppkey AS k FROM supplier) a FULL OUTER JOIN (SELECT c_custkey * 2 AS k FROM customer WHERE c_custkey < 40) b ON a.k = b.k")
dialect("join_cross", "SELECT r_name, n_name FROM region, nation WHERE n_nationkey < 3")
dialect("join_theta", "SELECT a.n_nationkey AS lo, b.n_nationkey AS hi FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
dialect("join_using", "SELECT k, x, y FROM (SELECT n_regionkey AS k, n_name AS x FROM nation) a JOIN (SELECT r_regionkey AS k, r_name AS y FROM region) b USING (k)")

# -- subqueries

dialect("subquery_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
dialect("subquery_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
dialect("subquery_in", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
dialect("subquery_not_in", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey END FROM lineitem)", "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey % 2 = 0 AND l_suppkey = s_suppkey)")
dialect("subquery_any", "SELECT c_custkey FROM customer WHERE c_acctbal > ANY (SELECT s_acctbal FROM supplier WHERE s_nationkey = c_nationkey)")
dialect("subquery_all", "SELECT c_custkey FROM customer WHERE c_acctbal >= ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey = c_nationkey)")
dialect("subquery_some_equal", "SELECT n_name FROM nation WHERE n_nationkey = SOME (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
dialect("subquery_scalar_correlated", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
dialect("subquery_count_bug", "SELECT c_custkey FROM customer WHERE 0 = (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)")
dialect("subquery_scalar_uncorrelated", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
dialect("mark_join_exists", "SELECT s_suppkey, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50 AND l_tax = 0.08) AS hit FROM supplier")
dialect("mark_join_or", "SELECT c_custkey FROM customer WHERE c_acctbal > 9900 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
dialect("subquery_having", "SELECT l_suppkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > (SELECT avg(q) FROM (SELECT sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey) AS s)")
dialect("subquery_non_equi", "SELECT n_nationkey, (SELECT count(*) FROM region WHERE r_regionkey < n_regionkey) AS below FROM nation")

# -- aggregation

dialect("agg_basic", "SELECT l_returnflag, count(*) AS n, count(l_tax) AS nt, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_discount), 8) AS mean FROM lineitem GROUP BY l_returnflag")
dialect("agg_no_keys_empty", "SELECT count(*) AS n, sum(l_quantity) AS s, min(l_orderkey) AS m FROM lineitem WHERE l_quantity < 0")
dialect("agg_distinct", "SELECT l_linestatus, count(DISTINCT l_suppkey) AS ns, count(DISTINCT l_partkey) AS np, sum(DISTINCT l_linenumber) AS sl FROM lineitem GROUP BY l_linestatus", types={"sl": "BIGINT"})
dialect("agg_stddev", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 5) AS vs FROM lineitem GROUP BY l_returnflag")
dialect("agg_group_expression", "SELECT abs(o_custkey % 7 - 3) AS bucket, count(*) AS n FROM orders GROUP BY abs(o_custkey % 7 - 3)")
dialect("agg_null_group", "SELECT o.o_orderpriority AS p, count(*) AS n FROM customer LEFT OUTER JOIN orders o ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY o.o_orderpriority")
dialect("rollup_grouping", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS a, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2 FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)", types={"g1": "TINYINT", "g2": "TINYINT"})
dialect("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")

# -- windows

dialect("win_rank", "SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS r FROM supplier", types={"r": "INTEGER"})
dialect("win_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders", types={"rn": "INTEGER"})
dialect(
    "win_running_sum_rows",
    "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS run FROM orders",
    "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS run FROM orders",
)
dialect("win_moving_avg", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS m FROM orders")
dialect("win_partition_total", "SELECT s_suppkey, count(*) OVER (PARTITION BY s_nationkey) AS n, round(max(s_acctbal) OVER (PARTITION BY s_nationkey), 2) AS top FROM supplier")
dialect(
    "win_over_aggregate",
    "SELECT o_orderpriority, o_orderstatus, count(*) AS n, sum(count(*)) OVER (PARTITION BY o_orderpriority) AS total FROM orders GROUP BY o_orderpriority, o_orderstatus",
    types={"total": "BIGINT"},
)

# -- order, limit, sets

dialect("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
dialect("order_by_position", "SELECT n_regionkey, n_name FROM nation ORDER BY 1, 2 DESC LIMIT 7")
dialect(
    "null_order",
    "SELECT k, v FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer) AS t ORDER BY v DESC, k LIMIT 40",
    "SELECT k, v FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer) AS t ORDER BY v DESC NULLS FIRST, k LIMIT 40",
)
dialect("limit_offset", "SELECT n_name FROM nation ORDER BY n_name LIMIT 5 OFFSET 3")
dialect("set_union_all", "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer")
dialect("set_union", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
dialect("set_intersect", "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice < 50000")
dialect("set_intersect_all", "SELECT s_nationkey AS k FROM supplier INTERSECT ALL SELECT c_nationkey FROM customer WHERE c_custkey < 60")
dialect("set_except", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
dialect("set_except_all", "SELECT c_nationkey AS k FROM customer WHERE c_custkey < 200 EXCEPT ALL SELECT s_nationkey FROM supplier")

# -- scalar expressions

dialect("expr_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, CASE p_size WHEN 1 THEN 'one' ELSE 'other' END AS simple FROM part")
dialect("expr_coalesce", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, 'none') AS name FROM customer")
dialect("expr_like", "SELECT p_partkey FROM part WHERE p_type LIKE '%BRASS' OR p_name NOT LIKE '%a%' OR p_brand LIKE 'Brand#_2'")
dialect("expr_between_in", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 12 AND p_size NOT IN (11) AND NOT (p_retailprice NOT BETWEEN 900 AND 2000)")
dialect(
    "expr_integer_division",
    "SELECT o_orderkey, CAST(o_orderkey / 7 AS bigint) AS q, o_orderkey % 7 AS r FROM orders",
    "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r FROM orders",
)
dialect("expr_three_valued", "SELECT c_custkey, (CASE WHEN c_custkey % 2 = 0 THEN TRUE END) AND c_acctbal > 0 AS a, (CASE WHEN c_custkey % 2 = 0 THEN TRUE END) OR c_acctbal > 0 AS o FROM customer")
dialect(
    "fn_substring",
    "SELECT c_custkey, substring(c_name, -1, 4) AS a, substr(c_name, 3, 5) AS b, substring(c_name FROM 5) AS c FROM customer",
    "SELECT c_custkey, substring(c_name, 1, 2) AS a, substr(c_name, 3, 5) AS b, substring(c_name, 5) AS c FROM customer",
)
dialect("fn_string", "SELECT p_partkey, upper(p_name) AS u, length(p_type) AS n, p_brand || '/' || p_type AS j FROM part", types={"n": "INTEGER"})
dialect("fn_regexp_replace", r"SELECT c_custkey, regexp_replace(c_name, '([A-Za-z]+)#', '<\1>') AS r FROM customer", r"SELECT c_custkey, regexp_replace(c_name, '([A-Za-z]+)#', '<\1>') AS r FROM customer")
dialect("fn_math", "SELECT c_custkey, round(c_acctbal, 1) AS r, abs(c_acctbal) AS a FROM customer")
dialect("fn_extract", "SELECT o_orderkey, EXTRACT(year FROM o_orderdate) AS y, EXTRACT(month FROM o_orderdate) AS m, EXTRACT(day FROM o_orderdate) AS d FROM orders", "SELECT o_orderkey, CAST(EXTRACT(year FROM o_orderdate) AS INTEGER) AS y, CAST(EXTRACT(month FROM o_orderdate) AS INTEGER) AS m, CAST(EXTRACT(day FROM o_orderdate) AS INTEGER) AS d FROM orders")
dialect("fn_date_trunc", "SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY date_trunc('month', o_orderdate)", "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, count(*) AS n FROM orders GROUP BY 1")
dialect("fn_date_interval", "SELECT o_orderkey, o_orderdate + INTERVAL '1' MONTH AS later, o_orderdate - INTERVAL '5' DAY AS earlier FROM orders")
dialect("fn_cast", "SELECT o_orderkey, CAST(o_totalprice AS decimal(18,1)) AS d, o_orderkey::text AS t, CAST('17' AS int) AS i, CAST(o_orderdate AS date)::text AS day FROM orders", "SELECT o_orderkey, CAST(o_totalprice AS decimal(18,1)) AS d, CAST(o_orderkey AS VARCHAR) AS t, CAST('17' AS int) AS i, CAST(CAST(o_orderdate AS date) AS VARCHAR) AS day FROM orders")

# -- pipes

dialect("pipe_where_select", "FROM orders |> WHERE o_totalprice > 300000 |> SELECT o_orderkey, o_custkey", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000")
dialect("pipe_extend_set_drop", "FROM nation |> EXTEND n_nationkey * 2 AS twice |> SET n_regionkey = n_regionkey + 1 |> DROP n_name", "SELECT n_nationkey, n_regionkey + 1 AS n_regionkey, n_nationkey * 2 AS twice FROM nation")
dialect("pipe_aggregate", "FROM lineitem |> AGGREGATE count(*) AS n, max(l_quantity) AS hi GROUP BY l_returnflag |> WHERE n > 10", "SELECT l_returnflag, count(*) AS n, max(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag HAVING count(*) > 10")
dialect("pipe_rollup", "FROM lineitem |> WHERE l_quantity > 10 |> AGGREGATE count(*) AS n GROUP BY ROLLUP(l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY ROLLUP(l_returnflag, l_linestatus)")
dialect("pipe_join", "FROM customer |> LEFT JOIN nation ON c_nationkey = n_nationkey |> WHERE c_acctbal > 9000 |> SELECT c_custkey, n_name", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
dialect("pipe_order_limit", "FROM orders |> ORDER BY o_totalprice DESC, o_orderkey |> LIMIT 5 |> SELECT o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
dialect("pipe_sets", "FROM supplier |> SELECT s_nationkey AS k |> UNION ALL (SELECT c_nationkey FROM customer) |> EXCEPT (SELECT n_nationkey FROM nation WHERE n_nationkey > 10)", "SELECT k FROM (SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer) EXCEPT SELECT n_nationkey FROM nation WHERE n_nationkey > 10")
dialect("pipe_distinct", "FROM lineitem |> SELECT DISTINCT l_returnflag", "SELECT DISTINCT l_returnflag FROM lineitem")

# -- the events table

dialect("json_free_events", "SELECT event_type, count(*) AS n, round(sum(value), 3) AS s FROM events GROUP BY event_type")
dialect("events_hourly", "SELECT date_trunc('hour', ts) AS h, event_type, count(DISTINCT user_id) AS users FROM events GROUP BY date_trunc('hour', ts), event_type", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
