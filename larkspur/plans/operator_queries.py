"""Queries through the DataFrame operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import joins, relational
from ..session import Engine
from .registry import register


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op_mark_join", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000) AS rich FROM customer")
def op_mark_join(spark, d):
    big = t(spark, d, "orders").filter("o_totalprice > 350000")
    return joins.mark_join(t(spark, d, "customer").select("c_custkey"), big, [("c_custkey", "o_custkey")], "rich")


@register("op_single_join", "SELECT n_nationkey, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey AND r_regionkey > 1) AS r_name FROM nation")
def op_single_join(spark, d):
    right = t(spark, d, "region").filter("r_regionkey > 1")
    return joins.single_join(t(spark, d, "nation"), right, [("n_regionkey", "r_regionkey")], ["r_name"], check=True).select("n_nationkey", "r_name")


@register(
    "op_collection_join",
    """SELECT r_regionkey, len(ns) AS n, array_to_string(ns, ',') AS names
       FROM (SELECT r_regionkey, (SELECT coalesce(list(n_name ORDER BY n_name), []) FROM nation WHERE n_regionkey = r_regionkey) AS ns FROM region)""",
)
def op_collection_join(spark, d):
    out = joins.collection_join(t(spark, d, "region"), t(spark, d, "nation"), [("r_regionkey", "n_regionkey")], ["n_name"], "ns")
    return out.select("r_regionkey", F.size("ns").cast("bigint").alias("n"), F.array_join(F.transform("ns", lambda x: x["n_name"]), ",").alias("names"))


@register("op_group_join", "SELECT c_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def op_group_join(spark, d):
    aggs = [F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")]
    return joins.group_join(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders"), [("c_custkey", "o_custkey")], aggs)


@register("op_group_join_outer", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def op_group_join_outer(spark, d):
    out = joins.group_join(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders"), [("c_custkey", "o_custkey")], [F.count("*").alias("n")], "left")
    return out.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@register(
    "op_compatible_join",
    """WITH l AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_regionkey END AS r FROM nation),
            m AS (SELECT r_regionkey AS r, r_name AS nm FROM region)
       SELECT k, coalesce(l.r, m.r) AS r, nm FROM l JOIN m ON l.r IS NULL OR m.r IS NULL OR l.r = m.r""",
)
def op_compatible_join(spark, d):
    left = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey")).alias("r"))
    right = t(spark, d, "region").select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("nm"))
    return joins.compatible_join(left, right, ["r"], [])


@register("op_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def op_not_exists(spark, d):
    return joins.not_exists(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders"), [("c_custkey", "o_custkey")])


@register(
    "op_rollup",
    "SELECT o_orderpriority, o_orderstatus, count(*) AS n, grouping(o_orderpriority) AS grouping_o_orderpriority, grouping(o_orderstatus) AS grouping_o_orderstatus FROM orders GROUP BY ROLLUP(o_orderpriority, o_orderstatus)",
)
def op_rollup(spark, d):
    out = relational.rollup(t(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], F.count("*").alias("n"))
    return out.withColumns({c: F.col(c).cast("bigint") for c in out.columns if c.startswith("grouping_")})


@register("op_set_types", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation UNION SELECT s_suppkey FROM supplier")
def op_set_types(spark, d):
    return relational.union(t(spark, d, "nation").select(F.col("n_nationkey").alias("k")), t(spark, d, "supplier").select("s_suppkey"))


@register("op_top_k_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 5")
def op_top_k_offset(spark, d):
    return relational.top_k(t(spark, d, "customer").select("c_custkey", "c_acctbal"), [("c_acctbal", True), ("c_custkey", False)], 10, 5)


@register("op_running", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS n FROM orders")
def op_running(spark, d):
    return relational.running(t(spark, d, "orders"), "n", F.count("*"), ["o_custkey"], [("o_orderdate", False), ("o_orderkey", False)]).select("o_orderkey", "n")


@register("op_moving", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM orders")
def op_moving(spark, d):
    return relational.moving(t(spark, d, "orders"), "m", F.max("o_totalprice"), ["o_custkey"], [("o_orderdate", False), ("o_orderkey", False)], 3, 3).select("o_orderkey", "m")


@register(
    "fn_strings_more",
    "SELECT c_custkey, instr(c_name, '#') - 1 AS at, ascii(c_name) AS first, lower(c_name) AS l, contains(c_name, '00') AS has, replace(c_name, '0', 'o') AS r, len(string_split(c_name, '#')) AS parts FROM customer",
)
def fn_strings_more(spark, d):
    c = F.col("c_name")
    return t(spark, d, "customer").select("c_custkey", expr.find(c, "#").cast("bigint").alias("at"), expr.ordinal(c).alias("first"), F.lower(c).alias("l"), c.contains("00").alias("has"), F.replace(c, F.lit("0"), F.lit("o")).alias("r"), F.size(F.split(c, "#")).cast("bigint").alias("parts"))


@register(
    "fn_math_more",
    "SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS s, round(sin(c_custkey), 6) AS sn, round(cos(c_custkey), 6) AS cs, round(asin((c_custkey % 100) / 100.0), 6) AS sa, round(exp((c_custkey % 10)), 4) AS e, round(ln(c_custkey + 1), 6) AS l FROM customer",
)
def fn_math_more(spark, d):
    k = F.col("c_custkey")
    return t(spark, d, "customer").select(k, F.round(F.sqrt(F.abs("c_acctbal")), 6).alias("s"), F.round(F.sin(k), 6).alias("sn"), F.round(F.cos(k), 6).alias("cs"), F.round(F.asin((k % 100) / 100.0), 6).alias("sa"), F.round(F.exp(k % 10), 4).alias("e"), F.round(F.ln(k + 1), 6).alias("l"))


@register("fn_date_diff", "SELECT o_orderkey, date_diff('day', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS days, date_diff('hour', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS hours FROM orders")
def fn_date_diff(spark, d):
    start = F.lit("1992-01-01 00:00:00").cast("timestamp_ntz")
    return t(spark, d, "orders").select("o_orderkey", expr.date_diff("day", start, F.col("o_orderdate")).alias("days"), expr.date_diff("hour", start, F.col("o_orderdate")).alias("hours"))


@register("fn_lists", "SELECT n_nationkey, array_to_string([n_nationkey, 99, n_regionkey], ',') AS l, 3 AS n, n_regionkey AS last FROM nation")
def fn_lists(spark, d):
    made = F.array_append(expr.list_set(F.array("n_nationkey", "n_regionkey"), 1, F.lit(99)), F.col("n_regionkey"))
    return t(spark, d, "nation").select("n_nationkey", F.array_join(made.cast("array<string>"), ",").alias("l"), F.size(made).alias("n"), F.element_at(made, -1).alias("last"))


@register("fn_dicts", "SELECT n_nationkey, 2 AS n, n_regionkey + 1 AS v, TRUE AS has FROM nation")
def fn_dicts(spark, d):
    m = expr.dict_set(F.create_map(F.lit("a"), F.col("n_nationkey"), F.lit("b"), F.col("n_regionkey")), F.lit("b"), F.col("n_regionkey") + 1)
    return t(spark, d, "nation").select("n_nationkey", F.size(m).alias("n"), F.element_at(m, "b").alias("v"), F.map_contains_key(m, "a").alias("has"))


@register("fn_erf", None)
def fn_erf(spark, d):
    x = (F.col("c_acctbal") / 5000.0)
    return t(spark, d, "customer").select("c_custkey", F.round(expr.erf(x), 12).alias("e"))


@register("fn_null_safe", "SELECT c_custkey, (CASE WHEN c_custkey % 2 = 0 THEN 1 END) IS NOT DISTINCT FROM (CASE WHEN c_custkey % 3 = 0 THEN 1 END) AS same FROM customer")
def fn_null_safe(spark, d):
    one = lambda k: F.when(F.col("c_custkey") % k == 0, 1)
    return t(spark, d, "customer").select("c_custkey", expr.null_safe_equal(one(2), one(3)).alias("same"))


@register("agg_avg_exact", "SELECT l_returnflag, round(avg(l_linenumber), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def agg_avg_exact(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(expr.avg_exact(F.col("l_linenumber")).cast("double"), 6).alias("mean"))


@register("agg_group_concat", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_group_concat(spark, d):
    return t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ";").alias("names"))


@register("agg_any", "SELECT n_regionkey, any_value(r) AS r FROM (SELECT n_regionkey, n_regionkey * 2 AS r FROM nation) GROUP BY n_regionkey")
def agg_any(spark, d):
    return t(spark, d, "nation").groupBy("n_regionkey").agg(F.any_value(F.col("n_regionkey") * 2, F.lit(True)).alias("r"))


@register("ddl_insert_select", "SELECT n_regionkey AS region, count(*) AS n FROM nation WHERE n_nationkey < 20 GROUP BY n_regionkey")
def ddl_insert_select(spark, d):
    e = Engine(spark)
    e.add_table("nation", t(spark, d, "nation"))
    return e.sql(
        """CREATE TABLE chosen (region int NOT NULL, name varchar(25), PRIMARY KEY (region, name));
           INSERT INTO chosen (name, region) SELECT n_name, n_regionkey FROM nation WHERE n_nationkey < 10;
           INSERT INTO chosen SELECT n_regionkey, n_name FROM nation WHERE n_nationkey BETWEEN 10 AND 19;
           SELECT region, count(*) AS n FROM chosen GROUP BY region"""
    )


@register("udf_scalar", "SELECT n_nationkey, n_nationkey * 3 + n_regionkey AS v, n_nationkey % 2 = 0 AS even FROM nation")
def udf_scalar(spark, d):
    e = Engine(spark)
    e.add_table("nation", t(spark, d, "nation"))
    return e.sql(
        """CREATE OR REPLACE FUNCTION lk_mix(a int, b int) RETURNS int LANGUAGE c AS $$ return a * 3 + b; $$;
           CREATE OR REPLACE FUNCTION lk_even(a bigint) RETURNS bool LANGUAGE c AS $$ return a % 2 == 0; $$;
           SELECT n_nationkey, lk_mix(n_nationkey, n_regionkey) AS v, lk_even(n_nationkey) AS even FROM nation"""
    )


@register("tmp_shared_subplan", "WITH s AS (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT l_suppkey FROM s WHERE q >= (SELECT max(q) FROM s)")
def tmp_shared_subplan(spark, d):
    s = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return s.join(s.agg(F.max("q").alias("m")), F.col("q") >= F.col("m")).select("l_suppkey")  # one row; the aggregation is reused


@register("track_tuples", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 40")
def track_tuples(spark, d):
    df, _ = relational.tracked(t(spark, d, "lineitem").filter("l_quantity > 40"), "filtered")
    return df.agg(F.count("*").alias("n"))
