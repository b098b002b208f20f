"""Queries of the SELECT dialect."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.catalog import query
from geoloom.sql import execute_sql

from .views import table


def statement(name: str, source: str, text: str, oracle: str) -> None:
    @query(name, oracle)
    def run(spark, sf_dir):  # noqa: ANN001, ANN202
        return execute_sql(table(spark, sf_dir, source), text)


statement(
    "sql_select_where", "lineitem",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'a' AND l_quantity BETWEEN 10 AND 20",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE lower(l_returnflag) = 'a' AND l_quantity BETWEEN 10 AND 20",
)
statement(
    "sql_arith_div", "lineitem",
    "SELECT l_orderkey, l_linenumber, l_orderkey / (l_linenumber - 3) AS q, l_orderkey % (l_linenumber - 3) AS m, -l_linenumber * 2 + 7 AS e FROM lineitem",
    "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber = 3 THEN 2147483647 ELSE l_orderkey // (l_linenumber - 3) END AS BIGINT) q, CAST(CASE WHEN l_linenumber = 3 THEN 2147483647 ELSE l_orderkey % (l_linenumber - 3) END AS BIGINT) m, CAST(-l_linenumber * 2 + 7 AS BIGINT) e FROM lineitem",
)
statement("sql_in_null", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber NOT IN (1, NULL)", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber NOT IN (1)")
statement("sql_like", "part", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%bol_' AND p_name NOT LIKE 'BLUE%'", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%bol_' AND p_name NOT LIKE 'BLUE%'")
statement("sql_fold_letters", "part", "SELECT p_partkey FROM part WHERE p_type = 'eCoNoMy' OR p_name IN ('RED BOLT', 'Hot Gear') OR p_brand < 'BRAND#11'", "SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' OR p_name IN ('red bolt', 'hot gear') OR lower(p_brand) < 'brand#11'")
statement("sql_ilike_escape", "part", "SELECT p_partkey, p_brand FROM part WHERE p_brand ILIKE 'BRAND!#%' ESCAPE '!' OR p_name ILIKE '%!%%' ESCAPE '!'", "SELECT p_partkey, p_brand FROM part WHERE p_brand ILIKE 'BRAND!#%' ESCAPE '!' OR p_name ILIKE '%!%%' ESCAPE '!'")
statement(
    "sql_agg_all", "orders",
    "SELECT COUNT(*) AS n, COUNT(DISTINCT o_orderpriority) AS d, SUM(o_custkey) AS s, MIN(o_orderstatus) AS lo, MAX(o_orderpriority) AS hi, MIN(o_totalprice) AS cheap FROM orders ORDER BY o_orderkey LIMIT 1",
    "SELECT count(*) n, count(DISTINCT o_orderpriority) d, CAST(sum(o_custkey) AS BIGINT) s, min(o_orderstatus) lo, max(o_orderpriority) hi, min(o_totalprice) cheap FROM orders",
)
statement("sql_distinct", "part", "SELECT DISTINCT p_brand FROM part", "SELECT DISTINCT p_brand FROM part")
statement(
    "sql_order_limit", "orders",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS FIRST LIMIT 50 OFFSET 10",
)
statement(
    "sql_cast_prefix", "orders",
    "SELECT o_orderkey, CAST(o_orderpriority AS INTEGER) AS p, CAST(o_totalprice AS INTEGER) AS t, CAST(o_orderkey AS SMALLINT) AS w, CAST(o_orderpriority AS CHARACTER(3)) AS c FROM orders",
    "SELECT o_orderkey, coalesce(try_cast(regexp_extract(o_orderpriority, '^\\s*([-+]?\\d+)', 1) AS INT), 0) p, CAST(trunc(o_totalprice) AS INT) t, CAST((o_orderkey + 32768) % 65536 - 32768 AS SMALLINT) w, substr(o_orderpriority, 1, 3) c FROM orders",
)
statement("sql_concat", "nation", "SELECT n_nationkey, CONCAT(n_name, '-', n_name) AS cc, n_name + '!' AS pp FROM nation", "SELECT n_nationkey, n_name || '-' || n_name cc, n_name || '!' pp FROM nation")
statement(
    "sql_substr", "nation",
    "SELECT n_nationkey, SUBSTR(n_name, 0, 2) AS a, SUBSTR(n_name, -3, 2) AS b, SUBSTR(n_name, -100, 3) AS c, SUBSTR(n_name, 3) AS d FROM nation",
    "SELECT n_nationkey, substr(n_name, 1, 2) a, substr(n_name, greatest(length(n_name) - 3, 0) + 1, 2) b, substr(n_name, greatest(length(n_name) - 100, 0) + 1, 3) c, substr(n_name, 3) d FROM nation",
)


def nullable(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("nullif(l_linenumber, 3)").alias("n"))


NULLABLE = "t AS (SELECT l_orderkey, l_linenumber, nullif(l_linenumber, 3) n FROM lineitem)"


@query("sql_is_null", f"WITH {NULLABLE} SELECT l_orderkey, l_linenumber FROM t WHERE n IS NULL OR NOT n IS NOT NULL")
def sql_is_null(spark, sf_dir):  # noqa: ANN001, ANN201
    return execute_sql(nullable(spark, sf_dir), "SELECT l_orderkey, l_linenumber FROM t WHERE n IS NULL OR NOT n IS NOT NULL")


@query("sql_between_null", f"WITH {NULLABLE} SELECT l_orderkey, l_linenumber, n FROM t WHERE l_linenumber NOT BETWEEN n AND 5")
def sql_between_null(spark, sf_dir):  # noqa: ANN001, ANN201
    return execute_sql(nullable(spark, sf_dir), "SELECT l_orderkey, l_linenumber, n FROM t WHERE l_linenumber NOT BETWEEN n AND 5")


@query("sql_kleene", f"WITH {NULLABLE} SELECT l_orderkey, l_linenumber FROM t WHERE NOT (n > 2 AND l_linenumber > 3) OR n = 1")
def sql_kleene(spark, sf_dir):  # noqa: ANN001, ANN201
    return execute_sql(nullable(spark, sf_dir), "SELECT l_orderkey, l_linenumber FROM t WHERE NOT (n > 2 AND l_linenumber > 3) OR n = 1")
