"""Arbitrary SQL over the star schema: what the gateway must be able to answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import gateway
from quillspark.plans.catalogue import query
from quillspark.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _views(spark, d):
    for t in TABLES:
        table(spark, d, t).createOrReplaceTempView(t)


def _sql(name: str, text: str, spark_text: str | None = None):
    """A query whose text both engines take, or nearly so."""

    def run(spark, d):
        _views(spark, d)
        if gateway.statement_kind(spark, spark_text or text) != "read":
            raise ValueError(f"{name} is not a read")
        return spark.sql(spark_text or text)

    run.__name__ = name
    query(name, text)(run)


_sql("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity),2) AS sum_qty, round(sum(l_extendedprice),2) AS sum_base, round(sum(l_extendedprice*(1-l_discount)),2) AS sum_disc, round(avg(l_quantity),4) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
_sql("regional_revenue", """SELECT n_name, round(sum(l_extendedprice*(1-l_discount)),2) AS revenue FROM customer JOIN orders ON c_custkey=o_custkey JOIN lineitem ON l_orderkey=o_orderkey JOIN supplier ON l_suppkey=s_suppkey AND c_nationkey=s_nationkey
JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY n_name""")
_sql("top_customers", "SELECT c_custkey, c_name, round(sum(o_totalprice),2) AS total FROM customer JOIN orders ON c_custkey=o_custkey GROUP BY c_custkey, c_name ORDER BY total DESC, c_custkey LIMIT 20")
_sql("order_priority_exists", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey AND l_quantity>40) GROUP BY o_orderpriority")
_sql("customers_without_orders", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey) GROUP BY c_mktsegment")
_sql("parts_never_shipped", "SELECT p_brand, count(*) AS n FROM part LEFT JOIN lineitem ON l_partkey=p_partkey WHERE l_partkey IS NULL GROUP BY p_brand")
_sql("balance_theta_join", "SELECT n_name, count(*) AS pairs FROM nation JOIN supplier ON n_nationkey=s_nationkey JOIN customer ON c_nationkey=n_nationkey AND c_acctbal>s_acctbal GROUP BY n_name")
_sql("nation_set_operations", """SELECT k, 'both' AS part FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) x UNION ALL SELECT k, 'customers' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) y
UNION ALL SELECT k, 'suppliers' FROM (SELECT s_nationkey AS k FROM supplier EXCEPT SELECT c_nationkey FROM customer) z""")
_sql("order_status_cube", "SELECT coalesce(o_orderstatus,'(all)') AS status, coalesce(o_orderpriority,'(all)') AS priority, count(*) AS n, round(sum(o_totalprice),2) AS total FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)")
_sql("segment_grouping_sets", """SELECT coalesce(c_mktsegment,'(all)') AS segment, coalesce(n_name,'(all)') AS nation, count(*) AS n, CAST(grouping(c_mktsegment) AS INT) AS g FROM customer JOIN nation ON c_nationkey=n_nationkey
GROUP BY GROUPING SETS ((c_mktsegment),(n_name),())""")
_sql("customer_ranks", "SELECT c_custkey, c_nationkey, r, d FROM (SELECT c_custkey, c_nationkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS r, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS d FROM customer) x WHERE r<=5")
_sql("running_order_totals", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),2) AS last3, count(*) OVER (PARTITION BY o_custkey) AS orders FROM orders")
_sql("event_properties", "SELECT event_type, CAST(json_extract_string(props,'$.k') AS INT) AS k, count(*) AS n, round(sum(value),2) AS total FROM events GROUP BY event_type, k", "SELECT event_type, CAST(get_json_object(props,'$.k') AS INT) AS k, count(*) AS n, round(sum(value),2) AS total FROM events GROUP BY 1, 2")
_sql("monthly_orders", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, round(avg(o_totalprice),2) AS mean FROM orders GROUP BY ALL", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, count(*) AS n, round(avg(o_totalprice),2) AS mean FROM orders GROUP BY 1, 2")
_sql("promotion_share", "SELECT p_brand, round(100.0*sum(CASE WHEN p_size>25 THEN l_extendedprice*(1-l_discount) ELSE 0 END)/sum(l_extendedprice*(1-l_discount)),4) AS share FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY p_brand")
_sql("large_orders_cte", "WITH big AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity)>200) SELECT o_orderstatus, count(*) AS n, round(max(q),2) AS most FROM big JOIN orders ON o_orderkey=l_orderkey GROUP BY o_orderstatus")
_sql("above_average_parts", "SELECT p_type, count(*) AS n FROM part p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part q WHERE q.p_brand=p.p_brand) GROUP BY p_type")


@query("capped_rows", "SELECT count(*) AS rows, true AS truncated FROM (SELECT 1 FROM lineitem LIMIT 500)")
def capped_rows(spark, d):
    g = gateway.Gateway(spark)
    _views(spark, d)
    r = g.query("SELECT l_orderkey, l_linenumber FROM lineitem")
    return spark.createDataFrame([(len(r.rows), r.truncated)], "rows long, truncated boolean")


@query("catalog_keys")
def catalog_keys(spark, d):
    """Keys and references of the star schema, joined as INFORMATION_SCHEMA frames are."""
    _views(spark, d)
    cols = spark.createDataFrame([("main", t, f.name, i, f.dataType.simpleString(), f.nullable) for t in TABLES for i, f in enumerate(table(spark, d, t).schema)], "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable boolean")
    keys = spark.createDataFrame([("main", t, k) for t, k in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"))], "table_schema string, table_name string, column_name string")
    fks = spark.createDataFrame([("main", *x) for x in (("nation", "n_regionkey", "main", "region", "r_regionkey"), ("customer", "c_nationkey", "main", "nation", "n_nationkey"), ("orders", "o_custkey", "main", "customer", "c_custkey"), ("lineitem", "l_orderkey", "main", "orders", "o_orderkey"))], "table_schema string, table_name string, column_name string, ref_schema string, ref_table string, ref_column string")
    return gateway.schema_tables(cols, keys, fks)


@query("key_integrity", "SELECT 'orders' AS child, count(*) AS n, count(*) FILTER (c_custkey IS NULL) AS orphans FROM orders LEFT JOIN customer ON o_custkey=c_custkey UNION ALL SELECT 'lineitem', count(*), count(*) FILTER (o_orderkey IS NULL) FROM lineitem LEFT JOIN orders ON l_orderkey=o_orderkey")
def key_integrity(spark, d):
    def check(child, parent, fk, pk, name):
        p = table(spark, d, parent).select(F.col(pk).alias("_p"))
        return table(spark, d, child).join(p, F.col(fk) == F.col("_p"), "left").agg(F.lit(name).alias("child"), F.count("*").alias("n"), F.count_if(F.col("_p").isNull()).alias("orphans"))

    return check("orders", "customer", "o_custkey", "c_custkey", "orders").unionByName(check("lineitem", "orders", "l_orderkey", "o_orderkey", "lineitem"))
