"""Tables of the harness, and the same with faults that are the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Each with the SQL of the same rows.
VIEWS = {
    "cust": """SELECT c_custkey AS id, c_nationkey AS nation, CAST(CASE WHEN c_custkey % 97 = 0 THEN n_regionkey + 1 WHEN c_custkey % 89 = 0 THEN NULL ELSE n_regionkey END AS INT) AS region,
        c_mktsegment AS segment, CASE WHEN c_custkey % 101 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 499 = 0 THEN concat('X', c_custkey) ELSE c_mktsegment END AS spelled, c_acctbal AS balance
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "ord": """SELECT o_orderkey AS id, o_custkey AS customer_id, o_orderstatus AS status, o_orderpriority AS priority, CAST(o_totalprice * 100 AS BIGINT) AS cents, o_orderdate AS placed,
        CASE WHEN o_orderkey % 211 = 0 THEN o_orderkey + 1000000000 ELSE o_custkey END AS broken_customer FROM orders""",
    "item": """SELECT l_orderkey AS order_id, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS quantity, CAST(l_discount * 100 AS BIGINT) AS discount, CAST(l_tax * 100 AS BIGINT) AS tax,
        CAST(l_quantity AS BIGINT) + CAST(l_discount * 100 AS BIGINT) + CASE WHEN (l_orderkey + l_linenumber) % 131 = 0 THEN 7 ELSE 0 END AS charge, l_returnflag AS flag, l_linestatus AS state FROM lineitem""",
    "part2": """SELECT p_partkey AS id, p_size AS size, p_size * 2 AS doubled, CAST(CASE WHEN p_partkey % 113 = 0 THEN p_size * 3 + 1 ELSE p_size * 3 END AS INT) AS tripled, p_brand AS brand, p_type AS type FROM part""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables in sf_dir."""
    sql = VIEWS[name]
    for table in ("customer", "nation", "orders", "lineitem", "part"):
        if f" {table}" in sql:
            t(spark, sf_dir, table).createOrReplaceTempView(f"_in_{table}")
            sql = sql.replace(f"FROM {table}", f"FROM _in_{table}").replace(f"JOIN {table}", f"JOIN _in_{table}")
    return spark.sql(sql)


def using(*names: str) -> str:
    """WITH clause of views for SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n"
