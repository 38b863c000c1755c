"""The cohort that the registered queries run on, and their registry.

``cohort`` is orders with customer and nation: id, label by order status, year, drug by
market segment, target by nation, disease by priority, two scores and four features.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import hash_order

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that DuckDB checks it by.

    SQL that does not begin with its own WITH goes on from that of the cohort, ``c``.
    """

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql if sql.startswith("WITH") else C + sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    id_ = F.col("o_orderkey")
    label = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).otherwise(-1)
    a, b = hash_order(id_, "a"), hash_order(id_, "b")
    return joined.select(
        id_.alias("id"),
        F.col("o_custkey").alias("customer"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "unmapped").otherwise(F.col("c_mktsegment")).alias("drug"),
        F.col("n_name").alias("target"),
        F.col("n_regionkey").alias("region"),
        F.col("o_orderpriority").alias("disease"),
        F.when(F.pmod(id_, F.lit(97)) != 0, F.year("o_orderdate")).alias("year"),
        F.col("o_orderstatus").alias("status"),
        label.alias("label"),
        F.when((label == -1) & (F.pmod(id_, F.lit(4)) == 0), 1).otherwise(label).alias("label_b"),
        F.col("o_totalprice").alias("price"),
        ((F.pmod(a, F.lit(1000)) + F.when(label == 1, 150).otherwise(0)) / 1150.0).alias("p"),
        (F.pmod(b, F.lit(1000)) / 1000.0).alias("q"),
        F.when(F.pmod(id_, F.lit(7)) != 0, F.col("o_totalprice") / 100000.0).alias("x1"),
        (F.pmod(b, F.lit(100)) / 100.0).alias("x2"),
        F.when(F.pmod(id_, F.lit(11)) != 0, F.pmod(a, F.lit(50)) / 50.0).alias("x3"),
        (F.col("c_acctbal") / 10000.0).alias("x4"),
    )


C = """
WITH c AS (
  SELECT o_orderkey AS id, o_custkey AS customer, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'unmapped' ELSE c_mktsegment END AS drug,
    n_name AS target, n_regionkey AS region, o_orderpriority AS disease,
    CASE WHEN o_orderkey % 97 <> 0 THEN year(o_orderdate)::INT END AS year, o_orderstatus AS status,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE -1 END AS label,
    CASE WHEN o_orderstatus NOT IN ('F', 'O') AND o_orderkey % 4 = 0 THEN 1 WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 ELSE -1 END AS label_b,
    o_totalprice AS price,
    ((('0x' || substr(md5('a:' || o_orderkey::VARCHAR), 1, 8))::BIGINT % 1000) + CASE WHEN o_orderstatus = 'F' THEN 150 ELSE 0 END)::DOUBLE / 1150.0::DOUBLE AS p,
    (('0x' || substr(md5('b:' || o_orderkey::VARCHAR), 1, 8))::BIGINT % 1000)::DOUBLE / 1000.0::DOUBLE AS q,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 100000.0::DOUBLE END AS x1,
    (('0x' || substr(md5('b:' || o_orderkey::VARCHAR), 1, 8))::BIGINT % 100)::DOUBLE / 100.0::DOUBLE AS x2,
    CASE WHEN o_orderkey % 11 <> 0 THEN (('0x' || substr(md5('a:' || o_orderkey::VARCHAR), 1, 8))::BIGINT % 50)::DOUBLE / 50.0::DOUBLE END AS x3,
    c_acctbal / 10000.0::DOUBLE AS x4
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
