"""The ledger view over the star-schema tables, and the same view as SQL.

Orders become ledger rows: the order status gives the type (urgent expenses are taxes), the priority
gives the class, customer, nation and region give counterparty, bank and person.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.schema import DOUBTFUL, EXPENSE, INCOME, NEEDED, SURPLUS, TAX, TRANSFER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    status, priority = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    rows = (
        o.join(c, o.o_custkey == c.c_custkey)
        # nation and region are dimensions of 25 and 5 rows
        .join(F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey)), c.c_nationkey == n.n_nationkey)
    )
    return rows.select(
        F.col("o_orderkey").alias("identificador"),
        F.to_date("o_orderdate").alias("data"),
        F.date_format(F.to_date("o_orderdate"), "yyyy-MM").alias("mes_ref"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("valor"),
        F.when((status == "F") & (F.col("o_orderpriority") == "1-URGENT"), TAX).when(status == "F", EXPENSE)
        .when(status == "O", INCOME).otherwise(TRANSFER).alias("tipo"),
        F.when(priority.isin("1", "2"), NEEDED).when(priority == "3", DOUBTFUL).otherwise(SURPLUS).alias("classificacao"),
        F.col("r_name").alias("quem"), F.col("n_name").alias("banco_origem"), F.col("c_name").alias("local"),
        F.col("c_mktsegment").alias("categoria"),
    )


SQL = f"""ledger AS (
  SELECT o_orderkey AS identificador, CAST(o_orderdate AS DATE) AS data, strftime(o_orderdate, '%Y-%m') AS mes_ref,
    CAST(o_totalprice AS DECIMAL(18,2)) AS valor,
    CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN '{TAX}' WHEN o_orderstatus = 'F' THEN '{EXPENSE}'
      WHEN o_orderstatus = 'O' THEN '{INCOME}' ELSE '{TRANSFER}' END AS tipo,
    CASE WHEN substring(o_orderpriority, 1, 1) IN ('1', '2') THEN '{NEEDED}'
      WHEN substring(o_orderpriority, 1, 1) = '3' THEN '{DOUBTFUL}' ELSE '{SURPLUS}' END AS classificacao,
    r_name AS quem, n_name AS banco_origem, c_name AS local, c_mktsegment AS categoria
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
