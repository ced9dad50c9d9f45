"""Layers over the synthetic tables, and a corpus of notebooks, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .sources.catalog import Layer, Table
from .sources.notebooks import notebooks

LOAD_ORDERS = """# Databricks notebook source
# MAGIC %md
# MAGIC ## Orders Clean!
# COMMAND ----------
# MAGIC %sql
# MAGIC CREATE OR REPLACE TABLE silver.orders AS SELECT * FROM bronze.orders WHERE o_orderstatus <> 'P'
# COMMAND ----------

# COMMAND ----------
threshold = 100
def clean(df):
    # drop nothing
    return df.where("x > 1")
# COMMAND ----------
# MAGIC %sql
# MAGIC SELECT count(*) FROM silver.orders"""

NOTEBOOKS = (
    ("/etl/load_orders", "PYTHON", LOAD_ORDERS),
    ("/etl/load_orders_v2", "PYTHON", LOAD_ORDERS.replace("'P'", "'F'").replace("threshold = 100", "threshold = 200").replace("x > 1", "x > 2")),
    (
        "/etl/load_orders_final",
        "SQL",
        "-- Databricks notebook source\nSELECT a FROM bronze.orders;\nselect  a from bronze.orders -- same\n-- COMMAND ----------\nCREATE TEMP VIEW recent AS SELECT * FROM silver.orders WHERE o_orderdate > '1997-01-01'",
    ),
    (
        "/etl/build_sales",
        "PYTHON",
        'stg = spark.sql("""CREATE OR REPLACE TABLE silver.stg_lineitem USING DELTA AS SELECT * FROM bronze.raw_lineitem WHERE l_returnflag <> \'R\'""")\n'
        "# COMMAND ----------\n"
        "spark.sql(\"INSERT OVERWRITE gold.fact_sales SELECT l.*, o.o_custkey FROM silver.stg_lineitem l JOIN silver.orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_totalprice > 1000\")\n"
        "spark.sql('MERGE INTO gold.dim_customer t USING bronze.customer s ON t.c_custkey = s.c_custkey WHEN NOT MATCHED THEN INSERT *')\n"
        "# COMMAND ----------\n"
        'spark.sql(f"SELECT * FROM {table}")',
    ),
    ("/etl/df_api", "PYTHON", 'df = spark.table("silver.orders").where("o_totalprice > 100000")\ndf.write.saveAsTable("gold.orders")'),
    ("/etl/udfs", "SCALA", 'def twice(x: Int): Int = {\n  if (x > 0) { x * 2 } else { 0 }\n}\ndef once(x: Int) = x\nval limit: Int = 5 // rows\nvar name = "a"'),
    (
        "/etl/quirks",
        "SQL",
        "-- Databricks notebook source\r\nCREATE TABLE silver.customer_map AS WITH c AS (SELECT * FROM bronze.customer WHERE c_acctbal > 0) SELECT c.c_custkey FROM c WHERE c_custkey BETWEEN 1 AND 100\r\n-- COMMAND ----------\r\n"
        "INSERT INTO `silver`.`stg_tmp` SELECT * FROM bronze.customer x WHERE x.c_acctbal < 0;\r\nSELECT ';' AS semi",
    ),
    ("/etl/rmodel", "R", "# Databricks notebook source\nlibrary(SparkR)\ndf <- sql('SELECT * FROM silver.orders')"),
    ("/etl/mystery", "UNKNOWN", "x = spark.sql('SELECT 1 FROM bronze.orders')"),
)


def corpus(spark: SparkSession) -> DataFrame:
    return notebooks(spark, list(NOTEBOOKS))


def layers(spark: SparkSession, sf_dir: str) -> list[Layer]:
    """Bronze, silver and gold over the parquet tables, and a layer without tables."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders, items, customer, events = t("orders"), t("lineitem"), t("customer"), t("events")
    kept = orders.where("o_orderstatus <> 'P'")
    stg = items.where("l_returnflag <> 'R'")
    sales = stg.join(kept, stg.l_orderkey == kept.o_orderkey).where("o_totalprice > 1000")
    return [
        Layer("bronze", "bronze", [Table(name, df, path=f"{sf_dir}/{table}.parquet") for name, table, df in (("orders", "orders", orders), ("raw_lineitem", "lineitem", items), ("customer", "customer", customer), ("events", "events", events))]),
        Layer("silver", "silver", [Table("orders", kept), Table("stg_lineitem", stg), Table("customer_map", customer.where("c_custkey BETWEEN 1 AND 100").select("c_custkey")), Table("stg_tmp", customer.where("c_acctbal < 0"))]),
        Layer("gold", "gold", [Table("orders", kept), Table("fact_sales", sales), Table("dim_customer", customer), Table("events", events.where("value > 50"))]),
        Layer("empty", "none", []),
    ]
