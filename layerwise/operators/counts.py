"""Row counts of tables and stages."""

from __future__ import annotations

from contextlib import suppress
from functools import reduce
from itertools import chain

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.catalog import Layer
from .pool import WORKERS, each

SCHEMA = "layer_ord int, label string, schema string, tbl_ord int, table string, row_count long"


def table_counts(spark: SparkSession, layers: list[Layer]) -> DataFrame:
    """SCHEMA: a row a table, all counted in one job; a table that can't be counted fails it."""
    rows = [
        t.df.groupBy().agg(F.count("*").alias("row_count")).select(
            F.lit(i).alias("layer_ord"), F.lit(x.label).alias("label"), F.lit(x.schema).alias("schema"), F.lit(j).alias("tbl_ord"), F.lit(t.name).alias("table"), "row_count"
        )
        for i, x in enumerate(layers)
        for j, t in enumerate(x.tables)
    ]
    while len(rows) > 1:  # by halves: a plan for thousands of tables stays shallow
        rows = [reduce(DataFrame.unionAll, rows[i : i + 8]) for i in range(0, len(rows), 8)]
    return rows[0] if rows else spark.createDataFrame([], SCHEMA)


def safe_table_counts(spark: SparkSession, layers: list[Layer], workers: int = WORKERS, limit: float | None = None) -> DataFrame:
    """As table_counts, but a table that can't be counted, or not within `limit` seconds, has a null count.

    Without a limit all are counted in one job; only if that fails, or with a limit, is each counted by itself, several
    at a time.
    """
    rows = None
    if limit is None:
        with suppress(PySparkException):
            rows = [tuple(r) for r in table_counts(spark, layers).collect()]  # a row a table
    if rows is None:

        def counted(df: DataFrame) -> int | None:
            try:
                return df.count()
            except PySparkException:
                return None

        places = [(i, x.label, x.schema, j, t) for i, x in enumerate(layers) for j, t in enumerate(x.tables)]
        found = each([lambda t=t: counted(t.df) for *_, t in places], workers, limit)
        rows = [(i, label, schema, j, t.name, n) for (i, label, schema, j, t), n in zip(places, found, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def layer_totals(spark: SparkSession, layers: list[Layer], counts: DataFrame, strict: bool) -> DataFrame:
    """(layer_ord, label, total_rows). strict: 0 for a layer without tables; else null if no table has a count."""
    names = spark.createDataFrame([(i, x.label) for i, x in enumerate(layers)], "layer_ord int, label string")
    total = F.sum("row_count")
    sums = counts.groupBy("layer_ord").agg(total.alias("total"))
    value = F.coalesce("total", F.lit(0)) if strict else F.col("total")
    return names.join(sums, "layer_ord", "left").select("layer_ord", "label", value.cast("long").alias("total_rows"))


def compare_stages(spark: SparkSession, layers: list[Layer]) -> DataFrame:
    """(table_name, from_stage, to_stage, from_count, to_count, difference) where adjacent stages differ.

    Tables are paired by their exact name; only those that both stages have are counted, each once.
    """
    if len(layers) < 2:
        raise ValueError("at least two stages are needed")
    names = [{t.name for t in x.tables} for x in layers]
    wanted = [n & set(chain(*names[max(0, i - 1) : i], *names[i + 1 : i + 2])) for i, n in enumerate(names)]
    shared = [Layer(x.label, x.schema, [t for t in x.tables if t.name in wanted[i]]) for i, x in enumerate(layers)]
    counts = table_counts(spark, shared)
    # A window, not a join of the counts with themselves, which would scan every table twice.
    before = F.lag(F.struct("layer_ord", "label", "row_count")).over(Window.partitionBy("table").orderBy("layer_ord"))
    pairs = counts.withColumn("b", before).where((F.col("b.layer_ord") == F.col("layer_ord") - 1) & (F.col("b.row_count") != F.col("row_count")))
    return pairs.select(
        F.col("table").alias("table_name"),
        F.col("b.label").alias("from_stage"),
        F.col("label").alias("to_stage"),
        F.col("b.row_count").alias("from_count"),
        F.col("row_count").alias("to_count"),
        (F.col("row_count") - F.col("b.row_count")).alias("difference"),
    )
