"""A project at a glance: its tables by kind, their rows, its lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LAYERS, layer_rank, table_kind
from ..sources.catalog import Layer, inventory
from .counts import safe_table_counts


def detect_layers(schemas: DataFrame) -> DataFrame:
    """schemas(ord, name) -> (layer_ord, label, schema): the first schema of each layer that its name points to."""
    ranked = schemas.withColumn("layer_ord", layer_rank(F.col("name"))).where(F.col("layer_ord").isNotNull())
    first = ranked.groupBy("layer_ord").agg(F.min_by("name", "ord").alias("schema"))
    labels = F.array(*[F.lit(label) for label, _ in LAYERS])
    return first.select("layer_ord", F.element_at(labels, F.col("layer_ord") + 1).alias("label"), "schema").orderBy("layer_ord")


def table_infos(spark: SparkSession, layers: list[Layer]) -> DataFrame:
    """(layer_ord, label, schema, tbl_ord, table, kind, row_count, column_count, comment); what can't be counted is null."""
    counts = safe_table_counts(spark, layers).select("layer_ord", "tbl_ord", "row_count")
    rows = inventory(spark, layers).join(counts, ["layer_ord", "tbl_ord"])
    n_columns = F.when(F.col("columns").isNotNull(), F.size("columns"))
    return rows.select("layer_ord", "label", "schema", "tbl_ord", "table", table_kind(F.col("table"), F.col("label")).alias("kind"), "row_count", n_columns.alias("column_count"), "comment")


def project_stats(infos: DataFrame, lineage: DataFrame, n_layers: int) -> DataFrame:
    """One row: layers, tables by kind, rows, lineage edges and the notebooks they come from."""
    tables = infos.agg(
        F.count("*").alias("table_count"),
        F.count_if(F.col("kind") == "fact").alias("fact_table_count"),
        F.count_if(F.col("kind") == "dimension").alias("dimension_table_count"),
        F.count_if(~F.col("kind").isin("fact", "dimension")).alias("other_table_count"),
        F.sum("row_count").alias("total_rows"),
    )
    edges, notebooks = lineage.agg(F.count("*"), F.count_distinct(F.when(F.col("path") != "", F.col("path")))).first()
    return tables.select("*", *[F.lit(n).cast("long").alias(name) for name, n in (("lineage_edge_count", edges), ("notebook_count", notebooks), ("layer_count", n_layers))])
