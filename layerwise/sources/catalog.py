"""Catalogs, schemas, tables and columns of the session, and layers of tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INVENTORY = "layer_ord int, label string, schema string, tbl_ord int, table string, comment string, columns array<struct<name:string,type_name:string>>"


def check_connection(spark: SparkSession) -> bool:
    """Whether the session can run a job; raises what the job raises."""
    return spark.range(1).count() == 1


def catalogs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c.name, c.description) for c in spark.catalog.listCatalogs()], "name string, comment string")


def schemas(spark: SparkSession, catalog: str | None = None) -> DataFrame:
    """The schemas of a catalog, by default the session's current one, which stays current."""
    current = spark.catalog.currentCatalog()
    try:
        if catalog:
            spark.catalog.setCurrentCatalog(catalog)
        rows = [(d.name, d.catalog, d.description) for d in spark.catalog.listDatabases()]
    finally:
        if catalog:
            spark.catalog.setCurrentCatalog(current)
    return spark.createDataFrame(rows, "name string, catalog string, comment string")


def columns(df: DataFrame) -> list[tuple[str, str]] | None:
    """(name, type) of each column; None, not an empty list, if there is none."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields] or None


def table_columns(spark: SparkSession, table: str) -> list[tuple[str, str]]:
    return columns(spark.table(table)) or []


def compute(spark: SparkSession) -> dict:
    """What the session runs on: name, application id and default parallelism."""
    sc = spark.sparkContext
    return {"id": sc.applicationId, "name": sc.appName, "state": "RUNNING", "parallelism": sc.defaultParallelism}


@dataclass
class Table:
    """A table's name and rows. path: set if these are just the Parquet files there, whose footers know how many rows they have."""

    name: str
    df: DataFrame
    comment: str | None = None
    path: str | None = None


def parquet_table(spark: SparkSession, name: str, path: str) -> Table:
    return Table(name, spark.read.parquet(path), path=path)


@dataclass
class Layer:
    """One stage of a pipeline: a label, the schema behind it, and its tables in order."""

    label: str
    schema: str
    tables: list[Table] = field(default_factory=list)


def schema_layer(spark: SparkSession, label: str, schema: str, catalog: str | None = None) -> Layer:
    """A layer of all tables of a schema, in the given catalog or the session's current one."""
    place = f"`{catalog}`.`{schema}`" if catalog else f"`{schema}`"
    tables = [t for t in spark.catalog.listTables(place) if not t.isTemporary]
    return Layer(label, schema, [Table(t.name, spark.table(f"{place}.`{t.name}`"), t.description) for t in tables])


def inventory(spark: SparkSession, layers: list[Layer]) -> DataFrame:
    """A row a table, with its place in its layer and its layer's place."""
    rows = [(i, x.label, x.schema, j, t.name, t.comment, columns(t.df)) for i, x in enumerate(layers) for j, t in enumerate(x.tables)]
    return spark.createDataFrame(rows, INVENTORY)


def complete_layers(layers: DataFrame) -> DataFrame:
    """layers(label, schema, ...) that have both."""
    return layers.where((F.trim("label") != "") & (F.trim("schema") != ""))


def table_index(tables: DataFrame) -> DataFrame:
    """(name, schema, table): each bare lower-cased name once; a later layer's table replaces an earlier one's."""
    last = F.max_by(F.struct("schema", "table"), F.struct("layer_ord", "tbl_ord"))
    return tables.groupBy(F.lower("table").alias("name")).agg(last.alias("t")).select("name", "t.schema", "t.table")
