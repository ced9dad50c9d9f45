"""Notebook sources: files of exported notebooks, folders of them, and rows made by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

SCHEMA = "nb_ord int, path string, name string, language string, source string"
# Fixed values.
PREFIX = {"PYTHON": "#", "R": "#", "SQL": "--", "SCALA": "//"}
LANGUAGES = (("py", "PYTHON"), ("sql", "SQL"), ("scala", "SCALA"), ("r", "R"))


def language_of(path: Column) -> Column:
    """By the file's ending; UNKNOWN if that says nothing."""
    out = F.lit("UNKNOWN")
    for ending, language in LANGUAGES:
        out = F.when(F.lower(path).endswith(f".{ending}"), language).otherwise(out)
    return out


def notebooks(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """(path, language, source) rows, in their order."""
    return spark.createDataFrame([(i, p, p.rsplit("/", 1)[-1], x or "UNKNOWN", s) for i, (p, x, s) in enumerate(rows)], SCHEMA)


def placed(rows: DataFrame, *order) -> DataFrame:
    """rows with `place`, their place in an order, from 0. Ranges of it are sorted apart, and know how many rows come before them."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_g", F.monotonically_increasing_id())
    ranged = written(ranged, "placed").withColumn("_range", F.shiftright("_g", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = ranged.groupBy("_range").agg(F.count("*").alias("n"), F.min("_g").alias("_least")).select("_range", "_least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(starts), "_range").select(*rows.columns, (F.col("_before") + F.col("_g") - F.col("_least")).alias("place"))  # as many rows as ranges


_IPYNB = "cells array<struct<cell_type:string,source:variant>>, metadata struct<kernelspec:struct<language:string>,language_info:struct<name:string>>"


def from_ipynb(content: Column) -> Column:
    """struct<language, source> of a notebook in JSON: its cells in the format of exported notebooks; null if it isn't JSON.

    A cell's source may be a text or a list of lines. Code that starts with a % names its own language; markdown cells
    become cells of magic lines. Other kinds of cells are left out.
    """
    book = F.from_json(content, _IPYNB)
    name = F.coalesce(book["metadata"]["language_info"]["name"], book["metadata"]["kernelspec"]["language"], F.lit("python"))
    language = F.upper(name)
    mark = F.coalesce(F.create_map(*[F.lit(x) for kv in PREFIX.items() for x in kv])[language], F.lit("#"))

    def cell(c: Column) -> Column:
        lines = F.try_variant_get(c["source"], "$", "array<string>")
        text = F.coalesce(F.array_join(lines, ""), F.try_variant_get(c["source"], "$", "string"), F.lit(""))
        marked = F.concat(mark, F.lit(" MAGIC "), F.regexp_replace(text, "\n", F.concat(F.lit("\n"), mark, F.lit(" MAGIC "))))
        heading = F.concat(mark, F.lit(" MAGIC %md\n"), marked)
        return F.when(c["cell_type"] == "markdown", heading).when(F.ltrim(text).startswith("%"), marked).otherwise(text)

    cut = F.concat(F.lit("\n"), mark, F.lit(" COMMAND ----------\n"))
    kept = F.filter(book["cells"], lambda c: c["cell_type"].isin("code", "markdown"))
    whole = F.concat(mark, F.lit(" Databricks notebook source\n"), F.aggregate(F.transform(kept, cell), F.lit(None).cast("string"), lambda a, x: F.when(a.isNull(), x).otherwise(F.concat(a, cut, x))))
    return F.when(book["cells"].isNotNull(), F.struct(language.alias("language"), F.coalesce(whole, F.lit("")).alias("source")))


def read_notebooks(spark: SparkSession, root: str) -> DataFrame:
    """The notebooks among the files under a folder, ordered by path: sources of the known languages, and .ipynb files.

    Spark reads the files, several a task, from any store that it knows. Other files are not opened; .ipynb files that
    aren't notebooks are left out. Only the paths are sorted.
    """
    endings = [x for x, _ in LANGUAGES] + ["ipynb"]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.lower("path").rlike(rf"\.({'|'.join(endings)})\z"))
    text = F.decode("content", "UTF-8")
    book = F.when(F.lower("path").endswith(".ipynb"), from_ipynb(text)).otherwise(F.struct(language_of(F.col("path")).alias("language"), text.alias("source")))
    rows = files.select("path", book.alias("b")).where("b is not null").select("path", "b.language", "b.source")
    rows = written(rows, "notebooks")
    return rows.join(placed(rows.select("path"), "path"), "path").select(F.col("place").cast("int").alias("nb_ord"), "path", F.element_at(F.split("path", "/"), -1).alias("name"), "language", "source")


def decoded(rows: DataFrame, column: str = "content") -> DataFrame:
    """The column's base64 text as UTF-8, in `source`."""
    return rows.withColumn("source", F.decode(F.unbase64(F.col(column)), "UTF-8"))


def listed_by() -> tuple[Column, Column]:
    """Folders first, then by name as people sort."""
    return F.expr("type <> 'DIRECTORY'"), F.expr("name COLLATE UNICODE")


def folder(entries: DataFrame, path: str = "/") -> DataFrame:
    """entries(path, type, ...): what lies directly in a folder, folders first, then by name as people sort.

    Only entries of type DIRECTORY and NOTEBOOK are listed.
    """
    inside = F.regexp_replace(F.regexp_replace("path", r"/[^/]*\z", ""), r"\A\z", "/") == (path.rstrip("/") or "/")
    rows = entries.where(F.col("type").isin("DIRECTORY", "NOTEBOOK") & inside).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return rows.orderBy(*listed_by())


def under(rows: DataFrame, root: str = "/") -> DataFrame:
    """The notebooks below a folder."""
    return rows.where(F.col("path").startswith(root.rstrip("/") + "/"))
