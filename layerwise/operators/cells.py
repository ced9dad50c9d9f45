"""Notebook sources cut into cells, and cells into statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import slug, statements, trimmed
from ..sources.notebooks import PREFIX

# The notebook file format.
DEFAULT = {"PYTHON": "python", "R": "r", "SQL": "sql", "SCALA": "scala"}
MAGIC = {"sql": "sql", "python": "python", "scala": "scala", "r": "r", "md": "md", "md-sandbox": "md"}
HEADER, CUT = r"\s*Databricks notebook source\s*\n", r"\s*COMMAND -+\s*$"
SPARK_SQL = (
    r'(?s)(?:(\w+)\s*=\s*)?spark\.sql\(\s*f?"""(.*?)"""\s*\)|(?:(\w+)\s*=\s*)?spark\.sql\(\s*f?"([^"]*)"\s*\)'
    r"|(?:(\w+)\s*=\s*)?spark\.sql\(\s*f?'([^']*)'\s*\)"
)
HEADING = r"^\s*#+\s*\S"


def _mapped(key: Column, values: dict[str, str], other: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key], F.lit(other))


def cells(notebooks: DataFrame) -> DataFrame:
    """notebooks(nb_ord, path, language, source) -> (nb_ord, path, cell_index, language, source).

    Empty cells are left out but keep their number. A cell whose first line is a magic line loses the
    marks, and takes the language of a line that only names one. A null source has no cells.
    """
    prefix = _mapped(F.col("language"), PREFIX, "#")
    default = _mapped(F.col("language"), DEFAULT, "unknown")
    rows = notebooks.where(F.col("source").isNotNull()).select("nb_ord", "path", prefix.alias("prefix"), default.alias("default"), F.replace("source", F.lit("\r\n"), F.lit("\n")).alias("text"))
    body = F.regexp_replace("text", F.concat(F.lit("^"), "prefix", F.lit(HEADER)), F.lit(""))
    raw = F.split(body, F.concat(F.lit("(?m)^"), "prefix", F.lit(CUT)), -1)
    rows = rows.select("nb_ord", "path", "prefix", "default", F.posexplode(raw).alias("cell_index", "raw"))
    rows = rows.withColumn("plain", F.regexp_replace("raw", r"^\n+|\n+\z", "")).where("plain <> ''")
    magic = F.concat(F.lit("^"), F.col("prefix"), F.lit(r"\s*MAGIC\b ?(.*)\z"))
    lines = F.split("plain", "\n", -1)
    bare = F.transform(lines, lambda x: F.when(F.regexp(x, magic), F.call_function("regexp_extract", x, magic, F.lit(1))).otherwise(x))
    rows = rows.withColumn("marked", F.regexp(F.element_at(lines, 1), magic)).withColumn("bare", bare)
    named = F.nullif(F.regexp_extract(F.element_at("bare", 1), r"^%([a-zA-Z-]+)\s*\z", 1), F.lit(""))
    rows = rows.withColumn("named", F.when(F.col("marked"), named))
    text = F.when(F.col("named").isNotNull(), F.array_join(F.slice("bare", F.lit(2), F.size("bare")), "\n")).otherwise(F.array_join("bare", "\n"))
    return rows.select(
        "nb_ord",
        "path",
        "cell_index",
        F.when(F.col("named").isNotNull(), _mapped(F.lower("named"), MAGIC, "unknown")).otherwise(F.col("default")).alias("language"),
        F.when(F.col("marked"), trimmed(text)).otherwise(F.col("plain")).alias("source"),
    )


def headings(rows: DataFrame) -> DataFrame:
    """cells -> with `heading`: that of the nearest earlier markdown cell that has one; it may be empty."""
    line = F.try_element_at(F.filter(F.split("source", "\n", -1), lambda x: x.rlike(HEADING)), F.lit(1))
    own = F.when((F.col("language") == "md") & line.isNotNull(), slug(F.lower(trimmed(F.regexp_replace(line, r"^\s*#+\s*", ""))), "_", None))
    before = Window.partitionBy("nb_ord", "path").orderBy("cell_index").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_own", own).withColumn("heading", F.last("_own", ignorenulls=True).over(before)).drop("_own")


def sql_statements(rows: DataFrame) -> DataFrame:
    """cells -> with stmt_idx, n_stmts, variable, raw_sql: statements of SQL cells and spark.sql() texts of Python ones."""
    group = lambda n: F.regexp_extract_all("source", F.lit(SPARK_SQL), F.lit(n))
    calls = F.arrays_zip(*[group(n).alias(f"g{n}") for n in range(1, 7)])
    first = lambda x, *names: F.coalesce(*[F.nullif(x[n], F.lit("")) for n in names])
    # Columns of their own: inside the lambdas below they would be computed again for each element.
    cut = rows.withColumn("_found", F.when(F.col("language") == "sql", statements(F.col("source")))).withColumn("_calls", F.when(F.col("language") == "python", calls))
    in_sql = F.transform("_found", lambda s, i: F.struct(i.alias("stmt_idx"), F.size("_found").alias("n_stmts"), F.lit(None).cast("string").alias("variable"), s.alias("raw_sql")))
    in_python = F.transform("_calls", lambda x, i: F.struct(i.alias("stmt_idx"), F.size("_calls").alias("n_stmts"), first(x, "g1", "g3", "g5").alias("variable"), first(x, "g2", "g4", "g6").alias("raw_sql")))
    in_python = F.filter(in_python, lambda x: F.coalesce(trimmed(x["raw_sql"]), F.lit("")) != "")
    return cut.select("*", F.explode(F.coalesce(in_sql, in_python)).alias("_s")).select(*rows.columns, "_s.*")
