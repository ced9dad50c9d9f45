"""What each SQL statement in a notebook is called, reads and says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CREATE_VIEW, found, identifier, normal_sql
from ..plans.catalyst import read_statements
from ..sources.shared import written
from .cells import cells, headings, sql_statements


def read(rows: DataFrame) -> DataFrame:
    """rows(raw_sql, ...) -> with sources, target, tables, columns, normal, predicate, filters, parsed (see plans.catalyst).

    What Spark's grammar doesn't have is read by the lexer: it has no columns, and its normal form is its text as one line.
    A read-only statement has no target.
    """
    plans = read_statements(rows).withColumn("normal", F.coalesce("normal", normal_sql(F.col("raw_sql"))))
    return rows.join(plans, "raw_sql").select(*rows.columns, *[c for c in plans.columns if c != "raw_sql"])


def sql_facts(notebooks: DataFrame) -> DataFrame:
    """(nb_ord, path, cell_index, stmt_idx, metric_name, tables, columns, normal, raw_sql).

    The name is the view's or the assigned variable's, else the heading's above, else the cell's number
    (with the statement's, if the cell has several).
    """
    rows = written(sql_statements(headings(cells(notebooks))), "cut")  # read for its different statements, and joined with them
    view = F.when(F.col("language") == "sql", identifier(found(F.col("raw_sql"), CREATE_VIEW)))
    number = F.concat(F.lit("cell_"), F.col("cell_index").cast("string"))
    numbered = F.when((F.col("language") == "sql") & (F.col("n_stmts") > 1), F.concat(number, F.lit("_"), F.col("stmt_idx").cast("string"))).otherwise(number)
    facts = read(rows).withColumn("metric_name", F.coalesce(view, "variable", "heading", numbered))
    return facts.select("nb_ord", "path", "cell_index", "stmt_idx", "metric_name", "tables", "columns", "normal", "raw_sql")
