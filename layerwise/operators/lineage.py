"""Which statement writes which table from which tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bare_name, found, identifier, join_key_hint, matches_table, snippet
from ..sources.shared import written
from .cells import cells, sql_statements
from .sqlfacts import read

# Fixed values.
WRITES = r"""\.(?:saveAsTable|insertInto)\(\s*["']([\w.`]+)["']"""
READS = r"""spark\.(?:read\.)?table\(\s*["']([\w.`]+)["']\s*\)"""
LAST = 1_000_000  # the stmt_idx of a cell's DataFrame fact, after all of its statements


def order():
    """The order that facts are met in."""
    return F.struct("nb_ord", "cell_index", "stmt_idx")


def lineage_facts(notebooks: DataFrame, name: str | None = None) -> DataFrame:
    """(nb_ord, path, cell_index, stmt_idx, sources, target, predicate, filters, raw_sql, parsed); read-only statements have a null target.

    A Python cell that writes a table by the DataFrame API, and reads one, gives a fact with the cell's whole
    text, unless one of its statements writes the same table. With a name only cells whose text holds it are read.
    Cells are cut once and statements are parsed and joined once, whoever reads them.
    """
    every = cells(notebooks)
    every = written((every if name is None else mentioning(every, name)).where(F.col("language").isin("sql", "python")), "cells")
    facts = read(written(sql_statements(every).select("nb_ord", "path", "cell_index", "stmt_idx", "raw_sql"), "cut"))
    facts = written(facts.select("nb_ord", "path", "cell_index", "stmt_idx", "sources", "target", "predicate", "filters", "raw_sql", "parsed"), "facts")
    targets = facts.where(F.col("target").isNotNull()).groupBy("nb_ord", "path", "cell_index").agg(F.collect_set("target").alias("known"))
    reads = F.array_distinct(F.transform(F.regexp_extract_all("source", F.lit(READS), F.lit(1)), identifier))
    frames = every.where(F.col("language") == "python").withColumn("target", identifier(found(F.col("source"), WRITES))).withColumn("sources", reads)
    frames = frames.where(F.col("target").isNotNull() & (F.size("sources") > 0)).join(targets, ["nb_ord", "path", "cell_index"], "left")
    frames = frames.where(F.col("known").isNull() | ~F.array_contains("known", F.col("target")))
    frames = frames.select("nb_ord", "path", "cell_index", F.lit(LAST).alias("stmt_idx"), "sources", "target", F.lit(None).cast("string").alias("predicate"), F.lit(None).cast(facts.schema["filters"].dataType).alias("filters"), F.col("source").alias("raw_sql"), F.lit(False).alias("parsed"))
    return facts.unionByName(frames)


def mentioning(notebooks: DataFrame, name: str) -> DataFrame:
    """The notebooks, or cells, whose text holds the name: the others needn't be parsed."""
    return notebooks.where(F.contains(F.lower("source"), F.lit(name.lower())))


def fan_out(notebooks: DataFrame, table: str, target_schema: str | None = None) -> DataFrame:
    """(nb_ord, cell_index, stmt_idx, target, path, sources, snippet) of writes that read the table.

    With target_schema only targets that name that schema count.
    """
    needle = table.lower().rsplit(".", 1)[-1]
    facts = lineage_facts(mentioning(notebooks, needle), needle).where(F.col("target").isNotNull() & F.exists("sources", lambda x: bare_name(x) == needle))
    if target_schema:
        parts = F.split("target", r"\.")
        facts = facts.where((F.size(parts) >= 2) & (F.try_element_at(parts, F.lit(-2)) == target_schema.lower()))
    return facts.select("nb_ord", "cell_index", "stmt_idx", "target", "path", "sources", snippet(F.col("raw_sql")).alias("snippet"))


def writers(notebooks: DataFrame, catalog: str, schema: str, table: str, whole: bool = False) -> DataFrame:
    """(nb_ord, cell_index, stmt_idx, path, snippet) of statements that write catalog.schema.table; with `whole` a snippet is all of the statement."""
    facts = lineage_facts(mentioning(notebooks, table), table).where(F.col("target").isNotNull())
    facts = facts.where(matches_table(F.col("target"), catalog, schema, table))
    text = F.col("raw_sql")
    return facts.select("nb_ord", "cell_index", "stmt_idx", "path", (text if whole else snippet(text)).alias("snippet"))


def edges(facts: DataFrame, index: DataFrame) -> DataFrame:
    """(source, target, join_key_hint, path, cell_index): each pair once, as the first fact has it.

    Only targets in the index (see sources.catalog.table_index) count; sources may be any.
    """
    known = facts.where(F.col("target").isNotNull()).withColumn("name", bare_name(F.col("target"))).join(index.select("name"), "name", "left_semi")
    pairs = known.select(order().alias("at"), F.explode("sources").alias("source"), "target", join_key_hint(F.col("raw_sql")).alias("hint"), "path", "cell_index")
    first = F.min_by(F.struct("hint", "path", "cell_index"), F.col("at"))
    return pairs.groupBy("source", "target").agg(first.alias("f")).select("source", "target", F.col("f.hint").alias("join_key_hint"), "f.path", "f.cell_index")
