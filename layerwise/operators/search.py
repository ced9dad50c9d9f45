"""Code that mentions a table, and code to review for a step between layers."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import LEVEL_SNIPPET, bare_name, refers_to, snippet, trimmed
from .cells import cells
from .lineage import mentioning
from .sqlfacts import sql_facts

MOST = 40  # the report's length


def responsible_code(notebooks: DataFrame, table: str) -> DataFrame:
    """(nb_ord, cell_index, stmt_idx, path, snippet) of statements that reference the table.

    The whole lower-cased name is compared with the last part of references, so a dotted name never matches.
    """
    facts = sql_facts(mentioning(notebooks, table)).where(refers_to(F.col("tables"), table))
    return facts.select("nb_ord", "cell_index", "stmt_idx", "path", snippet(F.col("raw_sql")).alias("snippet"))


def responsible_for(notebooks: DataFrame, tables: DataFrame) -> DataFrame:
    """tables(table_name, ...) -> (table_name, nb_ord, cell_index, stmt_idx, path, snippet): responsible_code of all tables at once.

    Every statement is read once; an index from the last parts of its references to the statement answers all tables. A name that
    many statements share is one key of a join that Spark may split.
    """
    facts = sql_facts(notebooks).select("nb_ord", "cell_index", "stmt_idx", "path", snippet(F.col("raw_sql")).alias("snippet"), F.explode(F.array_distinct(F.transform("tables", bare_name))).alias("name"))
    names = tables.select("table_name").distinct().withColumn("name", F.lower("table_name"))
    return facts.join(names, "name").select("table_name", "nb_ord", "cell_index", "stmt_idx", "path", "snippet")


def needles_of(tables: list[str]) -> list[str]:
    """Each table's name and its last part, in small letters, each once."""
    return list(dict.fromkeys(x for t in tables for x in (t.lower(), t.lower().rsplit(".", 1)[-1]) if x))


def mentions(code: DataFrame, needles: list[str]) -> DataFrame:
    """code(nb_ord, path, cell_index, source) -> with `found`, the places of the needles that the source holds.

    One pass over the text whatever the number of needles: they are one Aho-Corasick automaton, built once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for i, n in enumerate(needles):
            automaton.add_word(n, i)
        if needles:
            automaton.make_automaton()
        for b in batches:
            texts = b.column("source").to_pylist()
            found = [sorted({i for _, i in automaton.iter(t.lower())}) if needles and t else [] for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int32()))], [*b.schema.names, "found"])

    kept = code.select("nb_ord", "path", "cell_index", "source")
    return kept.mapInArrow(run, f"{', '.join(f'{n} {t}' for n, t in kept.dtypes)}, found array<int>")


def level_codes(notebooks: DataFrame, steps: dict[str, list[str]], most: int = MOST) -> DataFrame:
    """(step, nb_ord, cell_index, path, snippet): level_code of several steps, each with its tables, in one pass over all code."""
    spark = notebooks.sparkSession
    needles = needles_of([t for tables in steps.values() for t in tables])
    places = {n: i for i, n in enumerate(needles)}
    asked = spark.createDataFrame([(s, [places[n] for n in needles_of(tables)]) for s, tables in steps.items()], "step string, wanted array<int>")
    rows = mentions(_code(notebooks), needles).withColumn("snippet", F.substring("source", 1, LEVEL_SNIPPET)).drop("source")
    rows = rows.join(F.broadcast(asked)).withColumn("hit", F.arrays_overlap("found", "wanted") | (F.size("wanted") == 0))  # a row a step
    rows = rows.withColumn("any", F.max("hit").over(Window.partitionBy("step", "nb_ord", "path"))).where("hit or not any")
    first = Window.partitionBy("step").orderBy("nb_ord", "cell_index")
    return rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most).select("step", "nb_ord", "cell_index", "path", "snippet")


def _code(notebooks: DataFrame) -> DataFrame:
    """Code cells; notebooks of unknown language are read as Python."""
    known = notebooks.withColumn("language", F.when(F.col("language") == "UNKNOWN", "PYTHON").otherwise(F.col("language")))
    return cells(known).where((F.col("language") != "md") & (trimmed(F.col("source")) != ""))


def level_code(notebooks: DataFrame, tables: list[str], most: int = MOST) -> DataFrame:
    """(nb_ord, cell_index, path, snippet): the first `most` code cells that mention a table.

    A notebook without such a cell gives all of its code cells. Notebooks of unknown language are read as
    Python.
    """
    needles, code = needles_of(tables), _code(notebooks)
    if needles:
        low = F.lower("source")
        hit = F.exists(F.array(*map(F.lit, needles)), lambda n: F.contains(low, n))
        code = code.withColumn("hit", hit).withColumn("any", F.max("hit").over(Window.partitionBy("nb_ord", "path"))).where("hit or not any")
    return code.select("nb_ord", "cell_index", "path", F.substring("source", 1, LEVEL_SNIPPET).alias("snippet")).orderBy("nb_ord", "cell_index").limit(most)
