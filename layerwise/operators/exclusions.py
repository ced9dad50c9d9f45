"""Rows that a table's WHERE clause drops."""

from __future__ import annotations

from collections import defaultdict
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.logger import PySparkLogger
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MISSING, bare_name, shortened
from ..sources.catalog import Layer, inventory, table_index
from .lineage import order
from .pool import each

SCHEMA = "layer_ord int, label string, tbl_ord int, path string, cell_index int, predicate_sql string, source_table string, excluded_count long, rule_label string, explanation string, severity string"
SCANS = "layer_ord int, label string, tbl_ord int, table string, path string, cell_index int, scan int, predicate_sql string, source_table string, excluded_count long, null_count long"


@contextmanager
def _quietly():
    """Keeps the errors of expressions that are only tried out of the log."""
    logger = PySparkLogger.getLogger("SQLQueryContextLogger")
    before, logger.disabled = logger.disabled, True
    try:
        yield
    finally:
        logger.disabled = before


def profiled(df: DataFrame, predicates: list[str], rows: bool = True) -> tuple[int | None, list[tuple[int, int] | None]]:
    """How many rows df has, and for each predicate (rows for which it is false, rows for which it is null), or None if it can't
    be computed.

    All is one scan. A predicate must be one expression over df's columns; those that don't resolve are None, and if the
    scan fails at run time each is tried by itself. Rows for which a predicate is null are dropped by a WHERE too, but
    don't count as excluded. Without `rows` the first is None, and nothing is scanned for no good predicate.
    """

    def counted(chosen: list[str], total: bool) -> list[int]:
        sums = [x for p in chosen for x in (F.count_if(~F.expr(p).cast("boolean")), F.count_if(F.expr(p).isNull()))]
        return list(df.agg(*[s.alias(f"c{i}") for i, s in enumerate([*sums, *[F.count("*")] * total])]).first())

    def resolves(p: str) -> bool:
        try:
            with _quietly():
                return df.select(F.expr(f"NOT ({p})").alias("p")).schema[0].dataType.simpleString() == "boolean"
        except PySparkException:
            return False

    good = [p for p in dict.fromkeys(predicates) if resolves(p)]
    found: dict[str, tuple[int, int]] = {}
    total = None
    try:
        got = counted(good, rows) if good or rows else []
        found = {p: (got[2 * i], got[2 * i + 1]) for i, p in enumerate(good)}
        total = got[-1] if rows else None
    except PySparkException:
        total = df.count() if rows else None
        for p in good:
            try:
                found[p] = tuple(counted([p], False))
            except PySparkException:
                continue
    return total, [found.get(p) for p in predicates]


def excluded(df: DataFrame, predicates: list[str]) -> list[tuple[int, int] | None]:
    """profiled, without the number of rows."""
    return profiled(df, predicates, rows=False)[1]


def _placed(spark: SparkSession, layers: list[Layer], rules: DataFrame, source: Column) -> DataFrame:
    """rules -> with the schema and table that a source's bare name has in the last layer, and what the source itself says."""
    rules = rules.withColumn("lone", bare_name(source)).withColumn("lone_schema", F.try_element_at(F.split(source, r"\."), F.lit(-2)))
    index = table_index(inventory(spark, layers)).select(F.col("name").alias("lone"), F.col("schema").alias("source_schema"), F.col("table").alias("source_name"))
    return rules.join(index, "lone", "left")


def sources_of(layers: list[Layer], rows: list, qualified: bool) -> dict[tuple[str, str], list[int]]:
    """(schema, table) -> the places of the rules that are counted on it."""
    names = [(x.schema, t.name) for x in layers for t in x.tables]
    out: dict[tuple[str, str], list[int]] = defaultdict(list)
    for i, r in enumerate(rows):
        if r.source_schema is not None:
            own = next((k for k in names if qualified and r.lone_schema and (k[0].lower(), k[1].lower()) == (r.lone_schema, r.lone)), None)
            out[own or (r.source_schema, r.source_name)].append(i)
    return out


def _counted(layers: list[Layer], rows: list, qualified: bool) -> dict[int, tuple[int, int]]:
    """(false, null) rows of each rule's source, by the rule's place: all rules of one source in one scan."""
    frames = {(x.schema, t.name): t.df for x in layers for t in x.tables}
    by_source = sources_of(layers, rows, qualified)
    jobs = [(frames[key], [rows[i].predicate_sql for i in places]) for key, places in by_source.items()]
    out: dict[int, tuple[int, int]] = {}
    for places, got in zip(by_source.values(), each([lambda j=j: excluded(*j) for j in jobs]), strict=True):
        out |= {i: x for i, x in zip(places, got, strict=True) if x}
    return out


def scan_rules(spark: SparkSession, layers: list[Layer], facts: DataFrame, skip_first: bool = True, qualified: bool = False) -> DataFrame:
    """SCANS: a rule for each WHERE that rows pass on their way into a table, branch by branch.

    Of a table's first writing statement: the WHEREs of all branches of set operations, of common table expressions, of
    subqueries in FROM, and of an UPDATE, each with the one relation that it reads in the end (null if it reads several) and
    the rows of that relation for which it is false, or null. `scan` is the order in which their SELECTs begin, the statement itself first.
    """
    tables = inventory(spark, layers).where(F.col("layer_ord") >= int(skip_first))
    first = facts.where(F.col("target").isNotNull()).withColumn("name", bare_name(F.col("target")))
    first = first.groupBy("name").agg(F.min_by(F.struct("path", "cell_index", "filters"), order()).alias("f"))
    rules = tables.withColumn("name", F.lower("table")).join(first, "name").select("*", F.posexplode("f.filters").alias("scan", "x"))
    rules = _placed(spark, layers, rules, F.col("x.source"))
    rows = rules.select(
        "layer_ord", "label", "tbl_ord", "table", "f.path", "f.cell_index", "scan", F.col("x.predicate").alias("predicate_sql"), F.col("x.source").alias("source_table"), "source_schema", "source_name", "lone", "lone_schema"
    ).orderBy("layer_ord", "tbl_ord", "scan").collect()  # fmt: skip  # the WHEREs of one statement a table
    found = _counted(layers, rows, qualified)
    return spark.createDataFrame([(r.layer_ord, r.label, r.tbl_ord, r.table, r.path, r.cell_index, r.scan, r.predicate_sql, r.source_table, *found.get(i, (None, None))) for i, r in enumerate(rows)], SCANS)


def rule_rows(spark: SparkSession, layers: list[Layer], facts: DataFrame, skip_first: bool = True) -> list:
    """A row for each table whose first writing statement has a WHERE, in the tables' order, without counts."""
    tables = inventory(spark, layers).where(F.col("layer_ord") >= int(skip_first))
    first = facts.where(F.col("target").isNotNull()).withColumn("name", bare_name(F.col("target")))
    first = first.groupBy("name").agg(F.min_by(F.struct("path", "cell_index", "sources", "predicate"), order()).alias("f"))
    rules = tables.withColumn("name", F.lower("table")).join(first, "name").where(F.col("f.predicate").isNotNull())
    rules = _placed(spark, layers, rules, F.when(F.size("f.sources") == 1, F.element_at("f.sources", 1)))
    return rules.select(
        "layer_ord", "label", "tbl_ord", "table", "f.path", "f.cell_index", F.col("f.predicate").alias("predicate_sql"), F.coalesce(F.try_element_at("f.sources", F.lit(1)), F.lit(MISSING)).alias("source_table"),
        "source_schema", "source_name", "lone", "lone_schema", shortened(F.col("f.predicate")).alias("short"),
    ).orderBy("layer_ord", "tbl_ord").collect()  # fmt: skip  # a rule a table at most


def rules_frame(spark: SparkSession, rows: list, found: dict[int, tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame([(r.layer_ord, r.label, r.tbl_ord, r.path, r.cell_index, r.predicate_sql, r.source_table, found.get(i, (None,))[0], f"{r.table}: {r.short}", "", "ok") for i, r in enumerate(rows)], SCHEMA)


def exclusion_rules(spark: SparkSession, layers: list[Layer], facts: DataFrame, skip_first: bool = True, qualified: bool = False) -> DataFrame:
    """SCHEMA: a rule for each table whose first writing statement has a WHERE, with the rows that it drops.

    Rules with several sources, and rules whose predicate can't be computed on the source alone, have a null
    count. A source is looked up by its bare name, in the last layer that has it; with `qualified`, a source
    that names its schema is looked up there. The first layer has no rules unless skip_first is off.
    """
    rows = rule_rows(spark, layers, facts, skip_first)
    return rules_frame(spark, rows, _counted(layers, rows, qualified))
