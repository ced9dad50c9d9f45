"""Queries over the synthetic tables for the auditing operators, and the same in SQL for DuckDB."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .functions import responses
from .functions.text import (
    KINDS, LABEL, LAYERS, LEVEL_SNIPPET, MISSING, SNIPPET, STAGING_LAYER, normal_sql, notebook_key, parent_of, shortened, snippet, table_kind, text_sources, text_tables, text_target,
)
from .operators import audit, codedefs, counts, drift, exclusions, explained, lineage, measures, search, sqlfacts, summary
from .operators.cells import HEADING, MAGIC, PREFIX, cells, headings
from .sources import catalog
from .sources.catalog import Layer, Table, columns, inventory, schema_layer, table_index
from .sources.notebooks import decoded, folder, listed_by, notebooks, placed, read_notebooks, under
from .sources.shared import fresh_path
from .sources.snapshots import Snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def literal(x) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(rows, name: str, *columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS {name}({', '.join(columns)})"


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers, dealt out: their file is small, and one task would make and read all the code that they stand for."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").repartition(max(32, spark.sparkContext.defaultParallelism))


def of_suppliers(spark: SparkSession, sf_dir: str, rows, shape: str) -> DataFrame:
    """Every one of a few rows for each supplier: `k` and the rows' columns."""
    names, types = zip(*(x.strip().split(" ", 1) for x in shape.split(",")))
    listed = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(r, names, types)]) for r in rows])
    return suppliers(spark, sf_dir).select(F.col("s_suppkey").alias("k"), F.inline(listed))


def supplied(rows, *columns: str) -> str:
    """The same in SQL, as a relation."""
    return f"(SELECT s_suppkey AS k, v.* FROM supplier, {values(rows, 'v', *columns)}) AS w"


def corpus_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy of the fixture's notebooks for each supplier, in a folder of its own and with names of its own."""
    rows = of_suppliers(spark, sf_dir, [(i, p, p.rsplit("/", 1)[-1], x, t) for i, (p, x, t) in enumerate(fixtures.NOTEBOOKS)], "i int,path string,name string,language string,source string")
    own = lambda mark, c: F.concat(F.lit(mark), F.col("k").cast("string"), c)
    return rows.select((F.col("k") * 100 + F.col("i")).cast("int").alias("nb_ord"), own("/s", F.col("path")).alias("path"), own("s", F.concat(F.lit("_"), "name")).alias("name"), "language", "source")


# The layers of fixtures.layers(), table by table.
_KEPT = "orders WHERE o_orderstatus <> 'P'"
_TABLES = (
    (0, "bronze", 0, "orders", "orders"),
    (0, "bronze", 1, "raw_lineitem", "lineitem"),
    (0, "bronze", 2, "customer", "customer"),
    (0, "bronze", 3, "events", "events"),
    (1, "silver", 0, "orders", _KEPT),
    (1, "silver", 1, "stg_lineitem", "lineitem WHERE l_returnflag <> 'R'"),
    (1, "silver", 2, "customer_map", "customer WHERE c_custkey BETWEEN 1 AND 100"),
    (1, "silver", 3, "stg_tmp", "customer WHERE c_acctbal < 0"),
    (2, "gold", 0, "orders", _KEPT),
    (2, "gold", 1, "fact_sales", f"lineitem JOIN (SELECT * FROM {_KEPT}) o ON l_orderkey = o.o_orderkey WHERE l_returnflag <> 'R' AND o.o_totalprice > 1000"),
    (2, "gold", 2, "dim_customer", "customer"),
    (2, "gold", 3, "events", "events WHERE value > 50"),
)
_COUNTS = "counts AS (" + " UNION ALL ".join(f"SELECT {i} AS layer_ord, '{x}' AS label, {j} AS tbl_ord, '{t}' AS tbl, count(*) AS n FROM {f}" for i, x, j, t, f in _TABLES) + ")"
_LAYERS = values([(0, "bronze"), (1, "silver"), (2, "gold"), (3, "empty")], "layers", "layer_ord", "label")


@query(f"WITH {_COUNTS} SELECT label, tbl AS \"table\", n AS row_count FROM counts")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.table_counts(spark, fixtures.layers(spark, sf_dir)).select("label", "table", "row_count")


@query(
    f"WITH {_COUNTS} SELECT a.tbl AS table_name, a.label AS from_stage, b.label AS to_stage, a.n AS from_count, b.n AS to_count, b.n - a.n AS difference"
    " FROM counts a JOIN counts b ON a.tbl = b.tbl AND b.layer_ord = a.layer_ord + 1 WHERE a.n <> b.n"
)
def stage_count_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.compare_stages(spark, fixtures.layers(spark, sf_dir))


def _totals(strict: bool):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        layers = fixtures.layers(spark, sf_dir)
        return counts.layer_totals(spark, layers, counts.table_counts(spark, layers), strict)

    return f


for _name, _strict, _sum in (("layer_totals_strict", True, "coalesce(sum(n), 0)"), ("layer_totals_nullable", False, "sum(n)")):
    QUERIES[_name] = _totals(_strict)
    ORACLE_SQL[_name] = f"WITH {_COUNTS} SELECT l.layer_ord, l.label, CAST({_sum} AS BIGINT) AS total_rows FROM {_LAYERS} LEFT JOIN counts c USING (layer_ord) GROUP BY ALL"
    ORACLE_SQL[_name] = ORACLE_SQL[_name].replace("FROM (VALUES", "FROM (SELECT * FROM (VALUES").replace("AS layers(layer_ord, label)", "AS v(layer_ord, label)) l")

_PREDICATES = ("o_orderstatus <> 'P'", "o_totalprice > 100000", "o_custkey NOT IN (1, 2, 3)", "nullif(o_orderstatus, 'F') <> 'P'", "nullif(o_totalprice > 100000, true)", "x.o_custkey > 1", "no_such_column = 1", "this is not sql")
_COMPUTED = _PREDICATES[:5]


@query(
    " UNION ALL ".join(f"SELECT {literal(p)} AS predicate, count(*) FILTER (WHERE NOT ({p})) AS excluded, count(*) FILTER (WHERE ({p}) IS NULL) AS null_dropped FROM orders" for p in _COMPUTED)
    + "".join(f" UNION ALL SELECT {literal(p)}, NULL, NULL" for p in _PREDICATES[5:])
)
def exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exclusions.excluded(spark.read.parquet(f"{sf_dir}/orders.parquet"), list(_PREDICATES))
    rows = [(p, *(got or (None, None))) for p, got in zip(_PREDICATES, found)]
    return spark.createDataFrame(rows, "predicate string, excluded long, null_dropped long")


def _kind_sql(name: str, layer: str) -> str:
    tests = [(k, f"regexp_matches(lower({name}), {literal(p.replace(chr(92) + 'z', '$'))})") for k, p in KINDS]
    tests = [(k, f"({t} OR regexp_matches(lower(coalesce({layer}, '')), {literal(STAGING_LAYER)}))" if k == "staging" else t) for k, t in tests]
    return "CASE " + " ".join(f"WHEN {t} THEN '{k}'" for k, t in tests) + " ELSE 'other' END"


_NAMES = tuple((n, x) for n in ("fact_sales", "FCT_x", "f_y", "sales_facts", "a_fact_b", "dim_date", "d_z", "my_dimension", "bridge_a", "user_map", "xref_q", "stg_a", "stgfoo", "tmp_x", "work_y", "orders", "factory", "") for x in ("bronze", "Raw zone", "gold", None))


@query(f"SELECT k, name, layer, {_kind_sql('name', 'layer')} AS kind FROM (SELECT k, name || CASE WHEN k % 2 = 0 THEN '_' || k ELSE '' END AS name, layer FROM {supplied(_NAMES, 'name', 'layer')})")
def classify_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of_suppliers(spark, sf_dir, _NAMES, "name string,layer string").withColumn("name", F.concat("name", F.when(F.col("k") % 2 == 0, F.concat(F.lit("_"), F.col("k").cast("string"))).otherwise(F.lit(""))))
    return rows.withColumn("kind", table_kind(F.col("name"), F.col("layer")))


_SCHEMAS = tuple(enumerate(("zz_gold", "Landing", "raw_x", "silver", "mart", "misc", "clean_source")))
_RANK = "CASE " + " ".join(f"WHEN regexp_matches(lower(name), '{'|'.join(keys)}') THEN {i}" for i, (_, keys) in enumerate(LAYERS)) + " END"


@query(
    f"SELECT layer_ord, CASE layer_ord WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' ELSE 'gold' END AS label, arg_min(name, ord) AS \"schema\" FROM (SELECT *, CAST({_RANK} AS INT) AS layer_ord FROM (SELECT k * 10 + ord AS ord, name || '_' || k AS name FROM {supplied(_SCHEMAS, 'ord', 'name')}))"
    " WHERE layer_ord IS NOT NULL GROUP BY layer_ord"
)
def detect_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of_suppliers(spark, sf_dir, _SCHEMAS, "ord int,name string")
    return summary.detect_layers(rows.select((F.col("k") * 10 + F.col("ord")).alias("ord"), F.concat("name", F.lit("_"), F.col("k").cast("string")).alias("name")))


_NOTEBOOK_NAMES = tuple(enumerate(("Sales_v2.py", "sales-final", "sales (2)", "sales(2)", "sales_2024", "_v1_v2", "load  orders", "Load-Orders_copy.sql", "Δ", "x.ipynb", "x_old_bak", " sales ", "v2", "(3)")))
_BASE = r"regexp_replace(regexp_replace(trim(name), '\.(py|sql|scala|r|ipynb)$', '', 'i'), '^(.+?)(?:[_\-](?:v\d+|version\d+|final|draft|copy|old|new|backup|bak|wip|\d+)|\(\d+\))+$', '\1', 'is')"
_KEY = rf"regexp_replace(regexp_replace(lower({_BASE}), '[\s_\-]+', '_', 'g'), '^_+|_+$', '', 'g')"
_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(base_key, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'group')"


@query(f"SELECT {_SLUG} AS id, base_key, string_agg(name, '|' ORDER BY ord) AS paths FROM (SELECT *, {_KEY} AS base_key FROM (SELECT k * 100 + ord AS ord, 's' || k || name AS name FROM {supplied(_NOTEBOOK_NAMES, 'ord', 'name')})) GROUP BY base_key")
def notebook_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of_suppliers(spark, sf_dir, _NOTEBOOK_NAMES, "ord int,name string")
    rows = rows.select((F.col("k") * 100 + F.col("ord")).alias("nb_ord"), F.concat(F.lit("s"), F.col("k").cast("string"), "name").alias("name")).withColumn("path", F.col("name"))
    return drift.notebook_groups(rows).select("id", "base_key", F.array_join("paths", "|").alias("paths"))


def _cells_sql(unknown: str) -> str:
    """CTE `cells` over the fixture's notebooks: nb_ord, path, cell_index, language, source."""
    parts = []
    languages = "CASE lower(named) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MAGIC.items()) + " ELSE 'unknown' END"
    for language in ("PYTHON", "SQL", "SCALA", "R", "UNKNOWN"):
        read_as = unknown if language == "UNKNOWN" else language
        p, default = PREFIX.get(read_as, "#"), {"UNKNOWN": "unknown"}.get(read_as, read_as.lower())
        rows = [(i, path, s) for i, (path, x, s) in enumerate(fixtures.NOTEBOOKS) if x == language]
        magic = rf"'^{p}\s*MAGIC\b ?(.*)$'"
        parts.append(
            rf"""SELECT nb_ord, path, cell_index, CASE WHEN named <> '' THEN {languages} ELSE '{default}' END AS language,
              CASE WHEN NOT marked THEN plain ELSE regexp_replace(array_to_string(CASE WHEN named <> '' THEN bare[2:] ELSE bare END, chr(10)), '^\s+|\s+$', '', 'g') END AS source
            FROM (SELECT *, CASE WHEN marked THEN regexp_extract(bare[1], '^%([a-zA-Z-]+)\s*$', 1) ELSE '' END AS named
              FROM (SELECT *, regexp_matches(lines[1], {magic}) AS marked, [CASE WHEN regexp_matches(x, {magic}) THEN regexp_extract(x, {magic}, 1) ELSE x END FOR x IN lines] AS bare
                FROM (SELECT *, string_split(plain, chr(10)) AS lines
                  FROM (SELECT nb_ord, path, i - 1 AS cell_index, regexp_replace(raw[i], '^\n+|\n+$', '', 'g') AS plain
                    FROM (SELECT nb_ord, path, raw, unnest(range(1, len(raw) + 1)) AS i
                      FROM (SELECT nb_ord, path, regexp_split_to_array(regexp_replace(replace(src, chr(13) || chr(10), chr(10)), '^{p}\s*Databricks notebook source\s*\n', ''), '(?m)^{p}\s*COMMAND -+\s*$') AS raw
                        FROM (SELECT k * 100 + nb_ord AS nb_ord, '/s' || k || path AS path, src FROM {supplied(rows, "nb_ord", "path", "src")})))) WHERE plain <> '')))"""
        )
    return "cells AS (" + " UNION ALL ".join(parts) + ")"


@query(f"WITH {_cells_sql('UNKNOWN')} SELECT path, CAST(cell_index AS INT) AS cell_index, language, source FROM cells")
def notebook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(corpus_of(spark, sf_dir)).select("path", "cell_index", "language", "source")


@query(
    f"WITH {_cells_sql('PYTHON')}, code AS (SELECT *, contains(lower(source), 'silver.stg_lineitem') OR contains(lower(source), 'stg_lineitem') AS hit FROM cells WHERE language <> 'md' AND trim(source) <> ''),"
    " w AS (SELECT *, max(hit) OVER (PARTITION BY nb_ord) AS any_hit FROM code)"
    " SELECT path, CAST(cell_index AS INT) AS cell_index, source[1:4000] AS snippet FROM w WHERE hit OR NOT any_hit ORDER BY nb_ord, w.cell_index LIMIT 40"
)
def level_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.level_code(corpus_of(spark, sf_dir), ["silver.stg_lineitem"]).select("path", "cell_index", "snippet")


# The facts that the fixture's notebooks hold, as read by eye: place, metric, tables (target first), raw text, target, sources, join hint, WHERE.
_P = "/etl/"
_CLEAN = "CREATE OR REPLACE TABLE silver.orders AS SELECT * FROM bronze.orders WHERE o_orderstatus <> '{}'"
_SALES = "INSERT OVERWRITE gold.fact_sales SELECT l.*, o.o_custkey FROM silver.stg_lineitem l JOIN silver.orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_totalprice > 1000"
_MERGE = "MERGE INTO gold.dim_customer t USING bronze.customer s ON t.c_custkey = s.c_custkey WHEN NOT MATCHED THEN INSERT *"
_MAP = "CREATE TABLE silver.customer_map AS WITH c AS (SELECT * FROM bronze.customer WHERE c_acctbal > 0) SELECT c.c_custkey FROM c WHERE c_custkey BETWEEN 1 AND 100"
_FRAME = fixtures.NOTEBOOKS[4][2]
_FACTS = (
    (0, _P + "load_orders", 1, 0, "silver.orders", "bronze.orders", None, "o_orderstatus <> 'P'", _CLEAN.format("P")),
    (0, _P + "load_orders", 4, 0, None, "silver.orders", None, None, "SELECT count(*) FROM silver.orders"),
    (1, _P + "load_orders_v2", 1, 0, "silver.orders", "bronze.orders", None, "o_orderstatus <> 'F'", _CLEAN.format("F")),
    (1, _P + "load_orders_v2", 4, 0, None, "silver.orders", None, None, "SELECT count(*) FROM silver.orders"),
    (2, _P + "load_orders_final", 0, 0, None, "bronze.orders", None, None, "SELECT a FROM bronze.orders"),
    (2, _P + "load_orders_final", 0, 1, None, "bronze.orders", None, None, "select  a from bronze.orders -- same"),
    (2, _P + "load_orders_final", 1, 0, "recent", "silver.orders", None, "o_orderdate > '1997-01-01'", "CREATE TEMP VIEW recent AS SELECT * FROM silver.orders WHERE o_orderdate > '1997-01-01'"),
    (3, _P + "build_sales", 0, 0, "silver.stg_lineitem", "bronze.raw_lineitem", None, "l_returnflag <> 'R'", "CREATE OR REPLACE TABLE silver.stg_lineitem USING DELTA AS SELECT * FROM bronze.raw_lineitem WHERE l_returnflag <> 'R'"),
    (3, _P + "build_sales", 1, 0, "gold.fact_sales", "silver.stg_lineitem,silver.orders", "l.l_orderkey = o.o_orderkey", "o.o_totalprice > 1000", _SALES),
    (3, _P + "build_sales", 1, 1, "gold.dim_customer", "bronze.customer", "t.c_custkey = s.c_custkey", None, _MERGE),
    (3, _P + "build_sales", 2, 0, None, "", None, None, "SELECT * FROM {table}"),
    (4, _P + "df_api", 0, lineage.LAST, "gold.orders", "silver.orders", None, None, _FRAME),
    (6, _P + "quirks", 0, 0, "silver.customer_map", "bronze.customer", None, "c_custkey BETWEEN 1 AND 100", _MAP),
    (6, _P + "quirks", 1, 0, "silver.stg_tmp", "bronze.customer", None, "x.c_acctbal < 0", "INSERT INTO `silver`.`stg_tmp` SELECT * FROM bronze.customer x WHERE x.c_acctbal < 0"),
    (6, _P + "quirks", 1, 1, None, "", None, None, "SELECT '"),
    (6, _P + "quirks", 1, 2, None, "", None, None, "' AS semi"),
)
_FACT_SQL = "facts AS (SELECT * FROM " + values(_FACTS, "v", "nb_ord", "path", "cell_index", "stmt_idx", "target", "sources", "hint", "predicate", "raw_sql") + ")"

_OWN_FACTS = _FACT_SQL.replace("SELECT * FROM (VALUES", "SELECT s_suppkey * 100 + nb_ord AS nb_ord, '/s' || s_suppkey || path AS path, cell_index, stmt_idx, target, sources, hint, predicate, raw_sql FROM supplier, (VALUES", 1)


@query(f"WITH {_OWN_FACTS} SELECT path, CAST(cell_index AS INT) AS cell_index, CAST(stmt_idx AS INT) AS stmt_idx, target, sources, predicate, raw_sql FROM facts")
def lineage_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.lineage_facts(corpus_of(spark, sf_dir)).select("path", "cell_index", "stmt_idx", "target", F.array_join("sources", ",").alias("sources"), "predicate", "raw_sql")


_INDEX = "idx AS (SELECT DISTINCT lower(tbl) AS name FROM " + values([(t,) for _, _, _, t, _ in _TABLES], "v", "tbl") + ")"


@query(
    f"WITH {_OWN_FACTS}, {_INDEX}, e AS (SELECT nb_ord, cell_index, stmt_idx, unnest(string_split(sources, ',')) AS source, target, hint, path FROM facts WHERE target IS NOT NULL AND string_split(target, '.')[-1] IN (SELECT name FROM idx)),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY nb_ord, cell_index, stmt_idx) AS n FROM e)"
    " SELECT source, target, hint AS join_key_hint, path, CAST(cell_index AS INT) AS cell_index FROM r WHERE n = 1"
)
def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table_index(inventory(spark, fixtures.layers(spark, sf_dir)))
    return lineage.edges(lineage.lineage_facts(corpus_of(spark, sf_dir)), index)


@query(
    f"WITH {_OWN_FACTS} SELECT target, path, CAST(cell_index AS INT) AS cell_index, sources, raw_sql[1:400] || CASE WHEN length(raw_sql) > 400 THEN chr(10) || '...' ELSE '' END AS snippet"
    " FROM facts WHERE len(list_filter(string_split(sources, ','), lambda x: string_split(x, '.')[-1] = 'orders')) > 0 AND len(string_split(target, '.')) >= 2 AND string_split(target, '.')[-2] = 'gold'"
)
def lineage_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.fan_out(corpus_of(spark, sf_dir), "silver.orders", "gold").select("target", "path", "cell_index", F.array_join("sources", ",").alias("sources"), "snippet")


@query(f"WITH {_OWN_FACTS} SELECT path, CAST(cell_index AS INT) AS cell_index, raw_sql AS snippet FROM facts WHERE target IN ('orders', 'silver.orders', 'main.silver.orders') OR ends_with(target, '.silver.orders')")
def writers_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.writers(corpus_of(spark, sf_dir), "main", "silver", "orders").select("path", "cell_index", "snippet")


@query(
    f"WITH {_OWN_FACTS} SELECT path, CAST(cell_index AS INT) AS cell_index, raw_sql AS snippet FROM facts WHERE stmt_idx < {lineage.LAST}"
    " AND len(list_filter(string_split(concat_ws(',', target, sources), ','), lambda x: string_split(x, '.')[-1] = 'customer')) > 0"
)
def responsible_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.responsible_code(corpus_of(spark, sf_dir), "customer").select("path", "cell_index", "snippet")


# Which rows each rule is counted on: the last layer that has the source's bare name.
_SOURCES = {"bronze.orders": _KEPT, "bronze.raw_lineitem": "lineitem", "bronze.customer": "customer"}


def _rules_sql(told: Callable[[int], tuple[str, str]] = lambda k: ("", "ok")) -> str:
    """told: what is said of the rule at a place, and its severity."""
    parts = []
    for i, label, _, table, _ in _TABLES:
        if i == 0:
            continue
        fact = next((f for f in _FACTS if f[4] and f[4].rsplit(".", 1)[-1] == table), None)
        if fact is None or fact[7] is None:
            continue
        _, path, cell, _, _, sources, _, predicate, _ = fact
        plain = "," not in sources and "x." not in predicate and "o." not in predicate
        count = f"(SELECT count(*) FROM (SELECT * FROM {_SOURCES[sources]}) WHERE NOT ({predicate}))" if plain else "CAST(NULL AS BIGINT)"
        said, severity = told(len(parts))
        parts.append(
            f"SELECT '{label}' AS layer, {literal(path)} AS path, {cell} AS cell_index, {literal(predicate)} AS predicate_sql, {literal(sources.split(',')[0])} AS source_table,"
            f" {count} AS excluded_count, {literal(f'{table}: {predicate}')} AS rule_label, {literal(said)} AS explanation, {literal(severity)} AS severity"
        )
    return " UNION ALL ".join(parts)


@query(_rules_sql())
def exclusion_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = exclusions.exclusion_rules(spark, fixtures.layers(spark, sf_dir), lineage.lineage_facts(fixtures.corpus(spark)))
    return rules.select(F.col("label").alias("layer"), "path", "cell_index", "predicate_sql", "source_table", "excluded_count", "rule_label", "explanation", "severity")


# Statements of the one group with several notebooks: place, name, set of tables, a number for each different normal form.
_DRIFT = (
    (0, 1, 0, "orders_clean", "bronze.orders,silver.orders", 1), (0, 4, 0, "orders_clean", "silver.orders", 2),
    (1, 1, 0, "orders_clean", "bronze.orders,silver.orders", 3), (1, 4, 0, "orders_clean", "silver.orders", 2),
    (2, 0, 0, "cell_0_0", "bronze.orders", 4), (2, 0, 1, "cell_0_1", "bronze.orders", 4), (2, 1, 0, "recent", "recent,silver.orders", 5),
)
_DRIFT_SQL = "f AS (SELECT * FROM " + supplied(_DRIFT, "m", "cell", "stmt", "metric", "tables", "norm") + ")"
_place = lambda m, cell: f"'/s' || k || CASE {m} WHEN 0 THEN '/etl/load_orders' WHEN 1 THEN '/etl/load_orders_v2' ELSE '/etl/load_orders_final' END || ' (cell ' || {cell} || ')'"
_PAIR = "a.k = b.k AND a.m <> b.m AND a.norm <> b.norm AND (a.m, a.cell, a.stmt) < (b.m, b.cell, b.stmt)"


@query(
    f"""WITH {_DRIFT_SQL}, p1 AS (SELECT a.k, 1 AS pass, a.metric AS key, min((z.m, z.cell, z.stmt)) AS first, a.m AS am, a.cell AS ac, a.stmt AS "as", b.m AS bm, b.cell AS bc, b.stmt AS bs
      FROM f a JOIN f b ON a.metric = b.metric AND {_PAIR} JOIN f z ON z.metric = a.metric AND z.k = a.k GROUP BY ALL),
    p2 AS (SELECT a.k, 2 AS pass, a.tables AS key, min((z.m, z.cell, z.stmt)) AS first, a.m AS am, a.cell AS ac, a.stmt AS "as", b.m AS bm, b.cell AS bc, b.stmt AS bs
      FROM f a JOIN f b ON a.tables = b.tables AND {_PAIR} JOIN f z ON z.tables = a.tables AND z.k = a.k
      WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.k = a.k AND p1.am = a.m AND p1.ac = a.cell AND p1.bm = b.m AND p1.bc = b.cell) GROUP BY ALL),
    u AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pass, first, am, ac, "as", bm, bc, bs) AS n FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2))
    SELECT 's' || k || '-load-orders-sql-' || n AS id, 's' || k || '-load-orders' AS group_id, 'sql-logic-mismatch' AS type, key, CAST(ac AS INT) AS left_cell, CAST(bc AS INT) AS right_cell,
      CASE pass WHEN 1 THEN 'The SQL named "' ELSE 'Statements over "' END || key || CASE pass WHEN 1 THEN '" is' ELSE '" are' END || ' not the same in ' || {_place('am', 'ac')} || ' and ' || {_place('bm', 'bc')} || '.' AS description FROM u"""
)
def sql_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = corpus_of(spark, sf_dir)
    found = drift.sql_drift(books, drift.notebook_groups(books))
    return found.select("id", "group_id", "type", "key", "description", F.col("left.cell_index").alias("left_cell"), F.col("right.cell_index").alias("right_cell"))


_DEFS = ((0, 3, 0, "threshold", "threshold = 100"), (0, 3, 1, "clean", "1"), (1, 3, 0, "threshold", "threshold = 200"), (1, 3, 1, "clean", "2"))


@query(
    f"WITH f AS (SELECT * FROM {supplied(_DEFS, 'm', 'cell', 'i', 'name', 'norm')})"
    " SELECT 's' || a.k || '-load-orders-code-' || row_number() OVER (PARTITION BY a.k ORDER BY a.m, a.cell, a.i) AS id, a.name AS key, CAST(a.cell AS INT) AS left_cell, CAST(b.cell AS INT) AS right_cell,"
    f" CASE a.name WHEN 'clean' THEN 'Function' ELSE 'Variable' END || ' \"' || a.name || '\" has different definitions in ' || {_place('a.m', 'a.cell').replace('|| k ||', '|| a.k ||')} || ' and ' || {_place('b.m', 'b.cell').replace('|| k ||', '|| a.k ||')} || '.' AS description"
    " FROM f a JOIN f b ON a.k = b.k AND a.name = b.name AND a.m < b.m AND a.norm <> b.norm"
)
def code_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = corpus_of(spark, sf_dir)
    found = drift.code_drift(books, drift.notebook_groups(books))
    return found.select("id", "key", "description", F.col("left.cell_index").alias("left_cell"), F.col("right.cell_index").alias("right_cell"))


_ALL_DEFS = (
    ("load_orders", 3, "threshold", "variable", "threshold = 100"), ("load_orders", 3, "clean", "function", 'def clean(df): return df.where("x > 1")'),
    ("load_orders_v2", 3, "threshold", "variable", "threshold = 200"), ("load_orders_v2", 3, "clean", "function", 'def clean(df): return df.where("x > 2")'),
    ("build_sales", 0, "stg", "variable", fixtures.NOTEBOOKS[3][2].split("\n")[0]), ("df_api", 0, "df", "variable", _FRAME.split("\n")[0]),
    ("udfs", 0, "twice", "function", "def twice(x: Int): Int = { if (x > 0) { x * 2 } else { 0 } }"), ("udfs", 0, "once", "function", "def once(x: Int) = x"),
    ("udfs", 0, "limit", "variable", "val limit: Int = 5"), ("udfs", 0, "name", "variable", 'var name = "a"'),
)


@query(f"SELECT '/s' || k || '/etl/' || path AS path, CAST(cell AS INT) AS cell_index, name, kind, normal FROM {supplied(_ALL_DEFS, 'path', 'cell', 'name', 'kind', 'normal')}")
def code_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codedefs.code_defs(corpus_of(spark, sf_dir)).select("path", "cell_index", "name", "kind", "normal")


_METRICS = tuple((p.removeprefix(_P), c, i) for _, p, c, i, *_ in _FACTS if i < lineage.LAST)
_METRIC_NAMES = ("orders_clean", "orders_clean", "orders_clean", "orders_clean", "cell_0_0", "cell_0_1", "recent", "stg", "cell_1", "cell_1", "cell_2", "cell_0", "cell_1_0", "cell_1_1", "cell_1_2")


@query(f"SELECT '/s' || k || '/etl/' || path AS path, CAST(c AS INT) AS cell_index, CAST(i AS INT) AS stmt_idx, metric_name FROM {supplied([(*m, n) for m, n in zip(_METRICS, _METRIC_NAMES)], 'path', 'c', 'i', 'metric_name')}")
def sql_fact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlfacts.sql_facts(corpus_of(spark, sf_dir)).select("path", "cell_index", "stmt_idx", "metric_name")


@query(
    f"WITH {_COUNTS}, k AS (SELECT *, {_kind_sql('tbl', 'label')} AS kind FROM counts), {_FACT_SQL}, {_INDEX},"
    " e AS (SELECT DISTINCT unnest(string_split(sources, ',')) AS source, target FROM facts WHERE target IS NOT NULL AND string_split(target, '.')[-1] IN (SELECT name FROM idx)),"
    " p AS (SELECT arg_min(path, (nb_ord, cell_index, stmt_idx)) AS path FROM (SELECT *, unnest(string_split(sources, ',')) AS source FROM facts WHERE target IS NOT NULL AND string_split(target, '.')[-1] IN (SELECT name FROM idx)) GROUP BY source, target)"
    " SELECT CAST(4 AS BIGINT) AS layer_count, count(*) AS table_count, count(*) FILTER (WHERE kind = 'fact') AS fact_table_count, count(*) FILTER (WHERE kind = 'dimension') AS dimension_table_count,"
    " count(*) FILTER (WHERE kind NOT IN ('fact', 'dimension')) AS other_table_count, CAST(sum(n) AS BIGINT) AS total_rows, (SELECT count(*) FROM e) AS lineage_edge_count, (SELECT count(DISTINCT path) FROM p) AS notebook_count FROM k"
)
def project_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.summarise(spark, fixtures.layers(spark, sf_dir), fixtures.corpus(spark)).stats


# Answers of an explaining model: as asked, fenced, malformed, null, and with wrong types.
_ANSWERS = (
    '{"responsibleIndex": 1, "explanation": "b", "isCorrect": true, "alerts": ["x", 1, null, "y"], "status": "ok", "summary": "s", "overview": "o", "architecture": "a", "howItWorks": "h", "onboardingTips": ["t", 2]}',
    '```json\n{"responsibleIndex": 1.9, "explanation": 5, "isCorrect": "true", "alerts": "no", "status": "fine", "summary": 1, "overview": null}\n```',
    "not json at all",
    "null",
    '{"responsibleIndex": -0.5, "explanation": ""}',
    '{"responsibleIndex": 7}',
    '{"responsibleIndex": "1", "isCorrect": false, "status": "error"}',
    "[1, 2]",
)
_answer_sql = lambda answers: (
    "r AS (SELECT k * 100 + i AS i, replace(raw, '\"b\"', '\"b' || k || '\"') AS raw FROM " + supplied(list(enumerate(answers)), "i", "raw") + "),"
    r" c AS (SELECT i, regexp_replace(regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '^```(?:json)?\s*', '', 'i'), '```\s*$', '') AS t FROM r),"
    " j AS (SELECT i, t, CASE WHEN json_valid(t) AND t <> 'null' THEN CAST(t AS JSON) END AS j FROM c)"
)
_ANSWER_SQL = _answer_sql(_ANSWERS)
_is = lambda field, kind: f"json_type(j, '$.{field}') IN ({kind})"
_text = lambda field: f"CASE WHEN {_is(field, chr(39) + 'VARCHAR' + chr(39))} THEN j->>'$.{field}' END"
_texts = lambda field: (
    f"coalesce(CASE WHEN {_is(field, chr(39) + 'ARRAY' + chr(39))} THEN array_to_string(list_transform(list_filter(CAST(j->'$.{field}' AS JSON[]), lambda x: json_type(x) = 'VARCHAR'), lambda x: x->>'$'), '|') END, '')"
)


def _answers(spark: SparkSession, sf_dir: str, answers=_ANSWERS) -> DataFrame:
    """Answers about each supplier."""
    rows = of_suppliers(spark, sf_dir, list(enumerate(answers)), "i int,raw string").withColumn("n", F.lit(3))
    named = F.replace("raw", F.lit('"b"'), F.concat(F.lit('"b'), F.col("k").cast("string"), F.lit('"')))
    return rows.select((F.col("k") * 100 + F.col("i")).alias("i"), named.alias("raw"), "n")


@query(
    f"WITH {_ANSWER_SQL}, x AS (SELECT i, t, j, CASE WHEN {_is('responsibleIndex', chr(39) + 'BIGINT' + chr(39) + ', ' + chr(39) + 'UBIGINT' + chr(39) + ', ' + chr(39) + 'DOUBLE' + chr(39))} THEN trunc(CAST(j->>'$.responsibleIndex' AS DOUBLE)) END AS k FROM j)"
    f" SELECT i, CASE WHEN k >= 0 AND k < 3 THEN CAST(k AS INT) END AS responsible_index, coalesce({_text('explanation')}, t) AS explanation FROM x"
)
def parse_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("i", responses.analysis(F.col("raw"), F.col("n")).alias("a")).select("i", "a.*")


@query(f"WITH {_ANSWER_SQL} SELECT i, coalesce({_is('isCorrect', chr(39) + 'BOOLEAN' + chr(39))} AND j->>'$.isCorrect' = 'true', false) AS is_correct, {_texts('alerts')} AS alerts, coalesce({_text('explanation')}, t) AS explanation FROM j")
def parse_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("i", responses.validation(F.col("raw")).alias("a")).select("i", "a.is_correct", F.array_join("a.alerts", "|").alias("alerts"), "a.explanation")


@query(f"WITH {_ANSWER_SQL} SELECT i, CASE WHEN {_text('status')} IN ('ok', 'warning', 'error') THEN j->>'$.status' ELSE 'warning' END AS status, coalesce({_text('summary')}, t) AS summary FROM j")
def parse_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("i", responses.level(F.col("raw")).alias("a")).select("i", "a.status", "a.summary")


@query(
    f"WITH {_ANSWER_SQL} SELECT i, coalesce({_text('overview')}, t) AS overview, coalesce({_text('architecture')}, '') AS architecture, coalesce({_text('howItWorks')}, '') AS how_it_works, {_texts('onboardingTips')} AS onboarding_tips FROM j"
)
def parse_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("i", responses.narrative(F.col("raw")).alias("a")).select("i", "a.overview", "a.architecture", "a.how_it_works", F.array_join("a.onboarding_tips", "|").alias("onboarding_tips"))


_EXPLAINED = (
    '{"explanations": [{"index": 0, "explanation": "a", "severity": "warning"}, {"index": 2, "explanation": "c"}, {"index": 2.5, "explanation": "d", "severity": "bad"}, {"index": "1", "explanation": "no"}, 5, null]}',
    '```\n{"explanations": []}\n```',
    "broken {",
    '{"explanations": {"index": 0}}',
)
_TOLD = ((0, 0, "a", "warning"), (0, 1, responses.NO_RULE, "warning"), (0, 2, "d", "ok")) + tuple((i, k, t, "warning") for i, t in ((1, '{"explanations": []}\n'), (2, "broken {"), (3, '{"explanations": {"index": 0}}')) for k in range(3))


@query(f"SELECT k * 100 + i AS i, CAST(pos AS INT) AS \"index\", explanation, severity FROM {supplied(_TOLD, 'i', 'pos', 'explanation', 'severity')}")
def parse_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir, _EXPLAINED)
    return responses.exclusions(rows).select("i", F.explode("explanations").alias("e")).select("i", "e.*")


_LINES = (
    '{"explanations": [{"targetTable": "a", "explanation": "1"}, {"targetTable": "a", "explanation": "2"}, {"targetTable": "b", "explanation": 3}, {"targetTable": 4, "explanation": "x"}]}',
    "oops",
)
_LINED = ((0, "a", "2"), (0, "b", responses.NO_LINEAGE), (1, "a", "oops"), (1, "b", "oops"))


@query(f"SELECT k * 100 + i AS i, target, explanation FROM {supplied(_LINED, 'i', 'target', 'explanation')}")
def parse_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of_suppliers(spark, sf_dir, list(enumerate(_LINES)), "i int,raw string").withColumn("i", F.col("k") * 100 + F.col("i")).withColumn("targets", F.array(F.lit("a"), F.lit("b")))
    return responses.lineage(rows).select("i", F.explode("explanations").alias("e")).select("i", "e.*")


# What a heading is called, over real lines.
_HEADED = (("# Sales  KPI!",), ("  ## Δ",), ("###x_y",), ("#  ",))
_SLUGGED = r"regexp_replace(regexp_replace(lower(regexp_replace(h, '^\s*#+\s*', '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"SELECT h, CASE WHEN regexp_matches(h, {literal(HEADING)}) THEN {_SLUGGED} END AS name FROM (SELECT h || ' ' || k AS h FROM {supplied(_HEADED, 'h')})")
def heading_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = of_suppliers(spark, sf_dir, _HEADED, "h string").select(F.concat("h", F.lit(" "), F.col("k").cast("string")).alias("path"))
    two = F.array(*[F.struct(F.lit(i).alias("cell_index"), F.lit(x).alias("language"), t.alias("source")) for i, (x, t) in enumerate((("md", F.col("path")), ("sql", F.lit("SELECT 1"))))])
    rows = heads.select(F.lit(0).alias("nb_ord"), "path", F.inline(two))
    return headings(rows).where("language = 'sql'").select(F.col("path").alias("h"), F.col("heading").alias("name"))


@query(f"SELECT name, {_KEY} AS key FROM (SELECT k || name AS name FROM {supplied(_NOTEBOOK_NAMES, 'ord', 'name')})")
def notebook_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of_suppliers(spark, sf_dir, _NOTEBOOK_NAMES, "ord int,name string").select(F.concat(F.col("k").cast("string"), "name").alias("name"))
    return rows.select("name", notebook_key(F.col("name")).alias("key"))


# A WHERE in a comment or inside a subquery drops no rows of the statement around it.
_OWN_WHERE = (
    "INSERT INTO silver.a SELECT * FROM bronze.orders -- where o_orderkey > 5\n;INSERT INTO silver.b SELECT * FROM (SELECT * FROM bronze.orders WHERE o_orderkey > 5) q;"
    "INSERT INTO silver.c SELECT * FROM bronze.orders /* where o_orderkey > 5 */ WHERE o_orderkey > 7;INSERT INTO silver.d SELECT TOP 3 * FROM bronze.orders WHERE o_orderkey > 9 -- where o_orderkey > 5"
)


@query(
    " UNION ALL ".join(
        f"SELECT '{t}: o_orderkey > {n}' AS rule_label, 'o_orderkey > {n}' AS predicate_sql, count(*) FILTER (WHERE NOT o_orderkey > {n}) AS excluded_count FROM orders" for t, n in (("c", 7), ("d", 9))
    )
)
def own_where_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    layers = [Layer("bronze", "bronze", [Table("orders", orders)]), Layer("silver", "silver", [Table(t, orders) for t in "abcd"])]
    facts = lineage.lineage_facts(notebooks(spark, [("/own", "SQL", _OWN_WHERE)]))
    return exclusions.exclusion_rules(spark, layers, facts).select("rule_label", "predicate_sql", "excluded_count")


def _cut(n: int, most: int, name: str) -> str:
    mark = "chr(10) || '...'" if most == n else "'…'"
    return f"CASE WHEN length(text) > {most} THEN substring(text, 1, {n}) || {mark} ELSE text END AS {name}"


@query(f"SELECT doc_id, {_cut(LABEL - 1, LABEL, 'label')}, {_cut(SNIPPET, SNIPPET, 'snippet')}, {_cut(LEVEL_SNIPPET, LEVEL_SNIPPET, 'level_snippet')} FROM documents")
def cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and snippets of texts beyond each of the limits."""
    text = F.col("text")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", shortened(text).alias("label"), snippet(text).alias("snippet"), snippet(text, LEVEL_SNIPPET).alias("level_snippet"))


# Reviews of a step: as asked, with entries of wrong types, malformed.
_REVIEWS = (
    '{"status": "error", "summary": "s", "reconciliationAlerts": ["a", 1, "b"], "findings": [{"severity": "error", "table": "t", "message": "m"}, {"severity": "bad", "table": "  ", "message": "n"},'
    ' {"message": 5}, {"table": 3, "message": "o"}, 7, null]}',
    "oops",
    '{"findings": "no", "status": "great", "reconciliationAlerts": {}}',
)
_SEVERITY = "CASE WHEN json_type(x, '$.severity') = 'VARCHAR' AND x->>'$.severity' IN ('info', 'warning', 'error') THEN x->>'$.severity' ELSE 'info' END"


@query(
    f"WITH {_answer_sql(_REVIEWS)}, f AS (SELECT i, unnest(CASE WHEN {_is('findings', chr(39) + 'ARRAY' + chr(39))} THEN CAST(j->'$.findings' AS JSON[]) ELSE [] END) AS x FROM j),"
    f" g AS (SELECT i, x->>'$.message' AS message, {_SEVERITY} AS severity, CASE WHEN json_type(x, '$.table') = 'VARCHAR' AND trim(x->>'$.table') <> '' THEN x->>'$.table' END AS \"table\" FROM f WHERE json_type(x, '$.message') = 'VARCHAR')"
    f" SELECT j.i, {_texts('reconciliationAlerts')} AS alerts, severity, message, \"table\" FROM j LEFT JOIN g ON g.i = j.i"
)
def parse_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir, _REVIEWS).select("i", responses.level(F.col("raw")).alias("a"))
    return rows.select("i", F.array_join("a.reconciliation_alerts", "|").alias("alerts"), F.explode_outer("a.findings").alias("f")).select("i", "alerts", "f.*")


# A notebook a supplier, so that code grows with the data: a heading, a table with a filter, an insertion with a join.
_MADE = {
    "made": "silver.t_{k}", "read": "bronze.src_{m}", "out": "gold.g_{g}",
    "create": "CREATE TABLE silver.t_{k} AS SELECT * FROM bronze.src_{m} WHERE amount > {n}",
    "count": "SELECT count(*) FROM silver.t_{k}",
    "insert": "INSERT INTO gold.g_{g} SELECT a.* FROM silver.t_{k} a JOIN bronze.src_0 b ON a.id = b.id",
    "path": "/gen/n{k}",
}
_BOOK = "-- Databricks notebook source\n-- MAGIC %md\n-- MAGIC # Step {k}\n-- COMMAND ----------\n{create};\n{count}\n-- COMMAND ----------\n{insert}"


def _filled(template: str) -> str:
    """A template over a supplier's key as an expression of SQL."""
    out = literal(template)
    for hole, value in (("k", "s_suppkey"), ("m", "s_suppkey % 7"), ("g", "s_suppkey % 5"), ("n", "s_nationkey")):
        out = out.replace("{" + hole + "}", f"' || CAST({value} AS VARCHAR(20)) || '")
    return f"({out})"


_M = {name: _filled(t) for name, t in _MADE.items()}
_MADE_CELLS = (
    "made_cells AS (SELECT s_suppkey AS k, 0 AS cell_index, 'md' AS language, " + _filled("# Step {k}") + f" AS source, {_M['path']} AS path FROM supplier"
    f" UNION ALL SELECT s_suppkey, 1, 'sql', {_M['create']} || ';' || chr(10) || {_M['count']}, {_M['path']} FROM supplier UNION ALL SELECT s_suppkey, 2, 'sql', {_M['insert']}, {_M['path']} FROM supplier)"
)
_MADE_FACTS = (
    f"made_facts AS (SELECT s_suppkey AS k, {_M['path']} AS path, 1 AS cell_index, 0 AS stmt_idx, {_M['made']} AS target, {_M['read']} AS sources, {_filled('amount > {n}')} AS predicate, {_M['create']} AS raw_sql FROM supplier"
    f" UNION ALL SELECT s_suppkey, {_M['path']}, 1, 1, NULL, {_M['made']}, NULL, {_M['count']} FROM supplier"
    f" UNION ALL SELECT s_suppkey, {_M['path']}, 2, 0, {_M['out']}, {_M['made']} || ',bronze.src_0', NULL, {_M['insert']} FROM supplier)"
)


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _BOOK
    for name in ("create", "count", "insert"):
        text = text.replace("{" + name + "}", _MADE[name])
    expr = _filled(text).replace("\n", "\\n").replace("VARCHAR(20)", "STRING")
    path = _M["path"].replace("VARCHAR(20)", "STRING")
    rows = suppliers(spark, sf_dir)
    return rows.select(F.col("s_suppkey").cast("int").alias("nb_ord"), F.expr(path).alias("path"), F.substring_index(F.expr(path), "/", -1).alias("name"), F.lit("SQL").alias("language"), F.expr(expr).alias("source"))


@query(f"WITH {_MADE_CELLS} SELECT path, CAST(cell_index AS INT) AS cell_index, language, source FROM made_cells")
def made_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(_made(spark, sf_dir)).select("path", "cell_index", "language", "source")


@query(f"WITH {_MADE_FACTS} SELECT path, CAST(cell_index AS INT) AS cell_index, CAST(stmt_idx AS INT) AS stmt_idx, target, sources, predicate, raw_sql FROM made_facts")
def made_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.lineage_facts(_made(spark, sf_dir)).select("path", "cell_index", "stmt_idx", "target", F.array_join("sources", ",").alias("sources"), "predicate", "raw_sql")


@query(
    f"WITH {_MADE_FACTS}, e AS (SELECT *, unnest(string_split(sources, ',')) AS source FROM made_facts WHERE target LIKE 'gold.%')"
    " SELECT source, target, 'a.id = b.id' AS join_key_hint, arg_min(path, k) AS path, CAST(2 AS INT) AS cell_index FROM e GROUP BY source, target"
)
def made_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = spark.createDataFrame([(f"g_{i}",) for i in range(5)], "name string")
    return lineage.edges(lineage.lineage_facts(_made(spark, sf_dir)), index)


@query(f"WITH {_MADE_FACTS} SELECT path, CAST(cell_index AS INT) AS cell_index, target, raw_sql AS snippet FROM made_facts WHERE target LIKE 'gold.%'")
def made_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.fan_out(_made(spark, sf_dir), "bronze.src_0", "gold").select("path", "cell_index", "target", "snippet")


@query(f"WITH {_MADE_FACTS} SELECT path, CAST(cell_index AS INT) AS cell_index, raw_sql AS snippet FROM made_facts WHERE target = 'gold.g_0'")
def made_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.writers(_made(spark, sf_dir), "main", "gold", "g_0").select("path", "cell_index", "snippet")


@query(
    f"WITH {_MADE_CELLS}, code AS (SELECT *, contains(source, 'g_1') AS hit FROM made_cells WHERE language <> 'md'), w AS (SELECT *, max(hit) OVER (PARTITION BY path) AS any_hit FROM code)"
    " SELECT path, CAST(cell_index AS INT) AS cell_index, source AS snippet FROM w WHERE hit OR NOT any_hit ORDER BY k, w.cell_index LIMIT 40"
)
def made_level_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More code than the report's 40 snippets, from the larger scales on."""
    return search.level_code(_made(spark, sf_dir), ["gold.g_1"]).select("path", "cell_index", "snippet")


# What lies in a folder and below it.
_ENTRY = "CASE n_nationkey % 3 WHEN 0 THEN 'DIRECTORY' WHEN 1 THEN 'NOTEBOOK' ELSE 'FILE' END"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet")
    top = rows.select(F.concat(F.lit("/work/"), "n_name").alias("path"), F.expr(_ENTRY).alias("type"))
    return top.unionByName(top.select(F.concat("path", F.lit("/inner")).alias("path"), F.lit("NOTEBOOK").alias("type")))


@query(f"SELECT row_number() OVER (ORDER BY type <> 'DIRECTORY', n_name) - 1 AS place, '/work/' || n_name AS path, '/work' AS parent, type FROM (SELECT *, {_ENTRY} AS type FROM nation) WHERE type <> 'FILE'")
def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folder(_entries(spark, sf_dir), "/work/")
    return placed(rows, *listed_by()).select("place", "path", parent_of(F.col("path")).alias("parent"), "type")


@query("SELECT '/work/' || n_name || '/inner' AS path FROM nation WHERE n_nationkey = 3")
def under_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir)
    name = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey = 3").first().n_name
    return under(entries, f"/work/{name}/").select("path")


@query("SELECT doc_id, text AS source FROM documents")
def exported_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decoded(docs.select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("content"))).select("doc_id", "source")


_LISTED = ("nation", "region", "supplier")


@query(
    "SELECT c.tbl AS \"table\", columns, n AS row_count FROM (SELECT table_name AS tbl, string_agg(column_name, ',' ORDER BY ordinal_position) AS columns FROM information_schema.columns"
    f" WHERE table_name IN {_LISTED} GROUP BY table_name) c JOIN (" + " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n FROM {t}" for t in _LISTED) + ") n ON n.tbl = c.tbl"
)
def schema_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a schema of the session's catalog, as a layer. The schema is gone afterwards; its tables point at files, which stay."""
    name = f"layerwise_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name}")
    try:
        for t in _LISTED:
            spark.sql(f"CREATE TABLE {name}.{t} USING parquet LOCATION '{sf_dir}/{t}.parquet'")
        layer = schema_layer(spark, "demo", name, spark.catalog.currentCatalog())
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")
    named = spark.createDataFrame([(t.name, ",".join(c for c, _ in columns(t.df) or [])) for t in layer.tables], "table string, columns string")
    return named.join(counts.table_counts(spark, [layer]), "table").select("table", "columns", "row_count")


@query("SELECT 's' || k || '-load-orders' AS id, '/s' || k || '/etl/load_orders|/s' || k || '/etl/load_orders_v2|/s' || k || '/etl/load_orders_final' AS paths FROM (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 2 = 0)")
def chosen_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = drift.notebook_groups(corpus_of(spark, sf_dir))
    keys = [r[0] for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 2 = 0").select("s_suppkey").collect()]  # what a user asks for
    groups = drift.chosen_groups(groups, [*(f"s{k}-load-orders" for k in keys), "no-such-group"])
    return groups.select("id", F.array_join("paths", "|").alias("paths"))


# Statements as their text alone tells: target, sources without it, one-line form, tables.
_DIALECT = (
    ("MERGE INTO `A`.b USING c ON a.b.x = c.x", "a.b", "c", "merge into a.b using c on a.b.x = c.x", ""),
    ("create table if not exists T as\n select * from u join V -- from z", "t", "u,v", "create table if not exists t as select * from u join v", "u,v"),
    ("INSERT INTO t SELECT TOP 3 * FROM t JOIN w /* from y */;", "t", "w", "insert into t select top 3 * from t join w", "t,w"),
    ("SELECT 1", None, "", "select 1", ""),
)


@query(f"SELECT k, sql, target, sources, normal, tables FROM {supplied(_DIALECT, 'sql', 'target', 'sources', 'normal', 'tables')}")
def dialect_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = F.col("sql")
    joined = lambda c, name: F.array_join(c, ",").alias(name)
    rows = of_suppliers(spark, sf_dir, [(r[0],) for r in _DIALECT], "sql string")
    return rows.select("k", "sql", text_target(sql).alias("target"), joined(text_sources(sql), "sources"), normal_sql(sql).alias("normal"), joined(text_tables(sql), "tables"))


@query(f"SELECT 'a: 1 = 1' AS rule_label, '{MISSING}' AS source_table, CAST(NULL AS BIGINT) AS excluded_count")
def rule_without_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    layers = [Layer("bronze", "bronze", [Table("orders", orders)]), Layer("silver", "silver", [Table("a", orders)])]
    facts = lineage.lineage_facts(notebooks(spark, [("/one", "SQL", "INSERT INTO silver.a SELECT 1 AS x WHERE 1 = 1")]))
    return exclusions.exclusion_rules(spark, layers, facts).select("rule_label", "source_table", "excluded_count")


# Explanations by a fixed explainer: every second rule, one target, one candidate.
def _told(k: int) -> tuple[str, str]:
    return (responses.NO_RULE, "warning") if k % 2 else (f"rule {k}", "ok")


@query(_rules_sql(_told))
def explained_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = json.dumps({"explanations": [{"index": k, "explanation": f"rule {k}", "severity": "ok"} for k in range(0, 100, 2)]})
    rules = audit.analyse(spark, fixtures.layers(spark, sf_dir), fixtures.corpus(spark), lambda messages: answer).rules
    return rules.select(F.col("label").alias("layer"), "path", "cell_index", "predicate_sql", "source_table", "excluded_count", "rule_label", "explanation", "severity")


@query(
    f"WITH {_FACT_SQL}, c AS (SELECT *, row_number() OVER (ORDER BY nb_ord, cell_index, stmt_idx) - 1 AS i FROM facts WHERE stmt_idx < {lineage.LAST}"
    " AND len(list_filter(string_split(concat_ws(',', target, sources), ','), lambda x: string_split(x, '.')[-1] = 'orders')) > 0)"
    " SELECT i = 1 AS responsible, path, CAST(cell_index AS INT) AS cell_index, CAST(stmt_idx AS INT) AS stmt_idx, 'why' AS explanation FROM c"
)
def explained_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    mismatch = counts.compare_stages(spark, fixtures.layers(spark, sf_dir)).where("table_name = 'orders'").first().asDict()
    got = audit.analyse_mismatch(spark, fixtures.corpus(spark), mismatch, lambda messages: '{"responsibleIndex": 1, "explanation": "why"}')
    rows = [(is_it, c["path"], c["cell_index"], c["stmt_idx"], got["explanation"]) for is_it, found in ((True, [got["responsible"]]), (False, got["others"])) for c in found]
    return spark.createDataFrame(rows, "responsible boolean, path string, cell_index int, stmt_idx int, explanation string")


@query(
    f"WITH {_OWN_FACTS} SELECT target, path, CAST(cell_index AS INT) AS cell_index, CASE target WHEN 'gold.fact_sales' THEN 'joined' ELSE {literal(responses.NO_LINEAGE)} END AS explanation"
    " FROM facts WHERE target IS NOT NULL AND len(list_filter(string_split(sources, ','), lambda x: string_split(x, '.')[-1] = 'orders')) > 0"
)
def explained_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = '{"explanations": [{"targetTable": "gold.fact_sales", "explanation": "joined"}, {"targetTable": "no.such", "explanation": "x"}]}'
    told = audit.explain_lineage(spark, "silver.orders", lineage.fan_out(corpus_of(spark, sf_dir), "silver.orders"), lambda messages: answer)
    return told.select("target", "path", "cell_index", "explanation")


@query(f"WITH {_OWN_FACTS} SELECT path, CAST(cell_index AS INT) AS cell_index, true AS is_correct, 'x' AS alerts FROM facts WHERE target = 'silver.orders'")
def validated_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = audit.validate_logic(spark, corpus_of(spark, sf_dir), "main", "silver", "orders", "only closed orders", lambda messages: '{"isCorrect": true, "alerts": ["x"]}')
    rows = [(c["path"], c["cell_index"], got["is_correct"], "|".join(got["alerts"])) for c in got["candidates"]]
    return spark.createDataFrame(rows, "path string, cell_index int, is_correct boolean, alerts string")


@query(ORACLE_SQL["level_code"].replace("source[1:4000] AS snippet", "'error' AS status"))
def reviewed_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = audit.analyse_level(spark, corpus_of(spark, sf_dir), "bronze", "silver", ["silver.stg_lineitem"], explainer=lambda messages: _REVIEWS[0])
    return spark.createDataFrame([(c["path"], c["cell_index"], got["status"]) for c in got["candidates"]], "path string, cell_index int, status string")


# What Spark's grammar lacks, and what it nests: a notebook of such statements for each supplier.
# Each: statement, target, sources, predicate, its WHEREs with the relation that each reads.
_NESTED = (
    ("WITH c AS (SELECT * FROM bronze.src_{m} WHERE amount > {n}) INSERT INTO silver.w_{k} SELECT * FROM c WHERE id > {k}", "silver.w_{k}", "bronze.src_{m}", "id > {k}", "bronze.src_{m}: id > {k}|bronze.src_{m}: amount > {n}"),
    ("INSERT INTO silver.d_{k} SELECT TOP 3 * FROM (SELECT * FROM bronze.src_{m} WHERE amount > {n}) q", "silver.d_{k}", "bronze.src_{m}", None, "bronze.src_{m}: amount > {n}"),
    ("INSERT INTO silver.e_{k} SELECT TOP 5 'a where b' AS t, z FROM [bronze].[src_{m}] WHERE z = 'x{n}' -- where 1 = 1", "silver.e_{k}", "bronze.src_{m}", "z = 'x{n}'", "bronze.src_{m}: z = 'x{n}'"),
    ("INSERT INTO silver.c_{k} SELECT * FROM bronze.src_{m} WHERE a > {n} ON CONFLICT DO NOTHING", "silver.c_{k}", "bronze.src_{m}", "a > {n}", "bronze.src_{m}: a > {n}"),
    ("INSERT INTO silver.u_{k} SELECT a FROM bronze.src_{m} WHERE a > {n} UNION ALL SELECT a FROM bronze.alt_{g} WHERE a < {k}", "silver.u_{k}", "bronze.src_{m},bronze.alt_{g}", "a > {n}", "bronze.src_{m}: a > {n}|bronze.alt_{g}: a < {k}"),
    ("UPDATE silver.v_{k} SET a = 1 WHERE b > {n}", "silver.v_{k}", "", "b > {n}", "silver.v_{k}: b > {n}"),
    ("INSERT INTO silver.j_{k} SELECT x.a FROM (SELECT * FROM bronze.src_{m} WHERE `odd name` > {n}) x JOIN bronze.alt_{g} y ON x.a = y.a WHERE x.a IN (SELECT a FROM gold.g_{g} WHERE b)", "silver.j_{k}", "bronze.src_{m},bronze.alt_{g},gold.g_{g}", "x.a IN (SELECT a FROM gold.g_{g} WHERE b)", "?: x.a IN (SELECT a FROM gold.g_{g} WHERE b)|bronze.src_{m}: `odd name` > {n}"),
    ("SELECT a INTO #t_{k} FROM dbo.[My Table] WITH (NOLOCK) WHERE offset > {n} AND CASE WHEN a THEN 1 END = 1 ORDER BY a", "#t_{k}", "dbo.my table", "offset > {n} AND CASE WHEN a THEN 1 END = 1", "dbo.my table: offset > {n} AND CASE WHEN a THEN 1 END = 1"),
)


def _made_of(spark: SparkSession, rows: DataFrame, path: str, text: str, order: str) -> DataFrame:
    """A notebook of SQL for each row, from expressions over its columns."""
    plain = lambda x: x.replace("VARCHAR(20)", "STRING")
    named = rows.select(F.col(order).cast("int").alias("nb_ord"), F.expr(plain(path)).alias("path"), F.expr(plain(text)).alias("source"))
    return named.select("nb_ord", "path", F.substring_index("path", "/", -1).alias("name"), F.lit("SQL").alias("language"), "source")


@query(
    " UNION ALL ".join(
        f"SELECT {_filled('/nested/n{k}')} AS path, {i} AS stmt_idx, {_filled(t)} AS target, {_filled(r)} AS sources, {'NULL' if p is None else _filled(p)} AS predicate, {_filled(f)} AS filters FROM supplier"
        for i, (_, t, r, p, f) in enumerate(_NESTED)
    )
)
def made_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made_of(spark, suppliers(spark, sf_dir), _filled("/nested/n{k}"), " || ';' || ".join(_filled(x[0] + chr(10)) for x in _NESTED).replace("\n", "\\n"), "s_suppkey")
    each = F.transform("filters", lambda x: F.concat_ws(": ", F.coalesce(x["source"], F.lit("?")), x["predicate"]))
    return lineage.lineage_facts(rows).select("path", "stmt_idx", "target", F.array_join("sources", ",").alias("sources"), "predicate", F.array_join(each, "|").alias("filters"))


# A table for each nation, written by two branches over a filtered common table expression; one table that is updated.
_BRANCHED = (
    "WITH c AS (SELECT * FROM bronze.orders WHERE o_custkey > {k}) INSERT INTO silver.a_{k} SELECT * FROM c WHERE o_totalprice > {k}000"
    " UNION ALL SELECT * FROM bronze.orders WHERE nullif(o_orderstatus, 'F') <> 'P' AND o_orderkey > {k};UPDATE silver.items SET l_tax = 0 WHERE l_quantity > {k} + 10"
)
_OF_NATION = lambda text: text.replace("s_suppkey", "n_nationkey")
_SCANS = (
    ("o_totalprice > n_nationkey * 1000", "o_totalprice > {k}000"), ("o_custkey > n_nationkey", "o_custkey > {k}"),
    ("nullif(o_orderstatus, 'F') <> 'P' AND o_orderkey > n_nationkey", "nullif(o_orderstatus, 'F') <> 'P' AND o_orderkey > {k}"),
)


@query(
    " UNION ALL ".join(
        f"SELECT {_OF_NATION(_filled('a_{k}'))} AS \"table\", {i} AS scan, {_OF_NATION(_filled(p))} AS predicate_sql, 'bronze.orders' AS source_table, count(*) FILTER (WHERE NOT ({q})) AS excluded_count, count(*) FILTER (WHERE ({q}) IS NULL) AS null_count FROM nation, orders GROUP BY n_nationkey"
        for i, (q, p) in enumerate(_SCANS)
    )
    + " UNION ALL SELECT 'items', 0, 'l_quantity > 0 + 10', 'silver.items', count(*) FILTER (WHERE NOT l_quantity > 10), count(*) FILTER (WHERE l_quantity IS NULL) FROM lineitem"
)
def branch_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items, nations = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem", "nation"))
    keys = sorted(r[0] for r in nations.select("n_nationkey").collect())  # names of tables
    layers = [Layer("bronze", "bronze", [Table("orders", orders)]), Layer("silver", "silver", [*(Table(f"a_{k}", orders) for k in keys), Table("items", items)])]
    code = _made_of(spark, nations, _OF_NATION(_filled("/branched/n{k}")), _OF_NATION(_filled(_BRANCHED)), "n_nationkey")
    return exclusions.scan_rules(spark, layers, lineage.lineage_facts(code)).select("table", "scan", "predicate_sql", "source_table", "excluded_count", "null_count")


@query(f"WITH {_COUNTS} SELECT label, tbl AS \"table\", n AS row_count FROM counts")
def measured_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_counts once more, with the exclusion rules' scans: footers, one scan for a table with rules, one job for the rest."""
    facts = lineage.lineage_facts(corpus_of(spark, sf_dir))
    return measures.rules_and_counts(spark, fixtures.layers(spark, sf_dir), facts)[1].select("label", "table", "row_count")


# Code that writes real tables, a notebook for each supplier: which of it stands behind each difference in row counts?
_CULPRITS = ("INSERT INTO silver.orders SELECT * FROM bronze.orders WHERE o_custkey > {k}", "INSERT INTO gold.events SELECT * FROM silver.stg_lineitem WHERE l_tax > {n}", "INSERT INTO silver.nothing SELECT * FROM bronze.other_{m}")
_NAMED = ("orders", "events")


@query(
    f"WITH {_COUNTS}, d AS (SELECT DISTINCT a.tbl FROM counts a JOIN counts b ON a.tbl = b.tbl AND b.layer_ord = a.layer_ord + 1 WHERE a.n <> b.n)"
    + " UNION ALL ".join(f" SELECT d.tbl AS table_name, {_filled('/culprits/n{k}')} AS path, {i} AS stmt_idx, {_filled(c)} AS snippet FROM supplier, d WHERE d.tbl = '{t}'" for i, (t, c) in enumerate(zip(_NAMED, _CULPRITS)))
)
def mismatch_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    differing = counts.compare_stages(spark, fixtures.layers(spark, sf_dir))
    code = _made_of(spark, suppliers(spark, sf_dir), _filled("/culprits/n{k}"), " || ';' || ".join(map(_filled, _CULPRITS)), "s_suppkey")
    return search.responsible_for(code, differing).select("table_name", "path", "stmt_idx", "snippet")


@query(
    f"WITH {_MADE_CELLS}, code AS (SELECT g AS step, made_cells.*, contains(source, 'g_' || g) AS hit FROM made_cells, range(5) r(g) WHERE language <> 'md'), w AS (SELECT *, max(hit) OVER (PARTITION BY step, path) AS any_hit FROM code),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY k, cell_index) AS n FROM w WHERE hit OR NOT any_hit)"
    " SELECT 'to g_' || step AS step, path, CAST(cell_index AS INT) AS cell_index, source AS snippet FROM r WHERE n <= 40"
)
def made_level_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of five steps in one pass; 40 snippets of each are the report's length."""
    return search.level_codes(_made(spark, sf_dir), {f"to g_{g}": [f"gold.g_{g}"] for g in range(5)}).select("step", "path", "cell_index", "snippet")


# A folder of files of every kind for each nation; what are notebooks, and which cells have they?
_FILES = (
    ("a/n{k}.py", "# Databricks notebook source\nx = {k}\n# COMMAND ----------\n# MAGIC %sql\n# MAGIC SELECT {k}"),
    ("a/n{k}.sql", "-- Databricks notebook source\nSELECT {k};\n-- COMMAND ----------\n-- MAGIC %md\n-- MAGIC # Step {k}"),
    ("b/c/n{k}.ipynb", '{"cells": [{"cell_type": "markdown", "source": ["# Step {k}\\n", "more"]}, {"cell_type": "code", "source": "%sql\\nSELECT {k}"}, {"cell_type": "raw", "source": "r"}, {"cell_type": "code", "source": ["y = [{k}]\\n", "z"]}], "metadata": {"language_info": {"name": "python"}}}'),
    ("b/broken{k}.ipynb", "not json {k}"),
    ("b/n{k}.txt", "SELECT {k}"),
)
_FOUND_CELLS = (
    ("n{k}.py", 0, "python", "x = {k}"), ("n{k}.py", 1, "sql", "SELECT {k}"), ("n{k}.sql", 0, "sql", "SELECT {k};"), ("n{k}.sql", 1, "md", "# Step {k}"),
    ("n{k}.ipynb", 0, "md", "# Step {k}\nmore"), ("n{k}.ipynb", 1, "sql", "SELECT {k}"), ("n{k}.ipynb", 2, "python", "y = [{k}]\nz"),
)


@query(" UNION ALL ".join(f"SELECT {_OF_NATION(_filled(n))} AS name, CAST({i} AS INT) AS cell_index, '{x}' AS language, {_OF_NATION(_filled(t))} AS source FROM nation" for n, i, x, t in _FOUND_CELLS))
def notebook_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_path(spark, "notebook-files")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for (k,) in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").collect():  # the files to be read: 25 nations'
        for name, text in _FILES:
            stream = files.create(path(f"{root}/{name.replace('{k}', str(k))}"))
            stream.write(bytearray(text.replace("{k}", str(k)).encode()))
            stream.close()
    return cells(read_notebooks(spark, root)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "cell_index", "language", "source")


# Every difference with the code behind it and the question about it; an explainer that points at the second candidate of `orders`.
_ASKED = "'Difference:' || chr(10) || d.j || chr(10) || chr(10) || 'Candidates:' || chr(10) || coalesce(c.code, 'No code was found.')"
_PICKS = "CASE WHEN d.table_name = 'orders' THEN c.paths[2] END"


@query(
    f"WITH {_COUNTS}, d AS (SELECT a.tbl AS table_name, a.label AS from_stage, b.label AS to_stage, '{{\"table_name\":\"' || a.tbl || '\",\"from_stage\":\"' || a.label || '\",\"to_stage\":\"' || b.label || '\",\"from_count\":' || a.n || ',\"to_count\":' || b.n || ',\"difference\":' || (b.n - a.n) || '}}' AS j"
    " FROM counts a JOIN counts b ON a.tbl = b.tbl AND b.layer_ord = a.layer_ord + 1 WHERE a.n <> b.n),"
    " s AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, s_suppkey AS k, {_filled('/culprits/n{k}')} AS path, {_filled(c)} AS snippet FROM supplier" for t, c in zip(_NAMED, _CULPRITS)) + "),"
    " n AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY k) AS n FROM s),"
    " c AS (SELECT table_name, string_agg('[' || (n - 1) || '] ' || path || ', cell 0' || chr(10) || '<code>' || chr(10) || snippet || chr(10) || '</code>', chr(10) ORDER BY n) FILTER (WHERE n <= 40) AS code, list(path ORDER BY n) AS paths, count(*) AS n FROM n GROUP BY table_name)"
    f" SELECT d.table_name, d.from_stage, sha256({_ASKED}) AS prompt_hash, coalesce(c.n, 0) AS n_candidates, {_PICKS} AS responsible, CASE d.table_name WHEN 'orders' THEN 'why' END AS explanation FROM d LEFT JOIN c USING (table_name)"
)
def explained_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    def explainer(messages: list[dict[str, str]]) -> str:
        if '"table_name":"orders"' not in messages[1]["content"]:
            raise RuntimeError("no answer")
        return '{"responsibleIndex": 1, "explanation": "why"}'

    code = _made_of(spark, suppliers(spark, sf_dir), _filled("/culprits/n{k}"), " || ';' || ".join(map(_filled, _CULPRITS)), "s_suppkey")
    differing = counts.compare_stages(spark, fixtures.layers(spark, sf_dir))
    found = explained.explained_mismatches(code, differing, explainer, Snapshots(spark, fresh_path(spark, "explained")))
    return found.select("table_name", "from_stage", "prompt_hash", "n_candidates", F.col("responsible.path").alias("responsible"), "explanation")


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE 'layer ' || s_suppkey END AS label, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 's' END AS \"schema\" FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0")
def complete_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    label = F.when(F.col("k") % 3 == 0, " ").otherwise(F.concat(F.lit("layer "), F.col("k").cast("string")))
    return catalog.complete_layers(rows.withColumn("label", label).withColumn("schema", F.when(F.col("k") % 5 == 0, "").otherwise("s")))


_ALL_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(f"SELECT table_name AS \"table\", string_agg(column_name, ',' ORDER BY ordinal_position) AS columns FROM information_schema.columns WHERE table_name IN {_ALL_TABLES} GROUP BY table_name")
def columns_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = Layer("all", "all", [catalog.parquet_table(spark, t, f"{sf_dir}/{t}.parquet") for t in _ALL_TABLES])
    return inventory(spark, [layer]).select("table", F.array_join("columns.name", ",").alias("columns"))


@query("SELECT row_number() OVER (ORDER BY name) - 1 AS place, name AS base_key, '/x/' || name || '|/x/' || name || '_v2' AS paths FROM (SELECT replace(lower(n_name), '_', 'x') AS name FROM nation)")
def group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in the order that people sort by."""
    both = F.array(F.struct(F.lit(0).alias("v"), F.lit("").alias("mark")), F.struct(F.lit(1).alias("v"), F.lit("_v2").alias("mark")))
    named = F.replace(F.lower("n_name"), F.lit("_"), F.lit("x")).alias("n")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", named, F.inline(both))
    rows = rows.select((F.col("n_nationkey") * 2 + F.col("v")).alias("nb_ord"), F.concat("n", "mark").alias("name"), F.concat(F.lit("/x/"), "n", "mark").alias("path"))
    groups = drift.notebook_groups(rows)
    return placed(groups.select("base_key", F.array_join("paths", "|").alias("paths")), F.expr("base_key COLLATE UNICODE"))


_N_FACTS = ("load_orders", 2, 2), ("load_orders_v2", 2, 2), ("load_orders_final", 3, 0), ("build_sales", 4, 1), ("df_api", 0, 1), ("udfs", 0, 4), ("quirks", 4, 0)


@query(f"SELECT '/s' || k || '/etl/' || path AS path, CAST(n_sql AS BIGINT) AS n_sql, CAST(n_defs AS BIGINT) AS n_defs FROM {supplied(_N_FACTS, 'path', 'n_sql', 'n_defs')}")
def facts_of_notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements and definitions of every notebook that has any."""
    books = corpus_of(spark, sf_dir)
    one = lambda df, a, b: df.select("path", F.lit(a).alias("n_sql"), F.lit(b).alias("n_defs"))
    both = one(sqlfacts.sql_facts(books), 1, 0).unionByName(one(codedefs.code_defs(books), 0, 1))
    return both.groupBy("path").agg(F.sum("n_sql").alias("n_sql"), F.sum("n_defs").alias("n_defs"))


@query("SELECT 1 AS version, count(*) AS n FROM orders UNION ALL SELECT 2, count(*) FILTER (WHERE o_orderstatus <> 'P') FROM orders")
def kept_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result that is replaced: both versions, as a reader of either sees them."""
    shelf, orders = Snapshots(spark, fresh_path(spark, "shelf")), spark.read.parquet(f"{sf_dir}/orders.parquet")
    found = [shelf.read("orders", shelf.publish(x, "orders")) for x in (orders, orders.where("o_orderstatus <> 'P'"))]
    each = [x.groupBy().agg(F.count("*").alias("n")).select(F.lit(i + 1).alias("version"), "n") for i, x in enumerate(found)]
    return each[0].unionAll(each[1])
