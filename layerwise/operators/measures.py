"""Row counts and exclusion rules of a whole pipeline, each table read once at most."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import Layer
from . import counts
from .exclusions import profiled, rule_rows, rules_frame, sources_of
from .pool import WORKERS, each

_FOOTERS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


@contextmanager
def _footers(spark: SparkSession):
    """Parquet files are read so that counts of rows come from their footers."""
    before = {k: spark.conf.get(k) for k in _FOOTERS}
    try:
        for k, v in _FOOTERS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def footer_plan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(at, n) of each path's Parquet files; to be run under _footers."""
    rows = [spark.read.parquet(p).groupBy().agg(F.count("*").alias("n")).select(F.lit(i).alias("at"), "n") for i, p in enumerate(paths)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out


def footer_counts(spark: SparkSession, paths: list[str], batch: int = 64) -> list[int]:
    """The rows of Parquet tables, of which only footers are read."""
    out: list[int] = []
    with _footers(spark):
        for i in range(0, len(paths), batch):
            out += [r.n for r in sorted(footer_plan(spark, paths[i : i + batch]).collect())]  # a row a table
    return out


def rules_and_counts(
    spark: SparkSession, layers: list[Layer], facts: DataFrame, first_counted: int = 0, qualified: bool = False, workers: int = WORKERS
) -> tuple[DataFrame, DataFrame]:
    """(exclusion rules, counts of the tables from layer `first_counted` on; see exclusions.SCHEMA and counts.SCHEMA).

    A table that rules are counted on is scanned once for its rows and all of the rules; a plain Parquet table
    without rules only has its footers read; the rest are counted in one job.
    """
    rules = rule_rows(spark, layers, facts)
    by_source = sources_of(layers, rules, qualified)
    places = [(i, j, x, t) for i, x in enumerate(layers) for j, t in enumerate(x.tables)]
    wanted = {(x.schema, t.name): t for i, _, x, t in places if i >= first_counted or (x.schema, t.name) in by_source}
    keys = list(by_source)
    got = each([lambda k=k: profiled(wanted[k].df, [rules[i].predicate_sql for i in by_source[k]]) for k in keys], workers)
    sizes = {k: n for k, (n, _) in zip(keys, got, strict=True)}
    found = {i: x for k, (_, of) in zip(keys, got, strict=True) for i, x in zip(by_source[k], of, strict=True) if x}
    plain = [(k, t.path) for k, t in wanted.items() if k not in sizes and t.path]
    sizes |= dict(zip([k for k, _ in plain], footer_counts(spark, [p for _, p in plain]) if plain else [], strict=True))
    rest = [Layer(x.label, x.schema, [t for t in x.tables if i >= first_counted and (x.schema, t.name) not in sizes]) for i, x in enumerate(layers)]
    if any(x.tables for x in rest):
        sizes |= {(r.schema, r.table): r.row_count for r in counts.table_counts(spark, rest).collect()}  # a row a table
    rows = [(i, x.label, x.schema, j, t.name, sizes[x.schema, t.name]) for i, j, x, t in places if i >= first_counted]
    return rules_frame(spark, rules, found), spark.createDataFrame(rows, counts.SCHEMA)
