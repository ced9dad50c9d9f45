"""The whole audit of a pipeline, and explanations of its parts by a pluggable model.

An explainer takes messages and returns text; it runs on the driver only and is off by default. Without
one, or if it fails, analyses and summaries are returned unexplained; what is nothing but an explanation raises.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts, responses
from ..sources.catalog import Layer, inventory, table_index
from ..sources.shared import written
from . import counts, exclusions, lineage, measures, search, summary

Explainer = Callable[[list[dict[str, str]]], str]


class ExplainerMissing(RuntimeError):
    """An explanation is asked for and there is no explainer."""


def _needed(explainer: Explainer | None) -> Explainer:
    if explainer is None:
        raise ExplainerMissing("no explainer is configured")
    return explainer


def _dicts(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]  # results about code and tables, not data


def _answer(spark: SparkSession, raw: str, n: int = 0, targets: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame([(raw, n, targets or [])], "raw string, n int, targets array<string>")


@dataclass
class Analysis:
    rules: DataFrame
    totals: DataFrame
    lineage: DataFrame


def analyse(spark: SparkSession, layers: list[Layer], notebooks: DataFrame, explainer: Explainer | None = None) -> Analysis:
    """Exclusion rules with live counts, strict totals of the layers after the first, and the lineage graph."""
    if not layers:
        raise ValueError("at least one layer is needed")
    facts = written(lineage.lineage_facts(notebooks), "facts")  # both the rules and the graph read it
    graph = lineage.edges(facts, table_index(inventory(spark, layers)))
    rules, found = measures.rules_and_counts(spark, layers, facts, first_counted=1)
    totals = counts.layer_totals(spark, layers, found, strict=True).where("layer_ord > 0")
    if explainer is not None:
        rules = explained_rules(spark, rules, explainer)
    return Analysis(rules, totals, graph)


def explained_rules(spark: SparkSession, rules: DataFrame, explainer: Explainer) -> DataFrame:
    """The rules with the explainer's words and severities, matched by their order; unchanged if it fails."""
    rows = _dicts(rules.orderBy("layer_ord", "tbl_ord"))
    if not rows:
        return rules
    try:
        raw = explainer(prompts.exclusions(rows))
    except Exception:  # an explainer is foreign code; the rules stand without it
        return rules
    said = responses.exclusions(_answer(spark, raw, len(rows))).first().explanations
    return spark.createDataFrame([{**r, "explanation": s.explanation, "severity": s.severity} for r, s in zip(rows, said)], exclusions.SCHEMA)


@dataclass
class Summary:
    tables: DataFrame
    totals: DataFrame
    stats: DataFrame
    lineage: DataFrame
    narrative: dict | None


def summarise(spark: SparkSession, layers: list[Layer], notebooks: DataFrame, explainer: Explainer | None = None) -> Summary:
    """Tables with kinds and best-effort counts, null-skipping totals, figures, lineage, and perhaps a narrative."""
    if not layers:
        raise ValueError("at least one layer is needed")
    tables = written(summary.table_infos(spark, layers), "tables")
    graph = lineage.edges(lineage.lineage_facts(notebooks), table_index(inventory(spark, layers)))
    graph = written(graph, "lineage")
    stats = summary.project_stats(tables, graph, len(layers))
    told = None
    if explainer is not None:
        try:
            raw = explainer(prompts.narrative(_dicts(stats)[0], _dicts(tables), _dicts(graph.select("source", "target"))))
            told = _answer(spark, raw).select(responses.narrative(F.col("raw")).alias("a")).first().a.asDict()
        except Exception:  # as in explained_rules
            told = None
    return Summary(tables, counts.layer_totals(spark, layers, tables, strict=False), stats, graph, told)


def analyse_mismatch(spark: SparkSession, notebooks: DataFrame, mismatch: dict, explainer: Explainer | None = None) -> dict:
    """The code responsible for a stage mismatch, the other candidates, and why."""
    ask = _needed(explainer)
    found = _dicts(search.responsible_code(notebooks, mismatch["table_name"]).orderBy("nb_ord", "cell_index", "stmt_idx"))
    raw = ask(prompts.analysis(mismatch, found))
    got = _answer(spark, raw, len(found)).select(responses.analysis(F.col("raw"), F.col("n")).alias("a")).first().a
    at = got.responsible_index
    return {"mismatch": mismatch, "responsible": None if at is None else found[at], "others": [c for i, c in enumerate(found) if i != at], "explanation": got.explanation}


def explain_lineage(spark: SparkSession, source: str, transformations: DataFrame, explainer: Explainer | None = None) -> DataFrame:
    """transformations(target, ..., explanation?) with explanations by target; one without keeps what it had."""
    found, targets = written(transformations, "transformations"), {}

    def each():
        for r in found.toLocalIterator():  # of all rows, the driver holds the question's text only
            targets[r.target] = None
            yield r.asDict(recursive=True)

    question = prompts.lineage(source, each())
    if not targets:
        return found
    said = _answer(spark, _needed(explainer)(question), 0, list(targets))
    said = responses.lineage(said).select(F.explode("explanations").alias("e")).select(F.col("e.target").alias("target"), F.col("e.explanation").alias("_said"))
    had = F.col("explanation") if "explanation" in found.columns else F.lit(None).cast("string")
    return found.join(said, "target", "left").withColumn("explanation", F.coalesce("_said", had)).drop("_said")


def validate_logic(spark: SparkSession, notebooks: DataFrame, catalog: str, schema: str, table: str, rule: str, explainer: Explainer | None = None) -> dict:
    """Whether the code that writes a table follows a rule; with the code. It is asked about whole: a rule may be kept or broken at a statement's end."""
    ask = _needed(explainer)
    found = _dicts(lineage.writers(notebooks, catalog, schema, table, whole=True).orderBy("nb_ord", "cell_index", "stmt_idx"))
    raw = ask(prompts.validation(f"{catalog}.{schema}.{table}", rule, found))
    got = _answer(spark, raw).select(responses.validation(F.col("raw")).alias("a")).first().a
    return {**got.asDict(), "candidates": found}


def analyse_level(spark: SparkSession, notebooks: DataFrame, source: str, target: str, tables: list[str], context: str = "", explainer: Explainer | None = None) -> dict:
    """A review of the step between two layers; with the code it is about."""
    ask = _needed(explainer)
    found = _dicts(search.level_code(notebooks, tables))
    if not found:
        raise ValueError("no code to review")
    got = _answer(spark, ask(prompts.level(source, target, tables, context, found))).select(responses.level(F.col("raw")).alias("a")).first().a
    return {**got.asDict(recursive=True), "candidates": found}
