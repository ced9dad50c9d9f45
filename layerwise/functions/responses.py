"""Answers of an explaining model, read into columns.

An answer is JSON, perhaps in a code fence; whatever isn't as asked for gets a defined value. Types are
checked on VARIANT, as a cast would turn numbers and booleans into strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import trimmed

# Fixed values.
NO_LINEAGE = "The model did not return an explanation for this target table."
NO_RULE = "The model did not return an explanation for this rule."
STATUSES = ("ok", "warning", "error")
SEVERITIES = ("info", "warning", "error")
TEXT, NUMBER = "STRING", r"^(BIGINT|DOUBLE|DECIMAL.*|INT|SMALLINT|TINYINT|FLOAT)\z"


def unfenced(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(trimmed(raw), r"(?i)^```(?:json)?\s*", ""), r"```\s*\z", "")


def _variant(raw: Column) -> Column:
    """Null for malformed text, and for the JSON null as well."""
    v = F.try_parse_json(unfenced(raw))
    return F.when(~F.is_variant_null(v), v)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column, path: str) -> Column:
    got = F.try_variant_get(v, path, "variant")
    return F.when(_kind(got) == TEXT, F.try_variant_get(v, path, "string"))


def _number(v: Column, path: str) -> Column:
    got = F.try_variant_get(v, path, "variant")
    return F.when(_kind(got).rlike(NUMBER), F.try_variant_get(v, path, "double"))


def _items(v: Column, path: str) -> Column:
    """The elements of an array, as variants; none if it isn't one."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _texts(v: Column, path: str) -> Column:
    return F.transform(F.filter(_items(v, path), lambda x: _kind(x) == TEXT), lambda x: F.try_variant_get(x, "$", "string"))


def analysis(raw: Column, n: Column) -> Column:
    """struct(responsible_index, explanation): an index from 0 to n - 1 or null."""
    v = _variant(raw)
    i = _number(v, "$.responsibleIndex")
    whole = F.when((i > -1) & (i < n), i.cast("int"))
    return F.struct(whole.alias("responsible_index"), F.coalesce(_text(v, "$.explanation"), unfenced(raw)).alias("explanation"))


def validation(raw: Column) -> Column:
    """struct(is_correct, alerts, explanation): only a JSON true is correct, only strings are alerts."""
    v = _variant(raw)
    flag = F.try_variant_get(v, "$.isCorrect", "variant")
    ok = F.coalesce(F.when(_kind(flag) == "BOOLEAN", F.try_variant_get(v, "$.isCorrect", "boolean")), F.lit(False))
    return F.struct(ok.alias("is_correct"), _texts(v, "$.alerts").alias("alerts"), F.coalesce(_text(v, "$.explanation"), unfenced(raw)).alias("explanation"))


def level(raw: Column) -> Column:
    """struct(status, summary, reconciliation_alerts, findings: array<struct<severity, message, table>>)."""
    v = _variant(raw)
    status = _text(v, "$.status")
    findings = F.filter(_items(v, "$.findings"), lambda x: _text(x, "$.message").isNotNull())

    def finding(x: Column) -> Column:
        severity, table = _text(x, "$.severity"), _text(x, "$.table")
        return F.struct(
            F.when(severity.isin(*SEVERITIES), severity).otherwise("info").alias("severity"),
            _text(x, "$.message").alias("message"),
            F.when(trimmed(table) != "", table).alias("table"),
        )

    return F.struct(
        F.when(status.isin(*STATUSES), status).otherwise("warning").alias("status"),
        F.coalesce(_text(v, "$.summary"), unfenced(raw)).alias("summary"),
        _texts(v, "$.reconciliationAlerts").alias("reconciliation_alerts"),
        F.transform(findings, finding).alias("findings"),
    )


def narrative(raw: Column) -> Column:
    """struct(overview, architecture, how_it_works, onboarding_tips)."""
    v = _variant(raw)
    text = lambda path, alias: F.coalesce(_text(v, path), F.lit("")).alias(alias)
    return F.struct(
        F.coalesce(_text(v, "$.overview"), unfenced(raw)).alias("overview"),
        text("$.architecture", "architecture"),
        text("$.howItWorks", "how_it_works"),
        _texts(v, "$.onboardingTips").alias("onboarding_tips"),
    )


def _entries(answers: DataFrame, test) -> DataFrame:
    """The valid entries of each answer's `explanations`, with their places."""
    v = _variant(F.col("raw"))
    kept = F.filter(F.transform(_items(v, "$.explanations"), lambda x, i: F.struct(i.alias("at"), x.alias("v"))), lambda s: test(s["v"]))
    return answers.withColumn("_good", v.isNotNull()).withColumn("_entries", kept)


def lineage(answers: DataFrame) -> DataFrame:
    """answers(raw, targets array<string>, ...) -> with explanations, array<struct<target, explanation>>.

    Of several entries for a target the last counts; a target without one gets a fixed sentence; an answer
    that can't be read explains every target with its own text.
    """
    rows = _entries(answers, lambda x: _text(x, "$.targetTable").isNotNull() & _text(x, "$.explanation").isNotNull())

    def one(target: Column) -> Column:
        mine = F.filter("_entries", lambda s: _text(s["v"], "$.targetTable") == target)
        last = F.when(F.size(mine) > 0, _text(F.element_at(mine, -1)["v"], "$.explanation"))
        said = F.when(F.col("_good"), F.coalesce(last, F.lit(NO_LINEAGE))).otherwise(unfenced(F.col("raw")))
        return F.struct(target.alias("target"), said.alias("explanation"))

    return rows.withColumn("explanations", F.transform("targets", one)).drop("_good", "_entries")


def exclusions(answers: DataFrame) -> DataFrame:
    """answers(raw, n, ...) -> with explanations, array<struct<index, explanation, severity>> of n entries.

    The severity is `warning` only if the entry says so; a rule without an entry gets a fixed sentence and
    `warning`; an answer without any valid entry gives its own text and `warning` to all.
    """
    rows = _entries(answers, lambda x: _number(x, "$.index").isNotNull() & _text(x, "$.explanation").isNotNull())
    usable = F.col("_good") & (F.size("_entries") > 0)

    def one(i: Column) -> Column:
        mine = F.filter("_entries", lambda s: _number(s["v"], "$.index").cast("int") == i)
        last = F.when(F.size(mine) > 0, F.element_at(mine, -1)["v"])
        told = F.when(_text(last, "$.severity") == "warning", "warning").otherwise("ok")
        said = F.when(usable, F.coalesce(_text(last, "$.explanation"), F.lit(NO_RULE))).otherwise(unfenced(F.col("raw")))
        return F.struct(i.cast("int").alias("index"), said.alias("explanation"), F.when(usable & last.isNotNull(), told).otherwise("warning").alias("severity"))

    every = F.when(F.col("n") > 0, F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("explanations", F.transform(every, one)).drop("_good", "_entries")
