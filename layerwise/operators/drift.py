"""Versions of one notebook: which belong together, and where their logic differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import notebook_key, slug, snippet
from .codedefs import code_defs
from .sqlfacts import sql_facts


def notebook_groups(notebooks: DataFrame) -> DataFrame:
    """(id, base_key, paths): notebooks with one name but for version marks, in their order; ids may collide."""
    keyed = notebooks.withColumn("base_key", notebook_key(F.col("name")))
    groups = keyed.groupBy("base_key").agg(F.sort_array(F.collect_list(F.struct("nb_ord", "path"))).alias("p"))
    return groups.select(slug(F.col("base_key")).alias("id"), "base_key", F.col("p.path").alias("paths")).orderBy(F.expr("base_key COLLATE UNICODE"))


def chosen_groups(groups: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """The groups asked for, or all; asking for none that exists is an error."""
    out = groups if ids is None else groups.where(F.col("id").isin(ids))
    if out.isEmpty():
        raise ValueError("no notebook group matches")
    return out


def _in_groups(facts: DataFrame, groups: DataFrame, notebooks: DataFrame) -> DataFrame:
    """facts of grouped notebooks with `seq`, their order in the group; groups of one notebook are left out."""
    members = groups.select("id", "base_key", F.posexplode("paths").alias("member", "path")).join(notebooks.select("path", "nb_ord"), "path")
    members = members.withColumn("n", F.size(F.collect_set("path").over(Window.partitionBy("id", "base_key")))).where("n >= 2")
    return facts.join(members.select("id", "base_key", "member", "path"), "path")


def _pairs(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (a, b) of facts with equal keys, from different notebooks and with different normal forms, left one first.

    What meets in the join are places and 128 bits of each normal form, no texts: see _told.
    """
    slim = facts.select("id", "base_key", "seq", "path", "cell_index", *[k for k in keys if k not in ("id", "base_key")], *(["kind"] if "kind" in facts.columns else []), F.md5("normal").alias("form"))
    rows = slim.withColumn("key_seq", F.min("seq").over(Window.partitionBy(*keys)))
    a, b = rows.alias("a"), rows.alias("b")
    test = (F.col("a.seq") < F.col("b.seq")) & (F.col("a.path") != F.col("b.path")) & (F.col("a.form") != F.col("b.form"))
    for k in keys:
        test = test & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, test)


def _at(s: str) -> Column:
    return F.format_string("%s (cell %d)", F.col(f"{s}.path"), F.col(f"{s}.cell_index"))


def _told(pairs: DataFrame, facts: DataFrame, raw: str) -> DataFrame:
    """Pairs with left and right: each side's place and snippet, looked up after the pairing."""
    sides = facts.select("id", "base_key", "seq", F.struct("path", "cell_index", snippet(F.col(raw)).alias("snippet")).alias("side")).dropDuplicates(["id", "base_key", "seq"])
    for s in ("left", "right"):
        own = sides.select(F.col("id").alias("group_id"), "base_key", F.col("seq").alias(f"{s}_seq"), F.col("side").alias(s))
        pairs = pairs.join(own, ["group_id", "base_key", f"{s}_seq"])
    return pairs


def sql_drift(notebooks: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, group_id, type, key, description, left, right) of statements that differ.

    First statements of one name, every pair of them; then statements over one set of tables, each pair of
    cells once and only if no pair before has it.
    """
    facts = _in_groups(sql_facts(notebooks), groups, notebooks).withColumn("seq", F.struct("member", "cell_index", "stmt_idx"))
    facts = facts.withColumn("table_key", F.when(F.size("tables") > 0, F.array_join(F.array_sort("tables"), ",")))
    take = lambda pairs, n, key, text: pairs.select(
        F.col("a.id").alias("group_id"), F.col("a.base_key").alias("base_key"), F.lit(n).alias("pass"), F.col("a.key_seq").alias("key_seq"), F.col("a.seq").alias("left_seq"), F.col("b.seq").alias("right_seq"),
        F.col(f"a.{key}").alias("key"), F.format_string(text, F.col(f"a.{key}"), _at("a"), _at("b")).alias("description"),
        F.col("a.path").alias("lp"), F.col("a.cell_index").alias("lc"), F.col("b.path").alias("rp"), F.col("b.cell_index").alias("rc"),
    )
    named = take(_pairs(facts, ["id", "base_key", "metric_name"]), 1, "metric_name", 'The SQL named "%s" is not the same in %s and %s.')
    tables = take(_pairs(facts.where(F.col("table_key").isNotNull()), ["id", "base_key", "table_key"]), 2, "table_key", 'Statements over "%s" are not the same in %s and %s.')
    pair = ["base_key", "group_id", "lp", "lc", "rp", "rc"]
    once = Window.partitionBy(*pair).orderBy("key_seq", "left_seq", "right_seq")
    fresh = tables.join(named.select(*pair).distinct(), pair, "left_anti").withColumn("n", F.row_number().over(once)).where("n = 1")
    return _numbered(_told(named.unionByName(fresh.select(*named.columns)), facts, "raw_sql"), "sql", "sql-logic-mismatch")


def code_drift(notebooks: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, group_id, type, key, description, left, right) of definitions of one name that differ, of whatever kind."""
    defs = _in_groups(code_defs(notebooks), groups, notebooks).withColumn("seq", F.struct("member", "cell_index", "def_idx"))
    pairs = _pairs(defs, ["id", "base_key", "name"])
    kind = F.when(F.col("a.kind") == "function", "Function").otherwise("Variable")
    rows = pairs.select(
        F.col("a.id").alias("group_id"), F.col("a.base_key").alias("base_key"), F.lit(1).alias("pass"), F.col("a.key_seq").alias("key_seq"), F.col("a.seq").alias("left_seq"), F.col("b.seq").alias("right_seq"),
        F.col("a.name").alias("key"), F.format_string('%s "%s" has different definitions in %s and %s.', kind, F.col("a.name"), _at("a"), _at("b")).alias("description"),
    )
    return _numbered(_told(rows, defs, "raw"), "code", "code-def-mismatch")


def _numbered(rows: DataFrame, part: str, kind: str) -> DataFrame:
    order = Window.partitionBy("group_id", "base_key").orderBy("pass", "key_seq", "left_seq", "right_seq")
    number = F.row_number().over(order).cast("string")
    return rows.select(F.concat_ws("-", "group_id", F.lit(part), number).alias("id"), "group_id", F.lit(kind).alias("type"), "key", "description", "left", "right")
