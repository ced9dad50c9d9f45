"""Column functions on names, paths, SQL text and code. Lengths and cuts are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File endings, version marks and name patterns that results depend on.
EXTENSION = r"(?i)\.(py|sql|scala|r|ipynb)\z"
VERSIONS = r"(?is)^(.+?)(?:[_\-](?:v\d+|version\d+|final|draft|copy|old|new|backup|bak|wip|\d+)|\(\d+\))+\z"
CREATE_VIEW = r"(?i)create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?view\s+([a-zA-Z0-9_.`]+)"
ON_EQUALITY = r"(?i)\bon\s+([\w.`]+)\s*=\s*([\w.`]+)"
WHERE_EQUALITY = r"(?is)\bwhere\b.*?\b(\w+\.\w+)\s*=\s*(\w+\.\w+)"
WHERE_SPAN = r"(?is)\bwhere\b(.*?)(?:\bgroup\s+by\b|\border\s+by\b|\bqualify\b|\blimit\b|\z)"
MERGE_TARGET = r"(?i)merge\s+into\s+([a-zA-Z0-9_.`]+)"
CTAS_TARGET = r"(?i)create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?([a-zA-Z0-9_.`]+)\s+as\s+select"
INSERT_TARGET = r"(?i)insert\s+(?:overwrite\s+)?(?:into\s+)?(?:table\s+)?([a-zA-Z0-9_.`]+)"
SOURCES = r"(?i)\b(?:from|join|using)\s+([a-zA-Z0-9_.`]+)"
TABLES = r"\b(?:from|join)\s+([a-zA-Z0-9_.]+)"
KINDS = (
    ("fact", r"^(fact|fct|f)_|_fact|_facts\z"),
    ("dimension", r"^(dim|dm|d)_|_dim|_dimension\z"),
    ("bridge", r"^(bridge|br|map|xref|link)_|bridge|_map"),
    ("staging", r"^(stg|stage|staging|tmp|temp|wrk|work)_|^stg"),
)
STAGING_LAYER = r"\b(raw|bronze|stag)"
LAYERS = (
    ("bronze", ("bronze", "raw", "landing", "ingest", "source")),
    ("silver", ("silver", "staging", "stage", "clean", "refined", "conformed")),
    ("gold", ("gold", "curated", "mart", "presentation", "serving", "reporting", "analytics")),
)

SNIPPET, LEVEL_SNIPPET, LABEL = 400, 4000, 70
MISSING = "(unknown)"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^[\s﻿]+|[\s﻿]+\z", "")


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def notebook_key(name: Column) -> Column:
    """A notebook's name without ending, version marks, case and runs of separators."""
    base = F.regexp_replace(trimmed(name), EXTENSION, "")
    base = F.regexp_replace(base, VERSIONS, "$1")
    return F.regexp_replace(F.regexp_replace(F.lower(base), r"(?U)[\s_\-]+", "_"), r"^_+|_+\z", "")


def slug(key: Column, joint: str = "-", empty: str | None = "group") -> Column:
    out = F.regexp_replace(F.regexp_replace(key, r"[^a-z0-9]+", joint), rf"^{joint}+|{joint}+\z", "")
    return out if empty is None else F.coalesce(F.nullif(out, F.lit("")), F.lit(empty))


def identifier(ref: Column) -> Column:
    return F.lower(F.replace(ref, F.lit("`"), F.lit("")))


def bare_name(ref: Column) -> Column:
    """The last part of a dotted name."""
    return F.element_at(F.split(ref, r"\."), -1)


def parent_of(path: Column) -> Column:
    """The folder of a path; the root's is the root."""
    up = F.regexp_replace(F.regexp_replace(path, r"/+\z", ""), r"/[^/]*\z", "")
    return F.when(up == "", F.lit("/")).otherwise(up)


def statements(source: Column) -> Column:
    """The source cut at every semicolon, without blanks."""
    return F.filter(F.transform(F.split(source, ";", -1), trimmed), lambda s: s != "")


def without_comments(sql: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(sql, r"(?m)--.*$", ""), r"(?s)/\*.*?\*/", "")


def normal_sql(sql: Column) -> Column:
    """SQL that no parser reads, as one line without comments, backticks and case."""
    c = F.replace(F.lower(without_comments(sql)), F.lit("`"), F.lit(""))
    return trimmed(F.regexp_replace(F.regexp_replace(c, r"(?U);\s*\z", ""), r"(?U)\s+", " "))


def normal_body(raw: Column, comment: Column) -> Column:
    """Code lines up to the first comment mark, joined by single spaces."""
    lines = F.transform(F.split(raw, "\n", -1), lambda x: trimmed(F.substring_index(x, "#", 1)))
    slashes = F.transform(F.split(raw, "\n", -1), lambda x: trimmed(F.substring_index(x, "//", 1)))
    kept = F.filter(F.when(comment == "#", lines).otherwise(slashes), lambda x: x != "")
    return trimmed(F.regexp_replace(F.array_join(kept, " "), r"(?U)\s+", " "))


def snippet(raw: Column, most: int = SNIPPET) -> Column:
    return F.when(F.length(raw) > most, F.concat(F.substring(raw, 1, most), F.lit("\n..."))).otherwise(raw)


def shortened(text: Column, most: int = LABEL) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def join_key_hint(sql: Column) -> Column:
    """`a = b` of the first ON, else of the first qualified equality after WHERE; for display only."""
    clean = lambda p, g: F.replace(F.regexp_extract(sql, p, g), F.lit("`"), F.lit(""))
    both = lambda p: F.when(found(sql, p).isNotNull(), F.concat_ws(" = ", clean(p, 1), clean(p, 2)))
    return F.coalesce(both(ON_EQUALITY), both(WHERE_EQUALITY))


def where_text(sql: Column) -> Column:
    """What stands after the first WHERE, up to the next clause; null if that is nothing."""
    return F.nullif(F.regexp_replace(trimmed(F.regexp_extract(sql, WHERE_SPAN, 1)), r"(?U);\s*\z", ""), F.lit(""))


def text_target(sql: Column) -> Column:
    """The table a statement writes, by its text: MERGE, then CREATE TABLE AS SELECT, then INSERT."""
    c = without_comments(sql)
    return identifier(F.coalesce(found(c, MERGE_TARGET), found(c, CTAS_TARGET), found(c, INSERT_TARGET)))


def text_sources(sql: Column) -> Column:
    """The names after FROM, JOIN and USING, each once, without the target."""
    names = F.array_distinct(F.transform(F.regexp_extract_all(without_comments(sql), F.lit(SOURCES), F.lit(1)), identifier))
    target = text_target(sql)
    return F.when(target.isNull(), names).otherwise(F.array_remove(names, target))


def text_tables(sql: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(normal_sql(sql), F.lit(TABLES), F.lit(1)))


def table_kind(name: Column, layer: Column | None = None) -> Column:
    """fact, dimension, bridge, staging or other, by the name; a raw layer's unmarked tables are staging."""
    low = F.lower(name)
    out = None
    for kind, pattern in KINDS:
        test = low.rlike(pattern)
        if kind == "staging" and layer is not None:
            test = test | F.coalesce(F.lower(layer), F.lit("")).rlike(STAGING_LAYER)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("other")


def layer_rank(schema: Column) -> Column:
    """The place of the first layer with a keyword in the schema's name, null if there is none."""
    low = F.lower(schema)
    out = F.lit(None).cast("int")
    for i, (_, keys) in reversed(list(enumerate(LAYERS))):
        out = F.when(low.rlike("|".join(keys)), i).otherwise(out)
    return out


def matches_table(target: Column, catalog: str, schema: str, table: str) -> Column:
    """Whether a written name means catalog.schema.table; a bare name means any schema's."""
    t, s = table.lower(), f"{schema}.{table}".lower()
    return target.isin(t, s, f"{catalog}.{s}".lower()) | target.endswith(f".{s}")


def refers_to(tables: Column, name: str) -> Column:
    """Whether the last part of any table is the name."""
    return F.exists(tables, lambda x: bare_name(x) == name.lower())
