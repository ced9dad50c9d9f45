"""Statements read by Spark's parser and by the lexer. Nothing is resolved and nothing is ever executed.

The parser only exists on the driver. Each different shape of a statement costs it one call, which gives the plan as
rendered text; shapes and plans go to the shared folder batch by batch, so that the driver never holds more than one, and
tasks fill the plans with each statement's own names and values. A shape is the statement with holes for names and
values that hold digits, where a plan's form can't depend on them; a statement that may be an exception is its own shape.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from py4j import protocol
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexer import Reading, Token, reading_of, tokens
from ..sources.shared import fresh_path, written

_FILTER = "struct<source:string,predicate:string>"
SCHEMA = f"raw_sql string, sources array<string>, target string, tables array<string>, columns array<string>, normal string, predicate string, filters array<{_FILTER}>, parsed boolean"
_TREES = "shape string, tree string"
_SHAPED = "raw_sql string, shape string, parts array<string>"
BATCH, BATCH_CHARS = 500, 8 << 20  # shapes, and characters of them, that the driver holds at a time

# One line of a rendered plan: marks of the depth, three characters each, and what the node says of itself.
_LINE = re.compile(r"^((?:: {2}| {3})*)(:- |\+- )(.*)$", re.S)
_RELATION = re.compile(r"'?UnresolvedRelation \[(.*?)\], \[")
_IDENTIFIER = re.compile(r"'?UnresolvedIdentifier \[(.*?)\], (?:true|false)")
_ATTRIBUTE = re.compile(r"'((?:`[^`]+`|[\w$-]+)(?:\.(?:`[^`]+`|[\w$-]+))*)(?![\w(`.])")
_LABEL = re.compile(r"^'?(\w+)")

# What has holes: statements that begin so and hold none of the words after which the parser looks into a name or a value
# (or files it by its hash), with plain names, and plain values after a comparison.
_SHAPED_VERBS = frozenset("select with insert create merge update delete".split())
_LOOKED_INTO = frozenset("collate collation interval identifier tablesample options tblproperties dbproperties serdeproperties partition partitioned clustered window location pivot unpivot".split())
_COMPARED = frozenset(("=", "==", "<>", "!=", "<", "<=", ">", ">="))
_PLAIN_NAME = re.compile(r"(?=\D*\d)[A-Za-z_][A-Za-z0-9_]*\Z", re.A)
_PLAIN_NUMBER = re.compile(r"(?:0|[1-9]\d{0,8})\Z", re.A)
_PLAIN_TEXT = re.compile(r"'(?=\D*\d)[A-Za-z0-9_-]*'\Z", re.A)
_HOLE, _NUMBER = "qzx{}xzq", "73519{:04d}"
_HELD = re.compile(r"qzx(\d+)xzq|(?<![\w.])73519(\d{4})(?![\w.])")


def shape_of(sql: str) -> tuple[str, list[str]]:
    """The statement with holes, and what was in them.

    Equal names are one hole, since the parser compares names; values are a hole each. Word characters with a digit among
    them are never one of the grammar's words, so that both read alike.
    """
    low = sql.lower()
    if "qzx" in low or "73519" in low or "${" in low:
        return sql, []
    found = tokens(sql)
    if not found or found[0].low not in _SHAPED_VERBS or any(t.low in _LOOKED_INTO for t in found):
        return sql, []
    out, at, parts, names = [], 0, [], {}
    for i, t in enumerate(found):
        start, end = t.start, t.end
        before, after = sql[start - 1 : start], sql[end : end + 1]
        if t.kind in ("word", "name"):
            if t.kind == "name":
                start, end = start + 1, end - 1
            elif t.text[0] == "#":
                start += 2 if t.text[1:2] == "#" else 1
            if t.text[0] == '"' or not _PLAIN_NAME.match(sql[start:end]) or before and before in "$@#{:&\\" or after in ("'", '"', "$", "@", "#"):
                continue
            part = sql[start:end]
            if part not in names:
                names[part] = len(parts)
                parts.append(part)
            hole = _HOLE.format(names[part])
        elif i and found[i - 1].text in _COMPARED and len(parts) < 10_000:
            follows = found[i + 1] if i + 1 < len(found) else None
            if t.kind == "number" and _PLAIN_NUMBER.match(t.text) and not re.match(r"[\w.$]", after or " "):
                hole = _NUMBER.format(len(parts))
            elif t.kind == "text" and _PLAIN_TEXT.match(t.text) and (follows is None or follows.kind not in ("text", "name")):
                start, end = start + 1, end - 1
                hole = _HOLE.format(len(parts))
            else:
                continue
            parts.append(sql[start:end])
        else:
            continue
        out += [sql[at:start], hole]
        at = end
    if len({x.lower() for x in names}) < len(names):  # the parser may or may not tell them apart
        return sql, []
    return "".join([*out, sql[at:]]), parts


def filled(tree: str | None, parts: list[str]) -> str | None:
    """A shape's plan with what was in the holes."""
    return tree if tree is None or not parts else _HELD.sub(lambda m: parts[int(m[1] or m[2])], tree)


@dataclass
class Node:
    label: str
    children: list[Node] = field(default_factory=list)
    inner: list[Node] = field(default_factory=list)  # bodies of common table expressions, subqueries

    @property
    def kind(self) -> str:
        m = _LABEL.match(self.label)
        return m[1] if m else ""

    def below(self) -> Iterator[Node]:
        yield self
        for x in (*self.children, *self.inner):
            yield from x.below()


def tree_of(rendered: str) -> Node:
    """The nodes of a rendered plan. Lines that don't look like a node's belong to the one before: literals may have several."""
    root, path = None, []
    for line in rendered.rstrip("\n").split("\n"):
        m = _LINE.match(line)
        if root is None:
            root = Node(line)
            path = [(0, root)]
        elif m is None:
            path[-1][1].label += "\n" + line
        else:
            depth = len(m[1]) // 3 + 1
            while path[-1][0] >= depth:
                path.pop()
            over, parent = path[-1]
            node = Node(m[3])
            (parent.children if depth == over + 1 else parent.inner).append(node)  # inner plans are drawn one step deeper
            path.append((depth, node))
    return root


def _name(listed: str) -> str:
    return listed.replace(", ", ".").lower()


def _written(root: Node) -> tuple[str | None, list[Node]]:
    """The table that a plan writes and the nodes that it reads from."""
    kind = root.kind
    if kind == "CTE":
        target, reads = _written(root.children[-1])
        return target, [*reads, *root.inner] if target is not None else [root]
    if kind == "Union" and root.children and root.children[0].kind == "InsertIntoStatement":
        return _written(root.children[0])[0], [x for c in root.children for x in c.children]
    if kind == "InsertIntoStatement":
        m = _RELATION.search(root.label)
        return (_name(m[1]) if m else None), [*root.children, *root.inner]
    if kind in ("CreateTableAsSelect", "ReplaceTableAsSelect", "CreateTable", "ReplaceTable", "CreateView"):
        m = _IDENTIFIER.match(root.children[0].label) if root.children else None
        return (_name(m[1]) if m else None), [*root.children[1:], *root.inner]
    if kind == "CreateViewCommand":
        m = re.match(r"'?CreateViewCommand ((?:`(?:[^`]|``)*`\.?)+|[\w.]+),", root.label)
        return (m[1].replace("`", "").lower() if m else None), [*root.children, *root.inner]
    if kind in ("MergeIntoTable", "UpdateTable"):
        own = next((n for n in root.children[0].below() if _RELATION.match(n.label)), None)
        return (_name(_RELATION.match(own.label)[1]) if own else None), [*root.children[1:], *(root.inner if kind == "UpdateTable" else [])]
    return None, [root]


def _coded(found: list[Token]) -> tuple[Callable[[str], str], Callable[[str], str]]:
    """Names that the rendering doesn't quote, as one character each, and back; literals with a quote in them vanish."""
    odd = list(dict.fromkeys(t.text[1:-1].replace("``", "`") for t in found if t.text[0] == "`" and not re.match(r"\w*\Z", t.text[1:-1])))[:6000]
    literals = [x for t in found if t.kind == "text" and "'" in (x := t.text[1:-1])]

    def to(text: str) -> str:
        for x in literals:
            for y in {x, x.replace("''", "'"), x.replace("\\'", "'")}:
                text = text.replace(y, "")
        for i, x in enumerate(odd):
            text = text.replace(f"`{x}`", chr(0xE000 + i)).replace(x, chr(0xE000 + i))
        return text

    return to, lambda text: re.sub("[" + chr(0xE000) + "-" + chr(0xF8FF) + "]", lambda m: odd[ord(m[0]) - 0xE000] if ord(m[0]) - 0xE000 < len(odd) else m[0], text)


def from_tree(sql: str, rendered: str, read: Reading) -> tuple:
    """A row of SCHEMA from a rendered plan; where a WHERE begins and ends, only the text tells."""
    root = tree_of(rendered)
    target, reads = _written(root)
    to, back = _coded(tokens(sql))
    own = {x.strip().lower() for n in root.below() if n.kind == "CTE" for x in n.label[5:-1].split(",")}
    names, columns = [], []
    for n in (n for r in reads for n in r.below()):
        label = to(n.label)
        if m := _RELATION.match(label):
            names.append(back(_name(m[1])))
        elif n.kind != "SubqueryAlias":
            columns += [back(m[1].split(".")[-1].strip("`")).lower() for m in _ATTRIBUTE.finditer(_LABEL.sub("", label))]
    sources = list(dict.fromkeys(x for x in names if x not in own))
    everything = sources if target is None else list(dict.fromkeys([target, *sources]))
    # A view's plan also carries its body's text, comments and all.
    shown = rendered if root.kind not in ("CreateView", "CreateViewCommand") else f"View {target} " + "\n".join(rendered.split("\n")[1:])
    normal = re.sub(r"\s+", " ", re.sub(r"#\d+L?", "", shown)).lower().strip()
    return sql, sources, target, everything, list(dict.fromkeys(columns)), normal, read.predicate, [{"source": s, "predicate": p} for s, p in read.filters], True


def from_text(sql: str, read: Reading) -> tuple:
    """A row of SCHEMA of a statement that Spark's grammar doesn't have; its normal form is left to functions.text."""
    everything = read.sources if read.target is None else list(dict.fromkeys([read.target, *read.sources]))
    return sql, read.sources, read.target, everything, [], None, read.predicate, [{"source": s, "predicate": p} for s, p in read.filters], False


def row_of(sql: str, rendered: str | None) -> tuple:
    read = reading_of(sql)
    return from_text(sql, read) if rendered is None else from_tree(sql, rendered, read)


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(0).to_pylist()
        shapes = [shape_of(t) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in shapes], pa.string()), pa.array([x for _, x in shapes], pa.list_(pa.string()))], ["raw_sql", "shape", "parts"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text, texts = pa.string(), pa.list_(pa.string())
    types = [text, texts, text, texts, texts, text, text, pa.list_(pa.struct([("source", text), ("predicate", text)])), pa.bool_()]
    names = ["raw_sql", "sources", "target", "tables", "columns", "normal", "predicate", "filters", "parsed"]
    for b in batches:
        found = [row_of(s, filled(t, p)) for s, p, t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)


def rendered(spark: SparkSession, sql: str, parser=None) -> str | None:
    """The statement's plan as text, or None if Spark's grammar doesn't have it.

    A refusal is only noticed: PySpark would fetch the parser's whole error, for ten times what the parsing takes.
    """
    parser = parser or spark._jsparkSession.sessionState().sqlParser()
    command = f"{protocol.CALL_COMMAND_NAME}{parser._target_id}\nparsePlan\n{protocol.get_command_part(sql)}{protocol.END_COMMAND_PART}"
    answer = parser._gateway_client.send_command(command)
    try:
        return protocol.get_return_value(answer, parser._gateway_client, parser._target_id, "parsePlan").toString()
    except (protocol.Py4JError, PySparkException):
        return None


def _batches(texts: Iterator[str]) -> Iterator[list[str]]:
    batch, size = [], 0
    for t in texts:
        batch.append(t)
        size += len(t)
        if len(batch) >= BATCH or size >= BATCH_CHARS:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def read_statements(rows: DataFrame, column: str = "raw_sql") -> DataFrame:
    """SCHEMA for each different statement of rows. `normal` is null where Spark's grammar doesn't have one (`parsed` is false)."""
    spark = rows.sparkSession
    key = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(key)
    different = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("raw_sql")).distinct()
    shaped = written(different.mapInArrow(_shapes, _SHAPED), "shapes")
    texts = (r[0] for r in shaped.select("shape").distinct().toLocalIterator())
    path, last = None, []
    parser = spark._jsparkSession.sessionState().sqlParser()
    spark.conf.set(key, "100000")  # else long lists of columns are cut in the plans
    try:
        for batch in _batches(texts):
            if last:
                path = path or fresh_path(spark, "plans")
                spark.createDataFrame(last, _TREES).coalesce(1).write.mode("append").parquet(path)
            last = [(t, rendered(spark, t, parser)) for t in batch]
    finally:
        spark.conf.set(key, before)
    trees = spark.createDataFrame(last, _TREES)
    if path is None:
        trees = F.broadcast(trees)  # a batch
    else:
        trees.coalesce(1).write.mode("append").parquet(path)
        trees = spark.read.schema(_TREES).parquet(path)
    return written(shaped.join(trees, "shape").select("raw_sql", "parts", "tree").mapInArrow(_rows, SCHEMA), "statements")
