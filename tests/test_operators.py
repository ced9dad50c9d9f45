"""Auditing operators on hand-made notebooks and tables."""

import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from layerwise import fixtures, queries
from layerwise.functions import text
from layerwise.functions.lexer import reading_of
from layerwise.operators import audit, cells, codedefs, counts, drift, exclusions, explained, lineage, measures, search, sqlfacts, summary
from layerwise.plans import catalyst
from layerwise.plans.catalyst import rendered, row_of
from layerwise.sources import catalog, sinks
from layerwise.sources.catalog import Layer, Table
from layerwise.sources.snapshots import Conflict, Snapshots
from layerwise.sources.notebooks import decoded, folder, notebooks, read_notebooks, under

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    lit = F.lit
    assert value(spark, text.snippet(lit("a" * 401))) == "a" * 400 + "\n..." and value(spark, text.snippet(lit("a" * 400))) == "a" * 400
    assert value(spark, text.shortened(lit("b" * 71))) == "b" * 69 + "…"
    assert [value(spark, text.parent_of(lit(p))) for p in ("/a/b", "/a", "/", "/a/b/")] == ["/a", "/", "/", "/a"]
    assert value(spark, text.statements(lit(" a ; ;\tb;"))) == ["a", "b"]
    assert value(spark, text.normal_sql(lit("SELECT `A` -- x\n /* y */ FROM t ; "))) == "select a from t"
    assert value(spark, text.join_key_hint(lit("x JOIN y ON `a`.b = c.d WHERE p.q = r.s"))) == "a.b = c.d"
    assert value(spark, text.join_key_hint(lit("x, y WHERE 1 = 1 AND p.q = r.s"))) == "p.q = r.s"
    assert value(spark, text.join_key_hint(lit("x JOIN y ON (a.b = c.d)"))) is None
    assert value(spark, text.where_text(lit("SELECT 1 FROM t WHERE a > 1\nGROUP BY b"))) == "a > 1"
    assert value(spark, text.where_text(lit("SELECT 1"))) is None
    assert value(spark, text.text_sources(lit("MERGE INTO a.b USING C.d ON x FROM a.b"))) == ["c.d"]
    assert value(spark, text.matches_table(lit("main.s.t"), "main", "S", "T")) and not value(spark, text.matches_table(lit("other.t"), "main", "s", "t"))


def loop_key(name):
    import re

    base = re.sub(r"(?i)\.(py|sql|scala|r|ipynb)\Z", "", name.strip())
    marks = [r"[_\-]v\d+\Z", r"[_\-]version\d+\Z", r"[_\-](final|draft|copy|old|new|backup|bak|wip)\Z", r"\(\d+\)\Z", r"[_\-]\d+\Z"]
    while True:
        for m in marks:
            shorter = re.sub("(?i)" + m, "", base)
            if shorter and shorter != base:
                base = shorter
                break
        else:
            return re.sub(r"[\s_\-]+", "_", base.lower()).strip("_")


NAMES = st.lists(st.sampled_from(["a", "B", "_v2", "-final", "_old", "(3)", "_2024", "-", " ", "_version1", ".py", ".sql", "copy", "_"]), max_size=7).map("".join)


@settings(max_examples=1, deadline=None)
@given(st.lists(NAMES, min_size=300, max_size=300))
def test_names_lose_their_versions(spark, names):
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.notebook_key(F.col("n")).alias("k")).collect()
    assert all(r.k == loop_key(r.n) for r in got)


def test_cells_keep_their_numbers(spark):
    source = "# Databricks notebook source\n\n# COMMAND ----------\n   \n# COMMAND ----------\n# MAGIC %sql SELECT 1\n# COMMAND ----------\n# MAGIC %rust\n# MAGIC x\n# COMMAND ----------\n# MAGIC %md\nplain\n# MAGIC  two"
    got = cells.cells(notebooks(spark, [("/n", "PYTHON", source), ("/null", "SQL", None), ("/u", None, "x")])).orderBy("nb_ord", "cell_index").collect()
    assert [(r.path, r.cell_index, r.language, r.source) for r in got] == [
        ("/n", 2, "python", "%sql SELECT 1"), ("/n", 3, "unknown", "x"), ("/n", 4, "md", "plain\n two"), ("/u", 0, "unknown", "x"),
    ]


def test_definitions():
    source = "def f(a,\n      b\n):\n  pass\nx = 1\nasync def g(): pass\ny == 2\nclass C:\n  z = 1\nn: int = 3\ndef h(): return 1\n\n\nw = [\n 1]"
    assert codedefs.python_defs(source) == [("f", "function", "def f(a,\n      b"), ("x", "variable", "x = 1"), ("h", "function", "def h(): return 1\n\n"), ("w", "variable", "w = [")]
    scala = "def a(x: Int) = {\nval inner = 1\n}\ndef b(y: Int): Int = y\nvar c = 2\ndef open(z: Int) = {\n x"
    assert [(n, k) for n, k, _ in codedefs.scala_defs(scala)] == [("a", "function"), ("open", "function"), ("b", "function"), ("c", "variable")]
    nested = "def a(x: Int) = {\ndef b(y: Int) = {\n1 }\nval z = 2\n}\nval w = 3\ndef c(x: Int) =\n  x\n"
    assert codedefs.scala_defs(nested) == [
        ("a", "function", nested[: nested.index("\nval w")]), ("b", "function", "def b(y: Int) = {\n1 }"), ("c", "function", "def c(x: Int) =\n  x"), ("w", "variable", "val w = 3"),
    ]


@pytest.mark.parametrize(
    ("sql", "target", "sources", "predicate"),
    [
        ("CREATE OR REPLACE TABLE s.x USING DELTA AS SELECT a FROM b.y WHERE a BETWEEN 1 AND 3 AND c <> 'P' GROUP BY a", "s.x", ["b.y"], "a BETWEEN 1 AND 3 AND c <> 'P'"),
        ("INSERT OVERWRITE TABLE t SELECT * FROM a JOIN b ON a.i = b.i WHERE a.x > 1 LIMIT 3", "t", ["a", "b"], "a.x > 1"),
        ("MERGE INTO g.m t USING s.s ON t.i = s.i WHEN MATCHED THEN DELETE", "g.m", ["s.s"], None),
        ("WITH c AS (SELECT * FROM r.z WHERE q = 1) SELECT * FROM c", None, ["r.z"], None),
        ("SELECT * FROM (SELECT * FROM u WHERE x = 1) v", None, ["u"], None),
        ("DELETE FROM d WHERE x = 1", None, ["d"], None),
        ("SELECT extract(YEAR FROM d) FROM t", None, ["t"], None),
    ],
)
def test_parser(spark, sql, target, sources, predicate):
    parsed = lambda text: row_of(text, rendered(spark, text))
    _, got, written, tables, _, _, where, _, known = parsed(sql)
    assert known
    assert (written, sorted(got), where) == (target, sorted(sources), predicate)
    assert rendered(spark, "SELECT TOP 3 * FROM t") is None
    assert parsed(sql)[5] == parsed("/* c */ " + sql.replace(" ", "  ").replace("SELECT", "select"))[5]


def test_excluded_rows_add_up(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    for p in ("o_orderstatus <> 'P'", "nullif(o_orderstatus, 'F') <> 'P'", "o_totalprice > 100000 OR o_custkey = 1"):
        (excluded, nulls), = exclusions.excluded(orders, [p])
        assert orders.where(p).count() + excluded + nulls == orders.count()
    bad = ["alias.o_custkey > 1", "not sql at all (", "o_orderstatus > 5", "1) OR (1 = 1", "o_custkey"]
    got = exclusions.excluded(orders, [*bad, "o_custkey > 1"])
    assert got[:2] == [None, None] and got[2] is None and got[4] is None and got[5] is not None


def test_only_a_statements_own_where_is_a_rule(spark):
    t = spark.range(10).toDF("v")
    layers = [Layer("bronze", "b", [Table("src", t)]), Layer("silver", "s", [Table(x, t) for x in ("a", "b", "c", "d")])]
    code = (
        "INSERT INTO s.a SELECT * FROM b.src -- where v > 5\n;INSERT INTO s.b SELECT * FROM (SELECT * FROM b.src WHERE v > 5) q;"
        "INSERT INTO s.c SELECT * FROM b.src /* where v > 5 */ WHERE v > 7;INSERT INTO s.d SELECT TOP 3 * FROM b.src WHERE v > 8 -- where v > 5"
    )
    facts = lineage.lineage_facts(notebooks(spark, [("/n", "SQL", code)]))
    got = {r.rule_label: r.excluded_count for r in exclusions.exclusion_rules(spark, layers, facts).collect()}
    assert got == {"c: v > 7": 8, "d: v > 8": 9}


def test_first_writer_decides_and_last_layer_wins(spark):
    a, b = spark.range(10).toDF("v"), spark.range(3).toDF("v")
    layers = [Layer("bronze", "b", [Table("t", a), Table("src", a)]), Layer("silver", "s", [Table("T", b), Table("u", b), Table("w", b)])]
    books = notebooks(spark, [("/1", "SQL", "INSERT INTO s.t SELECT * FROM b.t WHERE v > 1; INSERT INTO s.u SELECT * FROM src"), ("/2", "SQL", "INSERT INTO s.u SELECT * FROM src WHERE v > 5;INSERT INTO s.w SELECT * FROM nowhere WHERE v > 5")])
    facts = lineage.lineage_facts(books)
    got = {r.rule_label: r.excluded_count for r in exclusions.exclusion_rules(spark, layers, facts).collect()}
    assert got == {"T: v > 1": 2, "w: v > 5": None}
    own = {r.rule_label: r.excluded_count for r in exclusions.exclusion_rules(spark, layers, facts, qualified=True).collect()}
    assert own["T: v > 1"] == 2  # b.t is looked up in bronze: two rows there as well


def test_frames_give_way_to_statements(spark):
    both = 'spark.sql("INSERT INTO a.t SELECT * FROM b.x")\nspark.table("b.y").write.insertInto("a.t")'
    other = 'spark.read.table("b.y").write.saveAsTable("a.u")'
    got = lineage.lineage_facts(notebooks(spark, [("/1", "PYTHON", both), ("/2", "PYTHON", other), ("/3", "PYTHON", 'df.write.saveAsTable("a.v")')])).collect()
    assert sorted((r.path, r.target, r.sources) for r in got) == [("/1", "a.t", ["b.x"]), ("/2", "a.u", ["b.y"])]


def test_drift_against_loops(spark):
    sql = ["SELECT a FROM t", "SELECT b FROM t", "SELECT a FROM t; SELECT c FROM t", "SELECT a  FROM t -- same"]
    books = notebooks(spark, [(f"/n_v{i}", "SQL", s) for i, s in enumerate(sql)])
    groups = drift.notebook_groups(books)
    found = drift.sql_drift(books, groups).orderBy("id").collect()
    facts = [("/n_v0", 0, "cell_0", "a"), ("/n_v1", 0, "cell_0", "b"), ("/n_v2", 0, "cell_0_0", "a"), ("/n_v2", 0, "cell_0_1", "c"), ("/n_v3", 0, "cell_0", "a")]
    want, flagged = [], set()
    for same_name in (True, False):
        for i, x in enumerate(facts):
            for y in facts[i + 1 :]:
                pair = (x[0], x[1], y[0], y[1])
                if x[0] != y[0] and x[3] != y[3] and (x[2] == y[2] if same_name else pair not in flagged):
                    flagged.add(pair)
                    want.append((x[0], y[0]))
    assert [(r.left.path, r.right.path) for r in found] == want
    assert drift.chosen_groups(groups, ["n"]).count() == 1
    with pytest.raises(ValueError):
        drift.chosen_groups(groups, ["none"])


def test_counts_that_fail(spark):
    bad = spark.range(1).select(F.expr("cast('x' as int)").alias("v")).where("v > 0")
    layers = [Layer("a", "a", [Table("t", spark.range(4)), Table("bad", bad)]), Layer("b", "b", [])]
    got = {r.table: r.row_count for r in counts.safe_table_counts(spark, layers).collect()}
    assert got == {"t": 4, "bad": None}
    totals = {r.label: r.total_rows for r in counts.layer_totals(spark, layers, counts.safe_table_counts(spark, layers), strict=False).collect()}
    assert totals == {"a": 4, "b": None}
    with pytest.raises(ValueError):
        counts.compare_stages(spark, layers[:1])


def test_explanations(spark):
    books, layers = fixtures.corpus(spark), fixtures.layers(spark, SF)
    said = []

    def explainer(messages):
        said.append(messages)
        return '{"explanations": [{"index": 0, "explanation": "drops pending", "severity": "warning"}, {"targetTable": "gold.orders", "explanation": "copies"}], "responsibleIndex": 0, "explanation": "why", "isCorrect": true, "status": "ok", "summary": "fine", "overview": "all"}'

    rules = audit.analyse(spark, layers, books, explainer).rules.orderBy("layer_ord", "tbl_ord").collect()
    assert (rules[0].explanation, rules[0].severity) == ("drops pending", "warning") and rules[1].severity == "warning"
    assert audit.analyse(spark, layers, books, lambda m: 1 / 0).rules.first().explanation == ""
    mismatch = {"table_name": "customer", "from_stage": "a", "to_stage": "b", "from_count": 1, "to_count": 2}
    got = audit.analyse_mismatch(spark, books, mismatch, explainer)
    assert got["responsible"]["path"] == "/etl/build_sales" and len(got["others"]) == 2 and got["explanation"] == "why"
    fan = lineage.fan_out(books, "orders", "gold")
    told = {r.target: r.explanation for r in audit.explain_lineage(spark, "orders", fan, explainer).collect()}
    assert told["gold.orders"] == "copies"
    assert audit.validate_logic(spark, books, "main", "silver", "orders", "no pending orders", explainer)["is_correct"]
    assert audit.analyse_level(spark, books, "bronze", "silver", ["silver.orders"], "", explainer)["status"] == "ok"
    whole = audit.summarise(spark, layers, books, explainer)
    assert whole.narrative["overview"] == "all" and whole.stats.first().layer_count == 4
    assert all("pending" not in m["content"] or i for i, m in enumerate(said[0]))
    with pytest.raises(audit.ExplainerMissing):
        audit.analyse_mismatch(spark, books, mismatch)
    assert audit.explain_lineage(spark, "x", fan.limit(0)).count() == 0


def test_explained_lineage_leaves_rows_where_they_are(spark, monkeypatch):
    """The question is made row by row: the driver never holds all rows, and a table of many is read once."""
    monkeypatch.setattr(audit, "_dicts", None)
    fan = spark.range(50).selectExpr("concat('t', id % 3) AS target", "'/p' AS path", "CAST(id AS INT) AS cell_index", "uuid() AS snippet")
    asked = []
    told = audit.explain_lineage(spark, "x", fan, lambda m: asked.append(m[1]["content"]) or '{"explanations": [{"targetTable": "t1", "explanation": "e"}]}').collect()
    assert len(told) == 50 and {r.explanation for r in told if r.target == "t1"} == {"e"}
    assert all(r.snippet in asked[0] for r in told)


def test_logic_is_judged_by_whole_code(spark):
    """A rule that stands at the end of long code is in the question, and in the code that comes with the answer."""
    many = ", ".join(f"column_{i}" for i in range(100))
    sql = f"INSERT INTO silver.orders SELECT {many} FROM bronze.orders WHERE status <> 'pending'"
    frame = f"# {many}\nspark.table('bronze.orders').where('not held').write.saveAsTable('silver.orders')"
    asked = []
    got = audit.validate_logic(spark, notebooks(spark, [("/a", "SQL", sql), ("/b", "PYTHON", frame)]), "main", "silver", "orders", "no pending orders", lambda m: asked.append(m[1]["content"]) or '{"isCorrect": true}')
    assert [c["snippet"] for c in got["candidates"]] == [sql, frame] and sql in asked[0] and frame in asked[0]


def test_level_code_limits(spark):
    many = "\n-- COMMAND ----------\n".join(f"SELECT {i} FROM t" for i in range(60))
    books = notebooks(spark, [("/a", "SQL", "SELECT 1 FROM other"), ("/b", "SQL", many)])
    got = search.level_code(books, ["s.t"]).collect()
    assert len(got) == 40 and got[0].path == "/a"  # /a has no match and gives all of its cells
    assert len(search.level_code(books, []).collect()) == 40


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "b.sql").write_text("SELECT 1")
    (tmp_path / "x" / "a.py").write_text("y = 1")
    got = read_notebooks(spark, str(tmp_path)).orderBy("nb_ord").collect()
    assert [(r.name, r.language, r.source) for r in got] == [("b.sql", "SQL", "SELECT 1"), ("a.py", "PYTHON", "y = 1")]
    entries = spark.createDataFrame([("/b", "NOTEBOOK"), ("/A", "NOTEBOOK"), ("/z", "DIRECTORY"), ("/z/q", "NOTEBOOK"), ("/f", "FILE")], "path string, type string")
    assert [r.name for r in folder(entries).collect()] == ["z", "A", "b"] and [r.name for r in folder(entries, "/z").collect()] == ["q"]
    assert under(fixtures.corpus(spark), "/etl").count() == len(fixtures.NOTEBOOKS)
    assert decoded(spark.createDataFrame([("w6k=",)], "content string")).first().source == "é"
    assert catalog.check_connection(spark) and catalog.compute(spark)["state"] == "RUNNING"
    assert "default" in [r.name for r in catalog.schemas(spark).collect()] and catalog.catalogs(spark).count() >= 1
    layers = spark.createDataFrame([("bronze", "b"), (" ", "s"), ("gold", "")], "label string, schema string")
    assert catalog.complete_layers(layers).count() == 1
    assert catalog.columns(spark.createDataFrame([], "")) is None
    sinks.remember(spark.range(3), "kept")
    assert spark.table("kept").count() == 3 and catalog.table_columns(spark, "kept") == [("id", "bigint")]
    sinks.forget(spark, "kept")
    sinks.write(spark.range(3), f"{tmp_path}/out", "json")
    assert spark.read.json(f"{tmp_path}/out").count() == 3


def test_detected_layers(spark):
    rows = spark.createDataFrame([(0, "gold_raw"), (1, "x")], "ord int, name string")
    assert [(r.layer_ord, r.schema) for r in summary.detect_layers(rows).collect()] == [(0, "gold_raw")]


@pytest.mark.parametrize(
    ("sql", "target", "sources", "predicate", "filters"),
    [
        ("INSERT INTO t (a, b) (SELECT a, b FROM (x JOIN y ON x.i = y.i) WHERE q)", "t", ["x", "y"], "q", [(None, "q")]),
        ("MERGE INTO g.m t USING (SELECT * FROM s.s WHERE u = 1) s ON t.i = s.i WHEN MATCHED AND a > 1 THEN DELETE", "g.m", ["s.s"], None, [("s.s", "u = 1")]),
        ("SELECT extract(YEAR FROM d) FROM t WHERE a IS DISTINCT FROM b AND limit > 3 LIMIT 3", None, ["t"], "a IS DISTINCT FROM b AND limit > 3", [("t", "a IS DISTINCT FROM b AND limit > 3")]),
        ("WITH a AS (SELECT * FROM r WHERE p = 1 UNION SELECT * FROM q), b AS (SELECT * FROM a WHERE z) INSERT INTO o SELECT * FROM b WHERE k", "o", ["r", "q"], "k", [(None, "k"), ("r", "p = 1"), (None, "z")]),
        ("DELETE FROM d WHERE x = 1", None, ["d"], None, []),
        ("SELECT a[1] FROM t, explode(b) e, LATERAL (SELECT 1 FROM u WHERE c) w WHERE d = ')' /* where */", None, ["t", "u"], "d = ')' /* where */"[:7], [(None, "d = ')'"), ("u", "c")]),
        ("WITH RECURSIVE r AS (SELECT 1 FROM base WHERE s UNION ALL SELECT 1 FROM r WHERE n < 5) SELECT * FROM r", None, ["base"], None, [("base", "s"), ("base", "n < 5")]),
        ("CREATE TABLE x (a INT)", "x", [], None, []), ("", None, [], None, []), ("'", None, [], None, []), ("((((", None, [], None, []), ("SELECT 1 FROM", None, [], None, []), ("a WHERE", None, [], None, []), ("]]) ) FROM x", None, ["x"], None, []),
    ],
)
def test_lexer(sql, target, sources, predicate, filters):
    got = reading_of(sql)
    assert (got.target, got.sources, got.predicate, got.filters) == (target, sources, predicate, filters)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["select", "from", "where", "with", "as", "(", ")", "'", '"', "`", "[", "]", ",", ".", "--", "/*", "*/", "\n", " ", "a", "union", "insert into", "case", "end", ";", "$$", "join", "t"]), max_size=40).map("".join))
def test_the_lexer_takes_any_text(sql):
    got = reading_of(sql)
    assert got.predicate is None or got.predicate in sql


def test_plans_are_read_from_files(spark, monkeypatch):
    """More statements than a batch: the same rows as from one."""
    text = [f"INSERT INTO t{i} SELECT `odd name`, 'it''s a''b', c.d FROM s.u{i} WHERE x > {i}" for i in range(20)] + ["SELECT TOP 3 * FROM z WHERE 'multi\nline' = y"]
    rows = spark.createDataFrame([(t,) for t in text], "raw_sql string")
    one = sorted(catalyst.read_statements(rows).collect(), key=lambda r: r.raw_sql)
    monkeypatch.setattr(catalyst, "BATCH", 3)
    assert sorted(catalyst.read_statements(rows).collect(), key=lambda r: r.raw_sql) == one
    assert [r.columns for r in one if r.target == "t3"] == [["odd name", "d", "x"]] and sum(r.parsed for r in one) == 20
    assert len({r.normal for r in one}) == 21


_FORMS = (
    "CREATE OR REPLACE TABLE silver.t_{k} AS SELECT a{k}, `b{k}`, log{k}(x) FROM bronze.src_{m} WHERE amount > {k} AND z = 'x{k}'",
    "WITH c{k} AS (SELECT * FROM a.t{m} WHERE q = {k}) INSERT INTO b.u{k} SELECT * FROM c{k} JOIN d.v{m} ON c{k}.i1 = v{m}.i1 WHERE x <= {k}",
    "CREATE TEMP VIEW w{k} AS\n-- note {k}\nSELECT * FROM s.t{k} WHERE d > '1997-0{m}-01' AND e > {k}.5",
    "INSERT INTO gold.g{k} SELECT TOP {k} * FROM [dbo].[t{k}] WHERE a > {k}", "SELECT a INTO #t{k} FROM ##u{k} WHERE z = 'x{k}' 'y{k}'",
    "MERGE INTO g.t{k} t USING b.s{k} s ON t.k1 = s.k1 WHEN MATCHED AND s.a = {k} THEN UPDATE SET v = 'n{k}' WHEN NOT MATCHED THEN INSERT *",
    "UPDATE t{k} SET a = {k}, b = 'x-{k}' WHERE c IN (SELECT c{k} FROM u{m})", "DELETE FROM d{k} WHERE x = {k}", "SELECT * FROM t{k} LIMIT {k}",
    "SELECT CAST(a AS DECIMAL({k}, 2)), INTERVAL {k} MONTH FROM t{k} WHERE d > INTERVAL '{k}' DAY", "SELECT a COLLATE UTF{k} FROM t{k} WHERE a = 0{k}",
    "SELECT x FROM T{k} JOIN t{k} ON x = -{k} AND y = {k}L AND z = {k}e2 AND t{k}.y{k} = 99999999999999999999", "SELECT `odd name {k}`, \"s{k}\" FROM t{k} WHERE a = {k} GROUP BY {k}",
    "SELECT IDENTIFIER('t{k}') FROM t{k}", "SELECT ${{k}} FROM t{k}", "SELECT qzx0xzq FROM t{k} WHERE a = {k}", "SELECT (SELECT max(a{k}) FROM u{k}) FROM t{k} a WHERE a.x1 = :p{k} OR b IN ({k}, 'v{k}')",
)


def test_a_shape_costs_one_call(spark, monkeypatch):
    """Statements of one shape are parsed once, and each row is what its own plan gives."""
    text = [f.replace("{k}", str(k)).replace("{m}", str(k % 3)) for f in _FORMS for k in (1, 2, 3, 8, 10, 12, 41, 77, 123)]
    want = {t: row_of(t, rendered(spark, t)) for t in text}
    assert len({r[8] for r in want.values()}) == 2
    calls = []
    monkeypatch.setattr(catalyst, "rendered", lambda spark, sql, parser: calls.append(sql) or rendered(spark, sql, parser))
    got = catalyst.read_statements(spark.createDataFrame([(t,) for t in text], "raw_sql string")).collect()
    for r in got:
        assert [list(x) if isinstance(x, tuple) else x for x in (*r[:7], [f.asDict() for f in r.filters], r.parsed)] == list(want[r.raw_sql]), r.raw_sql
    assert len(got) == len(want)
    calls.clear()
    made = [f"INSERT INTO gold.g_{i % 5} SELECT * FROM silver.t_{i} WHERE amount > {i}" for i in range(300)]
    assert catalyst.read_statements(spark.createDataFrame([(t,) for t in made], "raw_sql string")).where("parsed").count() == 300
    assert len(calls) == 1


def test_made_code_is_many_tasks(spark, tmp_path):
    """A small file of suppliers isn't one task that makes and reads all of their code."""
    spark.range(64).selectExpr("id + 1 AS s_suppkey", "CAST(0 AS INT) AS s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    for rows in (queries.corpus_of(spark, str(tmp_path)), queries._made(spark, str(tmp_path))):
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_late_and_failing_tables_have_no_count(spark):
    slow = spark.range(0, 10**13, 1, 1).where("hash(id) = 7")
    bad = spark.range(1).select(F.expr("cast('x' as int)").alias("v")).where("v > 0")
    layers = [Layer("bronze", "b", [Table("ok", spark.range(3)), Table("slow", slow), Table("bad", bad), Table("two", spark.range(2))])]
    got = counts.safe_table_counts(spark, layers, workers=2, limit=5.0).collect()
    assert [(r.table, r.row_count) for r in got] == [("ok", 3), ("slow", None), ("bad", None), ("two", 2)]
    assert spark.range(5).count() == 5


def test_rules_by_branch(spark):
    t = spark.range(10).toDF("v")
    layers = [Layer("bronze", "b", [Table("src", t), Table("other", t)]), Layer("silver", "s", [Table(x, t) for x in ("a", "b")])]
    code = "WITH c AS (SELECT * FROM b.src WHERE v > 1) INSERT INTO s.a SELECT * FROM c WHERE v > 3 UNION ALL SELECT * FROM b.other o, b.src WHERE o.v = 1;UPDATE s.b SET v = 1 WHERE v > 7;INSERT INTO s.b SELECT * FROM b.src WHERE v > 2"
    got = exclusions.scan_rules(spark, layers, lineage.lineage_facts(notebooks(spark, [("/n", "SQL", code)]))).collect()
    assert [(r.table, r.scan, r.predicate_sql, r.source_table, r.excluded_count) for r in got] == [
        ("a", 0, "v > 3", "b.src", 4), ("a", 1, "v > 1", "b.src", 2), ("a", 2, "o.v = 1", None, None), ("b", 0, "v > 7", "s.b", 8),
    ]


def test_each_table_is_read_once(spark, tmp_path):
    """Rows and rules of a table are one scan; a plain table's rows come from footers."""
    spark.range(100).toDF("v").repartition(3).write.parquet(f"{tmp_path}/plain")
    spark.range(50).toDF("v").write.parquet(f"{tmp_path}/src")
    plain, src = catalog.parquet_table(spark, "plain", f"{tmp_path}/plain"), catalog.parquet_table(spark, "src", f"{tmp_path}/src")
    layers = [Layer("bronze", "b", [src, plain]), Layer("silver", "s", [Table("a", src.df.where("v > 9")), Table("c", src.df.where("v > 19"))])]
    code = "INSERT INTO s.a SELECT * FROM b.src WHERE v > 9;INSERT INTO s.c SELECT * FROM b.src WHERE v > 19"
    facts = lineage.lineage_facts(notebooks(spark, [("/n", "SQL", code)]))
    rules, found = measures.rules_and_counts(spark, layers, facts)
    assert [(r.table, r.row_count) for r in found.collect()] == [("src", 50), ("plain", 100), ("a", 40), ("c", 30)]
    assert [r.excluded_count for r in rules.collect()] == [10, 20]
    assert exclusions.profiled(src.df, ["v > 9", "bad", "v > 19"]) == (50, [(10, 0), None, (20, 0)])
    with measures._footers(spark):
        plan = measures.footer_plan(spark, [plain.path])._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
    one = src.df.agg(F.count_if(F.expr("v > 9")), F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert one.count("FileScan") == 1
    assert measures.footer_counts(spark, [plain.path, src.path], batch=1) == [100, 50] and "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


def test_all_tables_at_once(spark):
    books = notebooks(spark, [("/1", "SQL", "SELECT * FROM a.T1;SELECT 1 FROM x.t2 JOIN T1 ON y"), ("/2", "PYTHON", "print('nothing')"), ("/3", None, "spark.sql('select * from t3')")])
    names = spark.createDataFrame([("t1",), ("T2",), ("none",), ("t1",)], "table_name string")
    got = sorted((r.table_name, r.path, r.stmt_idx) for r in search.responsible_for(books, names).collect())
    assert got == sorted([("t1", "/1", 0), ("t1", "/1", 1), ("T2", "/1", 1)])
    for n in ("t1", "T2"):
        assert sorted((r.path, r.stmt_idx) for r in search.responsible_code(books, n).collect()) == [(p, i) for t, p, i in got if t == n]
    steps = {"one": ["a.t1"], "two": ["b.t3", "t2"], "none": []}
    every = search.level_codes(books, steps, most=2).collect()
    for step, tables in steps.items():
        assert sorted((r.path, r.cell_index, r.snippet) for r in every if r.step == step) == sorted((r.path, r.cell_index, r.snippet) for r in search.level_code(books, tables, 2).collect())


def test_pairs_meet_without_texts(spark):
    versions = [(f"/n_v{i}", "SQL", f"CREATE VIEW v AS SELECT {'a' * 300} FROM t WHERE x > {i % 2}") for i in range(6)]
    books = notebooks(spark, versions)
    found = drift.sql_drift(books, drift.notebook_groups(books))
    assert found.count() == 9 and {len(r.left.snippet) for r in found.collect()} == {len(versions[0][2])}
    facts = drift._in_groups(drift.sql_facts(books), drift.notebook_groups(books), books).withColumn("seq", F.struct("member", "cell_index", "stmt_idx"))
    assert not {"raw_sql", "normal"} & set(drift._pairs(facts, ["id", "base_key", "metric_name"]).columns)


def test_snapshots_of_two_writers(spark, tmp_path):
    """Writers at the same time: every version is committed once, and a reader always sees a whole one."""
    shelf = Snapshots(spark, f"file://{tmp_path}/results")
    with pytest.raises(KeyError):
        shelf.read("a")
    assert shelf.publish(spark.range(1), "a") == 1
    seen = []

    def write(n):
        return [shelf.publish(spark.range(n), "a") for _ in range(3)]

    def look(_):
        seen.extend(shelf.read("a").count() for _ in range(6))

    with ThreadPoolExecutor(3) as pool:
        reader = pool.submit(look, 0)
        versions = sorted(v for found in pool.map(write, (10, 20)) for v in found)
        reader.result()
    assert versions == [2, 3, 4, 5, 6, 7] and set(seen) <= {1, 10, 20}
    assert shelf.read("a", 1).count() == 1
    with pytest.raises(Conflict):
        shelf.publish(spark.range(5), "a", after=3)
    assert shelf.publish(spark.range(5), "a", after=7) == 8
    again = Snapshots(spark, f"file://{tmp_path}/results")  # as another session would
    again.forget("a", keep=2)
    assert again.versions("a") == [7, 8] and again.read("a").count() == 5
    assert shelf.publish(spark.range(0), "b") == 1 and shelf.read("b").count() == 0


def test_notebooks_among_other_files(spark, tmp_path):
    book = '{"cells": [{"cell_type": "code", "source": "[1, 2]"}, {"cell_type": "code", "source": []}, {"cell_type": "code"}, {"cell_type": "code", "source": ["%%sql\\n", "SELECT 1"]}], "nbformat": 4}'
    (tmp_path / "b c").mkdir()
    for name, content in (("x.txt", "no"), ("b c/y.IPYNB", book), ("z.ipynb", "{"), ("e.ipynb", '{"cells": []}'), ("a.scala", "//é"), ("noending", "x"), ("r.csv", "1")):
        (tmp_path / name).write_text(content)
    got = read_notebooks(spark, str(tmp_path)).orderBy("nb_ord").collect()
    assert [(r.nb_ord, r.name, r.language) for r in got] == [(0, "a.scala", "SCALA"), (1, "y.IPYNB", "PYTHON"), (2, "e.ipynb", "PYTHON")]
    assert got[0].source == "//é" and [(r.cell_index, r.language, r.source) for r in cells.cells(spark.createDataFrame(got)).where("nb_ord = 1").collect()] == [(0, "python", "[1, 2]"), (3, "python", "%%sql\nSELECT 1")]
    plan = spark.read.format("binaryFile").load(str(tmp_path)).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_answers_are_kept_and_late_ones_left_out(spark, tmp_path):
    store, asked = Snapshots(spark, f"file://{tmp_path}/kept"), []

    def explainer(messages):
        asked.append(messages[1]["content"])
        if "slow" in asked[-1]:
            time.sleep(60)
        if "bad" in asked[-1]:
            raise ValueError
        return f"answer to {asked[-1]}"

    prompts = spark.createDataFrame([(t, t) for t in ("one", "slow", "bad", "two", "one")], "prompt_hash string, prompt string")
    for _ in range(2):
        got = {r.prompt: r.answer for r in explained.answered(prompts, explainer, store, "s", limit=1.0).collect()}
        assert got == {"one": "answer to one", "two": "answer to two", "slow": None, "bad": None}
    assert sorted(asked) == ["bad", "bad", "one", "slow", "slow", "two"]  # what was answered isn't asked again


def test_questions_as_columns(spark, tmp_path):
    books = notebooks(spark, [("/1", "SQL", "INSERT INTO s.a SELECT * FROM b.src;SELECT 1 FROM a")])
    rows = spark.createDataFrame([("a", "x", "y", 1, 2, 1), ("none", "x", "y", 1, 2, 1)], "table_name string, from_stage string, to_stage string, from_count long, to_count long, difference long")
    answer = lambda messages: '{"responsibleIndex": 1, "explanation": "e"}'
    got = {r.table_name: r for r in explained.explained_mismatches(books, rows, answer, Snapshots(spark, f"file://{tmp_path}/a"), most=5).collect()}
    assert got["a"].responsible.snippet == "SELECT 1 FROM a" and got["a"].n_candidates == 2 and got["a"].explanation == "e"
    assert "[0] /1, cell 0\n<code>\nINSERT INTO s.a SELECT * FROM b.src\n</code>\n[1] /1" in got["a"].prompt
    assert got["none"].responsible is None and got["none"].prompt.endswith("Candidates:\nNo code was found.")


def test_writers_read_only_cells_that_name_the_table(spark, monkeypatch):
    seen, read = [], lineage.read
    monkeypatch.setattr(lineage, "read", lambda rows: (seen.extend(r.raw_sql for r in rows.select("raw_sql").collect()), read(rows))[1])
    books = notebooks(spark, [("/a", "SQL", "-- Databricks notebook source\nINSERT INTO silver.orders SELECT 1\n-- COMMAND ----------\nINSERT INTO silver.other SELECT 2")])
    assert [(r.cell_index, r.snippet) for r in lineage.writers(books, "main", "silver", "orders").collect()] == [(0, "INSERT INTO silver.orders SELECT 1")]
    assert seen == ["INSERT INTO silver.orders SELECT 1"]


def test_a_frame_gives_way_to_a_statement_that_does_not_name_the_source(spark):
    cell = 'spark.sql("CREATE TABLE gold.x AS SELECT 1 AS a")\nspark.table("silver.orders").write.saveAsTable("gold.x")'
    assert lineage.fan_out(notebooks(spark, [("/a", "PYTHON", cell)]), "silver.orders").count() == 0


def test_code_is_cut_once(spark):
    """However often its cells, statements and facts are read, a notebook's text is computed once."""
    runs = spark.sparkContext.accumulator(0)

    def counted(s):
        runs.add(1)
        return s

    books = notebooks(spark, [("/a", "SQL", "INSERT INTO silver.orders SELECT 1; SELECT 2")])
    books = books.withColumn("source", F.udf(counted, "string").asNondeterministic()("source"))
    for n, facts_of in enumerate((lineage.lineage_facts, sqlfacts.sql_facts), 1):
        facts = facts_of(books)
        assert facts.count() == len(facts.collect()) == 2
        assert runs.value == n
