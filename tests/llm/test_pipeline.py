"""The corpus pipeline, stage by stage, on the smallest tables."""

import corpus_pipeline
from layerwise.llm import quality, registry

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(d.columns == columns for d in seen[:-1])
    start, good, unique, clean, mixed, pieces = seen

    scores = quality.score(start, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in scores.where("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == kept

    texts = {r.doc_id: r.text for r in good.collect()}
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    left = {r.doc_id for r in unique.collect()}
    like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert not any(like(a, b) for a in left for b in left if a < b)
    assert all(any(like(a, b) for b in texts if b < a) for a in texts if a not in left)

    assert clean.count() == unique.count() and clean.where("text rlike '[0-9a-f]{24}' or text rlike 'AKIA[A-Z0-9]{16}'").count() == 0
    sizes = {r.doc_id: len((r.text or "").split()) for r in clean.collect()}
    taken = {}
    for r in mixed.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    assert all(n <= 3 * sizes[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - sum(sizes.values())) <= 25
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in mixed.select("doc_id").distinct().collect()}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _size long, _copy string, _taken int, _spans string, _row long, _original string"


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, and columns with the names of the stages' own."""
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [(None, None, None, None), (1, None, "en", "a"), (2, "", "en", "a"), (3, "plain words of a text that is kept", "en", None), (3, "plain words of a text that is kept", "en", None), (4, long, "de", "b"), (None, "token = abcdef123456 here", None, "b")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 7, "c", 8, "s", 9, "o") for r in rows], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[1:]:  # the first drops what its classifier rejects
        for kind, frame in (("rows", docs), ("none", docs.limit(0))):
            stage(spark, frame, SF).write.parquet(f"{tmp_path}/{name}-{kind}")
            got = spark.read.parquet(f"{tmp_path}/{name}-{kind}")
            assert (got.count() > 0) == (kind == "rows"), name
            if name != "packing":
                assert got.columns == docs.columns
                left = {c: {r[c] for r in got.collect()} for c in ("_size", "_copy", "_taken", "_spans", "_row", "_original")}
                assert kind == "none" or left == {"_size": {7}, "_copy": {"c"}, "_taken": {8}, "_spans": {"s"}, "_row": {9}, "_original": {"o"}}, name
    rejected = corpus_pipeline.quality_stage(spark, docs, SF)
    assert rejected.columns == docs.columns and rejected.count() <= len(rows)


def test_every_operator_has_a_query():
    assert [name.split("_")[0] for name in registry.QUERIES if name.startswith("op")] == [f"op{n}" for n in range(1, 14)]
