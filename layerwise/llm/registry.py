"""The queries over the synthetic tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, identifiers, jaccard, language, mixing, neighbours, packing, prefixes, quality, rules, scoring, secrets, toxicity
from .common import documents


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir).select("doc_id", "text")).drop("_row", "keep")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by its text, and every page by its visible text, markup and address."""
    docs, pages = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/pages.parquet")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = docs.select("doc_id", none("long", "page_id"), "text", none("string", "html"), none("string", "url")).unionByName(
        pages.select(none("long", "doc_id"), "page_id", none("string", "text"), F.coalesce("html", F.lit("")).alias("html"), "url")
    )
    return language.fused(rows, language.trained(docs.select("doc_id", "text", "lang")), ["doc_id", "page_id"])


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir).select("doc_id", "text"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mixing.mix(docs).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken")
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7') AS o,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
-- Sources in order of cap over weight: those before some place are capped, the others share what is left.
r AS (SELECT *, 3.0 * source_size / weight AS full_at,
        coalesce(sum(3.0 * source_size) OVER p, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS open_weight,
        sum(source_size) OVER () AS total
      FROM w WINDOW p AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (total - capped) / open_weight AS level FROM r WHERE (total - capped) / open_weight <= full_at ORDER BY full_at, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(CAST(weight * level AS DOUBLE), CAST(3.0 * source_size AS DOUBLE)) AS target FROM w, l),
u AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole FROM t),
v AS (SELECT *, CAST(round(target - whole * source_size) AS BIGINT) AS want FROM u),
x AS (SELECT d.doc_id, d.size, v.source_size, v.target, v.whole, v.want,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, want - before)) AS BIGINT) AS taken
FROM x
"""

def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("_spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *[count(k) for k in secrets.BASE], F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("_spans")).alias("spans"))


def _op7_sql() -> str:
    parts, unions = [], []
    for i, r in enumerate(secrets.RULES):
        pattern = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(
            f"r{i} AS (SELECT rid, unnest(range(1, len(hit) + 1)) AS k, hit, core, gap FROM (SELECT rid, regexp_extract_all(t, {pattern}) AS hit,"
            f" regexp_extract_all(t, {pattern}, {r.group}) AS core, regexp_split_to_array(t, {pattern}) AS gap FROM d))"
        )
        unions.append(
            f"SELECT rid, {i} AS place, '{r.kind}' AS kind, list_sum([len(x) for x in gap[1:k]]) + coalesce(list_sum([len(x) for x in hit[1:k-1]]), 0) AS s,"
            f" list_sum([len(x) for x in gap[1:k]]) + list_sum([len(x) for x in hit[1:k]]) AS e FROM r{i} WHERE len(core[k]) >= {r.least}"
        )
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), " + ", ".join(parts) + ", m AS (" + " UNION ALL ".join(unions) + "),"
        " g AS (SELECT rid, count(*) FILTER (WHERE place = 0) AS n_assign, count(*) FILTER (WHERE place = 1) AS n_access, count(*) FILTER (WHERE place = 2) AS n_hex,"
        " string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR), ',' ORDER BY s, place) AS spans,"
        " string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR), ',' ORDER BY s, place) FILTER (WHERE place < 3) AS base FROM m GROUP BY rid)"
        " SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans"
        " FROM d LEFT JOIN g USING (rid)"
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.ledger(documents(spark, sf_dir))
    base = [m for m in rules.MEASURES if m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select("doc_id", *base, (~rules.kept("base-1")).alias("base_failed"), (rules.kept("base-1") & rules.kept("prose-1")).alias("kept"), "failures")


def _op8_sql() -> str:
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {rules.BIT[r.name]} ELSE 0 END" for r in rules.RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i:i+4] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
h AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM h) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
        len(list_filter(ws, lambda x: upper(x) = x AND lower(x) <> x)) AS n_upper_words, len(list_filter(ws, lambda x: regexp_matches(x, '^\p{{L}}'))) AS n_alpha_words,
        len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS n_stutters
      FROM w LEFT JOIN c USING (rid)),
f AS (SELECT *, CAST({bits} AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & {rules.mask("base-1")} <> 0 AS base_failed,
       failures & {rules.mask("base-1") | rules.mask("prose-1")} = 0 AS kept, failures FROM f"""


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of a policy drops, drops alone, and what the policy would keep without it."""
    return rules.ablation(rules.ledger(documents(spark, sf_dir)), "prose-1")


def _ablation_sql() -> str:
    m, names = rules.mask("prose-1"), rules.POLICIES["prose-1"]
    listed = ", ".join(f"('{n}', {rules.BIT[n]})" for n in names)
    return (
        f"WITH l AS ({_op8_sql()}), b AS (SELECT failures & {m} AS bits FROM l) SELECT rule, count(*) FILTER (WHERE bits & bit <> 0) AS failed, count(*) FILTER (WHERE bits = bit) AS only,"
        f" count(*) FILTER (WHERE bits = 0 OR bits = bit) AS kept_without FROM b, (VALUES {listed}) AS r(rule, bit) GROUP BY rule"
    )


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("place", "last_place")


# crc32 of an ASCII text, bit by bit.
_CRC = (
    "xor(list_reduce(list_concat([4294967295], list_transform(string_split({x}, ''), lambda ch: ord(ch))), lambda c, b:"
    " list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)), 4294967295)"
)
OP11_SQL = rf"""
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) - 1 AS pos FROM o),
n AS (SELECT c, c - c % {prefixes.STRIDE} AS base, {_CRC.format(x="CAST(c AS VARCHAR)")} % {prefixes.HEADS} AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT n.c, 0 AS part, t.pos, t.role, t.text FROM n JOIN t ON t.c = n.base AND t.pos < n.h UNION ALL SELECT n.c, 1, t.pos, t.role, t.text FROM n JOIN t ON t.c = n.c AND t.pos >= n.h),
p AS (SELECT n.c, coalesce(list([r.role, r.text] ORDER BY r.part, r.pos) FILTER (WHERE r.pos IS NOT NULL), []) AS path FROM n LEFT JOIN r ON r.c = n.c GROUP BY n.c),
m AS (SELECT c, d, path[1:d] AS pre, len(path) = d AS ends FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM p)),
g AS (SELECT pre, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256,
        CASE WHEN d > 0 THEN len(regexp_extract_all(pre[d][2], '[^ 	-
]+')) ELSE 0 END AS words FROM m GROUP BY pre, d),
k AS (SELECT pre[1:d - 1] AS pre, d - 1 AS d, count(*) AS n FROM g WHERE d > 0 GROUP BY ALL),
f AS (SELECT g.*, coalesce(k.n, 0) AS n_children FROM g LEFT JOIN k ON k.pre = g.pre AND k.d = g.d),
s AS (SELECT a.pre, a.d, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.words) AS BIGINT) AS saved_tokens FROM f a JOIN f b ON b.d >= a.d AND b.pre[1:a.d] = a.pre GROUP BY a.pre, a.d)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM f JOIN s ON s.pre = f.pre AND s.d = f.d LEFT JOIN f u ON u.d = f.d - 1 AND u.pre = f.pre[1:f.d - 1]"""


def op12_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identifiers.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = [k.name for k in identifiers.BASE]
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.filter("_spans", lambda s: s["kind"].isin(*base))
    return found.select("doc_id", *map(count, base), F.sha2(secrets.joined(spans), 256).alias("base_sha256"), secrets.joined(F.col("_spans")).alias("spans"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return centroids.summed(found).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op13_sql() -> str:
    c = centroids
    places = f"range(1, {c.DIM + 1})"
    away = f"list_sum(list_transform({places}, lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])))"
    parts = [
        f"q AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({c.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        f" WHERE len(embedding) = {c.DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{c.SEED}:' || vec_id), v) - 1 AS c, v FROM q ORDER BY sha256('{c.SEED}:' || vec_id) NULLS LAST, v LIMIT {c.K})",
    ]
    for r in range(c.ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, min((d, c)) AS z FROM (SELECT q.rid, c.c, {away} AS d FROM q, c{r} c) GROUP BY rid)")
        if r < c.ROUNDS:
            parts.append(
                f"c{r + 1} AS MATERIALIZED (SELECT p.c, coalesce(n.v, p.v) AS v FROM c{r} p LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM"
                f" (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.z[2] AS c, unnest({places}) AS i, unnest(q.v) AS x FROM a{r} a JOIN q ON q.rid = a.rid) GROUP BY c, i) GROUP BY c) n ON n.c = p.c)"
            )
    last = c.ROUNDS
    return (
        "WITH " + ", ".join(parts) + f" SELECT q.vec_id, CAST(a.z[2] AS INT) AS cluster, CAST(a.z[1] AS BIGINT) AS distance, CAST(sum(a.z[1]) OVER (PARTITION BY a.z[2]) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(a.z[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.v, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256 FROM q JOIN a{last} a ON a.rid = q.rid JOIN c{last} c ON c.c = a.z[2]"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_secrets": op7_secrets,
    "op8_quality_rules": op8_quality_rules,
    "quality_rule_ablations": quality_rule_ablations,
    "op9_nearest": op9_nearest,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_identifiers": op12_identifiers,
    "op13_centroids": op13_centroids,
}
ORACLE_SQL: dict[str, str] = {"op6_mixing": OP6_SQL, "op7_secrets": _op7_sql(), "op8_quality_rules": _op8_sql(), "quality_rule_ablations": _ablation_sql(), "op11_prefix_trie": OP11_SQL, "op13_centroids": _op13_sql()}
