"""Secret scans by a trigram inverted index; DataFrame functions only.

Each rule's regex is turned into a Boolean query over trigrams of the lower-cased text. Only trigrams that
some query names are indexed: a posting is (shard, trigram) -> row keys. Intersecting and uniting postings
gives each rule's candidate rows; only these are matched against the rule. Rules without mandatory
trigrams scan every row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser as sre_parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed_row, small, stored, unpacked


@dataclass(frozen=True)
class Rule:
    """kind: its name in spans; pattern: a regex that Java and Python read alike.

    Matches are leftmost and do not overlap; a match whose `group` is shorter than `least` is dropped.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: In the order that ties of spans are listed in. The first three are the base rules.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 20),
    Rule("url_login", r"[a-z]{3,9}://[A-Za-z0-9._-]{1,64}:[^\x20\x09-\x0D@/:]{3,64}@", 0, 10),
)
BASE = ("assign", "access", "hex")

#: A query is None (every row) or an OR of ANDs: a set of sets of trigrams.
Query = frozenset | None
_MANY = 64  # alternatives followed before a sub-expression counts as unknown


def trigram_query(pattern: str) -> Query:
    """The trigrams that the lower-cased text of any match must hold.

    The parsed regex is walked left to right with the set of literal strings that the current run may be.
    Where the next part is not a small choice of literals, each run gives the AND of its trigrams, the
    choice between runs an OR, and the run starts again.
    """
    queries: list[Query] = []

    def flush(runs: set[str]) -> None:
        terms = [frozenset(r[i : i + 3] for i in range(len(r) - 2)) for r in runs]
        if terms and all(terms):
            queries.append(frozenset(terms))

    def choices(op, arg) -> set[str] | None:
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN:
            out: set[str] = set()
            for kind, x in arg:
                if kind is sre.LITERAL:
                    out.add(chr(x).lower())
                elif kind is sre.RANGE and x[1] - x[0] < 8:
                    out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
            return out if len(out) <= 8 else None
        if op is sre.SUBPATTERN:
            return sequence(arg[3])
        if op is sre.BRANCH:
            parts = [sequence(x) for x in arg[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if op is sre.MAX_REPEAT:
            low, high, body = arg
            inner = sequence(body)
            if inner is None or high is sre.MAXREPEAT or high > 3:
                return None
            out, power = set(), {""}
            for n in range(high + 1):
                if n >= low:
                    out |= power
                power = {a + b for a in power for b in inner}
            return out if len(out) <= _MANY else None
        return None

    def sequence(items) -> set[str] | None:
        out = {""}
        for op, arg in items:
            more = choices(op, arg)
            if more is None or len(out) * len(more) > _MANY:
                return None
            out = {a + b for a in out for b in more}
        return out

    def walk(items, runs: set[str]) -> set[str]:
        for op, arg in items:
            more = choices(op, arg)
            if more is not None and len(runs) * len(more) <= _MANY:
                runs = {a + b for a in runs for b in more}
                continue
            flush(runs)
            runs = {""}
            if op is sre.SUBPATTERN:
                runs = walk(arg[3], {""})
            elif op is sre.MAX_REPEAT and arg[0] >= 1:  # at least once: what it must hold is mandatory
                flush(walk(arg[2], {""}))
        return runs

    flush(walk(sre_parse.parse(pattern), {""}))
    if not queries:
        return None

    def product(a: frozenset, b: frozenset) -> frozenset:
        return frozenset(x | y for x in a for y in b) if len(a) * len(b) <= _MANY else a

    terms = reduce(product, queries)
    return frozenset(t for t in terms if not any(o < t for o in terms))  # a wider AND adds nothing


def matches(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, kind>> in code points, of all matches that are long enough.

    The pieces between matches and the matches themselves add up to the text, which gives the places.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    tested = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    steps = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), tested.alias("core"))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(rule.kind).alias("kind")))
        keep = F.when(F.length(x["core"]) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"])
        return F.struct(end.cast("int").alias("at"), keep.alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def candidates(docs: DataFrame, rules, shard_rows: int = 4096) -> DataFrame:
    """docs(_key, text) -> (_key, _rules): for each row that some indexed rule may match, the rules' places.

    Equal keys may stand for several rows: a posting then holds what any of them has, so no row is lost.
    """
    asked = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    grams = sorted({g for q in asked.values() for terms in q for g in terms})
    spark = docs.sparkSession
    if not grams:
        return spark.createDataFrame([], "_key long, _rules array<int>")
    # A row's trigrams are bits of as few longs as hold them. Stored before they are filtered: a filter would
    # move below the projection, and every text would be searched twice.
    words = [grams[at : at + 64] for at in range(0, len(grams), 64)]
    low = docs.select("_key", F.lower("text").alias("low"))
    bit = lambda g, i: F.shiftleft(F.contains("low", F.lit(g)).cast("long"), i)
    bits = [reduce(Column.bitwiseOR, [bit(g, i) for i, g in enumerate(word)]).alias(f"bits{n}") for n, word in enumerate(words)]
    rows = stored(low.select("_key", *bits), "trigrams").where(reduce(Column.__or__, [F.col(f"bits{n}") != 0 for n in range(len(words))]))
    set_in = lambda n: lambda i: F.getbit(f"bits{n}", i - 64 * n) == 1
    held = F.concat(*[F.filter(F.sequence(F.lit(64 * n), F.lit(64 * n + len(word) - 1)), set_in(n)) for n, word in enumerate(words)])
    shards = max(1, rows.count() // shard_rows)
    postings = (
        rows.select(F.pmod(F.xxhash64("_key"), F.lit(shards)).alias("shard"), F.explode(held).alias("gram"), "_key")
        .groupBy("shard", "gram")
        .agg(F.sort_array(F.collect_set("_key")).alias("keys"))  # a shard holds about shard_rows keys
    )
    by_gram = postings.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("index"))
    empty = F.array().cast("array<bigint>")
    post = lambda g: F.coalesce(F.element_at("index", F.lit(grams.index(g))), empty)

    def of(query) -> Column:
        both = [reduce(F.array_intersect, [post(g) for g in sorted(terms)]) for terms in sorted(query, key=sorted)]
        return reduce(F.array_union, both)

    def tagged(rule: int, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(k.alias("_key"), F.lit(rule).alias("rule")))

    hits = F.concat(*[tagged(i, of(q)) for i, q in asked.items()])
    return by_gram.select(F.explode(hits).alias("h")).groupBy("h._key").agg(F.sort_array(F.collect_set("h.rule")).alias("_rules"))


def scan(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds _spans, array<struct<start, end, kind>> by start and then the rules' order, to every row of docs.

    A null text counts as empty and gives no spans. Null or repeated keys are no problem: rows are told
    apart by a hash of key and text, and rows that share one are verified each on its own text. An empty
    table gives an empty table. All columns pass through; one named _spans is replaced.
    """
    columns = docs.columns
    rows = docs.select(packed_row(docs), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.xxhash64(F.col(key), F.col(text)).alias("_key"))
    found = stored(candidates(rows.select("_key", F.col("_text").alias("text")), rules), "candidates")
    n = found.count()
    rows = rows.join(small(found, n, 64), "_key", "left")
    order = {r.kind: i for i, r in enumerate(rules)}
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    parts = []
    for i, r in enumerate(rules):
        if trigram_query(r.pattern) is None:
            test = F.col("_text").rlike(r.pattern)  # a scan of every row; most end here
        else:
            test = F.array_contains(F.coalesce(F.col("_rules"), F.array().cast("array<int>")), i)
        parts.append(F.when(test, matches(F.col("_text"), r)).otherwise(none))
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    keyed = F.transform(F.concat(*parts), lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("at"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.transform(F.sort_array(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return unpacked(rows.withColumn("_spans", spans), columns, "_spans")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(scanned: DataFrame, text: str = "text") -> DataFrame:
    """Replaces every span's characters by [kind]; where spans overlap, by the first's.

    Null texts without spans stay null.
    """
    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    # the last argument is longer than any rest
    clean = F.concat(done["out"], F.substring(F.col(text), done["at"] + 1, F.length(text)))
    return scanned.withColumn(text, F.when(F.size("_spans") > 0, clean).otherwise(F.col(text)))
