"""Quality rules kept as a bitmask ledger.

Each document's rules are evaluated once. The ledger holds the measurements and one integer of failure
bits; policies are sets of rules with a version, applied to the ledger without touching texts again, and
ablations (what a policy would drop without one of its rules) come from bitwise aggregation.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_alpha_words", "n_stutters")


def repeated_words(found: list[str], size: int = WINDOW) -> int:
    """Words inside windows of `size` words that occur at least twice in the text, the first time included."""
    if len(found) < size + 1:
        return 0
    windows = list(zip(*(found[i:] for i in range(size))))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, covered = 0, 0  # covered: words before this place are counted
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + size - max(covered, i)
            covered = i + size
    return total


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text; a null text counts as empty."""
    text = text or ""
    found = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    return (
        len(found),
        sum(map(len, found)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(found),
        len(lines),
        sum(w.isupper() for w in found),
        sum(w[0].isalpha() for w in found),
        sum(map(eq, found, found[1:])),
    )


@dataclass(frozen=True)
class Rule:
    """fails: an SQL condition on MEASURES that is true for documents which fail. Its bit is its place in RULES."""

    name: str
    fails: str


#: Bits never change their meaning: new rules are appended.
RULES = (
    Rule("too_few_words", "n_words < 10"),
    Rule("repeats", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "n_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("long_words", "word_chars > 25 * n_words"),
    Rule("shouting", "10 * n_upper_words > 5 * n_words"),
    Rule("not_prose", "10 * n_alpha_words < 5 * n_words"),
    Rule("short_words", "2 * word_chars < 3 * n_words"),
    Rule("stutters", "10 * n_stutters > 3 * n_words"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}

#: Policies by version. A document is kept if it fails none of the policy's rules.
POLICIES = {
    "base-1": ("too_few_words", "repeats"),
    "prose-1": tuple(r.name for r in RULES),
}


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs -> (key, MEASURES..., failures): one row a row, in one pass without a shuffle.

    Null texts count as empty (and fail too_few_words); null and repeated keys pass through; an empty table
    gives an empty ledger. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t) for t in b.column(1).to_pylist()]
            columns = zip(*rows) if rows else [[] for _ in MEASURES]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["key", *MEASURES])

    measured = chosen.mapInArrow(run, f"key {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = sum((F.when(F.expr(r.fails), F.lit(BIT[r.name])).otherwise(0) for r in RULES), F.lit(0))
    return measured.withColumn("failures", bits.cast("long")).withColumnRenamed("key", key)


def kept(policy: str):
    """Whether a ledger row passes the policy."""
    return F.col("failures").bitwiseAND(mask(policy)) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """ledger -> (rule, failed, only, kept_without): per rule of the policy, how many rows fail it, how many fail
    nothing else of the policy, and how many the policy would keep without it.

    Rows are first counted by their failure bits, so at most 2^rules counts are looked at.
    """
    m = mask(policy)
    counts = rows.groupBy(F.col("failures").bitwiseAND(m).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = counts.select("bits", "n", F.explode(rules).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    zero = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        zero(hit).alias("failed"), zero(F.col("bits") == F.col("r.bit")).alias("only"), zero((F.col("bits") == 0) | (F.col("bits") == F.col("r.bit"))).alias("kept_without")
    )
