"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the words that follows its weight, but never more than `epochs` times its
own words; what a capped source can't use is shared again among the others by weight until none is above
its cap. Each document is then repeated whole floor(rate) times, and the rest of the source's target is
filled with one more repetition of documents in a seeded order; the last of these is a fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, packed_row, small, stored, unpacked

#: Buckets of the seeded order within a source. Only the one bucket that the target falls into is ordered row by row.
BUCKETS = 4096
#: The columns that mix() adds.
OWN = ("_size", "_source_size", "_target", "_reps", "_part", "_taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame, by: str) -> DataFrame:
    """Adds `rank`, from 0, in order of `by` (nulls last), without bringing the rows into one task."""
    ordered = stored(sources.orderBy(F.col(by).asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    counts = sorted(ordered.groupBy(part.alias("p")).count().collect())  # a row for each sort partition
    before, total = {}, 0
    for p, n in counts:
        before[p] = total
        total += n
    offsets = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]) if before else F.lit(None)
    return ordered.withColumn("rank", offsets[part] + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at") if before else ordered.withColumn("rank", F.lit(0).cast("long")).drop("_at")


def water_fill(sources: DataFrame, epochs: float) -> DataFrame:
    """sources(source, source_size, weight) -> with target: the words each source gets.

    The level (words for each unit of weight) is raised round by round, each an aggregation; only two sums
    come to the driver. A source under its cap gets level * weight.
    """
    cap = F.col("source_size") * F.lit(float(epochs))
    total, weights = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level, clamped = (total / weights if weights else 0.0), -1
    while True:
        full = F.col("weight") * F.lit(level) >= cap
        n, used, free = sources.agg(
            F.coalesce(F.sum(full.cast("long")), F.lit(0)),
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == clamped or not free:
            break
        clamped, level = n, (total - used) / free
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def mix(docs: DataFrame, epochs: float = 3.0, weights=(1.0, 2.0, 3.0), seed: int = 7) -> DataFrame:
    """docs(doc_id, source, text, ...) -> docs with _size, _source_size, _target, _reps, _part, _taken.

    _reps: whole repetitions; _part: words of one more, partial repetition (less than _size); _taken: words in all.
    Sources go by code point, null last (a null source is a source of its own), and weigh `weights` in turn.
    A null or empty text has size 0 and takes nothing. Equal rows share one place in the seeded order and are
    told apart arbitrarily, which leaves the result as a set of rows the same. An empty table gives no rows.
    All columns pass through but those named as in OWN, which are replaced.
    """
    columns = docs.columns
    docs = docs.select(packed_row(docs), F.col("doc_id").alias("_id"), F.col("source").alias("source"), word_count(F.col("text")).alias("_size"))
    order = F.md5(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    docs = docs.withColumn("_order", order).withColumn("_bucket", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int"))
    sums = stored(docs.groupBy("source", "_bucket").agg(F.sum("_size").alias("words")), "bucket-sums")
    per = ranked(sums.groupBy("source").agg(F.sum("words").alias("source_size")), "source")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    per = stored(water_fill(per.withColumn("weight", turn), epochs), "targets")
    n_sources = per.count()

    # The words of whole repetitions, then those still wanted from the seeded order.
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(epochs)))).otherwise(0)
    per = per.withColumn("whole", whole.cast("long")).withColumn("want", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    at = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        sums.withColumn("before", F.coalesce(F.sum("words").over(at), F.lit(0)))  # at most BUCKETS rows a source
        .withColumnRenamed("source", "s")
        .join(small(per, n_sources, 64), F.col("s").eqNullSafe(F.col("source")))
        .where((F.col("before") <= F.col("want")) & (F.col("before") + F.col("words") > F.col("want")))
        .select("s", F.col("_bucket").alias("edge"), F.col("before").alias("edge_before"))
    )
    per = stored(
        per.join(edges, F.col("source").eqNullSafe(F.col("s")), "left")
        .select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "whole", "want", "edge", "edge_before"),
        "plan",
    )
    docs = docs.join(small(per, n_sources, 128), F.col("source").eqNullSafe(F.col("_source")))
    inside = docs.where(~F.coalesce(F.col("_bucket") == F.col("edge"), F.lit(False)))
    # Without an edge bucket the wanted words are all of the source's words.
    extra = F.when(F.col("edge").isNull() & (F.col("want") > 0), F.col("_size")).when(F.col("_bucket") < F.col("edge"), F.col("_size")).otherwise(0)
    inside = inside.withColumn("_extra", extra.cast("long"))
    running = Window.partitionBy("_source").orderBy("_order", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    edge = docs.where(F.col("_bucket") == F.col("edge"))
    edge = edge.withColumn("_before", F.col("edge_before") + F.coalesce(F.sum("_size").over(running), F.lit(0)))
    edge = edge.withColumn("_extra", F.greatest(F.lit(0), F.least(F.col("_size"), F.col("want") - F.col("_before"))).cast("long")).drop("_before")
    both = inside.unionByName(edge)
    full = (F.col("_extra") == F.col("_size")) & (F.col("_size") > 0)
    both = (
        both.withColumn("_reps", F.col("whole") + full.cast("long"))
        .withColumn("_part", F.when(full, F.lit(0)).otherwise(F.col("_extra")).cast("long"))
        .withColumn("_taken", F.col("whole") * F.col("_size") + F.col("_extra"))
    )
    return unpacked(both, columns, *OWN)


def repeated(mixed: DataFrame) -> DataFrame:
    """The mixed corpus itself: whole documents as often as they repeat, and the first words of partial ones."""
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("_part").cast("int")), "")
    rows = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_reps"))))  # 0: the partial repetition
    rows = rows.where((F.col("_copy") > 0) | (F.col("_part") > 0))
    rows = rows.withColumn("text", F.when(F.col("_copy") == 0, cut).otherwise(F.col("text")))
    return rows.drop(*OWN, "_copy")
