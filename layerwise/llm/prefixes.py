"""The trie of conversations' prefixes, as preorder intervals over distributed prefix sums.

No trie is ever built in memory. Conversations get a number in the lexicographic order of their turns; a node is
a distinct prefix, which spans the conversations from its first to its last member. In the order of (first
member, depth) nodes lie in preorder, and a node's subtree ends at the last node that its last member is the first
of. So once nodes have places, everything that is summed over a subtree is the difference of two running sums.

Texts are read once: what is shuffled is a turn's digest and its number of words. A table is numbered by sorting
it into ranges and adding up the ranges' sizes, a running sum by adding up the ranges' sums, so that neither a
long conversation nor a common prefix has to fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stored

STRIDE = 20  # conversations that share a first one
HEADS = 4  # a conversation takes over fewer turns than this
BLOCK = 64  # turns, or names of blocks, that one row of the ranking holds
CHUNK = 1024  # turns of a conversation that are summed in one window
_KEY = ["k0", "k1", "k2", "k3"]
_PARENT = ["p0", "p1", "p2", "p3"]


def laid_out(df: DataFrame, label: str, *order) -> DataFrame:
    """df, stored in ranges of an order, with `_g`: a number that grows with it; the range is _g >> 33.

    Rows that are equal in the order would all be in one range: the last key tells them apart.
    """
    tie = F.monotonically_increasing_id()
    out = df.withColumn("_tie", tie).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    return stored(out.withColumn("_g", F.monotonically_increasing_id()), label)


def running(rows: DataFrame, **sums: Column) -> DataFrame:
    """laid-out rows -> with each sum over all rows up to and including the own one."""
    rows = rows.withColumn("_range", F.shiftright("_g", 33)).withColumns({f"_{n}": c.cast("long") for n, c in sums.items()})
    totals = rows.groupBy("_range").agg(*[F.sum(f"_{n}").alias(n) for n in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = totals.select("_range", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({n: F.sum(f"_{n}").over(inside) for n in sums}).join(F.broadcast(totals), "_range")  # as many rows as ranges
    return out.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in sums}).drop("_range", *[f"_{n}" for n in sums], *[f"_before_{n}" for n in sums])


def ordered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conversations -> (conv, pos, digest, words): a conversation's turns from 0, by turn with null first, then by digest.

    Null roles and texts are empty. Rows without a conversation's id take no part. Repeated rows are turns of
    their own.
    """
    col = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    # The role's length before it keeps role and text apart.
    digest = F.md5(F.concat(F.length(col(role)).cast("string"), F.lit(":"), col(role), col(text)))
    words = F.size(F.regexp_extract_all(col(text), F.lit(WORD), F.lit(0))).cast("long")
    rows = conversations.where(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), words.alias("words"))
    rows = running(laid_out(rows, "turns", "conv", F.asc_nulls_first("turn"), "digest"), at=F.lit(1))
    first = rows.groupBy("conv").agg(F.min("at").alias("first"))
    return rows.join(first, "conv").select("conv", (F.col("at") - F.col("first")).alias("pos"), "digest", "words")


def rebuilt(turns: DataFrame, stride: int = STRIDE, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(convs(conv, n), turns(conv, pos, digest, words)) with each conversation c starting as conversation c - c % stride.

    It takes over that one's first h turns, h = crc32(c in decimal) % heads, all if there are fewer, and then has
    its own after its first h.
    """
    sizes = stored(turns.groupBy("conv").agg(F.count("*").alias("size")), "conversations")
    h = F.crc32(F.col("conv").cast("string")) % heads
    convs = sizes.select("conv", "size", (F.col("conv") - F.col("conv") % stride).alias("base"), h.alias("h"))
    of_base = sizes.select(F.col("conv").alias("base"), F.col("size").alias("base_size"))
    convs = convs.join(of_base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_size", F.lit(0))))
    convs = stored(convs.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("n")), "rebuilt-conversations")
    own = turns.join(convs.select("conv", "h", "taken"), "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words")
    heads_of = turns.where(F.col("pos") < heads - 1).withColumnRenamed("conv", "base")
    copied = convs.where("taken > 0").select("conv", "base", "taken").join(heads_of, "base").where("pos < taken").select("conv", "pos", "digest", "words")
    return convs.select("conv", "n"), own.unionByName(copied)


def ranked(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """turns(conv, pos, digest) -> (conv, r): numbers in the lexicographic order of the turns' digests; equal ones are equal.

    A prefix comes before what it is a prefix of. Blocks of turns get names in their order, blocks of names get
    names, and so on, until a conversation is one block: no row holds more than `block` of either.
    """
    def blocks(rows: DataFrame) -> DataFrame:
        inside = F.sort_array(F.collect_list(F.struct("pos", "name")))
        return rows.groupBy("conv", F.floor(F.col("pos") / block).cast("long").alias("pos")).agg(F.array_join(inside["name"], "").alias("key"))

    rows = turns.select("conv", "pos", F.col("digest").alias("name"))
    while True:
        rows = stored(blocks(rows), "prefix-blocks")
        named = laid_out(rows.select("key").distinct(), "prefix-names", "key")
        rows = rows.join(named, "key")
        longest = rows.agg(F.max("pos")).first()[0]
        if not longest:
            return rows.select("conv", F.col("_g").alias("r"))
        rows = rows.select("conv", "pos", F.lpad(F.hex("_g"), 16, "0").alias("name"))


def _keyed(turns: DataFrame) -> DataFrame:
    """turns -> with 128 bits for the prefix that ends with each turn, and those of the prefix before it.

    A prefix's bits are sums of hashes of its (place, digest)s, by windows over chunks and one over the chunks' sums.
    """
    bits = [F.xxhash64(F.lit(seed), "pos", "digest") for seed in (11, 12)]
    terms = [x for b in bits for x in (F.shiftrightunsigned(b, 32), b.bitwiseAND(F.lit(0xFFFFFFFF)))]
    rows = turns.withColumn("chunk", F.floor(F.col("pos") / CHUNK)).withColumns({f"t{i}": t for i, t in enumerate(terms)})
    inside = Window.partitionBy("conv", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"s{i}": F.sum(f"t{i}").over(inside) for i in range(4)})
    sums = turns.withColumn("chunk", F.floor(F.col("pos") / CHUNK)).withColumns({f"t{i}": t for i, t in enumerate(terms)})
    sums = sums.groupBy("conv", "chunk").agg(*[F.sum(f"t{i}").alias(f"c{i}") for i in range(4)])
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv", "chunk", *[F.coalesce(F.sum(f"c{i}").over(before), F.lit(0)).alias(f"b{i}") for i in range(4)])
    rows = rows.join(sums, ["conv", "chunk"])
    key = [(F.col(f"s{i}") + F.col(f"b{i}")).alias(f"k{i}") for i in range(4)]
    parent = [(F.col(f"s{i}") + F.col(f"b{i}") - F.col(f"t{i}")).alias(f"p{i}") for i in range(4)]
    return rows.select("conv", (F.col("pos") + 1).alias("depth"), "words", *key, *parent)


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, conv) in order -> (place, seq, ids): runs of one place as comma-joined text."""
    seq = 0
    for b in batches:
        if not b.num_rows:
            continue
        place, conv = b.column(0).to_numpy(), b.column(1).cast(pa.string()).to_pylist()
        starts = [0, *((place[1:] != place[:-1]).nonzero()[0] + 1).tolist(), len(conv)]
        runs = list(zip(starts, starts[1:], strict=False))
        yield pa.RecordBatch.from_arrays([pa.array([int(place[a]) for a, _ in runs]), pa.array(range(seq, seq + len(runs)), pa.int64()), pa.array([",".join(conv[a:z]) for a, z in runs])], ["place", "seq", "ids"])
        seq += len(runs)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, ids) in order -> (place, sha256) of each place's texts, comma-joined; one text at a time."""
    at, state = None, None
    for b in batches:
        done: list[tuple[int, str]] = []
        for place, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if place == at:
                state.update(b",")
            else:
                if state:
                    done.append((at, state.hexdigest()))
                at, state = place, hashlib.sha256()
            state.update(ids.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], ["place", "sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([state.hexdigest()])], ["place", "sha256"])


def _ends(members: DataFrame) -> DataFrame:
    """(place, conv) -> (place, sha256) of the convs in ascending order, comma-joined.

    Ranges of the order are joined first; a place's texts are then hashed one after the other, which SHA-256 can
    only do in one task, but for a common place that task reads one row for each batch of its members.
    """
    ids = members.repartitionByRange("place", "conv").sortWithinPartitions("place", "conv").withColumn("range", F.spark_partition_id())
    ids = stored(ids.select("place", "conv").mapInArrow(_joined_ids, "place long, seq long, ids string").withColumn("range", F.spark_partition_id()), "prefix-ends")
    return ids.repartition("place").sortWithinPartitions("place", "range", "seq").select("place", "ids").mapInArrow(_digests, "place long, sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """convs(conv, n), turns(conv, pos from 0, digest, words) -> a row for each distinct prefix.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, place, last_place):
    conv_id is the smallest member; places are from 1 in preorder, and a node's subtree is those from `place` to `last_place`.
    Every conversation, also one without turns, is a member of the root, which has depth 0. No conversations give
    no nodes.
    """
    order = ranked(turns)
    members = stored(convs.join(order, "conv", "left").select("conv", "n", F.coalesce("r", F.lit(-1)).alias("r")), "prefix-members")
    root = members.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), *[F.lit(0).cast("long").alias(c) for c in (*_KEY, *_PARENT)], "n", "r")
    rows = _keyed(turns).join(members, "conv").select(*root.columns).unionByName(root)
    ends = F.col("n") == F.col("depth")
    rows = stored(rows, "prefixes")
    nodes = rows.groupBy("depth", *_KEY).agg(
        *[F.min(c).alias(c) for c in _PARENT], F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("r").alias("first"), F.max("r").alias("last"),
        F.max("words").alias("words"), F.count_if(ends).alias("n_ends"),
    )
    leaf = (F.col("n_ends") == F.col("n_convs")).cast("long")
    nodes = laid_out(nodes.withColumn("leaf", leaf).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "prefix-nodes", "first", "depth")
    nodes = stored(running(nodes, place=F.lit(1), leaves=F.col("leaf"), saves=F.col("saved")).drop("_g"), "prefix-places")

    # The last node of a subtree is the whole of its last member: the deepest of those that it is the first of.
    last = nodes.groupBy(F.col("first").alias("last")).agg(F.max_by(F.struct("place", "leaves", "saves"), "place").alias("z"))
    nodes = nodes.join(last, "last")
    parent = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(p) for k, p in zip(_KEY, _PARENT, strict=True)], F.col("place").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = stored(nodes.join(parent, ["depth", *_PARENT], "left"), "prefix-parents")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("place")).agg(F.count("*").alias("n_children"))
    ended = rows.where(ends).select("depth", *_KEY, "conv").join(nodes.where("n_ends > 0").select("depth", *_KEY, "place"), ["depth", *_KEY]).select("place", "conv")
    out = nodes.join(children, "place", "left").join(_ends(ended), "place", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), (F.col("z.leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("z.saves") - F.col("saves") + F.col("saved")).alias("saved_tokens"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "place", F.col("z.place").alias("last_place"),
    )


def prefix_trie(conversations: DataFrame, stride: int = STRIDE, heads: int = HEADS, **columns: str) -> DataFrame:
    """The trie of rebuilt conversations (see rebuilt, ordered_turns, trie); columns of other names take no part."""
    return trie(*rebuilt(stored(ordered_turns(conversations, **columns), "ordered-turns"), stride, heads))
