"""N-gram Jaccard join: MinHash bands propose, whole sets of word n-grams decide.

Rows with equal n-gram sets are one class (copies). Band hashes of the classes are shuffled; classes that
share a bucket are candidates. Candidates that hang together form a neighbourhood, inside which every pair
is compared on its full n-gram sets, by products of 0/1 matrices. A neighbourhood over BLOCK classes or
BLOCK_GRAMS n-grams is cut into blocks of classes that lie near each other in the graph of candidates. A block is
one row, linked inside first, which leaves it a few roots; then every two blocks that share a bucket meet in a
task, which says how many links each class got there, as one array a block, and names one edge for each root
that it joins to others, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY_BYTES, bounded_batches, measured, packed_row, row_key, small, stored, unpacked, words
from .graph import components
from .prefixes import laid_out, running

N = 5
SIMILARITY = 0.8
ROWS = 8
RECALL = 0.999  # wanted of pairs at exactly SIMILARITY
BLOCK = 1000
BLOCK_GRAMS = 1_000_000
_MEMO = 300_000
_MAX = np.uint32(0xFFFFFFFF)


def bands_for(similarity: float = SIMILARITY, rows: int = ROWS, recall: float = RECALL) -> int:
    """The least number of bands with 1 - (1 - similarity^rows)^bands >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


class Shingler:
    """Hashed sets of word n-grams of lower-cased texts."""

    def __init__(self, n: int = N) -> None:
        self.n, self.memo = n, {}
        self.powers = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(n)], np.uint64)

    def _hash(self, word: str) -> bytes:
        if len(self.memo) >= _MEMO:
            self.memo.clear()
        got = self.memo[word] = xxhash.xxh64_digest(word.encode("utf-8", "surrogatepass"))
        return got

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes. A text of one to n - 1 words has one n-gram, all its words; none without words."""
        memo, miss = self.memo, self._hash
        h = np.frombuffer(b"".join(memo[w] if w in memo else miss(w) for w in words((text or "").lower())), np.uint64)
        if not len(h):
            return h
        size = min(self.n, len(h))
        out = np.zeros(len(h) - size + 1, np.uint64)
        for i in range(size):
            out += h[i : len(h) - size + 1 + i] * self.powers[i]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        return np.unique(out)


class MinHash:
    """Band hashes: `rows` minima under random linear maps of 32 bits make one band."""

    def __init__(self, bands: int, rows: int = ROWS, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 1 << 32, (bands * rows, 1), dtype=np.uint32)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, (bands * rows, 1), dtype=np.uint32)
        self.mix = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) | np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """bands int64 hashes, different from band to band; none of an empty set."""
        if not len(shingles):
            return np.zeros(0, np.int64)
        x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
        least = np.full(self.bands * self.rows, _MAX)
        for i in range(0, len(x), 512):
            least = np.minimum(least, (self.a * x[None, i : i + 512] + self.b).min(axis=1))
        h = (least.reshape(self.bands, self.rows).astype(np.uint64) * self.mix).sum(axis=1, dtype=np.uint64)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        return (h ^ (h >> np.uint64(29))).view(np.int64)


def overlaps(sets: list[np.ndarray], split: int | None = None) -> np.ndarray:
    """Sizes of the intersections of all sets; with `split`, of those before it (rows) with those from it on."""
    m = len(sets)
    rows, cols = (slice(0, split), slice(split, m)) if split else (slice(0, m), slice(0, m))
    inter = np.zeros((rows.stop - rows.start, cols.stop - cols.start))
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1  # what one set alone has adds to no intersection
    owner, column = owner[shared], np.cumsum(times > 1)[column[shared]] - 1
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [start, start + 4096])
        x = np.zeros((m, int(column[hi - 1]) - start + 1), np.float32)
        x[owner[lo:hi], column[lo:hi] - start] = 1
        inter += x[rows] @ x[cols].T
    return inter


def similar(sets: list[np.ndarray], similarity: float = SIMILARITY, split: int | None = None) -> np.ndarray:
    """Boolean matrix: whether two sets' Jaccard similarity is at least `similarity`; an empty set is like no other.

    With `split`, those before it are the rows and those from it on the columns.
    """
    sizes = np.array([len(s) for s in sets], np.float64)
    if len(sets) == 2 and not split:
        inter = np.zeros((2, 2))
        inter[0, 1] = inter[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        inter = overlaps(sets, split)
    a, b = (sizes[:split, None], sizes[None, split:]) if split else (sizes[:, None], sizes[None])
    out = inter * (1 + similarity) >= similarity * (a + b) - 1e-9
    out &= (a > 0) & (b > 0)
    if not split:
        np.fill_diagonal(out, False)
    return out


def connected(links: np.ndarray) -> np.ndarray:
    """The least place that each place is connected to."""
    label = np.arange(len(links))
    while True:
        near = np.where(links, label[None], len(links)).min(axis=1, initial=len(links))
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def signatures(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(_row, doc_id, class, node, grams, bands) of every row; _row tells different rows apart, node is half of class, grams the set's size."""
    bounded_batches(docs.sparkSession)
    bands = bands_for(similarity)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, minhash = Shingler(), MinHash(bands)
        for b in batches:
            keys, nodes, grams, out = [], [], [], []
            for text in b.column(2).to_pylist():
                s = shingler.shingles(text)
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                keys.append(digest)
                nodes.append(int.from_bytes(digest[:8], "little", signed=True))
                grams.append(len(s))
                out.append(minhash.signature(s))
            flat = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))
            ends = pa.array(np.cumsum([0, *map(len, out)]), pa.int32())
            arrays = [b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(nodes, pa.int64()), pa.array(grams, pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(ends, flat)], ["_row", "doc_id", "class", "node", "grams", "bands"])

    rows = docs.select(row_key(docs).alias("_row"), "doc_id", "text")
    return rows.mapInArrow(run, f"_row binary, doc_id {kind}, class binary, node long, grams long, bands array<long>")


_BLOCK = "component long, own long, nodes binary, sizes binary, copies binary, sets binary, links binary, roots binary"


def _linked(rows: pd.DataFrame, shingler: Shingler, similarity: float) -> tuple[list[np.ndarray], pd.DataFrame]:
    """The n-gram sets of some classes, and (node, links, root) as far as they are linked among themselves."""
    sets = [shingler.shingles(t) for t in rows["text"]]
    like = similar(sets, similarity)
    nodes = rows["node"].to_numpy()
    return sets, pd.DataFrame({"node": nodes, "links": like @ rows["copies"].to_numpy(np.int64), "root": nodes[connected(like)]})


def _unpacked_block(r: pd.Series) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A block's sets, its classes' numbers of copies and their roots."""
    sizes = np.frombuffer(r["sizes"], np.int64)
    return np.split(np.frombuffer(r["sets"], np.uint64), np.cumsum(sizes)[:-1]), np.frombuffer(r["copies"], np.int64), np.frombuffer(r["roots"], np.int64)


def in_blocks(places: DataFrame, block: int = BLOCK, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """places(node, component, grams, path) -> (node, component, own): blocks of at most about `block` nodes and `block_grams` grams.

    Nodes are laid out so that those with the same labels in components() lie together, late rounds before early
    ones, and are cut by a running sum. So a block is a few near pieces of its component, and one in a long chain
    touches few others. A node over `block_grams` is a block by itself.
    """
    share = F.greatest(F.lit(block_grams), F.col("grams") * block).cast("long")
    rows = laid_out(places.select("node", "component", "path", share.alias("share")), "block-order", "component", F.reverse("path"), "node")
    return running(rows, upto=F.col("share")).select("node", "component", F.expr(f"(upto - 1) div {block * block_grams}L").alias("own"))


def meetings(owned: DataFrame, bands: DataFrame) -> DataFrame:
    """owned(node, component, own), bands(node, bands array) -> (component, i, j): blocks i < j with nodes in one bucket."""
    at = owned.join(bands.hint("merge"), "node").select("component", "own", F.explode("bands").alias("band")).distinct()
    at = stored(at, "buckets-of-blocks")
    i, j = (at.select("component", "band", F.col("own").alias(name)) for name in "ij")
    return i.join(measured(j, at.count(), KEY_BYTES), ["component", "band"]).where("i < j").select("component", "i", "j").distinct()


def compared(
    texts: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, block_grams: int = BLOCK_GRAMS, places: DataFrame | None = None, bands: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """texts(node, copies, text, component, size, all_grams), a row a node -> (node, links, root) and (u, v).

    links: rows whose n-gram sets are like the node's; root: a node of its block that it is connected to, by
    links inside the block. (u, v): edges between roots of different blocks, fewer a task than its two blocks
    have roots. places(node, component, size, all_grams, grams, path) says where nodes lie, bands(node, bands)
    which buckets they are in; without them nodes lie by number, and a component is one bucket.
    """
    if places is None:
        places = texts.withColumn("grams", F.ceil(F.col("all_grams") / F.col("size"))).withColumn("path", F.array("component"))
    if bands is None:
        bands = texts.select("node", F.array("component").alias("bands"))
    is_large = (F.col("size") > block) | (F.col("all_grams") > block_grams)
    few, many = texts.where(~is_large), texts.where(is_large)
    load = places.where(~is_large).agg(F.count("*"), F.sum(F.col("all_grams") / F.col("size"))).first()  # without their texts
    batches = max(1, int(load[0] // block), int((load[1] or 0) // block_grams))

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        shingler = Shingler()
        return pd.concat([_linked(g, shingler, similarity)[1] for _, g in rows.sort_values("node").groupby("component")])

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        sets, found = _linked(rows, Shingler(), similarity)
        raw = lambda x, kind: np.asarray(x, kind).tobytes()
        row = (*key, raw(rows["node"], np.int64), raw([len(s) for s in sets], np.int64), raw(rows["copies"], np.int64))
        return pd.DataFrame([(*row, np.concatenate(sets).tobytes(), raw(found["links"], np.int64), raw(found["root"], np.int64))], columns=_BLOCK.replace(",", "").split()[::2])

    small_ones = few.select("node", "copies", "text", "component").groupBy(F.pmod(F.xxhash64("component"), F.lit(batches))).applyInPandas(inside, "node long, links long, root long")
    places = places.where(is_large)
    if places.isEmpty():
        return small_ones, texts.sparkSession.createDataFrame([], "u long, v long")
    owned = stored(in_blocks(places, block, block_grams), "owned")
    of_node = small(owned.select("node", "own"), owned.count(), KEY_BYTES)
    cut = many.select("node", "copies", "text", "component").join(of_node, "node")
    cut = stored(cut.groupBy("component", "own").applyInPandas(packed, _BLOCK), "blocks")

    def across(key: tuple, pair: pd.DataFrame) -> pd.DataFrame:
        (sets, copies, roots), (sets2, copies2, roots2) = (_unpacked_block(pair.iloc[k]) for k in pair["own"].argsort())
        like = similar([*sets, *sets2], similarity, len(sets))
        # Roots that a link joins hang together; each but the least of such a set names one edge.
        names, at = np.unique(np.concatenate([roots, roots2]), return_inverse=True)
        joined = np.zeros((len(names), len(names)), bool)
        a, b = np.nonzero(like)
        joined[at[: len(roots)][a], at[len(roots) :][b]] = True
        top = connected(joined | joined.T)
        edges = [[{"u": int(u), "v": int(v)} for u, v in zip(names, names[top]) if u != v], []]
        links = [(like @ copies2).tobytes(), (like.T @ copies).tobytes()]
        return pd.DataFrame({"component": [key[0]] * 2, "own": list(key[1:]), "links": links, "edges": edges})

    pairs = stored(meetings(owned, bands), "block-pairs")
    sides = pairs.withColumn("own", F.explode(F.array("i", "j")))
    tasks = cut.select("component", "own", "sizes", "copies", "sets", "roots").join(small(sides, 2 * pairs.count(), KEY_BYTES), ["component", "own"])
    met = stored(tasks.groupBy("component", "i", "j").applyInPandas(across, "component long, own long, links binary, edges array<struct<u:long,v:long>>"), "meetings")

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        block = rows[rows["nodes"].notna()].iloc[0]
        links = np.sum([np.frombuffer(x, np.int64) for x in rows["links"]], axis=0)
        return pd.DataFrame({"node": np.frombuffer(block["nodes"], np.int64), "links": links, "root": np.frombuffer(block["roots"], np.int64)})

    none = F.lit(None).cast("binary")
    parts = cut.select("component", "own", "links", "nodes", "roots").unionByName(met.select("component", "own", "links", none.alias("nodes"), none.alias("roots")))
    large_ones = parts.groupBy("component", "own").applyInPandas(summed, "node long, links long, root long")
    return small_ones.unionByName(large_ones), met.select(F.explode("edges").alias("e")).select("e.u", "e.v")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text, ...) -> (_row, doc_id, class_id, copy_id, n_copies, n_links, keep), a row a row.

    copy_id: the least doc_id with the same n-gram set; n_copies: the rows of that set, itself included;
    n_links: other rows with a similarity of at least `similarity`, copies included; class_id: the least
    doc_id reached over links; keep: whether the row is the one to keep of its class (the least doc_id, null
    last). Null and empty texts have the empty set: they are copies of one another and like nothing else.
    Ids may be null (they count last; a class of null ids has a null class_id) or repeat; equal rows are kept
    together, so a caller that wants one drops repeated _row. An empty table gives none.
    """
    sigs = stored(signatures(docs, similarity), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("_row").alias("row")))
    classes = stored(sigs.groupBy("class", "node").agg(F.count("*").alias("copies"), first.alias("least"), F.min("_row").alias("_row"), F.first("grams").alias("grams"), F.first("bands").alias("bands")), "classes")
    n = classes.count()
    banded = classes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v < last").select("band", "v")
    edges = banded.join(measured(buckets, n * bands_for(similarity), KEY_BYTES), "band").where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    near = components(stored(edges, "candidates"), paths=True)
    members = classes.select("node", "copies", "grams", "_row").join(measured(near, n), "node")
    sizes = members.groupBy("component").agg(F.count("*").alias("size"), F.sum("grams").alias("all_grams"))
    members = stored(members.join(measured(sizes, n), "component"), "neighbourhoods")
    texts = docs.select(row_key(docs).alias("_row"), "text").join(small(members.select("_row"), members.count(), KEY_BYTES), "_row", "left_semi")
    texts = texts.dropDuplicates(["_row"]).join(measured(members.drop("grams", "path"), n), "_row")  # equal rows have one text
    inside, across = compared(texts, similarity, block, places=members, bands=classes.select("node", "bands"))
    inside = stored(inside, "compared")
    # A block's links are settled in it: only what joins the roots of different blocks is left.
    if across.isEmpty():
        links = inside.withColumnRenamed("root", "component")
    else:
        met = components(stored(across, "links")).select(F.col("node").alias("root"), "component")
        links = inside.join(measured(met, n), "root", "left").select("node", "links", F.coalesce("component", "root").alias("component"))
    info = classes.select("class", "node", "copies", "least").join(measured(links, n), "node", "left")
    info = stored(info.select("class", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")), "class-links")
    groups = info.groupBy("component").agg(F.min("least").alias("winner"))
    info = stored(info.join(measured(groups, n), "component").drop("component"), "class-info")
    rows = sigs.select("_row", "doc_id", "class").join(measured(info, n), "class")
    return rows.select(
        "_row",
        "doc_id",
        F.col("winner.doc_id").alias("class_id"),
        F.col("least.doc_id").alias("copy_id"),
        F.col("copies").alias("n_copies"),
        (F.col("links") + F.col("copies") - 1).alias("n_links"),
        (F.col("_row") == F.col("winner.row")).alias("keep"),
    )


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that near_duplicates keeps, one for each class, with all their columns."""
    rows = stored(near_duplicates(docs, similarity).select("_row", "keep"), "keep")
    lost = rows.where("not keep").select("_row").distinct()
    kept = docs.select(packed_row(docs), row_key(docs).alias("_row")).join(small(lost, rows.where("not keep").count(), KEY_BYTES), "_row", "left_anti")
    if not rows.where("keep").groupBy("_row").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_row"])
    return unpacked(kept, docs.columns)
