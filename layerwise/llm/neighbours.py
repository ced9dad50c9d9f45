"""Approximate nearest neighbours by cross-polytope hashing, with exact reranking.

Inner products become angles between unit vectors by one more coordinate. A hash is a fast pseudo-rotation
(random signs and Hadamard transforms, three times over) and the signed axis nearest to what comes out; a table's
bucket is that of several hashes together. Every table keeps each class of equal vectors in one bucket. A query looks
into the buckets whose axes have the largest sums of products with it, of several tables, and what it finds is scored
in double precision on the original vectors. How many buckets there are and how many are probed follows from the
number of classes (see plan): the more there are, the smaller a share of them is scored. A query that finds too few
is compared with all of its width.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, small, stored

TABLES = 16
SHARE, FALL, AT = 0.36, 0.22, 2000  # of AT classes a query is scored with SHARE of them; of n with SHARE * (n / AT) ** -FALL
LEAST_PROBES = 32
TOP = 20
SLICE = 2048  # vectors of a cell that one task scores at a time
PAIRS = 1 << 16  # pairs that are scored at a time
CELL = 4096  # classes that a cell is meant to hold
SEED = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep their lengths; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


class CrossPolytope:
    """`tables` independent concatenations of `joined` hashes of unit vectors of `dim` coordinates."""

    def __init__(self, dim: int, tables: int = TABLES, joined: int = 2, seed: int = SEED) -> None:
        self.width = 1 << (dim - 1).bit_length()
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, joined, 3, self.width))

    def buckets(self, x: np.ndarray, probes: int) -> Iterator[np.ndarray]:
        """For each table (rows, probes): the buckets nearest to each row, nearest first. Axis a is +a or, from width on, -a."""
        pad = np.zeros((len(x), self.width))
        pad[:, : x.shape[1]] = x
        m, rows = 2 * self.width, np.arange(len(x))[:, None]
        for table in self.signs:
            code, score = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
            for signs in table:
                y = pad
                for s in signs:
                    y = hadamard(y * s)
                sums = (score[:, :, None] + np.hstack([y, -y])[:, None, :]).reshape(len(x), -1)
                k = min(probes, sums.shape[1])
                best = np.argpartition(-sums, k - 1, axis=1)[:, :k]
                code, score = code[rows, best // m] * m + best % m, sums[rows, best]
            yield np.take_along_axis(code, np.argsort(-score, axis=1, kind="stable"), 1)

    def in_parts(self, x: np.ndarray, probes: int, rows: int = 128) -> list[np.ndarray]:
        """buckets of all tables, a few rows at a time: a row's sums of products are as many as axes times probes."""
        parts = [list(self.buckets(x[i : i + rows], probes)) for i in range(0, len(x), rows)]
        return [np.concatenate(t) for t in zip(*parts, strict=True)]


@dataclass(frozen=True)
class Plan:
    """How one width is hashed: hashes a table, buckets probed of each table, and cells that buckets are grouped into."""

    joined: int
    probes: int
    cells: int
    longest: float
    extended: bool


def plan(dim: int, n: int, shortest: float, longest: float, tables: int = TABLES, share: float = SHARE) -> Plan:
    """For n classes of a width. The share of them that a query is scored with falls as a power of n."""
    extended = longest - shortest > 1e-5 * longest  # one more coordinate makes inner products angles
    axes = 2 << (dim + extended - 1).bit_length()
    each = 1 - (1 - min(0.999, share * (n / AT) ** -FALL)) ** (1 / tables)  # of one table's buckets, if tables were independent
    joined = max(2, math.ceil(math.log(LEAST_PROBES / each) / math.log(axes)))
    cells = min(axes**joined, axes * max(1, math.ceil(n / (axes * CELL))))
    return Plan(joined, min(axes**joined, math.ceil(axes**joined * each)), cells, longest, extended)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, without null or non-finite components, not zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def _hashed(plans: dict[int, Plan], tables: int, index: bool):
    """Arrow batches (class, v, dim) -> (class, v, dim, table, cell, codes): the buckets that a class is in, or that a query looks
    into, by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[int, CrossPolytope] = {}
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                at, p = np.flatnonzero(dims == dim), plans[dim]
                x = b.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                unit = x / norm
                if p.extended:
                    unit = np.hstack([x / p.longest, np.sqrt(np.maximum(0, 1 - (norm / p.longest) ** 2))] if index else [unit, np.zeros_like(norm)])
                if dim not in hashes:
                    hashes[dim] = CrossPolytope(unit.shape[1], tables, p.joined)
                buckets = (2 * hashes[dim].width) ** p.joined
                for table, codes in enumerate(hashes[dim].in_parts(unit, 1, 4096) if index else hashes[dim].in_parts(unit, p.probes)):
                    # A cell is a range of buckets; a row's buckets of one cell go there together.
                    codes = np.sort(codes, axis=1)
                    cell = codes * p.cells // buckets
                    starts = np.flatnonzero(np.hstack([np.ones((len(at), 1), bool), cell[:, 1:] != cell[:, :-1]]).ravel())
                    row = pa.array(at[starts // codes.shape[1]])
                    listed = pa.ListArray.from_arrays(pa.array(np.append(starts, codes.size).astype(np.int32)), pa.array(codes.ravel()))
                    fixed = [pa.array(np.full(len(starts), table, np.int32)), pa.array(cell.ravel()[starts])]
                    yield pa.RecordBatch.from_arrays([*(b.column(i).take(row) for i in range(3)), *fixed, listed], ["class", "v", "dim", "table", "cell", "codes"])

    return run


def scored(queries: np.ndarray, asked: np.ndarray, of: np.ndarray, vectors: np.ndarray, codes: np.ndarray, keys: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, key, score) of each query's `top` vectors with the largest products among those in the buckets that it
    asks for, ties to the smaller key. asked: bucket numbers, of: the query that asks; codes: the bucket of each vector.
    """
    order = np.argsort(codes, kind="stable")
    low, high = np.searchsorted(codes[order], asked, "left"), np.searchsorted(codes[order], asked, "right")
    out: list[tuple[np.ndarray, ...]] = []
    ends = np.cumsum(high - low)
    at = 0
    while at < len(asked):  # so many of the asked-for buckets that their pairs fit
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = (high - low)[at:to]
        q = np.repeat(of[at:to], n)
        v = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:to], n)]
        score = np.concatenate([(queries[q[i : i + PAIRS]] * vectors[v[i : i + PAIRS]]).sum(axis=1) for i in range(0, len(q), PAIRS)] or [np.empty(0)])
        out.append(_best(q, keys[v], score, top))
        at = to
    q, key, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return _best(q, key, score, top)


def _best(q: np.ndarray, key: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((key, -score, q))
    q, key, score = q[order], key[order], score[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < top
    return q[kept], key[kept], score[kept]


def _compared(index: DataFrame, probe: DataFrame, n_cells: int, top: int) -> DataFrame:
    """index, probe(class, v, dim, table, cell, codes) -> (class, near, score, r): of each class of probe the top + 1 nearest
    classes of index that are in a bucket that it looks into."""
    cell = ["dim", "table", "cell"]
    # Both sides of a cell are cut into slices of about SLICE rows; every slice meets every slice of the other side.
    parts = lambda df, name: df.groupBy(cell).agg(F.ceil(F.count("*") / SLICE).cast("int").alias(name))
    sizes = parts(index, "of_index").join(parts(probe, "of_probe"), cell)
    cut = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sized = lambda df: df.join(small(sizes, n_cells, 32), cell)
    left = sized(index).select(*cell, "class", "v", "codes", cut("of_index").alias("i"), "of_probe").select(*cell, "class", "v", "codes", "i", all_of("of_probe").alias("j"))
    right = sized(probe).select(*cell, "class", "v", "codes", cut("of_probe").alias("j"), "of_index").select(*cell, "class", "v", "codes", "j", all_of("of_index").alias("i"))
    place = [*cell, "i", "j"]

    def run(_: tuple, found: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(queries):
            return pd.DataFrame({"class": [], "near": [], "score": []})
        asked = np.concatenate(queries["codes"].to_numpy())
        of = np.repeat(np.arange(len(queries)), [len(c) for c in queries["codes"]])
        x, y = np.stack(found["v"]).astype(np.float64), np.stack(queries["v"]).astype(np.float64)
        q, key, score = scored(y, asked, of, x, np.concatenate(found["codes"].to_numpy()), found["class"].to_numpy(), top + 1)  # its own class may be among them
        return pd.DataFrame({"class": queries["class"].to_numpy()[q], "near": key, "score": score})

    pairs = left.groupBy(place).cogroup(right.groupBy(place)).applyInPandas(run, "class long, near long, score double")
    pairs = pairs.groupBy("class", "near").agg(F.max("score").alias("score"))
    nearest_first = Window.partitionBy("class").orderBy(F.desc("score"), "near")
    return pairs.withColumn("r", F.row_number().over(nearest_first)).where(F.col("r") <= top + 1)


def nearest(vectors: DataFrame, every: int = 20, top: int = TOP, tables: int = TABLES, share: float = SHARE, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vectors(key, column, ...) -> (query_id, rank, vec_id, score): of each query the `top` nearest found.

    Queries are the rows whose key is divisible by `every`; a query's candidates are all other rows with as many
    components, of which it gets `top`, or all if there are fewer; queries that hashing leaves short are compared with
    every candidate. Rows whose vector is null, empty, zero, or holds null or non-finite components take no part. Rows
    with a null key are candidates and no queries. Repeated rows are candidates each; those that are queries are one
    query, of which one row is its own. One key with several vectors is several queries. Equal vectors are one class: a
    class keeps its top + 1 least keys, which is all that a ranking can show of it. Ties go to the smaller key, null
    last. An empty table gives none.
    """
    bounded_batches(vectors.sparkSession)
    kind = vectors.schema[column].dataType.elementType.simpleString()
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v")).where(usable(F.col("v")))
    rows = stored(rows.groupBy("id", "v").agg(F.least(F.count("*"), F.lit(top + 1)).cast("int").alias("copies")), "vectors")
    # Of a common vector each task sends top + 1 rows to where the class is made.
    least = Window.partitionBy("v").orderBy(F.asc_nulls_last("id"))
    first = rows.withColumn("n", F.row_number().over(least)).where(F.col("n") <= top + 1)
    each = F.transform(F.sort_array(F.collect_list(F.struct("n", "id", "copies"))), lambda x: F.array_repeat(x["id"], x["copies"]))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    classes = first.groupBy("v").agg(F.slice(F.flatten(each), 1, top + 1).alias("ids")).select("v", F.size("v").alias("dim"), "ids", norm.alias("norm"), F.element_at("ids", 1).alias("least"))
    # Numbers in the order of the classes' least keys.
    classes = classes.repartitionByRange(F.asc_nulls_last("least"), "v").sortWithinPartitions(F.asc_nulls_last("least"), "v")
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    spans = classes.groupBy("dim").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"), F.count("*").alias("n"), F.sum(F.size("ids")).alias("rows")).collect()  # a row for each width of vectors
    plans = {r.dim: plan(r.dim, r.n, r.lo, r.hi, tables, share) for r in spans}
    asked = rows.where(F.col("id") % every == 0).select("id", "v").join(classes.select("v", "class", "dim"), "v").select("id", "class", "v", "dim")
    asked = stored(asked, "queries")

    shape = f"class long, v array<{kind}>, dim int, table int, cell long, codes array<bigint>"
    index = classes.select("class", "v", "dim").mapInArrow(_hashed(plans, tables, True), shape)
    probe = asked.select("class", "v", "dim").distinct().mapInArrow(_hashed(plans, tables, False), shape)
    index, probe = stored(index, "index"), stored(probe, "probes")
    n_cells = tables * sum(p.cells for p in plans.values())
    found = stored(_compared(index, probe, n_cells, top).join(classes.select(F.col("class").alias("near"), "ids"), "near").select("class", "near", "score", "ids"), "near-classes")

    # A class has its top + 1 least keys at most, so `rows` tells how many candidates there are up to `top`.
    due = F.coalesce(*[F.when(F.col("dim") == r.dim, min(top, r.rows - 1)) for r in spans], F.lit(0))
    own = found.groupBy("class").agg((F.sum(F.size("ids")) - F.max((F.col("class") == F.col("near")).cast("int"))).alias("got"))
    short = asked.select("class", "v", "dim").distinct().join(own, "class", "left").where(F.coalesce("got", F.lit(0)) < due).select("class", "v", "dim")
    short = stored(short, "short-queries")
    if not short.isEmpty():
        one = [F.lit(0).alias("table"), F.lit(0).cast("long").alias("cell"), F.array(F.lit(0).cast("long")).alias("codes")]
        wide = classes.join(F.broadcast(short.select("dim").distinct()), "dim").select("class", "v", "dim", *one)  # a row for each width of vectors
        more = _compared(wide, short.select("class", "v", "dim", *one), len(plans), top).join(classes.select(F.col("class").alias("near"), "ids"), "near").select("class", "near", "score", "ids")
        found = stored(found.join(short.select("class"), "class", "left_anti").unionByName(more), "near-classes")
    hits = asked.select(F.col("id").alias("query_id"), "class").join(found, "class")
    # Of its own class one row is the query itself.
    at = F.array_position("ids", F.col("query_id")).cast("int")
    others = F.concat(F.slice("ids", F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice("ids", at + 1, F.size("ids")))
    mine = (F.col("class") == F.col("near")) & (at > 0)
    hits = hits.withColumn("ids", F.when(mine, others).otherwise(F.col("ids"))).select("query_id", "class", F.explode("ids").alias("vec_id"), "score")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "class").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
