"""What several corpus operators share: shared-folder tables, size-checked broadcasts, words."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words everywhere in this subpackage: space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
_SPACES = str.maketrans("\t\n\x0b\x0c\r", "     ")

#: Largest side that is ever broadcast, in bytes of its rows as estimated by the caller.
BROADCAST_BYTES = 16 << 20

#: What a row_key takes in the table that a broadcast is at the driver: key and value rows of 32 bytes, pointers, hash slots.
KEY_BYTES = 112

#: What a row of some ids, counts, a digest and labels takes there at most.
ROW_BYTES = 256


def words(text: str) -> list[str]:
    """The words of a text; what re.findall(WORD) gives, several times as fast."""
    return [w for w in text.translate(_SPACES).split(" ") if w]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and all run in one
    process, a temporary one. On a cluster other machines couldn't read that: an error says what to set."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.layerwise.sharedDir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="layerwise-shared-")
        spark.conf.set("spark.layerwise.sharedDir", found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str, *partition: str) -> DataFrame:
    """Writes df once as a compressed table in the shared folder and reads it back.

    This cuts the lineage: what was computed survives lost executors and isn't computed again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/layerwise/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df, marked for broadcast only if its known number of rows keeps it under BROADCAST_BYTES, and else for a sorted join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df.hint("merge")


def measured(df: DataFrame, rows: int, row_bytes: int = ROW_BYTES) -> DataFrame:
    """df, a side of a join; neither side that Spark might broadcast has more than `rows` rows.

    Spark takes a table for as large as its compressed file, and an array, or all that explode makes of it, for one
    value: what is 10 MB to it can be the driver's whole memory. So it may only choose by that while the number of rows,
    which is known, keeps the table under BROADCAST_BYTES; beyond, the join is a sorted one.
    """
    return df if rows * row_bytes <= BROADCAST_BYTES else df.hint("merge")


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small, so that a worker's memory doesn't follow the batch size."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def fold_of_value(doc_id, folds: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key(docs: DataFrame) -> Column:
    """128 bits of doc_id and text by which a row is found again in a later pass; equal rows share them.

    A null is told from an empty text by a mark before each value.
    """
    part = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(part(docs["doc_id"]), F.lit("\n"), part(docs["text"]))))


def packed_row(df: DataFrame) -> Column:
    """All of df's columns as one struct: inside it, no name can clash with an operator's own columns."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_doc")


def unpacked(df: DataFrame, columns: list[str], *own: str) -> DataFrame:
    """The packed columns again, then an operator's own; where both have a name, the operator's."""
    return df.select(*[F.col(f"_doc.`{c}`").alias(c) for c in columns if c not in own], *own)


_BYTE = np.random.default_rng(13).integers(0, 1 << 63, 256, dtype=np.uint64)
_FACTOR = 0x9E3779B97F4A7C15
#: Runs from this size on are hashed by XXH64: a polynomial modulo 2**64 has collisions that can be written down, the
#: shortest of some 1,000 letters, whatever its factor.
LONG_RUN = 64  # a power of two
_POWERS = np.array([pow(_FACTOR, i, 1 << 64) for i in range(LONG_RUN)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def hashed_runs(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes that lie one after the other and are not empty."""
    terms = _BYTE[letters]
    terms *= _POWERS[(np.arange(len(letters)) - np.repeat(starts, sizes)) & (LONG_RUN - 1)]
    out = mixed(np.add.reduceat(terms, starts) + sizes.astype(np.uint64))
    for i in np.flatnonzero(sizes >= LONG_RUN).tolist():
        out[i] = xxhash.xxh64_intdigest(letters[starts[i] : starts[i] + sizes[i]].tobytes())
    return out
