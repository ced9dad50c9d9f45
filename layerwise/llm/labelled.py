"""Bounded samples of labelled rows, for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of

#: At most so many labelled rows are used to fit a classifier; which ones is decided by a hash of doc_id.
MAX_TRAIN = 12_000
FOLDS = 5


def training_labels(labels: DataFrame, column: str, limit: int = MAX_TRAIN, folds: int = FOLDS) -> DataFrame:
    """(doc_id, label) of at most `limit` rows outside the held-out fold 0.

    Null ids and null labels are left out; of a doc_id's several labels the largest counts.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold_of(F.col("doc_id"), folds) != 0))
    one = rows.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fitted_on(features: DataFrame, labels: DataFrame) -> DataFrame:
    """The features' rows that have a training label; the labels are few enough to broadcast (see MAX_TRAIN).

    Of several rows with one doc_id the one with the least hash counts, so that a fit can be repeated.
    """
    rows = features.join(F.broadcast(labels), "doc_id")
    rest = [c for c in rows.columns if c != "doc_id"]
    least = F.min(F.struct(F.xxhash64(*rest).alias("_hash"), *rest)).alias("_least")
    return rows.groupBy("doc_id").agg(least).select("doc_id", *[f"_least.{c}" for c in rest])
