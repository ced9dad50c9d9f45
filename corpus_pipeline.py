"""A training corpus in stages: each reads what the one before it kept.

Quality classifier: rejected documents go. N-gram Jaccard join: one document of each class stays. Secret
scans: found secrets are replaced by their kind. Mixing: documents repeat, or drop out, until each source
has its share. Packing: what is left goes into windows of token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerwise.llm import jaccard, mixing, packing, quality, secrets
from layerwise.llm.common import stored


def _inner(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and every column packed into one, so that none clashes with a stage's own."""
    return docs.select(*names, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_original"))


def _outer(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of docs with the changed text; n_chars, where there is one, follows it."""
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return changed.select(*[new.get(c, F.col(f"_original.`{c}`")).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicated(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _outer(docs, secrets.redacted(secrets.scan(_inner(docs, "doc_id", "text"))))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _outer(docs, mixing.repeated(mixing.mix(_inner(docs, "doc_id", "source", "text"))))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("duplicates", duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Neither a trained network nor greedy packing can be put in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
