"""Results as tables, files or views of the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").format(kind).save(path)


def remember(df: DataFrame, name: str) -> DataFrame:
    """Keeps a result under a name of the session; see forget()."""
    df.createOrReplaceTempView(name)
    return df


def forget(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.catalog.dropTempView(name)
