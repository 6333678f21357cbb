"""The Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def first_delivery(df: DataFrame, keys: list[str], when: str = "recibido_en", columns: list[str] | None = None) -> DataFrame:
    """One row a key: that of the earliest ``when``; among equal times the smallest row.

    Rows with a null in a key are kept as keys of their own value (null groups with null). Extra columns pass through. The
    aggregate runs map-side before its one shuffle, so a key delivered a million times arrives once a task.
    """
    rest = [c for c in (columns or df.columns) if c not in keys and c != when]
    comparable = [c for c in rest if not df.schema[c].dataType.simpleString().startswith("map")]
    maps = [c for c in rest if c not in comparable]
    as_entries = {c: F.map_entries(f"`{c}`").alias(c) for c in maps}
    row = F.struct(F.col(when), *(F.col(f"`{c}`") for c in comparable), *as_entries.values())
    out = df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.min(row).alias("__row"))
    back = {c: F.map_from_entries(F.col("__row").getField(c)).alias(c) if c in maps else F.col("__row").getField(c).alias(c) for c in [*rest, when]}
    return out.select(*(F.col(f"`{c}`") if c in keys else back[c] for c in df.columns if c in keys or c in back))


def without_redelivery(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Distinct rows of ``keys`` and ``columns``: enough where redelivered rows repeat the content, and a plain hash aggregate."""
    return df.select(*(F.col(f"`{c}`") for c in [*keys, *columns])).distinct()


def spread(df: DataFrame, key: str, least: int | None = None) -> DataFrame:
    """A scan over at least as many tasks as there are cores: for work that costs far more than reading its rows.

    A table in fewer splits than that is small, and shuffled for it; large tables and results of shuffles stay as they are.
    """
    query = df._jdf.queryExecution()
    if query.executedPlan().nodeName() == "AdaptiveSparkPlan":  # it shuffles, and is planned as it runs
        return df
    cores = least or df.sparkSession.sparkContext.defaultParallelism
    return df if query.toRdd().getNumPartitions() >= cores else df.repartition(cores * 2, F.col(f"`{key}`"))
