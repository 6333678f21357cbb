"""Incremental ingestion: the same operators over a stream of case documents or turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.status import nested_status
from ..schema import CASE


def stream_cases(spark: SparkSession, folder: str, files_a_trigger: int = 1000) -> DataFrame:
    """New case documents below a folder as they arrive."""
    return spark.readStream.schema(CASE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_a_trigger).json(folder)


def stream_status(cases: DataFrame) -> DataFrame:
    return nested_status(cases)


def stream_table(spark: SparkSession, path: str, files_a_trigger: int = 1000) -> DataFrame:
    """A Parquet folder or file as a stream of the files that appear in it."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def first_deliveries(stream: DataFrame, keys: list[str], when: str = "recibido_en", late: str = "90 days") -> DataFrame:
    """The stream without redelivered rows; state is dropped once the watermark has passed, ``late`` being the longest delay expected."""
    ts = stream.withColumn(when, F.col(when).cast("timestamp"))
    return ts.withWatermark(when, late).dropDuplicatesWithinWatermark(keys)


def turns_by_day(stream: DataFrame, when: str = "recibido_en", late: str = "90 days") -> DataFrame:
    """Turns and characters received by day; late rows within the watermark are counted in their day."""
    ts = stream.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, late)
    return ts.groupBy(F.window(when, "1 day")).agg(F.count("*").alias("n_turns"), F.sum(F.length("texto").cast("long")).alias("n_chars")).select(F.col("window.start").alias("day"), "n_turns", "n_chars")
