"""The summary document: one nested JSON whose specialty names are keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPECIALTIES = "especialidades map<string, struct<total:bigint, comunes:bigint, raras:bigint>>"


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The specialties of a summary document as rows (especialidad, total, comunes, raras); a file without any gives none."""
    return _rows(spark.read.schema(SPECIALTIES).option("multiLine", True).json(path))


def specialties_of(docs: DataFrame, text: str) -> DataFrame:
    """The same of documents that are texts in a column. Null texts and texts without the object give none."""
    return _rows(docs.select(F.from_json(text, SPECIALTIES).alias("d")).select("d.especialidades"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("especialidades").alias("especialidad", "v")).select("especialidad", "v.total", "v.comunes", "v.raras")
