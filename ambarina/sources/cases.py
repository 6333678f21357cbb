"""Case documents on disk: one JSON object a file, found recursively."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CASE

CORRUPT = "_corrupt_record"


def read_cases(spark: SparkSession, *roots: str, schema: T.StructType = CASE) -> DataFrame:
    """Rows of all ``*.json`` below the given folders (or of the given files), plus ``path`` (decoded) and ``_corrupt_record``.

    One scan of all folders and one of all files named. A file that is no JSON object is one row with ``_corrupt_record`` set; a field of
    another type than the schema's is null and leaves the others as they are. A file whose top level is an array yields a
    row an element; ``one_row_a_file`` turns it into a single failed row. A path given twice is read twice, by a scan of those that
    are; a file that lies below two of the folders is read once. Files whose names start with ``.`` or ``_`` are not listed by Spark; ``read_named`` reads them by explicit name. No path at all, or an
    empty folder, is an empty table.
    """
    wanted = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    scans: list[list[str]] = []
    for some in ([r for r in roots if not r.endswith(".json")], [r for r in roots if r.endswith(".json")]):
        while some:
            scans.append(list(dict.fromkeys(some)))
            for r in scans[-1]:
                some.remove(r)
    out = None
    for paths in scans:
        reader = spark.read.schema(wanted).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        part = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(paths).select("*", decoded_path(F.col("_metadata.file_path")).alias("path"))
        part = part.withColumn(CORRUPT, unreadable(F.col(CORRUPT), F.col(CORRUPT)))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], T.StructType([*wanted.fields, T.StructField("path", T.StringType())])) if out is None else out


def read_named(spark: SparkSession, paths: list[str] | DataFrame, schema: T.StructType = CASE) -> DataFrame:
    """Files by name, hidden ones and any suffix included, read by the executors: the document, ``pos`` (the place in the list, from 0),
    ``path`` and ``_corrupt_record``. A path given twice is read twice. A missing file is a row with a null document and that reason.

    ``paths``: a list, or a table of (pos, path). Paths are local or mounted, or URIs that Arrow knows. Bytes that are no UTF-8 become U+FFFD.
    """
    if not isinstance(paths, DataFrame):
        paths = spark.createDataFrame(list(enumerate(paths)), "pos long, path string")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            for pos, path in zip(pdf["pos"], pdf["path"]):  # a file a batch: never more than one is held
                try:
                    where, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
                    with where.open_input_stream(at) as f:
                        text = f.read().decode("utf-8", "replace")
                except (OSError, ValueError):
                    text = None
                yield pd.DataFrame([(pos, path, text)], columns=["pos", "path", "payload"])

    raw = paths.select("pos", "path").repartition(spark.sparkContext.defaultParallelism, "pos").mapInPandas(read, "pos long, path string, payload string")
    return documents(raw, "payload", schema=schema, missing="missing file").select(*(f.name for f in schema.fields), CORRUPT, "pos", "path")


def unreadable(text: Column, corrupt: Column) -> Column:
    """``text`` where it is no JSON object. ``corrupt`` is what Spark's reader has for it, which is also set where only a type differs."""
    v = F.try_parse_json(text)
    return F.when(corrupt.isNotNull() & (v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT")), text)


def documents(df: DataFrame, text: str, schema: T.StructType = CASE, missing: str = "no document") -> DataFrame:
    """The columns of ``df`` without ``text``, the fields of the document in it, and ``_corrupt_record``: the text where it is no JSON object,
    ``missing`` where it is null. Fields of another type than the schema's are null."""
    wanted = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    doc = F.from_json(text, wanted, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rest = [c for c in df.columns if c != text and c not in wanted.names]
    fields = (F.col("__d").getField(f.name).alias(f.name) for f in schema.fields)
    return df.withColumn("__d", doc).select(*rest, *fields, F.coalesce(unreadable(F.col(text), F.lit(1)), F.when(F.col(text).isNull(), F.lit(missing))).alias(CORRUPT))


def decoded_path(path: Column) -> Column:
    """Spark reports paths URI-encoded; sorting and matching want them as written."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def one_row_a_file(cases: DataFrame) -> DataFrame:
    """One row a path: where a file gave several rows (an array at top level) its document is void and ``_corrupt_record`` says so."""
    value = [c for c in cases.columns if c not in ("path", CORRUPT)]
    grouped = cases.groupBy("path").agg(F.count("*").alias("__n"), F.first(F.struct(*(f"`{c}`" for c in value))).alias("__d"), F.max(CORRUPT).alias(CORRUPT))
    return grouped.select(
        *(F.when(F.col("__n") == 1, F.col("__d").getField(c)).alias(c) for c in value),
        F.coalesce(F.when(F.col("__n") > 1, F.lit("top-level array")), F.col(CORRUPT)).alias(CORRUPT),
        "path",
    )


def sorted_paths(cases: DataFrame) -> DataFrame:
    """The distinct paths in code-point order, with their position from 0 in one global order."""
    return cases.select("path").distinct().orderBy("path")


def required_setting(spark: SparkSession, key: str, default: str | None = None) -> str | None:
    """A session setting; unset gives ``default``, set but empty counts as missing (None)."""
    got = spark.conf.get(key, None)
    return default if got is None else (got or None)
