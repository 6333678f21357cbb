"""What documents hold that the schema does not say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CASE


def kind(declared: T.DataType) -> str:
    """The JSON type a field of the schema is written as."""
    if isinstance(declared, (T.StructType, T.MapType)):
        return "object"
    if isinstance(declared, T.ArrayType):
        return "array"
    return "boolean" if isinstance(declared, T.BooleanType) else "string" if isinstance(declared, T.StringType) else "number"


def json_kind(variant: Column) -> Column:
    """object, array, string, number, boolean or null."""
    t = F.schema_of_variant(variant)
    out = F.lit("number")
    for start, name in (("OBJECT", "object"), ("ARRAY", "array"), ("STRING", "string"), ("BOOLEAN", "boolean"), ("VOID", "null")):
        out = F.when(t.startswith(start), name).otherwise(out)
    return out


def key_types(docs: DataFrame, text: str, schema: T.StructType = CASE) -> DataFrame:
    """key, tipo, n, declarado (the type the schema gives it, null for none) of the keys at the top of documents given as text.

    Read as variants, so that no schema hides anything; null texts, incomplete ones and those that are no object have no keys. A key
    written null is of type ``null``, which any field may be. What differs from ``declarado`` is drift.
    """
    v = docs.select(F.try_parse_json(text).alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    pairs = v.lateralJoin(v.sparkSession.tvf.variant_explode(F.col("v").outer())).select(F.col("key"), json_kind(F.col("value")).alias("tipo"))
    known = [x for f in schema for x in (F.lit(f.name), F.lit(kind(f.dataType)))]
    return pairs.groupBy("key", "tipo").agg(F.count("*").alias("n")).withColumn("declarado", F.try_element_at(F.create_map(*known), F.col("key")))
