"""Folders of odd tables made from the smallest given ones: empty, or with rows of nulls and a further column."""

import os

from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def odd(spark, to, kind):
    for name in sorted(os.listdir(SMALL)):
        t = spark.read.parquet(f"{SMALL}/{name}")
        if kind == "empty":
            t = t.limit(0)
        else:
            nulls = spark.createDataFrame([tuple(None for _ in t.columns)] * 2, t.schema)
            t = t.unionByName(nulls).withColumn("__n", F.lit(1)).withColumn("total", F.lit("x"))
        t.coalesce(1).write.mode("overwrite").parquet(f"{to}/{name}")
    return str(to)
