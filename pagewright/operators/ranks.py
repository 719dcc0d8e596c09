"""Numbers along an order without gathering all rows in one task."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import shared_dir


def numbered(df: DataFrame, order: str | Column | tuple[str | Column, ...], name: str) -> DataFrame:
    """df with `name`: a long from 1 without gaps along `order`, ties as they come.

    Ranges of the order are written with their numbers; a row's place is its range's start and its place within.
    """
    spark, by = df.sparkSession, order if isinstance(order, tuple) else (order,)
    path = f"{shared_dir(spark)}/pagewright/numbered-{uuid4().hex}"
    df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    held = spark.read.parquet(path)
    before = Window.partitionBy(F.lit(0)).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy(F.col("_range").alias("_of")).agg(F.count("*").alias("_n"))  # a row for each range
    starts = counts.select("_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    met = held.withColumn("_place", place).join(F.broadcast(starts), F.col("_range") == F.col("_of"))
    return met.withColumn(name, (F.col("_start") + F.col("_place")).cast("long")).drop("_range", "_of", "_start", "_place")
