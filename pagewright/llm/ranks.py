"""Gapless ranks within groups, however large, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a part of a group has in the mean at most.
PART = 20_000


def ranked(df: DataFrame, group: str, order: list[str], name: str, n: int, part: int = PART) -> DataFrame:
    """df with `name`: a long from 0 without gaps within each value of `group`.

    Rows go to parts by a hash of `order`; a part has its rank by window, and its start from the counts of the parts
    before it. df must give the same rows each time it is computed (a written table); n is its number of rows. The
    table of counts has a row for each group and part.
    """
    parts = max(1, n // part)
    split = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = split.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    own = split.withColumn("_row", inner)
    met = own.join(starts, (F.col(group) == F.col("_group")) & (F.col("_part") == F.col("_of")))
    return met.withColumn(name, (F.col("_start") + F.col("_row") - 1).cast("long")).drop("_part", "_row", "_group", "_of", "_start")
