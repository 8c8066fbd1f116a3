"""Plan shaping that Catalyst leaves to us."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, array: Column, position: str, element: str) -> DataFrame:
    """df with a row for each element of an expensive array.  A plain explode makes the optimizer infer a filter
    from the array, in which the array's expression is computed once more; an outer one doesn't, and a filter on
    the position drops the rows of empty arrays.  Filters on df's own columns reach its scan."""
    rows = df.withColumn("__array", array).select("*", F.posexplode_outer("__array").alias(position, element))
    return rows.where(F.col(position).isNotNull()).drop("__array")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores if it comes in fewer partitions than there are cores (a small file with one
    row group).  A larger input stays as it is scanned, so what this moves is at most a split per core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
