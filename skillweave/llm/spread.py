"""Small inputs over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for stages that compute much per row.

    Inputs that have as many already, as all large ones do, stay as they are: no exchange is added to them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
