"""Top k per group without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_top(df: DataFrame, group: str, key: str, order: list[Column], k: int, salts: int = 32) -> DataFrame:
    """df with column ``selected``: whether the row is among its group's first k. order must be total over key.

    Rows are ranked within salted parts of their group first and only the first k of each part are candidates, so
    that a group with a third of all rows is sorted by many tasks, and the final sort sees at most salts x k of its
    rows. The others keep to their parts there, so that df is read and sorted once for both.
    """
    near = Window.partitionBy(group, "_salt").orderBy(*order)
    ranked = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts))).withColumn("_near", F.row_number().over(near))
    ranked = ranked.withColumn("_salt", F.when(F.col("_near") <= k, F.lit(-1)).otherwise(F.col("_salt")))
    final = Window.partitionBy(group, "_salt").orderBy(*order)
    selected = (F.col("_salt") < 0) & (F.row_number().over(final) <= k)
    return ranked.withColumn("selected", selected).drop("_salt", "_near")
