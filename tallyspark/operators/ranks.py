"""Places within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their place, from 1 on, among those of equal keys.

    Rows are dealt into ranges of (keys, order); a window numbers them within a range, and the numbers of rows of a key
    in the ranges before are added.  A key with a third of all rows spreads over a third of the ranges.
    Rows of one key that are equal in ``order`` get different places in no particular order.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, *keys, *order).withColumn("__range", F.spark_partition_id()))
    counts = ranged.groupBy("__range", *keys).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__range", *[F.col(k).alias(f"__{k}") for k in keys], F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    within = ranged.withColumn("__place", F.row_number().over(Window.partitionBy("__range", *keys).orderBy(*order)))
    same = [within["__range"] == before["__range"], *[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]]
    return within.join(before, same).select(*[within[c] for c in rows.columns], (F.col("__before") + F.col("__place")).cast("long").alias(name))
