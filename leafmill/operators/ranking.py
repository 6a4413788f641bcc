"""Full ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.session import written


def rank_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``rank INT``, 1 to the size of each group, by a total ``order``.

    Rows are sorted by ranges over (keys, order), so a group that holds much of
    the table spans many tasks; its parts are numbered one by one and shifted by
    the sizes of the parts before them.  Nulls rank as ``order`` says; an empty
    table gives an empty result.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    # Written, as the numbers of partitions must not change between the two uses.
    placed = written(ranged.withColumn("__part", F.spark_partition_id()), "ranges")
    local = placed.withColumn("__place", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order)))
    sizes = placed.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select(*keys, "__part", F.coalesce(before, F.lit(0)).alias("__shift"))
    left, right = local.alias("l"), shifts.alias("s")
    same = F.col("l.__part") == F.col("s.__part")
    for key in keys:
        same = same & F.col(f"l.{key}").eqNullSafe(F.col(f"s.{key}"))
    joined = left.join(right, same)
    return joined.select(*[F.col(f"l.{c}").alias(c) for c in df.columns], (F.col("l.__place") + F.col("s.__shift")).cast("int").alias("rank"))
