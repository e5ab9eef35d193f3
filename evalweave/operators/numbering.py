"""Row numbers over a whole table or over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.session import written


def number_rows(
    df: DataFrame,
    order_by: list[Column],
    within: list[str] | None = None,
    into: str = "rn",
    slabs: int | None = None,
) -> DataFrame:
    """Number rows from 1 in ``order_by`` order, per ``within`` group or overall.

    A window function would sort each group in a single task, which a global rank or
    one huge group does not survive. Here rows are range-partitioned on group and
    order, so a large group spreads over many sorted slabs. Each row's number is its
    place in its slab plus the size of the same group in earlier slabs. ``order_by``
    must end in a unique key. The sorted slabs are written: places and sizes have to
    come from the same partitioning even when a task is run again. Range partitioning
    reads ``df`` twice, so pass a written table if it is costly to compute.
    """
    groups = list(within or [])
    spark = df.sparkSession
    n = slabs or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in groups]
    slab_rows = written(
        df.repartitionByRange(n, *keys, *order_by)
        .sortWithinPartitions(*keys, *order_by)
        .withColumn("_slab", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id()),
        "slabs",
    )
    sizes = slab_rows.groupBy(*groups, "_slab").agg(
        F.count(F.lit(1)).alias("_size"), F.min("_place").alias("_first")
    )
    # At most one row per slab and group, so this window stays small.
    earlier = Window.partitionBy(*groups).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *groups,
        "_slab",
        (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_start"),
    )
    renamed = written(
        starts.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("_slab").alias("_s"), "_start"),
        "slab-starts",
    )
    same = F.col("_slab") == F.col("_s")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return slab_rows.join(renamed, same).select(
        *df.columns, (F.col("_place") + F.col("_start")).cast("bigint").alias(into)
    )
