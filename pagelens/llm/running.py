"""Places and running sums inside groups, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.shared import stored


def placed(df: DataFrame, group: str, order: list[Column], size: Column, name: str) -> DataFrame:
    """`df` with seq (from 0) and start (sum of `size` over the rows before) in the group's order; equal rows in any order.

    Rows are range-sorted by group and order, so a large group lies in many partitions. Places are counted inside each
    partition, then moved by the totals of the group's earlier partitions: one narrow row per group and partition.
    """
    order = [F.col(group).asc_nulls_first(), *order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.withColumn("_size", size.cast("long")).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), name)
    totals = dealt.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_sum"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_sum")))
    inside = Window.partitionBy("_part", group).orderBy(*order)
    local = dealt.withColumn("_row", F.row_number().over(inside)).withColumn("_run", F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = local.join(earlier, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return rows.select(*df.columns, (F.col("_row") - 1 + F.col("_n_before")).cast("long").alias("seq"), (F.col("_run") - F.col("_size") + F.col("_sum_before")).alias("start"))
