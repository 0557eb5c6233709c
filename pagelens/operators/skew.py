"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds at least 1/HOT_SHARE of the rows, so there are at most HOT_SHARE of
# them: that bound is what makes broadcasting the hot keys safe at any size.
HOT_SHARE = 200
SALTS = 64


def hot_keys(df: DataFrame, on: list[str]) -> DataFrame:
    """Keys holding at least 1/HOT_SHARE of the rows. Only the key columns are read."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.where((F.col("_n") * HOT_SHARE >= total) & (F.col("_n") > 1)).select(*on)


def salted_join(
    left: DataFrame, right: DataFrame, on: list[str], spread_by: list[str], how: str = "left", hot: DataFrame | None = None
) -> DataFrame:
    """Join where `left` may be skewed on `on`; `right` rows of hot keys are repeated per salt.

    Every left row meets every matching right row exactly once, so the result is that of a plain
    join. `spread_by` names left columns that differ between rows of one key. `hot` is a
    hot_keys() result over a cheaper table with the same skew, where `left` is costly to count.
    """
    hot = F.broadcast((hot_keys(left, on) if hot is None else hot).withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int")).otherwise(0)
    salted = left.join(hot, on, "left").withColumn("_salt", salt).drop("_hot")
    last = F.when(F.col("_hot"), F.lit(SALTS - 1)).otherwise(0)
    repeated = right.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_hot")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


# A dimension of at most this many narrow rows may be broadcast.
BROADCAST_ROWS = 1_000_000


def sized_join(left: DataFrame, right: DataFrame, on: list[str], spread_by: list[str], key_source: DataFrame, how: str = "left") -> DataFrame:
    """Join a dimension with one row per key: broadcast when counted to be small, else salted.

    `key_source` is a table holding every key of `right` that is cheap to read (a stored column).
    Its distinct keys are counted up to the limit, which proves the size of `right` before it is
    broadcast.
    """
    keys = key_source.select(*on).distinct().limit(BROADCAST_ROWS + 1).count()
    if keys <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    return salted_join(left, right, on, spread_by, how)
