"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_SALT = 1_000_000


def join_salted(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    sizes: DataFrame | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Join ``big`` (any number of rows per key) with ``small`` (few rows per key); null keys are equal.

    Keys with more than ``rows_per_salt`` rows are split over as many salts as they need, and only their
    rows of ``small`` are repeated. ``sizes`` may bring the row counts per key (column ``n``) when they
    are known. The table of such keys is broadcast: it has at most (rows of ``big`` / ``rows_per_salt``)
    rows. The salt depends on the row and on its input partition, so copies of one row spread as well,
    and a task that runs again gives the same salts.
    """
    keys = list(on)
    if sizes is None:
        sizes = big.groupBy(*keys).agg(F.count("*").alias("n"))
    salts = F.ceil(F.col("n") / rows_per_salt).cast("int").alias("_salts")
    hot = F.broadcast(
        sizes.where(F.col("n") > rows_per_salt).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], salts)
    )

    def look_up(df: DataFrame) -> DataFrame:
        condition = F.lit(True)
        for k in keys:
            condition = condition & F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
        return df.join(hot, condition, "left").drop(*[f"_hot_{k}" for k in keys])

    mixed = F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in big.columns])
    left = (
        look_up(big)
        .withColumn("_salt", F.pmod(mixed, F.coalesce(F.col("_salts"), F.lit(1)).cast("bigint")).cast("int"))
        .drop("_salts")
    )
    right = (
        look_up(small)
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    for k in keys:
        right = right.withColumnRenamed(k, f"_key_{k}")
    # by name, so that both sides may come from one table
    condition = F.col("_salt") == F.col("_copy")
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return left.join(right, condition, how).drop("_salt", "_copy", *[f"_key_{k}" for k in keys])


def left_join_spread(big: DataFrame, small: DataFrame, on: str, by: Sequence[str]) -> DataFrame:
    """A left join on one key, whose rows with a null key go to tasks by a hash of the columns ``by`` instead of all to one."""
    spread = F.when(F.col(on).isNull(), F.xxhash64(*by)).otherwise(0)
    # 0, but not a literal: Spark would take that out of the join keys
    right = small.withColumn("_spread", F.pmod(F.xxhash64(on), F.lit(1)))
    return big.withColumn("_spread", spread).join(right, [on, "_spread"], "left").drop("_spread")
