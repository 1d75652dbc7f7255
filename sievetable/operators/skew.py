"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_HOT_WEIGHT = 100_000
# Several salts for a share, as two that meet in one partition would undo the spread.
SALTS_PER_SHARE = 4


def salted_join(
    large: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    weight: str | None = None,
    *,
    how: str = "inner",
    hot_weight: int = LEAST_HOT_WEIGHT,
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Join where ``small`` has one row per key and ``large`` may be very uneven.

    A key is hot when it weighs more than a task's even share of all rows (and
    ``hot_weight`` at least), so there are fewer hot keys than shuffle partitions
    and their broadcast is bounded by that. A hot key gets ``SALTS_PER_SHARE``
    salts for each share it holds; every other key takes the ordinary shuffle.
    The weight of a key is a column of ``small``, or its count in ``large``.
    """
    keys = list(on)
    if weight is None:
        weighed, weight = large.groupBy(*keys).agg(F.count(F.lit(1)).alias("_weight")), "_weight"
    else:
        weighed = small
    partitions = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = weighed.agg(F.sum(weight).cast("double").alias("total")).scalar()
    share = F.greatest(F.lit(float(hot_weight)), total / partitions)
    heavy = weighed.select(*keys, F.col(weight).alias("_weight"), share.alias("_share"))
    hot = heavy.filter(F.col("_weight") >= F.col("_share")).select(
        *keys, (SALTS_PER_SHARE * F.ceil(F.col("_weight") / F.col("_share"))).cast("bigint").alias("_salts")
    )
    spread = [F.col(c) for c in (spread_by or [c for c in large.columns if c not in keys])]
    slot = F.pmod(F.xxhash64(*spread), F.col("_salts"))
    salt = F.coalesce(F.when(F.col("_salts").isNotNull(), slot), F.lit(-1))
    left = large.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt.cast("bigint"))
    none = F.lit(-1).cast("bigint")
    copies = F.when(
        F.col("_salts").isNotNull(), F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1)
    ).otherwise(F.array(none))
    right = small.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(copies))
    joined = left.drop("_salts").join(right.drop("_salts"), [*keys, "_salt"], how)
    return joined.drop("_salt")
