"""Lookups and patches by key.

Lookups are small by nature (one value per key) but the record side is not,
and a lookup key may be hot (one key on a third of the records). Lookups are
plain joins: AQE broadcasts a lookup by its measured size, so a hot key costs
nothing, and splits the skewed key of a larger one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SENTINEL = "Unknown"


def _nonempty(c: F.Column) -> F.Column:
    return c.isNotNull() & (c != F.lit(""))


def build_lookup(df: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """(key, value) with empty keys/values skipped and the last duplicate (by
    ``pos``) winning. Aggregated in each task before the shuffle, so a hot key is fine."""
    k, v = F.col(key).cast("string"), F.col(value).cast("string")
    return (
        df.where(_nonempty(k) & _nonempty(v))
        .groupBy(k.alias("key"))
        .agg(F.max_by(v, F.col(pos)).alias("value"))
    )


def literal_lookup(spark: SparkSession, mapping: dict[str, str]) -> DataFrame:
    """An inline name -> value mapping as a two-column DataFrame."""
    return spark.createDataFrame(list(mapping.items()), "key string, value string")


def _hits(records: DataFrame, lookup: DataFrame, on: str) -> DataFrame:
    lk = lookup.select(F.col("key").alias("_lk"), F.col("value").alias("_hit"))
    return records.join(lk, F.col(on).cast("string") == F.col("_lk"), "left").drop("_lk")


def enrich(
    records: DataFrame, lookup: DataFrame, on: str, out_col: str, default: str = SENTINEL
) -> DataFrame:
    """Equi lookup by ``on``; a miss gives ``default``."""
    return _hits(records, lookup, on).withColumn(out_col, F.coalesce("_hit", F.lit(default))).drop("_hit")


def patch_conditional(
    records: DataFrame, lookup: DataFrame, on: str, col: str, sentinel: str = SENTINEL,
    flag: str = "patched"
) -> DataFrame:
    """Replace ``col`` only where it equals ``sentinel`` and the key is found."""
    j = _hits(records, lookup, on)
    fix = (F.col(col) == F.lit(sentinel)) & F.col("_hit").isNotNull()
    return j.withColumn(flag, F.coalesce(fix, F.lit(False))).withColumn(
        col, F.when(fix, F.col("_hit")).otherwise(F.col(col))
    ).drop("_hit")


def patch_overwrite(
    records: DataFrame, lookup: DataFrame, on: str, col: str, flag: str = "changed"
) -> DataFrame:
    """Overwrite ``col`` from the lookup, keeping the old value on a miss (a
    missing old value reads as ''); ``flag`` marks rows whose value changed."""
    j = _hits(records, lookup, on)
    old = F.coalesce(F.col(col), F.lit(""))
    new = F.coalesce(F.col("_hit"), old)
    return j.withColumn(flag, ~new.eqNullSafe(old)).withColumn(col, new).drop("_hit")


def patch_stats(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """One row: count of each flag plus the total."""
    return df.agg(
        *[F.count_if(F.col(c)).alias(name) for name, c in flags.items()],
        F.count(F.lit(1)).alias("total"),
    )
