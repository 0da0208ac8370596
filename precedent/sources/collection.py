"""The case collection on storage: rebuild, open, count.

A rebuild writes a new version folder (rows of one label lie in one of a few hash
folders, and the label stays a data column, so it comes back as it was) and
never overwrites the folder it reads from; callers switch to the returned path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precedent.session import scratch_dir
from precedent.sources.json_io import _exists

FOLDER, FOLDERS, SALTS = "label_folder", 32, 8


def rebuild(df: DataFrame, path: str | None = None, partition_by: str | None = "industry") -> str:
    """Write the collection to a fresh version folder (drop + create + bulk
    add in one distributed overwrite) and return its path."""
    out = path or scratch_dir(df.sparkSession, "collection")
    if not partition_by:
        df.write.mode("overwrite").parquet(out)
        return out
    # a folder per hash of the label; the salt spreads a label that many rows share
    dealt = df.withColumn(FOLDER, F.pmod(F.xxhash64(partition_by), F.lit(FOLDERS)).cast("int"))
    salt = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind]), F.lit(SALTS))
    dealt.repartition(FOLDER, salt).write.mode("overwrite").partitionBy(FOLDER).parquet(out)
    return out


def open_collection(spark: SparkSession, path: str) -> DataFrame:
    """Open an existing collection; a missing one is an error."""
    if not _exists(spark, path):
        from pyspark.errors import AnalysisException

        raise AnalysisException(f"[PATH_NOT_FOUND] collection does not exist: {path}")
    return spark.read.parquet(path).drop(FOLDER)


def rebuild_and_check(df: DataFrame, path: str | None = None, partition_by: str | None = "industry") -> DataFrame:
    """Rebuild, reopen and compare counts: one row (source_count,
    written_count, ok)."""
    out = rebuild(df, path, partition_by)
    written = open_collection(df.sparkSession, out).select(F.count(F.lit(1))).scalar()
    return (
        df.agg(F.count(F.lit(1)).alias("source_count"))
        .withColumn("written_count", written)
        .withColumn("ok", F.col("source_count") == F.col("written_count"))
    )


def patched_version(df: DataFrame, base: str) -> str:
    """In-place patch semantics without reading and overwriting one path:
    write next to ``base`` under a new version folder."""
    out = scratch_dir(df.sparkSession, base.rstrip("/").rsplit("/", 1)[-1] + "-v")
    df.write.mode("overwrite").parquet(out)
    return out
